"""Data vault: B7 hub, B8 link, B9 satellite, W5 change detection, J9 read-back.

Hash keys are md5 of the business key (same rule as surrogate keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions import surrogate_key
from kiln.operators.common import latest
from kiln.session import saved


def _cols(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def hashdiff(*attrs) -> Column:
    """md5 over the attribute values, written as in a surrogate key: NULL and '' differ."""
    return surrogate_key(*attrs)


# B7 -------------------------------------------------------------------------
def hub(df: DataFrame, entity: str, nk, load_ts: str, source: str | Column) -> DataFrame:
    """``hub_<entity>``: one row per business key with its first load time and source."""
    nk = _cols(nk)
    src = F.lit(source) if isinstance(source, str) else source
    rows = df.select(*nk, F.col(load_ts).alias("load_ts"), src.alias("record_source"))
    if isinstance(source, str):  # one source: a plain minimum, which hashes
        first = rows.groupBy(*nk).agg(F.min("load_ts").alias("load_ts")).withColumn("record_source", F.lit(source))
    else:
        first = (rows.groupBy(*nk).agg(F.min(F.struct("load_ts", "record_source")).alias("__f"))
                 .select(*nk, F.col("__f.load_ts").alias("load_ts"), F.col("__f.record_source").alias("record_source")))
    return first.select(surrogate_key(*nk).alias(f"{entity.lower()}_hk"), *nk, "load_ts", "record_source")


# B8 -------------------------------------------------------------------------
def link(df: DataFrame, name: str, parts: list, load_ts: str, source: str,
         existing: DataFrame | None = None) -> DataFrame:
    """``lnk_<name>``: distinct key combinations with their hub keys and first load.

    ``parts`` is ``[(entity, nk cols)]``.  Rows already in ``existing`` are dropped.
    """
    all_nk = [c for _, nk in parts for c in _cols(nk)]
    first = (df.select(*all_nk, F.col(load_ts).alias("load_ts"))
             .groupBy(*all_nk).agg(F.min("load_ts").alias("load_ts")))
    hks = [surrogate_key(*_cols(nk)).alias(f"{e.lower()}_hk") for e, nk in parts]
    out = first.select(surrogate_key(*all_nk).alias(f"{name.lower()}_hk"), *hks, "load_ts",
                       F.lit(source).alias("record_source"))
    if existing is not None:
        out = out.join(existing.select(f"{name.lower()}_hk"), f"{name.lower()}_hk", "left_anti")
    return out


# W5 -------------------------------------------------------------------------
HEAVY_ROWS = 1_000_000  # of one key in one bucket; more are cut further
MANY_HEAVY = 50_000


def _cuts(x: DataFrame, key: str, ts: str, heavy_rows: int) -> DataFrame | None:
    """``key, __b, __cuts``: times that cut heavy (key, bucket) groups into parts of about ``heavy_rows``; None if none is heavy."""
    heavy = saved(x.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_rows))
    n = heavy.count()
    if not n:
        return None
    most = heavy.agg(F.max("n")).first()[0]
    parts = -(-most // heavy_rows)
    side = F.broadcast(heavy) if n <= MANY_HEAVY else heavy  # otherwise joined through an exchange
    kind = dict(x.dtypes)[ts]
    micros = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(ts)
    rows = x.select(key, "__b", micros.alias("__t")).join(side.select(key, "__b"), [key, "__b"], "left_semi")
    cuts = F.percentile_approx("__t", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000))
    return saved(rows.groupBy(key, "__b").agg(F.array_distinct(cuts).alias("__cuts")))


def changes(df: DataFrame, key: str, ts: str, diff: str, bucket: Column | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rows whose ``diff`` differs from the previous row of the same key (by ``ts``, then ``diff``).

    Two levels, so a key with a third of all rows is not sorted in one task:
    ``lag`` runs inside (key, time bucket) partitions; the first row of a
    bucket compares with the last row of the key's previous bucket, found
    from one summary row per (key, bucket).  Default bucket: the day of ``ts``.
    A bucket of over ``heavy_rows`` rows of one key is cut at quantiles of its
    times; rows of one time stay together.
    """
    b = bucket if bucket is not None else F.to_date(F.col(ts))
    x = df.withColumn("__b", b)
    cuts = _cuts(x, key, ts, heavy_rows)
    if cuts is None:
        x = x.withColumn("__p", F.lit(0))
    else:
        kind = dict(df.dtypes)[ts]
        at = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(ts)
        side = cuts.select(F.col(key).alias("__k"), F.col("__b").alias("__kb"), "__cuts")
        side = F.broadcast(side) if side.count() <= MANY_HEAVY else side
        x = x.join(side, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
        x = x.withColumn("__p", F.coalesce(F.size(F.filter("__cuts", lambda c: c < at)), F.lit(0))).drop("__k", "__kb", "__cuts")
        x = x.withColumn("__p", F.greatest("__p", F.lit(0)))  # size of a null list is -1 or null
    w_in = Window.partitionBy(key, "__b", "__p").orderBy(ts, diff)
    x = x.withColumn("__prev", F.lag(diff).over(w_in))
    last = x.groupBy(key, "__b", "__p").agg(F.max(F.struct(F.col(ts).alias("t"), F.col(diff).alias("d"))).alias("__l"))
    prev_b = last.select(key, "__b", "__p", F.lag("__l.d").over(Window.partitionBy(key).orderBy("__b", "__p")).alias("__pb"))
    x = x.join(prev_b, [key, "__b", "__p"], "left")
    prev = F.when(F.col("__prev").isNull(), F.col("__pb")).otherwise(F.col("__prev"))
    return x.filter(prev.isNull() | (prev != F.col(diff))).drop("__b", "__p", "__prev", "__pb")


# B9 -------------------------------------------------------------------------
def satellite(df: DataFrame, entity: str, nk, attrs, load_ts: str, source: str,
              existing: DataFrame | None = None) -> DataFrame:
    """``sat_<entity>`` rows to insert: attributes + hashdiff, only on change.

    Within the load, consecutive repeats per key are dropped (W5).  Against
    ``existing``, a key's first new row is dropped when it equals the key's
    latest stored row (latest is a max-struct aggregate, no window).
    """
    nk, attrs = _cols(nk), _cols(attrs)
    hk = f"{entity.lower()}_hk"
    rows = df.select(surrogate_key(*nk).alias(hk), F.col(load_ts).alias("load_ts"), *attrs) \
        .withColumn("hashdiff", hashdiff(*attrs))
    if existing is not None:
        cur = latest(existing.select(hk, "load_ts", "hashdiff"), hk, ["load_ts", "hashdiff"])
        # seed each key with its stored latest row so W5 compares across loads
        seed = cur.select(hk, "load_ts", *[F.lit(None).cast(t).alias(a) for a, t in rows.select(*attrs).dtypes],
                          "hashdiff", F.lit(True).alias("__seed"))
        rows = rows.withColumn("__seed", F.lit(False)).unionByName(seed)
        out = changes(rows, hk, "load_ts", "hashdiff").filter(~F.col("__seed")).drop("__seed")
    else:
        out = changes(rows, hk, "load_ts", "hashdiff")
    return out.withColumn("record_source", F.lit(source))


# J9 -------------------------------------------------------------------------
def vault_current(hub_df: DataFrame, hk: str, sats: list, link_df: DataFrame | None = None) -> DataFrame:
    """Hub joined to the latest row of each satellite (and optionally a link)."""
    out = hub_df
    for i, s in enumerate(sats):
        cur = latest(s, hk, ["load_ts", "hashdiff"])
        keep = [c for c in cur.columns if c not in (hk, "record_source")]
        cur = cur.select(hk, *[F.col(c).alias(f"{c}_{i}" if c in ("load_ts", "hashdiff") else c) for c in keep])
        out = out.join(cur, hk, "left")
    if link_df is not None:
        out = out.join(link_df.drop("load_ts", "record_source"), hk, "left")
    return out
