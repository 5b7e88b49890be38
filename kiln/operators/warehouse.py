"""Star and snowflake building: B1-B6, B10, B11, J1, J4, J8, A11, Q1.

Surrogate keys are ``md5`` of the business key (kiln.functions.surrogate_key),
so a fact row computes its own dimension key without looking it up.  J1 only
asks whether the dimension has the key: one left join with its distinct keys,
whose strategy is left to the adaptive planner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import surrogate_key, unknown_key
from kiln.operators.common import first_wins

def _cols(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


# B1 -------------------------------------------------------------------------
def bronze(df: DataFrame, source: str, batch_id: str, load_ts: str | None = None) -> DataFrame:
    """Source rows unchanged plus load time, source name and batch id."""
    ts = F.lit(load_ts).cast("timestamp_ntz") if load_ts else F.localtimestamp()
    return df.select("*", ts.alias("_load_ts"), F.lit(source).alias("_source"),
                     F.lit(batch_id).alias("_batch_id"))


def append_bronze(df: DataFrame, path: str, source: str, batch_id: str, load_ts: str | None = None) -> str:
    """Append a batch to the bronze dataset at ``path``, in a folder per load date and batch.

    Loading a batch of a date again replaces that batch and nothing else, so a
    retried load leaves no rows twice.
    """
    rows = bronze(df, source, batch_id, load_ts).withColumn("_load_date", F.to_date("_load_ts"))
    (rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("_load_date", "_batch_id").parquet(path))
    return path


# B2 -------------------------------------------------------------------------
def silver(df: DataFrame, key, order, casts: dict | None = None, trim: bool = True) -> DataFrame:
    """Conform: trim text, cast to target types, one row per business key (first wins)."""
    casts = casts or {}
    sel = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if trim and dtype == "string":
            c = F.trim(c)
        if name in casts:
            c = c.cast(casts[name])
        sel.append(c.alias(name))
    return first_wins(df.select(*sel), key, order)


# B3 -------------------------------------------------------------------------
def dimension(df: DataFrame, entity: str, nk, attrs, order=None,
              with_unknown: bool = True) -> DataFrame:
    """``DIM_<entity>``: ``<entity>_sk``, the business key as an attribute, attributes.

    One row per business key (first by ``order``, default the key); an
    unknown member (key NULL, sk = md5('-1')) is added for orphan facts.
    """
    nk, attrs = _cols(nk), _cols(attrs)
    base = first_wins(df.select(*nk, *attrs), nk, order or nk)
    sk = f"{entity.lower()}_sk"
    dim = base.select(surrogate_key(*nk).alias(sk), *nk, *attrs)
    if with_unknown:
        unk = dim.sparkSession.range(1).select(
            unknown_key().alias(sk),
            *[F.lit(None).cast(dict(dim.dtypes)[c]).alias(c) for c in nk + attrs])
        dim = dim.unionByName(unk)
    return dim


# J1 -------------------------------------------------------------------------
def resolve_keys(fact: DataFrame, fk, dim: DataFrame, dim_nk, sk_name: str) -> DataFrame:
    """Add ``sk_name`` = md5(business key), or the unknown key for orphans and for keys with a NULL.

    One left join with the dimension's distinct keys: no action, no forced
    strategy.  A small dimension is broadcast by size at run time, a large one
    is joined through exchanges, where hot keys are split.
    """
    marked = _mark_known(fact, fk, dim, dim_nk, "__known")
    return marked.select(*[F.col(c) for c in fact.columns], _resolved(fk, "__known").alias(sk_name))


def _mark_known(fact: DataFrame, fk, dim: DataFrame, dim_nk, flag: str) -> DataFrame:
    """Whether the dimension has the row's key, as the column ``flag``."""
    fk, dim_nk = _cols(fk), _cols(dim_nk)
    keys = dim.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(dim_nk)]).dropna().distinct()
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__k{i}") for i, a in enumerate(fk)])
    joined = fact.join(keys, same, "left")
    return joined.select(*[F.col(c) for c in fact.columns], F.col("__k0").isNotNull().alias(flag))


def _resolved(fk, flag: str) -> Column:
    return F.when(F.col(flag), surrogate_key(*_cols(fk))).otherwise(unknown_key())


# B4 -------------------------------------------------------------------------
def fact(df: DataFrame, dims: list, measures, degenerate=()) -> DataFrame:
    """``FACT_<process>``: only ``_sk`` references, degenerate ids and measures.

    ``dims`` is a list of ``(fk_cols, dim_df, dim_nk_cols, sk_name)``; a
    ``dim_df`` of None means the key is hashed without an orphan check
    (for generated dimensions such as dates).
    """
    out = df
    sks = {}
    for i, (fk, ddf, dnk, sk) in enumerate(dims):
        if ddf is None:
            sks[sk] = surrogate_key(*_cols(fk))
        else:
            out = _mark_known(out, fk, ddf, dnk, f"__known{i}")
            sks[sk] = _resolved(fk, f"__known{i}")
    # hashed after the last join: the exchanges carry a flag a dimension, not its hash
    out = out.withColumns(sks)
    meas = [m if isinstance(m, Column) else F.col(m) for m in _cols(measures)]
    return out.select(*sks, *[F.col(d) for d in degenerate], *meas)


# B5 -------------------------------------------------------------------------
def snowflake_chain(levels: list) -> list:
    """Normalised sub-dimensions linked by ``_sk``.

    ``levels`` runs from the leaf to the top: ``(entity, df, nk, attrs, parent_nk)``
    where ``parent_nk`` names the column of ``df`` holding the next level's key.
    Returns the dimension DataFrames in the same order.
    """
    out = []
    for i, (entity, df, nk, attrs, parent_nk) in enumerate(levels):
        d = dimension(df, entity, nk, list(_cols(attrs)) + ([parent_nk] if parent_nk else []))
        if parent_nk:
            parent_entity = levels[i + 1][0]
            d = d.withColumn(f"{parent_entity.lower()}_sk",
                             F.when(F.col(parent_nk).isNull(), unknown_key())
                             .otherwise(surrogate_key(parent_nk))).drop(parent_nk)
        out.append(d)
    return out


# A11 ------------------------------------------------------------------------
def mart(fact_df: DataFrame, sk: str, dim: DataFrame, by, sums: dict, counts: dict | None = None,
         averages: dict | None = None) -> DataFrame:
    """Gold aggregate by dimension attributes: sums, counts, averages (of non-NULL values).

    The fact is first aggregated on its dimension key (partial aggregation on
    every task, so the join sees at most one row per key), then joined to the
    dimension and rolled up to ``by``.
    """
    counts, averages = counts or {}, averages or {}
    by = _cols(by)
    pre = fact_df.groupBy(sk).agg(
        *[F.sum(F.col(src)).alias(f"__s_{name}") for name, src in sums.items()],
        *[F.count(F.lit(1) if src == "*" else F.col(src)).alias(f"__c_{name}") for name, src in counts.items()],
        *[x for name, src in averages.items() for x in (F.sum(src).alias(f"__a_{name}"), F.count(src).alias(f"__n_{name}"))])
    joined = pre.join(dim.select(sk, *by), sk, "left")
    return joined.groupBy(*by).agg(
        *[F.sum(f"__s_{n}").cast("decimal(38,2)").alias(n) for n in sums],
        *[F.sum(f"__c_{n}").cast("long").alias(n) for n in counts],
        *[(F.sum(f"__a_{n}").cast("double") / F.nullif(F.sum(f"__n_{n}"), F.lit(0))).alias(n) for n in averages])


# J8 / B6 ----------------------------------------------------------------------
def drill_across(facts: list, on) -> DataFrame:
    """Several facts, each aggregated to the conformed keys ``on``, then full-outer joined
    (a NULL key meets a NULL key).

    ``facts`` is a list of ``(df, {name: Column aggregate})``.
    """
    on = _cols(on)
    parts = [df.groupBy(*on).agg(*[a.alias(n) for n, a in aggs.items()]) for df, aggs in facts]
    out = parts[0]
    for p in parts[1:]:
        q = p.withColumnsRenamed({c: f"__{c}" for c in on})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
        out = out.join(q, same, "full_outer")
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in on}).drop(*[f"__{c}" for c in on])
    return out


# Q1 -------------------------------------------------------------------------
def check_pk(df: DataFrame, key) -> DataFrame:
    """Key values that are NULL or repeated, with their row count."""
    key = _cols(key)
    null_any = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter((F.col("n_rows") > 1) | null_any)
            .withColumn("violation", F.when(null_any, "null_key").otherwise("duplicate_key")))


# J4 -------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk, pk) -> DataFrame:
    """Child rows whose foreign key has no parent (NULL keys are not orphans)."""
    fk, pk = _cols(fk), _cols(pk)
    cond = reduce(lambda a, b: a & b, [child[a] == parent[b] for a, b in zip(fk, pk)])
    return child.join(parent.select(*pk), cond, "left_anti") \
        .filter(reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in fk]))


# B10 ------------------------------------------------------------------------
def normalize(df: DataFrame, entities: dict) -> dict:
    """3NF split: ``{name: (key cols, attr cols)}`` -> one DataFrame per entity.

    Each entity keeps one row per key (first by key and attributes).
    """
    out = {}
    for name, (key, attrs) in entities.items():
        key, attrs = _cols(key), _cols(attrs)
        out[name] = first_wins(df.select(*key, *attrs), key, attrs or key)
    return out


# B11 ------------------------------------------------------------------------
def event_stream_model(df: DataFrame, event_id: str, ts: str, partitions: int | None = None) -> DataFrame:
    """Append-only event table: one row per event id (earliest wins), an event
    date for partition pruning, rows range-partitioned by time and sorted
    within each partition."""
    one = first_wins(df, event_id, [ts])
    out = one.withColumn("event_date", F.to_date(F.col(ts)))
    if partitions:
        out = out.repartitionByRange(partitions, "event_date", ts)
    return out.sortWithinPartitions("event_date", ts, event_id)


def date_key(c) -> Column:
    """Integer yyyymmdd key of a date or timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyyMMdd").cast(T.IntegerType())
