"""Source profiling: A1-A4, W6, P2, P9, G1.

One scan per table: row count and a distinct count of every column come
out of a single aggregate (partial aggregation on every task, one small
final merge).  The exact counts deal every row's values out as (column number,
value as 128 bits) and aggregate those twice over one exchange: no row is
copied whole, long texts travel as hashes.  What needs names and types only
reads the schemas.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.functions import base_type, is_key_name, is_pii_name
from kiln.sources.tables import describe

TABLE_SCHEMA = "table_name string, row_count long, error string"


def schema_columns(tables: dict) -> DataFrame:
    """Columns of the tables with key and PII flags, from the schemas alone: no scan."""
    parts = [describe(df, name) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "ordinal", "column_name", "data_type", "nullable",
        is_key_name("column_name").alias("is_key"), is_pii_name("column_name").alias("is_pii"))


_WHOLE = {"boolean", "tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz"}  # fit a long as they are


def _value(name: str, kind: str):
    """A column's value as two longs, NULL for NULL: itself where it fits one, else two hashes with different seeds (of texts
    for nested values, whose own hashes skip NULLs)."""
    c = F.col(f"`{name}`")
    if kind == "date":
        pair = F.struct(F.unix_date(c).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    elif kind.startswith("timestamp"):
        pair = F.struct(F.unix_micros(c.cast("timestamp")).alias("a"), F.lit(0).cast("long").alias("b"))
    elif kind in _WHOLE:
        pair = F.struct(c.cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    else:
        v = c + F.lit(0).cast(kind) if kind in ("double", "float") else c  # one zero
        if kind.startswith(("array", "struct")):
            v = v.cast("string")
        pair = F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("again"), v).alias("b"))
    return F.when(c.isNotNull(), pair)


def exact_counts(df: DataFrame) -> tuple[int, list[int]]:
    """(rows, distinct values of each column), without NULLs."""
    cells = [F.struct(F.lit(i).alias("c"), _value(f.name, f.dataType.simpleString()).alias("v")) for i, f in enumerate(df.schema.fields)]
    none = F.struct(F.lit(-1).alias("c"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("v"))  # one cell of each row
    each = df.select(F.explode(F.array(none, *cells)).alias("x")).where("x.v is not null").select("x.c", "x.v.a", "x.v.b")
    got = each.groupBy("c", "a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
    by = {r["c"]: r for r in got.collect()}  # a row per column
    return by[-1]["n"] if by else 0, [by[i]["d"] if i in by else 0 for i in range(len(cells))]


def _profile_one(name: str, source, exact: bool):
    """(row count, [(column fields)], error) of one table: one aggregate over one scan."""
    try:
        df = source() if callable(source) else source
        fields = df.schema.fields
        if exact:
            n, distinct = exact_counts(df)
        else:
            got = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"d{i}") for i, f in enumerate(fields)]).first()
            n, distinct = got["n"], [got[f"d{i}"] for i in range(len(fields))]
        return n, [(name, i, f.name, f.dataType.simpleString(), f.nullable, distinct[i]) for i, f in enumerate(fields)], None
    except Exception as e:  # whatever is wrong with one table must not stop the others
        return None, [], f"{type(e).__name__}: {e}"


def profile(spark: SparkSession, tables: dict, exact: bool = False, at_once: int = 5):
    """A1/A2: ``(profile_tables, profile_columns)`` for a dict name -> DataFrame or function giving one.

    Tables are profiled ``at_once`` at a time, each in a job of its own that
    returns one row.  A table that cannot be opened or read gives an error row
    in ``profile_tables`` and no column rows; the other tables go on.
    """
    with ThreadPoolExecutor(at_once) as pool:
        got = list(pool.map(lambda kv: _profile_one(*kv, exact), tables.items()))
    table_rows = [(name, n, error) for name, (n, _, error) in zip(tables, got)]
    column_rows = [c for _, cols, _ in got for c in cols]
    columns = spark.createDataFrame(column_rows, "table_name string, ordinal int, column_name string, data_type string, "
                                                 "nullable boolean, distinct_count long")
    return spark.createDataFrame(table_rows, TABLE_SCHEMA), columns.select(
        "*", is_key_name("column_name").alias("is_key"), is_pii_name("column_name").alias("is_pii"))


# G1 -------------------------------------------------------------------------
TAGS = ["PII", "SENSITIVE", "CONFIDENTIAL"]


def tag(columns: DataFrame, words: dict | None = None) -> DataFrame:
    """Sensitive-column tags: PII by the name heuristic (F8), SENSITIVE and CONFIDENTIAL by the
    words that the policy names for them; the first tag of TAGS that fits."""
    words = words or {}
    tests = {t: reduce(lambda a, b: a | b, [F.lower("column_name").contains(w.lower()) for w in words[t]]) for t in TAGS[1:] if words.get(t)}
    kind = F.when(F.col("is_pii"), "PII")
    for t, test in tests.items():
        kind = kind.when(test, t)
    return columns.select("table_name", "column_name", kind.alias("tag")).filter(F.col("tag").isNotNull())


# P2 -------------------------------------------------------------------------
def flagged(columns: DataFrame, flag: str) -> DataFrame:
    if flag not in ("is_key", "is_pii"):
        raise ValueError("flag must be is_key or is_pii")
    return columns.filter(F.col(flag))


# P9 -------------------------------------------------------------------------
def with_defaults(columns: DataFrame) -> DataFrame:
    """Missing type -> 'TEXT', missing nullable -> true, other missing text -> 'N/A'."""
    out = columns
    for name, dtype in columns.dtypes:
        if name == "data_type":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit("TEXT")))
        elif name == "nullable":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(True)))
        elif dtype == "string":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit("N/A")))
    return out


# A3 -------------------------------------------------------------------------
def type_mix(columns: DataFrame) -> DataFrame:
    """Columns per base type (text before '('), missing type counted as TEXT."""
    return (columns.groupBy(base_type("data_type").alias("base_type"))
            .agg(F.count(F.lit(1)).alias("n_columns")))


# A4 / W6 ----------------------------------------------------------------------
def row_share(tables: DataFrame) -> DataFrame:
    """Rows per table, share of all rows and size rank.

    The window has no partition key on purpose: its input is one row per
    table (the catalogue), never data rows.
    """
    w = Window.partitionBy(F.lit(1))
    ok = tables.filter(F.col("row_count").isNotNull())
    return ok.select(
        "table_name", "row_count",
        (F.col("row_count") / F.sum("row_count").over(w)).cast("decimal(9,6)").alias("row_share"),
        F.rank().over(Window.orderBy(F.col("row_count").desc())).cast("long").alias("size_rank"))


# P8 -------------------------------------------------------------------------
# Tables and columns that a lean profile shows, by level of detail.
LEAN_TABLES = {"macro": 100, "meso": 50, "micro": 50}
LEAN_COLUMNS = {"meso": 8, "micro": 12}


def lean_profile(tables: DataFrame, columns: DataFrame, mode: str = "meso", order: str = "table_name") -> DataFrame:
    """One line of text per profiled table: its name (macro); its row count and first columns with their flags (meso); its
    first columns with their types (micro).  Only the first tables by ``order`` are shown, fewer the more is said of each."""
    shown = tables.filter(F.col("row_count").isNotNull()).orderBy(order).limit(LEAN_TABLES[mode])
    if mode == "macro":
        return shown.select("table_name", F.concat(F.lit("- "), "table_name").alias("line"))
    if mode == "meso":
        text = F.concat("column_name", F.when(F.col("is_key"), "KEY").otherwise(""), F.when(F.col("is_pii"), "PII").otherwise(""))
    else:
        text = F.concat("column_name", F.lit("("), "data_type", F.lit(")"))
    first = (columns.filter(F.col("ordinal") < LEAN_COLUMNS[mode]).groupBy("table_name")
             .agg(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text")))).alias("c")))
    listed = F.concat(F.lit("["), F.array_join(F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>")), ", "), F.lit("]"))
    rows = F.concat(F.lit(" ("), F.col("row_count").cast("string"), F.lit(" rows)")) if mode == "meso" else F.lit("")
    return shown.join(first, "table_name", "left").select("table_name", F.concat(F.lit("- "), "table_name", rows, F.lit(": "), listed).alias("line"))
