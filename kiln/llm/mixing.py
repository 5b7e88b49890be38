"""Mixing sources to target weights.

A document's size is its number of words.  Sources in code-point order (null
last) take the weights in turn; a target may not exceed ``epochs`` times its
source, and what it can't take goes to the others by weight.  The level that
leaves nobody above is found in one pass: in order of ``limit / weight``, a
source is at its limit as long as its limit is below its share of what the
sources before it left over.

Rows get a hash-random key (MD5 of seed, id and size).  They are range-sorted
by source and key over the whole table, equal rows told apart by a number, so
neither a source nor a group of equal rows is one task's.  Words are summed
inside a range, range sums are summed up per source, and the two together are
the prefix sum of words.  A source's budget is its rounded target: whole
epochs, then documents in key order up to the budget, the last one in part.

Rows travel without their texts; ``apply_mix`` numbers the rows it keeps and
joins the decisions back by number.

Nulls: a null text has size 0; the null source is a source of its own; null
ids are kept.  Rows equal in id, source and size are interchangeable.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm import scan
from kiln.llm.components import saved

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``src, no_src, source_size`` with ``target``: one row per source, so one task suffices."""
    rank = F.row_number().over(Window.orderBy("no_src", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * epochs
    t = sizes.withColumn("w", weight).withColumn("limit", limit)
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "no_src", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = (t.withColumn("total", F.sum("source_size").over(every))
         .withColumn("left_words", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    dec = "decimal(38,0)"
    at_limit = F.col("limit").cast(dec) * F.col("left_weight") <= F.col("left_words").cast(dec) * F.col("w")
    t = t.withColumn("at_limit", at_limit)
    level = F.first(F.when(~F.col("at_limit"), F.struct("left_words", "left_weight")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("level", level)
    shared = F.col("w") * F.col("level.left_words") / F.col("level.left_weight")
    return t.select("src", "no_src", "source_size",
                    F.when(F.col("at_limit"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        epochs: int = EPOCHS, seed: int = SEED, number: str | None = None) -> DataFrame:
    """Per document: id, size, its source's size and target, and the words that the mix takes (repeats counted).

    ``number`` names a column that tells rows apart; it is kept.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    rest = [F.col(number).alias("number")] if number else []
    rows = (df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(source).isNull().alias("no_src"),
                      F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *rest)
            .withColumn("key", F.conv(F.substring(key, 1, 13), 16, 10).cast("long")))
    rows = scan.written(rows if number else rows.withColumn("number", F.monotonically_increasing_id()), "sizes")
    place = ["src", "no_src"]
    laid = scan.ordered(rows, *place, "key", "doc_id", "size", "number")
    summed = scan.running(laid, place, {"sofar": F.col("size")})
    goal = targets(rows.groupBy(*place).agg(F.sum("size").alias("source_size")), weights, epochs)
    budget = F.floor(F.col("target") + 0.5)
    goal = (goal.withColumn("laps", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", budget.cast("long") - F.col("laps") * F.col("source_size")))
    out = summed.join(saved(goal), place)
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("sofar") - F.col("size"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("laps") * F.col("size") + last).alias("taken"), *(["number"] if number else []))


def leading_words(text, n):
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
              epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed rows: each document as often as it is taken whole, and the beginning of one that is taken in part."""
    names = {c: f"_{i}" for i, c in enumerate(df.columns)}
    kept = scan.written(df.withColumnsRenamed(names).withColumn("number", F.monotonically_increasing_id()), "to-mix")
    taken = mix(kept, names[id_col], names[text], names[source], weights, epochs, seed, "number").where("taken > 0").select("number", "size", "taken")
    mixed = kept.join(taken, "number").select("size", "taken", F.struct(*[F.col(v).alias(k) for k, v in names.items()]).alias("row"))
    part = F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = mixed.select("row", F.explode(copies).alias("words"))
    cut = F.when(F.col("words") == 0, F.col("row")[text]).otherwise(leading_words(F.col("row")[text], F.col("words")))
    return each.select(*[cut.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (
  SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR)[1:13] AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS w, 3 * source_size AS lim FROM s),
p AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS lw, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS ww
  FROM w WINDOW b AS (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, lim * ww <= lw * w AS capped FROM p),
g AS (SELECT min(lw) AS lw, min(ww) AS ww FROM (SELECT lw, ww FROM c WHERE NOT capped ORDER BY lim / w, source IS NULL, source LIMIT 1)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN lim::DOUBLE ELSE (c.w * g.lw)::DOUBLE / g.ww::DOUBLE END AS target FROM c, g),
b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS laps FROM t),
o AS (
  SELECT k.*, b.source_size, b.target, b.laps, b.budget - b.laps * b.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (laps * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM o
"""
