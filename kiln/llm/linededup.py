"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document are one window (at least one of
them not blank).  Windows with the same lines are the same wherever they
stand.  The first occurrence, by (doc_id, hash of the text, line number), is
kept; all later ones are covered: the lines that at least one of them covers
are removed and the rest is joined again.  Overlapping windows of a longer
repeated passage cover it whole.

Shape: windows are hashed inside the document's row (every line twice, with
different seeds: 128 bits), counted with map-side combining, and only windows that occur more than once are kept as a
table.  Its join with all windows is between two fresh exchanges, so the
adaptive planner splits a window that a third of the documents share.  What
comes back is one list of window starts per document.

Texts with fewer than three lines have no window and stay as they are, as do
null and empty texts (no lines: 0; an empty text has one).  Rows with equal id and
text are treated alike.  Texts of any length are one row.  Extra columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.components import saved

LINES = 3


def _windows(df: DataFrame) -> DataFrame:
    """``doc_id, th, pos, k1, k2``: one row per window."""
    lines = F.split("text", "\n")
    hashed = df.select("doc_id", F.xxhash64("text").alias("th"), F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("again"), x).alias("g"), (F.trim(x) != "").alias("full"))).alias("l"))
    hashed = hashed.where(F.size("l") >= LINES)

    def window(i):
        part = [F.get("l", i + k) for k in range(LINES)]
        h, g = [p["h"] for p in part], [p["g"] for p in part]
        full = part[0]["full"] | part[1]["full"] | part[2]["full"]
        return F.struct(i.alias("pos"), F.xxhash64(*h).alias("k1"), F.xxhash64(*g).alias("k2"), full.alias("full"))

    each = F.transform(F.sequence(F.lit(0), F.size("l") - LINES), window)
    return hashed.select("doc_id", "th", F.inline(each)).where("full").drop("full")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, text without repeated windows, its lines before (``n_lines``) and the lines removed
    (``n_removed``); ``row`` holds the other columns of the input row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in df.columns if c != text]).alias("row"))
    windows = _windows(docs.select("doc_id", "text").where("text is not null"))
    place = F.struct("doc_id", "th", "pos")
    repeated = saved(windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("k1", "k2", "first"))
    later = windows.join(repeated, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    covered = (later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts"))
               .select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"),
                       F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(LINES)])))).alias("gone")))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), "row")


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i AS pos, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE text IS NOT NULL)
  WHERE trim(l[i], ' ') <> '' OR trim(l[i + 1], ' ') <> '' OR trim(l[i + 2], ' ') <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, pos + k AS line FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
e AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text
       ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines,
  coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN e ON d.doc_id = e.doc_id
"""
