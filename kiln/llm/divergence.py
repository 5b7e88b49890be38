"""How the sources of a language differ in their use of its vocabulary.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z
lower-cased.  A language keeps the terms that at least ``MIN_DOCS`` of its
documents hold.  Kept terms are sorted over the whole table (ranges, no single
task) and numbered by their place in the language; each run of ``BLOCK_TERMS``
becomes a minimal acyclic transducer, built where its terms lie.  All texts
are then streamed through the transducers of their language, which recounts
the terms per (language, source, number).  Transducers are broadcast
``BROADCAST_BYTES`` at a time (a larger vocabulary takes more passes over the
texts, never a larger broadcast; a single block alone may be larger).

Probabilities are integers, ``1 + floor(1e9 (count + 5) / (N + 5 V))``, worked
out in decimals.  Sources are compared in tiles of ``TILE`` sources by
``SPAN`` terms, as dense matrices, and partial sums are added up by pair.
Equal values rank by number, which is UTF-8 order (terms), or by name.

Null text, language or source is ''.  A group without terms takes part.
Repeated rows count each; ids and extra columns are ignored.  Texts of any
length are taken whole.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm import scan, transducer
from kiln.llm.components import saved

MIN_DOCS = 30
TOP_TERMS = 50
BLOCK_TERMS = 1 << 18
BROADCAST_BYTES = 64 << 20
TILE = 128
SPAN = 2048
HELD = 1 << 18
TEXT_BYTES = 4 << 20
_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
# every byte of a term as its lower case, every other byte as a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def _document_counts(batches):
    """Number of documents of each (language, term) in this task, in parts."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, terms in held.items():
            keys = list(terms)
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([terms[t] for t in some], pa.int64())], ["lang", "term", "n"])
        held.clear()

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(set(text.translate(_FOLD).split()))
            if sum(map(len, held.values())) > 4 * HELD:
                yield from rows()
    yield from rows()


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("ordinal")
    made = transducer.build(t.column("term").to_pylist()).arrays()
    return pa.table({"lang": [t.column("lang")[0].as_py()], "first": [t.column("ordinal")[0].as_py()], "parts": pa.array([made], pa.list_(pa.binary()))})


class _Recount:
    """Counts by (language, source, number) of the texts of a task."""

    def __init__(self, blocks):
        self.machines: dict[str, list] = {}
        for lang, first, parts in blocks:
            self.machines.setdefault(lang, []).append((first, transducer.Transducer.of(parts)))
        self.texts: dict[str, list] = {}
        self.size, self.found = 0, {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        if lang in self.machines:
            self.texts.setdefault(lang, []).append((source, text))
            self.size += len(text)

    def count(self) -> None:
        for lang, rows in self.texts.items():
            names = sorted({s for s, _ in rows})
            number = {s: i for i, s in enumerate(names)}
            x = np.frombuffer(b"".join(t + b" " for _, t in rows).translate(_FOLD), np.uint8)
            to = np.cumsum([len(t) + 1 for _, t in rows])
            term = x != 32
            edge = np.diff(term.astype(np.int8), prepend=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            group = np.fromiter((number[s] for s, _ in rows), np.int64, len(rows))[np.searchsorted(to, start, "right")]
            for first, machine in self.machines[lang]:
                place = machine.places(x, start, end)
                hit = place >= 0
                keys, n = np.unique(group[hit] << 32 | place[hit], return_counts=True)
                cuts = np.searchsorted(keys >> 32, np.arange(len(names) + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a:
                        self.found.setdefault((lang, names[i]), []).append((first + (keys[a:b] & 0xFFFFFFFF), n[a:b]))
        self.texts, self.size = {}, 0

    def rows(self):
        self.count()
        for (lang, source), parts in self.found.items():
            at, n = (np.concatenate(v) for v in zip(*parts))
            at, back = np.unique(at, return_inverse=True)
            n = np.bincount(back, weights=n).astype(np.int64)
            for i in range(0, len(at), 1 << 16):
                some = slice(i, i + (1 << 16))
                k = len(at[some])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(at[some]), pa.array(n[some])], ["lang", "source", "ordinal", "n"])
        self.found = {}


def _recount(shared):
    def run(batches):
        r = _Recount(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for row in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    r.add(*row)
                if r.size >= TEXT_BYTES:
                    r.count()
                if sum(len(v) for parts in r.found.values() for v, _ in parts) > 4 * HELD:
                    yield from r.rows()
        yield from r.rows()

    return run


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, ordinal``: the kept terms with their place in the language's UTF-8 order, from 0."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")
    numbered = scan.running(scan.ordered(kept, "lang", "term"), ["lang"], {"ordinal": F.lit(1).cast("long")})
    return scan.written(numbered.select("lang", "term", (F.col("ordinal") - 1).alias("ordinal")), "vocabulary")


def recount(docs: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``lang, source, ordinal, n``: occurrences of the kept terms, counted by streaming the texts through transducers."""
    spark = docs.sparkSession
    made = scan.written(terms.groupBy("lang", F.floor(F.col("ordinal") / block).alias("block")).applyInArrow(
        lambda t: _build(t.drop_columns("block") if "block" in t.column_names else t), "lang string, first long, parts array<binary>"), "transducers")
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    loads, filled = [], limit + 1
    for r in made.select("lang", "first", size.alias("size")).orderBy("lang", "first").collect():  # a row per BLOCK_TERMS terms
        if filled + r["size"] > limit:
            loads.append([])
            filled = 0
        loads[-1].append((r["lang"], r["first"]))
        filled += r["size"]
    passes = []
    for load in loads:
        low, high = load[0], load[-1]
        place = F.struct("lang", "first")
        rows = made.where((place >= F.struct(F.lit(low[0]), F.lit(low[1]).cast("long"))) & (place <= F.struct(F.lit(high[0]), F.lit(high[1]).cast("long")))).collect()
        shared = spark.sparkContext.broadcast([(r["lang"], r["first"], [bytes(p) for p in r["parts"]]) for r in rows])
        passes.append(docs.select("lang", "source", "text").mapInArrow(_recount(shared), "lang string, source string, ordinal long, n long"))
    if not passes:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    return reduce(DataFrame.unionByName, passes).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _share(n, total, v):
    """1 + floor(1e9 (n + 5) / (total + 5 v)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(v > 0, F.expr("1").cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * wide(n + 5), wide(total + 5 * v)))


def _tile(tile: int, t: pa.Table) -> pa.Table:
    """Partial distances of all pairs of sources of two tiles over one span of terms."""
    col = lambda c: t.column(c).to_numpy()
    who, at, p = col("src"), col("at"), col("p")
    left, right, width = t.column("left")[0].as_py(), t.column("right")[0].as_py(), t.column("width")[0].as_py()
    mark = at < 0
    src = np.unique(who[mark])
    m = np.zeros((len(src), width), np.int64)
    m[np.searchsorted(src, who[mark])] = p[mark][:, None]
    m[np.searchsorted(src, who[~mark]), at[~mark]] = p[~mark]
    ones, others = np.flatnonzero(src // tile == left), np.flatnonzero(src // tile == right)
    a, b, f = [], [], []
    for i in ones:
        d = np.abs(m[others] - m[i]).sum(axis=1)
        keep = others != i
        a.append(np.full(keep.sum(), src[i]))
        b.append(src[others[keep]])
        f.append(d[keep])
    a, b, f = (np.concatenate(v).astype(np.int64) for v in (a, b, f))
    if left != right:
        a, b, f = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((f, f))
    return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "f": f})


def _tiled(df: DataFrame, tile: int) -> DataFrame:
    """Rows once for each tile that theirs is compared with."""
    own = F.floor(F.col("src") / tile).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return df.select("*", own.alias("own"), other).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """Part ``pair``: distance of each source from each other one of its language; part ``term``: the terms that a source
    uses more than its language does, up to rank ``top_terms``."""
    empty = F.lit("")
    docs = df.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"),
                     F.coalesce(F.col(text), empty).cast("binary").alias("text"))
    terms = vocabulary(docs, min_docs)
    counts = scan.written(recount(docs, terms), "recounts")
    kinds = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    group_n = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).join(group_n, ["lang", "source"], "left").join(kinds, "lang", "left")
              .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), number.alias("src")))
    groups = saved(groups.withColumn("tiles", (F.floor(F.max("src").over(Window.partitionBy("lang")) / tile) + 1).cast("int")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))

    spans = F.greatest(F.ceil(F.col("v") / span).cast("int"), F.lit(1))
    marks = (groups.select("lang", "src", "tiles", "v", F.coalesce(_share(zero, F.col("total"), F.col("v")), zero).alias("p"), F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"))
             .withColumn("at", F.lit(-1).cast("long")))
    cells = shares.select("lang", "src", "tiles", "v", "p", F.floor(F.col("ordinal") / span).cast("int").alias("span"), (F.col("ordinal") % span).alias("at"))
    width = F.least(F.lit(span).cast("long"), F.col("v") - F.col("span").cast("long") * span).alias("width")
    cells = _tiled(marks.unionByName(cells), tile).select("lang", "span", "left", "right", width, "src", "at", "p")
    apart = cells.groupBy("lang", "span", "left", "right").applyInArrow(lambda t: _tile(tile, t), "lang string, a long, b long, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    name = lambda side, as_: groups.select("lang", F.col("src").cast("long").alias(side), F.col("source").alias(as_))
    pairs = apart.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    more = shares.join(of_lang, ["lang", "ordinal"]).join(langs, "lang")
    more = more.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("value > 0")
    more = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top_terms)
    more = more.join(terms.select("lang", "ordinal", F.col("term").cast("string").alias("item")), ["lang", "ordinal"])
    shown = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown("pair", pairs).unionByName(shown("term", more))


ORACLE = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.total + 5 * v.v)::HUGEINT AS p
  FROM t JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)::HUGEINT) // ((SELECT sum(total) FROM t WHERE t.lang = p.lang) + 5 * any_value(v))::HUGEINT AS q
  FROM p JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL BY NAME
  SELECT * FROM (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r
"""
