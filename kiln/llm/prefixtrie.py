"""A prefix trie of conversations, measured along its Euler tour.

A conversation is rebuilt from the first turns of the conversation that its
block of ``BLOCK`` ids begins with and its own turns after those.  Turns are
ordered by turn number, null first; turns that share a number by the SHA-256
of role and text.  Orders and running sums are found over ranges of the whole
table, so a conversation with a third of all rows takes many tasks.

A sequence of turns is known by a running polynomial of the turns' digests
modulo 2**61 - 1, at two bases (122 bits), which is a prefix sum too.  That
equal values mean equal turns is checked: all rows of a node must agree in the
SHA-256 of their last turn and in their parent, or the job fails.

A node has an enter and an exit arc.  Children follow in the order of their
smallest members: the arc after an enter is the first child's enter or the
node's own exit, the arc after an exit the next sibling's enter or the
parent's exit.  The tour is list-ranked by contraction; leaves and savings of
a subtree are differences of prefix sums between its two arcs.

The ends of a node (ids of the conversations that stop there) are hashed as
one stream: ids are written out in order in pieces, ranges first, and the
pieces of a node then run through SHA-256 one after the other.  No list of ids
is ever held.

Null roles and texts are empty; equal rows are turns of their own; rows
without conv_id belong to no conversation and are left out.  Extra columns are
ignored.  An empty table gives no rows (no conversation, no root).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import listrank, scan

BLOCK = 20
HEADS = 4  # at most HEADS - 1 turns are taken over
PIECE = 4096
_P = (1 << 61) - 1
_BASES = (0x1B873593CC9E2D51 % _P, 0x165667B19E3779F9 % _P)
_WORD = r"[^\x20\x09-\x0D]+"


def _digests(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    role_, text_ = F.coalesce(F.col(role), empty), F.coalesce(F.col(text), empty)
    digest = F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"),
                                                    F.regexp_count(text_, F.lit(_WORD)).cast("long").alias("words"))
    return scan.written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")  # tells equal rows apart


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``conv, depth, digest, words`` of every turn of the rebuilt conversations, ``conv, length``)."""
    rows = _digests(df, conv, turn, role, text)
    laid = scan.ordered(rows, "conv", F.col("turn").asc_nulls_first(), "digest", "row")
    own = scan.written(scan.running(laid, ["conv"], {"pos": F.lit(1).cast("long")}).select("conv", "pos", "digest", "words"), "own")
    sizes = own.groupBy("conv").agg(F.max("pos").alias("size"))
    heads = own.where(F.col("pos") < HEADS)
    head_size = heads.groupBy(F.col("conv").alias("base")).agg(F.max("pos").alias("head"))
    plan = (sizes.withColumn("base", F.col("conv") - F.col("conv") % BLOCK).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS))
            .join(head_size, "base", "left").withColumn("taken", F.least("h", F.coalesce("head", F.lit(0).cast("long")))))
    plan = scan.written(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "plan")
    first = plan.join(heads.withColumnRenamed("conv", "base"), "base").where(F.col("pos") <= F.col("taken")).select("conv", F.col("pos").alias("depth"), "digest", "words")
    rest = own.join(plan.select("conv", "h", "taken"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    return first.unionByName(rest), plan.select("conv", "length")


def _terms(bases):
    """Each turn's summand of the two polynomials."""

    def run(batches):
        for b in batches:
            depth, digest = b.column("depth").to_pylist(), b.column("digest").to_pylist()
            out = []
            for base, part in zip(bases, (slice(0, 32), slice(32, 64))):
                out.append(pa.array([int(x[part], 16) % _P * pow(base, d, _P) % _P for d, x in zip(depth, digest)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv", "depth", "digest", "words")], *out], ["conv", "depth", "digest", "words", "t1", "t2"])

    return run


def _prefixes(turns: DataFrame, bases) -> DataFrame:
    """Turns with the value of the sequence up to them (``h1, h2``) and up to the turn before (``p1, p2``)."""
    terms = turns.select("conv", "depth", "digest", "words").mapInArrow(_terms(bases), "conv long, depth long, digest string, words long, t1 long, t2 long")
    laid = scan.ordered(terms, "conv", "depth")
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    summed = scan.running(laid, ["conv"], {"s1": wide("t1"), "s2": wide("t2")})
    p = F.lit(_P).cast("decimal(28,0)")
    out = summed.withColumns({f"h{i}": F.pmod(F.col(f"s{i}"), p).cast("long") for i in (1, 2)})
    return out.withColumns({f"p{i}": F.pmod(F.col(f"h{i}") - F.col(f"t{i}"), F.lit(_P)) for i in (1, 2)}).select("conv", "depth", "digest", "words", "h1", "h2", "p1", "p2")


def _nodes(turns: DataFrame, lengths: DataFrame, bases) -> tuple[DataFrame, DataFrame]:
    """(one row per node, ``depth, h1, h2, conv`` of where each conversation ends)."""
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv", zero.alias("depth"), F.lit("").alias("digest"), zero.alias("words"), *[zero.alias(c) for c in ("h1", "h2", "p1", "p2")])
    rows = scan.written(_prefixes(turns, bases).unionByName(roots), "prefixes")
    key = ["depth", "h1", "h2"]
    check = [F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min(F.struct("p1", "p2")).alias("q0"), F.max(F.struct("p1", "p2")).alias("q1")]
    nodes = rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *check)
    same = (F.col("d0") == F.col("d1")) & (F.col("q0") == F.col("q1"))
    nodes = nodes.withColumn("p", F.when(same, F.col("q0")).otherwise(F.raise_error(F.lit("two different prefixes share a value"))))
    nodes = scan.written(nodes.select(*key, "conv", "n_convs", "words", F.col("p.p1").alias("p1"), F.col("p.p2").alias("p2")), "nodes")
    ends = rows.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]).select(*key, "conv")
    return nodes, ends


_PIECES = pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _pieces(size):
    """Sorted ids of a node as comma-joined pieces, in order."""

    def run(batches):
        now, first, ids, out = None, None, [], []
        for b in batches:
            for d, h1, h2, conv in zip(*[b.column(c).to_pylist() for c in ("depth", "h1", "h2", "conv")]):
                if (d, h1, h2) != now or len(ids) >= size:
                    if ids:
                        out.append((*now, first, ",".join(map(str, ids))))
                    now, first, ids = (d, h1, h2), conv, []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _PIECES)], schema=_PIECES)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, first, ",".join(map(str, ids))), _PIECES)], schema=_PIECES)

    return run


def _hashes(batches):
    """SHA-256 of each node's pieces, joined by commas, as a stream."""
    now, sha, out = None, None, []
    for b in batches:
        for d, h1, h2, ids in zip(*[b.column(c).to_pylist() for c in ("depth", "h1", "h2", "ids")]):
            if (d, h1, h2) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (d, h1, h2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(out) >= 4096:
            yield _hash_rows(out)
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield _hash_rows(out)


def _hash_rows(rows):
    d, h1, h2, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (d, h1, h2)] + [pa.array(sha, pa.string())], ["depth", "h1", "h2", "ends_sha256"])


def _end_hashes(ends: DataFrame, piece: int) -> DataFrame:
    key = ["depth", "h1", "h2"]
    laid = scan.ordered(ends, *key, "conv").select(*key, "conv")
    pieces = laid.mapInArrow(_pieces(piece), "depth long, h1 long, h2 long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashes, "depth long, h1 long, h2 long, ends_sha256 string")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, parent_conv, n_children``, the tour as ``id, next``) of numbered nodes; arcs: 2 node (enter), 2 node + 1 (exit)."""
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    below = scan.written(nodes.where("depth > 0").join(above, ["depth", "p1", "p2"]).select("node", "conv", "parent", "parent_conv"), "children")
    kin = scan.following(scan.ordered(below, "parent", "conv"), ["parent"], F.col("node"), "sibling").select("node", "parent", "parent_conv", "sibling")
    kin = scan.written(kin, "kin")
    born = below.groupBy(F.col("parent").alias("node")).agg(F.min_by("node", "conv").alias("child"), F.count(F.lit(1)).alias("n_children"))
    all_ = nodes.select("node").join(kin, "node", "left").join(born, "node", "left")
    all_ = scan.written(all_, "tree")
    enter = all_.select((F.col("node") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1).alias("next"))
    leave = all_.select((F.col("node") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    return all_.select("node", "parent_conv", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")), enter.unionByName(leave)


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bases=_BASES, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, lengths = rebuilt(df, conv, turn, role, text)
    nodes, ends = _nodes(turns, lengths, bases)
    numbered = scan.written(nodes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    tree, arcs = tour(numbered)
    ranks = listrank.rank(arcs)
    facts = scan.written(numbered.join(tree, "node").withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "facts")
    marks = ranks.select(F.shiftright("id", 1).alias("node"), F.col("id").bitwiseAND(F.lit(1)).alias("exit"), "rank")
    weights = facts.select("node", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    marks = marks.join(weights, "node").withColumns({c: F.when(F.col("exit") == 0, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("leaf", "saved")})
    summed = scan.running(scan.ordered(marks, "rank"), [], {"leaves": F.col("leaf"), "savings": F.col("saved")})
    part = lambda c, own: (F.max_by(c, "exit") - F.min_by(F.col(c) - F.col(own), "exit")).alias(c)
    spans = summed.groupBy("node").agg(part("leaves", "leaf"), part("savings", "saved"))
    out = facts.join(spans, "node").join(_end_hashes(ends, piece), ["depth", "h1", "h2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("savings").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM t),
s AS (SELECT c, c - c % 20 AS base, count(*) AS size FROM o GROUP BY c),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1),
           lambda i: list_prepend(ascii((c::VARCHAR)[i])::BIGINT, list_transform(range(7), lambda j: 0::BIGINT))))),
           lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) % 4 AS h FROM s),
p AS (SELECT h.*, least(h.h, coalesce(b.size, 0)) AS taken FROM h LEFT JOIN s b ON b.c = h.base),
l AS (SELECT c, taken + greatest(size - h, 0) AS length FROM p),
b AS (
  SELECT p.c, o.pos AS depth, o.k, o.w FROM p JOIN o ON o.c = p.base AND o.pos <= p.taken
  UNION ALL SELECT p.c, p.taken + o.pos - p.h, o.k, o.w FROM p JOIN o ON o.c = p.c AND o.pos > p.h
  UNION ALL SELECT c, 0, '', 0 FROM p),
f AS (SELECT c, depth, w, list(k) OVER (PARTITION BY c ORDER BY depth) AS pre FROM b),
m AS (SELECT c, depth, w, min(c) OVER (PARTITION BY depth, pre) AS node FROM f),
n AS (SELECT node, depth, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY node, depth),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.c = n.node AND m.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
x AS (SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM u LEFT JOIN k USING (node, depth)),
a AS (
  SELECT m.node, m.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.w) AS saved_tokens
  FROM x JOIN m ON m.c = x.node AND m.depth <= x.depth GROUP BY ALL),
e AS (SELECT m.node, m.depth, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends_sha256 FROM m JOIN l ON l.c = m.c AND l.length = m.depth GROUP BY ALL)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM x JOIN a USING (node, depth) LEFT JOIN e USING (node, depth)
"""
