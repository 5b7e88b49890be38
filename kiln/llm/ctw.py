"""Language-model scores by context-tree weighting.

The model sees a document as its words (ASCII letters lower-cased), joined by
one space and ended by a newline.  Every byte is eight binary decisions, most
significant bit first.  A decision has a context tree of its own for each
prefix of bits; a tree's nodes are the last 0 to ``DEPTH`` bytes.  A node
estimates its bit by Krichevsky and Trofimov from its two counts, and the
weighted probability of its training bits is

    Pw(node) = 1/2 KT(node) + 1/2 product of Pw(children)

(KT alone at full depth).  What that gives for one more bit is a mix of the
estimates of all depths along the context, node by node
``g KT + (1 - g) (the child's)`` with g = KT / (KT + product of Pw(children)).
A context that the training text lacks has no estimate: the mix ends at its
deepest node with counts, and is 1/2 where not even the root has any.  The
model is fitted once and then stays as it is.  A score is the log10
probability of the document's bytes, the newline included; it sums to at most
one over all sequences of words, as the base's does over classes of words.

How it runs.  Documents are dealt into chunks of some ``CHUNK_BYTES``.  Each
chunk asks for its distinct (context, byte) keys, six bytes in one long, and
for its distinct words, both with their training counts.  Spark adds up the
counts by key, so what the model holds grows with the corpus.  Keys are dealt
by their three nearest context bytes (at most 2**24 keys), which makes all
trees from depth 3 on local to a task; depths 0 to 2 come from sums over those
and are broadcast: at most one row for each pair of bytes and prefix of bits,
in valid UTF-8 under 11 million rows of 32 bytes, in practice some megabytes.
The log probability of each key (in single precision) and the count of each
word go back to the chunks that asked, packed.  No task sees more than a chunk
or a run of such trees.

A null text is empty; an empty text has one token, the end.  Null and repeated
ids keep their rows (a null id is neither training nor held out).  Extra
columns are ignored.  Very long texts are chunks of their own.  Without
training rows every bit has probability 1/2.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kiln.llm.scan import written

DEPTH = 5
TOP = 2  # contexts of up to so many bytes are broadcast
CHUNK_BYTES = 32 << 20
CHUNK_DOCS = 1 << 17
PART_BYTES = 1 << 20
TREE_ROWS = 1 << 18  # keys of a run of trees, about 500 bytes each while it is worked on
ASK_ROWS = 1 << 21  # keys of a chunk's parts before they are merged
PACK_ROWS = 1 << 20
END = b"\n"
_TABLE = 1 << 16


def sequence(text: bytes | None) -> bytes:
    """The bytes that the model scores: words joined by a space, and the end."""
    return b" ".join((text or b"").lower().split()) + END


def keys_of(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of every byte of some sequences (its context, nearest byte first, then itself), and where each sequence begins."""
    size = np.fromiter(map(len, seqs), np.int64, len(seqs))
    x = np.frombuffer(b"".join(END * DEPTH + s for s in seqs), np.uint8)
    own = np.ones(len(x), bool)
    begin = np.cumsum(size + DEPTH) - size
    own[(begin[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    k = x[DEPTH:].astype(np.int64)
    for back in range(1, DEPTH + 1):
        k |= x[DEPTH - back : len(x) - back].astype(np.int64) << (8 * (DEPTH + 1 - back))
    return k[own[DEPTH:]], np.cumsum(size) - size


# --- estimates ---------------------------------------------------------------

_LOG_HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))))
_LOG_FACT = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _TABLE + 1)))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; used from ``_TABLE`` on, where it is exact in double precision."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lookup(table: np.ndarray, n: np.ndarray, shift: float, base: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE)]
    big = n > _TABLE
    if big.any():
        out[big] = _log_gamma(n[big] + shift) - base
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    half = 0.5 * np.log(np.pi)
    return _lookup(_LOG_HALVES, n0, 0.5, half) + _lookup(_LOG_HALVES, n1, 0.5, half) - _lookup(_LOG_FACT, n0 + n1, 1.0, 0.0)


class Level:
    """The nodes of one depth, for each of the eight bits, over sorted distinct (context, byte) rows."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.rows, self.n = rows, n
        self.first, self.node, self.n0, self.n1 = [], [], [], []
        for j in range(8):
            run = rows >> (8 - j)
            new = np.concatenate(([True], run[1:] != run[:-1]))
            first = np.flatnonzero(new)
            one = n * ((rows >> (7 - j)) & 1)
            n1 = np.add.reduceat(one, first)
            self.first.append(first)
            self.node.append(np.cumsum(new) - 1)
            self.n1.append(n1)
            self.n0.append(np.add.reduceat(n, first) - n1)

    def weigh(self, j: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(log Pw, g) of the nodes of bit ``j``; ``below``: log of the product of their children's Pw."""
        lk = log_kt(self.n0[j], self.n1[j])
        if below is None:
            return lk, np.ones(len(lk))
        return np.logaddexp(lk, below) - np.log(2), 1 / (1 + np.exp(np.minimum(below - lk, 700)))

    def estimate(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one, whether it has counts) of the nodes of bit ``j``."""
        n = self.n0[j] + self.n1[j]
        return (self.n1[j] + 0.5) / (n + 1), n > 0


class Trees:
    """All levels below the broadcast ones for sorted distinct keys that hold whole depth-3 trees."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels, self.up, self.g = [Level(keys, n)], [], []
        while len(self.levels) < DEPTH - TOP:
            rows = (self.levels[-1].rows >> 16 << 8) | (self.levels[-1].rows & 255)
            rows, up = np.unique(rows, return_inverse=True)
            self.levels.append(Level(rows, np.bincount(up, weights=self.levels[-1].n, minlength=len(rows)).astype(np.int64)))
            self.up.append(up)
        self.log_pw = []
        for j in range(8):
            below, gs = None, []
            for d, level in enumerate(self.levels):
                lw, g = level.weigh(j, below)
                gs.append(g)
                if d + 1 < len(self.levels):
                    parent = self.levels[d + 1].node[j][self.up[d][level.first[j]]]
                    below = np.bincount(parent, weights=lw, minlength=len(self.levels[d + 1].first[j]))
            self.log_pw.append(lw)
            self.g.append(gs)

    def sums(self):
        """(node of depth ``TOP``, zeros, ones, log of the product of Pw) of its children here."""
        level, out = self.levels[-1], []
        for j in range(8):
            rows = level.rows[level.first[j]]
            node = (rows >> 16 << 8) | (1 << j) | ((rows & 255) >> (8 - j))
            node, back = np.unique(node, return_inverse=True)
            out.append((node, *[np.bincount(back, weights=v, minlength=len(node)) for v in (level.n0[j], level.n1[j], self.log_pw[j])]))
        node, n0, n1, lw = map(np.concatenate, zip(*out))
        some = n0 + n1 > 0
        return node[some], n0[some].astype(np.int64), n1[some].astype(np.int64), lw[some]

    def log10(self, top: "Tops") -> np.ndarray:
        """log10 probability of the byte of every key after its context."""
        keys = self.levels[0].rows
        out = np.zeros(len(keys))
        for j in range(8):
            q, known, at = None, None, np.arange(len(keys))
            for d, level in enumerate(self.levels):
                at = self.up[d - 1][at] if d else at
                node = level.node[j][at]
                p, seen = (v[node] for v in level.estimate(j))
                if q is None:
                    q, known = p, seen
                else:
                    g = self.g[j][d][node]
                    q = np.where(known, g * p + (1 - g) * q, p)
                    known = seen
            prefix = (1 << j) | ((keys & 255) >> (8 - j))
            q = top.mix(keys >> (8 * (DEPTH + 1 - TOP)) << 8 | prefix, q, known)
            out += np.log10(np.where((keys >> (7 - j)) & 1, q, 1 - q))
        return out


class Tops:
    """The nodes of depth 0 to 2: what they give on top of a deeper estimate, or alone."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        order = np.argsort(node)
        levels = [(node[order], n0[order], n1[order], below[order])]
        for _ in range(TOP):
            node, n0, n1, below = levels[0]
            lw = np.logaddexp(log_kt(n0, n1), below) - np.log(2)
            up, back = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
            add = [np.bincount(back, weights=v, minlength=len(up)) for v in (n0, n1, lw)]
            levels.insert(0, (up, add[0].astype(np.int64), add[1].astype(np.int64), add[2]))
        self.nodes, self.part, self.rest, self.alone = [], [], [], []
        for d, (node, n0, n1, below) in enumerate(levels):
            g = 1 / (1 + np.exp(np.minimum(below - log_kt(n0, n1), 700)))
            p = (n1 + 0.5) / (n0 + n1 + 1)
            if d:
                up = np.searchsorted(self.nodes[-1], node >> 16 << 8 | node & 255)
                part, rest = self.part[-1][up], self.rest[-1][up]
            else:
                part, rest = np.zeros(len(node)), np.ones(len(node))
            self.nodes.append(node)
            self.alone.append(part + rest * p)
            self.part.append(part + rest * g * p)
            self.rest.append(rest * (1 - g))

    def mix(self, node: np.ndarray, q: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The whole mix, from the estimate ``q`` at depth 3 where it is ``known``."""
        out = np.full(len(node), 0.5)
        done = np.zeros(len(node), bool)
        for d in range(TOP, -1, -1):
            if len(self.nodes[d]):
                at = np.minimum(np.searchsorted(self.nodes[d], node), len(self.nodes[d]) - 1)
                hit = ~done & (self.nodes[d][at] == node)
                value = self.alone[d][at]
                if d == TOP:
                    value = np.where(known, self.part[d][at] + self.rest[d][at] * q, value)
                out[hit] = value[hit]
                done |= hit
            node = node >> 16 << 8 | node & 255
        return out


# --- Spark -------------------------------------------------------------------


def _chunks(limit: int, batches):
    """One row per chunk: its documents' ids, whether they are learned from, and their sequences, compressed."""
    first = TaskContext.get().partitionId() << 32
    ids, train, seqs, size, n = [], [], [], 0, 0

    def chunk(schema):
        text = b"".join(seqs)
        return pa.RecordBatch.from_arrays([
            pa.array([first + n]), pa.array([ids], pa.list_(schema.field(0).type)), pa.array([train], pa.list_(pa.bool_())), pa.array([[len(s) for s in seqs]], pa.list_(pa.int64())),
            pa.array([pa.compress(text, codec="zstd", asbytes=True)], pa.binary())], ["chunk", "doc_id", "train", "size", "seqs"])

    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows = b.slice(at, 256)
            for i, t, text in zip(*[rows.column(k).to_pylist() for k in range(3)]):
                s = sequence(text)
                if ids and (size + len(s) > limit or len(ids) >= CHUNK_DOCS):
                    yield chunk(b.schema)
                    ids, train, seqs, size, n = [], [], [], 0, n + 1
                ids.append(i)
                train.append(t)
                seqs.append(s)
                size += len(s)
    if ids:
        yield chunk(b.schema)


def _sequences(sizes: list[int], packed: bytes) -> list[bytes]:
    text = pa.decompress(packed, sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [text[e - n : e] for e, n in zip(ends, sizes)]


def _words(seq: bytes) -> list[bytes]:
    out = seq.split()
    out.append(END)
    return out


def _parts(seqs: list[bytes]):
    """Runs of sequences of about ``PART_BYTES``."""
    at = 0
    while at < len(seqs):
        to, size = at, 0
        while to < len(seqs) and size < PART_BYTES:
            size += len(seqs[to])
            to += 1
        yield slice(at, to)
        at = to


def _distinct(keys: list, counts: list):
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def _ask(batches):
    """What a chunk asks for: its distinct keys, and its distinct words numbered -1, -2, ... by first appearance; with training counts."""
    for b in batches:
        for row in range(b.num_rows):
            chunk, train, sizes, packed = (b.column(c)[row].as_py() for c in ("chunk", "train", "size", "seqs"))
            seqs = _sequences(sizes, packed)
            words, keys, counts, held = Counter(), [], [], 0
            for part in _parts(seqs):
                for t, s in zip(train[part], seqs[part]):
                    words.update(_words(s) if t else dict.fromkeys(_words(s), 0))
                for learn in (True, False):
                    some = [s for t, s in zip(train[part], seqs[part]) if t == learn]
                    if some:
                        k, n = np.unique(keys_of(some)[0], return_counts=True)
                        keys.append(k)
                        counts.append(n if learn else np.zeros(len(n), np.int64))
                        held += len(k)
                if held > ASK_ROWS:
                    keys, counts = ([v] for v in _distinct(keys, counts))
                    held = len(keys[0]) // 2  # so that merges pay for themselves
            k, n = _distinct(keys, counts)
            for at in range(0, len(k), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield _asked(chunk, pa.array(k[some]), pa.nulls(len(k[some]), pa.binary()), pa.array(n[some]))
            listed = list(words.items())
            for at in range(0, len(listed), 1 << 16):
                some = listed[at : at + (1 << 16)]
                numbers = -1 - np.arange(at, at + len(some))
                yield _asked(chunk, pa.array(numbers), pa.array([w for w, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64()))


def _asked(chunk: int, key, word, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), key, word, n], ["chunk", "key", "word", "n"])


def _trees(limit: int, batches):
    """Whole depth-3 trees from rows sorted by key, about ``TREE_ROWS`` rows at a time."""
    keys, counts, size = [], [], 0
    for b in batches:
        keys.append(b.column(0).to_numpy())
        counts.append(b.column(1).to_numpy())
        size += b.num_rows
        if size >= limit:
            k, n = np.concatenate(keys), np.concatenate(counts)
            root = k >> (8 * (DEPTH - TOP))
            cut = int(np.searchsorted(root, root[-1]))
            if cut:
                yield Trees(k[:cut], n[:cut])
            keys, counts, size = [k[cut:]], [n[cut:]], len(k) - cut
    if size:
        yield Trees(np.concatenate(keys), np.concatenate(counts))


def _sums(limit: int, batches):
    for trees in _trees(limit, batches):
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in trees.sums()], ["node", "n0", "n1", "below"])


def _key_scores(shared, limit: int):
    def run(batches):
        for trees in _trees(limit, batches):
            yield pa.RecordBatch.from_arrays([pa.array(trees.levels[0].rows), pa.array(trees.log10(shared.value))], ["key", "value"])

    return run


def _pack(batches):
    """Answers (chunk, key, value) as compressed arrays by chunk, some ``PACK_ROWS`` rows at a time."""
    held, size = [], 0

    def packs():
        chunk, key, value = (np.concatenate(v) for v in zip(*held))
        order = np.lexsort((key, chunk))
        chunk, key, value = chunk[order], key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))).tolist()
        small = lambda x: pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)
        rows = []
        for at, to in zip(first, [*first[1:], len(chunk)]):
            words = at + int(np.searchsorted(key[at:to], 0))
            rows.append((int(chunk[at]), to - at, words - at, small(np.diff(key[at:to], prepend=0)), small(value[at:words].astype(np.int64)), small(value[words:to].astype(np.float32))))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["chunk", "n", "n_words", "keys", "counts", "logs"])

    for b in batches:
        held.append([b.column(c).to_numpy() for c in ("chunk", "key", "value")])
        size += b.num_rows
        if size >= PACK_ROWS:
            yield packs()
            held, size = [], 0
    if size:
        yield packs()


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, their values, the counts of the words in their order) of a chunk."""
    keys, values, words, counts = [], [], [], []
    get = lambda x, n, kind: np.frombuffer(pa.decompress(x, np.dtype(kind).itemsize * n, codec="zstd"), kind)
    for n, n_words, k, c, v in zip(*[t.column(c).to_pylist() for c in ("n", "n_words", "keys", "counts", "logs")]):
        k = np.cumsum(get(k, n, np.int64))
        words.append(-1 - k[:n_words])
        keys.append(k[n_words:])
        counts.append(get(c, n_words, np.int64))
        values.append(get(v, n - n_words, np.float32))
    keys, values, words, counts = map(np.concatenate, (keys, values, words, counts))
    order = np.argsort(keys)
    by_number = np.empty(len(words), np.int64)
    by_number[words] = counts
    return keys[order], values[order].astype(np.float64), by_number


def _answer(mass: float, schema: pa.Schema):
    """Scores of a chunk's documents from the values of its keys and the counts of its words."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, values, counts = _unpack(answers)
        ids, train, sizes, packed = (docs.column(c)[0].as_py() for c in ("doc_id", "train", "size", "seqs"))
        seqs = _sequences(sizes, packed)
        base: dict[bytes, float] = {}
        for s in seqs:
            base.update(dict.fromkeys(_words(s), 0.0))
        for w, v in zip(base, np.log10((counts + 0.5) / mass).tolist()):  # words in the order of their numbers
            base[w] = v
        unknown = np.log10(0.5 / mass)
        out = {"n_tokens": [], "n_known": [], "base_score": []}
        scores = []
        for part in _parts(seqs):
            k, begin = keys_of(seqs[part])
            k, back = np.unique(k, return_inverse=True)
            scores.append(np.add.reduceat(values[np.searchsorted(keys, k)][back], begin))
            for s in seqs[part]:
                w = _words(s)
                v = np.fromiter(map(base.__getitem__, w), float, len(w))
                out["n_tokens"].append(len(w))
                out["n_known"].append(int(np.count_nonzero(v > unknown)))
                out["base_score"].append(float(v.sum()))
        score = np.concatenate(scores)
        cols = [pa.array(ids, schema.field(0).type), pa.array(train), *map(pa.array, out.values()), pa.array(score), pa.array(-score * np.log2(10) / np.array(sizes))]
        return pa.table(cols, schema=schema)

    return run


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
          tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per document: id, ``train`` (whether it was learned from), tokens, known tokens, training tokens, the unigram base's and
    the model's log10 probability, and the model's code length in bits for each byte."""
    sc = df.sparkSession.sparkContext
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("binary").alias("text"))
    docs = written(rows.mapInArrow(partial(_chunks, chunk_bytes), f"chunk long, doc_id array<{id_type}>, train array<boolean>, size array<long>, seqs binary"), "ctw-docs")
    asked = written(docs.drop("doc_id").mapInArrow(_ask, "chunk long, key long, word binary, n long"), "ctw-asked")

    words = asked.where("key < 0").groupBy("word").agg(F.sum("n").alias("n"))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()

    keys = written(asked.where("key >= 0").groupBy("key").agg(F.sum("n").alias("n")), "ctw-keys")
    trees = keys.repartition(F.shiftright("key", 8 * (DEPTH - TOP))).sortWithinPartitions("key")
    sums = trees.mapInArrow(partial(_sums, tree_rows), "node long, n0 long, n1 long, below double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    top = sums.toPandas()
    shared = sc.broadcast(Tops(*[top[c].to_numpy() for c in ("node", "n0", "n1", "below")]))
    values = trees.mapInArrow(_key_scores(shared, tree_rows), "key long, value double")

    answers = (asked.where("key >= 0").select("chunk", "key").join(values, "key").select("chunk", "key", "value")
               .unionByName(asked.where("key < 0").select("chunk", "key", "word").join(words, "word").select("chunk", "key", F.col("n").cast("double").alias("value"))))
    packs = answers.mapInArrow(_pack, "chunk long, n long, n_words long, keys binary, counts binary, logs binary")
    out = f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    scored = docs.groupBy("chunk").cogroup(packs.groupBy("chunk")).applyInArrow(_answer(total + 0.5 * (kinds + 1), to_arrow_schema(T.StructType.fromDDL(out))), out)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
