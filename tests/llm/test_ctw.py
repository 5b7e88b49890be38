"""Context-tree weighting against a model written out node by node."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kiln.llm import ctw
from kiln.llm import queries as Q

SF = "/root/testdata/sf0.001"


def bits(seq):
    """(context of full depth, prefix of bits, bit) of every decision."""
    x = b"\n" * ctw.DEPTH + seq
    for i in range(ctw.DEPTH, len(x)):
        p = 1
        for j in range(7, -1, -1):
            bit = x[i] >> j & 1
            yield x[i - ctw.DEPTH : i], p, bit
            p = 2 * p + bit


class Model:
    def __init__(self, seqs):
        self.n, self.below = defaultdict(lambda: [0, 0]), defaultdict(set)
        for s in seqs:
            for context, p, bit in bits(s):
                for d in range(ctw.DEPTH + 1):
                    here = context[ctw.DEPTH - d :]
                    self.n[p, here][bit] += 1
                    if d < ctw.DEPTH:
                        self.below[p, here].add(context[ctw.DEPTH - d - 1 :])
        self.memo = {}

    def log_kt(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def children(self, node):
        return sum(self.log_pw((node[0], c)) for c in self.below[node])

    def log_pw(self, node):
        if node not in self.memo:
            kt = self.log_kt(node)
            if len(node[1]) < ctw.DEPTH:
                rest = self.children(node)
                top = max(kt, rest)
                kt = top + math.log(0.5 * math.exp(kt - top) + 0.5 * math.exp(rest - top))
            self.memo[node] = kt
        return self.memo[node]

    def one(self, context, p, d=0):
        node = (p, context[ctw.DEPTH - d :])
        if node not in self.n:
            return None
        a, b = self.n[node]
        kt = (b + 0.5) / (a + b + 1)
        deeper = self.one(context, p, d + 1) if d < ctw.DEPTH else None
        if deeper is None:
            return kt
        x = self.children(node) - self.log_kt(node)
        g = 1 / (1 + math.exp(min(x, 700)))
        return g * kt + (1 - g) * deeper

    def score(self, seq):
        out = 0.0
        for context, p, bit in bits(seq):
            one = self.one(context, p)
            one = 0.5 if one is None else one
            out += math.log10(one if bit else 1 - one)
        return out


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def by_hand(rows, learns):
    train = [t for i, t in rows if learns(i)]
    counts = Counter(w for t in train for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    model = Model([b" ".join(words(t)[:-1]) + b"\n" for t in train])
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        yield i, len(w), sum(counts[x] > 0 for x in w), total, base, model.score(b" ".join(w[:-1]) + b"\n")


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def check(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


ROWS = [(1, "The cat sat on the mat"), (2, "the cat sat on the hat"), (3, None), (4, ""), (5, "\t \n"), (6, "Über straße\x0bÇA zzz"), (6, "the cat"),
        (6, "the cat"), (None, "the dog"), (7, "a" * 300), (8, "naïve 中文 text"), (10, "the CAT\x00sat"), (11, "   "), (12, "qqqq the cat")]


@pytest.mark.parametrize("chunk,rows", [(16 << 20, 1 << 20), (40, 1 << 20), (64, 8)])
def test_equals_model_by_hand(spark, chunk, rows):
    df = spark.createDataFrame([(i, t, 1, t, 7) for i, t in ROWS], "doc_id long, text string, chunk int, word string, n long")
    got = ctw.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, chunk_bytes=chunk, tree_rows=rows)
    assert got.columns == ["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "train_tokens"]
    got = got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    check([tuple(r) for r in got], list(by_hand(ROWS, learns)))


def test_runs_of_trees_add_up():
    """The same sums, whatever runs the sorted keys come in."""
    import numpy as np
    import pyarrow as pa

    k, n = np.unique(ctw.keys_of([ctw.sequence(t.encode()) for _, t in ROWS if t])[0], return_counts=True)
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(n[s])], ["key", "n"])
    out = []
    for size in (1, 10, 1 << 20):
        sums = Counter()
        for b in ctw._sums(size, [batch(slice(i, i + 7)) for i in range(0, len(k), 7)]):
            for node, n0, n1, low in zip(*[b.column(i).to_pylist() for i in range(4)]):
                sums[node, "0"] += n0
                sums[node, "1"] += n1
                sums[node, "w"] += low
        out.append(sums)
    assert out[0].keys() == out[2].keys() and all(out[0][x] == pytest.approx(out[2][x]) == pytest.approx(out[1][x]) for x in out[0])


def test_estimates_are_exact():
    import numpy as np

    n0, n1 = np.array([0, 1, 70_000, 3, 10**9]), np.array([0, 0, 65_537, 200_000, 5])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for a, b in zip(n0.tolist(), n1.tolist())]
    assert ctw.log_kt(n0, n1) == pytest.approx(want, rel=1e-7)  # both sides lose digits where large terms cancel


def test_probabilities_of_a_byte_sum_to_one():
    import numpy as np

    text = [b"the cat sat on the mat\n", b"a cat\n"]
    trained, n = np.unique(ctw.keys_of(text)[0], return_counts=True)
    for context in (b"\n\n\n\n\n", b"e cat", b"zzzzz", b"z cat"):
        key = sum(context[-1 - d] << (8 * (5 - d)) for d in range(5)) + np.arange(256)
        keys = np.union1d(trained, key)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, trained)] = n
        trees = ctw.Trees(keys, counts)
        p = 10 ** trees.log10(ctw.Tops(*trees.sums()))
        assert p[np.searchsorted(keys, key)].sum() == pytest.approx(1)


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score(df, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(-24 * math.log10(2)) and got[1]["base_score"] == 0 and got[1]["train_tokens"] == 0
    assert got[2]["n_tokens"] == 1 and got[2]["n_known"] == 0 and got[1]["bits_per_byte"] == pytest.approx(8)
    assert ctw.score(df.where("false"), F.lit(True)).collect() == []


def test_registered_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 600").orderBy("doc_id").limit(25)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in Q.QUERIES["op11_ctw_score"](spark, str(tmp_path)).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(got, list(by_hand(rows, learns)))
    assert sum(r[1] for r in got) > 1000
