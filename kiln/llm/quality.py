"""Quality classifier: supervised subword embeddings.

Every word (split at white space, case and punctuation kept) and every
character trigram and tetragram is hashed to one of ``1 << BITS`` vectors; a
word that repeats the word before it is one more feature.  A document is the
mean of its vectors; a softmax layer on top gives the probability of label
1.  Vectors and layer are trained together by stochastic gradient descent in
numpy, on at most about ``PER_CLASS`` labelled documents of each class; the
layer's bias is then set right for the classes' true shares.

Output and mean are linear, so for scoring each vector is reduced to its
share of the two classes' margin: one number per bucket, added over all
n-grams of the whole text.

Very long texts are read in pieces that overlap by three characters and know
the word in front.  A score of just 0.5 has no side; equal documents have equal
scores.  A null or empty text has no feature and gets the score of the bias.  Label
rows with a null id or label, or ids labelled both ways, teach nothing.
Without labelled rows every score is 0.5.  Null and repeated ids keep their
rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import textcodes as X

BITS = 16
DIM = 16
PER_CLASS = 1500
EPOCHS = 6
RATE = 0.4
SEED = 5
_NONE = 1 << BITS
_REPEAT = 0  # the bucket of a word that repeats the one before it


def features(block: X.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of every word, repeated word, trigram and tetragram of a block."""
    c = block.codes
    cls = block.classes()
    value = X._values()[c]
    inside = cls != X.SEP
    shift = np.uint64(64 - BITS)
    out = []
    h = value * np.uint64(0x9E3779B97F4A7C15)
    for n, odd in ((2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9), (4, 0x27D4EB2F165667C5)):
        k = n - 1
        if len(c) <= k:
            break
        h = h[: len(c) - k] + value[k:] * np.uint64(odd)
        inside = inside[: len(c) - k] & (cls[k:] != X.SEP)
        if n > 2:
            at = np.flatnonzero(inside)
            out.append((at, ((h[at] * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)))
    gap = (cls == X.SPACE) | (cls == X.SEP)
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    word = X.span_hash(X.prefix_hash(c), start, end)
    out.append((start, ((word * np.uint64(0xA0761D6478BD642F)) >> shift).astype(np.int64)))
    same = np.flatnonzero(word[1:] == word[:-1]) + 1
    first = np.searchsorted(start, block.begin)  # the first word of a text repeats nothing, that of a later piece perhaps the word in front
    again = [k for k, w in zip(first.tolist(), block.before) if w and k < len(start) and X.codes(w).tolist() == c[start[k] : end[k]].tolist()]
    same = np.union1d(np.setdiff1d(same, first), np.asarray(again, np.int64))
    out.append((start[same], np.full(len(same), _REPEAT)))
    for end, n in zip(block.end[block.ahead > 0].tolist(), block.ahead[block.ahead > 0].tolist()):  # counted with the next piece
        out = [(np.delete(at, slice(*np.searchsorted(at, (end - n, end)))), np.delete(b, slice(*np.searchsorted(at, (end - n, end))))) for at, b in out]
    return out


def _sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of a table's values over each text's features, and their number."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for block in X.blocks(texts, ahead=3):
        for at, bucket in features(block):
            run = np.concatenate(([0.0], np.cumsum(table[bucket], dtype=np.float64)))
            s, e = np.searchsorted(at, block.begin), np.searchsorted(at, block.end)
            np.add.at(total, block.owner, run[e] - run[s])
            np.add.at(n, block.owner, e - s)
    return total, n


def _bags(batches):
    """Distinct buckets and their shares, a row per labelled text."""
    for b in X.slices(batches):
        for i, t in enumerate(b.column(0).to_pylist()):
            bag = np.zeros(_NONE, np.int64)
            for block in X.blocks([t], ahead=3):
                for _, bucket in features(block):
                    bag += np.bincount(bucket, minlength=_NONE)
            on = np.flatnonzero(bag)
            share = (bag[on] / max(bag.sum(), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([on.astype(np.int32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary()), b.column(1).slice(i, 1), b.column(2).slice(i, 1)], ["idx", "val", "y", "place"])


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        total, n = _sums(texts, self.table)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE,
          dim: int = DIM, seed: int = SEED) -> Model:
    """Stochastic gradient descent over documents; the rate falls linearly to zero."""
    rng = np.random.default_rng(seed)
    vec = (rng.random((_NONE, dim), dtype=np.float32) - 0.5) / dim
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            idx, share = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ vec[idx]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            # a step per feature of the mean's size: shares are small, so the vectors learn as a sum would
            vec[idx] -= (lr * 50) * share[:, None] * back
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS) -> Model | None:
    """Learn from labelled documents; None unless both classes are there."""
    known = (labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
             .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 40))
    share = F.when(F.col("y") == 0, min(1.0, per_class / n[0])).otherwise(min(1.0, per_class / n[1]))
    some = known.withColumn("place", place).where(F.col("place") < share * (1 << 40)).orderBy("place").limit(4 * per_class)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(some), "i")  # at most 4 * per_class ids
    got = (rows.select("t", "y", "place").mapInArrow(_bags, "idx binary, val binary, y int, place long")
           .orderBy("place", "y").limit(4 * per_class).toPandas())
    y = got["y"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    model = train([(np.frombuffer(k, np.int32), np.frombuffer(v, np.float32)) for k, v in zip(got["idx"], got["val"])], y)
    model.bias += np.log(n[1] / n[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and the probability of label 1."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in X.slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            s = m.scores(texts) if m is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
