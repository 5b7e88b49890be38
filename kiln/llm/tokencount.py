"""Token counts by a map-side two-tier lookup.

Tier one is a compact table (the code points of a pre-token, its number of
tokens) of the most frequent pre-tokens, broadcast to every worker; it has at
most ``FREQUENT`` entries of at most textcodes.LONG code points, under 70 MB
if all are that long, about 2 MB in practice.  Tier two is each worker's own
cache, filled by the tokenizer's model for pre-tokens that tier one lacks.

Frequencies are counted over all documents: every task counts its pre-tokens
and hands on its most frequent ones, ``TASK_TOP`` at most, which Spark adds up
by pre-token.  These lists are all that is shuffled; which pre-tokens tier one
holds (ties: by text) decides how fast the job runs, never what it returns.

Nulls: a null text has 0 bytes and 0 tokens; an empty text too.  Null and
repeated ids are kept, one row out per row in.  Other columns are ignored.
Very long texts are counted in pieces cut where a pre-token ends.  An empty
table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import pretoken as PT
from kiln.llm import textcodes as X

FREQUENT = 1 << 16
TASK_TOP = 1 << 15
TASK_WORDS = 1 << 20


def _frequencies(path: str, top: int):
    """The ``top`` most frequent pre-tokens of each run of about ``TASK_WORDS`` distinct ones of a task."""

    def run(batches):
        enc, words, count = PT.encoder(path), X.Words(), np.zeros(1024, np.int64)

        def best():
            some = np.argsort(-count[: words.n], kind="stable")[:top]
            return pa.RecordBatch.from_arrays([pa.array([words.text(k) for k in some.tolist()], pa.string()), pa.array(count[some])], ["word", "k"])

        for b in X.slices(batches):
            for block in X.blocks([t for t in b.column(0).to_pylist() if t and enc.plain(t)]):
                c, start, end = enc.spans(block)
                h = X.span_hash(X.prefix_hash(c), start, end)
                short = end - start <= X.LONG
                u, first, n = np.unique(h[short], return_index=True, return_counts=True)
                start, end = start[short][first], end[short][first]
                new = words.table.get(u) < 0
                words.add(c, start[new], end[new], u[new])
                count = X.room(count, words.n)
                got = words.find(c, start, end, u)
                np.add.at(count, got[got >= 0], n[got >= 0])
                if words.n > TASK_WORDS:
                    yield best()
                    words, count = X.Words(), np.zeros(1024, np.int64)
        if words.n:
            yield best()

    return run


def frequent_words(df: DataFrame, path: str, text: str = "text", entries: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all documents."""
    rows = df.select(F.col(text).alias("t")).where("t is not null")
    top = rows.mapInArrow(_frequencies(path, TASK_TOP), "word string, k long").groupBy("word").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "word").limit(entries)
    return [r["word"] for r in top.select("word").collect()]


_TIER_ONE: dict[str, tuple] = {}


def _tier_one(shared) -> tuple[X.Words, np.ndarray]:
    """The broadcast pre-tokens as a table, with their numbers of tokens."""
    name, texts, n = shared.value
    if name not in _TIER_ONE:
        _TIER_ONE.clear()
        words, number = X.words_of(texts) if texts else (X.Words(), np.zeros(0, np.int64))
        lengths = np.zeros(max(words.n, 1), np.int64)
        lengths[number[number >= 0]] = np.asarray(n, np.int64)[number >= 0]
        _TIER_ONE[name] = (words, lengths)
    return _TIER_ONE[name]


def _counts(texts: list, enc: PT.Encoder, frequent: tuple[X.Words, np.ndarray]) -> np.ndarray:
    words, lengths = frequent
    out = np.zeros(len(texts), np.int64)
    plain = []
    for i, t in enumerate(texts):
        if t and enc.plain(t):
            plain.append(i)
        elif t:
            out[i] = len(enc.whole_ids(t))
    for block in X.blocks([texts[i] for i in plain]):
        c, start, end = enc.spans(block)
        h = X.span_hash(X.prefix_hash(c), start, end)
        got = words.find(c, start, end, h)
        n = lengths[got]
        rare = np.flatnonzero(got < 0)
        if len(rare):
            got, apart = enc.lookup(c, start[rare], end[rare], h[rare])
            n[rare] = enc.n_ids[got]
            for k, ids in apart.items():
                n[rare[k]] = len(ids)
        total = np.concatenate(([0], np.cumsum(n)))
        first, last = np.searchsorted(start, block.begin), np.searchsorted(start, block.end)
        np.add.at(out, np.asarray(plain)[block.owner], total[last] - total[first])
    return out


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512,
                 entries: int = FREQUENT) -> DataFrame:
    """Per document: id, bytes, tokens under the tokenizer file ``path``, and whether it exceeds ``limit``."""
    sc = df.sparkSession.sparkContext
    enc, texts = PT.encoder(path), frequent_words(df, path, text, entries)
    shared = sc.broadcast((uuid.uuid4().hex, texts, [len(enc.word_ids(t)) for t in texts]))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, frequent = PT.encoder(path), _tier_one(shared)
        for b in X.slices(batches):
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_counts(texts, enc, frequent))], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return (rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
