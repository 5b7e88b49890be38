"""Transducers and the source audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kiln.llm import divergence, transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def places(machine, texts):
    x = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    end = np.cumsum([len(t) + 1 for t in texts]) - 1
    return machine.places(x, end - np.array([len(t) for t in texts]), end).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_places_are_lexicographic(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcé中") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.choice((1, 30, 3000)))}
    terms = sorted(words)
    machine = transducer.build(terms)
    assert places(machine, terms) == list(range(len(terms)))
    others = [w for w in {t[:-1] for t in terms} | {t + b"a" for t in terms} if w and w not in words]
    assert set(places(machine, others)) <= {-1}


def test_transducer_is_minimal():
    """As many states as there are different right languages."""
    terms = sorted(w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "atop", "x"))
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    right = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in prefixes}
    machine = transducer.build(terms)
    assert len(machine.base) == len(right)
    again = transducer.Transducer.of(machine.arrays())
    assert places(again, terms) == list(range(len(terms)))


def test_one_long_term_and_all_bytes():
    terms = sorted([b"a" * 5000, *[bytes([b]) for b in range(1, 256)]])
    assert places(transducer.build(terms), terms) == list(range(len(terms)))


def by_hand(rows, min_docs, top):
    rows = [(lower(t), g or "", s or "") for t, g, s in rows]
    df, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for t, g, s in rows:
        df[g].update(set(TERM.findall(t)))
        groups[g].add(s)
    kept = {g: sorted((w for w, n in df[g].items() if n >= min_docs), key=lambda w: w.encode()) for g in groups}
    for t, g, s in rows:
        keep = set(kept[g])
        counts[g, s].update(w for w in TERM.findall(t) if w in keep)
    out = []
    for g, sources in groups.items():
        v = len(kept[g])
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * v)  # noqa: B023, E731
        whole = sum((counts[g, s] for s in sources), Counter())
        for s in sources:
            pair = [(o, sum(abs(share(counts[g, s], w) - share(counts[g, o], w)) for w in kept[g])) for o in sources - {s}]
            pair.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(g, s, "pair", o, f, i + 1) for i, (o, f) in enumerate(pair)]
            term = [(w, share(counts[g, s], w) - share(whole, w)) for w in kept[g] if counts[g, s][w]]
            term = sorted((x for x in term if x[1] > 0), key=lambda x: (-x[1], x[0].encode()))
            out += [(g, s, "term", w, f, i + 1) for i, (w, f) in enumerate(term[:top])]
    return sorted(out)


def rows_for(rng, n):
    words = ["Zeta", "zeta", "Été", "été", "中文", "ab", "a-b", "x1y", "été2", "ÀB", "tie1tie", "tiea", "tieb", "\x7fdel", "nul\x00nul"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("tiles", [{}, {"tile": 2, "span": 3}])
def test_audit_by_hand(spark, tiles):
    rows = rows_for(random.Random(5), 300) + [(None, None, "only null"), ("", "de", "a"), ("few words here", "de", "b"), (("é" * 3000 + " ") * 40, "en", "s1")] + [("Same text", "en", "s1")] * 40
    df = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, ordinal int, term string")
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=8, top_terms=4, **tiles).collect())
    assert got == by_hand(rows, 8, 4)


def test_vocabulary_in_several_blocks_and_passes(spark):
    rows = rows_for(random.Random(6), 200)
    df = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    docs = df.selectExpr("lang", "source", "cast(text as binary) text")
    terms = divergence.vocabulary(docs, 5)
    whole = sorted(map(tuple, divergence.recount(docs, terms).collect()))
    assert whole and whole == sorted(map(tuple, divergence.recount(docs, terms, block=3, limit=1).collect()))
    kept = terms.orderBy("lang", "ordinal").collect()
    for lang in {r["lang"] for r in kept}:
        own = [r for r in kept if r["lang"] == lang]
        assert [r["ordinal"] for r in own] == list(range(len(own))) and [bytes(r["term"]) for r in own] == sorted(bytes(r["term"]) for r in own)


def test_parts_of_a_task_add_up(monkeypatch):
    """Counters and texts handed on in small parts give the same sums."""
    import pyarrow as pa

    rows = [(t.encode(), g or "", s or "") for t, g, s in rows_for(random.Random(7), 150)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (1, 2, 0)], ["lang", "source", "text"])
    docs = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (1, 0)], ["lang", "text"])
    words = sorted({w.encode() for t, _, _ in rows for w in TERM.findall(lower(t.decode()))})
    shared = type("Shared", (), {"value": [("en", 0, transducer.build(words).arrays()), ("fr", 0, transducer.build(words[::2]).arrays())]})
    out = []
    for held, size in ((divergence.HELD, divergence.TEXT_BYTES), (1, 50)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "TEXT_BYTES", size)
        a, b = Counter(), Counter()
        for r in divergence._document_counts([docs.slice(i, 40) for i in range(0, 150, 40)]):
            for x in r.to_pylist():
                a[x["lang"], x["term"]] += x["n"]
        for r in divergence._recount(shared)([batch.slice(i, 40) for i in range(0, 150, 40)]):
            for x in r.to_pylist():
                b[x["lang"], x["source"], x["ordinal"]] += x["n"]
        out.append((a, b))
    assert out[0] == out[1] and out[0][1]


def test_counts_beyond_long_products(spark):
    from pyspark.sql import functions as F

    big = 40_000_000_000
    df = spark.createDataFrame([(big, 3 * big, 7)], "n long, total long, v long")
    got = df.select(divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (big + 5) // (3 * big + 35)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).collect() == []
