"""Mixing against a plain water-filling loop and the SQL form."""

import re

import duckdb
import numpy as np
import pytest

from kiln.llm import mixing


def target_by_hand(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * rest / free > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * rest / free for s in names}
        capped |= over


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    sources = ["src0", "src1", "src10", "src2", "é", "z", None]
    rows = [(i, "w " * int(rng.integers(0, 60)), sources[int(rng.choice(7, p=[0.5, 0.02, 0.1, 0.1, 0.08, 0.1, 0.1]))]) for i in range(n)]
    return rows + [(n, None, "src0"), (n + 1, "", "only empty"), (n + 2, " \n\t", "src1"), (n + 3, "a b c\x1cd", "src2"), (n + 4, "long " * 5000, "z")]


@pytest.mark.parametrize("n,seed", [(400, 1), (7, 2)])
def test_mix(spark, n, seed):
    rows = rows_of(n, seed)
    df = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, source string, key string, target double").repartition(3)
    got = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes, source = {}, {i: s for i, _, s in rows}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = target_by_hand(sizes)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert taken[s] == int(t + 0.5)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(mixing.ORACLE).fetchall()) == sorted(map(tuple, got))


def test_equal_rows_and_many_sources(spark):
    """Rows that are equal in every column, and more sources than weights by far."""
    rows = [(None, "a b c", "s0")] * 300 + [(7, "", "s1")] * 50 + [(i, "w " * (i % 9), f"t{i % 60:02d}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = target_by_hand(sizes)
    assert len(got) == len(rows) and sum(r["taken"] for r in got if r["doc_id"] is None) == int(want["s0"] + 0.5)
    assert [r["target"] for r in got if r["doc_id"] in (1, 61)] == pytest.approx([want["t01"]] * 2)
    whole, part = divmod(int(want["s0"] + 0.5) % 900, 3)
    laps = int(want["s0"] + 0.5) // 900
    assert sorted(r["taken"] for r in got if r["doc_id"] is None) == sorted([3 * laps + 3] * whole + [3 * laps + part] * (part > 0) + [3 * laps] * (300 - whole - (part > 0)))
    assert sum(r["size"] * 0 + 1 for r in mixing.apply_mix(df).withColumn("size", mixing.F.lit(1)).collect()) == sum(-(-r["taken"] // r["size"]) for r in got if r["taken"])


def test_mixed_rows(spark):
    rows = rows_of(200, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    words = {}
    for r in mixing.apply_mix(df).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect() if r["taken"]}


def test_odd_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    same = spark.createDataFrame([(1, "a b", None)] * 3 + [(None, "c", None), (None, None, None)], kind)
    got = sorted(map(tuple, mixing.mix(same).collect()), key=str)
    assert got == sorted([(1, 2, 7, 7.0, 2)] * 3 + [(None, 1, 7, 7.0, 1), (None, 0, 7, 7.0, 0)], key=str)
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], kind)
    assert sorted(map(tuple, mixing.mix(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
