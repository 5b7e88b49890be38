"""Search and near-duplicate join of vectors against brute force."""

import duckdb
import numpy as np
import pytest

from kiln.llm import egojoin, maxscore

TABLE = "vec_id long, embedding array<float>, n_links string, score string"


def table(n, width, seed, near=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(near):  # around two centres, near copies at all distances
        x[n // 2 + k] = x[k % 2] + rng.normal(size=width) * 0.06 * (1 + k % 5) / np.sqrt(width)
    rows = [(i, [float(v) for v in r], "a", "b") for i, r in enumerate(x)]
    rows += [(10_000, None, "a", "b"), (10_001, [1.0, None] + [0.0] * (width - 2), "a", "b"), (10_002, [float("nan")] * width, "a", "b"),
             (10_003, [float("inf")] * width, "a", "b"), (10_004, [0.0] * width, "a", "b"), (None, rows[0][1], "a", "b")]
    rows += [(20_000 + i, rows[3][1], None, None) for i in range(9)] + [(20_100, [2.5 * v for v in rows[3][1]], "a", "b")]
    return rows


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize("width,first", [(16, 256), (5, 8)])
def test_top_k(spark, monkeypatch, width, first):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 150)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    rows = table(600, width, 1, 40)
    rows += [(30_000, [0.5] * (width - 1), "a", "b")]  # shorter: ends in a zero
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    got = {}
    for r in maxscore.top_k(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    known = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (width - len(v))) for i, v in usable(rows)]
    for q, x in known:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in known if i != q)[:5]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == {}


def test_top_k_of_small_and_large_values(spark):
    rows = [(0, [1e6, -3.0]), (1, [1e6, 2.0]), (2, [-1e6, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, maxscore.top_k(df, df.where("vec_id = 0"), 5).collect()))
    w = [[int(256 * x) for x in v] for _, v in rows]
    assert got == [(0, r + 1, i, sum(a * b for a, b in zip(w[0], w[i]))) for r, i in enumerate([1, 3, 2])]
    assert maxscore.top_k(df.limit(0), df, 5).collect() == []
    assert maxscore.top_k(df, df.limit(0), 5).collect() == []


@pytest.mark.parametrize("first", [8, 256])
def test_top_k_of_rows_without_gain_behind_a_negative_bar(monkeypatch, first):
    monkeypatch.setattr(maxscore, "FIRST_ROWS", first)  # here, not in Spark's workers
    rows = [[256, 128]] + [[-256, -128]] * 299 + [[0, 0]] * 3 + [[-64, 0], [-128, 0]]
    shard = maxscore.Shard(np.arange(len(rows)), np.array(rows, float).T)
    ids, scores = shard.search(0, np.array([256.0, 128.0]), 5)
    assert ids.tolist() == [300, 301, 302, 303, 304] and scores.tolist() == [0, 0, 0, -64 * 256, -128 * 256]


def test_top_k_sql(spark):
    rows = table(120, 6, 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, v] for i, v, *_ in rows])
    df = spark.createDataFrame(rows, TABLE)
    assert sorted(con.sql(maxscore.ORACLE).fetchall()) == sorted(map(tuple, maxscore.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()))


def test_top_k_of_repeated_ids_and_huge_values(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 1.0]), (3, [1e300, 0.0]), (100, [1e300, 1.0]), (4, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, maxscore.top_k(df, df.where("vec_id % 50 = 0"), 3).collect()))
    one = [(1, 1, 128 * 256), (2, 1, 128 * 256), (3, 4, 64 * 256)]
    other = [(1, 2, 256 * 256), (2, 4, 128 * 256), (3, 1, 64 * 256)]
    assert got == sorted((50, *x) for x in one + one + other)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    five = sorted(map(tuple, maxscore.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()))
    assert sorted(con.sql(maxscore.ORACLE).fetchall()) == five


def test_near_duplicates_of_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0]), (0, [-1.0, 0.0]), (0, [0.0, 2.0]), (9, [-1.0, 0.01])]
    got = sorted(map(tuple, egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == sorted([(1, 1, 1, True), (1, 3, 0, False), (2, 1, 1, False), (3, 3, 0, False), (4, 3, 0, False), (0, 1, 0, True), (0, 3, 0, True), (9, 1, 0, False)])


def components_by_hand(known, threshold):
    ids = [i for i, _ in known]
    unit = np.array([v / np.linalg.norm(v) for _, v in known])
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array(ids)
    while True:
        new = np.minimum(least, np.where(near, least[None, :], 10**9).min(axis=1))
        if (new == least).all():
            return dict(zip(ids, near.sum(axis=1).tolist())), dict(zip(ids, least.tolist()))
        least = new


@pytest.mark.parametrize("block", [40, 2048])
def test_near_duplicate_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(egojoin, "BLOCK_ROWS", block)
    rows = table(500, 24, 7, 150)
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    got = egojoin.near_duplicates(df).collect()
    known = [(i, v) for i, v in usable(rows) if np.any(v)]
    links, least = components_by_hand(known, 0.95)
    assert 1000 < sum(links.values()) < 151 * 150
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links.get(i, 0), least.get(i, i), i is not None and least.get(i, i) == i)


def test_near_duplicates_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert egojoin.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, [1.0]), (2, [2.0]), (3, [-1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [1.0, 0.1]), (6, None), (7, [])]
    got = sorted(map(tuple, egojoin.near_duplicates(spark.createDataFrame(rows, kind)).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (6, 0, 6, True), (7, 0, 7, True)]


def test_descent_skips_distant_blocks(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(0)
    angle = np.sort(rng.random(2000) * 3.1)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    counted = []
    real = egojoin._close_pairs
    monkeypatch.setattr(egojoin, "_close_pairs", lambda b, n, e: counted.append((n, (p := real(b, n, e)).count())) or p)
    got = {r["vec_id"]: r["n_links"] for r in egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array([v for _, v in rows])
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))
    (n, pairs), = counted
    assert n >= 100 and pairs < 0.5 * n * n / 2
