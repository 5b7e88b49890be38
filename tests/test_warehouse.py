"""Star, vault, governance, store and response operators on small literal inputs."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.functions import surrogate_key
from kiln.operators import governance as G
from kiln.operators import responses as R
from kiln.operators import vault as V
from kiln.operators import warehouse as W
from kiln.session import scratch_path
from kiln.sources import commits
from kiln.sources import store as S


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_fact_orphans_get_unknown_key(spark):
    dim_src = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    dim = W.dimension(dim_src, "thing", "k", ["name"])
    assert dim.filter(F.col("k").isNull()).first()["thing_sk"] == md5("-1")
    fact = spark.createDataFrame([(1, 10.0), (3, 5.0), (None, 1.0)], "k long, v double")
    out = W.resolve_keys(fact, "k", dim, "k", "thing_sk")
    got = {r["k"]: r["thing_sk"] for r in out.collect()}
    assert got[1] == md5("1:1") and got[3] == md5("-1") and got[None] == md5("-1")
    # a real business key -1 is not the unknown member
    real = W.dimension(spark.createDataFrame([(-1, "x")], "k long, name string"), "thing", "k", ["name"])
    assert sorted(r["thing_sk"] for r in real.collect()) == sorted([md5("-1"), md5("2:-1")])
    # J4 is empty once orphans point at the unknown member
    f2 = W.fact(fact, [("k", dim, "k", "thing_sk")], ["v"])
    assert W.orphans(f2, dim, "thing_sk", "thing_sk").count() == 0


def test_check_pk_and_normalize(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "w")], "k long, v string")
    got = sorted((r["k"] if r["k"] is not None else -1, r["violation"]) for r in W.check_pk(df, "k").collect())
    assert got == [(-1, "null_key"), (1, "duplicate_key")]
    ents = W.normalize(df, {"e": ("k", ["v"])})
    assert sorted(tuple(r) for r in ents["e"].filter("k = 1").collect()) == [(1, "x")]


def test_changes_matches_plain_lag_on_hot_key(spark):
    rows = [(0 if i < 300 else i % 7, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", f"d{(i // 3) % 4}")
            for i in range(600)]
    df = spark.createDataFrame(rows, "k long, ts string, d string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(tuple(r) for r in V.changes(df, "k", "ts", "d").collect())
    w = Window.partitionBy("k").orderBy("ts", "d")
    plain = df.withColumn("p", F.lag("d").over(w)).filter(F.col("p").isNull() | (F.col("p") != F.col("d"))).drop("p")
    assert got == sorted(tuple(r) for r in plain.collect())


def test_satellite_inserts_only_changes(spark):
    v1 = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], "k long, x string, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    first = V.satellite(v1, "c", "k", ["x"], "t", "v1")
    v2 = spark.createDataFrame([(1, "a", "2024-02-01"), (2, "B", "2024-02-01"), (3, "c", "2024-02-01")],
                               "k long, x string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    new = V.satellite(v2, "c", "k", ["x"], "t", "v2", existing=first)
    assert sorted((r["c_hk"], r["x"]) for r in new.collect()) == sorted([(md5("1:2"), "B"), (md5("1:3"), "c")])
    # NULL and '' are different values
    gap = spark.createDataFrame([(1, None, "2024-01-01"), (1, "", "2024-02-01")], "k long, x string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert V.satellite(gap, "c", "k", ["x"], "t", "v").count() == 2
    pairs = spark.createDataFrame([("a", None), (None, "a"), ("a|", ""), ("a", "|")], "x string, y string")
    assert pairs.select(surrogate_key("x", "y").alias("k")).distinct().count() == 4


def test_mask_and_lineage(spark):
    df = spark.createDataFrame([(1, "Ann", "ann@x.org")], "id long, name string, email string")
    masks = spark.createDataFrame([("name", "hash", "STEWARD"), ("email", "email", "STEWARD")],
                                  "column_name string, mask_type string, exempt_role string")
    a = G.mask(df, masks, "ANALYST").first()
    assert a["name"] == hashlib.sha256(b"Ann").hexdigest() and a["email"] == "*****@x.org"
    assert G.mask(df, masks, "STEWARD").first()["name"] == "Ann"
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d")],
                                  "project_id long, src string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in G.lineage_paths(edges).collect()}
    assert got[("a", "d")] == 3 and got[("b", "a")] == 2 and ("a", "a") not in got
    chain = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "project_id long, src string, dst string")
    assert G.lineage_paths(chain).count() == 78
    # nodes between two cycles are on none
    ring = [(1, f"r{i}", f"r{(i + 1) % 20}") for i in range(20)] + [(1, "r3", "mid"), (1, "mid", "x"), (1, "x", "y"), (1, "y", "x"), (1, "y", "end")]
    on = {r["node"] for r in G.on_cycles(spark.createDataFrame(ring, "project_id long, src string, dst string")).collect()}
    assert on == {f"r{i}" for i in range(20)} | {"x", "y"}


def test_mask_names_and_order(spark):
    df = spark.createDataFrame([(1, "Ann", 7)], "id long, c_name string, n int")
    masks = spark.createDataFrame([("C_NAME", "hash", "STEWARD"), ("c_name", "partial", "ANALYST"), ("C_name", "null", "AUDITOR"), ("c_name", "null", "STEWARD")],
                                  "column_name string, mask_type string, exempt_role string")
    name = lambda role: G.mask(df, masks, role).first()["c_name"]
    assert name("ANALYST") is None and name("STEWARD") == "Ann"[:0] + "Ann" and name("steward") == "Ann"
    assert name("AUDITOR") == hashlib.sha256(b"Ann").hexdigest()
    assert dict(G.mask(df, masks, "ANALYST").dtypes)["n"] == "int"


def test_exposure_of_all_tables(spark):
    tags = spark.createDataFrame([("DIM_BOLTS", "EMAIL", "PII"), ("DIM_NUT", "phone", "PII")], "table_name string, column_name string, tag string")
    grants = spark.createDataFrame([("All", "R1", "SELECT"), ("dim__bolt", "R2", "select"), ("DIM_NUT", "R3", "INSERT")], "table_name string, role_name string, privilege string")
    masks = spark.createDataFrame([("dim_bolt", "email", "hash", "R2")], "table_name string, column_name string, mask_type string, exempt_role string")
    got = sorted((r["table_name"], r["role_name"], r["reason"]) for r in G.exposure(tags, grants, masks).collect())
    assert got == [("DIM_BOLTS", "R2", "exempt_role"), ("DIM_NUT", "R1", "no_mask")]


def test_exposure_meets_columns_once(spark):
    """F16: one join with the readers of a table and of all tables, one with the masks; odd rows as before."""
    tags = spark.createDataFrame([(1, "DIM_A", "email", "PII"), (1, "dim__as", "EMAIL", "PII"), (1, None, "phone", "PII"), (1, "B", "ssn", "PII"), (1, "B", "dob", "KEY"),
                                  (2, "ALL", "email", "PII"), (2, "C", "name", "PII"), (None, "C", "name", "PII")], "p long, table_name string, column_name string, tag string")
    grants = spark.createDataFrame([(1, "dim_a", "R1", "select"), (1, "DIM_AS", "R1", "SELECT"), (1, " all ", "R1", "SELECT"), (1, "B", None, "SELECT"), (1, "B", "R2", "SELECT"), (1, None, "R9", "SELECT"),
                                    (2, "ALL", "R3", "SELECT"), (2, "*", "R4", "SELECT"), (2, "C", "R5", None), (None, "C", "R1", "SELECT")], "p long, table_name string, role_name string, privilege string")
    masks = spark.createDataFrame([(1, "Dim_A", "Email", "hash", "R2"), (1, "b", "SSN", "hash", "R2"), (1, "b", "SSN", "hash", "R2"), (1, "b", "SSN", "hash", None), (2, "C", "name", "hash", None),
                                   (1, None, "phone", "hash", "R1")], "p long, table_name string, column_name string, mask_type string, exempt_role string")
    out = G.exposure(tags, grants, masks, keys=["p"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, None, "phone", "R1", "no_mask"), (1, "B", "ssn", "R2", "exempt_role"), (2, "ALL", "email", "R3", "no_mask")], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_drill_across_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    out = W.drill_across([(a, {"n": F.count(F.lit(1))}), (a, {"s": F.sum("v")})], "k")
    assert sorted(map(tuple, out.collect()), key=str) == [("x", 1, 2), (None, 1, 1)] or sorted(map(tuple, out.collect()), key=str) == sorted([(None, 1, 1), ("x", 1, 2)], key=str)


def test_store_upsert_is_idempotent(spark):
    # an update of older date counts all the same, and keeps the time of the first save
    was = spark.createDataFrame([("p1", 5, "draft")], "id string, v int, status string")
    late = spark.createDataFrame([("p1", 3, "deployed")], "id string, v int, status string")
    assert S.upsert_snapshot(was, late, "id", "v", created="v").first() == ("p1", 5, "deployed")
    old = spark.createDataFrame([("p1", 1, "draft"), ("p2", 1, "draft")], "id string, v int, status string")
    new = spark.createDataFrame([("p1", 2, "deployed"), ("p3", 1, "draft")], "id string, v int, status string")
    once = S.upsert_snapshot(old, new, "id", "v")
    twice = S.upsert_snapshot(once, new, "id", "v")
    assert sorted(once.collect()) == sorted(twice.collect())
    base = scratch_path(spark, f"test-store-{uuid.uuid4().hex}")
    S.write_snapshot(once, base, version=1)
    S.write_snapshot(twice, base, version=2)
    assert sorted(S.read_store(spark, base).collect()) == sorted(once.collect())
    got = S.get_project(spark.createDataFrame([("p1", "{bad"), ("p2", '{"a": 1}')], "id string, requirements string"),
                        "p1").first()
    assert got["requirements"] == "{}"


def test_parse_stages_and_merge(spark):
    rows = [(1, '{"k": 1}'), (2, "```json\n{'k': 2}\n```"), (3, "x {\"k\": 3} y"), (4, '{"k": 4'), (5, "nope"),
            (6, '{"choices":[{"message":{"content":"{\\"k\\": 6,}"}}]}')]
    df = spark.createDataFrame(rows, "id int, raw string")
    ok, q = R.parse_responses(df, "raw", "id")
    got = {r["id"]: (r["stage"], r["enveloped"], r["k"]) for r in
           ok.select("id", "stage", "enveloped", F.variant_get("parsed", "$.k", "int").alias("k")).collect()}
    assert got == {1: ("strict", False, 1), 2: ("repaired", False, 2), 3: ("extracted", False, 3),
                   4: ("closed", False, 4), 6: ("repaired", True, 6)}
    assert [r["id"] for r in q.collect()] == [5]
    odd = [(1, '{"a": "x\ny", "b": [1, {"c": "d'), (2, '{\n# note\n"a": 1\n"b": 2}'), (3, "{'a': 'it\\'s', b: \"p\\q\"}"), (4, '{"a": "}{", "l": [[1], [2'),
           (5, '{"a": [1], "t": []}')]
    ok, q = R.parse_responses(spark.createDataFrame(odd, "id int, raw string"), "raw", "id")
    got = {r["id"]: (r["stage"], r["j"]) for r in ok.select("id", "stage", F.to_json("parsed").alias("j")).collect()}
    assert q.count() == 0
    assert got[1] == ("closed", '{"a":"x\\ny","b":[1,{"c":"d"}]}') and got[2] == ("repaired", '{"a":1,"b":2}')
    assert got[3][0] == "repaired" and got[4] == ("closed", '{"a":"}{","l":[[1]]}')  # the span ends at the last closer
    bad = R.validate_contract(ok.filter("id = 5"), "id", {"a": "string", "t": "array", "z": "object"}, non_empty=["t"])
    assert sorted((r["contract_key"], r["violation"]) for r in bad.collect()) == [("a", "type"), ("t", "empty"), ("z", "missing")]
    full = ok.filter("id = 5").select(R.with_contract_defaults(F.col("parsed"), {"a": "array", "z": "object"}).alias("m")).first()["m"]
    assert full == {"a": "[1]", "z": "{}"}
    parts = spark.createDataFrame([(1, '{"a": 1, "b"', ': 2}'), (2, '{"a": [1', "no json at all {")], "id int, first string, cont string")
    ok, q = R.stitch_fragments(parts, "first", "cont", "id")
    assert {r["id"]: r["j"] for r in ok.select("id", F.to_json("parsed").alias("j")).collect()} == {1: '{"a":1,"b":2}', 2: '{"a":[1]}'} and q.count() == 0
    lists = spark.createDataFrame([([("A", "one"), ("B", "two")], [("a", "more"), ("C", None)])], "b array<struct<name:string,text:string>>, u array<struct<name:string,text:string>>")
    assert [tuple(x) for x in lists.select(R.merge_lists(F.col("b"), F.col("u")).alias("m")).first()["m"]] == [("A", "one\nmore"), ("B", "two"), ("C", None)]
    # the base already ends with the update's first 20 characters -> kept once
    b = spark.createDataFrame([(1, "T", "intro; the tail part ", 0), (1, "U", "u", 3)], "p int, name string, d string, n int")
    u = spark.createDataFrame([(1, "t", " the tail part", 5), (1, "V", "v", 1), (1, "u", "more", 0)],
                              "p int, name string, d string, n int")
    m = {r["name"]: (r["d"], r["n"]) for r in R.merge_named(b, u, "p", ["d"], ["n"]).collect()}
    assert m == {"T": ("intro; the tail part", 5), "U": ("u\nmore", 3), "V": ("v", 1)}


def test_materialise_logs_and_audits(spark):
    from kiln.operators import deploy as D
    tag = uuid.uuid4().hex[:8]
    loc = scratch_path(spark, f"test-wh-{tag}")
    log = scratch_path(spark, f"test-log-{tag}")
    dim = spark.createDataFrame([(1, "a")], "a_sk long, name string")
    fact = spark.createDataFrame([(1, 2.0)], "a_sk long, v double")
    out = D.materialise(spark, {"FACT_S": fact, "DIM_A": dim, "STG_MISSING": None},
                        {"FACT_S": "Gold", "DIM_A": "Gold", "STG_MISSING": "Silver / Conformed"},
                        f"wh{tag}", log_path=log, project_id="p1", location=loc).first()
    assert (out["statements_run"], out["statements_skipped"], out["status"], out["target_schema"]) == (2, 1, "success", "GOLD,SILVER_CONFORMED")
    gone = D.materialise(spark, {"DIM_B": lambda: spark.table("no_such_table"), "DIM_C": lambda: spark.read.parquet("/nonexistent/k.parquet")}, {}, f"wy{tag}", location=loc, log_path=log).first()
    assert (gone["statements_run"], gone["statements_skipped"], gone["status"]) == (0, 2, "success")
    broken = spark.range(2).select(F.raise_error(F.lit("damaged " * 100)).alias("x"))
    with pytest.raises(Exception):
        D.materialise(spark, {"DIM_D": broken}, {}, f"wz{tag}", location=loc, log_path=f"{log}-failed")
    kept = spark.read.parquet(f"{log}-failed").first()
    assert kept["status"] == "failed" and len(kept["errors"]) > 700
    assert spark.table(f"wh{tag}_gold.FACT_S").count() == 1
    a = D.audit(spark.read.parquet(log)).first()
    assert (a["runs"], a["statements"], a["failures"]) == (1, 2, 0)


def test_sources_and_defaults(spark):
    from kiln.operators import profile as P
    from kiln.operators.common import union_batches
    from kiln.sources import tables as T
    from kiln.functions import day_string, iso_day
    tpl = T.template(spark, "Unknown industry")            # unknown -> Retail
    assert sorted({r["table_name"] for r in tpl.collect()}) == ["CUSTOMERS", "ORDERS", "PRODUCTS"]
    rows = T.synthetic(spark, T.template(spark, "Finance"), "ACCOUNTS", rows=50)
    assert rows.count() == 50 and rows.select("ACCOUNT_ID").distinct().count() == 50
    assert sorted(rows.collect()) == sorted(T.synthetic(spark, T.template(spark, "Finance"), "ACCOUNTS", rows=50).collect())
    d = T.describe(rows, "ACCOUNTS")
    assert [r["column_name"] for r in d.orderBy("ordinal").collect()] == ["ACCOUNT_ID", "HOLDER_NAME", "TYPE", "BALANCE"]
    rows.createOrReplaceTempView("kiln_accounts")
    assert "kiln_accounts" in {r["table_name"] for r in T.list_catalog(spark).collect()}
    cols = spark.createDataFrame([("t", None, None, None)], "table_name string, column_name string, data_type string, nullable boolean")
    r = P.with_defaults(cols).first()
    assert (r["column_name"], r["data_type"], r["nullable"]) == ("N/A", "TEXT", True)
    u = union_batches(spark.createDataFrame([(1, "a")], "id int, n string"), spark.createDataFrame([(2, 1.5)], "id int, x double"))
    assert sorted(u.columns) == ["id", "n", "x"] and u.count() == 2
    ts = spark.createDataFrame([("2024-03-05 10:11:12",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = ts.select(day_string("t"), iso_day("t")).first()
    assert tuple(got) == ("2024-03-05", "2024-03-05")
    broken = spark.range(3).select(F.raise_error(F.lit("damaged")).alias("x"))  # fails only when it runs
    ok, cols = P.profile(spark, {"good": rows, "bad": lambda: spark.read.parquet("/nonexistent/kiln.parquet"), "late": broken})
    assert {r["table_name"]: r["error"] is None for r in ok.collect()} == {"good": True, "bad": False, "late": False}
    assert {r["table_name"] for r in cols.collect()} == {"good"}
    spark.sql("CREATE DATABASE IF NOT EXISTS kiln_other")
    assert "kiln_other" in {d.name for d in spark.catalog.listDatabases()} and T.list_catalog(spark).columns == ["db", "table_name", "is_temporary"]
    tags = P.tag(P.schema_columns({"t": spark.createDataFrame([], "email string, order_key int, price double")}), {"SENSITIVE": ["price"]})
    assert sorted(map(tuple, tags.collect())) == [("t", "email", "PII"), ("t", "price", "SENSITIVE")]


def test_upsert_stream_goes_on_and_never_loses_the_store(spark):
    from kiln.streaming import events as ST
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    kind = "user_id long, ts int, v string"
    put = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/in")
    run = lambda: ST.upsert_stream(ST.read_events(spark, f"{base}/in", spark.createDataFrame([], kind).schema), f"{base}/store", "user_id", "ts", f"{base}/progress", parts=4)
    put([(i, 1, "a") for i in range(15)])
    run()
    put([(3, 2, "b"), (20, 1, "c")])
    run()
    run()  # nothing new
    got = {r["user_id"]: r["v"] for r in ST.read_upserted(spark, f"{base}/store").collect()}
    assert got == {**{i: "a" for i in range(15)}, 3: "b", 20: "c"}
    # a commit that can't be read is an error, never an empty store
    last = max(os.listdir(f"{base}/store/{commits.FOLDER}"))
    with open(f"{base}/store/{commits.FOLDER}/{last}", "w") as f:
        f.write("not a commit")
    crc = f"{base}/store/{commits.FOLDER}/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    put([(i, 3, "d") for i in range(15)])
    with pytest.raises(Exception):
        run()
    assert S.current(spark, f"{base}/none") is None


def test_upsert_stream_of_a_second_checkpoint(spark):
    from kiln.streaming import events as ST
    base = scratch_path(spark, f"test-streams-{uuid.uuid4().hex}")
    kind = "user_id long, ts int, v string"
    put = lambda name, rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/{name}")
    run = lambda name, progress: ST.upsert_stream(ST.read_events(spark, f"{base}/{name}", spark.createDataFrame([], kind).schema), f"{base}/store", "user_id", "ts", f"{base}/{progress}", parts=1)
    got = lambda: {r["user_id"]: r["v"] for r in ST.read_upserted(spark, f"{base}/store").collect()}
    put("one", [(1, 1, "a"), (2, 1, "a")])
    run("one", "progress1")
    put("one", [(3, 1, "a")])
    run("one", "progress1")
    put("two", [(1, 2, "b"), (4, 1, "b")])
    run("two", "progress2")
    assert got() == {1: "b", 2: "a", 3: "a", 4: "b"}
    put("one", [(5, 1, "c")])
    run("one", "lost")  # a new progress folder: all files again
    assert got() == {1: "b", 2: "a", 3: "a", 4: "b", 5: "c"}
    at = commits.state(spark, f"{base}/store")
    run("one", "lost")  # nothing new
    assert commits.state(spark, f"{base}/store") == at and sorted(at["streams"].values()) == [0, 0, 1] and S.merged_batch(spark, f"{base}/store", "other") == -1


def test_a_store_grows_by_splitting_parts(spark):
    from kiln.streaming import events as ST
    base = scratch_path(spark, f"test-parts-{uuid.uuid4().hex}")
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    ST.upsert_parts(spark, base, rows(0, 200, 1), "k", "v", parts=32)
    assert ST.read_upserted(spark, base).count() == 200 and len(commits.state(spark, base)["parts"]) == 32
    ST.upsert_parts(spark, base, rows(100, 900, 2), "k", "v", parts=4, part_rows=20)  # the store knows its parts
    now = commits.state(spark, base)
    assert len(now["parts"]) > 40 and sum(p["rows"] for p in now["parts"]) == 900
    got = {r["k"]: r["v"] for r in ST.read_upserted(spark, base).collect()}
    assert got == {k: 1 if k < 100 else 2 for k in range(900)}
    before = {p["path"] for p in now["parts"]}
    ST.upsert_parts(spark, base, rows(5, 6, 3), "k", "v", part_rows=20)
    after = {p["path"] for p in commits.state(spark, base)["parts"]}
    assert len(before - after) == 1  # one part rewritten
    ST.upsert_parts(spark, base, rows(0, 0, 3), "k", "v")
    assert ST.read_upserted(spark, base).count() == 900
    with pytest.raises(ValueError):
        ST.upsert_parts(spark, base, rows(0, 1, 1), "v", "k")


def test_two_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    from kiln.streaming import events as ST
    base = scratch_path(spark, f"test-writers-{uuid.uuid4().hex}")
    row = lambda k: spark.createDataFrame([(f"p{k}", k)], "id string, v int")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: S.upsert_store(spark, f"{base}/a", row(k), "id", "v"), range(8)))
        list(pool.map(lambda k: ST.upsert_parts(spark, f"{base}/b", row(k), "id", "v", parts=2), range(6)))
    assert sorted(r["id"] for r in S.read_store(spark, f"{base}/a").collect()) == [f"p{k}" for k in range(8)] and S.current(spark, f"{base}/a")[0] == 8
    assert sorted(r["id"] for r in ST.read_upserted(spark, f"{base}/b").collect()) == [f"p{k}" for k in range(6)]
    with pytest.raises(commits.Taken):
        S.write_snapshot(row(9), f"{base}/a", version=3)
    assert S.read_store(spark, f"{base}/a").count() == 8


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from kiln.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1000]"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)


def test_bronze_batches_by_date(spark):
    path = scratch_path(spark, f"test-bronze-{uuid.uuid4().hex}")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "k")
    W.append_bronze(rows(3), path, "s", "b1", "2024-01-01 10:00:00")
    W.append_bronze(rows(4), path, "s", "b2", "2024-01-02 10:00:00")
    W.append_bronze(rows(5), path, "s", "b2", "2024-01-02 10:00:00")  # loaded again
    got = spark.read.parquet(path).groupBy("_load_date", "_batch_id").count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("2024-01-01", "b1", 3), ("2024-01-02", "b2", 5)]


def test_store_keeps_variants(spark):
    path = scratch_path(spark, f"test-variant-{uuid.uuid4().hex}")
    df = spark.createDataFrame([("p", '{"a": [1, 2]}', "{bad")], "id string, requirements string, history string")
    S.write_snapshot(S.typed_store(df), path)
    back = S.read_store(spark, path)
    assert dict(back.dtypes)["requirements"] == "variant"
    assert back.select(F.variant_get("requirements", "$.a[1]", "int"), F.to_json("history")).first() == (2, "{}")


def test_changes_of_a_key_hot_inside_one_day(spark):
    import random
    rng = random.Random(1)
    rows = [("hot", f"2024-01-01 10:{i // 60:02d}:{i % 60:02d}", rng.choice("ab")) for i in range(600)] + [("hot", "2024-01-02 00:00:00", "a")] + [(f"k{i % 9}", f"2024-01-0{1 + i % 3} 11:00:{i:02d}", rng.choice("ab")) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t string, d string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    plain = sorted(map(tuple, V.changes(df, "k", "t", "d").collect()))
    cut = V.changes(df, "k", "t", "d", heavy_rows=50)
    assert sorted(map(tuple, cut.collect())) == plain
    want, last = [], {}
    for k, t, d in sorted(rows):
        if last.get(k) != d:
            want.append((k, t, d))
        last[k] = d
    assert [(k, str(t), d) for k, t, d in plain] == want
    cuts = V._cuts(df.withColumn("__b", F.to_date("t")), "k", "t", 50).collect()
    assert [r["k"] for r in cuts] == ["hot"] and len(cuts[0]["__cuts"]) == 11
    assert V._cuts(df.withColumn("__b", F.to_date("t")), "k", "t", 1000) is None


def test_retention_leaves_out_old_folders(spark):
    path = scratch_path(spark, f"test-retention-{uuid.uuid4().hex}")
    df = spark.range(1, 900).select(F.col("id"), (F.lit("2024-06-30 12:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.col("id").cast("int"))).alias("t"))
    G.write_by_date(df, "t", path, "month")
    kept = G.retain_by_date(spark, path, "t", "6 months", "month")
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in G.retain(df, "t", "6 months").collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_date" in plan and "_date" in plan.split("PartitionFilters")[1]
    assert G.retain_by_date(spark, path, "t", "Unlimited").count() == 899


def test_exact_counts_of_all_types(spark):
    from kiln.operators.profile import exact_counts
    rows = spark.sql("""SELECT * FROM VALUES
        (1L, 'a', 1.5D, DATE'2024-01-01', TIMESTAMP_NTZ'2024-01-01 00:00:00', true, array(1, null), CAST(1.10 AS DECIMAL(9,2)), float('nan'), X'00'),
        (1L, 'a', -0.0D, DATE'2024-01-02', TIMESTAMP_NTZ'2024-01-01 00:00:01', false, array(1), CAST(1.1 AS DECIMAL(9,2)), float('nan'), X'0000'),
        (NULL, '', 0.0D, NULL, NULL, NULL, array(null, 1), NULL, 1.0F, X'00'), (2L, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(l, s, d, dt, ts, b, arr, dec, f, bin)""")
    want = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns]).first()
    n, got = exact_counts(rows)
    assert n == 4 and got == [want[c] for c in rows.columns]
    assert exact_counts(rows.limit(0)) == (0, [0] * 10)


def test_a_broken_run_goes_on_where_it_stopped(spark):
    from kiln.operators import deploy as D
    tag = uuid.uuid4().hex[:8]
    loc, journal = scratch_path(spark, f"test-go-on-{tag}"), scratch_path(spark, f"test-journal-{tag}")
    made = []

    def table(name, broken=False):
        def make():
            made.append(name)
            return spark.range(2).select(F.raise_error(F.lit("damaged")).alias("x")) if broken else spark.range(3).withColumnRenamed("id", "k")
        return make

    layers = {"DIM_A": "Gold", "DIM_B": "Gold", "FACT_C": "Gold"}
    with pytest.raises(Exception):
        D.materialise(spark, {"DIM_A": table("A"), "DIM_B": table("B", broken=True), "FACT_C": table("C")}, layers, f"gx{tag}", location=loc, journal=journal, run_id="r1")
    assert made == ["A", "B"] and commits.state(spark, journal)["runs"]["r1"] == {f"gx{tag}_gold.DIM_A": "done", f"gx{tag}_gold.DIM_B": "started"}
    log = D.materialise(spark, {"DIM_A": table("A"), "DIM_B": table("B"), "FACT_C": table("C"), "STG_D": None}, layers, f"gx{tag}", location=loc, journal=journal, run_id="r1", log_path=f"{loc}-log").first()
    assert made == ["A", "B", "B", "C"] and (log["statements_run"], log["statements_skipped"], log["status"]) == (3, 1, "success")
    assert all(spark.table(f"gx{tag}_gold.{t}").count() == 3 for t in ("DIM_A", "DIM_B", "FACT_C"))
    D.materialise(spark, {"DIM_A": table("A")}, layers, f"gx{tag}", location=loc, journal=journal, run_id="r2")  # another run: it is there already
    assert spark.table(f"gx{tag}_gold.DIM_A").count() == 3


def test_runs_are_logged_in_one_job(spark):
    path = scratch_path(spark, f"test-log-{uuid.uuid4().hex}")
    runs = spark.createDataFrame([("p1", 3, "success"), ("p2", 0, "failed")], "project_id string, statements_run int, status string")
    S.log_runs(runs, path)
    S.log_runs(runs.withColumn("id", F.lit("mine")), path)
    got = spark.read.parquet(path)
    assert got.columns == [c.split()[0] for c in S.LOG_SCHEMA.split(", ")] and got.count() == 4 and got.select("id").distinct().count() == 3
    assert got.where("deployed_at is null or statements_skipped <> 0").count() == 0
    with pytest.raises(Exception, match="status must be"):
        S.log_runs(runs.withColumn("status", F.lit("odd")), path)


def test_fact_hashes_after_the_last_join(spark):
    """exchanges carry a flag a dimension, not its hash."""
    f = spark.createDataFrame([(1, 7, 2.0), (9, None, 3.0)], "a int, b int, m double")
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(7,), (None,)], "k int")
    out = W.fact(f, [("a", a, "k", "a_sk"), ("b", b, "k", "b_sk")], ["m"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan[plan.index("Join"):]
    got = {r["m"]: (r["a_sk"], r["b_sk"]) for r in out.collect()}
    known = f.select(surrogate_key("a"), surrogate_key("b")).first()
    assert got == {2.0: tuple(known), 3.0: (hashlib.md5(b"-1").hexdigest(),) * 2}


def test_deploy_plan_numbers_copies_once(spark):
    """one sort a project; copies and missing names count once."""
    from kiln.operators import deploy as D
    rows = [(1, "GOLD", "FACT_S"), (1, "GOLD", "DIM_A"), (1, "GOLD", "DIM_A"), (1, "SILVER", "DIM_A"), (1, "GOLD", None), (1, "GOLD", None), (None, "GOLD", "DIM_A"), (None, "GOLD", "DIM_A")]
    out = D.deploy_plan(spark.createDataFrame(rows, "project_id int, schema_name string, table_name string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = sorted((r["project_id"] or 0, r["statement_no"], r["schema_name"], r["table_name"]) for r in out.collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, "GOLD", "DIM_A")]
    assert [g[1] for g in got if g[0] == 1] == [1, 2, 3, 4]
    assert [g[2:] for g in got if g[0] == 1 and g[3] == "DIM_A"] == [("GOLD", "DIM_A"), ("SILVER", "DIM_A")]


def test_stages_are_one_pass(spark, monkeypatch):
    """the stages are columns of one pass; what a stage may leave out changes no text."""
    def stored(df):
        raise AssertionError("a stage was stored")
    monkeypatch.setattr(R, "saved", stored)
    texts = ['{"a":1}', "see {\"a\": 2} there", "{b: [1,],}", "{'a': 'it'}", "{\"a\": 1\n\"b\": 2}", '{"a": [1, {"b": 2', "```json\n{\"a\": 3}\n```", "<thinking>{</thinking>{\"a\": 4}",
             '{"content": "{k: 1, }"}', '{"content": "nothing"}', "nothing", "", None, " {\"a\": 5} ", "{a: 1} // {\n", "{a: 1}/* x */, "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    ok, bad = R.parse_responses(df, "raw", "id")
    got = {r["id"]: (r["stage"], r["enveloped"]) for r in ok.collect()}
    assert got[0] == ("strict", False) and got[1] == ("extracted", False) and got[2] == ("repaired", False) and got[5] == ("closed", False)
    assert got[6] == got[7] == got[13] == ("strict", False) and got[8] == ("repaired", True)
    assert sorted(r["id"] for r in bad.collect()) == [9, 10, 11, 12]
    whole = F.col("raw")
    for pattern, by in R.REPAIRS:
        whole = F.regexp_replace(whole, pattern, by)
    s = F.regexp_replace(F.trim(F.regexp_replace("raw", r"(?s)<thinking>.*?</thinking>", "")), r"(?i)^```(?:json)?\s*", "")
    same = df.select(R.strip_noise("raw").eqNullSafe(F.trim(F.regexp_replace(s, r"\s*```$", ""))).alias("a"),
                     (R.repair("raw").eqNullSafe(whole) | F.contains("raw", F.lit("\n"))).alias("b")).collect()
    assert all(r["a"] and r["b"] is not False for r in same)
