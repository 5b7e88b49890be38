"""The corpus pipeline against brute force, stage by stage."""

import re

import public_tokenizers
import pytest

import corpus_pipeline as P
from .test_dedup import dedup_by_hand, fingerprint, least_reachable
from .test_tokens import check_pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(30).collect()
    more = [(90_000 + i, r["text"], "en", "src0", 1) for i, r in enumerate(first[:6])] + [
        (90_100, None, None, None, None), (90_101, "", "en", None, 0), (90_102, "123 456", "en", "src1", 7), (None, "a text without an id", None, None, 1),
        (None, "a text without an id", None, None, 1), (90_103, "one\ntwo\nthree\nfour five", "en", None, 3), (90_104, "one\ntwo\nthree\nsix seven", "en", "src2", 3)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(str(base / "in"))
    frames = [spark.read.parquet(str(base / "in"))]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(base / str(i)))
        frames.append(spark.read.parquet(str(base / str(i))))
    return frames


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_names_and_columns(stages):
    assert [name for name, _ in P.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_language_stage_keeps_all_with_letters(stages):
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[1] and any(c.isalpha() for c in r[1])]


def test_line_dedup_stage(stages):
    before = [r for r in rows(stages[1]) if r[0] is not None]
    by_hand = {i: (t, n, cut) for i, t, n, cut in dedup_by_hand([r[:2] for r in before])}
    want = [(r[0], by_hand[r[0]][0], *r[2:4], len(by_hand[r[0]][0]) if by_hand[r[0]][2] else r[4]) for r in before if by_hand[r[0]][2] < by_hand[r[0]][1]]
    got = rows(stages[2])
    assert [r for r in got if r[0] is not None] == sorted(want, key=str)
    assert sum(r[0] is None for r in got) == 2 and any(cut for _, _, cut in by_hand.values())


def test_simhash_stage(stages):
    before = rows(stages[2])
    prints = [fingerprint(r[1]) for r in before]
    near = [(a, b) for a in range(len(before)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = least_reachable(range(len(before)), near)
    least = {}
    for k, r in enumerate(before):
        if r[0] is not None:
            least[root[k]] = min(r[0], least.get(root[k], r[0]))
    want = {r for k, r in enumerate(before) if r[0] is None or least[root[k]] == r[0]}
    assert rows(stages[3]) == sorted(want, key=str)


def test_mixing_stage(spark, stages):
    taken = {}
    for r in rows(stages[4]):
        taken[r[0], r[3]] = taken.get((r[0], r[3]), 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        assert r[4] == len(r[1])
    from kiln.llm import mixing

    want = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect() if r["taken"]}
    assert {i: n for (i, _), n in taken.items()} == want
    whole = {r[0]: r[1] for r in rows(stages[3])}
    assert all(whole[r[0]].startswith(r[1]) for r in rows(stages[4]))


def test_packing_stage(stages):
    check_pack([r[:2] for r in rows(stages[4])], stages[5].collect())


def test_run(spark):
    assert P.ORACLE_SQL is None
    assert P.run(spark, SF).count() > 0


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages_on_an_empty_table(spark, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.STAGES[k][1](spark, docs, SF)
    assert out.collect() == [] and (k == 4 or out.columns == COLUMNS)


def test_stages_on_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, lang_pred string, row int, size int, taken int, fp int, n_lines int"
    docs = spark.createDataFrame([(i, f"some text number {i}\nwith\nlines {i}", "en", "s", 1, 2, "x", 3, 4, 5, 6, 7) for i in range(5)], kind)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in kind.split(", ")] and docs.count() >= 1
    assert {tuple(r)[5:] for r in docs.collect()} == {(2, "x", 3, 4, 5, 6, 7)}
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0
    assert public_tokenizers.path(P.TOKENIZER)


def test_one_document_of_each_simhash_group(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(300))
    near = lambda t: next(x for i in range(300) if (x := f"{t} tail{i}") and 0 < bin(fingerprint(x) ^ fingerprint(t)).count("1") <= 2)
    x, y, z, u, v, w = map(text, "xyzuvw")
    near_x = near(x)
    rows = [(3, x), (5, near_x), (5, y), (5, y), (None, z), (None, near(z)), (None, near(x)), (None, u), (8, near(u)), (5, v), (5, near(v)), (None, w), (None, w)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = P.simhash_dedup(spark, docs, SF)
    assert out.columns == COLUMNS
    want = [(3, x), (5, y), (None, min(z, near(z))), (8, near(u)), (5, min(v, near(v))), (None, w)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
