"""Language identification and quality: held-out accuracy, odd rows, stability."""

import duckdb
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

import __spark_entry__ as E
from kiln.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = E.queries()["op4_langid"](spark, SF).toPandas().set_index("doc_id")
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert len(got) == len(truth)
    assert all(got["held_out"][i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    held = [i for i in truth if got["held_out"][i]]
    assert np.mean([got["lang_pred"][i] == truth[i] for i in held]) >= 0.98
    assert got["score"].between(0, 1).all()


def model_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(langid.training_rows(docs))


def test_languages_by_family(spark):
    model = model_of(spark)
    assert model.families == [["de", "en"], ["es", "fr"]] and model.pairs == [("de", "en"), ("es", "fr")]
    assert langid.group(["xx", "de", "fr"], langid.FAMILIES) == [["de"], ["fr"], ["xx"]]


def test_odd_texts_and_neighbours(spark):
    model = model_of(spark)
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 40").fetchall()]
    rows = [(i, t, "l", 0.0) for i, t in enumerate(docs)] + [(100, None, "l", 0.0), (101, "", "l", 0.0), (102, "12 %% \n", "l", 0.0), (None, docs[0], None, None),
                                                             (1, docs[1], "l", 0.0), (103, docs[2] * 800, "l", 0.0), (104, "é", "l", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df.coalesce(1), model).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[104]["lang_pred"] != "und"
    assert by[None]["lang_pred"] == by[0]["lang_pred"] and by[103]["lang_pred"] == by[2]["lang_pred"]
    # a text's score does not depend on the texts beside it
    margins, _ = model.margins([t or "" for _, t, *_ in rows])
    for k, (_, t, *_) in enumerate(rows):
        alone, _ = model.margins([t or ""])
        assert margins[k] == pytest.approx(alone[0], abs=1e-4)
    assert langid.identify(df.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.fit(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None
    tagged = langid.tag(df, model)
    assert tagged.columns == ["doc_id", "text", "lang_pred", "score"] and tagged.count() == len(rows)


def test_one_language(spark):
    df = spark.createDataFrame([(i, f"some words {i} here", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df)).collect()} == {"en"}


def test_quality_of_held_out_documents(spark):
    got = E.queries()["op8_quality"](spark, SF).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    held = [(i, y) for i, y in labels if got["held_out"][i]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got["held_out"][i] for i, _ in labels)
    assert np.mean([got["predicted"][i] == y for i, y in held]) >= 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("good words in a row " if i % 2 else "BAD!! STUFF%% ") * (1 + i % 7), "z") for i in range(60)] +
                                 [(100, None, "z"), (101, "", "z"), (None, "good words", None), (3, "good words in a row", "z"), (102, "good words " * 50_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, "q") for i in range(60)] + [(None, 1, "q"), (5, None, "q"), (7, 0, "q"), (9, 5, "q")], "doc_id long, quality int, y string")
    model = quality.fit(docs, labels, per_class=50)
    got = quality.score(docs, model).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[102] > 0.5 > by[0] and by[100] == by[101]
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    texts = [r["text"] or "" for r in docs.collect()]
    assert model.scores(texts) == pytest.approx(np.concatenate([model.scores([t]) for t in texts]), abs=1e-6)
