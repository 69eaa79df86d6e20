"""String, null and repeated ids, columns with clashing names, all-null texts and empty tables, for operators and stages."""

import pytest

import corpus_pipeline
from joinlab.llm import exact_dedup, license_scan, line_dedup, mixing, mpeg_audio, packing, rule_ensemble, simhash, substring_dedup

LONG = " ".join(f"word{k % 97}x{k}" for k in range(40))


def frame(spark, kind="string"):
    ids = ["b", "a", None, "a", "c"] if kind == "string" else [2, 1, None, 1, 3]
    texts = [LONG, LONG, LONG + " more", None, ""]
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in zip(ids, texts)], f"doc_id {kind}, text string, source string, score string, n string")


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_kind(spark, kind):
    docs = frame(spark, kind)
    assert mpeg_audio.media_columns(mpeg_audio.wrap_texts(docs)).count() == 5
    lines = line_dedup.remove_repeated_lines(docs).collect()
    assert len(lines) == 5
    assert license_scan.scan_licenses(docs).count() == 5 and exact_dedup.exact_dedup(docs).count() == 5
    assert mixing.mix(docs).count() == 5 and packing.pack(docs).selectExpr("sum(length)").first()[0] > 0
    assert simhash.near_duplicates(docs).count() == 5
    cut = substring_dedup.cut_repeats(docs).collect()
    first = "a" if kind == "string" else 1
    second = "b" if kind == "string" else 2
    assert len(cut) == 5 and {r.n_removed for r in cut if r.doc_id == first} == {0} and [r.n_removed for r in cut if r.doc_id == second] == [40]


def test_texts_that_are_all_null(spark):
    docs = spark.createDataFrame([(k, None, None) for k in range(3)], "doc_id long, text string, source string")
    assert [r.target for r in mixing.mix(docs).collect()] == [0.0] * 3
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0}
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {(2, 3)}
    assert {r.n_removed for r in line_dedup.remove_repeated_lines(docs).collect()} == {0}


def test_few_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "x") for k in range(13)], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(13)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert {0 < r.score < 1 for r in rule_ensemble.score_documents(docs, labels).collect()} == {True}


def test_an_index_goes_on(spark):
    old = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    new = spark.createDataFrame([(7, "some words " + LONG), (8, "nothing old")], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, 4, "kept")
    assert substring_dedup.cut_repeats(old, batches=1, index=index).first().n_removed == 0
    again = substring_dedup.FingerprintIndex(spark, 4, "kept")
    assert [n for n, _ in again.runs] == [n for n, _ in index.runs] != []
    got = {r.doc_id: r.n_removed for r in substring_dedup.cut_repeats(new, batches=1, index=again, history=old).collect()}
    again.drop()
    assert got == {7: 40, 8: 0}


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, d0 string"
    rows = [(1, LONG, "en", "s", 1, 0.5, "q"), (1, LONG + " z", "en", "s", 1, 0.5, "q"), (None, None, None, None, None, None, None), (None, "x", "en", "s", 1, 0.1, "r"), (5, LONG, "en", "t", 1, 0.5, "q")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == table.columns
        assert corpus_pipeline.pack(spark, docs, "").columns[0] == "doc_id"
    bad = spark.createDataFrame([(None, "bad bad " * 50, "en", "s", 1, 0.0, "q"), (None, LONG, "en", "s", 1, 0.0, "q")], schema)
    scores = {r.score >= rule_ensemble.CUTOFF for r in rule_ensemble.score_documents(bad, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
    assert corpus_pipeline.quality(spark, bad, "/root/testdata/sf0.001").count() in ({0, 1} if False in scores else {2})
