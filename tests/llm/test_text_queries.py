"""The registered text queries on the driver's smallest tables, and the pipeline against its stages' rules."""

import re

import pytest
from parity import compare

from silvaflow.llm import queries as text

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(text.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compare(spark, text.queries()[name], text.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", [n for n in text.queries() if re.match("op(2|7|8|9|10)_", n)])
def test_one_row_a_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = text.queries()[name](spark, FOLDER)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline
    from test_text_operators import brute_components

    from silvaflow.llm import secret_scan

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {k: t for k, t in rows.items() if t and any(map(str.isalpha, t))}
    last = {t: k for k, t in sorted(kept.items())}
    kept = {k: t for t, k in last.items()}
    links = brute_components(list(kept.items()))
    kept = {k: t for k, t in kept.items() if links[k][1] == k}
    kept = {k: secret_scan.redacted(t, "[SECRET]") for k, t in kept.items()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, digest string, maybe int, row int, `a.b` int"


def test_pipeline_of_odd_tables(spark):
    """Nulls in every column, empty and repeated texts, ties, clashing and dotted names; then no rows at all."""
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(30))
    rows = [
        (1, words, "en", "s", 9, "c", "d", 1, 1, 1), (2, words, None, None, None, None, None, None, None, None), (2, words, "en", "t", 9, "c", "d", 1, 1, 2),
        (3, words + " tail", "en", "s", 9, "c", "d", 1, 1, 1), (None, "some other words here", "en", "s", 9, "c", "d", 1, 1, 1), (None, None, "en", "s", 9, "c", "d", 1, 1, 1),
        (4, "", "en", "s", 0, "c", "d", 1, 1, 1), (5, "12 34", "en", "s", 5, "c", "d", 1, 1, 1), (6, "password = hunter22x", None, "s", 20, "c", "d", 1, 1, 1), (7, "x" * 60_000, "en", "s", 9, "c", "d", 1, 1, 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        left.append(sorted((r.doc_id or 0, (r.text or "")[:12]) for r in docs.select("doc_id", "text").collect()))
    assert [len(x) for x in left] == [7, 5, 4, 4]
    assert {k for k, _ in left[-1]} == {0, 2, 6, 7}
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[6].text == "[SECRET]" and kept[6].n_chars == 8 and kept[6].lang == "en"
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {None, 2, 6, 7}
    nothing = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name


def test_language_stage_without_a_language_column(spark):
    from silvaflow.llm import langid

    docs = spark.createDataFrame([(1, "words"), (2, "12"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_identified(docs).collect()] == [1]


def test_toxicity_on_the_given_tables(spark):
    """Held-out recall and false alarms. Some labels stand on texts without any telling word, which nothing could find, so recall is that of the others."""
    found = text.queries()["op2_crf_toxicity"](spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").select("toxic", "predicted").collect()
    caught, all_ = sum(r.toxic and r.predicted for r in rows), sum(r.toxic for r in rows)
    assert caught >= 0.75 * all_ and sum(not r.toxic and r.predicted for r in rows) <= 0.01 * len(rows)
