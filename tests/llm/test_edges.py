"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import (exact_dedup, language_id, licenses, mixing, pieces, quality, registry,
                            simhash, sketches, stages, token_files, url_filter)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, "The cat sat on the mat and the dog lay by the door.", "en", "a", 51),
    (2, "The cat sat on the mat and the dog lay by the door.", "en", "a", 51),
    (2, "The cat sat on the mat and the dog lay by the door.", "en", "a", 51),
    (3, "", "en", "b", 0), (4, None, "de", None, None), (5, " \n\t ", None, "b", 4),
    (None, "Der Hund schläft im Garten neben dem alten Haus.", "de", "c", 48),
    (None, None, None, None, None), (6, LONG, "en", "b", len(LONG)),
    (7, "x", "de", "a", 1), (7, "y", "de", "c", 1),
    (8, "Released under the MIT License.\nÜber alles 😀 ▁ \x00 <|endoftext|>", "de", "a", 60),
]
CLASHES = ("id_key", "sha_key", "key", "cell", "draw", "print", "block", "part", "late", "at",
           "label", "fold", "score", "kept", "kept_0", "fingerprint", "component_id", "digest",
           "place", "size", "position", "row_no", "recipe", "content", "host", "verdict")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (7, 0, 0), (3, 0, 1), (None, 1, 0), (6, None, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, d: language_id.identify_languages(d),
    "op2": lambda spark, d: quality.score_documents(d, labels(spark)),
    "op3": lambda spark, d: sketches.edited_fingerprints(d),
    "op4": lambda spark, d: licenses.scan_licenses(d),
    "op5": lambda spark, d: simhash.simhash_groups(d),
    "op6": lambda spark, d: token_files.token_files(d, registry.vocabulary(registry.WORD_MODEL)),
    "op7": lambda spark, d: pieces.encode_documents(d, registry.vocabulary(registry.PIECE_MODEL)),
    "op8": lambda spark, d: exact_dedup.exact_groups(d),
    "op9": lambda spark, d: mixing.mixture(d),
}


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 5)
    monkeypatch.setattr(language_id.train, "__defaults__", (None, 8, 5, 1))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_row(spark, name):
    found = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row(spark, name):
    assert len(OPERATORS[name](spark, frame(spark, ROWS[:1])).collect()) == 1


def test_defined_results(spark):
    docs = frame(spark, ROWS)
    lang = {r.doc_id: r for r in OPERATORS["op1"](spark, docs).collect()}
    assert lang[4].lang_pred == lang[5].lang_pred == lang[3].lang_pred == "und"
    assert lang[4].score == 0
    exact = [r for r in OPERATORS["op8"](spark, docs).collect()]
    twos = [r for r in exact if r.doc_id == 2]
    assert {r.group_size for r in twos} == {3} and sum(r.kept for r in twos) == 1
    assert {r.keep_id for r in exact if r.doc_id in (3, 4)} == {4}
    prints = {str(r.doc_id): r for r in OPERATORS["op5"](spark, docs).collect()}
    assert prints["3"].fingerprint == prints["5"].fingerprint == "0" * 16
    assert prints["4"].component_id == 3
    scan = {r.doc_id: r for r in OPERATORS["op4"](spark, docs).collect()}
    assert scan[8].line_licenses == "MIT" and scan[8].n_license_lines == 1
    assert scan[1].line_licenses is None
    assert all(r.score == 1 for r in quality.score_documents(
        docs, labels(spark, [(1, 1, 0)])).collect())


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, verdict string"
    rows = [(1, None, "", "", ""), (2, "no scheme", "", "", ""), (None, "http://a.com/x", "", "", ""),
            (3, "http://a.com/x", None, None, None), (3, "http://a.com/x", None, None, None),
            (4, "", "", "", ""), (5, "http://é.org/" + "a" * 100_000, "", "", "")]
    found = url_filter.judge_urls(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows) and {r.verdict for r in found} <= {"allow", "block"}
    assert [r.host for r in found if r.page_id in (1, 2, 4)] == [""] * 3
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("stage", [stages.exact, stages.near, stages.mix])
def test_stages_keep_the_columns(spark, stage):
    found = stage(spark, frame(spark, ROWS), "")
    assert tuple(found.columns) == stages.COLUMNS
    assert found.count() > 0
    assert stage(spark, frame(spark, []), "").collect() == []
    if stage is stages.exact:
        texts = [r.text or "" for r in found.collect()]
        assert len(texts) == len(set(texts)) == len({r[1] or "" for r in ROWS})


def test_lone_mixture_takes_everything(spark):
    found = OPERATORS["op9"](spark, frame(spark, ROWS[:1])).first()
    assert (found.size, found.taken, found.target, found.position) == (13, 13, 13.0, 0.0)


def test_quality_and_encode_stages(spark, tmp_path):
    """Odd rows, no rows and clashing names; the labels too have columns of their own."""
    clashing = labels(spark).select("*", *[F.lit(1).alias(c) for c in ("row_key", "text", "label", "view")])
    clashing.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (ROWS, []):
        found = stages.quality(spark, frame(spark, rows), str(tmp_path))
        assert tuple(found.columns) == stages.COLUMNS
        kept = [r.doc_id for r in found.collect()]
        assert set(kept) <= {r[0] for r in rows} and (kept.count(2) in (0, 2))
        encoded = stages.encode(spark, frame(spark, rows), "").collect()
        assert sorted(str(r.doc_id) for r in encoded) == sorted(str(r[0]) for r in rows)
    empty = [r for r in stages.encode(spark, frame(spark, ROWS), "").collect() if r.doc_id in (3, 4)]
    assert {r.n_tokens for r in empty} == {0}


@pytest.mark.parametrize("rows", [ROWS, ROWS[3:5], []])
def test_whole_pipeline_on_odd_tables(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).select("*", F.lit("clash").alias("text")).write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows}
    texts = {r[1] for r in rows if r[1] and r[1].split()}
    assert bool(found) == bool(texts)
    assert all(r.n_tokens > 0 for r in found)
