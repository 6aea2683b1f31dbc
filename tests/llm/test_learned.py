"""Trained operators: gradients, held-out accuracy, and the pipeline's invariants."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import language_id, quality, registry, stages
from cohortloom.llm.common import read_table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b", "c"], 3, rng)
    net.table, net.back = net.table.astype(float), net.back.astype(float)
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    codes = rng.integers(97, 123, (7, 5))
    codes[5:, 0] = language_id.PAD
    target = np.array([0, 1, 2, 1, 0])
    _, grads = language_id.gradients(net, codes, target)
    for weight, grad in zip(net.weights(), grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            if len(at) == 3 and weight.shape[2] == language_id.PAD + 1:
                at = (*at[:2], int(codes[rng.integers(0, 5), rng.integers(0, 5)]))
            old, step = weight[at], 1e-4
            weight[at] = old + step
            up, _ = language_id.gradients(net, codes, target)
            weight[at] = old - step
            down, _ = language_id.gradients(net, codes, target)
            weight[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_padding_and_neighbours_do_not_matter():
    net = language_id.Network.fresh(["a", "b"], 4, np.random.default_rng(1))
    texts = [b"some words here", b"", b"x" * 300, b"\xc3\xa9t\xc3\xa9 1234"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = language_id.pooled(net, data, offsets)
    for i, t in enumerate(texts):
        alone = language_id.pooled(net, np.frombuffer(t + b" ", np.uint8)[:len(t)],
                                   np.array([0, len(t)])) if t else np.zeros((1, 2))
        assert np.allclose(alone[0], together[i], atol=1e-5)


def test_languages_on_held_out_documents(spark):
    docs = read_table(spark, FOLDER, "documents")
    found = registry.op1_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es"}


def test_languages_do_not_see_held_out_labels(spark):
    """Other labels and texts on held-out rows leave all predictions of the rest as they are."""
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    changed = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    first = {r.doc_id: r.lang_pred for r in language_id.identify_languages(docs).collect()}
    second = {r.doc_id: r.lang_pred for r in language_id.identify_languages(changed).collect()}
    assert first == second


def test_quality_on_documents_without_a_label_seen(spark):
    """Labels of a half are hidden; the classifier must find them."""
    docs, labels = (read_table(spark, FOLDER, t) for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    found = quality.score_documents(docs, seen).join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    good = [r.accepted for r in found if r.quality == 1]
    bad = [r.accepted for r in found if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    for r in found:
        assert 0 <= min(r.content_score, r.metadata_score, r.score) <= 1


def test_views_teach_each_other():
    """A view without labelled signal of its own learns from the other's pseudo-labels."""
    rng = np.random.default_rng(0)
    n = 1500
    truth = rng.integers(0, 2, n)
    content = (rng.standard_normal((n, 5)) + 2 * truth[:, None]).astype(np.float32)
    metadata = (rng.standard_normal((n, 5)) + 2 * truth[:, None]).astype(np.float32)

    def confident(models, share):
        out = []
        for model, view in zip(models, (content, metadata), strict=True):
            p = quality._sigmoid(model.score(view[60:]))
            rows = []
            for value, sure in ((1, p), (0, 1 - p)):
                order = np.argsort(-sure, kind="stable")[:quality.quotas(share)[value]]
                rows += [(i + 60, value) for i in order if sure[i] >= quality.SURE]
            keys = [i for i, _ in rows]
            out.append(quality.Handed(keys, content[keys], metadata[keys], np.array([v for _, v in rows])))
        return out

    views = quality.co_train(content[:60], metadata[:60], truth[:60], np.arange(60) % 5, confident)
    p = views.probabilities(content, metadata)
    assert np.mean((p[60:, 2] > 0.5) == truth[60:]) > 0.97


def exchange_rows(spark):
    """Two sources of very different size, labelled rows in between, repeats and odd rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        good = rng.random() < 0.6
        words = ["the", "quiet", "garden", "letter"] if good else ["%%", "WIN!!", "$$$", "7777"]
        text = " ".join(rng.choice(words, int(rng.integers(3, 30))))
        rows.append((i, text, "en", "rare" if i % 100 == 7 else "hot", len(text)))
    rows += [rows[20]] * 3 + [(None, "%% $$$ 7777", None, None, 0), (None, None, "en", "hot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return rows, docs


def test_exchange_matches_brute_force(spark, monkeypatch):
    """One round over all unlabelled documents: the surest of each source first."""
    monkeypatch.setattr(quality, "PER_ROUND", 40)
    rows, docs = exchange_rows(spark)
    names = quality.Names(("hot",), ("en",))
    rng = np.random.default_rng(1)
    labelled = set(range(0, 700, 3))
    texts = {r.row_key: r for r in quality._keyed(docs).collect()}
    features = quality._feature_frame(quality._keyed(docs).dropDuplicates(["row_key"]), names)
    widths = [len(x) for x in next(iter(features.values()))]
    models = [quality.Logistic((rng.standard_normal(w) * 2).astype(np.float32)) for w in widths]
    frame = spark.createDataFrame([(i,) for i in labelled], "doc_id long")
    found = quality.confident_documents(docs, frame, names)(models, 0.6)
    for view, handed in enumerate(found):
        wanted = []
        for value, most in quality.quotas(0.6).items():
            by_source = {}
            for key, row in texts.items():
                p = float(quality._sigmoid(models[view].score(features[key][view][None].astype(np.float32)))[0])
                sure = max(p, 1 - p)
                if row.doc_id not in labelled and sure >= quality.SURE and (p >= 0.5) == bool(value):
                    by_source.setdefault(row.source, []).append((-sure, key))
            ranked = [(place, *item) for own in by_source.values()
                      for place, item in enumerate(sorted(own))]
            wanted += [(key, value) for _, _, key in sorted(ranked)[:most]]
        got = list(zip(handed.keys, handed.values.tolist(), strict=True))
        # features travel as halves, so documents at the edge of the quota may trade places
        assert len(got) == len(wanted) and len(set(got) ^ set(wanted)) <= 4
        rare = {k for k, _ in wanted if texts[k].source in ("rare", None)}
        assert rare and rare <= set(handed.keys) | {k for k, _ in got}


def test_quality_of_a_rare_source(spark):
    """A source that no labelled document has still gives pseudo-labels and fair scores."""
    rows, docs = exchange_rows(spark)
    labels = spark.createDataFrame(
        [(i, int("garden" in r[1] or "letter" in r[1] or "quiet" in r[1] or "the" in r[1]))
         for i, r in enumerate(rows[:700]) if i % 4 == 0 and r[3] == "hot"], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    for i, r in enumerate(rows[:700]):
        assert (found[i] > 0.5) == ("%%" not in r[1] and "WIN" not in r[1] and "$" not in r[1] and "7777" not in r[1])


def test_pipeline_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "SentencePiece encoding"
    accepted = stages.quality(spark, docs, FOLDER)
    assert accepted.columns == docs.columns
    clean = docs.join(read_table(spark, FOLDER, "labels").filter("quality = 1"), "doc_id", "left_semi")
    lost = clean.join(accepted, "doc_id", "left_anti").count()
    assert lost <= 0.005 * clean.count()
    once = stages.exact(spark, docs, FOLDER)
    assert once.count() == once.select("text").distinct().count() == docs.select("text").distinct().count()
    near = stages.near(spark, once, FOLDER)
    assert near.count() == registry.simhash.component_heads(once).count()
    mixed = stages.mix(spark, near, FOLDER)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = stages.encode(spark, mixed, FOLDER)
    assert out.count() == mixed.count()
