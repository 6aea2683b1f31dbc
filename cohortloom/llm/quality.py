"""Quality classifier by co-training two views of a document.

The content view sees the text's byte trigrams (hashed, square roots of shares); the metadata
view sees source, language, size and layout counts. Each is a logistic regression, fitted on a
bounded sample of labelled documents. In every round each view scores all unlabelled documents
in Spark; of those it is sure of, the surest of every source come first, as many good and bad
ones as the labelled rows suggest, and join the other view's training rows. Both views are
calibrated on a labelled fifth that they never train on, and combined there; the combination
scores all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_text, id_key, prepare, stored, text_blocks

#: Labelled documents that the classifier is fitted on at most; the unlabelled are all scored.
LABELLED = 3000
#: Rounds of exchange, certainty of a pseudo-label, and pseudo-labels a view gives in a round.
ROUNDS, SURE, PER_ROUND = 3, 0.95, 300
#: Probability of good quality from which a document is accepted: only clear cases go.
ACCEPT = 0.25
TRIGRAMS_LOG2 = 11
_KINDS = 7


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed byte-trigram shares, and the share of distinct slots."""
    n, size = len(offsets) - 1, 1 << TRIGRAMS_LOG2
    counts = np.zeros(n * size, np.float32)
    if data.size > 2:
        code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAMS_LOG2)
        owner = np.repeat(np.arange(n), np.diff(offsets))[:-2]
        whole = np.arange(owner.size) + 2 < offsets[1:][owner]
        counts = np.bincount((owner * size + slot)[whole], minlength=n * size).astype(np.float32)
    counts = counts.reshape(n, size)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    distinct = (counts > 0).sum(axis=1, keepdims=True) / np.minimum(total, size)
    return np.concatenate([np.sqrt(counts / total), distinct.astype(np.float32)], axis=1)


def _kinds() -> np.ndarray:
    """Byte to kind: lower, upper, digit, space, line end, other ASCII, beyond ASCII."""
    kinds = np.full(256, 5)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 0, 1, 2, 6
    kinds[[32, 9]], kinds[[10, 13]] = 3, 4
    return kinds


@dataclass(frozen=True)
class Names:
    """Sources and languages of the fitting sample; all others share one place, nulls another."""

    sources: tuple[str, ...]
    languages: tuple[str, ...]

    @staticmethod
    def places(column: pa.Array, known: tuple[str, ...]) -> np.ndarray:
        """One-hot rows: a known value's place, then one for others, then one for null."""
        found = pc.index_in(column, pa.array(known, pa.string())).to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(found.astype(float)), len(known), found).astype(np.int64)
        place[column.is_null().to_numpy(zero_copy_only=False)] = len(known) + 1
        return np.eye(len(known) + 2, dtype=np.float32)[place]


def metadata_view(data: np.ndarray, offsets: np.ndarray, source: np.ndarray, lang: np.ndarray
                  ) -> np.ndarray:
    """Source and language (one-hot rows), size, shares of byte kinds, line and word sizes."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * _KINDS + _kinds()[data], minlength=n * _KINDS).reshape(n, _KINDS)
    total = np.maximum(sizes, 1)
    out = [source, lang, np.log1p(sizes)[:, None] / 10,
           3 * np.sqrt(kinds / total[:, None]),
           np.log1p(sizes / (kinds[:, 4] + 1))[:, None] / 5,
           np.log1p(sizes / (kinds[:, 3] + 1))[:, None] / 3]
    return np.concatenate(out, axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """A linear classifier; ``fit`` is accelerated gradient descent with a ridge."""

    weights: np.ndarray
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> Logistic:
        step = 4.0 / (float(np.einsum("ij,ij->", x, x)) / max(1, len(x)) + 1.0)
        w, b, last_w, last_b = self.weights, self.bias, self.weights, self.bias
        for i in range(1, steps + 1):
            push = (i - 1) / (i + 2)
            at_w, at_b = w + push * (w - last_w), b + push * (b - last_b)
            gap = (_sigmoid(x @ at_w + at_b) - y).astype(np.float32)
            last_w, last_b = w, b
            w = at_w - np.float32(step) * (x.T @ gap / len(y) + np.float32(ridge) * at_w)
            b = at_b - step * float(gap.mean())
        self.weights, self.bias = w.astype(np.float32), float(b)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + np.float32(self.bias)


@dataclass
class Views:
    """Both views with their calibration, and the weights that combine them."""

    content: Logistic
    metadata: Logistic
    scales: list
    mix: Logistic

    def calibrated(self, scores: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.clip(s * a + b, -12, 12) for s, (a, b) in
                         zip(scores, self.scales, strict=True)], axis=1).astype(np.float32)

    def probabilities(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """(n, 3): content view, metadata view, both."""
        logits = self.calibrated([self.content.score(content), self.metadata.score(metadata)])
        return _sigmoid(np.column_stack([logits, self.mix.score(logits)]))


@dataclass
class Handed:
    """Documents that a view is sure of: key, features of both views, pseudo-label."""

    keys: list
    content: np.ndarray
    metadata: np.ndarray
    values: np.ndarray


def quotas(share: float) -> dict[int, int]:
    """Pseudo-labels of a round by class, in the proportion of the labelled rows."""
    return {1: max(1, int(PER_ROUND * share)), 0: max(1, int(PER_ROUND * (1 - share)))}


def co_train(content: np.ndarray, metadata: np.ndarray, labels: np.ndarray, fold: np.ndarray,
             confident: Callable[[list[Logistic], float], list[Handed]]) -> Views:
    """Fit on labelled rows (fold < 4), calibrate on fold 4.

    ``confident(models, share)`` gives, for each view, the unlabelled documents it is sure of.
    """
    train, test = np.flatnonzero(fold < 4), np.flatnonzero(fold == 4)
    rows = [[content[train]], [metadata[train]]]
    answers = [[labels[train].astype(np.float32)] for _ in rows]
    seen: list[set] = [set(), set()]
    models = [Logistic(np.zeros(x.shape[1], np.float32)) for x in (content, metadata)]
    share = float(labels[train].mean())
    for step in range(ROUNDS + 1):
        for model, x, y in zip(models, rows, answers, strict=True):
            model.fit(np.concatenate(x), np.concatenate(y))
        if step == ROUNDS:
            break
        for k, handed in enumerate(confident(models, share)):
            other = 1 - k
            new = [i for i, key in enumerate(handed.keys) if key not in seen[other]]
            seen[other].update(handed.keys)
            rows[other].append((handed.metadata if k == 0 else handed.content)[new])
            answers[other].append(handed.values[new].astype(np.float32))
    test = test if len(set(labels[test].tolist())) == 2 else train
    scales, y = [], labels[test].astype(np.float32)
    for k, view in enumerate((content, metadata)):
        raw = models[k].score(view[test])[:, None]
        spread = float(raw.std()) or 1.0
        fit_line = Logistic(np.ones(1, np.float32)).fit(raw / spread, y, 1e-3, 300)
        scales.append((float(fit_line.weights[0]) / spread, fit_line.bias))
    out = Views(models[0], models[1], scales, Logistic(np.full(2, 0.5, np.float32)))
    logits = out.calibrated([models[0].score(content[test]), models[1].score(metadata[test])])
    out.mix.fit(logits / 4, y, 1e-3, 300)
    out.mix.weights = out.mix.weights / 4
    return out


def _features(batch: pa.RecordBatch, names: Names) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_text(batch.column("text"))
    return content_view(data, offsets), metadata_view(
        data, offsets, names.places(batch.column("source"), names.sources),
        names.places(batch.column("lang"), names.languages))


def _feature_rows(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                content, metadata = _features(batch, names)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key"),
                     pa.array([x.astype(np.float16).tobytes() for x in content], pa.binary()),
                     pa.array([x.tobytes() for x in metadata], pa.binary())],
                    ["row_key", "content", "metadata"])

    return run


def _sure_rows(models: list[Logistic], names: Names):
    """Documents to (row_key, doc_id, source, view, value, sure) of the views that are sure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                for view, x in enumerate(_features(batch, names)):
                    p = _sigmoid(models[view].score(x)).astype(float)
                    sure = np.maximum(p, 1 - p)
                    at = np.flatnonzero(sure >= SURE)
                    own = [batch.column(c).take(pa.array(at)) for c in ("row_key", "doc_id", "source")]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(np.full(at.size, view, np.int32)),
                         pa.array((p[at] >= 0.5).astype(np.int32)), pa.array(sure[at])],
                        ["row_key", "doc_id", "source", "view", "value", "sure"])

    return run


def _scores(views: Views, names: Names, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                p = views.probabilities(*_features(batch, names)).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], *[pa.array(p[:, i]) for i in range(3)]],
                    [*kept, "content_score", "metadata_score", "score"])

    return run


def _prepared(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.col("source").cast("string"), F.col("lang").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key of (doc_id, text); rows that repeat share it."""
    key = F.xxhash64(id_key(), F.coalesce(F.col("text"), F.lit(""))).alias("row_key")
    return _prepared(docs, key, F.col("doc_id").cast("long").alias("doc_id"))


def _feature_frame(texts: DataFrame, names: Names) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of a bounded number of rows by key, the content view in half precision."""
    found = texts.mapInArrow(_feature_rows(names), "row_key long, content binary, metadata binary")
    out = {}
    for batch in found.toArrow().to_batches():
        columns = [batch.column(c) for c in ("row_key", "content", "metadata")]
        for key, content, metadata in zip(*[c.to_pylist() for c in columns], strict=True):
            out[key] = np.frombuffer(content, np.float16), np.frombuffer(metadata, np.float32)
    return out


def _one_each(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per key of a bounded list, repeats added up where they are read."""
    first = F.min(F.struct("text", "source", "lang")).alias("row")
    return texts.join(F.broadcast(keys), "row_key", "left_semi").groupBy("row_key").agg(first).select(
        "row_key", "row.*")


def confident_documents(docs: DataFrame, labelled: DataFrame, names: Names
                        ) -> Callable[[list[Logistic], float], list[Handed]]:
    """The exchange over all documents without a label (``labelled`` has their doc_id).

    Within each view and class the surest document of every source comes first, then every
    second one, and so on up to the quota, so a rare source takes part however many documents
    the others have. Only narrow rows of sure documents move; of a source no more than the
    quota leave a task's partial ranking.
    """
    texts = _keyed(docs)

    def confident(models: list[Logistic], share: float) -> list[Handed]:
        most = quotas(share)
        sure = texts.mapInArrow(_sure_rows(models, names), (
            "row_key long, doc_id long, source string, view int, value int, sure double"))
        free = sure.join(labelled, "doc_id", "left_anti").dropDuplicates(["row_key", "view"])
        source = Window.partitionBy("view", "value", "source").orderBy(F.desc("sure"), "row_key")
        ranked = stored(free.withColumn("place", F.row_number().over(source)).filter(
            F.col("place") <= PER_ROUND))
        picks = [ranked.filter((F.col("view") == view) & (F.col("value") == value)).orderBy(
            "place", F.desc("sure"), "row_key").limit(most[value])
            for view in (0, 1) for value in (0, 1)]
        chosen = stored(reduce(DataFrame.union, picks).select("row_key", "view", "value"))
        rows = sorted((r.view, r.row_key, r.value) for r in chosen.collect())
        features = _feature_frame(_one_each(texts, chosen.select("row_key").distinct()), names)
        out = []
        for view in (0, 1):
            own = [(key, value) for v, key, value in rows if v == view]
            width = [len(x) for x in next(iter(features.values()))] if features else [0, 0]
            out.append(Handed([key for key, _ in own], *[
                np.array([features[key][k] for key, _ in own], np.float32).reshape(-1, width[k])
                for k in (0, 1)], np.array([value for _, value in own])))
        return out

    return confident


def fit_views(docs: DataFrame, labels: DataFrame) -> tuple[Views, Names] | None:
    """The classifier and its known names; None without labelled documents of both classes.

    It is fitted on at most LABELLED labelled documents, picked by a hash of their id: of an id
    that several texts have, the least text. Labels (doc_id, quality) of an id that disagree
    count as bad; null ones are ignored.
    """
    clean = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("label"))
    draw = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    chosen = stored(clean.orderBy(draw, "doc_id").limit(LABELLED))
    least = F.min(F.struct("text", "row_key", "source", "lang")).alias("row")
    rows = stored(_keyed(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        least).select("doc_id", "label", "row.*"))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(5)).cast("int")
    found = sorted((tuple(r) for r in rows.select("row_key", "label", fold, "source", "lang").collect()),
                   key=lambda r: r[:3])
    if len({r[1] for r in found if r[2] < 4}) < 2:
        return None
    names = Names(tuple(sorted({r[3] for r in found if r[3] is not None})),
                  tuple(sorted({r[4] for r in found if r[4] is not None})))
    features = _feature_frame(rows.select("row_key", "text", "source", "lang"), names)
    content, metadata = (np.stack([features[r[0]][k] for r in found]).astype(np.float32)
                         for k in (0, 1))
    del features
    views = co_train(content, metadata, np.array([r[1] for r in found]),
                     np.array([r[2] for r in found]),
                     confident_documents(docs, clean.select("doc_id"), names))
    return views, names


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)
                    ) -> DataFrame:
    """The ``keep`` columns of every row with content_score, metadata_score, score, accepted.

    Scores are probabilities of good quality; a row is accepted from ACCEPT on. Null text is
    empty, null source and language are a value of their own, those that no labelled document
    has are one value together. Very long texts are read whole. Repeated rows get equal scores;
    documents that a view is equally sure of count in the order of a hash of id and text.
    Without labels of both classes there is nothing to reject by: all scores are 1. Rows stay
    in place; an empty table gives an empty result; columns outside ``keep`` are ignored.
    """
    prepare(docs.sparkSession)
    fitted = fit_views(docs, labels)
    if fitted is None:
        out = docs.select(*keep, *[F.lit(1.0).alias(c) for c in
                                   ("content_score", "metadata_score", "score")])
    else:
        kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
        names = [f"kept_{i}" for i in range(len(keep))]
        rows = _prepared(docs, *kept)
        schema = ", ".join(f"{n} {t}" for n, t in rows.select(*names).dtypes)
        out = rows.mapInArrow(_scores(*fitted, names), schema + (
            ", content_score double, metadata_score double, score double"))
        out = out.withColumnsRenamed(dict(zip(names, keep, strict=True)))
    return out.withColumn("accepted", F.col("score") >= ACCEPT)
