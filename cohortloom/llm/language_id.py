"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. In either direction a gated recurrent unit of a few
cells reads the window (hard-sigmoid gates, soft-sign state); both states label every
position, and a document's probabilities are the mean over its letter positions. Numpy runs
thousands of windows side by side, one time step at a time. Training is backpropagation
through time with Adam on a bounded sample of labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_text, prepare, text_blocks

CELLS = 8
#: Labelled documents per language that the model learns from, about, and windows of each.
DOCUMENTS_PER_LABEL, WINDOWS_PER_DOCUMENT = 1500, 4
TRAIN_WINDOW, WINDOW = 64, 128
STEPS, BATCH, RATE = 400, 256, 0.02
PAD = 256
UNKNOWN = "und"
_LETTER = np.concatenate([np.isin(np.arange(256), [*range(65, 91), *range(97, 123),
                                                   *range(128, 256)]), [False]])


@dataclass
class Network:
    """Weights: byte tables (2, 3H, 257), recurrences (2, 3H, H), output (C, 2H) and bias.

    The three blocks of H rows are update gate, reset gate and candidate.
    """

    labels: list[str]
    table: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], cells: int, rng: np.random.Generator) -> Network:
        def draw(scale: float, *shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        net = cls(labels, draw(0.5, 2, 3 * cells, PAD + 1),
                  draw(1 / cells**0.5, 2, 3 * cells, cells),
                  draw(1 / cells**0.5, len(labels), 2 * cells),
                  np.zeros((len(labels), 1), np.float32))
        net.hold()
        return net

    def hold(self) -> None:
        """Padding closes the update gate: the state stays as it was."""
        cells = self.back.shape[2]
        self.table[:, :cells, PAD] = -1e3

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.back, self.out, self.bias]


def _hard(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid in place."""
    x *= np.float32(0.25)
    x += np.float32(0.5)
    np.maximum(x, np.float32(0), out=x)
    np.minimum(x, np.float32(1), out=x)
    return x


def states(net: Network, codes: np.ndarray) -> np.ndarray:
    """States (2, T, H, B) at every position of windows (T, B); the second reads backwards."""
    steps, n = codes.shape
    cells = net.back.shape[2]
    out = np.empty((2, steps, cells, n), np.float32)
    gates, candidate = np.empty((3 * cells, n), np.float32), np.empty((cells, n), np.float32)
    product, size = np.empty((3 * cells, n), np.float32), np.empty((cells, n), np.float32)
    for way in (0, 1):
        state = np.zeros((cells, n), np.float32)
        table, back = net.table[way], net.back[way]
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(table, codes[t], axis=1, out=gates, mode="clip")
            np.matmul(back, state, out=product)
            both = gates[:2 * cells]
            both += product[:2 * cells]
            _hard(both)
            np.multiply(gates[cells:2 * cells], product[2 * cells:], out=candidate)
            candidate += gates[2 * cells:]
            np.abs(candidate, out=size)
            size += np.float32(1)
            candidate /= size
            candidate -= state
            candidate *= gates[:cells]
            state = np.add(state, candidate, out=out[way, t])
    return out


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """Label probabilities (T, C, B) of every position of windows (T, B)."""
    both = states(net, codes)
    cells = both.shape[2]
    scores = np.matmul(net.out[:, :cells], both[0])
    scores += np.matmul(net.out[:, cells:], both[1])
    scores += net.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, codes: np.ndarray, target: np.ndarray
              ) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all letter positions and its gradient, through time."""
    steps, n = codes.shape
    cells = net.back.shape[2]
    kept = []
    state = np.zeros((2, cells, n), np.float32)
    ways = np.stack([codes, codes[::-1]], axis=1)  # (T, 2, B) in reading order
    for t in range(steps):
        rows = np.stack([np.take(net.table[w], ways[t, w], axis=1) for w in (0, 1)])
        product = np.matmul(net.back, state)
        raw = rows[:, :2 * cells] + product[:, :2 * cells]
        gates = _hard(raw.copy())
        inner = rows[:, 2 * cells:] + gates[:, cells:] * product[:, 2 * cells:]
        spread = 1 + np.abs(inner)
        candidate = inner / spread
        old, state = state, state + gates[:, :cells] * (candidate - state)
        kept.append((old, gates, product[:, 2 * cells:], candidate, spread, state))
    forward = np.stack([k[5][0] for k in kept])
    backward = np.stack([k[5][1] for k in kept])[::-1]
    scores = np.matmul(net.out[:, :cells], forward) + np.matmul(net.out[:, cells:], backward)
    scores += net.bias
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    counted = _LETTER[codes].astype(np.float32)  # (T, B)
    total = max(1.0, float(counted.sum()))
    picked = np.take_along_axis(p, np.broadcast_to(target[None, None, :], (steps, 1, n)), 1)[:, 0]
    loss = float(-(np.log(picked + 1e-9) * counted).sum() / total)
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(target[None, None, :], (steps, 1, n)),
                      (picked - 1)[:, None], 1)
    d *= (counted / np.float32(total))[:, None]
    d_out = np.concatenate([np.einsum("tcb,thb->ch", d, forward),
                            np.einsum("tcb,thb->ch", d, backward)], axis=1)
    d_bias = d.sum(axis=(0, 2))[:, None]
    from_out = np.stack([np.matmul(net.out[:, :cells].T, d),
                         np.matmul(net.out[:, cells:].T, d)[::-1]], axis=1)  # (T, 2, H, B)
    d_table, d_back = np.zeros_like(net.table), np.zeros_like(net.back)
    carry = np.zeros_like(state)
    slices = np.zeros((steps, 2, 3 * cells, n), np.float32)
    for t in range(steps - 1, -1, -1):
        old, gates, inner_product, candidate, spread, _ = kept[t]
        now = carry + from_out[t]
        update, reset = gates[:, :cells], gates[:, cells:]
        d_inner = now * update / spread**2
        d_gates = np.concatenate([now * (candidate - old), d_inner * inner_product], axis=1)
        d_gates *= 0.25 * ((gates > 0) & (gates < 1))
        d_product = np.concatenate([d_gates, d_inner * reset], axis=1)
        slices[t] = np.concatenate([d_gates, d_inner], axis=1)
        d_back += np.matmul(d_product, old.transpose(0, 2, 1))
        carry = now * (1 - update) + np.matmul(net.back.transpose(0, 2, 1), d_product)
    for w in (0, 1):
        flat = slices[:, w].transpose(1, 0, 2).reshape(3 * cells, -1)
        where = ways[:, w].reshape(-1)
        for row in range(3 * cells):
            d_table[w, row] = np.bincount(where, flat[row], PAD + 1)
    d_table[:, :, PAD] = 0
    return loss, [d_table, d_back, d_out.astype(np.float32), d_bias.astype(np.float32)]


def _codes(windows: list[bytes], length: int) -> np.ndarray:
    """Windows as columns of byte codes, padded at the end."""
    out = np.full((len(windows), length), PAD, np.int64)
    for i, w in enumerate(windows):
        out[i, :len(w)] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(out.T)


def train(windows: list[bytes], labels: list[str], shares: dict[str, float] | None = None,
          cells: int = CELLS, steps: int = STEPS, seed: int = 1) -> Network:
    """A network fitted to (window, label) pairs; every window is cut to TRAIN_WINDOW bytes.

    Half of a batch is even over labels, half follows ``shares``, the labels' own frequencies.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    by_label = [np.flatnonzero(target == i) for i in range(len(names))]
    codes = _codes([w[:TRAIN_WINDOW] for w in windows], TRAIN_WINDOW)
    net = Network.fresh(names, cells, rng)
    own = np.array([(shares or {}).get(x, 1.0) for x in names], float)
    odds = 0.5 / len(names) + 0.5 * own / own.sum()
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        drawn = rng.multinomial(BATCH, odds)
        pick = np.concatenate([rng.choice(x, k) for x, k in zip(by_label, drawn, strict=True)])
        _, grads = gradients(net, codes[:, pick], target[pick])
        size = sum(float((g**2).sum()) for g in grads) ** 0.5
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            g *= np.float32(min(1.0, 1.0 / (size + 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            w -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (
                np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        net.hold()
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, side_by_side: int = 1024
           ) -> np.ndarray:
    """Mean label probabilities (n, C) over the letter positions of texts laid end to end."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(sizes.size), counts)
    place = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + place * WINDOW
    ends = np.minimum(starts + WINDOW, offsets[1:][owner])
    sums = np.zeros((sizes.size, len(net.labels)))
    letters = np.zeros(sizes.size)
    span = np.arange(WINDOW)[:, None]
    for lo in range(0, owner.size, side_by_side):
        part = slice(lo, lo + side_by_side)
        at = starts[part] + span
        inside = at < ends[part]
        codes = np.where(inside, data[np.minimum(at, data.size - 1)], PAD).astype(np.int64)
        counted = _LETTER[codes]
        p = position_probabilities(net, codes)
        p *= counted[:, None].astype(np.float32)
        found = p.sum(axis=0)  # (C, B)
        for c in range(found.shape[0]):
            sums[:, c] += np.bincount(owner[part], found[c], sizes.size)
        letters += np.bincount(owner[part], counted.sum(axis=0), sizes.size)
    return sums / np.maximum(letters, 1)[:, None]


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text", 1 << 20):
                p = pooled(net, *flat_text(batch.column("text")))
                best = p.argmax(axis=1)
                known = np.array([t.is_valid for t in batch.column("text")])
                names = [net.labels[b] if k else UNKNOWN for b, k in
                         zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"),
                     pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(column: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4.

    A null id is held out too.
    """
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(True))


def training_windows(docs: DataFrame) -> tuple[list, dict[str, int]]:
    """(lang, window) pairs of a bounded sample even over languages, and all rows per language.

    Each language has about DOCUMENTS_PER_LABEL documents, chosen by a hash of the id, and
    WINDOWS_PER_DOCUMENT windows of each, spread over the whole text.
    """
    usable = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return [], {}
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in
                           (F.lit(lang), F.lit(min(1.0, DOCUMENTS_PER_LABEL / n)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    size = F.length("text")
    windows = F.array(*[
        F.substr("text", (size * (i / WINDOWS_PER_DOCUMENT)).cast("int") + 1, F.lit(TRAIN_WINDOW))
        for i in range(WINDOWS_PER_DOCUMENT)])
    most = 2 * DOCUMENTS_PER_LABEL * len(sizes)
    picked = usable.filter(draw < share[F.col("lang")]).select(
        "lang", windows.alias("windows")).limit(most).collect()
    return sorted((r.lang, w) for r in picked for w in r.windows if w), sizes


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    The network learns from text and non-null lang of rows that are not held out. A null
    text, or one without a letter, is ``und`` with score 0; so is every text if there is
    nothing to learn from. Very long texts are labelled at every position, window by window;
    of equally probable languages the first by name is predicted. Rows stay in place; repeated
    rows give repeated rows, an empty table gives an empty result, further columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang",
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    sample, sizes = training_windows(rows)
    if not sample:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    net = train([w.encode() for _, w in sample], [lang for lang, _ in sample], sizes)
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predict(net), "doc_id long, held_out boolean, lang_pred string, score double")
