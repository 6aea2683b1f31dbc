"""Percentile bootstrap intervals from mergeable replicate vectors.

A row's weight in replicate b is a Poisson(1) number that depends only on its id, b and the
seed, so any task can recompute it: no resample is ever drawn centrally or stored, and a
lost executor's work repeats exactly. The weight is whole-number arithmetic that plain SQL
can repeat, and a row weighs the same in every metric.

No row is multiplied by the replicates. A task turns its rows into state vectors with one
entry per replicate, adds them up per group, and hands on one state per group; states of
the same group merge in one exchange. A metric is a way to update, merge and finish a state
(:class:`Metric`): class counts per score value for AUROC and AUPRC, moments for Pearson, or
whatever a caller hands in.

Metrics on ranks of a continuous outcome (Spearman, concordance) are the plain ones of
:mod:`rank_scan`, with a weight per replicate in place of a count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank_scan import BLOCK, Levels, by_group, key_schema, scan

PRIME = 2147483647
#: Weights that are held at a time (rows times replicates), those worked out at a time, rows
#: that are held as numbers, and bytes of open states.
WEIGHTS, CACHED, HELD, STATE_BYTES = 1_000_000, 1 << 15, 1 << 17, 96 << 20


def _poisson_limits(count: int = 12) -> list[int]:
    """PRIME * P(Poisson(1) <= k), rounded down: a draw below the k-th has weight <= k.

    Weights from ``count`` on are rarer than one draw in PRIME where the list ends.
    """
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(count):
        total += term
        out.append(int(total * PRIME))
        term /= k + 1
    return out


LIMITS = _poisson_limits()
#: Limits that every draw is held against; those that reach the next one are few.
COMMON = 4


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """``x`` to a smaller number of the same remainder by PRIME, which is 2**31 - 1."""
    np.right_shift(x, 31, out=high)
    x &= PRIME
    x += high


def weight_matrix(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows by replicates.

    A pseudo-random integer in [0, PRIME) comes from modular multiplying and squaring, and the
    limits at or below it are counted. Replicate 0 is the sample itself: every row weighs 1.
    Worked out in blocks that stay in a core's cache. Numbers are folded only where the next step
    would not fit 64 bits; the last is less than twice PRIME, and its remainder is taken only of
    those few that reach the rarer limits.
    """
    ids = ids.astype(np.int64)
    a = np.mod(ids + (ids >> 31) * 40692, PRIME)
    b = replicates.astype(np.int64)
    start = np.mod(a * 48271, PRIME).astype(np.uint64)[:, None]
    first = np.mod(b * 69621 + seed % PRIME, PRIME).astype(np.uint64)
    third, a, b = (b * 39373).astype(np.uint64), a.astype(np.uint64)[:, None], b.astype(np.uint64)
    w = np.empty((ids.size, replicates.size))
    step = max(1, min(ids.size, CACHED // max(1, replicates.size)))
    # fresh memory for every step would cost more than the arithmetic
    spare = [np.empty((step, replicates.size), t) for t in ("u8", "u8", "u4", "u1", "?")]
    for at in range(0, ids.size, step):
        x, high, small, count, above = (s[:ids.size - at] for s in spare)
        x[:] = first
        x += start[at:at + step]
        x *= x
        x += a[at:at + step]
        _fold(x, high)
        x *= 16807
        x += third
        _fold(x, high)
        x *= x
        x += b
        _fold(x, high)
        x *= 48271
        x += 11
        _fold(x, high)
        small[:] = x
        count[:] = 0
        for limit in LIMITS[:COMMON]:
            count += np.greater_equal(small, limit, out=above)
        rare = np.flatnonzero(np.greater_equal(small, LIMITS[COMMON], out=above))
        count.flat[rare] = np.searchsorted(LIMITS, x.flat[rare].astype(np.int64) % PRIME, "right")
        w[at:at + step] = count
    w[:, replicates == 0] = 1.0
    return w


def interval(replicates: DataFrame, metric: str, by: list[str] = (), min_valid: int = 50,
             strict: bool = False, level: float = 0.95) -> DataFrame:
    """Percentile interval over the valid replicates of each group.

    Fewer than ``min_valid`` give NULL limits, or an error if ``strict``.
    """
    low, high, n = _limits(F.col(metric).cast("double"), min_valid, strict, level)
    return replicates.groupBy(*by).agg(
        low.alias("ci_low"), high.alias("ci_high"), n.alias("n_valid"))


def _limits(value: Column, min_valid: int = 50, strict: bool = False, level: float = 0.95
            ) -> tuple[Column, Column, Column]:
    tail, n = (1 - level) / 2, F.count(value)

    def limit(q: float) -> Column:
        few = (F.raise_error(F.lit("too few valid resamples")).cast("double") if strict
               else F.lit(None).cast("double"))
        return F.when(n < min_valid, few).otherwise(F.percentile(value, F.lit(q)))

    return limit(tail), limit(1 - tail), n


def estimates(replicates: DataFrame, metrics: dict[str, str], by: list[str] = (),
              counts: list[str] = ("n",)) -> DataFrame:
    """One row per group: each metric's value in the sample (replicate 0) and its interval.

    ``metrics`` maps result names to columns; ``counts`` are taken from the sample too.
    """
    def sample(column: str) -> Column:
        return F.max(F.when(F.col("b") == 0, F.col(column)))

    found = [sample(c).cast("bigint").alias(c) for c in counts]
    for name, column in metrics.items():
        low, high, _ = _limits(F.when(F.col("b") > 0, F.col(column)))
        found += [sample(column).alias(name), low.alias(f"{name}_ci_low"),
                  high.alias(f"{name}_ci_high")]
    return replicates.groupBy(*by).agg(*found)


# --- mergeable states ----------------------------------------------------------------

@dataclass(frozen=True)
class Metric:
    """A bootstrap metric as a mergeable state.

    ``update(columns, w)`` turns rows (a dict of arrays) and their weights (rows by
    replicates) into a state of ``size`` numbers per replicate (an array of that many rows);
    ``merge`` joins two states and must not care about order. ``finish(cells, states)`` gets
    all cells of a group, ascending (their key columns as arrays, their states stacked), and
    gives one array over replicates per output; not-a-number means no value.
    """

    columns: tuple[str, ...]
    size: int
    update: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]
    finish: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add
    outputs: tuple[str, ...] = ("value",)
    cells: tuple[str, ...] = ()
    #: ``update`` is the plain sum of the weights, ``merge`` their addition.
    sums: bool = False


def _area(cells: dict[str, np.ndarray], states: np.ndarray) -> dict[str, np.ndarray]:
    score, event = (cells[c] for c in ("_score", "_event"))
    levels, at = np.unique(score, return_inverse=True)
    p, q = np.zeros((2, levels.size, states.shape[2]))
    np.add.at(p, at, states[:, 0] * event[:, None])
    np.add.at(q, at, states[:, 0] * (1 - event[:, None]))
    positives, negatives = p.sum(axis=0), q.sum(axis=0)
    hits = positives - np.cumsum(p, axis=0) + p
    flagged = hits + negatives - np.cumsum(q, axis=0) + q
    with np.errstate(divide="ignore", invalid="ignore"):
        area = (p * (np.cumsum(q, axis=0) - q / 2)).sum(axis=0) / (positives * negatives)
        precision = np.where(flagged > 0, p * hits / flagged, 0.0).sum(axis=0) / positives
    both = (positives > 0) & (negatives > 0)
    return {"n": positives + negatives, "events": positives,
            "auroc": np.where(both, area, np.nan), "auprc": np.where(both, precision, np.nan)}


#: AUROC and AUPRC of a score with few levels: weight per (score, event) cell.
DISCRIMINATION = Metric((), 1, lambda columns, w: w.sum(axis=0)[None], _area,
                        outputs=("n", "events", "auroc", "auprc"),
                        cells=("_score", "_event"), sums=True)


def _moments(columns: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
    """Per replicate: weight, both means, and products about them.

    All sums are one matrix product of the values' distances from the rows' middle.
    """
    middle = [np.median(columns[c]) for c in ("_x", "_y")]
    u, v = columns["_x"] - middle[0], columns["_y"] - middle[1]
    n, su, sv, uu, uv, vv = np.stack([np.ones(u.size), u, v, u * u, u * v, v * v]) @ w
    safe = np.where(n > 0, n, 1.0)
    return np.stack([n, middle[0] + su / safe, middle[1] + sv / safe, uu - su * su / safe,
                     uv - su * sv / safe, vv - sv * sv / safe])


def _merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    safe = np.where(n > 0, n, 1.0)
    dx, dy, both = b[1] - a[1], b[2] - a[2], a[0] * b[0] / safe
    return np.stack([n, (a[0] * a[1] + b[0] * b[1]) / safe, (a[0] * a[2] + b[0] * b[2]) / safe,
                     a[3] + b[3] + both * dx * dx, a[4] + b[4] + both * dx * dy,
                     a[5] + b[5] + both * dy * dy])


def _correlation(cells: dict[str, np.ndarray], states: np.ndarray) -> dict[str, np.ndarray]:
    n, _, _, xx, xy, yy = states[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"n": n, "pearson": np.where(xx * yy > 0, xy / np.sqrt(xx * yy), np.nan)}


#: Pearson correlation from moments about the running means.
PEARSON = Metric(("_x", "_y"), 6, _moments, _correlation, _merge_moments,
                 ("n", "pearson"))


def _numbers(resamples: int, sample: bool) -> np.ndarray:
    return np.arange(0 if sample else 1, resamples + 1)


def _updates(metric: Metric, keys: list[str], numbers: np.ndarray, seed: int):
    """Rows to one state per group and task; open states are bounded, the rest goes out early."""

    def out(states: dict) -> pd.DataFrame:
        frame = pd.DataFrame(list(states), columns=keys) if keys else pd.DataFrame(index=range(1))
        frame["state"] = [s.tobytes() for s in states.values()]
        return frame

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, np.ndarray] = {}
        step = max(1, WEIGHTS // numbers.size)
        for whole in frames:
            for at in range(0, len(whole), step):
                pdf = whole.iloc[at:at + step]
                ids, place = np.unique(pdf["_id"].to_numpy(), return_inverse=True)
                w = weight_matrix(ids, numbers, seed)[place]
                columns = {c: pdf[c].to_numpy() for c in metric.columns}
                found = list(by_group(pdf, keys))
                added = (metric.update({c: v[rows] for c, v in columns.items()}, w[rows])
                         for _, rows in found)
                for (key, _), new in zip(found, added, strict=True):
                    states[key] = metric.merge(states[key], new) if key in states else new
                if len(states) * metric.size * numbers.size * 8 > STATE_BYTES:
                    yield out(states)
                    states = {}
        if states:
            yield out(states)

    return run


def _numbered(batch: pa.RecordBatch, keys: list[str], known: dict[tuple, int]) -> np.ndarray:
    """The number of every row's key; keys not yet ``known`` get the next ones."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        values = batch.column(c).dictionary_encode()
        code = code * len(values.dictionary) + values.indices.to_numpy(zero_copy_only=False)
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    rows = zip(*[batch.column(c).take(pa.array(first)).to_pylist() for c in keys], strict=True)
    own = [known.setdefault(key, len(known)) for key in rows] if keys else [known.setdefault((), 0)]
    return np.array(own, np.int64)[at]


def _sums(keys: list[str], cell: str | None, numbers: np.ndarray, seed: int):
    """Rows sorted by id to the summed weights of each key and task.

    Rows are held as the numbers of their ids and keys and then worked on by ``cell``, so that
    few keys meet in a piece: how often each key has each id, times the ids' weights.
    """
    most = max(1, WEIGHTS // numbers.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema, sums, slots = None, np.zeros((0, numbers.size)), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            """The open sums; their places are free again."""
            names, used = list(known), np.flatnonzero(slots >= 0)
            columns = [pa.array([names[k][i] for k in used], schema.field(c).type)
                       for i, c in enumerate(keys)]
            states = pa.array([sums[slots[k]].tobytes() for k in used], pa.binary())
            sums[:], slots[:] = 0.0, -1
            return pa.RecordBatch.from_arrays([*columns, states], names=[*keys, "state"])

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal sums, slots
            ids, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            slots = np.r_[slots, np.full(len(known) - slots.size, -1)]
            spot = np.zeros(ids.size, np.int64)
            if cell:
                at = keys.index(cell)
                spot = np.unique([k[at] for k in known], return_inverse=True)[1][code]
            order = np.lexsort((ids, spot))
            ids, code, spot = ids[order], code[order], spot[order]
            fresh = np.r_[True, (ids[1:] != ids[:-1]) | (spot[1:] != spot[:-1])]
            number, lo = np.cumsum(fresh), 0
            while lo < ids.size:
                hi = min(int(np.searchsorted(number, number[lo] + most)), lo + 16 * most)
                # up to where the cell ends, unless that is soon
                enough = int(np.searchsorted(number, number[lo] + most // 8))
                if enough < hi:
                    hi = min(hi, int(np.searchsorted(spot, spot[enough], "right")))
                first, place = np.unique(number[lo:hi], return_index=True)[1], number[lo:hi] - number[lo]
                w = weight_matrix(ids[lo:hi][first], numbers, seed)
                present, own = np.unique(code[lo:hi], return_inverse=True)
                new = present[slots[present] < 0]
                used = int(slots.max()) + 1
                slots[new] = np.arange(used, used + new.size)
                if used + new.size > len(sums):
                    wanted = max(used + new.size, 2 * len(sums)) - len(sums)
                    sums = np.concatenate([sums, np.zeros((wanted, numbers.size))])
                if present.size * len(w) <= 4 * WEIGHTS:
                    counts = np.bincount(own * len(w) + place, minlength=present.size * len(w))
                    sums[slots[present]] += counts.reshape(-1, len(w)).astype(np.float64) @ w
                else:
                    for at in range(0, hi - lo, most):
                        np.add.at(sums, slots[code[lo + at:lo + at + most]][:hi - lo - at],
                                  w[place[at:at + most]])
                if (used + new.size) * numbers.size * 8 > STATE_BYTES:
                    yield out()
                lo = hi

        for batch in batches:
            schema = batch.schema
            held.append((batch.column("_id").to_numpy(), _numbered(batch, keys, known)))
            if sum(ids.size for ids, _ in held) >= HELD:
                yield from work()
                if len(known) * numbers.size * 8 > STATE_BYTES:
                    yield out()
                    known.clear()
                    slots = slots[:0]
        if held:
            yield from work()
        if (slots >= 0).any():
            yield out()

    return run


def _finishes(metric: Metric, by: list[str], numbers: np.ndarray):
    """States sorted by group and cell to one row per group and replicate."""
    cells = list(metric.cells)

    def out(key: tuple, found: dict) -> pd.DataFrame:
        names = {c: np.array([k[i] for k in found]) for i, c in enumerate(cells)}
        values = metric.finish(names, np.stack(list(found.values())))
        frame = pd.DataFrame({"b": numbers.astype(np.int32)})
        for c, v in zip(by, key, strict=True):
            frame[c] = v
        for name in metric.outputs:
            frame[name] = values[name]
        return frame[[*by, "b", *metric.outputs]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found = None, {}
        for pdf in frames:
            groups = list(zip(*[pdf[c] for c in by], strict=True)) if by else [()] * len(pdf)
            parts = list(zip(*[pdf[c] for c in cells], strict=True)) if cells else [()] * len(pdf)
            for key, cell, raw in zip(groups, parts, pdf["state"], strict=True):
                if found and key != now:
                    yield out(now, found)
                    found = {}
                now, state = key, np.frombuffer(raw).reshape(metric.size, numbers.size)
                found[cell] = metric.merge(found[cell], state) if cell in found else state
        if found:
            yield out(now, found)

    return run


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def replicates(df: DataFrame, metric: Metric, row_id: str, resamples: int, seed: int,
               by: list[str] = (), sample: bool = False) -> DataFrame:
    """by, b and the metric's outputs: one row per group and replicate, NULL without a value.

    With ``sample`` the sample itself comes along as replicate 0. ``df`` must hold the metric's columns and cells. The narrow rows are dealt by id, so the
    thousandfold work does not hang on a few files and a row that belongs to many groups
    draws its weights once.
    """
    by, numbers = list(by), _numbers(resamples, sample)
    keys = [*by, *metric.cells]
    rows = df.select(F.col(row_id).cast("bigint").alias("_id"), *keys, *metric.columns).dropna()
    schema = key_schema(rows, keys)
    dealt = rows.repartition(_tasks(df), "_id").sortWithinPartitions("_id")
    if metric.sums:
        cell = metric.cells[0] if metric.cells else None
        states = dealt.mapInArrow(_sums(keys, cell, numbers, seed), f"{schema}state binary")
    else:
        states = dealt.mapInPandas(_updates(metric, keys, numbers, seed), f"{schema}state binary")
    met = states.repartition(*by) if by else states.repartition(1)
    found = (met.sortWithinPartitions(*keys) if keys else met).mapInPandas(
        _finishes(metric, by, numbers), f"{key_schema(rows, by)}b int, "
        + ", ".join(f"{c} double" for c in metric.outputs))
    # pandas has no NULL for doubles
    return found.select(*by, "b", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in metric.outputs])


def bootstrap(df: DataFrame, metric: Metric, row_id: str, resamples: int, seed: int,
              by: list[str] = ()) -> DataFrame:
    """Interval of any metric with a single output per group."""
    name, = metric.outputs
    return interval(replicates(df, metric, row_id, resamples, seed, by), name, list(by))


def discrimination_replicates(df: DataFrame, score: str, event: str, resamples: int, seed: int,
                              by: list[str] = (), row_id: str = "stay_id", sample: bool = False
                              ) -> DataFrame:
    """by, b, n, events, auroc, auprc; replicates lacking a class have NULL areas.

    For a score of few levels: a group's state is a vector per score value and class.
    """
    rows = df.withColumns({"_score": F.col(score).cast("double"), "_event": F.col(event).cast("int")})
    return replicates(rows, DISCRIMINATION, row_id, resamples, seed, by, sample)


def pearson_replicates(df: DataFrame, row_id: str, x: str, y: str, resamples: int, seed: int,
                       by: list[str] = (), sample: bool = False) -> DataFrame:
    rows = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    return replicates(rows, PEARSON, row_id, resamples, seed, by, sample)


# --- ranks ---------------------------------------------------------------------------

def summed_cells(pdf: pd.DataFrame, by: list[str], place: np.ndarray, w: np.ndarray
                 ) -> tuple[pd.DataFrame, np.ndarray]:
    """One row per value, level and group, ascending, and the weights summed over its rows.

    ``place`` gives the row of ``w`` that a row has its weights from. Rows of one value and
    level are added up for all their groups by one matrix product.
    """
    group = (pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by
             else np.zeros(len(pdf), int))
    spot = np.zeros(len(pdf), int)
    for c in ("_y", "_x"):
        values, at = np.unique(pdf[c].to_numpy(), return_inverse=True)
        spot = spot * values.size + at
    groups = int(group.max()) + 1
    cells, first, at, size = np.unique(spot * groups + group, return_index=True,
                                       return_inverse=True, return_counts=True)
    sums = w[place[first]]
    order = np.argsort(at, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(cells // groups)) + 1, cells.size]
    begins = np.r_[0, np.cumsum(size)]
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        rows = order[begins[lo]:begins[hi]]
        if rows.size > hi - lo:
            ids, own = np.unique(place[rows], return_inverse=True)
            counts = np.bincount((at[rows] - lo) * ids.size + own, minlength=(hi - lo) * ids.size)
            sums[lo:hi] = counts.reshape(hi - lo, ids.size).astype(np.float64) @ w[ids]
    return pdf.iloc[first], sums


def rank_replicates(df: DataFrame, row_id: str, x: str, y: str, resamples: int, seed: int,
                    by: list[str] = (), concordance: bool = False, sample: bool = False) -> DataFrame:
    """by, b, n, spearman (and c_index, high ``x`` with low ``y``): rank metrics of every replicate.

    ``x`` is a score with a bounded number of levels. The rows of all groups are ranged by
    outcome together, equal outcomes by row id, so a value that a third of the rows share is
    spread too; a row that belongs to many groups meets its weights once.
    """
    by, numbers = list(by), _numbers(resamples, sample)
    rows = df.dropna(subset=[*by, x, y]).select(
        *by, F.col(row_id).cast("bigint").alias("_id"), F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"))

    def weigh(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        ids, place = np.unique(pdf["_id"].to_numpy(), return_inverse=True)
        return summed_cells(pdf, by, place, weight_matrix(ids, numbers, seed))

    metrics = ["n", "spearman", "c_index"] if concordance else ["n", "spearman"]
    start = int(numbers[0])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = Levels.of(pdf)
        at = int(pdf["_block"].iloc[0]) * BLOCK + start
        out = pd.DataFrame({"b": np.arange(at, at + levels.n.size), "n": levels.n,
                            "spearman": levels.spearman()})
        if concordance:
            out["c_index"] = levels.c_index()
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "b", *metrics]]

    found = scan(rows, by, "_id", weigh, numbers.size, concordance, _tasks(df)).groupBy(
        *by, "_block").applyInPandas(
        finish, f"{key_schema(rows, by)}b int, " + ", ".join(f"{m} double" for m in metrics))
    return found.select(*by, "b", *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics])
