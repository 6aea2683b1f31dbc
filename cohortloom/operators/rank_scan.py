"""Ranks within levels by one scan over rows that are ranged by value.

The rows of all groups are dealt into ranges of the value, one exchange. A task streams its
range in order and keeps running totals, so its states hold ranks counted from the range's
start; what lies before a range is added where the states of a group meet, one state per level
and range. A value that may go on in the neighbouring range is handed on by itself, as totals
only, so equal values may be split over ranges, and no task holds more than a piece of its
rows. Every row carries a vector of weights (a count, or one weight per bootstrap replicate),
and all sums are vectors of the same length.

Levels (a score's values, group labels) must be few: a state holds a vector for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import histogram

#: Rows of a range that are worked on together, those compared in pairs, and vector entries
#: that are finished together.
RANGE_ROWS, PIECE, BLOCK = 4096, 64, 50
#: Vectors of a part: weight and rank sum of a level; and, on any level, what is summed over all
#: of them: pairs with a higher level below, squared weights of ties within a level, squares and
#: cubes of the weights of ties over all levels. Only concordance asks for the three in the middle.
SUMS = ("w", "first", "pairs", "same_both", "same_y", "cube_y")
#: Rows and their weights; rows of one group, level and value come as one.
Weigh = Callable[[pd.DataFrame], tuple[pd.DataFrame, np.ndarray]]


@dataclass
class _Group:
    """Running state of one group in a range: totals so far and sums from the range's start."""

    width: int
    low: float | None = None
    levels: dict = field(default_factory=dict)

    def level(self, x) -> np.ndarray:
        if x not in self.levels:
            self.levels[x] = np.zeros((len(SUMS), self.width))
        return self.levels[x]

    def above(self, x) -> np.ndarray:
        """Weight so far in the levels above one."""
        return sum((v[0] for z, v in self.levels.items() if z > x), np.zeros(self.width))

    def add(self, x: np.ndarray, tie: np.ndarray, y: np.ndarray, w: np.ndarray,
            concordance: bool) -> None:
        """Rows of whole tied values (``tie`` numbers them), ascending, after all rows so far.

        A level has one row per tied value.
        """
        if self.low is None:
            self.low = float(y[0])
        ends = np.flatnonzero(np.r_[tie[1:] != tie[:-1], True])
        at = np.cumsum(np.r_[False, tie[1:] != tie[:-1]])
        rank, tied = np.cumsum(w, axis=0), w
        if ends.size < tie.size:
            rank = rank[ends]
            tied = np.diff(rank, axis=0, prepend=0)
        square = tied * tied
        # in place: fresh memory costs more than the sums
        rank -= tied / 2
        rank += sum((v[0] for v in self.levels.values()), np.full(self.width, 0.5))
        ranked = rank[at] if ends.size < tie.size else rank
        ranked *= w
        names, place = np.unique(x, return_inverse=True)
        # sums per level as matrix products: a row per level, a column per row of the range
        member = (np.arange(names.size)[:, None] == place).astype(float)
        total, first = member @ w, member @ ranked
        shared = self.level(names[0])
        if concordance:
            above = np.stack([self.above(name) for name in names])
            shared[2] += _pairs(place, at, ends, w, member, above)
            shared[3] += np.einsum("ij,ij->j", w, w)
            shared[4] += square.sum(axis=0)
        shared[5] += np.einsum("ij,ij->j", square, tied)
        for i, name in enumerate(names):
            self.level(name)[:2] += (total[i], first[i])

    def add_totals(self, x: np.ndarray, w: np.ndarray) -> None:
        for name in np.unique(x):
            self.level(name)[0] += w[x == name].sum(axis=0)


def _pairs(place: np.ndarray, at: np.ndarray, ends: np.ndarray, w: np.ndarray,
           member: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Weight of the pairs whose higher level has the lower value.

    Pieces of whole tied values are compared row by row, and by level with all before them:
    ``above`` is the weight before the first piece in the levels above each.
    """
    out, lo = np.zeros(w.shape[1]), 0
    while lo < place.size:
        # the last tied value that ends within the piece, or the first if it is longer
        stop = max(np.searchsorted(ends, lo + PIECE), at[lo] + 1)
        hi = int(ends[stop - 1]) + 1
        level, tie, mine = place[lo:hi], at[lo:hi], w[lo:hi]
        lower = (tie[:, None] > tie) & (level[:, None] < level)
        out += (mine * (lower.astype(float) @ mine)).sum(axis=0)
        own = member[:, lo:hi] @ mine
        out += (own * above).sum(axis=0)
        above += np.cumsum(own[::-1], axis=0)[::-1] - own
        lo = hi
    return out


def by_group(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers) of every group of a frame."""
    if not keys:
        yield (), np.arange(len(pdf))
        return
    for key, rows in pdf.groupby(keys, sort=False, dropna=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), rows


def _as_rows(key: tuple, group: _Group, y: float, tied: bool) -> list[tuple]:
    return [(*key, at // BLOCK, y, tied, x.item() if hasattr(x, "item") else x,
             sums[:, at:at + BLOCK].tobytes())
            for x, sums in group.levels.items() for at in range(0, group.width, BLOCK)]


def _ranges(by: list[str], weigh: Weigh, width: int, concordance: bool):
    """Rows of one range, sorted by value, to the parts of each group.

    A group's first and last tied value go out as parts of their own, since they may go on
    in the neighbouring ranges; the last one is held as totals while rows still come in.
    """
    names = [*by, "_block", "_place", "_tied", "_x", "state"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner: dict[tuple, _Group] = {}
        open_ties: dict[tuple, tuple[float, _Group, bool]] = {}

        def close(key: tuple) -> list[tuple]:
            """A tied value has ended: a part of its own if it was the first, else an inner one."""
            y, totals, was_first = open_ties.pop(key)
            if was_first:
                return _as_rows(key, totals, y, True)
            group = inner.setdefault(key, _Group(width))
            xs = np.array(sorted(totals.levels))
            w = np.stack([totals.levels[x][0] for x in xs])
            group.add(xs, np.zeros(xs.size, int), np.full(xs.size, y), w, concordance)
            return []

        for whole in frames:
            for lo in range(0, len(whole), RANGE_ROWS):
                pdf, weights = weigh(whole.iloc[lo:lo + RANGE_ROWS])
                xs, ys = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
                out: list[tuple] = []
                for key, rows in by_group(pdf, by):
                    rows = np.sort(rows)  # ascending by value, as they came
                    x, y, w = xs[rows], ys[rows], weights[rows]
                    values, tie = np.unique(y, return_inverse=True)
                    ends = np.searchsorted(tie, np.arange(values.size), "right")
                    begin, done = 0, 0
                    fresh = key not in open_ties and key not in inner
                    if key in open_ties and open_ties[key][0] == values[0]:
                        begin, done = ends[0], 1
                        open_ties[key][1].add_totals(x[:begin], w[:begin])
                    if done == values.size:
                        continue
                    if key in open_ties:
                        out += close(key)
                    if fresh and values.size > 1:
                        totals = _Group(width)
                        totals.add_totals(x[:ends[0]], w[:ends[0]])
                        out += _as_rows(key, totals, float(values[0]), True)
                        begin, done = ends[0], 1
                    last = ends[-2] if values.size > 1 else 0
                    if last > begin:
                        group = inner.setdefault(key, _Group(width))
                        group.add(x[begin:last], tie[begin:last], y[begin:last], w[begin:last],
                                  concordance)
                    totals = _Group(width)
                    totals.add_totals(x[last:], w[last:])
                    open_ties[key] = float(values[-1]), totals, fresh and values.size == 1
                if out:
                    yield pd.DataFrame(out, columns=names)
        out = []
        for key, (y, totals, _) in open_ties.items():
            out += _as_rows(key, totals, y, True)
        for key, group in inner.items():
            out += _as_rows(key, group, group.low, False)
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def scan(rows: DataFrame, by: list[str], split: str, weigh: Weigh, width: int,
         concordance: bool = False, tasks: int | None = None) -> DataFrame:
    """The parts of all groups of ``rows`` (by, _x, _y and what ``weigh`` reads).

    Rows are ranged by ``_y`` and, where it is equal, by ``split``; in a range, rows of equal
    ``_y`` and ``_x`` stand together. Without a number of ``tasks`` the rows' size decides, which
    says little where every row has many weights.
    """
    keys = key_schema(rows, [*by, "_x"])
    order = dict.fromkeys(["_y", "_x", split])
    columns = ["_y", split]
    ranged = rows.repartitionByRange(tasks, *columns) if tasks else rows.repartitionByRange(*columns)
    return (ranged.sortWithinPartitions(*order)
            .mapInPandas(_ranges(by, weigh, width, concordance),
                         f"{keys}_block bigint, _place double, _tied boolean, state binary"))


def key_schema(rows: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return "".join(f"`{k}` {types[k]}, " for k in keys)


@dataclass
class Levels:
    """All parts of a group: per level (ascending) its weight and centred rank sums, and totals."""

    names: np.ndarray
    size: np.ndarray
    d_sum: np.ndarray
    n: np.ndarray
    tied_y: np.ndarray
    cube_y: np.ndarray
    tied_both: np.ndarray
    ordered: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Levels:
        names, x = np.unique(pdf["_x"].to_numpy(), return_inverse=True)
        # parts in order of value; equal tied values are one part
        keys = list(zip(pdf["_place"], ~pdf["_tied"].astype(bool), strict=True))
        parts = sorted(set(keys))
        number = {k: i for i, k in enumerate(parts)}
        part = np.array([number[k] for k in keys])
        vectors = np.stack([np.frombuffer(s).reshape(len(SUMS), -1) for s in pdf["state"]])
        sums = np.zeros((len(SUMS), len(parts), names.size, vectors.shape[2]))
        for k in range(len(SUMS)):
            np.add.at(sums[k], (part, x), vectors[:, k])
        w, first, pairs, same_both, same_y, cube_y = sums
        whole = w.sum(axis=1)
        tied = np.array([not inner for _, inner in parts])[:, None, None]
        middle = (whole[:, None] + 1) / 2  # every row of a tied value has its mean rank
        first = np.where(tied, w * middle, first)
        n = whole.sum(axis=0)
        shift = (np.cumsum(whole, axis=0) - whole - (n + 1) / 2)[:, None]
        below = np.cumsum(w, axis=0) - w  # per part and level: weight in earlier parts
        higher = below.sum(axis=1, keepdims=True) - np.cumsum(below, axis=1)
        return cls(
            names, w.sum(axis=0), (first + w * shift).sum(axis=0), n,
            np.where(tied[:, 0], whole**2, same_y.sum(axis=1)).sum(axis=0),
            np.where(tied[:, 0], whole**3, cube_y.sum(axis=1)).sum(axis=0),
            np.where(tied, w * w, same_both).sum(axis=(0, 1)),
            pairs.sum(axis=(0, 1)) + (w * higher).sum(axis=(0, 1)))

    def spread(self) -> np.ndarray:
        """Square sum of the centred ranks, by the weights of the ties alone."""
        return (self.n**3 - self.cube_y) / 12

    def spearman(self) -> np.ndarray:
        rank = np.cumsum(self.size, axis=0) - (self.size - 1) / 2 - (self.n + 1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (self.size * rank * rank).sum(axis=0) * self.spread()
            return np.where(spread > 0, (rank * self.d_sum).sum(axis=0) / np.sqrt(spread), np.nan)

    def permissible(self) -> np.ndarray:
        return (self.n * self.n - self.tied_y) / 2

    def c_index(self) -> np.ndarray:
        """Share of the pairs of unequal value whose higher level lies lower, ties one half."""
        ties = ((self.size * self.size).sum(axis=0) - self.tied_both) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.permissible() > 0,
                            (self.ordered + ties / 2) / self.permissible(), np.nan)


def _counts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    return pdf, pdf["_n"].to_numpy(np.float64)[:, None]


def _finished(df: DataFrame, level: str, value: str, by: list[str], weight: str | None,
              concordance: bool, finish: Callable[[Levels], dict], schema: str) -> DataFrame:
    """``finish`` of every group's levels; the rows are first counted per (group, level, value)."""
    by = list(by)
    rows = histogram(df, [*by, level, value], weight).select(
        *by, F.col(level).alias("_x"), F.col(value).cast("double").alias("_y"),
        F.col("n").alias("_n"))
    parts = scan(rows, by, "_x", _counts, 1, concordance)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(finish(Levels.of(pdf)))
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    keys = key_schema(rows, by)
    names = [part.split()[0] for part in schema.split(", ")]
    found = parts.groupBy(*by).applyInPandas(
        lambda pdf: run(pdf)[[*by, *names]], keys + schema.replace("_x type", f"_x {dict(rows.dtypes)['_x']}"))
    return found


def level_sums(df: DataFrame, level: str, value: str, by: list[str] = (),
               weight: str | None = None) -> DataFrame:
    """Per (by, level): n and centred rank sum; on the first level the tie term and the square
    sum of all centred ranks."""
    def finish(levels: Levels) -> dict:
        first = np.arange(levels.names.size) == 0
        return {"_x": levels.names, "n": levels.size[:, 0].astype(np.int64),
                "d_sum": levels.d_sum[:, 0],
                "d_square": np.where(first, levels.spread()[0], 0.0),
                "tie_term": np.where(first, levels.cube_y[0] - levels.n[0], 0.0)}

    return _finished(df, level, value, by, weight, False, finish,
                     "_x type, n bigint, d_sum double, d_square double, tie_term double"
                     ).withColumnRenamed("_x", level)


def concordance(df: DataFrame, score: str, outcome: str, by: list[str] = (),
                weight: str | None = None) -> DataFrame:
    """Per group: n, permissible pairs, c_index (NULL without any)."""
    def finish(levels: Levels) -> dict:
        return {"n": levels.n.astype(np.int64), "permissible": levels.permissible(),
                "c_index": levels.c_index()}

    found = _finished(df, score, outcome, by, weight, True, finish,
                      "n bigint, permissible double, c_index double")
    return found.withColumn("c_index", F.when(~F.isnan("c_index"), F.col("c_index")))
