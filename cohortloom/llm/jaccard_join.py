"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text is the set of its distinct word shingles, each a 64-bit hash. All sets are put in one
global order, rare shingles first. If two sets of sizes r and s overlap enough, each holds
the first ``l`` shingles they share among its first r - ceil(t r) + l, its l-prefix, whatever
``l`` is. Every set therefore picks its own ``l``: a longer prefix means more index entries,
but a partner must then share at least the smaller of both picks before it is verified. The
pick is the cheapest by the counts of the prefix shingles, and a set that shares too few of
them for any pick has no partner at all.

Equal sets are one node from the start. Candidates meet in places: a shingle's place is the
smallest set that has it in its prefix, so near copies with hundreds of common shingles still
meet only a few times, and each pair is verified in one of its places. Whole shingle lists
are made for sets with a possible partner only. A place gives a spanning forest of its links
and each set's number of links, never its pairs; a large place is compared in pairs of parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, strings, text_blocks
from .components import components

SHINGLE = 3
#: Jaccard similarity from which two documents link, in hundredths.
PERCENT = 90
#: Slots (log 2) of the table of shingle counts that settles the global order. Results never
#: depend on it; with fewer slots than shingles, common ones still come last.
SLOTS_LOG2 = 22
#: Slots that are merged together.
CHUNK_LOG2 = 16
#: Sets, and shingles, of a part of a place; larger places are compared in pairs of parts.
MEMBERS, VOLUME = 4000, 4_000_000
#: Sets with a possible partner up to which their keys are broadcast (32 bytes each).
BROADCAST_SETS = 250_000
#: Cost of one shingle of a verified candidate in units of an index entry that is met.
VERIFY = 0.25
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
            0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTORS[3])
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text (no nulls), A-Z lower-cased.

    Words are runs without ASCII white space. A text with fewer words than a shingle has one
    shingle, its whole word sequence; without words it has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words = strings(coded.dictionary)
    hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in words] or [0], np.uint64)
    index = coded.indices.to_numpy().astype(np.int64)
    if "" in words:  # white space at either end of a text leaves an empty piece
        solid = index != words.index("")
        offsets = np.concatenate([[0], np.cumsum(solid)])[offsets]
        index = index[solid]
    row = hashes[index]
    factor = np.array([_FACTORS[j % 3] * (2 * j + 1) % 2**64 for j in range(shingle)], np.uint64)
    full = np.zeros(max(0, row.size - shingle + 1), np.uint64)
    for j in range(shingle):
        full += row[j:j + full.size] * factor[j]
    full = _mix(full)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            yield np.unique(full[lo:hi - shingle + 1])
        elif hi > lo:
            few = (row[lo:hi] * factor[:hi - lo]).sum(keepdims=True)
            yield _mix(few ^ np.uint64(_FACTORS[4] * (hi - lo) % 2**64))
        else:
            yield np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def longest_match(n: int, percent: int) -> int:
    """Most shared prefix shingles that a set of n may ask for."""
    return max(1, min(least_overlap(n, percent), 1 + n // 12))


def _counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOTS_LOG2, np.uint32)
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                sets = list(shingle_sets(batch.column("text"), shingle))
                slots = np.concatenate(sets) >> np.uint64(64 - SLOTS_LOG2)
                counts += np.bincount(slots.astype(np.int64), minlength=counts.size
                                      ).astype(np.uint32)
        chunks = counts.reshape(-1, 1 << CHUNK_LOG2)
        used = np.flatnonzero(chunks.any(axis=1))
        for chunk in used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([chunks[chunk].tobytes()], pa.binary())],
                ["chunk", "counts"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts"),
                              strict=True):
            part = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    for chunk, total in sums.items():
        level = np.minimum(255, 4 * np.log2(total.astype(float) + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())],
            ["chunk", "levels"])


def count_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Logarithmic level of the number of documents per slot of shingles, over all documents.

    Every task adds its documents up first, so the exchange and the result (one byte a slot)
    are bounded by the number of tasks and slots.
    """
    levels = np.zeros(1 << SLOTS_LOG2, np.uint8)
    found = (docs.select("text").mapInArrow(_counts(shingle), "chunk int, counts binary")
             .repartition("chunk").mapInArrow(_merged, "chunk int, levels binary").collect())
    for row in found:
        at = row.chunk << CHUNK_LOG2
        levels[at:at + (1 << CHUNK_LOG2)] = np.frombuffer(row.levels, np.uint8)
    return levels


def _prefixes(levels: np.ndarray, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                sizes, keys, prefixes = [], [], []
                for tokens in shingle_sets(batch.column("text"), shingle):
                    n = tokens.size
                    sizes.append(n)
                    keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                                if n else None)
                    level = levels[(tokens >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)]
                    length = n - least_overlap(n, percent) + longest_match(n, percent)
                    order = np.argsort(level, kind="stable")[:length]
                    prefixes.append(tokens[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "set_key", "prefix"])

    return run


def _structs(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of structs."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    names = [f.name for f in flat.type]
    return offsets - offsets[0], {n: c.to_numpy() for n, c in zip(names, flat.flatten(), strict=True)}


def pick(n: int, places: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, int] | None:
    """(matches to ask for, shared prefix shingles) of a set, or None if it has no partner.

    ``places`` are the prefix positions of shingles that other sets' prefixes have too, with
    the number of sets that have each. The cost of a pick is the index entries that its prefix
    meets, and the shingles of the candidates that these entries can make at most.
    """
    most = longest_match(least_overlap(n, percent), percent)  # what the smallest partner offers
    spare = n - least_overlap(n, percent)
    met = np.concatenate([[0], np.cumsum(counts - 1)])
    best, ask = None, 1
    while True:
        shared = int(np.searchsorted(places, spare + ask))
        if shared < ask:
            return None
        cost = met[shared] * (1 + VERIFY * n / ask)
        if best is None or cost < best[0]:
            best = (cost, ask, shared)
        if ask == most:
            return best[1], best[2]
        ask = min(2 * ask, most)


def _picks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, at = _structs(batch.column("at"))
            rows, asks, tokens = [], [], []
            for i, n in enumerate(batch.column("n").to_pylist()):
                own = slice(offsets[i], offsets[i + 1])
                found = pick(n, at["pos"][own], at["d"][own], percent)
                if found:
                    rows.append(i)
                    asks.append(found[0])
                    tokens.append(at["token"][own][:found[1]])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid").take(rows), batch.column("n").take(rows),
                 pa.array(asks, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                ["sid", "n", "ask", "tokens"])

    return run


def _all_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sid"), pa.array(sets, pa.list_(pa.int64()))],
                    ["sid", "shingles"])

    return run


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` at ``starts`` of ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    if not ends.size:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


class Place:
    """The sets that meet in one place, compared by their prefixes and then verified."""

    def __init__(self, rows: list[dict]):
        self.sid, self.n, self.ask, self.copies, self.part = (
            np.array([r[c] for r in rows], np.int64) for c in ("sid", "n", "ask", "copies", "part"))
        sizes = np.array([len(r["tokens"]) for r in rows])
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        names, self.token = np.unique(np.concatenate([r["tokens"] for r in rows]),
                                      return_inverse=True)
        self.leader = np.concatenate([r["leaders"] for r in rows])
        self.holders = np.repeat(np.arange(len(rows)), sizes)[np.argsort(self.token, kind="stable")]
        self.held = np.bincount(self.token, minlength=names.size)
        self.held_at = np.cumsum(self.held) - self.held
        names, self.shingle = np.unique(np.concatenate([r["shingles"] for r in rows]),
                                        return_inverse=True)
        self.mark = np.zeros(names.size, bool)
        self.starts = np.cumsum(self.n) - self.n

    def partners(self, i: int, place: int, percent: int, across: bool) -> np.ndarray:
        """Later members linked with member i whose pair is this place's to verify."""
        own = np.arange(self.bounds[i], self.bounds[i + 1])
        own = own[np.argsort(-self.leader[own], kind="stable")]
        token = self.token[own]
        met = _runs(self.holders, self.held_at[token], self.held[token])
        shared = np.bincount(met, minlength=self.n.size)
        least = np.full(self.n.size, np.iinfo(np.int64).max)
        least[met] = np.repeat(self.leader[own], self.held[token])  # the last, least one stays
        wanted = (shared >= np.minimum(self.ask, self.ask[i])) & (least == place)
        wanted &= (100 * self.n >= percent * self.n[i]) & (100 * self.n[i] >= percent * self.n)
        if across:
            wanted &= self.part != self.part[i]
        wanted[:i + 1] = False
        found = np.flatnonzero(wanted)
        if not found.size:
            return found
        mine = slice(self.starts[i], self.starts[i] + self.n[i])
        self.mark[self.shingle[mine]] = True
        sizes = self.n[found]
        hits = self.mark[_runs(self.shingle, self.starts[found], sizes)]
        common = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[self.shingle[mine]] = False
        return found[100 * common >= percent * (sizes + self.n[i] - common)]

    def links(self, place: int, percent: int, across: bool) -> tuple[list, np.ndarray]:
        """Spanning forest (pairs of sids) and the linked copies of each member."""
        label, degree, forest = np.arange(self.n.size), np.zeros(self.n.size, np.int64), []
        for i in range(self.n.size):
            found = self.partners(i, place, percent, across)
            if not found.size:
                continue
            degree[i] += self.copies[found].sum()
            degree[found] += self.copies[i]
            groups, first = np.unique(label[found], return_index=True)
            new = groups != label[i]
            forest += [(self.sid[i], self.sid[j]) for j in found[first[new]].tolist()]
            label[np.isin(label, groups[new])] = label[i]
        return forest, degree


_MEETING = ("place", "lo", "hi", "part", "sid", "n", "ask", "copies", "tokens", "leaders",
            "shingles")


def _meet(percent: int):
    """Rows sorted by (place, lo, hi) to links (a, b, null) and link counts (a, null, links)."""

    def out(key: tuple, rows: list[dict]) -> pa.RecordBatch:
        forest, degree = Place(rows).links(key[0], percent, key[1] != key[2])
        linked = np.flatnonzero(degree)
        a = [x for x, _ in forest] + [rows[i]["sid"] for i in linked]
        b = [y for _, y in forest] + [None] * linked.size
        counts = [None] * len(forest) + degree[linked].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.int64())],
            ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in _MEETING[:8]}
            lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy())
                     for c in _MEETING[8:]}
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in plain.items()}
                row |= {c: v[o[i]:o[i + 1]] for c, (o, v) in lists.items()}
                now = (row["place"], row["lo"], row["hi"])
                if now != key:
                    if len(rows) > 1:
                        yield out(key, rows)
                    key, rows = now, []
                rows.append(row)
        if len(rows) > 1:
            yield out(key, rows)

    return run


def _with_partners(sets: DataFrame, percent: int) -> DataFrame:
    """Stored (sid, n, ask, tokens, leaders) of the sets that may have a partner."""
    tokens = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("d")).filter("d > 1")
    at = F.sort_array(F.collect_list(F.struct("pos", "d", "token"))).alias("at")
    picked = stored(
        tokens.join(common, "token").groupBy("sid").agg(F.first("n").alias("n"), at)
        .mapInArrow(_picks(percent), "sid long, n long, ask long, tokens array<long>"))
    entries = picked.select("sid", "n", "ask", F.posexplode("tokens").alias("pos", "token"))
    leaders = entries.groupBy("token").agg(
        F.min("sid").alias("leader"), F.count("*").alias("d")).filter("d > 1").drop("d")
    held = F.sort_array(F.collect_list(F.struct("pos", "token", "leader")))
    return stored(
        entries.join(leaders, "token").groupBy("sid")
        .agg(F.first("n").alias("n"), F.first("ask").alias("ask"), held.alias("held"))
        .select("sid", "n", "ask", F.col("held.token").alias("tokens"),
                F.col("held.leader").alias("leaders")))


def _meetings(members: DataFrame, limit: int, volume: int) -> DataFrame:
    """(place, lo, hi, part, sid): every set at each of its places, large places in parts."""
    at = members.select("sid", "n", F.explode(F.array_distinct("leaders")).alias("place"))
    sizes = at.groupBy("place").agg(F.count("*").alias("m"), F.sum("n").alias("v")).select(
        "place", F.greatest(F.ceil(F.col("m") / F.lit(limit)), F.ceil(F.col("v") / F.lit(volume)))
        .cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("sid", F.lit("part")), F.col("parts")).cast("int")
    dealt = at.join(sizes, "place").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("place", F.least("part", "other").alias("lo"),
                        F.greatest("part", "other").alias("hi"), "part", "sid")


def jaccard_links(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                  limit: int = MEMBERS, volume: int = VOLUME) -> DataFrame:
    """Stored rows (a, b, null) of a spanning forest of links and (a, null, links) of link counts.

    ``sets`` has sid, n, copies, text_key and prefix, one row per distinct set; ``texts`` has
    text_key and text, from which the sets with a possible partner get all their shingles.
    """
    members = _with_partners(sets, percent)
    keys = members.join(sets.select("sid", "copies", "text_key"), "sid")
    wanted = keys.select("sid", "text_key")
    if members.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    whole = (texts.join(wanted, "text_key").groupBy("sid").agg(F.first("text").alias("text"))
             .mapInArrow(_all_shingles(shingle), "sid long, shingles array<long>"))
    full = keys.drop("text_key").join(whole, "sid")
    order = ["place", "lo", "hi"]
    return stored(
        _meetings(members, limit, volume).join(full, "sid").select(*_MEETING)
        .repartition(*order).sortWithinPartitions(*order, "sid")
        .mapInArrow(_meet(percent), "a long, b long, links long"))


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                   limit: int = MEMBERS, volume: int = VOLUME) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Two rows link when the Jaccard similarity of their shingle sets is ``percent`` hundredths
    or more. ``component_id`` is the smallest doc_id reachable over links, itself included,
    ``n_links`` the number of other rows that a row links with. Rows without words (null, empty
    or blank text) have no shingle and link with nothing, not even with each other; their
    component is their own doc_id. A text shorter than a shingle is one shingle. Very long
    texts are read whole. Repeated rows and equal texts link with one another. Null ids are
    never a component id unless a component has no other (then it is null). An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.select("*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"))
    rows = stored(texts.mapInArrow(
        _prefixes(count_levels(texts, shingle), shingle, percent),
        "doc_id long, text_key binary, n long, set_key binary, prefix array<long>"))
    sets = stored(rows.filter("n > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"),
        F.first("text_key").alias("text_key"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix")).withColumn("sid", F.monotonically_increasing_id()))
    found = jaccard_links(sets, texts.select("text_key", "text"), shingle, percent, limit, volume)
    roots = components(found.filter("b is not null").select("a", "b"))
    degrees = found.filter("b is null").groupBy(F.col("a").alias("sid")).agg(
        F.sum("links").alias("links"))
    linked = (sets.select("sid", "first").join(
        roots.select(F.col("node").alias("sid"), "root"), "sid").join(degrees, "sid"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("sid", "least", "links")
    named = sets.select("set_key", "sid", "first", "copies").join(linked, "sid", "left").select(
        "set_key", F.coalesce("least", "first").alias("least"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return rows.select("doc_id", "n", "set_key").join(named, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
