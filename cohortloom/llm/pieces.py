"""SentencePiece BPE on flat numpy arrays: vectorised merge rounds and decoding.

All distinct word segments of a block of texts are merged together. Symbols stand in one
flat array; each round looks up the rank of every neighbouring pair, takes the least rank of
each segment, merges its leftmost non-overlapping occurrences at once, and compacts; segments
without a pair leave. That equals merging one pair at a time, best score first and leftmost
first, unless a merge makes a pair that would have come before the rest of its round; such a
segment merges only its first occurrence in that round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, prepare, strings, text_blocks

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Segments a task remembers with their ids before it starts anew.
SEGMENTS = 300_000
_MARK = "▁"


class Pieces:
    """Vocabulary arrays of a SentencePiece BPE model with byte fallback.

    Built for models that only turn spaces into the mark U+2581 and put one mark before a
    text, and whose pieces hold marks at their start only; others are refused.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        texts = [p.piece for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type == 1]
        plain = (trainer.model_type == 2 and trainer.byte_fallback and spec.add_dummy_prefix
                 and spec.escape_whitespaces and not spec.remove_extra_whitespaces
                 and not spec.precompiled_charsmap and not trainer.treat_whitespace_as_suffix)
        known = {texts[i]: i for i in normal}
        chars = {c for t in known for c in t}
        if not plain or any(_MARK in t.lstrip(_MARK) for t in known) or chars - set(known) \
                or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("a SentencePiece model of another kind")
        scores = {i: proto.pieces[i].score for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.size = len(texts)
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [t.replace(_MARK, " ").encode() for t in texts]
        self.is_byte = np.zeros(self.size, bool)
        self.marked = [p.type == 1 and p.piece.startswith(_MARK) for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.bytes[i], self.is_byte[i] = i, bytes([value]), True
            elif p.type == 2:
                self.bytes[i] = trainer.unk_surface.encode()
            elif p.type == 3:
                self.bytes[i] = b""
        self.char_ids = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.char_ids[ord(c)] = known[c]
        # spaces cannot join beyond this run; equal scores make runs fill up from the left
        runs = [i for i in normal if not texts[i].strip(_MARK)]
        self.run = max((len(texts[i]) for i in runs), default=1)
        if len({scores[i] for i in runs if len(texts[i]) > 1}) > 1:
            self.run = 1 << 30
        triples = [(known[t[:k]], known[t[k:]], ranks[scores[i]], i)
                   for t, i in known.items() for k in range(1, len(t))
                   if t[:k] in known and t[k:] in known]
        self._table(np.array(triples, np.int64))
        #: Characters inside no longer piece end a segment on either side.
        joined = {c for t in known if len(t) > 1 for c in t}
        self.splits_line = "\n" not in joined

    def _table(self, triples: np.ndarray) -> None:
        """Open-addressing hash table from (left, right) to (rank, merged piece)."""
        self.shift = np.uint64(64 - max(4, int(len(triples) * 4).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys = np.full(slots, -1, np.int64)
        self.ranks = np.full(slots, _NONE, np.int32)
        self.merged = np.zeros(slots, np.int32)
        keys = triples[:, 0] * self.size + triples[:, 1]
        place, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = self.keys[place[left]] == -1
            _, first = np.unique(place[left], return_index=True)
            chosen = np.zeros(left.size, bool)
            chosen[first] = True
            chosen &= free
            done = left[chosen]
            self.keys[place[done]] = keys[done]
            self.ranks[place[done]], self.merged[place[done]] = triples[done, 2], triples[done, 3]
            left = left[~chosen]
            place[left] = (place[left] + (self.keys[place[left]] != -1)) % slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; rank ``_NONE`` where the two do not merge."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        place = self._slot(keys)
        found = self.keys[place]
        again = np.flatnonzero((found != keys) & (found != -1))
        while again.size:
            place[again] = (place[again] + 1) % self.keys.size
            seen = self.keys[place[again]]
            again = again[(seen != keys[again]) & (seen != -1)]
        hit = self.keys[place] == keys
        return np.where(hit, self.ranks[place], _NONE), self.merged[place]

    # merging ---------------------------------------------------------------------------

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all segments (marks as spaces) end to end, and how many each has."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        points = np.where(points == 32, ord(_MARK), points)
        symbols = self.char_ids[points]
        # characters outside the vocabulary: -2 - code point, never merged
        symbols = np.where(symbols < 0, -2 - points.astype(np.int64), symbols)
        sizes = np.array([len(s) for s in segments], np.int64)
        owner = np.arange(len(segments))
        done_owner, done_symbols = [], []
        while symbols.size:
            ranks = self._ranks(symbols, sizes)
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            over = least == _NONE
            if over.any():
                out = np.repeat(over, sizes)
                done_owner.append(np.repeat(owner[over], sizes[over]))
                done_symbols.append(symbols[out])
                symbols, ranks = symbols[~out], ranks[~out]
                owner, sizes, least = owner[~over], sizes[~over], least[~over]
                if not symbols.size:
                    break
            symbols, sizes = self._round(symbols, sizes, ranks, least)
        owners = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        found = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return self._fall_back(found[order], np.bincount(owners, minlength=len(segments)))

    def _ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next of its segment."""
        ranks = np.full(symbols.size, _NONE, np.int32)
        ranks[:-1] = self.pairs(symbols[:-1], symbols[1:])[0]
        ranks[np.cumsum(sizes) - 1] = _NONE
        return ranks

    def _round(self, symbols: np.ndarray, sizes: np.ndarray, ranks: np.ndarray,
               least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment = np.repeat(np.arange(sizes.size), sizes)
        at = np.flatnonzero(ranks == least[segment])
        # leftmost non-overlapping: every other one of a chain of touching occurrences
        chain = np.concatenate([[True], np.diff(at) != 1])
        offset = np.arange(at.size) - np.flatnonzero(chain)[np.cumsum(chain) - 1]
        at = at[offset % 2 == 0]
        new, new_sizes, early = self._merge(symbols, sizes, segment, at, least)
        if early.any():
            first = np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])
            at = at[first | ~early[segment[at]]]
            new, new_sizes, _ = self._merge(symbols, sizes, segment, at, least)
        return new, new_sizes

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, segment: np.ndarray,
               at: np.ndarray, least: np.ndarray):
        """Merge the pairs at ``at``; tells the segments whose order that may upset."""
        merged = self.pairs(symbols[at], symbols[at + 1])[1].astype(np.int64)
        new = symbols.copy()
        new[at] = merged
        keep = np.ones(symbols.size, bool)
        keep[at + 1] = False
        owner = segment[at]
        several = np.zeros(sizes.size, bool)
        several[owner[1:][owner[1:] == owner[:-1]]] = True
        early = np.zeros(sizes.size, bool)
        new_sizes = sizes - np.bincount(owner, minlength=sizes.size)
        new = new[keep]
        if several.any():
            # after the round, and between two merges that touch
            ranks = self._ranks(new, new_sizes)
            low = np.minimum.reduceat(ranks, np.cumsum(new_sizes) - new_sizes)
            early |= several & (low <= least)
            touch = np.flatnonzero(np.diff(at) == 2)
            between = self.pairs(merged[touch], symbols[at[touch] + 2])[0]
            early[owner[touch][between <= least[owner[touch]]]] = True
        return new, new_sizes, early

    def _fall_back(self, symbols: np.ndarray, sizes: np.ndarray):
        """Characters outside the vocabulary become the pieces of their UTF-8 bytes."""
        lost = np.flatnonzero(symbols < 0)
        if not lost.size:
            return symbols.astype(np.int32), sizes
        texts = [chr(-2 - int(s)).encode() for s in symbols[lost]]
        counts = np.ones(symbols.size, np.int64)
        counts[lost] = [len(t) for t in texts]
        out = np.repeat(symbols, counts).astype(np.int64)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return out.astype(np.int32), np.diff(ends[bounds])

    # decoding --------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one leading space goes, stray bytes become U+FFFD."""
        out, run, first = [], b"", True
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run, first = run + self.bytes[i], False
                continue
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as e:
                    out.append(run[:e.start].decode() + "�")
                    run = run[e.start + 1:]
            if i >= 0:
                text = self.bytes[i].decode()
                out.append(text[1:] if first and self.marked[i] else text)
                first = first and not text
        return "".join(out)


class TextEncoder:
    """Encodes blocks of texts, merging each distinct segment of a task once."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.names = [f"{i},".encode() for i in range(self.pieces.size)]
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.ids, self.texts = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def _learn(self, segments: list[str]) -> None:
        ids, counts = self.pieces.encode_segments(segments)
        for attribute, table in (("ids", self.names), ("texts", self.pieces.bytes)):
            sizes = np.array([len(t) for t in table], np.int64)
            flat = pa.array(table, pa.large_binary()).take(pa.array(ids))
            data, _ = flat_text(flat)
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
            made = pa.Array.from_buffers(pa.large_binary(), len(counts), [
                None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
            setattr(self, attribute, pa.concat_arrays([getattr(self, attribute), made]))
        self.counts = np.concatenate([self.counts, counts])

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All segments of the texts, each text with its leading mark, and offsets per text."""
        texts = texts.fill_null("").cast(pa.large_string())
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        texts = pc.binary_join_element_wise(
            lead.cast(pa.large_string()), pc.replace_substring(texts, _MARK, " "),
            pa.scalar("", pa.large_string()))
        data, offsets = flat_text(texts)
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        inner = offsets[:-1][offsets[:-1] < data.size]
        # a run of spaces is cut where no piece can reach
        runs = np.flatnonzero(space)
        if runs.size:
            edge = np.zeros(data.size, bool)
            edge[inner] = True
            new = np.concatenate([[True], (np.diff(runs) != 1) | edge[runs[1:]]])
            place = np.arange(runs.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
            cut[runs[place % self.pieces.run == 0]] = True
        if self.pieces.splits_line:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        if data.size:
            cut[inner] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, data.size).astype(np.int64)
        segments = pa.Array.from_buffers(pa.large_string(), len(starts), [
            None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return segments, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """For each text: number of ids, the ids as 'id,id,..,' and the decoded bytes.

        The decoded bytes still have the leading space.
        """
        if len(self.codes) > SEGMENTS:
            self._forget()
        segments, bounds = self._segments(texts)
        coded = segments.dictionary_encode()
        words = strings(coded.dictionary)
        fresh = [w for w in words if w not in self.codes]
        if fresh:
            known = len(self.codes)
            self.codes.update(zip(fresh, range(known, known + len(fresh)), strict=True))
            self._learn(fresh)
        own = np.array([self.codes[w] for w in words], np.int64)
        codes = own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        counts = np.concatenate([[0], np.cumsum(self.counts[codes])])[bounds]
        views = []
        for table in (self.ids, self.texts):
            data, ends = flat_text(table.take(pa.array(codes)))
            views.append((memoryview(data), ends[bounds].tolist()))
        (ids, id_ends), (out, out_ends) = views
        for i, n in enumerate(np.diff(counts).tolist()):
            yield n, ids[id_ends[i]:id_ends[i + 1]], out[out_ends[i]:out_ends[i + 1]]


def _encoded(model: bytes, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(model)
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                counts, id_sums, text_sums, lists, texts = [], [], [], [], []
                for n, ids, text in encoder.encode(batch.column("text")):
                    counts.append(n)
                    text = bytes(text[1:])
                    if full:
                        lists.append([int(i) for i in bytes(ids[:-1]).split(b",")] if n else [])
                        texts.append(text.decode())
                    id_sums.append(hashlib.sha256(ids[:-1]).hexdigest())
                    text_sums.append(hashlib.sha256(text).hexdigest())
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                           pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, model: bytes, full: bool = False) -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``full`` adds the ids and the decoded text. Null text is empty and has no ids. Rows stay
    in place (no shuffle); repeated rows give repeated rows, null ids stay null, an empty
    table gives an empty result, further columns are ignored. Very long texts are encoded
    whole; of merges of equal rank the leftmost goes first.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        _encoded(model, full), schema + (", ids array<int>, decoded string" if full else ""))
