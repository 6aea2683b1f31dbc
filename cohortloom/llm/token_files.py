"""Token ids in patched frame-of-reference files.

A file is a row of segments; a segment is

    magic 'PFR1', part u32, sequence u32, documents u32, tokens u64, block size u32, blocks u32
    document ids i64 each, null flags u8 each, document lengths u32 each
    block minimum u32 each, bit width u8 each, exceptions u16 each, block start u64 each
    packed blocks, then exception places u16 and values u32

all little-endian and followed by a line feed. A block holds ``BLOCK`` ids minus their
minimum, packed at the width of its percentile value; larger values go to the exception list.
Block starts index the packed area, so any run of tokens can be read by itself. Segments are
written by Spark's own committed writers and read as whole binary files, so the files may
lie in any store that Spark reaches, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import prepare, strings, text_blocks
from .ordering import by_id_range

BLOCK = 256
PERCENTILE = 0.95
#: Text bytes of a segment; a longer text makes a longer segment.
SEGMENT_BYTES = 4 << 20
#: Text bytes of a task's id range; a larger range meets fewer words anew.
RANGE_BYTES = 24 << 20
#: Segments of a file.
SEGMENTS = 8
_HEAD = "<4sIIIQII"
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 2 << 20
#: Words a worker process remembers with their ids before it starts anew.
WORDS = 250_000
#: Lower-case letters that stand alone in any normal form, and marks that never join a letter.
LETTERS, MARKS = "[a-zß-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes, ``width`` bits each, high bit first."""
    out = []
    for lo in range(0, len(values), 1024):
        part = np.ascontiguousarray(values[lo:lo + 1024]).astype(">u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 4), axis=2)
        out.append(np.packbits(bits[:, :, 32 - width:].reshape(len(part), -1), axis=1))
    return np.concatenate(out)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    out = []
    for lo in range(0, len(packed), 1024):
        part = packed[lo:lo + 1024]
        bits = np.unpackbits(part, axis=1).reshape(len(part), -1, width)
        full = np.zeros((*bits.shape[:2], 32), np.uint8)
        full[:, :, 32 - width:] = bits
        out.append(np.packbits(full, axis=2).reshape(len(part), -1).view(">u4"))
    return np.concatenate(out).astype(np.uint32)


def write_segment(part: int, sequence: int, doc_ids: list, lengths: np.ndarray,
                  ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n_blocks = -(-ids.size // block)
    rows = np.zeros(n_blocks * block, np.uint32)
    rows[:ids.size] = ids
    if ids.size:
        rows[ids.size:] = ids[-1]
    rows = rows.reshape(n_blocks, block)
    least = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rows = rows - least[:, None]
    place = min(block - 1, int(percentile * block))
    width = _widths(np.partition(rows, place, axis=1)[:, place]) if n_blocks else \
        np.zeros(0, np.uint8)
    late = rows >> width[:, None].astype(np.uint32) != 0
    starts = np.concatenate([[0], np.cumsum(width.astype(np.uint64) * (block // 8))])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        bytes_each = int(w) * block // 8
        to = starts[mine].astype(np.int64)[:, None] + np.arange(bytes_each)
        packed[to] = _pack(rows[mine] & np.uint32((1 << int(w)) - 1), int(w))
    missing = [d is None for d in doc_ids]
    return b"".join([
        struct.pack(_HEAD, b"PFR1", part, sequence, len(doc_ids), ids.size, block, n_blocks),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array(missing, np.uint8).tobytes(), lengths.astype("<u4").tobytes(),
        least.astype("<u4").tobytes(), width.tobytes(),
        late.sum(axis=1).astype("<u2").tobytes(), starts[:-1].astype("<u8").tobytes(),
        packed.tobytes(), np.nonzero(late)[1].astype("<u2").tobytes(),
        rows[late].astype("<u4").tobytes()])


@dataclass
class Segment:
    """A parsed segment; ids are decoded on demand."""

    part: int
    sequence: int
    doc_ids: list
    lengths: np.ndarray
    tokens: int
    block: int
    least: np.ndarray
    width: np.ndarray
    late: np.ndarray
    starts: np.ndarray
    packed: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """The ids of blocks ``lo`` to ``hi`` - 1 (the last block is padded)."""
        out = np.zeros((hi - lo, self.block), np.uint32)
        for w in np.unique(self.width[lo:hi]):
            if w:
                mine = np.flatnonzero(self.width[lo:hi] == w)
                bytes_each = int(w) * self.block // 8
                at = self.starts[lo + mine].astype(np.int64)[:, None] + np.arange(bytes_each)
                out[mine] = _unpack(self.packed[at], int(w))
        ends = np.concatenate([[0], np.cumsum(self.late.astype(np.int64))])
        row = np.repeat(np.arange(hi - lo), self.late[lo:hi])
        own = slice(ends[lo], ends[hi])
        out[row, self.places[own]] = self.values[own]
        return out + self.least[lo:hi, None]

    def read(self, first: int, last: int) -> np.ndarray:
        """Tokens ``first`` to ``last`` - 1 of the segment."""
        lo, hi = first // self.block, -(-last // self.block)
        return self.blocks(lo, hi).ravel()[first - lo * self.block:last - lo * self.block]


def _head(data: bytes, at: int) -> tuple:
    magic, *fields = struct.unpack_from(_HEAD, data, at)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    return tuple(fields)


def segment_totals(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(part, sequence, tokens) of every segment; only heads, widths and counts are read."""
    at = 0
    while at < len(data):
        part, sequence, docs, tokens, block, blocks = _head(data, at)
        at += struct.calcsize(_HEAD) + docs * 13 + blocks * 4
        width = np.frombuffer(data, "u1", blocks, at)
        late = np.frombuffer(data, "<u2", blocks, at + blocks)
        at += blocks * 11 + int(width.astype(np.int64).sum()) * block // 8
        at += int(late.astype(np.int64).sum()) * 6 + 1
        yield part, sequence, tokens


def read_segments(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        part, sequence, docs, tokens, block, blocks = _head(data, at)
        at += struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, missing, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        least, width = take("<u4", blocks), take("u1", blocks)
        late, starts = take("<u2", blocks), take("<u8", blocks)
        packed = take("u1", int(width.astype(np.int64).sum()) * block // 8)
        exceptions = int(late.astype(np.int64).sum())
        places, values = take("<u2", exceptions), take("<u4", exceptions)
        at += 1
        yield Segment(part, sequence, [None if m else d for d, m in
                                       zip(ids.tolist(), missing.tolist(), strict=True)],
                      lengths, tokens, block, least, width, late, starts, packed, places, values)


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, each word encoded once.

    Valid for byte-pair tokenizers that never join what ASCII white space separates, fold
    A-Z, and mark the last piece of a word. A word is a run without ASCII white space; a last
    run of marks after plain letters is a word of its own. Words of plain letters are encoded
    as one text, which is much faster, and told apart by the mark; all others one by one.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        spec = json.loads(model)
        suffix = spec["model"]["end_of_word_suffix"]
        # plain letters are in normal form already, and a space is all that parts them
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            *[p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]]}
        self.plain_tokenizer = Tokenizer.from_str(json.dumps(spec))
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of plain letters."""
        parts = [self.plain_tokenizer.encode_batch_fast(
            [" ".join(words[lo:lo + 1000])], add_special_tokens=False)[0].ids
            for lo in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(x, np.uint32) for x in parts])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._others(words)
        return ids, np.diff(ends, prepend=0)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for lo in range(0, len(words), 1000) for f in
                 self.tokenizer.encode_batch_fast(words[lo:lo + 1000], add_special_tokens=False)]
        return (np.array([i for f in found for i in f], np.uint32),
                np.array([len(f) for f in found], np.int64))

    def _codes(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words; new ones are encoded."""
        get, known = self.words.get, len(self.words)
        codes = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(codes < 0)
        if at.size:
            new = [words[i] for i in at.tolist()]
            codes[at] = np.arange(known, known + at.size)
            self.words.update(zip(new, range(known, known + at.size), strict=True))
            plain = pc.match_substring_regex(pa.array(new), f"^{LETTERS}+$").to_numpy(False)
            order, ids, counts = [], [], []
            for encode, mine in ((self._plain, plain), (self._others, ~plain)):
                if mine.any():
                    order.append(np.flatnonzero(mine))
                    got = encode([new[i] for i in order[-1].tolist()])
                    ids.append(got[0])
                    counts.append(got[1])
            order, counts = np.argsort(np.concatenate(order)), np.concatenate(counts)
            starts = (np.cumsum(counts) - counts)[order]
            self.ids = np.concatenate([
                self.ids, _gather(np.concatenate(ids), starts, counts[order])])
            self.starts = np.concatenate([
                self.starts, self.starts[-1] + np.cumsum(counts[order])])
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of ids of each."""
        if len(self.words) > WORDS:
            self._forget()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # special tokens are the only words with case
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = flat.dictionary_encode()
        words = coded.dictionary
        split = pc.extract_regex(words, f"^(?P<head>{LETTERS}+)(?P<tail>{MARKS}*)$")
        heads = pc.coalesce(pc.struct_field(split, 0), words).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(split, 1), "").dictionary_encode()
        pairs = np.stack([self._codes(strings(x.dictionary))[x.indices.to_numpy()]
                          for x in (heads, tails)], axis=1)
        sizes = np.diff(self.starts)
        # ids of the distinct words of this block, then of all words
        word_sizes = sizes[pairs].sum(axis=1)
        word_ids = _gather(self.ids, self.starts[pairs].ravel(), sizes[pairs].ravel())
        word_starts = np.cumsum(word_sizes) - word_sizes
        index = coded.indices.to_numpy()
        ids = _gather(word_ids, word_starts[index], word_sizes[index])
        ends = np.concatenate([[0], np.cumsum(word_sizes[index])])
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def worker_encoder(model: bytes) -> WordEncoder:
    """The worker process's encoder of a model; it outlives the task with the words it knows.

    A function that travels by value gets new globals in every task, so the encoder is kept
    in a module of its own. A process holds the last model only.
    """
    held = sys.modules.setdefault("token_file_encoders", types.ModuleType("token_file_encoders"))
    key = zlib.crc32(model), len(model)
    if getattr(held, "key", None) != key:
        held.encoder, held.key = WordEncoder(model), key
    return held.encoder


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` at ``starts`` of ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    if not ends.size:
        return values[:0]
    shift = np.repeat(starts - (ends - sizes), sizes)
    return values[np.arange(ends[-1]) + shift]


def _segments(model: bytes, end_id: int, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = worker_encoder(model), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, sequence
            payload = write_segment(held[0][0], sequence, [d for h in held for d in h[1]],
                                    np.concatenate([h[2] for h in held]),
                                    np.concatenate([h[3] for h in held]))
            held, size, sequence = [], 0, sequence + 1
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], ["payload"])

        for whole in batches:
            for batch in text_blocks(whole, "text", ENCODE_BYTES):
                ids, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(out.size, bool)
                keep[ends - 1] = False
                out[keep] = ids
                held.append((batch.column("part")[0].as_py(), batch.column("doc_id").to_pylist(),
                             counts + 1, out))
                size += batch.column("text").nbytes
                if size >= segment_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, model: bytes, path: str, end_id: int = 2,
                      segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode every text (null: empty), append ``end_id``, write files in ascending id order."""
    ordered = by_id_range(docs, closing=False, range_bytes=RANGE_BYTES)
    payload = ordered.select("part", "doc_id", "text").mapInArrow(
        _segments(model, end_id, segment_bytes), "payload binary")
    # the text writer puts a value's bytes down as they are, here those of a segment
    (payload.select(F.col("payload").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", SEGMENTS).text(path))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for s in read_segments(content.as_buffer()):
                ids = s.read(0, s.tokens).astype("<u4")
                ends = np.cumsum(s.lengths.astype(np.int64))
                starts = ends - s.lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in
                        zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.part] * n, pa.int32()), pa.array([s.sequence] * n, pa.int32()),
                     pa.array(s.doc_ids, pa.int64()), pa.array(starts),
                     pa.array(s.lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    ["part", "sequence", "doc_id", "start", "n_tokens", "ids_crc32"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = list(segment_totals(content.as_buffer()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in
                 zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)],
                ["part", "sequence", "tokens"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files read as ``content``.

    ``start`` counts the ids before the document in the whole data set. Segment totals, one
    row per segment, are the only thing that is summed in order.
    """
    totals = files.mapInArrow(_totals, "part int, sequence int, tokens long")
    order = Window.orderBy("part", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "sequence",
                            F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("offset"))
    rows = files.mapInArrow(_documents, "part int, sequence int, doc_id long, start long, "
                                        "n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "sequence"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, model: bytes, end_id: int = 2) -> DataFrame:
    """Write every text's ids, read the files back, one row per row of ``docs``.

    Null text is empty and has the end id alone; null ids come first; equal ids are in text
    order, repeated rows one after the other. A very long text makes a long segment. An empty
    table writes no segment and gives an empty result; further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, model, path, end_id)
    files = spark.read.format("binaryFile").load(path).select("content")
    return read_token_files(files)
