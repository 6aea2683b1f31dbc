"""Operators with an exact answer against brute force and the original libraries."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

import corpus_pipeline
from cohortloom.llm import (components, exact_dedup, licenses, mixing, pieces, registry, simhash,
                            sketches, stages, token_files, url_filter)
from cohortloom.llm.common import read_table

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ODD = "ab the re on\n\t .,!?'-_=▁éüñ日😀\x0001279xyzTHE{}();\r\xa0İΣ\u0301\u2028\x1c"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a ", " a", "x  y", "▁", "a▁b", " " * 40 + "w", "a" + " " * 33,
             "thor.,! thor.", "it's IT'S a.'s", "<|startoftext|> a", "A<|endoftext|>B",
             "<|ENDOFTEXT|>", "abababababab", "=" * 70, "日本語テスト", "\x00", "e\u0301 ́b"]
    return fixed + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def corpus(spark):
    return [(r.doc_id, r.text or "") for r in
            read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


# union-find over all pairs ---------------------------------------------------------------

def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@needs_data
def test_simhash_matches_all_pairs(spark):
    docs = corpus(spark)
    found = simhash.simhash_groups(read_table(spark, FOLDER, "documents")).collect()
    prints = {d: brute_print(t) for d, t in docs}
    roots = brute_components(set(prints.values()), 4)
    least = defaultdict(lambda: 1 << 60)
    for d, p in prints.items():
        least[roots[p]] = min(least[roots[p]], d)
    for r in found:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == least[roots[prints[r.doc_id]]]


@pytest.mark.parametrize("members", [3, 100_000])
def test_links_reach_everything_near(spark, members):
    """Dense groups too, whether a key is compared at once or in pairs of parts."""
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))
            prints.add(centre ^ flips)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    links = simhash.links(rows, 4, members).collect()
    assert all((r.a % 2**64 ^ r.b % 2**64).bit_count() <= 4 for r in links)
    found = {r.node % 2**64: r.root % 2**64 for r in
             components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[found.get(p, p)].add(p)
    for p, r in brute_components(prints, 4).items():
        wanted[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("whole", [False, True])
def test_near_keeps_one_row_per_component(spark, whole, monkeypatch, tmp_path):
    """Several null ids, and repeated ids of different texts, are components of their own."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    spaced = [t.replace(" ", "  ") for t in texts]
    rows = [(None, texts[0]), (None, texts[1]), (None, spaced[1]), (None, None), (None, " "),
            (7, texts[2]), (7, texts[3]), (7, spaced[3]), (9, texts[4]), (None, spaced[4]),
            (5, texts[5]), (5, texts[6]), (6, spaced[6]), (4, spaced[6] + " "), (8, texts[7]),
            (2, ""), (7, "x"), (7, "y")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    if whole:
        monkeypatch.setattr(corpus_pipeline, "STAGES", [
            ("exact dedup", stages.exact), ("SimHash near-dedup", stages.near)])
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    else:
        found = stages.near(spark, docs, "").collect()
    prints = {t or "": brute_print(t or "") for _, t in rows}
    roots, heads = brute_components(set(prints.values()), 4), {}
    for d, t in rows:
        row = (d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "")
        root = roots[prints[t or ""]]
        heads[root] = min(heads.get(root, row), row)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found) == sorted(
        (none, d, t) for none, d, _, t in heads.values())


def test_forest_is_small():
    members = np.unique(np.random.default_rng(1).integers(0, 2**14, 3000).astype(np.uint64))
    child, parent = simhash.forest(members, 4)
    assert len(child) == len(members) - 1
    assert (np.bitwise_count(child ^ parent) <= 4).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    found = {r.node: r.root for r in
             components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    none = components.components(spark.createDataFrame([], "a long, b long"))
    assert none.collect() == []


# chunk recipes ---------------------------------------------------------------------------

@needs_data
@pytest.mark.parametrize("digest_bits", [2, 64])
def test_digest_collisions_never_merge_texts(spark, digest_bits):
    how = exact_dedup.Chunking(bits=6, digest_bits=digest_bits)
    found = exact_dedup.exact_groups(read_table(spark, FOLDER, "documents"), how).collect()
    groups = defaultdict(list)
    for d, t in corpus(spark):
        groups[t].append(d)
    wanted = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest())
              for t, g in groups.items() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == wanted


def test_chunks_cover_the_text_and_follow_content():
    rng = np.random.default_rng(3)
    how = exact_dedup.Chunking(bits=6, most=500)
    one = rng.integers(0, 256, 20_000).astype(np.uint8)
    both = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), one, one])
    bounds = exact_dedup.chunk_bounds(both, np.array([0, 777, 20_777, 40_777]), how)
    assert [b[-1] for b in bounds] == [777, 20_777, 40_777]
    assert [e - 777 for e in bounds[1]] == [e - 20_777 for e in bounds[2]]
    sizes = np.diff([777, *bounds[1]])
    assert sizes.max() <= 500 and sizes[:-1].min() >= how.least
    shifted = exact_dedup.chunk_bounds(one[5000:], np.array([0, 15_000]), how)[0]
    assert len({e + 5000 for e in shifted} & {e - 777 for e in bounds[1]}) > len(shifted) * 0.8


# bottom-k sketches -----------------------------------------------------------------------

@needs_data
def test_edited_texts_match_brute_force(spark):
    docs = sorted(corpus(spark))
    found = {r.doc_id: r for r in
             sketches.edited_fingerprints(read_table(spark, FOLDER, "documents")).collect()}

    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", text)
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    errors = []
    for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = (text[:len(text) - half] + after[:half]).encode()
        row = found[d]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        own, new, follow = shingles(text.encode()), shingles(edited), shingles(after.encode())
        for got, a, b in ((row.near_edited, own, new), (row.near_next, own, follow)):
            assert abs(got - alike(a, b)) < 0.2
            if len(a | b) <= sketches.K:
                assert got == pytest.approx(alike(a, b))
            errors.append(abs(got - alike(a, b)))
        assert row.n_shingles == pytest.approx(len(own), rel=0.4)
    assert np.mean(errors) < 0.02
    prints = defaultdict(set)
    for d, text in docs:
        prints[text].add(found[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_id_ranges_meet_at_their_borders(spark):
    """Many ranges give what one range gives."""
    rng = random.Random(2)
    rows = [(i * 7, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (200, 1 << 30):
        parts = sketches.by_id_range(docs, True, size).mapInArrow(
            sketches._edited_rows(sketches.K, 5), sketches._RESULT).collect()
        got = {r.doc_id: r.edited_sha256 for r in parts}
        assert len(parts) == 300
        for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            assert got[d] == hashlib.sha256(edited.encode()).hexdigest()


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in (0, 1))
    both = np.concatenate([a, b[:1000]])
    assert (sketches.merge(sketches.bottom(a), sketches.bottom(b)) ==
            sketches.bottom(np.concatenate([a, b]))).all()
    one, two = sketches.bottom(a), sketches.bottom(both)
    assert sketches.resemblance(one, two) == pytest.approx(5 / 6, abs=0.12)
    assert sketches.containment(one, two) == pytest.approx(1, abs=0.15)
    assert sketches.distinct_count(two) == pytest.approx(6000, rel=0.3)
    assert (sketches.decode(sketches.encode(one)) == one).all()
    parts = spark.createDataFrame(
        [(1, [1, 5, 9]), (1, [2, 5]), (2, []), (None, [7])], "k int, sketch array<long>")
    merged = {r.k: r.sketch for r in sketches.merge_sketches(parts.filter("k > 0"), "k", k=3).collect()}
    assert merged == {1: [1, 2, 5], 2: []}


# tokens ----------------------------------------------------------------------------------

def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    model = registry.vocabulary(registry.WORD_MODEL)
    library = Tokenizer.from_str(model.decode())
    texts = odd_texts(400)
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in token_files.token_files(docs.repartition(5), model).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        row = found[3 * i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_segments_round_trip():
    rng = random.Random(4)
    for _ in range(60):
        n, top = rng.choice([0, 1, 255, 256, 257, 3000]), rng.choice([1, 2, 50, 49408, 2**32 - 1])
        ids = np.array([rng.randrange(top) if rng.random() < .9 else rng.randrange(2**32)
                        for _ in range(n)], np.uint32)
        data = token_files.write_segment(3, 7, [None, 5], np.array([n, 0]), ids) + b"\n"
        segments = list(token_files.read_segments(data + data))
        assert [s.doc_ids for s in segments] == [[None, 5]] * 2
        assert (segments[1].read(0, n) == ids).all()
        lo = n // 3
        assert (segments[0].read(lo, n) == ids[lo:]).all()
    with pytest.raises(ValueError):
        list(token_files.read_segments(b"x" * 100))


def test_pieces_match_the_library():
    import sentencepiece

    model = registry.vocabulary(registry.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = pieces.TextEncoder(model)
    texts = odd_texts(1500, 7)
    for text, (n, ids, out) in zip(texts, list(encoder.encode(pa.array(texts))), strict=True):
        wanted = library.encode(text)
        assert n == len(wanted)
        assert [int(i) for i in bytes(ids[:-1]).split(b",")] == wanted if n else not len(ids)
        assert bytes(out[1:]).decode() == library.decode(wanted)
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(32_000) if rng.random() < .5 else rng.randrange(259)
               for _ in range(rng.randint(0, 10))]
        assert encoder.pieces.decode(ids) == library.decode(ids)


def test_merge_order_is_the_sequential_one():
    """Long segments without spaces, where many pairs merge in one round."""
    import sentencepiece

    model = registry.vocabulary(registry.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder, rng = pieces.TextEncoder(model), random.Random(9)
    texts = ["".join(rng.choice(c) for _ in range(rng.randint(200, 900))) for c in
             ["ab", "abc", "ation", "-=", "01", "theinger", ".\r", "();\r"] for _ in range(12)]
    for text, (_, ids, _) in zip(texts, list(encoder.encode(pa.array(texts))), strict=True):
        assert [int(i) for i in bytes(ids[:-1]).split(b",")] == library.encode(text)


# licences --------------------------------------------------------------------------------

def test_licences_in_other_dress(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    full = licenses._MIT
    rows = [(1, full), (2, "Copyright (c) 2020 Somebody\n\n" + full.upper()),
            (3, full.replace(" ", "  ").replace(",", ";")), (4, full + " And more."),
            (5, "text\nLICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!\nmore\n\tReleased under the MIT Licence"),
            (6, "It was released under the MIT License."), (7, mit), (8, "© 2001 X")]
    found = {r.doc_id: r for r in licenses.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].text_license for i in range(1, 9)] == ["MIT", "MIT", "MIT", None, None, None,
                                                            "MIT", None]
    assert (found[5].line_licenses, found[5].n_license_lines) == ("CC-BY-NC-4.0,MIT", 2)
    assert found[6].line_licenses is None


def plain_canonical(text):
    """The canonical form by the ``regex`` library."""
    text = regex.sub("(?m)" + licenses.STATEMENT, r"\1\2", text.lower())
    text = regex.sub(licenses.NOT_WORD, " ", text).strip(" ")
    for other, one in licenses.EQUIVALENT:
        text = text.replace(other, one)
    return text


def plain_scan(text):
    """(licence of the text, licences of its lines, number of such lines) without prefilter."""
    known = {}
    for name, whole in licenses.KNOWN:
        key = plain_canonical(whole)
        known[key] = min(name, known.get(key, name))
    lines = [known[c] for c in map(plain_canonical, (text or "").split("\n")) if c in known]
    return known.get(plain_canonical(text or "")), ",".join(sorted(set(lines))) or None, len(lines)


def scans(spark, texts):
    found = licenses.scan_licenses(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in found}


def test_licences_survive_any_wrapping(spark):
    """A line that begins with 'copyright' is dropped only if it states one; every id has a text."""
    rows, wanted = [], []
    for name, text in licenses.KNOWN:
        for width in (9, 20, 33, 48, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 76, 100):
            paragraphs = [textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False)
                          for p in text.split("\n\n")]
            for head in ("", "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n",
                         "Copyright Some Body <a@b.org>\n\n", "(c) 2020 X. "):
                rows.append(head + "\n\n".join(paragraphs))
                wanted.append(name)
    found = scans(spark, rows)
    lost = [rows[i] for i, name in enumerate(wanted)
            if found[i][0] != name and "(c) 2020 X. " not in rows[i]]
    assert lost == []
    assert {n for n, t in licenses.KNOWN if len(t) > 70} == {n for n, _ in licenses.KNOWN}


STATEMENTS = [
    ("Copyright infringers will be sued\nReleased under the MIT License.", None),
    ("Copyright The Regents of the University of California in Berkeley and others\n"
     "Released under the MIT License.", None),
    ("Copyright The Regents of the University of California in Berkeley and others, 1983-1990\n"
     "Released under the MIT License.", "MIT"),
    ("(c) You must retain this.\nReleased under the MIT License.", None),
    ("(c) 2020 X. Licensed under the MIT License.", "MIT"),
    ("© Somebody\r\nAll Rights Reserved.\r\nReleased under the MIT Licence.\r\n", "MIT"),
    ("Copyright (C) A. All rights reserved; Licensed under the MIT License.", "MIT"),
    ("All rights reserved. Released under the MIT License.", "MIT"),
    ("All rights reserved by nobody\nReleased under the MIT License.", None),
    ("the above\ncopyright notice and this permission notice", None),
    ("Copyright <a@b.org>, and\n * copyright [yyyy] someone\nLICENCED under CC BY 4.0", "CC-BY-4.0"),
    ("Copyright holders\nMIT License\n\n" + licenses._MIT, None),
    ("ISC\n(c) 2020 X. Licensed under the MIT License.", None), ("", None), ("\n\n", None)]


def test_copyright_statements(spark):
    found = scans(spark, [t for t, _ in STATEMENTS])
    for i, (text, name) in enumerate(STATEMENTS):
        assert found[i][0] == name == plain_scan(text)[0], text


def test_licence_query_and_twin_state_one_rule(spark, tmp_path):
    """Query, SQL twin and a plain program agree on texts made of statements and notices."""
    import duckdb

    rng = random.Random(8)
    pieces = [t for t, _ in STATEMENTS[:12]] + [
        "Copyright", "copyright 1999", "(c)", "©", "all rights reserved", "Sub License", "licence",
        "Released under the MIT License.", "\x0b", "Permission 2020.", "This Work", "\u2028", "é\u0301",
        "Licensed under the BSD 2-Clause Licence", "a@b", "SPDX-License-Identifier: ISC", "İ", "ﬁ"]
    texts = [t for t, _ in STATEMENTS] + [
        "".join(rng.choice(pieces) + rng.choice(["\n", " ", "\n\n", ". ", ", "])
                for _ in range(rng.randint(1, 6))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scans(spark, texts)
    assert found == {i: plain_scan(t) for i, t in enumerate(texts)}
    frame.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rows = con.execute(licenses.oracle())
    names = [c[0] for c in rows.description]
    twin = {r["doc_id"]: (r["text_license"], r["line_licenses"], r["n_license_lines"])
            for r in (dict(zip(names, r, strict=True)) for r in rows.fetchall())}
    assert twin == found


def test_needles_are_in_every_spelling():
    words = licenses.needles([plain_canonical(t) for _, t in licenses.KNOWN])
    assert "" not in words and {"licensed", "licenced"} <= set(words)
    for _, text in licenses.KNOWN:
        for spelling in (text, text.replace("icense", "icence")):
            assert any(w in spelling.lower() for w in words)
    assert licenses.needles(["copyright holder", "a b"]) == [""]


# mixing ----------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        left = [s for s in names if s not in full]
        share = sum(weight[s] for s in left)
        target = {s: repeats * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in left if target[s] > repeats * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = [None, "A", "a", "é", "z", "😀", "b1", "b10", "b2"][:rng.randint(1, 9)]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 8])), s) for i in range(600)
            for s in [rng.choices(names, [rng.choice([1, 5, 60]) for _ in names])[0]]]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    again = sorted(map(str, found.collect()))
    found = found.collect()
    assert sorted(map(str, found)) == again
    source = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size and len(r.positions) == r.copies
    wanted = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(wanted[source[r.doc_id]])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 4
    places = [r.position for r in found if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1


def test_demand_inverts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(101).select((F.col("id") / 100).alias("share"))
    for kind, knots in enumerate(mixing.SCHEDULES):
        found = [r[0] for r in rows.select(
            mixing.invert_demand(F.col("share"), F.lit(kind))).collect()]
        times = np.linspace(0, 1, 200_001)
        weight = np.interp(times, *zip(*knots, strict=True))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert np.allclose(np.interp(np.arange(101) / 100 * demand[-1], demand, times), found, atol=1e-4)


# URLs ------------------------------------------------------------------------------------

def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, verdict in url_filter.RULES:
        fits = (host == h or host.endswith("." + h)) and path.startswith(p)
        if fits and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


@needs_data
def test_rules_and_models(spark):
    pages = read_table(spark, FOLDER, "pages").select("page_id", "url")
    odd = ["HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://a.example.com/en/b?x",
           "http://a.com", "http://com/", "http://xcom/", "https://b.net/es/#f", "http://net/fr/",
           "http://É.net/ES/", "ftp://h://x/y", "http:///p", "x", None, "http://a.com?b/c"]
    rows = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(odd)], pages.schema)
    pages = pages.union(rows)
    urls = {r.page_id: r.url for r in pages.collect()}
    found = url_filter.judge_urls(pages).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        wanted = best[1] if best else ("allow" if r.llr >= r.threshold else "block")
        assert r.verdict == wanted


def test_url_scores_are_exact_with_many_contexts(spark):
    """More keys than a hashed table of 2**18 counters holds apart; plain counts are the truth."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_"

    def url(host):
        return f"http://{host}/" + "".join(rng.choice(letters) for _ in range(60))

    urls = [url(f"a{i % 5}.com") for i in range(600)] + [
        f"http://b.net/es/{url('x')[9:]}" for _ in range(600)] + [url("c.org") for _ in range(20)]
    urls += urls[:40] + ["", None]
    found = url_filter.judge_urls(spark.createDataFrame(
        list(enumerate(urls)), "page_id long, url string")).collect()
    held = {r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").filter(
        "pmod(xxhash64(url, 'calibrate'), 5) = 0").collect()}
    plain, width = [defaultdict(int), defaultdict(int)], url_filter.ORDER

    def pad(text):
        return bytes([2] * width) + text.encode() + bytes([3])

    for text in urls:
        best = brute_rule(text)[2]
        if best and text not in held:
            data, table = pad(text), plain[best[1] == "allow"]
            for i in range(width, len(data)):
                for order in range(width + 1):
                    table[data[i - order:i], order] += 1
                    table[data[i - order:i], data[i], order] += 1
    assert sum(map(len, plain)) > 1 << 18
    for r in found:
        if urls[r.page_id] is None:
            assert r.llr == 0
            continue
        data, total = pad(urls[r.page_id]), 0.0
        for i in range(width, len(data)):
            p = [1 / url_filter.ALPHABET] * 2
            for order in range(width + 1):
                p = [(t[data[i - order:i], data[i], order] + url_filter.PRIOR * q)
                     / (t[data[i - order:i], order] + url_filter.PRIOR)
                     for t, q in zip(plain, p, strict=True)]
            total += np.log(p[1]) - np.log(p[0])
        assert r.llr == pytest.approx(total / (len(data) - width), abs=1e-9)


def test_set_of_repeated_digests_grows_with_them():
    assert [exact_dedup.bitmap_bits(n) for n in (0, 1000, 10**6, 10**7)] == [15, 15, 24, 28]
    assert exact_dedup.bitmap_bits(10**9) == exact_dedup.MOST_BITS


def test_segment_totals_skip_what_they_do_not_read():
    rng = np.random.default_rng(3)
    parts = []
    for k, n in enumerate((0, 1, 700, 5000)):
        ids = rng.integers(0, 49_000, n).astype(np.uint32)
        parts.append(token_files.write_segment(4, k, [1, None][:min(n, 2)],
                                               np.array([n - 1, 1][:min(n, 2)]), ids) + b"\n")
    data = b"".join(parts)
    whole = [(s.part, s.sequence, s.tokens) for s in token_files.read_segments(data)]
    assert list(token_files.segment_totals(data)) == whole == [(4, 0, 0), (4, 1, 1), (4, 2, 700), (4, 3, 5000)]


def test_worker_keeps_its_encoder():
    model = registry.vocabulary(registry.WORD_MODEL)
    assert token_files.worker_encoder(model) is token_files.worker_encoder(model)
