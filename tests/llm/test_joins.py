"""The n-gram Jaccard join against brute force, and its odd rows."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import jaccard_join as join
from cohortloom.llm import registry
from cohortloom.llm.common import read_table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows, percent=90, shingle=3):
    """(doc_id, set size, least id in reach, links) of every row, from all overlapping pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({b" ".join(words[i:i + shingle]) for i in
                     range(max(1, len(words) - shingle + 1))} if words else set())
    root, degree, holders = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        common = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted((str(d), len(sets[i]), str(min(ids[find(i)], default=None)), degree[i])
                  for i, (d, _) in enumerate(rows))


def results(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links)
                  for r in frame.collect())


def near_copies(n, seed):
    rng = random.Random(seed)
    words, rows = "a b c d e f G h É".split(), []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice(" \n\t") + " ".join(base) + rng.choice(["", " "])))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.choice([None, i, 1000 + len(rows)]), "  ".join(copy)))
    return rows + [(1, None), (None, ""), (2, " \n"), (2, "x"), (3, "X"), (None, "y z")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_matches_all_pairs(spark):
    docs = read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    assert results(registry.op11_jaccard_join(spark, FOLDER)) == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("options", [
    {}, {"percent": 60}, {"percent": 60, "limit": 5, "volume": 50}, {"shingle": 1, "percent": 70}])
def test_near_copies(spark, options):
    rows = near_copies(250, 3)
    expected = brute(rows, options.get("percent", 90), options.get("shingle", 3))
    assert results(join.jaccard_groups(spark.createDataFrame(rows, SCHEMA), **options)) == expected
    assert sum(r[3] > 0 for r in expected) > 50


def test_hot_group_of_near_copies(spark):
    """A third of the rows are near copies of one text, another third exact copies."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base)) for i in range(120)]
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(90)] = f"x{rng.randrange(9)}"
        rows.append((500 + i, " ".join(copy)))
    rows += [(900 + i, " ".join(f"r{rng.randrange(60)}" for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    for options in ({}, {"limit": 20}):
        assert results(join.jaccard_groups(docs, **options)) == expected


def test_odd_rows(spark):
    long = " ".join(f"word{i % 7919}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long), (3, None), (4, ""), (5, " \t"), (6, "one two"),
            (7, "ONE\ntwo"), (None, "lone text of a null id"), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select(
        "*", *[F.lit("clash").alias(c) for c in ("n", "sid", "set_key", "prefix", "text_key", "place",
                                                 "component_id", "links", "first", "least", "a")])
    assert results(join.jaccard_groups(docs)) == brute(rows)
    assert join.jaccard_groups(docs.limit(0)).collect() == []
    assert results(join.jaccard_groups(docs.filter("doc_id = 1"))) == [("1", 7919, "1", 0)]


def test_picks_lengthen_where_candidates_are_dear():
    places = np.arange(40)
    rare = join.pick(400, places, np.full(40, 2), 90)
    dear = join.pick(400, places, np.concatenate([np.full(3, 2), np.full(37, 5000)]), 90)
    late = join.pick(400, np.arange(36, 44), np.array([2] * 7 + [9]), 90)
    assert rare[0] > 1 and dear[0] >= 1 and late is None
    assert join.pick(400, places[:0], places[:0], 90) is None


def test_shingle_sets_match_plain_sets():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB \n\x0b\x1cé") for _ in range(rng.randint(0, 40)))
             for _ in range(300)]
    for text, found in zip(texts, join.shingle_sets(pa.array(texts)), strict=True):
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
        plain = {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        assert len(found) == len(plain) and (np.diff(found.astype(float)) >= 0).all()
