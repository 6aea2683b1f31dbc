"""Conversation repair against exhaustive search, its odd rows, and the decoder's memory."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, initials, lines) by search over all edits, with up to two insertions in a row.

    ``rows`` are (role, text, must go, truncated). Works from the end, on whole strings.
    """
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        if inserted < 2:
            for x in "ua":
                if (state, x) in step:
                    c, p, lines = best(i, step[state, x], inserted + 1)
                    found.append((c + 2, "I" + p, ((name[x], ""), *lines)))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            c, p, lines = best(i + 1, state, 0)
            found.append((c + 3, "D" + p, lines))
            if not must_go:
                for x, cost, letter, new in [(role[:1], 0, "K", role), ("u", 2, "R", "user"),
                                             ("a", 2, "R", "assistant")]:
                    if (state, x) in step:
                        c, p, lines = best(i + 1, step[state, x], 0)
                        found.append((c + cost + truncated, letter + p, ((new, text), *lines)))
        return min(found, key=lambda w: w[:2]) if found else (10**6, "", ())

    return best(0, "0", 0)


def brute(rows):
    """Result rows of a table of (conv_id, turn, role, text), damage included."""
    kept, found = {}, []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        mine = kept.setdefault(conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        mine += [] if kind == 0 else [row, row] if kind == 3 else [row]
    for conv_id, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, counts, rows_in = set(), dict.fromkeys(("blank", "again", "cut"), 0), []
        for _, role, text in mine:
            solid, cut = text.strip(SPACE), False
            if not solid:
                fault = "blank"
            elif (role, text) in seen:
                fault = "again"
            else:
                cut = solid[-1] not in ".!?"
                fault = "cut" if cut else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            rows_in.append((role, text, fault in ("blank", "again"), int(cut)))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = cheapest(rows_in)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        found.append((conv_id, gaps, *counts.values(), illegal, cost, audit,
                      hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def results(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def table(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "s", None, "Über"]
    texts = ["Yes.", "No", "No \n", "", " ", "Why?", "a.b", "…", None, "x\x1c", "end.\n", "é!"]
    rows = []
    for conv_id in range(n):
        name = rng.choice([conv_id, conv_id, None]) if conv_id % 10 == 0 else conv_id
        for turn in range(rng.randint(1, 9)):
            turn = rng.choice([turn] * 8 + [None, turn + 2, -turn])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn is None or turn % 2]
            rows.append((name, turn, role, rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_search_over_all_edits(spark, seed):
    rows = table(300, seed)
    found = results(conv.repaired_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute(rows)
    assert {len(set(r[7])) for r in found} >= {1, 2, 3, 4}


def decode(rows):
    out = []
    decoder = conv.Decoder(lambda letters, lines: out.append((letters, lines)))
    for row in rows:
        decoder.row(*row)
    cost = decoder.finish()
    return cost, "".join(x for x, _ in out), tuple(y for _, x in out for y in x), decoder.most


def test_decoder_on_random_rows():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), str(i), rng.random() < 0.2,
                 rng.random() < 0.3) for i in range(rng.randint(0, 9))]
        assert decode(rows)[:3] == cheapest([(a, b, c, int(d)) for a, b, c, d in rows])


def test_decoder_holds_only_what_is_undecided():
    rng = random.Random(6)
    rows = []
    for i in range(50_000):
        role = ("user", "assistant")[i % 2]
        if rng.random() < 0.1:
            role = rng.choice(["user", "assistant", "system"])
        rows.append((role, str(i), rng.random() < 0.05, False))
    cost, audit, lines, most = decode(rows)
    assert most < 400 and sum(map(audit.count, "KRD")) == 50_000
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    short = rows[:60]
    assert decode(short)[:3] == cheapest([(a, b, c, int(d)) for a, b, c, d in short])


def test_nodes_are_freed():
    decoder = conv.Decoder(lambda letters, lines: None)
    for i in range(1000):
        decoder.row(("user", "user", "assistant")[i % 3], "x.", False, False)

    def count(node):
        return 1 + sum(count(c) for c in node.children)

    assert count(decoder.root) - 1 == decoder.held < 100


def test_odd_tables(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (2, None, None, None), (3, 5, "user", "Hi."),
            (3, 5, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA).select(
        "*", *[F.lit("clash").alias(c) for c in ("again", "there", "copy", "audit", "cost", "name")])
    assert results(conv.repaired_conversations(frame)) == brute(rows)
    assert conv.repaired_conversations(frame.limit(0)).collect() == []


def test_one_conversation_with_all_rows(spark):
    """A conversation of many batches is streamed in order."""
    rows = [(7, i, ("user", "assistant", "user", "tool")[i % 4], f"text {i % 1000}.") for i in range(9000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    row, = conv.repaired_conversations(frame).collect()
    kinds = [zlib.crc32(f"7:{i}".encode()) % 20 for i in range(9000)]
    assert sum(map(row.audit.count, "KRD")) == sum(k != 0 for k in kinds) + kinds.count(3)
    assert row.duplicate > 6000 and row.cost >= 3 * (row.duplicate + row.blank)
