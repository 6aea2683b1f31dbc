"""Repair of damaged conversations by a survivor-coalescence Viterbi decoder.

The role initials of a repaired conversation read ``(s?(ua)+)?``. A decoder goes through the
rows of a conversation once and keeps, for each state of that pattern, the cheapest edits that
lead there; of equally cheap ones those whose initials come first in ASCII order, for which
the complete unresolved suffixes of both are compared. Edits form a tree of backpointers with
reference counts: a node that no survivor descends from is dropped, and as soon as all
survivors share an ancestor, the edits up to it are final and go out. So a conversation is
never held, only what is still undecided. States that can no longer win are given up, which
lets the others coalesce.

Spark deals the rows out by conversation, finds repetitions with a window that needs no
further exchange, and sorts; tasks only stream. The digest of a repaired conversation is one
sequential hash, so a conversation is one stream of one task however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What the rest can cost more from one state than from another (rows: from, columns: than).
_EXTRA = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


class Node:
    """Edits of one row: their initials and the lines that they leave."""

    __slots__ = ("parent", "letters", "lines", "children", "survives")

    def __init__(self, parent: Node | None, letters: str, lines: tuple):
        self.parent, self.letters, self.lines = parent, letters, lines
        self.children: list[Node] = []
        self.survives = True
        if parent is not None:
            parent.children.append(self)

    @property
    def references(self) -> int:
        return len(self.children) + self.survives


def before(a: Node, a_more: str, b: Node, b_more: str) -> bool:
    """Do the initials up to ``a`` and ``a_more`` come before those of ``b`` and ``b_more``?

    Both nodes belong to the same row, so their paths meet after equally many steps; the
    suffixes from there on are compared whole.
    """
    left, right = [a_more], [b_more]
    while a is not b:
        left.append(a.letters)
        right.append(b.letters)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Decoder:
    """Cheapest edits of one conversation, row by row; final ones go to ``emit``."""

    def __init__(self, emit):
        self.emit = emit
        self.root = Node(None, "", ())
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.held = self.most = 0

    @staticmethod
    def _ways(state: int, role: str, text: str, must_go: bool, truncated: bool):
        """(next state, cost, initials, lines) of every edit of a row that can be cheapest."""
        yield state, DELETE, "D", ()
        if must_go:
            return
        initial, more = role[:1], TRUNCATED if truncated else 0
        if initial == "s" and state == START:
            yield SYSTEM, more, "K", ((role, text),)
        for target, letter in ((USER, "u"), (ASSISTANT, "a")):
            kept = initial == letter
            line = (role if kept else _NAMES[target], text)
            cost, edit = more + (0 if kept else REROLE), "K" if kept else "R"
            if (state == USER) == (target == ASSISTANT):
                yield target, cost, edit, (line,)
            else:
                other = _NAMES[USER + ASSISTANT - target]
                yield target, cost + INSERT, "I" + edit, ((other, ""), line)

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: dict[int, tuple] = {}
        for state, (cost, node) in self.best.items():
            for target, more, letters, lines in self._ways(state, role, text, must_go, truncated):
                self._offer(found, target, (cost + more, node, letters, lines))
        worth = {q: way for q, way in found.items() if not any(
            found[p][0] + _EXTRA[p][q] < way[0] for p in found if p != q)}
        last = [node for _, node in self.best.values()]
        self.best = {q: (cost, Node(node, letters, lines))
                     for q, (cost, node, letters, lines) in worth.items()}
        self.held += len(self.best)
        for node in last:
            node.survives = False
            self._drop(node)
        self._settle()
        self.most = max(self.most, self.held)

    @staticmethod
    def _offer(found: dict, key, way: tuple) -> None:
        known = found.get(key)
        if known is None or way[0] < known[0] or (
                way[0] == known[0] and before(way[1], way[2], known[1], known[2])):
            found[key] = way

    def _drop(self, node: Node) -> None:
        """Free nodes without references, up the tree."""
        while node is not self.root and not node.references:
            node.parent.children.remove(node)
            node = node.parent
            self.held -= 1

    def _settle(self) -> None:
        """Emit the edits that all survivors share."""
        while not self.root.survives and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.emit(self.root.letters, self.root.lines)
            self.root.lines = ()
            self.held -= 1

    def finish(self) -> int:
        """Emit what is left; the cost of all edits."""
        found: dict[int, tuple] = {}
        ends = {START: (0, "", ()), ASSISTANT: (0, "", ()),
                USER: (INSERT, "I", (("assistant", ""),)),
                SYSTEM: (2 * INSERT, "II", (("user", ""), ("assistant", "")))}
        for state, (cost, node) in self.best.items():
            more, letters, lines = ends[state]
            self._offer(found, 0, (cost + more, node, letters, lines))
        cost, node, letters, lines = found[0]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for step in reversed(path):
            self.emit(step.letters, step.lines)
        self.emit(letters, lines)
        return cost


class Conversation:
    """Counts, edits and digest of one conversation whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.low, self.high = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.decoder = Decoder(self._emit)

    def _emit(self, letters: str, lines: tuple) -> None:
        self.audit.append(letters)
        for role, text in lines:
            self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def row(self, turn, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        solid = text.rstrip(SPACE)
        blank, truncated = not solid, False
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        else:
            truncated = solid[-1] not in ".!?"
            self.truncated += truncated
        self.decoder.row(role, text, blank or again, truncated)

    def result(self) -> tuple:
        cost = self.decoder.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                "".join(self.audit), self.digest.hexdigest())


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair(conv_type: pa.DataType):
    """Rows sorted by conversation and turn to one row per conversation."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["conv_id", *_RESULT, "audit", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in
                       ("conv_id", "turn", "role", "text", "again", "there")]
            for conv_id, turn, role, text, again, there in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if there:
                    now.row(turn, role, text, again)
            if done:
                yield out(done)
                done = []
        if now is not None:
            yield out([now.result()])

    return run


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): every row damaged by the checksum of its name.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (``there`` is false then,
    so that its conversation is not lost), 1 empties the text, 2 removes its full stops,
    exclamation and question marks, 3 repeats the row, 4 makes its role user. Nulls count as
    one space, in the name too; turn and conv_id stay null.
    """

    def plain(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", ""))
            .otherwise(plain("text")))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(plain("role")).alias("role"),
        F.when(kind != 0, text).alias("text"), (kind != 0).alias("there"),
        F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, there): counts, edits, digest.

    Rows count in order of turn (null first), then role and text. Only rows that are ``there``
    count; a conversation without any has zeros, no edits and the digest of nothing. One
    exchange by conversation serves the window and the decoder.
    """
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy(
        F.col("turn").asc_nulls_first())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "again")]
    ready = dealt.withColumn("again", F.row_number().over(same) > 1).select(
        "conv_id", "turn", "role", "text", "again", "there").sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    columns = ", ".join(f"{c} long" for c in _RESULT)
    return ready.mapInArrow(
        _repair(arrow), f"conv_id {kind}, {columns}, audit string, repaired_sha256 string")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Damage ``rows`` (conv_id, turn, role, text) and repair them: one row per conv_id.

    gaps: missing turn numbers between the least and largest turn; blank, duplicate, truncated:
    rows by their first fault; illegal: neighbours whose role initials are not su, ua or au;
    cost, audit: the cheapest edits (Keep, Rerole, Delete, Insert) and their initials, of ties
    the first in ASCII order; repaired_sha256: digest of the ``role:text`` lines they leave.
    Null role and text count as one space, so a null text is blank; null turns come first; rows
    with a null conv_id are one conversation, with id null. Rows of the same turn are ordered by
    role and text, repeated rows are duplicates. Texts are read whole, however long. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    prepare(rows.sparkSession)
    if dict(rows.dtypes)["conv_id"] not in ("bigint", "int", "string"):
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    return repair(damage(rows.select("conv_id", "turn", "role", "text")))


#: The CRC-32 remainder of ``name`` in SQL: bit by bit over its bytes.
_KIND = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)
  % 20"""


def _ways_sql(state: str, letters: str, cost: str, line: str) -> str:
    """One way on from a state in SQL; ``line`` is what it appends to the lines."""
    return (f"{{'c': {state}.c + {cost}, 'p': {state}.p || {letters}, "
            f"'r': {state}.r || {line}}}")


def oracle() -> str:
    """The same by dynamic programming over rows, with whole strings of initials and lines."""
    insert = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}

    def to(target: str) -> str:
        name = {"u": "user", "a": "assistant"}[target]
        other = "a" if target == "u" else "u"
        kept = f"initial = '{target}'"
        edit = f"CASE WHEN {kept} THEN 'K' ELSE 'R' END"
        cost = f"CASE WHEN gone THEN 1000000 WHEN {kept} THEN more ELSE more + {REROLE} END"
        line = f"(chr(10) || CASE WHEN {kept} THEN role ELSE '{name}' END || ':' || text)"
        straight = ("s0", "ss", "sa") if target == "u" else ("su",)
        ways = [_ways_sql(f"s{target}", "'D'", str(DELETE), "''")]
        for s in ("s0", "ss", "su", "sa"):
            if s in straight:
                ways.append(_ways_sql(s, edit, cost, line))
            else:
                ways.append(_ways_sql(s, f"'I' || {edit}", f"{INSERT} + {cost}",
                                      f"{insert[other]} || {line}"))
        return f"list_min([{', '.join(ways)}])"

    deleted = {s: _ways_sql(s, "'D'", str(DELETE), "''") for s in ("s0", "ss")}
    kept = _ways_sql("s0", "'K'", "CASE WHEN gone OR initial <> 's' THEN 1000000 ELSE more END",
                     "(chr(10) || role || ':' || text)")
    ends = ", ".join([
        _ways_sql("s0", "''", "0", "''"), _ways_sql("sa", "''", "0", "''"),
        _ways_sql("su", "'I'", str(INSERT), insert["a"]),
        _ways_sql("ss", "'II'", str(2 * INSERT), f"{insert['u']} || {insert['a']}")])
    never = "{'c': 1000000::BIGINT, 'p': '', 'r': ''}"
    solid = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
coded AS (SELECT *, {_KIND} AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE kind <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1
    AS again FROM damaged),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial,
    lag(left(role, 1)) OVER w AS former,
    CASE WHEN NOT regexp_matches(text, '{solid}') THEN 'b' WHEN again THEN 'd'
      WHEN regexp_extract(text, '({solid})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't'
      ELSE '' END AS fault
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
ready AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END AS more
  FROM placed),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'p': '', 'r': ''}} AS s0, {never} AS ss,
    {never} AS su, {never} AS sa
  FROM (SELECT DISTINCT conv_id FROM ready)
  UNION ALL
  SELECT w.conv_id, r.i, {deleted['s0']}, list_min([{deleted['ss']}, {kept}]), {to('u')}, {to('a')}
  FROM walk w JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ended AS (SELECT conv_id, list_min([{ends}]) AS best FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (former || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ready GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.p, '') AS audit,
  sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
