"""Operator 12: conversations repaired to ``(s?(ua)+)?`` by depth-first branch and bound.

A conversation's rows, in order of turn, each carry a fault (blank, duplicate, truncated
or none) and a role initial. Edits keep, re-role, delete or insert rows; the search finds
the cheapest script that gives an allowed sequence of initials, of equal ones the one whose
initials (the audit) come first in ASCII.

The search keeps an explicit stack of prefixes. A node is (next row, last initial). Its
suffix bound is the cost of the cheapest completion whatever its audit; children are
entered by bound, then by letter; a prefix goes when its cost and bound reach the
incumbent's cost, or when the node's dominance table holds a prefix as cheap that came
earlier. Two prefixes of equal cost at one node never continue each other (only inserts
could, and they cost), so the earlier one in ASCII stays ahead whatever follows. The empty
stack proves the incumbent.

Spark deals conversations by id and sorts each one's rows twice into one stream: first
short rows of faults, which give the audit, then the texts, which the audit turns into
repaired rows one by one. So a task holds about 300 bytes a row of the conversation at hand
(its audit alone has a byte a row), never its texts.

Defined results: a null role, text, id or turn counts as one space in comparisons and keys;
a role that does not start with s, u or a is never kept; null turns come first and count for no gap; rows of equal turn go by role, then by the
SHA-256 of the text; repeated rows are duplicates of each other; an id of ``ids`` without
rows gives zeros, an empty audit and the hash of the empty string; a null id is a
conversation like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5      # costs
FINE, BLANK, DUPLICATE, CUT = range(4)                       # faults
START, SYSTEM, USER, ASSISTANT = range(4)                    # last initial of a prefix
NAMES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\f\r"
_MARKER, _FAULTS, _TEXT = range(3)                           # kinds of rows of the stream
_NONE = 1 << 60

_NEEDS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _step(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return _AFTER[initial] if initial == _NEEDS[state] else None


def _choices(state: int, initial: str, fault: int):
    """(letter, cost, state after) of the edits that take the next row."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    kept = _step(state, initial) if initial in ("s", "u", "a") else None
    if kept is not None:
        yield "K", KEEP + more, kept
    yield "R", REROLE + more, _AFTER[_NEEDS[state]]


def suffix_bounds(rows: list[tuple[str, int]]) -> list[list[int]]:
    """For each suffix of ``rows`` and state, the cost of the cheapest completion."""
    bounds = [[0, _NONE, _NONE, 0]]
    _inserts(bounds[0])
    for initial, fault in reversed(rows):
        after = bounds[-1]
        now = [min(c + after[t] for _, c, t in _choices(s, initial, fault)) for s in range(4)]
        _inserts(now)
        bounds.append(now)
    return bounds[::-1]


def _inserts(bound: list[int]) -> None:
    for _ in range(2):                       # a third insert would only come back to the same state
        for s in range(4):
            bound[s] = min(bound[s], INSERT + bound[_AFTER[_NEEDS[s]]])


def cheapest_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of ``rows`` of (role initial, fault)."""
    bounds, n = suffix_bounds(rows), len(rows)
    best_cost, best = _NONE, None            # incumbent; its audit as a chain of letters
    reached: dict[tuple[int, int], int] = {}
    stack = [(0, START, 0, None)]
    while stack:
        row, state, cost, chain = stack.pop()
        # Of equal bounds, what was entered first comes first in ASCII, so equality prunes too.
        if cost + bounds[row][state] >= best_cost or reached.get((row, state), _NONE) <= cost:
            continue
        reached[row, state] = cost
        if row == n and state in (START, ASSISTANT):
            best_cost, best = cost, chain
            continue
        into = _AFTER[_NEEDS[state]]
        children = [(cost + INSERT + bounds[row][into], "I", row, into, cost + INSERT)]
        if row < n:
            children += [(cost + c + bounds[row + 1][t], letter, row + 1, t, cost + c) for letter, c, t in _choices(state, *rows[row])]
        for _, letter, r, t, c in sorted(children, reverse=True):
            stack.append((r, t, c, (chain, letter)))
    letters = []
    while best is not None:
        best, letter = best
        letters.append(letter)
    return best_cost, "".join(reversed(letters))


class _Conversation:
    """Faults of one conversation as its rows come, then its repaired rows."""

    def __init__(self):
        self.rows: list[tuple[str, int]] = []
        self.seen: set = set()
        self.counts = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns, self.least, self.last = 0, None, None
        self.audit = None

    def add(self, turn, role: str, digest: bytes, fault: int) -> None:
        if fault != BLANK and (role, digest) in self.seen:
            fault = DUPLICATE
        self.seen.add((role, digest))
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.rows.append((initial, fault))
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last = turn
            self.turns += 1

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest_edits(self.rows)
            self.seen, self.rows = set(), []
            self.at, self.state, self.step = 0, START, 0
            self.hash = hashlib.sha256()

    def _put(self, letter: str, role: str, text: str):
        if self.step:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.state = _AFTER[role[:1]]
        self.step += 1
        return self.step, letter, role, text

    def inserted(self):
        """Repaired rows up to the next edit that takes a row."""
        self.solve()
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._put("I", NAMES[_NEEDS[self.state]], "")

    def take(self, role: str, text: str):
        """Repaired rows that the next row of the conversation gives."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._put(letter, role if letter == "K" else NAMES[_NEEDS[self.state]], text)

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (gaps, *self.counts[BLANK:], self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _stream(batches, conv_type: pa.DataType, summaries: bool):
    """Summaries of conversations, or their repaired rows."""
    names = (["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] if summaries
             else ["conv_id", "step", "edit", "role", "text"])
    types = [conv_type, *([pa.int64()] * 6 if summaries else [pa.int64(), pa.string()]), pa.string(), pa.string()]
    out: list[tuple] = []

    def batch():
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def end(conv, now):
        rest = [(conv, *r) for r in now.inserted()]
        out.extend([(conv, *now.summary())] if summaries else rest)

    now, conv = None, None
    for arrow in batches:
        for c, kind, turn, role, digest, fault, text in zip(*(col.to_pylist() for col in arrow.columns), strict=True):
            if now is None or c != conv:
                if now:
                    end(conv, now)
                now, conv = _Conversation(), c
            if kind == _FAULTS:
                now.add(turn, role, digest, fault)
            elif kind == _TEXT:
                made = [(conv, *r) for r in now.take(role, text)]
                if not summaries:
                    out.extend(made)
        yield batch()
        out.clear()
    if now:
        end(conv, now)
        yield batch()


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _faults(text: Column) -> Column:
    trimmed = _trimmed(text)
    return (F.when(F.length(trimmed) == 0, BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE))


def _sorted_stream(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    filled = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                         *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    filled = filled.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), _faults(F.col("text")).alias("fault"),
                           F.explode(F.array(F.lit(_FAULTS), F.lit(_TEXT))).alias("kind"))
    stream = filled.select("conv_id", "kind", "turn", "role", "digest", "fault", F.when(F.col("kind") == _TEXT, F.col("text")).alias("text"))
    if ids is not None:
        marks = ids.select("conv_id").distinct().select("conv_id", F.lit(_MARKER).alias("kind"))
        stream = stream.unionByName(marks, allowMissingColumns=True)
    return stream.repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")


def _repair(rows: DataFrame, ids: DataFrame | None, summaries: bool, columns: str) -> DataFrame:
    stream = _sorted_stream(rows, ids)
    kind = rows.schema["conv_id"].dataType
    conv_type = to_arrow_type(kind)
    return stream.mapInArrow(lambda batches: _stream(batches, conv_type, summaries), f"conv_id {kind.simpleString()}, {columns}")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text): the rows of the repaired conversations of ``rows``
    (conv_id, turn, role, text), in order of ``step``; ``edit`` is K, R or I."""
    return _repair(rows, None, False, "step bigint, edit string, role string, text string")


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and hash of the repaired rows of each conversation of ``rows``
    (conv_id, turn, role, text), and of each id of ``ids``."""
    return _repair(rows, ids, True, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                   "cost bigint, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1
    empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    return conversations.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
