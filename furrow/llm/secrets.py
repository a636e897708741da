"""Operator 9: secret scan with one combined deterministic automaton.

Every rule is compiled into one minimised byte automaton (``automaton.py``) that
reads each text once. Base rules are ``assign``, ``access`` and ``hex``; the
method adds ``pem``. Spans are leftmost non-overlapping by rule,
in code points, end exclusive; an ``assign`` match with a value under 12
characters and an ``access`` match under 18 are dropped after matching (they
still use up their text). The bound of ``hex`` is part of its automaton, which is
the same because its matches are whole runs.

Defined results: null text counts as empty (no spans); repeated rows each give
a row; an empty table gives an empty result; other columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.automaton import Matcher
from furrow.llm.common import parts, utf8

# Rules in listed order, and the least length of an assigned value.
RULES = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]{16,}",
    "pem": rb"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
VALUE_LEAST = 12
ACCESS_LEAST = 18

_HEAD = re.compile(rb"""["']?\x20*[:=]\x20*["']?""")
_KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)")


def _value_length(match: bytes) -> int:
    key = _KEYWORD.match(match).end()
    return len(match) - _HEAD.match(match, key).end()


def find_spans(matcher: Matcher, data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, failing matches dropped."""
    kinds = list(RULES)

    def holds(s: int, k: int, e: int) -> bool:
        if kinds[k] == "assign":
            return _value_length(data[s:e]) >= VALUE_LEAST
        return kinds[k] != "access" or e - s >= ACCESS_LEAST

    return [span for span in matcher.spans(data) if holds(*span)]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<base kind>..., base_sha256, spans) for every row of ``docs``."""
    kinds = list(RULES)

    def scan(batches):
        matcher = Matcher(list(RULES.values()))
        for batch in parts(batches, 1):
            raw, offsets = utf8(batch.column(1))
            text = raw.tobytes()
            rows = []
            for i in range(len(offsets) - 1):
                data = text[offsets[i]:offsets[i + 1]]
                spans = find_spans(matcher, data)
                if spans:
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                    spans = [(int(chars[s]), kinds[k], int(chars[e])) for s, k, e in spans]
                rows.append(spans)
            base = [_joined(x for x in spans if x[1] in BASE) for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([sum(x[1] == k for x in spans) for spans in rows], pa.int64()) for k in BASE]
                + [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                   pa.array([_joined(spans) for spans in rows], pa.string())],
                names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, "
              + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string")
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]",
                   length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret span (base and added) replaced by ``mask``;
    ``length_col``, where the table has it, follows the new text. Null texts
    stay null."""
    names = docs.columns
    at = names.index(text_col)
    size_at = names.index(length_col) if length_col in names else -1
    cover = mask.encode()

    def redact(batches):
        matcher = Matcher(list(RULES.values()))
        for batch in parts(batches, at):
            old = batch.column(at)
            raw, offsets = utf8(old)
            text, new = raw.tobytes(), {}
            for i in range(len(offsets) - 1):
                data = text[offsets[i]:offsets[i + 1]]
                spans = find_spans(matcher, data)
                if not spans:
                    continue
                out, done = [], 0
                for s, _, e in spans:
                    if s >= done:
                        out += [data[done:s], cover]
                    done = max(done, e)
                new[i] = b"".join([*out, data[done:]]).decode()
            columns = list(batch.columns)
            if new:
                texts = old.to_pylist()
                for i, t in new.items():
                    texts[i] = t
                columns[at] = pa.array(texts, old.type)
                if size_at >= 0:
                    sizes = columns[size_at].to_pylist()
                    for i, t in new.items():
                        sizes[i] = len(t)
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
