"""Operator 6: benchmark decontamination as a prefix-filtered containment join.

A window is ``WINDOW_WORDS`` consecutive words of an item (an item of fewer words
is one window). Its tokens are its word shingles; a document that contains the
window must contain all of them, so the necessary prefix in the rarity order is
the one rarest shingle. Rarity is counted over all documents. Documents are
probed for prefix shingles only; a hit fixes the window's place (the shingle's
offset), the window must fit between the document's first and last word
(positional and length bounds), and then its words are compared byte by byte.

The benchmark is the query set. It is read in blocks of at most ``BLOCK_ITEMS_BYTES``
of text (one block unless it is larger), one at a time on the driver; documents pass
each block in turn, so none of its items is dropped. All blocks travel with the plan, and
a benchmark of many blocks has the texts split into words once a block.

Defined results: null or wordless texts have no words and are clean; items without
words match nothing; items of a null id hit like others, count as one item together and
have no id to list; repeated items with one id count once;
repeated rows each give a row; empty tables give clean or empty results; other
columns of either table are ignored (and kept by ``drop_contaminated``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import ALNUM, SHINGLE_WORDS, Words, doc_chunks, parts, runs_hash, unused, utf8

WINDOW_WORDS = 10
BLOCK_ITEMS_BYTES = 1 << 20
ADDED = ("_words", "_spans", "_items")
_FILTER_BITS = 20


class Block:
    """Distinct windows of a bounded set of items."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.words, self.items, at = [], [], {}
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), ALNUM)
            low = text.encode().translate(_LOWER_BYTES)
            words = [low[a:b] for a, b in zip(w.start, w.end, strict=True)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = tuple(words[i:i + size])
                if key not in at:
                    at[key] = len(self.words)
                    self.words.append((b" ".join(key), w.hash[i:i + size]))
                    self.items.append(set())
                self.items[at[key]].add(item)
        self.sizes = sorted({min(shingle, len(h)) for _, h in self.words})
        self.shingle = shingle

    def window_tokens(self, i: int) -> tuple[int, np.ndarray]:
        h = self.words[i][1]
        k = min(self.shingle, len(h))
        return k, runs_hash(h, k)

    def all_tokens(self) -> dict[int, np.ndarray]:
        found: dict[int, list] = {k: [] for k in self.sizes}
        for i in range(len(self.words)):
            k, t = self.window_tokens(i)
            found[k].append(t)
        return {k: np.unique(np.concatenate(v)) for k, v in found.items()}

    def prefixes(self, rarity: dict[int, int]):
        """By shingle size: sorted prefix shingles with their window and offset."""
        rows: dict[int, list] = {k: [] for k in self.sizes}
        for i in range(len(self.words)):
            k, t = self.window_tokens(i)
            offset = min(range(len(t)), key=lambda j: (rarity.get(int(t[j].view(np.int64)), 0), int(t[j]), j))
            rows[k].append((int(t[offset]), i, offset))
        out = {}
        for k, v in rows.items():
            v.sort()
            out[k] = (np.array([x[0] for x in v], np.uint64), np.array([x[1:] for x in v], np.int64).reshape(-1, 2))
        return out


_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Probe:
    """Places of a sorted set of hashes in an array: a small bit table first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.table[self._slot(hashes)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[self._slot(x)])
        left = np.searchsorted(self.hashes, x[at])
        left[left == len(self.hashes)] = 0
        return at[self.hashes[left] == x[at]] if len(self.hashes) else at[:0]


def _rarity(texts: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences in all documents of the block's shingles (rows: one a shingle
    of a bounded block)."""

    def count(batches):
        probes = {k: _Probe(t) for k, t in tokens.items()}
        total: dict[int, int] = {}
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in doc_chunks(offsets):
                w = Words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ALNUM)
                for k, probe in probes.items():
                    s = runs_hash(w.hash, k)
                    for t, n in zip(*np.unique(s[probe.places(s)], return_counts=True), strict=True):
                        total[int(t)] = total.get(int(t), 0) + int(n)
        keys = np.array(sorted(total), np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array([total[int(t)] for t in keys], pa.int64())], names=["token", "n"])

    rows = texts.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


def _match(batch_schema, columns: list[str], block: Block, rarity: dict[int, int]):
    """A function over batches of ``columns`` + _words, _spans, _items, where the
    text stands at index 0, that adds the block's hits."""

    def match(batches):
        prefixes = {k: (_Probe(np.unique(h)), h, v) for k, (h, v) in block.prefixes(rarity).items()}
        n_fixed = len(columns)
        for batch in parts(batches, 0):
            raw, offsets = utf8(batch.column(0))
            spans = [list(zip(s[::2], s[1::2], strict=True)) for s in batch.column(n_fixed + 1).to_pylist()]
            items = batch.column(n_fixed + 2).to_pylist()
            n_words = np.zeros(len(offsets) - 1, np.int64)
            for a, b in doc_chunks(offsets):
                part = raw[offsets[a]:offsets[b]]
                w = Words(part, offsets[a:b + 1] - offsets[a], ALNUM)
                n_words[a:b] = np.diff(w.first)
                for doc, start, window in _candidates(w, prefixes, block):
                    words, h = block.words[window]
                    stop = start + len(h)
                    if b" ".join(part[x:y].tobytes() for x, y in zip(w.start[start:stop], w.end[start:stop], strict=True)
                                 ).translate(_LOWER_BYTES) != words:
                        continue
                    at = start - w.first[doc]
                    spans[a + doc].append((int(at), int(at) + len(h)))
                    items[a + doc] = list(set(items[a + doc]) | block.items[window])
            spans = [_merged(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_fixed], pa.array(n_words, pa.int64()),
                 pa.array([[x for p in s for x in p] for s in spans], pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.string()))], names=batch_schema)

    return match


def _candidates(w: Words, prefixes, block: Block):
    """(document, first word, window) triples that pass the positional bounds and
    agree in all word hashes."""
    for k, (probe, hashes, where) in prefixes.items():
        s = runs_hash(w.hash, k)
        for p in probe.places(s):
            left, right = np.searchsorted(hashes, s[p], "left"), np.searchsorted(hashes, s[p], "right")
            doc = int(np.searchsorted(w.first, p, "right")) - 1
            for window, offset in where[left:right]:
                start, h = int(p - offset), block.words[window][1]
                if start >= w.first[doc] and start + len(h) <= w.first[doc + 1] \
                        and (w.hash[start:start + len(h)] == h).all():
                    yield doc, start, int(window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Blocks of (item, text) of at most ``limit`` bytes, an item at least."""
    rows = (benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
            .where(F.col("t").isNotNull()).distinct())
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"].encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
                    block_bytes: int = BLOCK_ITEMS_BYTES, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` (the text column first) plus the columns ``names``: number of words,
    merged hit word ranges [start, end) flattened, ids of the items with an occurring
    window. Columns of ``docs`` with these names are replaced."""
    columns = [text_col, *(c for c in docs.columns if c != text_col and c not in names)]
    texts = docs.select(F.col(text_col).cast("string"))
    rows = docs.select(*columns).withColumns(dict(zip(names, (
        F.lit(0).cast("bigint"), F.array().cast("array<bigint>"), F.array().cast("array<string>")), strict=True)))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    found = False
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        block = Block(items, window, shingle)
        rarity = _rarity(texts, block.all_tokens()) if block.words else {}
        rows = rows.mapInArrow(_match(schema.names, columns, block, rarity), schema)
        found = True
    if not found:
        rows = rows.mapInArrow(_match(schema.names, columns, Block([], window, shingle), {}), schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    rows = match_benchmark(docs.select(id_col, text_col), benchmark, text_col, **options)
    n_hit = F.aggregate(F.col("_spans"), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("sign")),
                        lambda acc, x: F.struct((acc["sum"] + acc["sign"] * x).alias("sum"), (-acc["sign"]).alias("sign")))["sum"]
    return rows.select(id_col, F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
                       F.size("_items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
                       (F.size("_spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept."""
    names = tuple(unused(docs.columns, name) for name in ADDED)
    rows = match_benchmark(docs, benchmark, text_col, names=names, **options)
    return rows.where(F.size(names[1]) == 0).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
