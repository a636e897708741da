"""Operator 11: phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z) and reduced to pieces of words joined by single blanks, in
blocks of about ``BLOCK_BYTES``. Prefix sums of a polynomial over a block's bytes
(modulo 2^64) give the fingerprint of every phrase of 1 to ``MAX_WORDS`` words by one
subtraction and one product.

First pass: each block sends its distinct fingerprints with counts (up to ``MIN_COUNT``),
cut to ranges that a task can sum up; the block's number is the occurrence pointer. A
range keeps the fingerprints that reach ``MIN_COUNT`` over all blocks and sends each block
those it holds. A phrase's count is at most its fingerprint's, so none is lost, and a
fingerprint shared by several phrases only keeps too many.
Second pass: blocks meet their texts again, pick out the occurrences of the fingerprints
they were sent, compare their bytes, so that phrases that share a fingerprint come apart,
and write out text and exact count of these phrases only. Sums over blocks are exact; what
stays below ``MIN_COUNT`` goes.
Scores, overlaps and ranks are DataFrame joins over the frequent phrases, in decimals.

Defined results: null text counts as empty; a null language is ``und``; languages without
candidates have no rows; equal scores go by count, then by phrase (UTF-8 bytes); repeated
rows count each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import LOWER, doc_chunks, mix, parts, stage, utf8

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
COVER_PERCENT = 50
SCALE = 1_000_000
BLOCK_BYTES = 8 << 20     # text of a block
PASS_BYTES = 2 << 20      # text hashed at once
PARTITION_BYTES = 128 << 20   # text of a partition of the second pass, where there are more than shuffle partitions
SALTS = 16
RANGE_BYTES = 4 << 20     # text a range of fingerprints stands for; a word and its phrases take about four bytes each

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_BASE = 0x9E3779B97F4A7C15                           # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """1, base, base^2, ... modulo 2^64."""
    if len(cache.get(base, ())) < n:
        steps = np.full(max(n, PASS_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        cache[base] = np.cumprod(steps, dtype=np.uint64)
    return cache[base][:n]


def canonical(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, words a text): lower-cased texts whose words are followed by a blank,
    or by a line feed at the end of their piece."""
    low = LOWER[raw]
    stop = _STOP[low]
    inside = ~stop & ~_BLANK[low]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    size = end - start
    to = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(to[-1], 0x20, np.uint8)
    out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = low[inside]
    stops = np.concatenate(([0], np.cumsum(stop)))
    last = np.ones(len(size), dtype=bool)
    last[:-1] = stops[start[1:]] > stops[end[:-1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    out[to[1:][last] - 1] = 0x0A
    return out, to[first], np.diff(first)


class Phrases:
    """Every phrase of a run of canonical texts: byte ``start``, ``end`` and fingerprint."""

    def __init__(self, data: np.ndarray, seeds: np.ndarray, offsets: np.ndarray):
        """``seeds``: a hash of each text's language."""
        gap = (data == 0x20) | (data == 0x0A)
        end = np.flatnonzero(gap)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        piece = np.concatenate(([0], np.cumsum(data[end] == 0x0A)[:-1])) if len(end) else end
        seed = np.repeat(seeds, np.diff(np.searchsorted(start, offsets)))
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=prefix[1:])
        back = _powers(_INVERSE, len(data) + 1)
        starts, ends, prints = [], [], []
        for k in range(MAX_WORDS):
            n = max(len(start) - k, 0)
            one = np.flatnonzero(piece[:n] == piece[k:k + n]) if k else np.arange(n)
            s, e = start[one], end[one + k]
            starts.append(s)
            ends.append(e)
            prints.append(mix((prefix[e] - prefix[s]) * back[s] ^ seed[one]))
        self.start, self.end, self.print = map(np.concatenate, (starts, ends, prints))


def _seed(languages: list[str]) -> np.ndarray:
    known = {}
    for name in set(languages):
        data = np.frombuffer(name.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        known[name] = mix(np.array([len(data)], np.uint64) + (data * _powers(_BASE, len(data))).sum(dtype=np.uint64))[0]
    return np.array([known[name] for name in languages], np.uint64)


def _runs(batch, data: int, language: int):
    """(Phrases, bytes, language index, names) of passes over an Arrow batch."""
    raw, offsets = utf8(batch.column(data))
    names = batch.column(language).to_pylist()
    seeds = _seed(names)
    for a, b in doc_chunks(offsets, PASS_BYTES):
        ends = [offsets[b]]
        if ends[0] - offsets[a] > 2 * PASS_BYTES:          # one long text: cut at ends of pieces
            stops = offsets[a] + np.flatnonzero(raw[offsets[a]:offsets[b]] == 0x0A) + 1
            ends = stops[np.append(np.flatnonzero(np.diff(stops // PASS_BYTES)), len(stops) - 1)]
        at = offsets[a]
        for end in ends:
            part, places = raw[at:end], np.clip(offsets[a:b + 1], at, end) - at
            yield Phrases(part, seeds[a:b], places), part, places, names[a:b]
            at = end


def pack(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte plane by byte plane (small once compressed)."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _prepare(batches):
    """(lang, text) to (block, lang, data, words); blocks are numbered within the task."""
    number, held = 0, 0
    for batch in parts(batches, 1):
        raw, offsets = utf8(batch.column(1))
        data, to, words = canonical(raw, offsets)
        if held > BLOCK_BYTES:
            number, held = number + 1, 0
        held += len(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(words), number), pa.int64()), batch.column(0),
             pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()),
             pa.array(words, pa.int64())], names=["block", "lang", "data", "words"])


def _count(range_bits: int):
    """Arrow function from (block, lang, data) to (range, block, prints, counts): the block's
    distinct fingerprints in each range, with counts up to ``MIN_COUNT``."""
    cut = np.uint64(32 - range_bits)

    def send(block, prints):
        kept, n = np.unique(np.concatenate(prints), return_counts=True)
        ranges = (kept >> np.uint64(32)).astype(np.int64)
        bound = np.flatnonzero(np.diff(ranges, prepend=-1))
        low, n = (kept & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, MIN_COUNT).astype(np.uint8)
        ends = np.append(bound[1:], len(kept))
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges[bound], pa.int64()), pa.array(np.full(len(bound), block), pa.int64()),
             pa.array([pack(low[a:b]) for a, b in zip(bound, ends, strict=True)], pa.binary()),
             pa.array([n[a:b].tobytes() for a, b in zip(bound, ends, strict=True)], pa.binary())],
            names=["range", "block", "prints", "counts"])

    def count(batches):
        block, prints = None, []
        for batch in parts(batches, 2):
            blocks = batch.column(0).to_numpy()
            for first in np.flatnonzero(np.diff(blocks, prepend=-1)):
                n = int(np.searchsorted(blocks[first:] != blocks[first], True)) if blocks[-1] != blocks[first] else len(blocks) - first
                if block is not None and blocks[first] != block:
                    yield send(block, prints)
                    prints = []
                block = int(blocks[first])
                prints += [p.print >> cut for p, *_ in _runs(batch.slice(first, n), 2, 1)]
        if block is not None:
            yield send(block, prints)
    return count


def _frequent(table: pa.Table) -> pa.Table:
    """The fingerprints of one range that reach ``MIN_COUNT``, for each block that holds them."""
    lists = [unpack(p) for p in table.column("prints").to_pylist()]
    sizes = np.array([len(x) for x in lists])
    prints = np.concatenate(lists)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
    order = np.argsort(prints, kind="stable")
    sorted_prints = prints[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_prints[1:] != sorted_prints[:-1])))
    enough = np.add.reduceat(counts[order].astype(np.int64), first) >= MIN_COUNT
    keep = np.empty(len(prints), dtype=bool)
    keep[order] = np.repeat(enough, np.diff(np.append(first, len(prints))))
    done = np.concatenate(([0], np.cumsum(sizes)))
    sent = [pack(x[keep[a:b]]) for x, a, b in zip(lists, done[:-1], done[1:], strict=True)]
    out = table.select(["range", "block"]).append_column("prints", pa.array(sent, pa.binary()))
    return out.filter(pa.array([len(s) > 0 for s in sent]))


def _wanted(ranges: list, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints that a block was sent, and a bit table of their low bits."""
    every = [unpack(p).astype(np.uint64) | (np.uint64(r) << np.uint64(32)) for r, p in zip(ranges, lists, strict=True)]
    found = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
    marks = np.zeros(1 << 24, dtype=bool)
    marks[(found & np.uint64(0xFFFFFF)).astype(np.int64)] = True
    return found, marks


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    at = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]


def _verified(phrases: Phrases, data: np.ndarray, language: np.ndarray, one: np.ndarray):
    """(start, end, language, count) of the distinct phrases among occurrences ``one``:
    equal fingerprints whose bytes or languages differ come apart."""
    one = one[np.argsort(phrases.print[one], kind="stable")]
    start, size, prints = phrases.start[one], phrases.end[one] - phrases.start[one], phrases.print[one]
    new = np.concatenate(([True], prints[1:] != prints[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]              # first occurrence of the same fingerprint
    same = (size == size[head]) & (language[one] == language[one[head]])
    check = np.flatnonzero(same & ~new)
    for a in range(0, len(check), 1 << 18):
        c = check[a:a + (1 << 18)]
        differ = _spans(data, start[c], size[c]) != _spans(data, start[head[c]], size[c])
        at = np.concatenate(([0], np.cumsum(size[c])[:-1]))
        same[c] = ~np.logical_or.reduceat(differ, at)
    first = np.flatnonzero(new)
    n = np.add.reduceat(same.astype(np.int64), first)
    rest = np.flatnonzero(~same)                                # phrases that share a fingerprint with another one
    heads = one[first]
    return (np.concatenate((heads, one[rest])), np.concatenate((n, np.ones(len(rest), np.int64))))


def _materialise(batches):
    """Arrow function from a block's (block, range, prints) rows followed by its (block, lang,
    data) rows to (lang, phrase, count)."""
    block, ranges, lists, wanted, cut = None, [], [], None, None
    for batch in parts(batches, 3):
        blocks = batch.column(0).to_numpy()
        for first in np.flatnonzero(np.diff(blocks, prepend=-1)):
            n = int(np.searchsorted(blocks[first:] != blocks[first], True)) if blocks[-1] != blocks[first] else len(blocks) - first
            rows = batch.slice(first, n)
            if blocks[first] != block:
                block, ranges, lists, wanted = int(blocks[first]), [], [], None
            texts = rows.column(1).is_null().to_numpy(zero_copy_only=False)
            sent = int((~texts).sum())
            if sent:
                ranges += rows.column(1).slice(0, sent).to_pylist()
                lists += rows.column(4).slice(0, sent).to_pylist()
                cut = np.uint64(rows.column(5)[0].as_py())
            if sent < n and lists:
                wanted = wanted or _wanted(ranges, lists)
                yield from _counted(rows.slice(sent), wanted, cut)


def _counted(rows, wanted, cut):
    found, marks = wanted
    for phrases, data, offsets, names in _runs(rows, 3, 2):
        short = phrases.print >> cut
        one = np.flatnonzero(marks[(short & np.uint64(0xFFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(found, short[one]), len(found) - 1)
        one = one[found[at] == short[one]]
        if not len(one):
            continue
        distinct = {name: i for i, name in enumerate(dict.fromkeys(names))}
        language = np.array([distinct[name] for name in names])[np.searchsorted(offsets, phrases.start, "right") - 1]
        heads, n = _verified(phrases, data, language, one)
        size = phrases.end[heads] - phrases.start[heads]
        text = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)),
                                                pa.py_buffer(_spans(data, phrases.start[heads], size)))
        yield pa.RecordBatch.from_arrays(
            [pa.DictionaryArray.from_arrays(pa.array(language[heads], pa.int32()), pa.array(list(distinct), pa.string())).cast(pa.string()),
             text.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of the phrases of 1 to ``MAX_WORDS`` words that occur at
    least ``MIN_COUNT`` times, (lang, n): words of each language)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = texts.mapInArrow(_prepare, "block bigint, lang string, data string, words bigint")
    # Number blocks across tasks; staged, since both passes need the same ones.
    base = stage(base.withColumn("block", F.spark_partition_id().cast("bigint") * (1 << 32) + F.col("block")), "blocks")
    totals = base.groupBy("lang").agg(F.sum("words").alias("n"))
    size = base.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0
    bits = min(max(int(size // RANGE_BYTES).bit_length(), 0), 31)
    shuffled = base.select("block", "lang", "data").mapInArrow(_count(bits), "range bigint, block bigint, prints binary, counts binary")
    sent = stage(shuffled.groupBy("range").applyInArrow(_frequent, "range bigint, block bigint, prints binary"), "frequent")
    both = (sent.withColumn("cut", F.lit(32 - bits))
            .unionByName(base.select("block", "lang", "data"), allowMissingColumns=True)
            .select("block", "range", "lang", "data", "prints", "cut"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    dealt = both.repartition(tasks, "block").sortWithinPartitions("block", F.col("range").asc_nulls_last())
    counts = dealt.mapInArrow(_materialise, "lang string, phrase string, n bigint")
    exact = (counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= MIN_COUNT)
             .withColumn("words", F.size(F.split("phrase", " "))))
    return stage(exact, "phrases"), totals


def _words(first: bool, k: Column) -> Column:
    """The first or last ``k`` words of ``phrase``."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k if first else -k)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases of 2
    to 3 words."""
    known, totals = frequent_phrases(docs, lang_col, text_col)
    candidates = known.where("words > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _words(True, F.col("k")), "right": _words(False, F.col("words") - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.call_function("div", whole["a"] * whole["a"] * F.lit(SCALE).cast("decimal(7,0)"), whole["l"] * whole["r"])
    scored = (cuts.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    longer = candidates.where(F.col("words") > 2).select("lang", "a", F.explode(F.array(_words(True, F.lit(2)), _words(False, F.lit(2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (scored.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < COVER_PERCENT * F.col("a")))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # First within parts of a language, so that the last ranking reads SALTS * top rows of it at most.
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, doc, p AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS p)),
words AS (
  SELECT lang, doc, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM words
  WINDOW s AS (PARTITION BY doc, piece ORDER BY i)),
phrases AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE words > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, w, words, k, array_to_string(w[1:k], ' ') AS lead_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, (VALUES (1), (2)) AS c(k) WHERE k < words),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.words, c.k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = c.lead_part
              JOIN phrases y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE words = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang)
WHERE rank <= 2000
"""
