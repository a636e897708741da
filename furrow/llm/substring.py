"""Operator 5: exact substring dedup with a sparse suffix array.

Removed is each byte covered by a ``LENGTH``-byte string that also starts earlier
(smaller id, or same document and earlier start). Sorting every suffix is not
needed: each window of ``LENGTH`` bytes has one anchor, its 32-byte gram of least
hash, and equal windows have equal anchors. Windows in a row with one anchor form a
run (about one in 32 bytes); the suffixes that are sorted start at the anchors.

1. Sampled splitters (leading 4 bytes, anchor, content, id) range-partition the
   anchored suffixes into buckets; ties split too, so a frequent passage spreads over
   several buckets. Each bucket sorts locally (multikey: only what is still tied is
   compared further). Runs of equal content are adjacent: all but the first are
   duplicates as a whole. The last suffix of a bucket is compared with the first of
   the next by a join of the buckets' ends (splitters are rows of the data, so no
   bucket between two others is empty).
2. Anchors with several contents (where repeats begin or end) need their bytes: the
   runs' windows are sorted by their bytes the same way, and all but the first of
   equal windows are duplicates. Anchors that span several buckets may be very
   frequent. Their runs are first tested by blocks of ``BLOCK`` neighbouring windows:
   the bytes that all windows of a block share (its core) stand at the same place of
   the anchor in every run that shares one of them, so a core that one run alone has
   ends its block. Windows of shared cores are sorted by bytes inside each task, which
   settles all but the task's first ones; those meet by hashes and a combining minimum.

Contents are told apart by 82 bits of two polynomials besides the anchor's 64, windows
of frequent anchors between tasks by 128; equal bytes are never missed.

Defined results: null text counts as empty; rows that share an id are one document
(equal repeated rows get equal results, none is earlier than the other); a null id
sorts before all ids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import doc_chunks, mix, stage, utf8
from furrow.llm.suffixes import anchored_runs, lead_word, merged, multikey_order, segments

LENGTH = 100
SAMPLE_DOCS = 2_000           # documents that splitters are drawn from
SAMPLE_ROWS = 50_000
BUCKET_BYTES = 32 << 20       # text a bucket
PART_BYTES = 4 << 20          # text handled at once inside a task
WINDOWS_AT_ONCE = 1 << 17
BLOCK = 8                     # windows of a block
_FIELD = 7                    # bits of (windows - 1) and of the anchor's offset in a packed content

_LEAD = np.uint64(0xFFFFFFFF00000000)     # leading bytes of an anchor; the rest of the word checks contents
_COPY, _PENDING, _OPEN, _OPEN_FIRST, _EDGE = 1, 2, 3, 4, 0


def _suffix_arrays(column, keys: np.ndarray, length: int):
    """(key, first byte, leading word, anchor hash, packed content) of all runs."""
    raw, offsets = utf8(column)
    parts = [[], [], [], [], []]
    for i, a, b, starts in segments(offsets, length):
        piece = raw[a:b]
        first, last, place, gram, content, check = anchored_runs(piece, starts, length)
        doc = i + np.searchsorted(starts, first, "right") - 1
        low = (np.uint64(1) << np.uint64(2 * _FIELD)) - np.uint64(1)
        packed = (content & ~low) | ((last - first).astype(np.uint64) << np.uint64(_FIELD)) | (place - first).astype(np.uint64)
        lead = (lead_word(piece, place) & _LEAD) | (check >> np.uint64(32))     # more of the content below the leading bytes
        for part, x in zip(parts, (keys[doc], first + a - offsets[doc], lead, gram, packed), strict=True):
            part.append(x)
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint64)
    return [np.concatenate(p).astype(t) if p else np.zeros(0, t) for p, t in zip(parts, kinds, strict=True)]


def _parts(batches, text: int):
    """(text column, other columns) in parts of about PART_BYTES of text."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        for a, b in doc_chunks(offsets, PART_BYTES):
            rows = batch.slice(a, b - a)
            yield rows.column(text), [c for i, c in enumerate(rows.columns) if i != text]


def _bucket_of(cuts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of splitters (sorted rows of ``cuts``) not above each row of ``keys``."""
    out = np.searchsorted(cuts[0], keys[0], "left")
    tied = np.flatnonzero(np.searchsorted(cuts[0], keys[0], "right") > out)
    for value in np.unique(keys[0][tied]):
        at = tied[keys[0][tied] == value]
        same = slice(*(int(np.searchsorted(cuts[0], value, side)) for side in ("left", "right")))
        if len(cuts) > 1:
            out[at] += _bucket_of([c[same] for c in cuts[1:]], [k[at] for k in keys[1:]])
        else:
            out[at] += same.stop - same.start
    return out


def _longs(*columns):
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns]


def _suffixes(length: int, cuts: list[np.ndarray] | None, every: int = 1):
    """Arrow function from (key, text) to suffix rows; without ``cuts`` a sample."""

    def emit(batches):
        for column, keys in _parts(batches, 1):
            key, first, lead, gram, content = _suffix_arrays(column, np.asarray(keys[0]), length)
            if cuts is None:
                at = np.flatnonzero(mix(mix(gram ^ content) ^ key.view(np.uint64)) % np.uint64(every) == 0)
                bucket = np.zeros(len(at), np.int64)
            else:
                at = np.arange(len(key))
                bucket = _bucket_of(cuts, [lead & _LEAD, gram, content, key])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32), pa.int32()), *_longs(lead[at], gram[at], content[at], key[at], first[at])],
                names=["bucket", "lead", "gram", "content", "key", "first"])

    return emit


_SUFFIX = "bucket int, lead bigint, gram bigint, content bigint, key bigint, first bigint"


def _sorted_buckets(batches):
    """Sort each bucket and mark its rows: copies, first contents of anchors with
    several, the same in the bucket's first and last anchor (open: neighbours
    decide), and the bucket's two ends."""
    held = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    del held
    for b in np.unique(columns[0]):
        at = np.flatnonzero(columns[0] == b)
        lead, gram, content = (c[at].view(np.uint64) for c in columns[1:4])
        key, first = (c[at] for c in columns[4:])
        lead, check = lead & _LEAD, lead & ~_LEAD
        order = multikey_order([lead, gram, content, check, key, first])
        lead, gram, content, check, key, first = (c[order] for c in (lead, gram, content, check, key, first))
        n = len(order)
        same_anchor, same = np.zeros(n, bool), np.zeros(n, bool)
        same_anchor[1:] = (lead[1:] == lead[:-1]) & (gram[1:] == gram[:-1])
        same[1:] = same_anchor[1:] & (content[1:] == content[:-1]) & (check[1:] == check[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        copy = same & ((key != key[head]) | (first != first[head]))
        group = np.cumsum(~same_anchor) - 1
        contents = np.bincount(group, ~same).astype(np.int64)
        outer = (group == 0) | (group == group[-1])
        kind = np.where(copy, _COPY, -1)
        starts = ~same
        kind[starts & ~outer & (contents[group] > 1)] = _PENDING
        kind[starts & outer] = _OPEN
        if head[0] == 0:
            kind[(head == 0) & ~copy] = _OPEN_FIRST      # continues the bucket before, perhaps
        rows = np.flatnonzero(kind >= 0)
        ends = np.array([0, n - 1])
        full = kind[rows] == _COPY
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((kind[rows], [_EDGE, _EDGE])).astype(np.int8), pa.int8()),
             pa.array(np.full(len(rows) + 2, b, np.int32), pa.int32()),
             *_longs(np.concatenate((np.where(full, 0, lead[rows].view(np.int64)), (lead | check)[ends].view(np.int64))),
                     np.concatenate((np.where(full, 0, gram[rows].view(np.int64)), gram[ends].view(np.int64))),
                     np.concatenate((np.where(full, (content[rows] & np.uint64((1 << 2 * _FIELD) - 1)).view(np.int64),
                                              content[rows].view(np.int64)), content[ends].view(np.int64))),
                     np.concatenate((key[rows], contents[group[ends]])),
                     np.concatenate((first[rows], [0, 1])))],
            names=["kind", "bucket", "lead", "gram", "content", "key", "first"])


def _settled(marked: DataFrame) -> DataFrame:
    """The rows of the buckets' outer anchors, decided: a bucket's first content that began in
    an earlier bucket is a copy; contents of an anchor with several are pending (``wide``: the
    anchor spans buckets); the only content of an anchor needs nothing."""
    anchor = (F.col("lead").bitwiseAND(F.lit(int(_LEAD) - (1 << 64)))).alias("lead"), "gram"
    ends = marked.where(F.col("kind") == _EDGE).select(
        "bucket", "first", *anchor, F.struct("content", F.col("lead").bitwiseAND(F.lit(int(~_LEAD))).alias("check")).alias("whole"),
        F.col("key").alias("contents"))
    heads = ends.where("first = 0").drop("first")
    tails = ends.where("first = 1").select((F.col("bucket") + 1).alias("bucket"), F.col("lead").alias("tlead"), F.col("gram").alias("tgram"),
                                           F.col("whole").alias("twhole"), F.col("contents").alias("tcontents"))
    over = heads.join(tails, "bucket").where("lead = tlead AND gram = tgram")
    over = stage(over.select("bucket", "lead", "gram", (F.col("whole") == F.col("twhole")).alias("continued"),
                             ((F.col("contents") > 1) | (F.col("tcontents") > 1) | (F.col("whole") != F.col("twhole"))).alias("many")), "ends")
    outer = (ends.select("lead", "gram", (F.col("contents") > 1).alias("many"), F.lit(False).alias("wide"))
             .unionByName(over.select("lead", "gram", "many", F.lit(True).alias("wide")))
             .groupBy("lead", "gram").agg(F.max("many").alias("many"), F.max("wide").alias("wide")))
    rows = (marked.where(F.col("kind").isin(_OPEN, _OPEN_FIRST)).join(outer, ["lead", "gram"])
            .join(over.where("continued").select("bucket", F.lit(True).alias("continued")), "bucket", "left"))
    copy = (F.col("kind") == _OPEN_FIRST) & F.coalesce("continued", F.lit(False))
    none = F.lit(0).cast("bigint")
    return rows.where(copy | F.col("many")).select(
        F.when(copy, F.lit(_COPY)).otherwise(F.lit(_PENDING)).cast("tinyint").alias("kind"),
        F.when(copy, none).otherwise(F.col("lead")).alias("lead"), F.when(copy, none).otherwise(F.col("gram")).alias("gram"),
        F.when(copy, F.col("content").bitwiseAND(F.lit((1 << 2 * _FIELD) - 1))).otherwise(F.col("content")).alias("content"),
        "key", "first", "wide")


def _removed(text: bytes, start: np.ndarray, stop: np.ndarray):
    """(bytes removed, runs, hash of the rest)."""
    start, stop = merged(start, np.minimum(stop, len(text)))
    rest, at = hashlib.sha256(), 0
    for a, b in zip(start, stop, strict=True):
        rest.update(text[at:a])
        at = b
    rest.update(text[at:])
    return int((stop - start).sum()), len(start), rest.hexdigest()


_RESULT = "id bigint, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_JUDGED = ("part tinyint, " + _RESULT + ", first bigint, lead bigint, gram bigint, content bigint, wide boolean, bytes binary, ranges array<bigint>")


def _judge(length: int):
    """Arrow function over (id, key, text, copies, pending): the result where no
    window is open (part 0), else the covered ranges (part 2) and the bytes of each
    pending run (part 1)."""

    def judge(batches):
        for column, rest in _parts(batches, 2):
            raw, offsets = utf8(column)
            data = raw.tobytes()
            ids, keys, copies, pending = (c.to_pylist() for c in rest)
            out = []
            for i, (id_, key) in enumerate(zip(ids, keys, strict=True)):
                text = data[offsets[i]:offsets[i + 1]]
                spans = np.array(copies[i] or [], np.int64)
                start = spans >> _FIELD
                stop = start + (spans & ((1 << _FIELD) - 1)) + length
                if not pending[i]:
                    n, runs, digest = _removed(text, start, stop)
                    out.append({"part": 0, "id": id_, "key": key, "n_bytes": len(text), "n_removed": n, "n_spans": runs,
                                "kept_sha256": digest})
                    continue
                start, stop = merged(start, stop)
                out.append({"part": 2, "key": key, "ranges": np.column_stack((start, stop)).ravel().tolist()})
                for p in pending[i]:
                    windows = ((p["content"] >> _FIELD) & ((1 << _FIELD) - 1)) + 1
                    out.append({"part": 1, "key": key, "first": p["first"], "lead": p["lead"], "gram": p["gram"],
                                "content": p["content"], "wide": p["wide"], "bytes": text[p["first"]:p["first"] + windows + length - 1]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("part", pa.int8()), ("id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("first", pa.int64()), ("lead", pa.int64()),
                 ("gram", pa.int64()), ("content", pa.int64()), ("wide", pa.bool_()), ("bytes", pa.binary()), ("ranges", pa.list_(pa.int64()))]))

    return judge


def _windows_of(bytes_: list[bytes], length: int):
    """(run, offset, windows x length bytes) of all windows of the runs."""
    size = np.array([len(b) - length + 1 for b in bytes_], np.int64)
    size = np.maximum(size, 0)
    run = np.repeat(np.arange(len(bytes_)), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat = np.frombuffer(b"".join(bytes_), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(b) for b in bytes_])))[:-1]
    view = np.lib.stride_tricks.sliding_window_view(flat, length) if len(flat) >= length else np.zeros((0, length), np.uint8)
    return run, offset, view[base[run] + offset]


def _local_windows(length: int):
    """Arrow function over runs partitioned by anchor: (key, first, n) of windows
    that also start earlier, found by sorting the windows' bytes."""

    def find(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key, first, lead, gram, content = (table[c].to_numpy() for c in ("key", "first", "lead", "gram", "content"))
        order = multikey_order([lead, gram, key, first])
        texts = table["bytes"].combine_chunks()
        new = np.ones(len(order), bool)
        new[1:] = (lead[order[1:]] != lead[order[:-1]]) | (gram[order[1:]] != gram[order[:-1]])
        group, bounds = np.cumsum(new), np.append(np.flatnonzero(new), len(order))
        a = 0
        per_run = 64
        while a < len(bounds) - 1:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + WINDOWS_AT_ONCE // per_run, "right")) - 1)
            rows = order[bounds[a]:bounds[b]]
            run, offset, window = _windows_of(texts.take(pa.array(rows)).to_pylist(), length)
            aim = (content[rows] & ((1 << _FIELD) - 1))[run] - offset + (1 << _FIELD)
            padded = np.zeros((len(run), -(-length // 8) * 8), np.uint8)
            padded[:, :length] = window
            words = padded.view(">u8").astype(np.uint64)
            place = group[bounds[a]:bounds[b]][run] * (1 << (_FIELD + 2)) + aim
            of, at = key[rows][run], first[rows][run] + offset
            by = multikey_order([place, *words.T, of, at])
            same = np.zeros(len(by), bool)
            same[1:] = (place[by[1:]] == place[by[:-1]]) & (words[by[1:]] == words[by[:-1]]).all(axis=1)
            head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
            late = np.zeros(len(by), bool)
            late[by] = same & ((of[by] != of[head]) | (at[by] != at[head]))
            begins = late.copy()
            begins[1:] &= ~(late[:-1] & (run[1:] == run[:-1]))
            begin = np.flatnonzero(begins)
            count = np.diff(np.append(np.cumsum(late)[begin] - 1, late.sum()))
            yield pa.RecordBatch.from_arrays(_longs(of[begin], at[begin], count), names=["key", "first", "n"])
            a = b

    return find


def _hashes(rows: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    h1, h2 = seed.copy(), mix(seed)
    for j in range(rows.shape[1]):
        x = rows[:, j].astype(np.uint64) + np.uint64(1)
        h1 = h1 * np.uint64(0x9E3779B97F4A7C15) + x
        h2 = mix(h2 ^ x) if j % 8 == 0 else h2 * np.uint64(0xD6E8FEB86659FD93) + x
    return mix(h1), mix(h2)


def _anchor_seed(batch) -> np.ndarray:
    lead, gram = (np.asarray(batch.column(c)).view(np.uint64) for c in ("lead", "gram"))
    return mix(mix(gram) ^ lead)


def _cores(length: int):
    """Arrow function over runs of spanning anchors: a row for each block of windows, with the
    hashes of the block's core and its place at the anchor."""
    size = length - BLOCK + 1

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            content = np.asarray(batch.column("content"))
            place, windows = content & ((1 << _FIELD) - 1), ((content >> _FIELD) & ((1 << _FIELD) - 1)) + 1
            least, most = (place - windows + 1) // BLOCK, place // BLOCK         # a window's place: anchor less start
            n = most - least + 1
            run = np.repeat(np.arange(len(n)), n)
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[run]
            texts = batch.column("bytes").to_pylist()
            flat = np.frombuffer(b"".join(texts), np.uint8)
            base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
            core = np.lib.stride_tricks.sliding_window_view(flat, size)[base[run] + place[run] - block * BLOCK]
            h1, h2 = _hashes(core, _anchor_seed(batch)[run] + block.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*_longs(h1, h2), *(batch.column(c).take(pa.array(run)) for c in _RUN), pa.array(block.astype(np.int32))],
                names=["h1", "h2", *_RUN, "block"])

    return emit


_RUN = ["key", "first", "lead", "gram", "content"]


def _shared_windows(length: int):
    """Arrow function over runs with the blocks whose core another run has: windows that
    repeat an earlier one of the same task (h1 = h2 = 0, n of them in a row), and the others
    with their hashes (n = 0)."""

    def find(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, WINDOWS_AT_ONCE // 64):
                rows = batch.slice(a, WINDOWS_AT_ONCE // 64)
                key, first, content, blocks = (np.asarray(rows.column(c)) for c in ("key", "first", "content", "blocks"))
                run, offset, window = _windows_of(rows.column("bytes").to_pylist(), length)
                place = (content & ((1 << _FIELD) - 1))[run] - offset
                open_ = (blocks[run] >> (place // BLOCK)) & 1 == 1
                run, offset, window, place = run[open_], offset[open_], window[open_], place[open_]
                if not len(run):
                    continue
                padded = np.zeros((len(run), -(-length // 8) * 8), np.uint8)
                padded[:, :length] = window
                words = padded.view(">u8").astype(np.uint64)
                of, at = key[run], first[run] + offset
                by = multikey_order([place, *words.T, of, at])
                same = np.zeros(len(by), bool)
                same[1:] = (place[by[1:]] == place[by[:-1]]) & (words[by[1:]] == words[by[:-1]]).all(axis=1)
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
                late = np.zeros(len(by), bool)
                late[by] = same & ((of[by] != of[by[head]]) | (at[by] != at[by[head]]))
                begins = late.copy()
                begins[1:] &= ~(late[:-1] & (run[1:] == run[:-1]) & (offset[1:] == offset[:-1] + 1))
                begin = np.flatnonzero(begins)
                count = np.diff(np.append(np.cumsum(late)[begin] - 1, late.sum()))
                lead = by[~same]                                            # the first of each window
                h1, h2 = _hashes(window[lead], _anchor_seed(rows)[run[lead]] + place[lead].astype(np.uint64))
                none = np.zeros(len(begin), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    _longs(np.concatenate((none, h1)), np.concatenate((none, h2)), np.concatenate((of[begin], of[lead])),
                           np.concatenate((at[begin], at[lead])), np.concatenate((count, np.zeros(len(lead), np.int64)))),
                    names=["h1", "h2", "key", "first", "n"])

    return find


def _wide_repeats(runs: DataFrame, length: int) -> DataFrame:
    """(key, first, n): windows of spanning anchors' runs that also start earlier."""
    types = ", ".join(f"{c} bigint" for c in _RUN)
    cores = stage(runs.mapInArrow(_cores(length), f"h1 bigint, h2 bigint, {types}, block int"), "cores")
    shared = cores.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    blocks = (cores.join(shared, ["h1", "h2"]).groupBy(*_RUN)
              .agg(F.bit_or(F.expr("shiftleft(1L, block)")).alias("blocks")))
    windows = stage(runs.join(blocks, _RUN).mapInArrow(
        _shared_windows(length), "h1 bigint, h2 bigint, key bigint, first bigint, n bigint"), "windows")
    firsts = windows.where("n = 0")
    least = firsts.groupBy("h1", "h2").agg(F.min(F.struct("key", "first")).alias("least"))
    far = (firsts.join(least, ["h1", "h2"]).where(F.struct("key", "first") > F.col("least"))
           .select("key", "first", F.lit(1).cast("bigint").alias("n")))
    return far.union(windows.where("n > 0").select("key", "first", "n"))


def _splitters(texts: DataFrame, n_docs: int, buckets: int, length: int) -> list[np.ndarray]:
    if buckets < 2 or not n_docs:
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64)]
    sample = (texts.sample(min(1.0, SAMPLE_DOCS / n_docs), 7).limit(2 * SAMPLE_DOCS)
              .mapInArrow(_suffixes(length, None, every=8), _SUFFIX).limit(SAMPLE_ROWS).collect())
    rows = [np.array([r[c] for r in sample], np.int64) for c in ("lead", "gram", "content", "key")]
    rows = [r.view(np.uint64) for r in rows[:3]] + rows[3:]
    rows[0] &= _LEAD
    order = multikey_order(rows)
    picks = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    cuts = np.array(list(dict.fromkeys(zip(*(r[picks].tolist() for r in rows), strict=True))), object).reshape(-1, 4).T
    return [c.astype(r.dtype) for c, r in zip(cuts, rows, strict=True)]      # each a row of the data, none twice


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    ``id_col`` holds integers. ``length`` lies between 40 and 128 bytes.
    """
    if not 40 <= length <= 128:
        raise ValueError("length must lie between 40 and 128")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size["b"] or 0) // BUCKET_BYTES + 1)
    keyed = texts.select("key", "text")
    cuts = _splitters(keyed, size["n"], buckets, length)
    marked = stage(keyed.mapInArrow(_suffixes(length, cuts), _SUFFIX).repartitionById(buckets, "bucket")
                   .mapInArrow(_sorted_buckets, "kind tinyint, " + _SUFFIX), "suffixes")
    sure = marked.where(F.col("kind").isin(_COPY, _PENDING)).withColumn("wide", F.lit(False))
    opened = _settled(marked)
    rows = sure.select(*opened.columns).union(opened)
    low = (1 << 2 * _FIELD) - 1
    span = F.shiftleft("first", _FIELD) + F.shiftright(F.col("content").bitwiseAND(F.lit(low)), _FIELD)
    lists = rows.groupBy("key").agg(
        F.collect_list(F.when(F.col("kind") == _COPY, span)).alias("copies"),
        F.collect_list(F.when(F.col("kind") == _PENDING, F.struct("first", "lead", "gram", "content", "wide"))).alias("pending"))
    judged = stage(texts.join(lists, "key", "left").select("id", "key", "text", "copies", "pending")
                   .mapInArrow(_judge(length), _JUDGED), "judged")
    runs = judged.where("part = 1").select(*_RUN, "wide", "bytes").distinct()
    near = (runs.where("NOT wide").drop("wide").repartition(buckets, "lead", "gram")
            .mapInArrow(_local_windows(length), "key bigint, first bigint, n bigint"))
    far = _wide_repeats(runs.where("wide").drop("wide"), length)
    found = near.union(far).groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("found"))
    last = (texts.join(judged.where("part = 2").select("key", "ranges").dropDuplicates(["key"]), "key").join(found, "key", "left")
            .select("id", "key", "text", "ranges", "found").mapInArrow(_finish(length), _RESULT))
    out = judged.where("part = 0").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(
        last.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return out.withColumnRenamed("id", id_col)


def _finish(length: int):
    """Arrow function over (id, key, text, ranges, found): the results."""

    def finish(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            data = raw.tobytes()
            out = []
            for i, (ranges, found) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                done = np.array(ranges or [], np.int64).reshape(-1, 2)
                more = np.array([(f["first"], f["first"] + f["n"] - 1 + length) for f in found or []], np.int64).reshape(-1, 2)
                spans = np.concatenate((done, more))
                text = data[offsets[i]:offsets[i + 1]]
                out.append((len(text), *_removed(text, spans[:, 0], spans[:, 1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([o[j] for o in out], pa.int64()) for j in range(3)),
                 pa.array([o[3] for o in out], pa.string())],
                names=["id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return finish


# For tables whose ids are unique and not null; bytes as two hex digits each.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunk AS (                       -- 100 window starts each
  SELECT doc_id, j, substr(h, CAST(200 * j + 1 AS BIGINT), 398) AS c
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0), 100)) // 100 AS j FROM d)),
w AS (
  SELECT doc_id, 100 * j + k AS s, md5_number(substr(c, CAST(2 * k + 1 AS BIGINT), 200)) AS win
  FROM (SELECT doc_id, j, c, unnest(range(0, least(100, len(c) // 2 - 99))) AS k FROM chunk)),
late AS (                        -- windows that start earlier, too
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
run AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS r
        FROM (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, true) AS new FROM late))
  GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM run
  UNION ALL SELECT d.doc_id, len(any_value(h)) // 2, coalesce(max(b), 0) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id),
rest AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)), '' ORDER BY start, stop) AS h
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN total USING (doc_id)
"""
