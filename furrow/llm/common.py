"""Small helpers shared by the document operators: Arrow columns as NumPy byte
arrays, byte-balanced chunks, vectorised word and shingle hashes, and tables
staged in the cluster's shared folder."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from furrow.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20     # text handled at once inside a task (whole documents)
PART_BYTES = 4 << 20      # text of an Arrow batch handled at once
BLOCK_BYTES = 1 << 18     # bytes hashed at once, whatever the document's length
SHINGLE_WORDS = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Word bytes after lower-casing A-Z. Every byte of a non-ASCII character is >= 0x80,
# so byte classes equal the character classes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def stage(df: DataFrame, keep: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder that
    ``spark.checkpoint.dir`` names, and read it back. Shuffle files of steps that
    nothing refers to any more are released, so only the last step's take disk."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{keep}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()       # Spark's cleaner follows the driver's garbage collection
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        spark = df.sparkSession
        jvm = spark._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns, name: str) -> str:
    """``name``, with underscores added until no column has it (names don't differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) row ranges of about ``limit`` bytes, whole documents."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def parts(batches, text: int, limit: int = PART_BYTES):
    """The Arrow batches cut into parts of about ``limit`` bytes in column ``text``, so
    that what a task makes of a part stays small whatever the batches hold."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        for a, b in doc_chunks(offsets, limit):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x ^= x >> np.uint64(33)
    x *= _C2
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, cache={"p": np.ones(1, np.uint64)}) -> np.ndarray:  # noqa: B006
    if len(cache["p"]) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        cache["p"] = np.cumprod(steps, dtype=np.uint64)
    return cache["p"]


class Words:
    """Words of a run of documents: byte ``start``/``end``, ``hash`` (64 bit, of
    the lower-cased bytes) and ``first``: index of each document's first word
    (one more entry than documents)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        low = LOWER[raw]
        inside = table[low]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(low)

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        done = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(len(size), np.uint64)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(done, done[a] + BLOCK_BYTES, "right")) - 1)
            at = (done[a:b] - done[a]).astype(np.int64)
            within = np.arange(done[b] - done[a]) - np.repeat(at, size[a:b])
            chars = low[within + np.repeat(self.start[a:b], size[a:b])].astype(np.uint64)
            chars += np.uint64(1)
            chars *= _powers(int(size[a:b].max()))[within]
            out[a:b] = np.add.reduceat(chars, at)
            a = b
        return mix(out ^ (size.astype(np.uint64) * _STEP))


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h`` (len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j:j + n]
    return mix(acc ^ np.uint64(k))


def shingles(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingle hashes of one document's word hashes, in order; a document of
    fewer than ``k`` words (but not none) is one shingle."""
    return runs_hash(h, min(k, len(h))) if len(h) else h


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())
