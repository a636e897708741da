"""Operator 13: token ids of whole texts in Arrow files.

Texts are dealt by ranges of ids, in ascending order; each task encodes its texts and
writes one file: the Arrow stream of record batches with the footer that tells their
places. A row of a batch is a sequence of ``length`` ids and its mask, both fixed-size
lists, so sequence i is row ``i % BATCH_ROWS`` of batch ``i // BATCH_ROWS``, read without
a copy from a memory map. Ids follow each other across documents (each ends with the
end id) and across sequences; only a file's last sequence is padded (mask false).

``write_token_files`` returns the index: a row a document with its file and the place of
its first id there. Files that a lost or repeated task left are in no index row, so they
are never read. ``read_token_files`` goes by the index and gives each document's ids,
``digest_token_files`` their length and CRC-32.

Encoding: where a vocabulary drops white space and never joins letters, ASCII marks and digits
(``apart``, read from its file), texts are cut there, and each distinct piece of a batch is
encoded by the library once; a bounded table keeps pieces between batches. Other
vocabularies encode whole texts.

Defined results: null text counts as empty (the end id alone); rows of equal id are next
to each other, by text hash; null ids come first; repeated rows each give a row; an empty
table gives an empty index and no file; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import LOWER, parts, stage, utf8
from furrow.session import ensure_checkpoint_dir

LENGTH = 2048             # ids of a sequence
BATCH_ROWS = 64           # sequences of a record batch
SHARD_BYTES = 64 << 20    # text of a file
SHARDS_A_BLOCK = 1000
KEPT_PIECES = 1 << 19     # pieces whose ids a worker keeps
PIECE_BYTES = 64          # longer pieces aren't kept
JOINED = 500              # words encoded at once
PART_BYTES = 2 << 20      # text encoded at once

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
# Classes of bytes: letters 1, marks 2, digits 4, blanks 8, others 0 (also ' < | >, which join
# letters). Places are cut beside blanks, between digits and between two of the first three.
_BLANK = 8
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[np.frombuffer(b".,;:!?\"#$%&()*+-/=@[\\]^_`{}~", np.uint8)] = 2
_CLASS[0x30:0x3A] = 4
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_CUT = np.array([_BLANK in (a, b) or 0 not in (a, b) and (a != b or a == 4) for a in range(16) for b in range(16)])
_PATTERN = re.compile(r"(?:'\w+\|)*(\[?)\\p\{L\}(\]?)\+\|(\[?)\\p\{N\}(\]?)\|\[\^\\s\\p\{L\}\\p\{N\}\]\+")


def _cuts(kind: np.ndarray) -> np.ndarray:
    """Whether tokens never join the bytes on both sides, for each place between bytes of these classes."""
    return _CUT[kind[:-1] << 4 | kind[1:]]


def apart(vocabulary: dict) -> bool:
    """Whether the vocabulary file says that white space is dropped, letters are lower-cased
    and runs of letters, single digits and runs of marks are tokens of their own."""
    normal, cut = vocabulary.get("normalizer") or {}, vocabulary.get("pre_tokenizer") or {}
    first = (cut.get("pretokenizers") or [cut])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    added = [t["content"] for t in vocabulary["added_tokens"]]
    return (any(n.get("type") == "Lowercase" for n in normal.get("normalizers", [normal]))
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and _PATTERN.fullmatch(pattern) is not None
            and vocabulary["model"].get("end_of_word_suffix") is not None
            and not any(t.strip("<|>").isspace() or not t.startswith("<") or _cuts(_CLASS[np.frombuffer(t.encode(), np.uint8)]).any() for t in added))


class Encoder:
    """Ids of texts by the tokenizers library, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.size = self.library.get_vocab_size()
        self.apart = apart(vocabulary)
        if self.apart:
            suffix = vocabulary["model"]["end_of_word_suffix"]
            self.last = np.zeros(self.size, dtype=bool)
            self.last[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, numbers of ids), in parts, of words of letters only: joined by blanks, cut
        after each id that ends a word."""
        out, sizes = [], []
        groups = [words[a:a + JOINED] for a in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            # Each word gives one end at least, so equal numbers mean exactly one each.
            if len(ends) == len(group) and ends[-1] == len(ids):
                out.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                found = self._whole(group)
                out += found
                sizes.append(np.array([len(f) for f in found], np.int64))
        return out, sizes

    def _places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def _learn(self, pieces: list[str]) -> bool:
        """Whether the table was cleared before it took the pieces."""
        full = len(self.known) > KEPT_PIECES
        if full:
            self._clear()
        words = [p for p in pieces if p.isalpha()]
        rest = [p for p in pieces if not p.isalpha()]
        found, sizes = self._words(words)
        others = self._whole(rest)
        sizes.append(np.array([len(f) for f in others], np.int64))
        n = len(self.known)
        self.known.update(zip(words + rest, range(n, n + len(pieces)), strict=True))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))))
        self.ids = np.concatenate((self.ids, *found, *others))
        return full

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end) of an Arrow column of texts."""
        raw, offsets = utf8(column)
        if not self.apart:
            found = self._whole([t or "" for t in column.to_pylist()])
            return np.concatenate((np.zeros(0, np.uint32), *found)), np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[raw]
        cut = np.empty(len(raw) + 1, dtype=bool)
        cut[1:-1] = _cuts(kind)
        cut[offsets] = cut[0] = cut[-1] = True
        edge = np.flatnonzero(cut)
        filled = kind[edge[:-1]] != _BLANK                # pieces of one blank hold nothing
        start = edge[:-1][filled]
        cuts = np.concatenate(([0], np.cumsum(np.diff(edge)[filled])))
        kept, angle = raw[kind != _BLANK], raw == 0x3C
        if len(start) and angle.any():                   # added tokens begin so and keep their case
            fold = _UPPER[kept] & ~np.repeat(np.add.reduceat(angle, start) > 0, np.diff(cuts))
            kept[fold] += 32
        else:
            kept = LOWER[kept]
        data = pa.py_buffer(kept)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts.astype(np.int64)), data).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._places(pieces)
        new = np.flatnonzero(at < 0).tolist()
        fresh = [p for p in map(pieces.__getitem__, new) if len(p) <= PIECE_BYTES]
        if fresh:
            if self._learn(fresh):
                at = self._places(pieces)
                new = np.flatnonzero(at < 0).tolist()
            else:
                at[new] = self._places([pieces[i] for i in new])
        first, ids = self.first, self.ids
        missing = [i for i in new if at[i] < 0]           # long ones, and all others if the table was just cleared
        if missing:
            found = self._whole([pieces[i] for i in missing])
            at[missing] = len(first) - 1 + np.arange(len(missing))
            first = np.concatenate((first, first[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)))
            ids = np.concatenate((ids, *found))
        at = at[coded.indices.to_numpy()]
        size = first[at + 1] - first[at]
        done = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.arange(done[-1], dtype=np.int32) + np.repeat((first[at] - done[:-1]).astype(np.int32), size)]
        return out, done[np.searchsorted(start, offsets)]


def _encoder(path: str, cache: dict = {}) -> Encoder:  # noqa: B006
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


class TokenWriter:
    """One file of sequences."""

    def __init__(self, path: str, kind: pa.DataType, length: int):
        files, name = pa.fs.FileSystem.from_uri(path)
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(name)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        batch = self.length * BATCH_ROWS
        if self.held >= batch:
            flat = np.concatenate(self.waiting)
            for a in range(0, len(flat) - batch + 1, batch):
                self._batch(flat[a:a + batch], batch)
            self.waiting = [flat[len(flat) // batch * batch:]]
            self.held = len(self.waiting[0])

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(n) < len(ids)
        ids = np.concatenate((ids, np.zeros(n - len(ids), ids.dtype)))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v, t), self.length) for v, t in ((ids, self.kind), (mask, pa.bool_()))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.written += n

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.waiting), -(-self.held // self.length) * self.length)
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of one file; views of a memory map where the file is local."""

    def __init__(self, path: str):
        files, name = pa.fs.FileSystem.from_uri(path)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else files.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = (-1, None)

    def _column(self, batch: int, name: str):
        if self.batch[0] != batch:
            self.batch = (batch, self.file.get_batch(batch))
        return self.batch[1].column(name)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``."""
        batch, row = divmod(i, BATCH_ROWS)
        ids, mask = (self._column(batch, c).values.slice(row * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def spans(self, first: int, n: int):
        """Views of the ids from ``first`` on, ``n`` in all, batch by batch."""
        width = self.length * BATCH_ROWS
        while n > 0:
            batch, at = divmod(first, width)
            view = self._column(batch, "ids").values.slice(at, n).to_numpy()
            yield view
            first, n = first + len(view), n - len(view)

    def close(self) -> None:
        self.source.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of every row of ``docs`` in ascending order of ``id_col``, each text's
    followed by ``end_id``; the index (id, n_tokens, shard, file, first) as a staged table.

    ``folder``: a folder that all executors share, any store that Arrow opens; else one in
    ``spark.checkpoint.dir``. Files hold about ``shard_bytes`` of text each."""
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), spark.sparkContext.defaultParallelism)
    # The last key only spreads rows that are equal in the others.
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = texts.repartitionByRange(shards, *keys).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches):
        encode, writer, place = _encoder(tokenizer_path), None, 0
        narrow = max(encode.size, end_id + 1) <= 1 << 16
        number = np.uint16 if narrow else np.uint32
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex}.arrow"
        for batch in parts(batches, 1, PART_BYTES):
            if writer is None:
                files, name = pa.fs.FileSystem.from_uri(folder)
                files.create_dir(name, recursive=True)
                writer = TokenWriter(path, pa.uint16() if narrow else pa.uint32(), length)
            ids, first = encode(batch.column(1))
            ids = np.insert(ids.astype(number), first[1:], number(end_id))
            writer.add(ids)
            n = np.diff(first) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.full(len(n), shard), pa.int64()),
                 pa.array([path] * len(n), pa.string()), pa.array(place + np.cumsum(n) - n, pa.int64())],
                names=["id", "n_tokens", "shard", "file", "first"])
            place += len(ids)
        if writer is not None:
            writer.close()

    kind = texts.schema["id"].dataType.simpleString()
    return stage(dealt.mapInArrow(write, f"id {kind}, n_tokens bigint, shard bigint, file string, first bigint"), "token-index")


def _started(index: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before; sums within blocks of shards, then of blocks."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / SHARDS_A_BLOCK))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (sums.withColumn("before", before).join(blocks.select("block", above.alias("above")), "block")
            .select("shard", (F.col("before") + F.col("above")).alias("base")))


def _read(index: DataFrame, make, out: pa.DataType, sql_type: str, name: str) -> DataFrame:
    """``make`` of each document's spans, from the files; (id, start, n_tokens, ``name``)."""
    def read(batches):
        opened, path = None, None
        for batch in batches:
            values = []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                if file != path:
                    if opened:
                        opened.close()
                    opened, path = TokenFile(file), file
                values.append(make(opened.spans(first, n)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "shard", "first", "n_tokens")] + [pa.array(values, out)],
                                             names=["id", "shard", "first", "n_tokens", "value"])

    files = index.agg(F.count_distinct("file")).first()[0]
    kind = index.schema["id"].dataType.simpleString()
    rows = index.repartitionByRange(max(files, 1), "shard", "first").sortWithinPartitions("file", "first")
    rows = rows.mapInArrow(read, f"id {kind}, shard bigint, first bigint, n_tokens bigint, value {sql_type}")
    return (rows.join(_started(index), "shard")
            .select("id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", F.col("value").alias(name)))


def _crc32(spans) -> int:
    crc = 0
    for span in spans:
        crc = zlib.crc32(span.astype("<u4").tobytes(), crc)
    return crc


def digest_token_files(index: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every indexed document, from the files:
    ``start`` counts the ids of all documents before it, the CRC-32 is of its ids as
    little-endian unsigned 32-bit integers."""
    return _read(index, _crc32, pa.int64(), "bigint", "ids_crc32")


def read_token_files(index: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every indexed document, from the files."""
    return _read(index, lambda spans: np.concatenate(list(spans)).astype(np.int32), pa.list_(pa.int32()), "array<int>", "ids")
