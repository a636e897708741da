"""Operator 2: quality classifier, boosted trees over document statistics.

``statistics`` turns each whole text into numbers (sizes, character classes, each
ASCII mark's share, repetition of words, word runs and lines). The trees are
fitted on a bounded sample, the ``TRAIN_ROWS`` labelled rows of least id hash, and
sent to the tasks as flat arrays that NumPy traverses for all rows at once.

Defined results: null text counts as empty; empty texts get the score of their
statistics; an id with several labels counts as 1 if any is 1; null ids, null
labels and labels without a document are not learned from; without usable labels
every score is the constant 0.5; repeated rows each give a row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.boosting import BoostedTrees, fit_boosted
from furrow.llm.common import NOT_SPACE, Words, doc_chunks, parts, runs_hash, utf8

TRAIN_ROWS = 20_000

# Byte classes: lower, upper, digit, blank, line end, control, lead and inner bytes
# of other characters, and each ASCII mark for itself.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_N_CLASSES = 8 + len(_MARKS)
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 6, 7
_CLASS[_MARKS] = 8 + np.arange(len(_MARKS))

_EXTRA = 14
N_FEATURES = _N_CLASSES + _EXTRA


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) for a run of whole documents."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(doc * _N_CLASSES + _CLASS[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(np.float64)
    lines = share[:, 4] + 1
    share /= np.maximum(size, 1)[:, None]
    w = Words(raw, offsets, NOT_SPACE)
    n_words = np.diff(w.first).astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    ends = raw[w.end - 1] if len(w.end) else raw[:0]
    extra = np.zeros((n, _EXTRA))
    extra[:, 0], extra[:, 1], extra[:, 2] = np.log1p(size), np.log1p(n_words), np.log1p(lines)
    extra[:, 3] = n_words / lines
    of = np.repeat(np.arange(n), np.diff(w.first))
    many = np.maximum(n_words, 1)
    extra[:, 4] = np.bincount(of, length, n) / many
    extra[:, 5] = np.bincount(of, length ** 2, n) / many - extra[:, 4] ** 2
    marked = _CLASS[ends] >= 8
    extra[:, 6] = np.bincount(of, marked, n) / many
    alone = (length == 1) & marked
    extra[:, 7] = np.bincount(of, alone, n) / many
    same = np.zeros(len(of))
    if len(of) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    extra[:, 8] = np.bincount(of, same, n) / many
    pairs, runs = runs_hash(w.hash, 2), runs_hash(w.hash, 5)
    for i in range(n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b == a:
            continue
        counts = np.unique(w.hash[a:b], return_counts=True)[1]
        extra[i, 9], extra[i, 10] = len(counts) / (b - a), counts.max() / (b - a)
        p = counts / (b - a)
        extra[i, 11] = -(p * np.log(p)).sum()
        extra[i, 12] = len(np.unique(pairs[a:b - 1])) / max(b - a - 1, 1)
        extra[i, 13] = len(np.unique(runs[a:b - 4])) / max(b - a - 4, 1)
    return np.column_stack((share, extra))


def _batch_statistics(column) -> np.ndarray:
    raw, offsets = utf8(column)
    rows = [statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in doc_chunks(offsets)]
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Fit on at most ``train_rows`` labelled documents. ``labels`` holds only rows
    that may be learned from."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
              .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(train_rows))
    # At most train_rows short rows: a proven size.
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .join(F.broadcast(chosen), "_id"))

    def measure(batches):
        for batch in parts(batches, 1):
            x = _batch_statistics(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()),
                 pa.array(list(x), pa.list_(pa.float32()))], names=["id", "label", "x"])

    seen = (rows.mapInArrow(measure, "id string, label int, x array<float>").dropDuplicates(["id"])
            .orderBy("id").collect())
    x = np.array([r["x"] for r in seen], np.float64).reshape(len(seen), N_FEATURES)
    return fit_boosted(x, np.array([r["label"] for r in seen], np.float64))


def score_quality(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""

    def score(batches):
        for batch in parts(batches, 1):
            x = _batch_statistics(batch.column(1)).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())],
                                             names=[id_col, "score"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(score, schema)
