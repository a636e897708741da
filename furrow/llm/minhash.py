"""Operator 7: near-duplicate documents by circulant MinHash.

A document's set holds its distinct word shingles. Two permutations make all
``BANDS * ROWS`` signature coordinates: the first maps shingles to a ring of 2^32
places, the second, shifted circularly by k, gives coordinate k. Documents that
agree in all rows of a band are candidates; a link is confirmed on the full sets
(``100 * intersection >= PERCENT * union``). At the bound a band of 4 rows matches
with probability 0.316, so 32 bands miss a link with probability 5e-6.

Groups are never expanded into all pairs. Documents with equal sets are one class.
First each class is checked against the smallest class of each of its band buckets, and
the links' components are formed. A bucket that then still holds several components has
its members outside its largest component compared with its members of other components
by a longer signature (``LONG`` coordinates, one bit each), in blocks of ``BLOCK`` members
a task (a pair only in the first bucket that its band keys share); pairs that differ in at
most ``FAR`` bits, six standard deviations below the bound, are checked on their full sets
too: first each member's best one, which connects most, then all that are left between
components. So every candidate pair is checked, already connected, or ruled out by its
signature, which loses a link at the bound with probability 1e-9. Links give components by
star contraction.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing; fewer than ``SHINGLE_WORDS`` words are one shingle; repeated rows each give
a row with the same component; a null id is never a component id and never kept; an
empty table gives an empty result; other columns are ignored by ``near_duplicates``
and kept by ``keep_representatives``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import NOT_SPACE, SHINGLE_WORDS, Words, doc_chunks, mix, parts, shingles, stage, utf8
from furrow.llm.components import components

BANDS, ROWS = 32, 4
PERCENT = 75
LONG = 2048
FAR = 346                     # bits that differ at similarity 0.75 (256) and six standard deviations more
BLOCK = 4096
ROUNDS = (1, None)            # best pairs of a member in a block; None: all

_SHIFTS = np.arange(LONG, dtype=np.uint32)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_DIGEST = np.uint64(0xA24BAED4963EE407)


def signature(shingle_set: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes: ``size`` coordinates."""
    ring = (mix(shingle_set) >> np.uint64(32)).astype(np.uint32)        # first permutation: place on the ring
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    block = (1 << 16) // size
    for a in range(0, len(ring), block):
        x = ring[a:a + block, None] + _SHIFTS[:size]                   # circular shifts
        x ^= x >> np.uint32(16)                                        # second permutation: a bijection of 32 bits
        x *= _M1
        x ^= x >> np.uint32(13)
        x *= _M2
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND_SALT.copy()
    for j in range(ROWS):
        key = mix(key ^ rows[:, j])
    return key


def _sets(column):
    """Each document's sorted set of shingle hashes."""
    raw, offsets = utf8(column)
    for a, b in doc_chunks(offsets):
        w = Words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], NOT_SPACE)
        for i in range(b - a):
            yield np.unique(shingles(w.hash[w.first[i]:w.first[i + 1]], SHINGLE_WORDS))


def _sketch(batches):
    for batch in parts(batches, 1):
        n, d1, d2, keys = [], [], [], []
        for s in _sets(batch.column(1)):
            n.append(len(s))
            m = mix(s ^ _DIGEST)
            d1.append(int(m.sum().view(np.int64)))
            d2.append(int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0)
            sig = signature(s)
            keys.append(band_keys(sig).view(np.int64) if len(s) else np.zeros(0, np.int64))
        size = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat, pa.int64()))],
            names=["id", "text_hash", "n", "d1", "d2", "keys"])


def _long(batches):
    """Arrow function from (rep, text_hash, text) to the long signature's bits."""
    for batch in parts(batches, 2):
        bits = [np.packbits(signature(s, LONG).astype(np.uint8) & np.uint8(1)).tobytes() for s in _sets(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())],
                                         names=["rep", "text_hash", "bits"])


def _confirm(batches):
    """Links among (a, b, text_a, text_b), rows of one b next to each other."""
    last_b, set_b = None, None
    for batch in parts(batches, 2):
        b_ids, texts_b = batch.column(1).to_pylist(), batch.column(3)
        keep = []
        for i, set_a in enumerate(_sets(batch.column(2))):
            if b_ids[i] != last_b:
                last_b, set_b = b_ids[i], next(_sets(texts_b.slice(i, 1)))
            both = len(np.intersect1d(set_a, set_b, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(set_a) + len(set_b) - both))
        found = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    """The pairs (a, a_hash, b, b_hash) whose full sets reach the bound."""
    left = texts.select(F.col("id").alias("a"), F.col("text_hash").alias("a_hash"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text_hash").alias("b_hash"), F.col("text").alias("text_b"))
    rows = pairs.join(left, ["a", "a_hash"]).join(right, ["b", "b_hash"])
    return (rows.select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
            .mapInArrow(_confirm, f"a {id_type}, b {id_type}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = stage(texts.select("id", "text", "text_hash").mapInArrow(
        _sketch, f"id {id_type}, text_hash bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"), "sketches")
    classes = stage(rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2")
                    .agg(F.min(F.struct("id", "text_hash")).alias("r"), F.first("keys").alias("keys"))
                    .select("n", "d1", "d2", F.col("r.id").alias("rep"), F.col("r.text_hash").alias("text_hash"), "keys"),
                    "classes")
    banded = classes.select("rep", "text_hash", "n", F.posexplode("keys").alias("band", "key"))
    shared = (banded.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rep", "text_hash", "n")).alias("lead"))
              .where("members > 1").select("key", "lead"))
    members = stage(banded.join(shared, "key"), "members")
    # Only texts of candidate classes are read again.
    wanted = members.select(F.col("rep").alias("id"), "text_hash").distinct()
    texts = texts.join(wanted, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    texts = stage(texts, "texts")
    fits = "a != b AND 4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n)"
    pairs = stage(members.select(F.col("rep").alias("a"), F.col("text_hash").alias("a_hash"), F.col("n").alias("a_n"),
                                 F.col("lead.rep").alias("b"), F.col("lead.text_hash").alias("b_hash"),
                                 F.col("lead.n").alias("b_n"))
                  .where(fits).select("a", "a_hash", "b", "b_hash").distinct(), "pairs")
    links = stage(_verified(pairs, texts, id_type), "links")
    found = stage(components(links, "a", "b"), "components")
    tested = pairs.select("a", "b").union(pairs.select("b", "a"))
    for best in ROUNDS:
        close = stage(_close_pairs(members.drop("lead"), classes, texts, found, id_type, best), "pairs")
        more = not close.where("more").isEmpty()
        close = stage(close.drop("more").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if not close.isEmpty():
            links = stage(links.union(_verified(close, texts, id_type)), "links")
            found = stage(components(links, "a", "b"), "components")
            tested = tested.union(close.select("a", "b")).union(close.select("b", "a"))
        if not more:
            break
    of_class = (classes.select("n", "d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left")
                .select("n", "d1", "d2", F.coalesce("component", "rep").alias("component")))
    out = rows.select("id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _compare(batches, best: int | None):
    """Close pairs of a leader and a probe of other components, in the first band that
    they share, from bucket blocks (key, salt, band, rep, text_hash, n, component, leads,
    probes, keys, bits); at most ``best`` a leader and block (more: there were others)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    key, salt, band, n, leads, probes = (table[c].to_numpy() for c in ("key", "salt", "band", "n", "leads", "probes"))
    rep, text_hash, part = (table[c].to_numpy() for c in ("rep", "text_hash", "component"))
    keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(key), BANDS)
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(key), -1)
    order = np.lexsort((salt, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (salt[order[1:]] != salt[order[:-1]])
    for rows in np.split(order, np.flatnonzero(new)[1:]):
        lead, probe = rows[leads[rows]], rows[probes[rows]]
        step = max(1, (1 << 16) // max(1, len(probe)))
        for at in range(0, len(lead), step):
            some = lead[at:at + step]
            first = (keys[some][:, None, :] == keys[probe][None, :, :]).argmax(axis=2)
            low, high = np.minimum(n[some][:, None], n[probe]), np.maximum(n[some][:, None], n[probe])
            differ = np.bitwise_count(bits[some][:, None, :] ^ bits[probe][None, :, :]).sum(axis=2, dtype=np.int64)
            good = ((differ <= FAR) & (first == band[some][:, None]) & (100 * low >= PERCENT * high)
                    & (part[some][:, None] != part[probe]) & (~leads[probe] | (rep[some][:, None] < rep[probe])))
            more = good.sum(axis=1) > (best or len(probe))
            if best and more.any():
                good[np.arange(len(some))[:, None], np.argsort(np.where(good, differ, LONG), axis=1, kind="stable")[:, best:]] = False
            x, y = np.nonzero(good)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[probe[y]]), pa.array(text_hash[probe[y]]), pa.array(rep[some[x]]), pa.array(text_hash[some[x]]),
                 pa.array(more[x])], names=["a", "a_hash", "b", "b_hash", "more"])



def _close_pairs(members: DataFrame, classes: DataFrame, texts: DataFrame, found: DataFrame, id_type: str,
                 best: int | None) -> DataFrame:
    """Close pairs between the components that still share a bucket. A pair of them has
    a side outside the bucket's largest component; those sides lead."""
    rows = members.join(found, F.col("rep") == F.col("node"), "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep")).drop("node")
    by_part = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = (by_part.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("top"),
                                        F.ceil(F.sum("size") / BLOCK).alias("blocks"))
             .where("parts > 1").select("key", F.col("top.component").alias("largest"), "blocks"))
    rows = stage(rows.join(mixed, "key").withColumn("lead", F.col("component") != F.col("largest")), "mixed")
    keep = ["key", "band", "rep", "text_hash", "n", "component"]
    # A small bucket is one block in which its leaders are probes as well; a large one deals
    # its members to blocks and sends the leaders to every block.
    one = rows.where("blocks = 1").select(*keep, F.lit(0).cast("bigint").alias("salt"), F.col("lead").alias("leads"), F.lit(True).alias("probes"))
    many = rows.where("blocks > 1")
    dealt = many.select(*keep, F.pmod(F.xxhash64("rep", "text_hash"), "blocks").alias("salt"), F.lit(False).alias("leads"), F.lit(True).alias("probes"))
    sent = many.where("lead").select(*keep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("salt"),
                                     F.lit(True).alias("leads"), F.lit(False).alias("probes"))
    bits = (texts.select(F.col("id").alias("rep"), "text_hash", "text")
            .join(rows.select("rep", "text_hash").distinct(), ["rep", "text_hash"], "left_semi")
            .mapInArrow(_long, f"rep {id_type}, text_hash bigint, bits binary"))
    signed = classes.select("rep", "text_hash", "keys").join(bits, ["rep", "text_hash"])
    blocks = one.union(dealt).union(sent).join(stage(signed, "signed"), ["rep", "text_hash"])
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "key", "salt").mapInArrow(
        lambda batches: _compare(batches, best), f"a {id_type}, a_hash bigint, b {id_type}, b_hash bigint, more boolean")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group, all columns kept. Rows with a
    null id stay; rows that share an id stay or go together."""
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id
         GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
