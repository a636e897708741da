"""Operator 4: document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs (lines; a line of over ``PIECE_CHARS`` code points counts in
pieces) become a set of 64-bit digests. A sketch hashes each digest into one cell of
each of ``HASHES`` rows of cells; a cell holds count, xor of digests, xor of their
checks. Cells subtract between two versions; peeling takes digests out of cells of
count +-1 whose check fits, round by round, until all cells are empty: the digests by
which the versions differ. Large texts use several sketches, by a hash of the digest,
of about ``LOAD`` digests each; a sketch that doesn't come out empty is retried as four
with fresh hashes, until none fails. Likeness is the Jaccard similarity of the two
paragraph sets that the recovered difference implies.

Only DataFrame functions. Texts are dealt once, by ranges of ids, for each row to see
the next one; what follows works on digests.

Defined results: null text counts as empty; two texts without paragraphs have likeness
1; the next document is that of the next id (equal ids by text hash; a null id first),
after the last the first, of a single row itself; repeated rows each give a row, next to
each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import stage

PIECE_CHARS = 512
HASHES, ROW_CELLS = 3, 8
LOAD = 10
ROUNDS = 6
PRINT_ROW_CELLS = 4
RANGE_BYTES = 256 << 20      # text of a range of ids
MOST_RANGES = 10_000         # cuts that fit an expression; beyond, ranges grow (and their sort spills)
_SEED_CHECK, _SEED_PRINT, _SEED_SPLIT, _SEED_CELLS = 11, 12, 1000, 2000


def digests(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PIECE_CHARS), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _places(key: Column, seed: int, row_cells: int) -> list[Column]:
    """The cell of ``key`` in each row of cells."""
    h = F.xxhash64(key, F.lit(seed))
    return [(F.pmod(F.shiftright(h, 20 * j), F.lit(row_cells)) + j * row_cells).cast("int") for j in range(HASHES)]


def _element(key: Column, count: Column, seed: int, row_cells: int) -> Column:
    return F.struct(key.alias("key"), count.cast("bigint").alias("count"), F.xxhash64(key, F.lit(_SEED_CHECK)).alias("check"),
                    *(p.alias(f"p{j}") for j, p in enumerate(_places(key, seed, row_cells))))


def _fold(elements: Column, cell: Column, start: Column, sign: int) -> Column:
    """``start`` with all elements that hash to ``cell`` added (sign -1: taken out)."""
    hits = F.filter(elements, lambda e: (e["p0"] == cell) | (e["p1"] == cell) | (e["p2"] == cell))
    return F.aggregate(hits, start, lambda c, e: F.struct(
        (c["count"] + sign * e["count"]).alias("count"), c["key"].bitwiseXOR(e["key"]).alias("key"),
        c["check"].bitwiseXOR(e["check"]).alias("check")))


def _zero() -> Column:
    return F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("count", "key", "check")))


def cells(elements: Column, row_cells: int) -> Column:
    """The sketch of ``elements``."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES * row_cells - 1)), lambda i: _fold(elements, i, _zero(), 1))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["count"] - y["count"]).alias("count"), x["key"].bitwiseXOR(y["key"]).alias("key"),
        x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(difference: Column, seed: int, row_cells: int, rounds: int = ROUNDS) -> Column:
    """Struct (left: cells, n: digests recovered)."""
    start = F.struct(difference.alias("left"), F.lit(0).cast("bigint").alias("n"))

    def step(state, _):
        pure = F.filter(state["left"], lambda c: (F.abs(c["count"]) == 1) & (F.xxhash64(c["key"], F.lit(_SEED_CHECK)) == c["check"]))
        out = F.array_distinct(F.transform(pure, lambda c: _element(c["key"], c["count"], seed, row_cells)))
        bound = F.transform(F.array(out), lambda p: F.struct(          # binds ``out`` once
            F.when(F.size(p) == 0, state["left"]).otherwise(
                F.transform(state["left"], lambda c, i: _fold(p, i, c, -1))).alias("left"),
            (state["n"] + F.size(p)).alias("n")))
        return F.element_at(bound, 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def fingerprint(keys: Column) -> Column:
    """The text's own sketch as a string: equal paragraph sets give equal strings."""
    elements = F.transform(keys, lambda k: _element(k, F.lit(1), _SEED_PRINT, PRINT_ROW_CELLS))
    shown = F.transform(F.array(elements), lambda e: F.concat_ws(".", F.transform(
        cells(e, PRINT_ROW_CELLS), lambda c: F.concat_ws(":", F.hex(c["count"]), F.hex(c["key"]),
                                                          F.hex(c["check"].bitwiseAND(F.lit(0xFFFFFFFF)))))))
    return F.element_at(shown, 1)


def _range_bucket(cuts: list) -> Column:
    """Number of cuts not above ``_key``, in two steps of about sqrt(len) comparisons."""
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)] or [[]]
    heads = F.array(*(F.lit(g[0]) for g in groups[1:])).cast("array<bigint>")
    which = F.size(F.filter(heads, lambda c: c <= F.col("_key")))
    inner = F.array(*(F.array(*map(F.lit, g)).cast("array<bigint>") for g in groups))
    within = F.size(F.filter(F.element_at(inner, which + 1), lambda c: c <= F.col("_key")))
    return which * width + within


def _with_next(texts: DataFrame, buckets: int) -> DataFrame:
    """``texts`` (_id, _key, _hash, text) plus a, its digests, and next_text and n, text
    and digests of the row that follows."""
    spark = texts.sparkSession
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = texts.agg(F.percentile_approx("_key", probs, 10_000)).first()[0] or []
    rows = texts.withColumn("_bucket", _range_bucket(sorted(set(cuts))))
    # One short row a bucket.
    firsts = [r for r in rows.groupBy("_bucket").agg(F.min(F.struct("_key", "_hash")).alias("f"))
              .select("_bucket", "f.*").orderBy("_bucket").collect()]
    order = [r["_bucket"] for r in firsts]
    after = {b: firsts[(bisect.bisect(order, b)) % len(firsts)] for b in order}
    link = spark.createDataFrame([(b, f["_key"], f["_hash"]) for b, f in after.items()] or [(-1, 0, 0)],
                                 "_of int, _key bigint, _hash bigint")
    heads = (texts.join(F.broadcast(link.select("_key", "_hash").distinct()), ["_key", "_hash"])
             .dropDuplicates(["_key", "_hash"]).join(link, ["_key", "_hash"]).withColumn("a", digests(F.col("text")))
             .select("_of", F.struct("text", "a").alias("_head")))
    heads = stage(heads, "heads")
    along = Window.partitionBy("_bucket").orderBy("_key", "_hash")
    rows = rows.withColumn("a", digests(F.col("text"))).withColumn("_next", F.lead(F.struct("text", "a")).over(along))
    rows = rows.join(heads.hint("shuffle_hash"), F.col("_bucket") == F.col("_of"), "left")
    following = F.coalesce("_next", "_head")
    return rows.withColumns({"next_text": following["text"], "n": following["a"]})


def _attempt(elements: DataFrame, seed: int) -> DataFrame:
    """(row, path, d_e, d_n, failed) for elements (row, path, side, key)."""
    held = elements.withColumn("e", _element(F.col("key"), F.lit(1), _SEED_CELLS + seed, ROW_CELLS))
    rows = held.groupBy("row", "path").agg(
        *(F.collect_list(F.when(F.col("side") == s, F.col("e"))).alias(s) for s in ("a", "e", "n")))
    rows = rows.withColumns({f"_{s}": cells(F.col(s), ROW_CELLS) for s in ("a", "e", "n")})
    rows = rows.withColumns({f"d_{s}": peel(subtract(F.col("_a"), F.col(f"_{s}")), _SEED_CELLS + seed, ROW_CELLS) for s in ("e", "n")})
    empty = [~F.exists(F.col(f"d_{s}.left"), lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0)) for s in ("e", "n")]
    keys = F.struct(*(F.transform(F.col(s), lambda e: e["key"]).alias(s) for s in ("a", "e", "n")))
    return rows.select("row", "path", F.col("d_e.n").alias("d_e"), F.col("d_n.n").alias("d_n"),
                       F.when(~(empty[0] & empty[1]), keys).alias("failed"))


def _exploded(rows: DataFrame, *by: str) -> DataFrame:
    """One row a digest and side."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("keys")) for s in ("a", "e", "n")))
    return (rows.select(*by, F.explode(sides).alias("s")).select(*by, F.col("s.side").alias("side"), F.explode("s.keys").alias("key")))


def differences(sets: DataFrame) -> DataFrame:
    """(row, d_e, d_n): sizes of the symmetric differences of a and e, a and n."""
    parts = F.ceil((F.size("a") + F.greatest(F.size("e"), F.size("n"))) / LOAD)
    first = _exploded(sets.withColumn("parts", parts), "row", "parts")
    first = first.select("row", F.pmod(F.xxhash64("key", F.lit(_SEED_SPLIT)), "parts").alias("path"), "side", "key")
    done, level = [], 0
    now = stage(_attempt(first, level), "peeled")
    while True:
        done.append(now.where("failed IS NULL").select("row", "d_e", "d_n"))
        failed = now.where("failed IS NOT NULL")
        if failed.isEmpty():
            break
        level += 1
        again = _exploded(failed.select("row", "path", "failed.*"), "row", "path")
        again = again.withColumn("path", F.col("path") * 4 + F.pmod(F.xxhash64("key", F.lit(_SEED_SPLIT + level)), F.lit(4)))
        now = stage(_attempt(again, level), "peeled")
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every.groupBy("row").agg(F.sum("d_e").alias("d_e"), F.sum("d_n").alias("d_n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) for every row of ``docs``; the edited text has its last half replaced by
    as many first code points of the next document. ``id_col`` holds integers."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("_id", F.coalesce("_id", F.lit(-(1 << 63))).alias("_key"), F.xxhash64("text").alias("_hash"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES + 1))
    rows = _with_next(texts, buckets).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    size = F.col("n_chars").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    sets = stage(rows.select("_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a",
                             digests(F.col("edited")).alias("e"), "n", F.monotonically_increasing_id().alias("row")), "digests")
    found = differences(sets)

    def likeness(other: str) -> Column:
        both, d = F.size("a") + F.size(other), F.coalesce(F.col(f"d_{other}"), F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    return (sets.join(found, "row", "left")
            .select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
                    fingerprint(F.col("e")).alias("edited_fingerprint"), likeness("e").alias("near_edited"),
                    likeness("n").alias("near_next")))
