"""Operator 10: mixing sources to target weights by Pareto order sampling.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all
words; a target stops at ``MAX_COPIES`` times its source's size and the excess
goes to the others by weight (water filling). Every document first gets the
certain whole copies, floor(target / source size). The rest of the target is a
sample of fixed size in words. Inclusion probabilities are proportional to size and
give the rest in expectation: p = min(1, c * size), where documents with c * size of 1
or more are certain, taken out, and c is worked out again for the others (on the sizes'
histogram). Documents rank by random odds u / (1 - u) over inclusion odds p / (1 - p),
and the lowest ranks are taken until the words are reached, the last of them in part.

Only DataFrame functions. A source is never gathered: its crossing point is found
on ``BINS`` bins of the rank, then on ``BINS`` bins inside the crossing bin (sums
that combine map-side), and only documents of that last bin are ordered. The
random number is a hash of ``seed`` and the id, so reruns agree.

Defined results: null text has size 0 and is never taken; null sources are one
source; rows that agree in id, source and size share what falls to them evenly
(rounded down); an empty table gives an empty result; input columns named like a
result column are replaced, all others, whatever their names, are kept by ``mix_sources``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BINS = 1024
SEED = "mix"
RESULT = ("size", "source_size", "target", "taken")


def _targets(rows: DataFrame, weights, max_copies: int) -> DataFrame:
    """One row a source: its size, mean size, target, certain copies and the
    words still to sample. One short row a source, so one task orders them."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = every.orderBy("_ratio", F.col("_source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                         (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.col("_source_size") * float(max_copies)
    out = (rows.groupBy("_source")
           .agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_n"))
           .withColumn("_weight", share)
           .withColumn("_ratio", cap / F.col("_weight"))
           .withColumn("_level", (F.sum("_source_size").over(every) - (F.sum(cap).over(up_to) - cap))
                       / F.sum("_weight").over(onward))
           .withColumn("_place", F.row_number().over(by_ratio))
           .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"),
                                              F.struct("_place", "_level"))).over(every)["_level"])
           .withColumn("_target", F.least(cap, F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_weight")))
           .withColumn("_whole", F.when(F.col("_source_size") > 0,
                                        F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)))
           .withColumn("_share", F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")
                                        - F.col("_whole")).otherwise(F.lit(0.0)))
           .withColumn("_rest", F.floor(F.col("_target") - F.col("_whole") * F.col("_source_size") + 0.5)))
    return out.select("_source", "_source_size", "_target", "_whole", "_share", "_rest")


def _inclusion(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with _certain (least size that is certain, or null) and _c. The histogram has a
    row a source and size; a source's rows are as many as it has sizes."""
    exact = "decimal(38,0)"
    sizes = rows.where("_size > 0").groupBy("_source", "_size").agg(F.count("*").alias("_times"))
    sizes = _by_source(sizes, plan.select("_source", "_rest"))
    size, times = F.col("_size").cast("decimal(19,0)"), F.col("_times").cast("decimal(19,0)")
    down = Window.partitionBy("_source").orderBy(F.desc("_size"))
    up = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns({"_words": (size * times).cast(exact), "_square": ((size * times).cast(exact) * size).cast(exact)})
    sizes = sizes.withColumns({
        "_larger": F.coalesce(F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(exact),
        "_below": F.sum("_square").over(up).cast(exact)})
    alone = (F.col("_rest").cast(exact) - F.col("_larger")).cast("double") * F.col("_size") >= F.col("_below").cast("double")
    sizes = sizes.withColumn("_sure", F.min(alone.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    c = sizes.groupBy("_source").agg(
        F.min(F.when(F.col("_sure"), F.col("_size"))).alias("_certain"),
        F.coalesce(F.sum(F.when(F.col("_sure"), F.col("_words"))), F.lit(0)).cast("double").alias("_taken_out"),
        F.sum(F.when(~F.col("_sure"), F.col("_square"))).cast("double").alias("_squares"))
    out = _by_source(plan, c)
    return out.withColumn("_c", F.try_divide(F.col("_rest").cast("double") - F.col("_taken_out"), F.col("_squares"))).drop("_taken_out", "_squares")


def _rank(seed: str):
    """Rank of a document in (0, 1): increasing in random odds / inclusion odds."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.col("_c") * F.col("_size")
    ratio = F.try_divide(u / (1.0 - u), p / (1.0 - p))  # NULL for a size of 0: never sampled
    certain = F.col("_size") >= F.col("_certain")
    return F.when(certain & (F.col("_size") > 0), F.lit(0.0)).otherwise(ratio / (1.0 + ratio))


def _crossing(rows: DataFrame, base, bin_col: str, name: str) -> DataFrame:
    """The bin of each source in which the words to sample run out, and the
    words in the bins before it."""
    so_far = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.groupBy("_source", F.col(bin_col).alias("_bin"))
            .agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"), F.first(base).alias("_base"))
            .withColumn("_before", F.col("_base") + F.sum("_words").over(so_far) - F.col("_words"))
            .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
            .select("_source", F.col("_bin").alias(name), F.col("_before").alias(f"{name}_before")))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("_source", "_of")
    return left.join(right, left["_source"].eqNullSafe(right["_of"]), "left").drop("_of")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes).

    ``keep_text=False`` returns only the id and these, from the sizes already
    counted, without a second pass over the texts.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"))
    slim = stage(sized, "sizes")
    plan = stage(_targets(slim, weights, max_copies), "targets")
    plan = stage(_inclusion(slim, plan), "inclusion")

    def ranked(rows: DataFrame) -> DataFrame:
        rows = _by_source(rows, plan).withColumn("_rank", _rank(seed))
        at = F.col("_rank") * BINS
        return (rows.withColumn("_open", (F.col("_size") > 0) & (F.col("_rest") > 0) & (F.col("_share") > 0))
                .withColumn("_one", F.least(F.floor(at), F.lit(BINS - 1)))
                .withColumn("_two", F.floor((at - F.col("_one")) * BINS)))

    sample = ranked(slim).where("_open")
    one = stage(_crossing(sample, F.lit(0), "_one", "_cut"), "bins")
    inside = _by_source(sample, one).where(F.col("_one") == F.col("_cut"))
    two = stage(_crossing(inside, "_cut_before", "_two", "_part"), "bins")
    cuts = _by_source(one, two)
    edge = (_by_source(inside.drop("_cut", "_cut_before"), cuts).where(F.col("_two") == F.col("_part"))
            .groupBy("_source", "_rank", "_id", "_size")
            .agg(F.count("*").alias("_same"), F.first("_rest").alias("_rest"), F.first("_part_before").alias("_base")))
    so_far = (Window.partitionBy("_source").orderBy("_rank", "_id", "_size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    words = F.col("_same") * F.col("_size")
    edge = edge.withColumn("_before", F.col("_base") + F.sum(words).over(so_far) - words)
    edge = edge.select(F.col("_source").alias("_of"), F.col("_id").alias("_edge_id"), F.col("_size").alias("_edge_size"),
                       F.floor(F.greatest(F.least(F.col("_rest") - F.col("_before"), words), F.lit(0))
                               / F.col("_same")).alias("_edge_words"))
    edge = stage(edge, "edge")

    if keep_text:
        rest = [c for c in docs.columns if c not in RESULT]
        # Numbered inside, so that no name meets one of this module's.
        base = docs.select(*(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(rest)), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                           F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"))
    else:
        rest, base = [id_col], slim.withColumn("__in0", F.col("_id"))
    rows = _by_source(ranked(base), cuts)
    rows = rows.join(edge, rows["_source"].eqNullSafe(edge["_of"]) & rows["_id"].eqNullSafe(edge["_edge_id"])
                     & (rows["_size"] == edge["_edge_size"]), "left")
    below = (F.col("_cut").isNull() | (F.col("_one") < F.col("_cut"))
             | ((F.col("_one") == F.col("_cut")) & (F.col("_part").isNull() | (F.col("_two") < F.col("_part")))))
    extra = (F.when(F.col("_open") & F.col("_edge_words").isNotNull(), F.col("_edge_words"))
             .when(F.col("_open") & below, F.col("_size")).otherwise(F.lit(0)))
    return rows.select(*(F.col(f"__in{i}").alias(c) for i, c in enumerate(rest)), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"),
                       (F.col("_whole") * F.col("_size") + extra).cast("bigint").alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, source_size, target, whole, target / source_size - whole AS share,
         CAST(floor(target - whole * source_size + 0.5::DOUBLE) AS BIGINT) AS rest
  FROM (
    SELECT *, floor(target / source_size) AS whole
    FROM (
      SELECT *, least(cap, weight * first_value(level) OVER (ORDER BY (level <= ratio) DESC, ratio, source)) AS target
      FROM (
        SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING) - cap))
                  / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM (
          SELECT *, cap / weight AS ratio
          FROM (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * 3.0::DOUBLE AS cap,
                   CAST(1 + (row_number() OVER (ORDER BY source) - 1) % 3 AS DOUBLE) AS weight
            FROM d GROUP BY source)))))),
h AS (
  SELECT source, size, count(*)::HUGEINT * size AS words, count(*)::HUGEINT * size * size AS square FROM d WHERE size > 0 GROUP BY 1, 2),
g AS (
  SELECT h.*, s.rest,
         CAST(s.rest - coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY size DESC
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * size
         >= CAST(sum(square) OVER (PARTITION BY h.source ORDER BY size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS alone
  FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
g2 AS (
  SELECT *, bool_and(alone) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS sure FROM g),
c AS (
  SELECT source, min(CASE WHEN sure THEN size END) AS certain,
         CAST(any_value(rest) - coalesce(sum(CASE WHEN sure THEN words END), 0) AS DOUBLE)
         / CAST(sum(CASE WHEN NOT sure THEN square END) AS DOUBLE) AS c
  FROM g2 GROUP BY 1),
r AS (
  SELECT d.*, s.* EXCLUDE (source), c.certain,
         (u / (1 - u)) / (c.c * size / (1 - c.c * size)) AS ratio,
         CASE WHEN size >= c.certain THEN 0.0::DOUBLE ELSE ratio / (1 + ratio) END AS rank
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN size > 0 AND rest > 0 AND share > 0 THEN greatest(least(rest - before, size), 0) ELSE 0 END AS BIGINT) AS taken
FROM (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM r)
"""
