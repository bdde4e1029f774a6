"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies follow its preference, so that those of a source add up to the
source's target of words. Whole copies are certain; for the rest documents are ranked by
random odds over inclusion odds, and the source takes them in that order until its target is
met. Random numbers are digests of the seed and the document, so reruns agree. Words are
counted once, into a slim table of ids, sources and sizes; ranks are found on it without
gathering a source: fine bins of the rank are summed first, and only the bin that holds a cut
is ordered. The texts are read once more at the end, each beside its source's cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
SEED = 7
#: Bins of the ranking variable: the documents of one bin are ordered in one task.
BINS = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target
    stops at ``most`` times its source's size and the excess is shared anew by weight until
    none is above. Only sums travel to the driver.
    """
    order = (F.col("source").isNull(), F.col("source"))
    ranges = max(1, math.ceil(sizes.count() / 200_000))
    ranged = materialise(sizes.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("range").count().withColumn("skip", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    turn = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("skip")
    numbered = ranged.join(before.select("range", "skip"), "range").withColumn("turn", turn)
    weighed = materialise(numbered.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")).alias("weight")), "weights")
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= F.col("source_size") * most
        open_weight = F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))
        left = F.sum("source_size") - F.sum(F.when(capped, F.col("source_size") * most).otherwise(0))
        row = weighed.agg(open_weight.alias("w"), left.cast("double").alias("left"), F.sum(F.when(capped, 1).otherwise(0)).alias("n")).first()
        if not row["w"]:
            break
        new = row["left"] / row["w"]
        if level is not None and row["n"] == before:
            break
        level, before = new, row["n"]
    at = F.lit(float(level or 0.0))
    target = F.least(F.col("weight") * at, (F.col("source_size") * most).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def expected_rates(slim: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``targets`` with ``rate``: expected copies are the rate times the preference, at most ``most``, and add up to the target.

    Where some would be above ``most``, what they leave is shared by the others, until none is
    above. Sums of each source and preference are all that the rounds read.
    """
    sums = materialise(slim.groupBy("source", "liking").agg(F.sum("size").alias("words")), "likings")
    full = targets.withColumn("all", F.col("target") >= F.col("source_size") * F.lit(float(most)))
    rates = full.select(F.col("source").alias("s"), "target", "all", F.lit(None).cast("double").alias("rate"))
    before = None
    while True:
        joined = sums.join(rates, F.col("source").eqNullSafe(F.col("s")))
        capped = F.coalesce(F.col("liking") * F.col("rate") >= F.lit(float(most)), F.lit(False))
        left = F.max("target") - F.sum(F.when(capped, F.col("words")).otherwise(0)) * F.lit(float(most))
        liked = F.sum(F.when(capped, 0.0).otherwise(F.col("words") * F.col("liking")))
        rate = F.when(F.max("all"), F.lit(float("inf"))).when(liked > 0, left / liked).otherwise(F.max("rate"))
        rates = materialise(joined.groupBy("source").agg(rate.alias("rate"), F.max("target").alias("target"), F.max("all").alias("all"), F.sum(capped.cast("int")).alias("n")).withColumnRenamed("source", "s"), "rates")
        n = rates.agg(F.sum("n")).first()[0]
        if n == before:
            break
        before = n
    return targets.join(rates.select("s", "rate"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text: str = "text", source: str = "source",
    preference: str | Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (words) and ``copies``.

    Expected copies of a document go with its ``preference`` (a column, or a function of
    the size; null: 1; none given: all alike), at most ``most``. Their whole part is certain and
    the rest p is the inclusion chance of one more.

    A null text has no words; a null source is a source of its own, the last. Documents
    without words are never sampled (their certain copies carry no words). Rows that repeat an
    id and a size stand or fall together. A source stops at the document with which it comes
    nearest to its target. Columns of the new names are replaced. An empty table gives an
    empty table.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    like = F.lit(1.0) if preference is None else F.col(preference) if isinstance(preference, str) else preference(F.col("__ls_size"))
    base = docs.withColumns({"__ls_id": F.col(id_col), "__ls_src": F.col(source), "__ls_size": word_count(text)})
    base = base.withColumn("__ls_liking", F.greatest(F.coalesce(like.cast("double"), F.lit(1.0)), F.lit(0.0)))
    slim = materialise(base.select(F.col("__ls_id").alias("id"), F.col("__ls_src").alias("source"), F.col("__ls_size").alias("size"), F.col("__ls_liking").alias("liking")), "sizes")
    targets = source_targets(materialise(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), weights, most)
    plan = expected_rates(slim, targets, most)

    def ranked(rows: DataFrame, rate: str, ident: str, size: str, liking: str) -> DataFrame:
        """``rows`` with ``__ls_whole`` certain copies and the rank of the rest: random odds over inclusion odds."""
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string"))), 1, 13), 16, 10).cast("long")
        expected = F.least(F.when(F.col(liking) > 0, F.col(rate) * F.col(liking)).otherwise(0.0), F.lit(float(most)))
        rows = rows.withColumn("__ls_expected", F.coalesce(expected, F.lit(0.0))).withColumn("__ls_whole", F.floor(F.col("__ls_expected") + 1e-12))
        rows = rows.withColumns({"__ls_p": F.greatest(F.col("__ls_expected") - F.col("__ls_whole"), F.lit(0.0)), "__ls_u": (draw + 0.5) / 2.0**52})
        odds = (F.col("__ls_u") / (1 - F.col("__ls_u"))) * ((1 - F.col("__ls_p")) / F.nullif(F.col("__ls_p"), F.lit(0.0)))
        return rows.withColumn("__ls_rank", F.when((F.col("__ls_p") > 0) & (F.col(size) > 0), odds))

    rates = plan.select(F.col("source").alias("s"), "target", "rate")
    every = ranked(slim.join(rates, F.col("source").eqNullSafe(F.col("s"))), "rate", "id", "size", "liking")
    # The rank's share in (0, 1) keeps the order and has even bins.
    share = F.least(F.floor(F.col("__ls_rank") / (1 + F.col("__ls_rank")) * BINS), F.lit(BINS - 1)).cast("int")
    every = materialise(every.select("s", "target", "id", "size", "__ls_rank", F.coalesce(share, F.lit(BINS)).alias("bin"), (F.col("__ls_whole") * F.col("size")).alias("certain")), "ranked")
    bins = materialise(every.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.sum("certain").alias("certain"), F.max("target").alias("target")), "bins")
    rest = bins.groupBy("s").agg(F.greatest(F.max("target") - F.sum("certain"), F.lit(0.0)).alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows at most
    placed = bins.where(F.col("bin") < BINS).withColumn("before", before).join(rest.withColumnRenamed("s", "r"), F.col("s").eqNullSafe(F.col("r")))
    cuts = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    cuts = materialise(cuts.groupBy("s").agg(F.min(F.struct("bin", "before", "rest")).alias("cut")).select(F.col("s").alias("c"), "cut.*"), "cuts")
    # Only the bin with the cut is ordered, ids and sizes alone; repeated rows are one step.
    inside = every.join(cuts.withColumnRenamed("bin", "cut"), F.col("s").eqNullSafe(F.col("c")) & (F.col("bin") == F.col("cut")))
    inside = inside.groupBy("s", "__ls_rank", "id", "size", "before", "rest").agg(F.sum("size").alias("step"))
    order = Window.partitionBy("s").orderBy("__ls_rank", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("step").over(order), F.lit(0))
    last = inside.withColumn("in", start + F.col("step") / 2.0 <= F.col("rest")).where("in").groupBy("s").agg(F.max(F.struct("__ls_rank", "id", "size")).alias("last"))
    ends = rest.withColumnRenamed("s", "r").join(cuts.drop("rest"), F.col("r").eqNullSafe(F.col("c")), "left").join(last, F.col("r").eqNullSafe(F.col("s")), "left")
    # Without a cut a source takes all or, if nothing is left to take, none.
    ends = ends.select("r", F.coalesce("bin", F.when(F.col("rest") > 0, BINS).otherwise(-1)).alias("cut"), "last")
    final = plan.join(ends, F.col("source").eqNullSafe(F.col("r")))
    final = materialise(final.select(*[F.col(c).alias(f"__ls_{c}") for c in ("source", "source_size", "target", "rate", "cut", "last")]), "plan")

    out = ranked(base.join(final, F.col("__ls_src").eqNullSafe(F.col("__ls_source"))), "__ls_rate", "__ls_id", "__ls_size", "__ls_liking")
    share = F.least(F.floor(F.col("__ls_rank") / (1 + F.col("__ls_rank")) * BINS), F.lit(BINS - 1)).cast("int")
    # Nulls come first in structs, as in the order above.
    among = F.coalesce(F.struct("__ls_rank", F.col("__ls_id").alias("id"), F.col("__ls_size").alias("size")) <= F.col("__ls_last"), F.lit(False))
    extra = F.when(F.col("__ls_rank").isNull(), 0).when(share < F.col("__ls_cut"), 1).when((share == F.col("__ls_cut")) & among, 1).otherwise(0)
    copies = F.col("__ls_whole") + extra
    named = {"size": F.col("__ls_size"), "source_size": F.col("__ls_source_size"), "target": F.col("__ls_target"), "copies": copies, "taken": copies * F.col("__ls_size")}
    return out.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in named.items()])


def by_length(size: Column) -> Column:
    """The preference of the query and the pipeline: the binary digits of a document's size, so longer documents are likelier."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(1)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, preference=by_length).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7|' || doc_id), 1, 13))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), l(step, level, n) AS (
  SELECT 0, (sum(source_size)::DOUBLE / sum(weight)), 0::BIGINT FROM s
  UNION ALL
  SELECT step + 1,
         (sum(s.source_size) - sum(CASE WHEN weight * level >= source_size * 3 THEN source_size * 3 ELSE 0 END))::DOUBLE
           / sum(CASE WHEN weight * level >= source_size * 3 THEN 0.0::DOUBLE ELSE weight END),
         (count(*) FILTER (weight * level >= source_size * 3))::BIGINT
  FROM l, s WHERE step < 60 GROUP BY step, level, n
), p AS (
  SELECT source, source_size, least(weight * (SELECT level FROM l ORDER BY step DESC LIMIT 1), (source_size * 3)::DOUBLE) AS target FROM s
), k AS (
  SELECT d.source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 1 END::DOUBLE AS liking, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), c(step, source, rate) AS (
  SELECT 0, source, CASE WHEN target >= source_size * 3.0::DOUBLE THEN 'inf'::DOUBLE END FROM p
  UNION ALL
  SELECT step + 1, c.source,
         CASE WHEN max(rate) = 'inf'::DOUBLE THEN max(rate)
              WHEN sum(CASE WHEN coalesce(liking * rate >= 3, false) THEN 0.0::DOUBLE ELSE words * liking END) > 0 THEN
                (max(target) - sum(CASE WHEN coalesce(liking * rate >= 3, false) THEN words ELSE 0 END) * 3.0::DOUBLE)
                / sum(CASE WHEN coalesce(liking * rate >= 3, false) THEN 0.0::DOUBLE ELSE words * liking END)
              ELSE max(rate) END
  FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE step < 40 GROUP BY step, c.source
), e AS (
  SELECT d.*, source_size, target, coalesce(least(rate * CASE WHEN size > 0 THEN length(bin(size)) ELSE 1 END, 3.0::DOUBLE), 0.0::DOUBLE) AS expected
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND step = 40
), q AS (
  SELECT *, floor(expected + 1e-12)::BIGINT AS whole, greatest(expected - floor(expected + 1e-12), 0.0::DOUBLE) AS p, (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM e
), f AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS rank FROM q
), r AS (
  SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0.0::DOUBLE) AS rest,
         coalesce(sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM f
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN rank IS NOT NULL AND start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
