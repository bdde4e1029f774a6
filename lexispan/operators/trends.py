"""Yearly document-frequency series, emergence, role shift, co-occurrence.

Mentions come as ``doc_id, key, role``, documents as ``doc_id, year`` (null: undated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_totals(documents: DataFrame) -> DataFrame:
    """``year, n``; undated documents count under a null year."""
    return documents.groupBy("year").agg(F.count("*").alias("n"))


def series_year(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """``key, year, n_docs``: in how many dated documents of a year a key occurs."""
    dealt = mentions.select("doc_id", "key").repartition(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # Told apart where a document's mentions are: parts stay as many as given, and few enough rows for one task.
    once = dealt.join(documents.where("year IS NOT NULL"), "doc_id").select("doc_id", "key", "year").distinct()
    return once.groupBy("key", "year").agg(F.count("*").alias("n_docs"))


def series_role(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """``key, year, role, n``: mentions by role."""
    return mentions.join(documents.where("year IS NOT NULL"), "doc_id").groupBy("key", "year", "role").agg(F.count("*").alias("n"))


def series_share(series: DataFrame, totals: DataFrame) -> DataFrame:
    """``key, year, share`` for all years, 0 where a key doesn't occur. Years are few: each key meets all."""
    years = F.broadcast(totals.where("year IS NOT NULL").select("year", F.col("n").alias("total")))
    every = series.select("key").distinct().crossJoin(years)
    return every.join(series, ["key", "year"], "left").select("key", "year", (F.coalesce("n_docs", F.lit(0)) / F.col("total")).alias("share"))


def top_series(series: DataFrame, k: int = 25) -> DataFrame:
    return series.groupBy("key").agg(F.sum("n_docs").alias("total")).orderBy(F.desc("total"), "key").limit(k)


def emerging(series: DataFrame, totals: DataFrame, min_docs: int = 4, window: int = 3, k: int = 25) -> DataFrame:
    """``key, slope, growth, recent, earlier``: the last ``window`` years against those before.

    Growth is (recent + f) / (earlier + f) with f one over all documents; fewer than two years
    give nothing. Ordered by growth, slope, key.
    """
    dated = totals.where("year IS NOT NULL")
    ranked = dated.withColumn("back", F.dense_rank().over(Window.orderBy(F.desc("year"))))  # one row for each year
    facts = ranked.agg(F.count("*").alias("n_years"), (1.0 / F.sum("n")).alias("floor"))
    enough = series.groupBy("key").agg(F.sum("n_docs").alias("total")).where(F.col("total") >= min_docs).select("key")
    shares = series_share(series.join(enough, "key", "left_semi"), totals).join(F.broadcast(ranked.select("year", "back")), "year")
    late = F.col("back") <= window
    per_key = shares.groupBy("key").agg(
        F.regr_slope("share", F.col("year").cast("double")).alias("slope"),
        F.coalesce(F.avg(F.when(late, F.col("share"))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.avg(F.when(~late, F.col("share"))), F.lit(0.0)).alias("earlier"),
    )
    out = per_key.crossJoin(F.broadcast(facts)).where("n_years >= 2").withColumn("growth", (F.col("recent") + F.col("floor")) / (F.col("earlier") + F.col("floor")))
    rounded = out.select("key", F.round("slope", 6).alias("slope"), F.round("growth", 3).alias("growth"), F.round("recent", 5).alias("recent"), F.round("earlier", 5).alias("earlier"))
    return rounded.orderBy(F.desc("growth"), F.desc("slope"), "key").limit(k)


def role_transitions(roles: DataFrame, series: DataFrame, min_docs: int = 6, late_roles: tuple[str, ...] = ("used", "compared")) -> DataFrame:
    """``key, early, late, shift``: the share of ``late_roles`` in a series' later years less that in its first half."""
    enough = series.groupBy("key").agg(F.sum("n_docs").alias("total"), F.count("*").alias("n_years")).where((F.col("total") >= min_docs) & (F.col("n_years") >= 2))
    by_key = Window.partitionBy("key").orderBy("year")
    halves = series.join(enough.select("key", "n_years"), "key").withColumn("turn", F.row_number().over(by_key))
    halves = halves.select("key", "year", (F.col("turn") <= F.greatest(F.lit(1), F.floor(F.col("n_years") / 2))).alias("early"))
    joined = roles.join(halves, ["key", "year"])
    share = lambda c: F.coalesce(F.sum(F.when(c & F.col("role").isin(*late_roles), F.col("n"))) / F.sum(F.when(c, F.col("n"))), F.lit(0.0))
    out = joined.groupBy("key").agg(share(F.col("early")).alias("early"), share(~F.col("early")).alias("late"))
    return out.withColumn("shift", F.col("late") - F.col("early"))


def cooccurrence(mentions: DataFrame, min_df: int = 3, min_joint: int = 3, k: int = 40) -> DataFrame:
    """``a, b, joint, pmi``: pairs of keys of one document, by pointwise mutual information."""
    once = mentions.select("doc_id", "key").distinct()
    df = once.groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n = once.agg(F.count_distinct("doc_id").alias("n"))  # one row
    live = once.join(df, "key")
    left = live.select("doc_id", F.col("key").alias("a"), F.col("df").alias("da"))
    right = live.select("doc_id", F.col("key").alias("b"), F.col("df").alias("db"))
    pairs = left.join(right, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint"), F.first("da").alias("da"), F.first("db").alias("db")).where(F.col("joint") >= min_joint)
    pmi = F.round(F.ln(F.col("joint") * F.col("n") / (F.col("da") * F.col("db"))), 6)
    return pairs.crossJoin(F.broadcast(n)).select("a", "b", "joint", pmi.alias("pmi")).orderBy(F.desc("pmi"), "a", "b").limit(k)
