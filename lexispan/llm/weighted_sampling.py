"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are words weighted by their count. For sample k a term S with weight w draws, from
digests of (k, S) alone, r and c from Gamma(2, 1) and b uniform; with t = floor(ln w / r + b)
its value is c * exp(-r * (t - b + 1)), and the term of the smallest value is the sample,
named by (S, t). Two texts agree in a sample with the probability of their generalised
Jaccard similarity, sum of min over sum of max of the weights.

A uniform part of a Gamma(2, 1) variable and the rest are two independent exponentials. So
all three are drawn from three exponentials x, y, z: c = x + y, r = s + z with
s = ln((x + y) / x), and b = z / r, which is uniform and independent of r. Then
t = floor((ln w + z) / r) and the value is x * exp(-r * t): for weight 1, x itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

SAMPLES = 64
#: Draws above ``ENOUGH`` over the text's weight are left out unseen: a sample's least value lies above with chance exp(-ENOUGH).
ENOUGH = 22.0
_AT_ONCE = 2
#: A text without words has this in place of every sample.
NONE = "0" * 8


def words_of(text: Column) -> Column:
    """The words of a text, without a regex."""
    for gap in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def pair_fingerprints(texts: DataFrame, keys: list[str], first: str = "text", second: str = "edited", samples: int = SAMPLES, enough: float | None = ENOUGH) -> DataFrame:
    """``keys, n0, n1, fp0, fp1``: word counts and fingerprints of two texts a row, eight hexadecimal digits a sample.

    Texts that share words share their draws, so an edited text costs little more than its
    original. Rows that agree in ``keys`` count as one; if ``texts`` is dealt out by them, nothing
    is shuffled. A draw is worked out only if a lower bound that needs no logarithm is at most
    ``enough`` over the text's words (None: always): as x = -ln(1 - e) >= e and
    r t <= ln w + z, a value is at least e * exp(-z) / w, and for weight 1 at least e. A sample
    whose draws were all left out makes its fingerprint null, and the caller draws that text in
    full. Samples are drawn ``_AT_ONCE`` at a time, so that the code that Spark makes stays
    small enough to be compiled. A text without words has a null fingerprint and a count of 0.
    """
    each = range(_AT_ONCE)
    some = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate((first, second))])
    both = texts.select(*keys, F.explode(some).alias("x")).select(*keys, "x.which", words_of(F.col("x.text")).alias("words"))
    words = both.select(*keys, "which", F.size("words").alias("n"), F.explode("words").alias("word"))
    own = lambda c, i: F.when(F.col("which") == i, c)
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*[F.count(own(F.lit(1), i)).alias(f"w{i}") for i in (0, 1)], *[F.coalesce(F.max(own(F.col("n"), i)), F.lit(0)).alias(f"m{i}") for i in (0, 1)])
    logs = [F.ln(F.col(f"w{i}").cast("double")).alias(f"l{i}") for i in (0, 1)]
    limits = [(F.lit(float(enough)) / F.greatest(f"m{i}", F.lit(1)) if enough else F.lit(float("inf"))).alias(f"e{i}") for i in (0, 1)]
    terms = terms.select(*keys, "term", "w0", "w1", "m0", "m1", F.greatest("w0", "w1").alias("w"), *logs, *limits)
    limit = F.greatest(F.when(F.col("w0") > 0, F.col("e0")), F.when(F.col("w1") > 0, F.col("e1")))
    groups = F.array(*map(F.lit, range(-(-samples // _AT_ONCE))))
    keep = [*keys, "g", "w0", "w1", "m0", "m1", "w", "l0", "l1", "e0", "e1"]
    drawn = terms.select(*keep[: len(keys)], "term", *keep[len(keys) + 1 :], limit.alias("limit"), F.explode(groups).alias("g"))
    drawn = drawn.select(*keep, "limit", F.xxhash64("term", "g").alias("term"))
    drawn = drawn.select(*keep, "limit", "term", *[F.expr(f"{2.0**-53!r}D * shiftrightunsigned(xxhash64(term, {j}), 11)").alias(f"u{j}") for j in each])
    bound = lambda j: f"if(w <= 1, u{j}, u{j} * ({2.0**-32!r}D * (shiftrightunsigned(xxhash64(term, {j + 100}), 32) + 1L)) / w)"
    drawn = drawn.select(*keep, "term", *[f"u{j}" for j in each], *[F.expr(f"{bound(j)} <= limit").alias(f"near{j}") for j in each], F.spark_partition_id().alias("part"))
    if enough:  # the partition's number, which isn't negative, only keeps this filter from being pushed below the sums it rests on
        drawn = drawn.where(" OR ".join(f"near{j}" for j in each) + " OR part < 0")
    more = lambda j: f"if(near{j} AND w > 1, xxhash64(term, {j + 100}), null)"
    drawn = drawn.select(*keep, "term", *[F.expr(f"if(near{j}, -log1p(-u{j}), null)").alias(f"x{j}") for j in each], *[F.expr(more(j)).alias(f"h{j}") for j in each])
    drawn = drawn.select(
        *keep, "term", *[f"x{j}" for j in each],
        *[F.expr(f"-ln({2.0**-32!r}D * (shiftrightunsigned(h{j}, 32) + 1L))").alias(f"z{j}") for j in each],
        *[F.expr(f"-ln({2.0**-32!r}D * ((h{j} & 4294967295L) + 1L))").alias(f"y{j}") for j in each],
    )
    drawn = drawn.select(*keep, "term", *[f"{c}{j}" for j in each for c in "xz"], *[F.expr(f"greatest(1e-12D, ln((x{j} + y{j}) / greatest(x{j}, 1e-300D)) + z{j})").alias(f"r{j}") for j in each])
    step = lambda i, j: f"if(x{j} IS NULL OR w{i} = 0, null, if(w{i} = 1, 0L, floor((l{i} + z{j}) / r{j})))"
    drawn = drawn.select(*keep, "term", *[f"{c}{j}" for j in each for c in "xr"], *[F.expr(step(i, j)).alias(f"t{i}_{j}") for j in each for i in (0, 1)])
    value = lambda i, j: f"if(t{i}_{j} = 0, x{j}, x{j} * exp(-r{j} * t{i}_{j}))"
    name = lambda i, j: f"if(t{i}_{j} IS NULL, null, xxhash64(term, t{i}_{j}))"
    drawn = drawn.select(*keys, "g", "m0", "m1", "e0", "e1", *[F.expr(name(i, j)).alias(f"n{i}_{j}") for j in each for i in (0, 1)], *[F.expr(value(i, j)).alias(f"v{i}_{j}") for j in each for i in (0, 1)])
    if enough:  # what was left out is above this: only below it is the least one sure
        drawn = drawn.select(*keys, "g", "m0", "m1", *[f"n{i}_{j}" for j in each for i in (0, 1)], *[F.expr(f"if(v{i}_{j} <= e{i}, v{i}_{j}, null)").alias(f"v{i}_{j}") for j in each for i in (0, 1)])
    chosen = drawn.groupBy(*keys, "g").agg(F.max("m0").alias("n0"), F.max("m1").alias("n1"), *[F.min_by(f"n{i}_{j}", f"v{i}_{j}").alias(f"s{i}_{j}") for i in (0, 1) for j in each])
    hexes = lambda i: F.concat(*[F.lower(F.substring(F.lpad(F.hex(f"s{i}_{j}"), 16, "0"), 9, 8)) for j in each])
    part = chosen.select(*keys, "g", "n0", "n1", hexes(0).alias("part0"), hexes(1).alias("part1"))
    # Every group of samples has a row for a key that has words; a null part makes the whole null.
    parts = part.groupBy(*keys).agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"), F.sort_array(F.collect_list(F.struct("g", "part0", "part1"))).alias("parts"))
    whole = lambda i: F.left(F.when(F.forall("parts", lambda x: x[f"part{i}"].isNotNull()), F.array_join(F.transform("parts", lambda x: x[f"part{i}"]), "")), F.lit(8 * samples))
    return parts.select(*keys, "n0", "n1", whole(0).alias("fp0"), whole(1).alias("fp1"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: an estimate of generalised Jaccard similarity."""
    same = F.lit(0)
    for k in range(samples):
        same = same + F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0)
    return same / float(samples)


KEY = ["k1", "k2"]


def next_in_order(keys: DataFrame, rows_a_bin: int = 200_000) -> DataFrame:
    """``keys`` (``doc_id, k1, k2``, distinct) with ``next``, the keys of the next by descending doc_id; after the last the first.

    Equal ids follow by key; null ids come last. Ranges of even size, whatever the gaps between
    ids, are written with their number and ordered each by itself; only the first key of each
    range is ordered over all.
    """
    order = (F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2"))
    bins = max(1, math.ceil(keys.count() / rows_a_bin))
    binned = materialise(keys.select("doc_id", F.struct(*KEY).alias("key"), *KEY).repartitionByRange(bins, *order).withColumn("bin", F.spark_partition_id()), "bins")
    within = binned.withColumn("next", F.lead("key").over(Window.partitionBy("bin").orderBy(*order)))
    rank = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "key")
    firsts = binned.groupBy("bin").agg(F.min_by("key", rank).alias("first"))
    by_bin = Window.orderBy("bin")  # one row for each range
    whole = by_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("bin", F.coalesce(F.lead("first").over(by_bin), F.first("first").over(whole)).alias("after"))
    return within.join(firsts, "bin").select("doc_id", *KEY, F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, enough: float | None = ENOUGH) -> DataFrame:
    """Each text and its edited text, fingerprinted: the columns of the contract of op2.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all)
    of the next document by descending doc_id. A null text counts as empty; two texts without
    words are alike (1), one without is unlike any with words (0). Rows that repeat doc_id and
    text are one document in the order and each give a row. An empty table gives an empty one.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    keys = materialise(source.groupBy("doc_id", *KEY).agg(F.max(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("copies")), "keys")
    ring = materialise(next_in_order(keys.select("doc_id", *KEY)).select(*KEY, F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2")), "ring")
    lengths = keys.select(*KEY, F.col("n_chars").alias("n"))
    before = ring.join(lengths, KEY).select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    base = source.join(before, KEY)
    pieces = base.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.left("text", "need").alias("piece")).groupBy(*KEY).agg(F.max("piece").alias("piece"))
    n = F.length("text")
    whole = base.select(*KEY, "text").join(pieces, KEY)
    whole = whole.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 2).cast("int")), "piece"))
    worded = F.col("text").rlike(WORD) | F.col("edited").rlike(WORD)
    digests = materialise(whole.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"), worded.alias("worded")).distinct(), "digests")
    prints = materialise(pair_fingerprints(whole, KEY, samples=samples, enough=enough), "prints")
    unseen = prints.where("(n0 > 0 AND fp0 IS NULL) OR (n1 > 0 AND fp1 IS NULL)").select(*KEY)
    # A text none of whose samples was drawn has no row at all.
    none_seen = digests.where("worded").join(prints, KEY, "left_anti").select(*KEY)
    unseen = materialise(unseen.unionByName(none_seen), "unseen")
    if not unseen.isEmpty():
        again = materialise(pair_fingerprints(whole.join(unseen, KEY, "left_semi"), KEY, samples=samples, enough=None), "prints")
        prints = prints.join(unseen, KEY, "left_anti").unionByName(again)
    prints = prints.select(*KEY, F.col("fp0").alias("fingerprint"), F.col("fp1").alias("edited_fingerprint"))
    none = F.lit(NONE * samples)
    every = keys.join(ring, KEY).join(digests, KEY).join(prints, KEY, "left")
    every = every.withColumns({c: F.coalesce(c, none) for c in ("fingerprint", "edited_fingerprint")})
    following = keys.select(*KEY).join(prints, KEY, "left").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.coalesce("fingerprint", none).alias("next_fingerprint"))
    out = every.join(following, ["n1", "n2"]).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
