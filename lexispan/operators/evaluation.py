"""Scores against annotations: alignment, precision and recall, calibration, attribution."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = ["doc_id", "start", "end"]


def align_strict(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact matches, each span once: ``doc_id, start, end`` and both sides' other columns."""
    once = lambda df: df.dropDuplicates(_SPAN)
    return once(system).join(once(gold), _SPAN)


def overlapping_pairs(system: DataFrame, gold: DataFrame, width: int = 64) -> DataFrame:
    """``doc_id, s_start, s_end, g_start, g_end, iou`` of overlapping pairs.

    Spans are put in the buckets of ``width`` characters they touch, and a pair is kept in the
    bucket where its overlap begins: a long document never compares all with all.
    """

    def bucketed(df: DataFrame, p: str) -> DataFrame:
        spans = df.select("doc_id", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
        return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width))))

    both = bucketed(system, "s").join(bucketed(gold, "g"), ["doc_id", "bucket"])
    lo, hi = F.greatest("s_start", "g_start"), F.least("s_end", "g_end")
    union = F.greatest("s_end", "g_end") - F.least("s_start", "g_start")
    kept = both.where((lo < hi) & (F.floor(lo / width) == F.col("bucket")))
    return kept.select("doc_id", "s_start", "s_end", "g_start", "g_end", ((hi - lo) / union).alias("iou"))


def align_partial(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs one to one, by falling overlap (ties by place): decided document by document."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["iou", "s_start", "g_start", "s_end", "g_end"], ascending=[False, True, True, True, True], kind="stable")
        s_taken, g_taken, keep = set(), set(), []
        for s, g in zip(zip(frame["s_start"], frame["s_end"], strict=True), zip(frame["g_start"], frame["g_end"], strict=True), strict=True):
            keep.append(s not in s_taken and g not in g_taken)
            if keep[-1]:
                s_taken.add(s)
                g_taken.add(g)
        return frame[keep]

    pairs = overlapping_pairs(system.dropDuplicates(_SPAN), gold.dropDuplicates(_SPAN))
    return pairs.groupBy("doc_id").applyInPandas(one, pairs.schema)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def prf(counts: DataFrame, tp: str = "tp", system: str = "n_system", gold: str = "n_gold") -> DataFrame:
    """``counts`` with ``precision, recall, f1``."""
    p, r = ratio(F.col(tp), F.col(system)), ratio(F.col(tp), F.col(gold))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def prf_by(system: DataFrame, gold: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Strict scores for each grouping set of ``genre, type`` (columns of both sides), in one pass."""
    hit = align_strict(system.select(*_SPAN), gold.select(*_SPAN)).withColumn("hit", F.lit(1))
    s = system.dropDuplicates(_SPAN).join(hit, _SPAN, "left").select("genre", "type", F.lit(1).alias("s"), F.lit(0).alias("g"), F.coalesce("hit", F.lit(0)).alias("t"))
    g = gold.dropDuplicates(_SPAN).select("genre", "type", F.lit(0).alias("s"), F.lit(1).alias("g"), F.lit(0).alias("t"))
    grouped = s.unionByName(g).groupingSets([[F.col(c) for c in one] for one in sets], "genre", "type")
    return prf(grouped.agg(F.sum("t").alias("tp"), F.sum("s").alias("n_system"), F.sum("g").alias("n_gold")))


def risk_coverage(scored: DataFrame, bins: int = 10_000) -> DataFrame:
    """``score, n, hits, coverage, precision`` by falling score: one row for each distinct score.

    Equal scores enter together. Running totals go over the distinct scores, rounded to one
    part in ``bins``, so the ordered pass is bounded whatever the number of mentions.
    """
    level = F.round(F.floor(F.col("score") * bins) / bins, 6)
    grouped = scored.groupBy(level.alias("score")).agg(F.count("*").alias("c"), F.sum(F.col("label").cast("long")).alias("l"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return grouped.select("score", F.sum("c").over(down).alias("n"), F.sum("l").over(down).alias("hits"), (F.sum("c").over(down) / F.sum("c").over(whole)).alias("coverage"), (F.sum("l").over(down) / F.sum("c").over(down)).alias("precision"))


def aurc(curve: DataFrame) -> DataFrame:
    """``aurc``: the area under risk (1 - precision) over coverage: a first rectangle, then trapezoids."""
    order = Window.orderBy("n")
    risk = 1 - F.col("precision")
    before, was = F.lag("coverage").over(order), F.lag(risk).over(order)
    piece = F.when(before.isNull(), F.col("coverage") * risk).otherwise((F.col("coverage") - before) * (risk + was) / 2)
    return curve.select(piece.alias("piece")).agg(F.sum("piece").alias("aurc"))


def operating_points(curve: DataFrame, coverages: tuple[float, ...] = (0.5, 0.8), precisions: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """``name, value``: precision at a coverage, coverage at a precision, the lowest threshold with a precision (else 1)."""
    rows = [F.struct(F.lit(f"precision_at_{c:g}").alias("name"), F.coalesce(F.min_by("precision", F.when(F.col("coverage") >= c, F.col("n"))), F.lit(0.0)).alias("value")) for c in coverages]
    for p in precisions:
        ok = F.col("precision") >= p
        rows.append(F.struct(F.lit(f"coverage_at_{p:g}").alias("name"), F.coalesce(F.max(F.when(ok, F.col("coverage"))), F.lit(0.0)).alias("value")))
        rows.append(F.struct(F.lit(f"threshold_for_{p:g}").alias("name"), F.coalesce(F.min(F.when(ok, F.col("score"))), F.lit(1.0)).alias("value")))
    return curve.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("x")).select("x.*")


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, confidence, accuracy, gap``: equal bins; the expected error is the mean gap weighted by n."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    out = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def attribute_losses(gold: DataFrame, **stages: DataFrame) -> DataFrame:
    """``gold`` with ``outcome``: the first of ``stages`` (name=spans, in order) that holds the span, else ``never_proposed``."""
    out = gold.dropDuplicates(_SPAN)
    for name, spans in stages.items():
        out = out.join(spans.select(*_SPAN).distinct().withColumn(f"in_{name}", F.lit(True)), _SPAN, "left")
    outcome = F.coalesce(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n in stages], F.lit("never_proposed"))
    return out.withColumn("outcome", outcome).drop(*[f"in_{n}" for n in stages])


#: A run of letters and digits, what bounds a surface; characters other than ASCII that case folding takes for ASCII letters.
_RUN = re.compile("[A-Za-z0-9]+")
_FOLDS = re.compile("[\u0130\u0131\u017f\u212a]")


def occurrences(text: str, surfaces: list[str]) -> list[list[tuple[int, int]]]:
    """For each surface its occurrences, bounded by other characters than letters and digits, case ignored, none overlapping its last.

    Surfaces of ASCII that begin and end with a letter or digit can only lie from the start of one
    run to the end of another as many runs on: one dictionary for each number of runs holds them
    all. Other surfaces, and texts with characters that fold to ASCII, are searched one by one.
    """
    plain = _FOLDS.search(text) is None
    indexed = [bool(plain and s.isascii() and s[:1].isalnum() and s[-1:].isalnum()) for s in surfaces]
    lengths: dict[int, set[str]] = {}
    for s, own in zip(surfaces, indexed, strict=True):
        if own:
            lengths.setdefault(len(_RUN.findall(s)), set()).add(s.lower())
    places: dict[str, list[tuple[int, int]]] = {}
    if lengths:
        runs = [m.span() for m in _RUN.finditer(text)]
        for n, wanted in lengths.items():
            longest = max(map(len, wanted))
            for (a, _), (_, b) in zip(runs, runs[n - 1 :], strict=False):
                if b - a <= longest and (low := text[a:b].lower()) in wanted:
                    mine = places.setdefault(low, [])
                    if not mine or mine[-1][1] <= a:
                        mine.append((a, b))
    out = []
    for s, own in zip(surfaces, indexed, strict=True):
        if own:
            # A surface in another case has the same places: they are taken once.
            out.append(places.pop(s.lower(), []))
        else:
            out.append([m.span() for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])", text, re.IGNORECASE)])
    return out


def expand_gold(docs: DataFrame, terms: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, end, surface``: every token-bounded occurrence of a document's annotated surfaces.

    The longest surface goes first and later ones must not overlap; case is ignored. ``terms``
    has ``doc_id, surface``; with ``zones`` (doc_id, lo, hi) only spans inside one count. A text is
    read once for each number of words that its surfaces have (:func:`occurrences`).
    """
    gathered = terms.distinct().groupBy("doc_id").agg(F.collect_list("surface").alias("surfaces"))
    joined = docs.select("doc_id", "text").join(gathered, "doc_id")
    if zones is not None:
        joined = joined.join(zones.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("zones")), "doc_id")
    else:
        joined = joined.withColumn("zones", F.array(F.struct(F.lit(0).alias("lo"), F.length("text").alias("hi"))))

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text, surfaces, spans in zip(frame["doc_id"], frame["text"], frame["surfaces"], frame["zones"], strict=True):
                taken: list[tuple[int, int]] = []
                covered = bytearray(len(text))
                ordered = sorted(surfaces, key=lambda x: (-len(x), x))
                for found in occurrences(text, ordered):
                    for a, b in found:
                        if any(z["lo"] <= a and b <= z["hi"] for z in spans) and not any(covered[a:b]):
                            covered[a:b] = b"\x01" * (b - a)
                            taken.append((a, b))
                rows += [(doc, a, b, text[a:b]) for a, b in sorted(taken)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "surface"])

    return joined.select(F.col("doc_id").cast("long"), "text", "surfaces", "zones").mapInPandas(run, "doc_id long, start int, end int, surface string")


def evaluation_zones(docs: DataFrame, sections: DataFrame, claim_chars: int = 1400, fallback: int = 2000) -> DataFrame:
    """``doc_id, lo, hi``: where annotations are complete: title, abstract and the first independent claim, cut to
    ``claim_chars``; in a document with none of them its first ``fallback`` characters."""
    own = sections.where("kind IN ('title', 'abstract', 'claim_independent')").select("doc_id", "kind", "start", "end")
    whole = docs.where("length(text) > 0").select("doc_id", F.lit("text").alias("kind"), F.lit(0).alias("start"), F.length("text").alias("end"))
    # One pass over a document's few rows. No joins: a union of tables that joins have dealt out anew can't always be read.
    first = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("start"))
    others = F.max(F.col("kind") != "text").over(Window.partitionBy("doc_id"))
    every = own.unionByName(whole).withColumns({"k": first, "others": others})
    kept = every.where("kind IN ('title', 'abstract') OR (kind = 'claim_independent' AND k = 1) OR (kind = 'text' AND NOT others)")
    most = F.when(F.col("kind") == "claim_independent", F.col("start") + claim_chars).when(F.col("kind") == "text", fallback)
    return kept.select("doc_id", F.col("start").alias("lo"), F.least("end", most).alias("hi"))


def in_zone(spans: DataFrame, zones: DataFrame) -> DataFrame:
    """Spans that lie inside a zone of their document."""
    z = zones.select(F.col("doc_id").alias("zd"), F.col("lo").alias("zl"), F.col("hi").alias("zh"))
    return spans.join(z, (F.col("doc_id") == F.col("zd")) & (F.col("zl") <= F.col("start")) & (F.col("end") <= F.col("zh")), "left_semi")


def invalid_gold(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Annotations whose surface isn't at their place."""
    joined = gold.join(docs.select("doc_id", "text"), "doc_id", "left")
    ok = (F.col("end") <= F.length("text")) & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface"))
    return joined.where(~F.coalesce(ok, F.lit(False))).drop("text")


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 13) -> DataFrame:
    """``n`` rows of each stratum in the order of a digest of the key and the seed: reruns agree."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("rank") <= n).drop("rank")
