"""Guards: filters that record why a candidate was rejected or doubted, and grounding.

A guard gives a verdict (``pass``, ``reject``, ``abstain``) and a reason. In a cascade the first
rejection decides and later guards aren't evaluated for it; abstentions are counted and survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FUNCTION_WORDS, INJECTION, ORGANISATIONS, TRUSTED, UNITS
from ..functions.text import lemma_key, strip_determiner

MAX_TOKENS = 8
ORG_PATTERN = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(ORGANISATIONS) + r")\.?$"
PERSON_PATTERN = r"^[A-Z][a-z]+[ \t]+(et[ \t]+al\.?|and[ \t]+[A-Z][a-z]+)$"
NUMBER_PATTERN = r"^[0-9 \t.,%/+-]+$"
UNIT_PATTERN = r"(?i)^[0-9]+(\.[0-9]+)?[ \t]*(" + "|".join(UNITS) + r")$"
ALL_FUNCTION = r"(?i)^((" + "|".join(FUNCTION_WORDS) + r")[.,;:]*([ \t\n]+|$))+$"
DANGLING = r"(?i)(^|[ \t\n])(" + "|".join(FUNCTION_WORDS) + r")$"


def grounded(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """The span lies in its text, reads as its surface and holds a letter or digit."""
    return (end <= F.length(text)) & (start >= 0) & (F.substring(text, start + 1, end - start) == surface) & surface.rlike(r"[\p{L}\p{N}]")


def negative_reason(surface: Column, in_lexicon: Column, min_chars: int = 3, max_tokens: int = MAX_TOKENS) -> Column:
    """Why a surface is no term, or null; ``in_lexicon`` says whether its lemma key is a negative entry."""
    bare = strip_determiner(F.btrim(surface, F.lit(" \t\n")))
    n = F.size(F.split(bare, r"[ \t\n]+"))
    return (
        F.when(F.length(bare) < min_chars, "too_short")
        .when(n > max_tokens, "too_long")
        .when(bare.rlike(ALL_FUNCTION), "function_words")
        .when(in_lexicon, "negative_lexicon")
        .when(bare.rlike(NUMBER_PATTERN) | bare.rlike(UNIT_PATTERN), "numeric")
        .when(bare.rlike(ORG_PATTERN), "organisation")
        .when(bare.rlike(PERSON_PATTERN), "person")
        .when(bare.rlike(DANGLING), "dangling")
    )


def negative_guard(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``candidates`` (with ``surface``) and ``reason``; ``lexicon`` has one ``term`` a row, as lemma keys, and goes to every task: candidates, often with their texts, aren't shuffled."""
    keyed = candidates.withColumn("lemma", lemma_key(F.col("surface"))).join(F.broadcast(lexicon.select(F.col("term").alias("lemma"), F.lit(True).alias("listed")).distinct()), "lemma", "left")
    return keyed.withColumn("reason", negative_reason(F.col("surface"), F.col("listed").isNotNull())).drop("listed", "lemma")


def injection_hits(docs: DataFrame) -> DataFrame:
    """``doc_id, family, start, end`` of every sign of an instruction in a text."""
    from .tokens import pieces

    out = None
    for family, pattern in INJECTION:
        part = pieces(docs, pattern).select("doc_id", F.lit(family).alias("family"), "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


def document_risk(docs: DataFrame) -> DataFrame:
    """Counts by family, in columns."""
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(f) for f, p in INJECTION])


def any_injection(text: Column) -> Column:
    found = F.lit(False)
    for _, p in INJECTION:
        found = found | text.rlike(p)
    return found


def injection_verdict(sentence: Column, near: Column) -> Column:
    """Reject in a sentence with a sign; doubt within reach of one (``near``: the text around)."""
    return F.when(any_injection(sentence), "reject").when(any_injection(near), "abstain").otherwise("pass")


#: What any sign needs, wherever a text is cut: the patterns without the conditions on what stands beside them.
_LOOSE = "|".join("(" + p.replace(r"\b", "").replace(r"(^|\n)", "") + ")" for _, p in INJECTION)


def injection_verdicts(docs: DataFrame, reach: int = 240) -> DataFrame:
    """``doc_id, start, verdict`` of every token, as :func:`injection_verdict` of its sentence and the ``reach`` characters around it.

    A text without a loose sign has none in any part, so its tokens pass unread. In other texts each
    sentence is read once, and the surroundings of those tokens alone that a loose sign reaches.
    """
    from .lineage import cut
    from .tokens import pieces, sentence_of, sentences, tokens

    signed = F.coalesce(F.col("text").rlike(_LOOSE), F.lit(False))
    clean, risky = docs.where(~signed), cut(docs.where(signed))  # few: written once, read by every step below
    passed = tokens(clean).select((F.col("doc_id") + 0).alias("doc_id"), "start", F.lit("pass").alias("verdict"))
    read = sentences(risky).join(risky, "doc_id")
    read = read.select("doc_id", "sent_idx", "start", "end", any_injection(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("sign"))
    spans = sentence_of(tokens(risky).select("doc_id", "start", "end"), read)
    lo = F.greatest(F.lit(0), F.col("start") - reach)
    # Signs and surroundings in order: the furthest end of a sign that begins before a token's reach ends.
    signs = pieces(risky, _LOOSE).select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.col("end").alias("upto"))
    both = spans.withColumns({"at": F.col("end") + reach, "side": F.lit(1)}).unionByName(signs, allowMissingColumns=True)
    furthest = F.max("upto").over(Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    judged = both.withColumn("furthest", furthest).where("side = 1").withColumn("near", F.coalesce(F.col("furthest") > lo, F.lit(False)))
    judged = judged.select("doc_id", "start", "end", F.coalesce("sign", F.lit(False)).alias("sign"), "near")
    reached = judged.where("near AND NOT sign").join(risky, "doc_id")
    around = F.substring("text", lo + 1, F.col("end") + reach - lo)
    reached = reached.select("doc_id", "start", F.when(any_injection(around), "abstain").otherwise("pass").alias("verdict"))
    rest = judged.where("sign OR NOT near").select((F.col("doc_id") + 0).alias("doc_id"), "start", F.when(F.col("sign"), "reject").otherwise("pass").alias("verdict"))
    return passed.unionByName(rest).unionByName(reached)


def consensus_verdict(proposers: Column, least: int = 2) -> Column:
    trusted = F.arrays_overlap(proposers, F.array(*map(F.lit, TRUSTED)))
    return F.when(trusted | (F.size(proposers) >= least), "pass").otherwise("abstain")


def evidence_ok(text: Column, start: Column, end: Column, surface: Column, ev_start: Column, ev_end: Column) -> Column:
    evidence = F.substring(text, ev_start + 1, ev_end - ev_start)
    return (ev_start <= start) & (end <= ev_end) & (ev_end <= F.length(text)) & evidence.contains(surface)


def temporal_verdict(year: Column, attested_from: Column) -> Column:
    """A link to something first attested more than a year later is doubted; undated ones pass."""
    return F.when((year + 1) < attested_from, "abstain").otherwise("pass")


def provenance_ok(doc_id: Column, own_doc: Column, proposers: Column, content_hash: Column, expected: Column) -> Column:
    return F.coalesce((doc_id == own_doc) & (F.size(proposers) > 0) & (content_hash == expected), F.lit(False))


def _nearest(hay: Column, needle: Column, anchor: Column, rung: str) -> Column:
    """The occurrence of a needle nearest to ``anchor``: one fold over the pieces between all occurrences."""
    literal = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.call_function("split", hay, literal, F.lit(-1))
    n, width = F.size(parts) - 1, F.length(needle)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("far"), F.lit(None).cast("int").alias("start"))

    def step(acc: Column, part: Column) -> Column:
        here = acc["at"] + F.length(part)
        far = F.abs(here - anchor)
        better = acc["far"].isNull() | (far < acc["far"])
        return F.struct((here + width).alias("at"), F.when(better, far).otherwise(acc["far"]).alias("far"), F.when(better, here).otherwise(acc["start"]).alias("start"))

    best = F.aggregate(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))), start, step)
    return F.when((n > 0) & (width > 0), F.struct(F.lit(rung).alias("status"), best["start"].alias("start"), (best["start"] + width).alias("end")))


def ground(quotes: DataFrame, least: float = 0.9) -> DataFrame:
    """``quotes`` (``id, text, quote, anchor``; ids are unique) with ``status, start, end``.

    Rungs in order: exact, white space ignored, case ignored, and ``fuzzy``, the token window
    whose similarity (one less edit distance over the longer length) is ``least`` or more. On
    the first and third rung the occurrence nearest to ``anchor`` counts, of all there are;
    without an anchor the first. What no rung finds is ``missing``.
    """
    anchor = F.coalesce("anchor", F.lit(0))
    exact = _nearest(F.col("text"), F.col("quote"), anchor, "exact")
    same_length = F.length(F.lower("text")) == F.length("text")
    folded = F.when(same_length, _nearest(F.lower("text"), F.lower("quote"), anchor, "case"))
    spaced = F.regexp_replace(F.regexp_replace("quote", r"([\\\[\](){}.*+?^$|])", r"\\$1"), r"[ \t\n]+", r"[ \\t\\n]+")
    loose = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("("), spaced, F.lit(")")), F.lit(1))
    loose_at = F.call_function("instr", F.col("text"), loose) - 1
    space = F.when(loose != "", F.struct(F.lit("whitespace").alias("status"), loose_at.alias("start"), (loose_at + F.length(loose)).alias("end")))
    first = quotes.withColumn("hit", F.coalesce(exact, space, folded))
    fuzzy = fuzzy_windows(first.where("hit IS NULL AND length(quote) > 0").select("id", "text", "quote"), least)
    fuzzy = fuzzy.select("id", F.struct(F.lit("fuzzy").alias("status"), F.col("start").alias("start"), F.col("end").alias("end")).alias("near"))
    joined = first.join(fuzzy, "id", "left").withColumn("hit", F.coalesce("hit", "near"))
    return joined.withColumns({"status": F.coalesce("hit.status", F.lit("missing")), "start": F.col("hit.start"), "end": F.col("hit.end")}).drop("hit", "near")


def fuzzy_windows(quotes: DataFrame, least: float = 0.9) -> DataFrame:
    """``id, start, end, similarity``: the best token window of each quote, 0.6 to 1.4 times as long."""
    from .tokens import pieces

    toks = pieces(quotes.select(F.col("id").alias("doc_id"), "text"), r"[^ \t\n]+")
    ends = toks.select(F.col("doc_id").alias("d2"), F.col("pos").alias("p2"), F.col("end").alias("e2"))
    sized = toks.join(quotes.withColumnRenamed("id", "doc_id"), "doc_id")
    # So many characters hold at most half as many tokens.
    most = F.floor(F.length("quote") * 0.7).cast("int")
    joined = sized.join(ends, (F.col("doc_id") == F.col("d2")) & F.col("p2").between(F.col("pos"), F.col("pos") + most))
    piece = F.substring("text", F.col("start") + 1, F.col("e2") - F.col("start"))
    n = F.length("quote")
    near = joined.where((F.length(piece) >= 0.6 * n) & (F.length(piece) <= 1.4 * n))
    likeness = 1.0 - F.levenshtein(piece, F.col("quote")) / F.greatest(F.length(piece), n)
    best = near.select("doc_id", "start", F.col("e2").alias("end"), likeness.alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    return best.groupBy("doc_id").agg(F.max_by(F.struct("start", "end", "similarity"), F.struct("similarity", -F.col("start"), -F.col("end"))).alias("b")).select(F.col("doc_id").alias("id"), "b.*")
