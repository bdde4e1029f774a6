"""The whole extraction as one chain of DataFrames, and the commands over its results.

Passes over the corpus are joins: term statistics meet every document once, and nothing is
kept in memory between stages but what Spark caches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import TECHNOLOGY_TYPES, TRUSTED
from ..operators import classify, evaluation, guards, model_tier, recall, score, tokens, trends, verify
from ..operators.lineage import cut
from .config import CONDITIONS, Config


@dataclass
class Lexicons:
    """Input tables: head nouns (``word, type, weight``), closed-class words (``word``), dictionary surfaces
    (``key, entry_id, depth`` and, if known, ``attested_from``), stance cues (``phrase, role, weight``) with priors by
    section, negative and umbrella terms (``term``), and vectors (``surface, vector``) with prototypes (``type, vector``).

    The readers load them from files. Nothing is made up for a table that a switched-on stage needs.
    """

    heads: DataFrame | None = None
    closed: DataFrame | None = None
    cues: DataFrame | None = None
    surfaces: DataFrame | None = None
    negative: DataFrame | None = None
    umbrella: DataFrame | None = None
    priors: dict[str | None, dict[str, float]] | None = None
    vectors: DataFrame | None = None
    prototypes: DataFrame | None = None


@dataclass
class Backends:
    """What answers questions: a verifier (``answer``) and models (``complete``); all optional."""

    verifier: object | None = None
    proposer: object | None = None
    adjudicator: object | None = None
    store: str | None = None


@dataclass
class Extraction:
    """Tables of one run: emitted mentions, rejected ones with reasons, withheld ones, counts by stage, canonical entries, and the emitted ones of tracked types."""

    mentions: DataFrame
    rejected: DataFrame
    abstained: DataFrame
    trace: DataFrame
    entries: DataFrame
    tracked: DataFrame


def _lexicons(docs: DataFrame, given: Lexicons | None, config: Config) -> Lexicons:
    g = given or Lexicons()
    spark = docs.sparkSession
    needed = {"heads": True, "closed": config.recall.cvalue, "cues": True, "surfaces": config.recall.gazetteer}
    missing = [n for n, on in needed.items() if on and getattr(g, n) is None]
    if missing:
        raise ValueError(f"these lexicons are needed: {', '.join(missing)}")
    none = spark.createDataFrame([], "term string")
    roles = g.priors or {None: {r[0]: 0.0 for r in g.cues.select("role").distinct().orderBy("role").collect()}}  # a handful of roles
    if len(roles[None]) < 2:
        roles = {**roles, None: {**roles[None], "unknown": 0.0, "background": 0.0}}
    return replace(g, negative=g.negative if g.negative is not None else none, priors=roles)


def propose(docs: DataFrame, config: Config | None = None, lexicons: Lexicons | None = None, toks: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, end, proposers`` and features: the union of the recallers that are on."""
    config = config or Config()
    c = config.recall
    lex = _lexicons(docs, lexicons, config)
    toks = toks if toks is not None else cut(tokens.tokens(docs))
    parts = []
    if c.pattern:
        parts.append(recall.phrase_candidates(docs, lex.heads if c.head_gate else None))
        if claims is not None:
            framed = recall.claim_frames(docs, claims).select("doc_id", "start", "end").distinct()
            parts.append(framed.select("*", F.lit("pattern").alias("recaller"), F.lit(1).alias("framed")))
    if c.abbrev:
        parts.append(recall.abbreviation_candidates(recall.abbreviation_pairs(docs)))
    if c.cvalue:
        occ = cut(recall.term_occurrences(toks, lex.heads, lex.closed))
        values = recall.ncvalue(recall.cvalue(recall.with_share(occ, lex.cues.select(F.col("phrase").alias("word"))), lex.heads))
        accepted = cut(recall.top_terms(values, c.cvalue_terms, c.cvalue_least))
        parts.append(recall.cvalue_candidates(occ, accepted))
    if c.gazetteer:
        hits = recall.leftmost_longest(recall.gazetteer_hits(toks, lex.surfaces))
        parts.append(hits.select("doc_id", "start", "end", F.lit("gazetteer").alias("recaller"), "entry_id", "depth"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, start int, end int, proposers array<string>, ncvalue double, entry_id string, depth int, framed int, llm_type string")
    return _with_features(recall.merge_candidates(parts))


def _with_features(merged: DataFrame) -> DataFrame:
    for name, kind in (("ncvalue", "double"), ("entry_id", "string"), ("depth", "int"), ("framed", "int"), ("llm_type", "string")):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast(kind))
    return merged


def _sections(docs: DataFrame) -> DataFrame:
    """Sections of each text by its genre (``paper`` where none is given): headings, or claims beside them."""
    genre = F.col("genre") if "genre" in docs.columns else F.lit("paper")
    papers = tokens.heading_sections(docs.where(F.coalesce(genre, F.lit("paper")) != "patent"))
    patents = docs.where(genre == "patent")
    spans = tokens.heading_sections(patents, "patent").where("kind <> 'other'").select("doc_id", "kind", "start", "end")
    claims = tokens.claims(patents).select("doc_id", "kind", "start", "end")
    every = papers.select("doc_id", "kind", "start", "end").unionByName(claims).unionByName(spans)
    return tokens.clamp_sections(every, docs)


def _verified(found: DataFrame, docs: DataFrame, lex: Lexicons, config: Config, backends: Backends) -> DataFrame:
    """``found`` with ``verdict, source, verdict_reason, verifier_score``: structure, prototypes, answers, adjudication."""
    v = config.verify
    out = found
    embedding, likeness = F.lit(None).cast("string"), F.lit(0.0)
    claims_tech = F.col("type").isin(*TECHNOLOGY_TYPES)
    if v.embedding and lex.vectors is not None and lex.prototypes is not None:
        # Distinct surfaces meet the prototypes once.
        vectors = found.select(F.lower("surface").alias("surface")).distinct().join(lex.vectors.select(F.lower("surface").alias("surface"), "vector"), "surface")
        margins = verify.margins(vectors.select(F.col("surface").alias("vec_id"), F.col("vector").alias("embedding")), verify.unit(lex.prototypes.select(F.col("type").alias("label"), F.col("vector").alias("embedding"))).select("label", F.col("unit").alias("centroid")), list(TECHNOLOGY_TYPES))
        out = out.withColumn("__low", F.lower("surface")).join(margins.select(F.col("vec_id").alias("__low"), F.col("nearest").alias("__near"), F.col("margin").alias("__margin")), "__low", "left")
        embedding, likeness = verify.embedding_verdict(F.col("__margin"), F.col("__near").isin(*TECHNOLOGY_TYPES), claims_tech, v.low, v.high)
        embedding, likeness = F.when(F.col("__margin").isNotNull(), embedding), F.coalesce(likeness, F.lit(0.0))
    out = out.withColumns({"__emb": embedding, "__like": likeness})
    answered = F.lit(None).cast("string")
    if v.llm and backends.verifier is not None:
        out = cut(out.withColumn("__q", verify.question_key(F.col("surface"), F.col("type"), F.col("evidence"))))
        residue = out.where("grounded AND coalesce(__emb, 'abstain') = 'abstain'")
        replies = verify.ask(verify.batches(verify.questions(residue), v.batch), backends.verifier)
        replies = cut(replies.dropDuplicates(["qkey"]).select(F.col("qkey").alias("__q"), "is_tech", "type_ok", F.col("reason").alias("__why")))
        out = out.join(replies, "__q", "left")
        answered = F.when(F.col("is_tech").isNotNull() & F.coalesce(F.col("__emb") == "abstain", F.lit(True)), verify.decide(F.col("is_tech"), claims_tech, F.col("type_ok")))
    verdict, source = model_tier.settle(F.col("grounded"), F.col("__emb"), answered)
    why = F.coalesce("__why", F.lit("")) if "__why" in out.columns else F.lit("")
    out = out.withColumns({"verdict": verdict, "source": source, "verdict_reason": why, "verifier_score": F.when(source == "llm", (verdict == "pass").cast("double")).otherwise(F.col("__like"))})
    out = out.drop(*[c for c in out.columns if c.startswith("__")], "is_tech", "type_ok")
    if v.adjudicate and backends.adjudicator is not None:
        narrow = out.select("doc_id", "start", "end", "surface", "proposers", "verdict", "source", F.col("verdict_reason").alias("reason"))
        settled = model_tier.adjudicate(cut(narrow), docs, backends.adjudicator, store=backends.store)
        settled = cut(settled.select("doc_id", "start", "end", "verdict", "source", F.col("reason").alias("verdict_reason")))
        out = out.drop("verdict", "source", "verdict_reason").join(settled, ["doc_id", "start", "end"])
    return out


def integrity(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions that break what every emitted one must hold, with the ``violation``; none should.

    All is derived anew from the text: the span reads as its surface, the evidence holds it, the
    content hash is that of the span, and a recaller proposed it.
    """
    own = mentions.join(docs.select("doc_id", "text"), "doc_id", "left")
    ok = guards.grounded(F.col("text"), F.col("start"), F.col("end"), F.col("surface"))
    evidence = guards.evidence_ok(F.col("text"), F.col("start"), F.col("end"), F.col("surface"), F.col("ev_start"), F.col("ev_end"))
    hashed = T.content_hash(F.col("doc_id"), F.col("start"), F.col("end"), F.col("surface"))
    broken = F.when(~F.coalesce(ok, F.lit(False)), "grounding").when(~F.coalesce(evidence, F.lit(False)), "evidence").when(hashed != F.col("content_hash"), "hash").when(F.size("proposers") < 1, "proposers")
    return own.withColumn("violation", broken).where("violation IS NOT NULL").drop("text")


def canonicalise(mentions: DataFrame, pairs: DataFrame, years: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``mentions`` with ``canonical_id`` and, in links that lack one, ``attested_from``; and the table of entries.

    Keys meet by explained abbreviations, by one knowledge-base entry, and else (with ``vectors``:
    ``key, vector``) by likeness of keys that share a head or contain each other.
    """
    keyed = cut(score.resolve(mentions, score.alias_map(pairs, last=True)))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"))
    links = keyed.where("entry_id IS NOT NULL").groupBy("key", "entry_id").agg(F.count("*").alias("n"))
    roots = score.kb_merge(links).select("key", F.col("anchor").alias("root"))
    if vectors is not None:
        unlinked = cut(groups.join(links.select("key").distinct(), "key", "left_anti"))
        roots = roots.unionByName(score.nil_clusters(unlinked, vectors))
    known = keyed.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    dated = known.join(years.select("doc_id", "year"), "doc_id", "left") if years is not None else known.withColumn("year", F.lit(None).cast("int"))
    dated = cut(dated)
    entries = score.canonical_entries(dated)
    ids = entries.select("root", "canonical_id", "first_seen")
    out = dated.join(ids, "root")
    attested = F.col("attested_from") if "attested_from" in mentions.columns else F.lit(None).cast("int")
    filled = F.when(F.col("entry_id").isNotNull(), F.coalesce(attested, F.col("first_seen")))
    kept = [c for c in mentions.columns if c not in ("attested_from", "canonical_id")]
    return out.select(*kept, filled.alias("attested_from"), "canonical_id"), entries


def extract(docs: DataFrame, config: Config | None = None, lexicons: Lexicons | None = None, backends: Backends | None = None) -> Extraction:
    """Mentions of a corpus (``doc_id, text``, optionally ``genre, year``): proposed, guarded, typed, verified, scored, decoded, named.

    A document with a null or empty text has no mentions. Tokens are found once, written and
    dealt out by document; so are candidates. A guard that can't decide lowers confidence; only
    rejections remove a mention. What breaks the integrity of the result is never emitted.
    """
    config, backends = config or Config(), backends or Backends()
    given = docs
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in ("genre", "year") if c in given.columns]).where("text IS NOT NULL")
    lex = _lexicons(docs, lexicons, config)
    texts = docs.select("doc_id", "text")
    toks = cut(tokens.tokens(texts))
    sections = cut(_sections(docs))
    found = cut(propose(texts, config, lex, toks, sections.where("kind LIKE 'claim%'")))
    if config.recall.llm and backends.proposer is not None:
        shown = model_tier.windows(texts, sections, found.select("doc_id", "start"), config.recall.llm_windows, min(model_tier.WINDOW, config.recall.llm_chars))
        more = model_tier.propose(texts, cut(shown), backends.proposer, store=backends.store)
        again = found.select("doc_id", "start", "end", F.explode("proposers").alias("recaller"), "ncvalue", "entry_id", "depth", "framed")
        found = cut(_with_features(recall.merge_candidates([again, more])))
    # Sentences give evidence, and are what instructions hide in.
    found = tokens.section_at(tokens.sentence_of(found, tokens.sentences(texts)), sections).join(texts, "doc_id")
    found = found.withColumn("surface", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    found = found.withColumns({"ev_start": F.coalesce(F.least("ev_start", "start"), "start"), "ev_end": F.least(F.greatest(F.coalesce("ev_end", "end"), F.col("end")), F.length("text"))})
    ok = guards.grounded(F.col("text"), F.col("start"), F.col("end"), F.col("surface"))
    evidence = F.substring("text", F.col("ev_start") + 1, F.col("ev_end") - F.col("ev_start"))
    lo = F.greatest(F.lit(0), F.col("start") - 240)
    injected = guards.injection_verdict(evidence, F.substring("text", lo + 1, F.col("end") + 240 - lo)) if config.guards.injection else F.lit("pass")
    agreed = guards.consensus_verdict(F.col("proposers"), config.guards.consensus)
    checked = guards.negative_guard(found, lex.negative).withColumns({"grounded": ok, "injected": injected, "agreed": agreed, "evidence": evidence})
    reason = F.when(~F.col("grounded"), "grounding") if config.guards.grounding else F.lit(None).cast("string")
    if config.guards.negative:
        reason = F.coalesce(reason, F.col("reason"))
    reason = F.coalesce(reason, F.when(F.col("injected") == "reject", "injection"))
    # Every table below reads the judged candidates: they are made once, with their contexts and without their texts.
    staged = classify.predict_role(checked.withColumn("reason", reason), lex.cues, lex.priors, section=F.col("section")).withColumnRenamed("margin", "role_margin").drop("prob", "fired", "text")
    judged = cut(staged.withColumn("guard_flags", (F.col("injected") == "abstain").cast("int") + (F.col("agreed") == "abstain").cast("int")))
    pruned = recall.prune(
        judged.where("reason IS NULL").withColumn("score", recall.candidate_score(
            F.size("proposers"), F.col("entry_id").isNotNull().cast("int"), F.array_contains("proposers", "abbrev").cast("int"), F.array_contains("proposers", "llm").cast("int"),
            F.coalesce("framed", F.lit(0)), F.coalesce("ncvalue", F.lit(0.0)), F.array_contains("proposers", "pattern").cast("int"), T.orthographic(F.col("surface")), F.size(F.split("surface", " ")),
        )), config.output.cap,
    )
    llm_type = "llm_type" if config.recall.llm and backends.proposer is not None else None
    features = classify.type_features(pruned, lex.heads, lex.umbrella)
    if lex.vectors is not None and lex.prototypes is not None:
        features = classify.prototype_features(features, lex.vectors, lex.prototypes)
    typed = classify.predict_type(features, llm_type)
    verified = _verified(typed, texts, lex, config, backends)
    if "year" in docs.columns and config.guards.temporal and lex.surfaces is not None and "attested_from" in lex.surfaces.columns:
        dated = lex.surfaces.groupBy("entry_id").agg(F.min("attested_from").alias("attested_from"))
        verified = verified.join(dated, "entry_id", "left").join(docs.select("doc_id", "year"), "doc_id", "left")
        late = F.coalesce(guards.temporal_verdict(F.col("year"), F.col("attested_from")) == "abstain", F.lit(False))
        verified = verified.withColumn("guard_flags", F.col("guard_flags") + late.cast("int")).drop("year")
    else:
        verified = verified.withColumn("attested_from", F.lit(None).cast("int"))
    on = config.guards.verifier
    denied = (F.col("verdict") == "reject") & F.lit(on)
    doubted = (F.col("verdict") == "abstain") & (F.col("source") != "structural") & F.lit(on)
    sizes = T.orthographic(F.col("surface"))
    feats = score.confidence_features(
        n_proposers=F.size("proposers"), trusted_proposer=F.arrays_overlap("proposers", F.array(*map(F.lit, TRUSTED))).cast("int"), kb_hit=F.col("entry_id").isNotNull().cast("int"),
        type_margin=F.col("margin"), type_prob=F.col("prob"), guard_flags=F.col("guard_flags") + doubted.cast("int"), distinctive_form=sizes,
        llm_proposed=F.array_contains("proposers", "llm").cast("int"), section_weight=score.section_weight(F.col("section")), asserted_contribution=F.col("role").isin("proposed", "claimed").cast("int"),
        verifier_score=F.when(F.lit(on), F.col("verifier_score")).otherwise(0.0), verifier_passed=((F.col("verdict") == "pass") & F.lit(on)).cast("int"),
        verifier_llm=((F.col("source") == "llm") & F.lit(on)).cast("int"), verifier_abstained=doubted.cast("int"),
    )
    scored = verified.withColumn("confidence", score.confidence(feats))
    routed = F.when(denied, "denied").otherwise(score.route(F.col("type"), F.col("confidence"), config.output.abstain_below))
    keep = ["doc_id", "start", "end", "surface", "proposers", "type", "margin", "granularity", "role", "role_margin", "section", "confidence", "entry_id", "attested_from", "ev_start", "ev_end", "verdict", "source", "guard_flags"]
    named = scored.select(*keep, routed.alias("route"), F.lit(config.digest()).alias("config_digest"), T.content_hash(F.col("doc_id"), F.col("start"), F.col("end"), F.col("surface")).alias("content_hash"), F.col("lemma").alias("normalized"))
    named = cut(named.withColumn("mention_id", T.stable_id(F.concat_ws(":", "doc_id", "start", "end"))))
    decoded = cut(score.decode(named.where("route = 'emitted'")).drop("route"))
    broken = cut(integrity(decoded, texts).select("doc_id", "start", "end", "surface", "proposers", F.concat(F.lit("integrity:"), "violation").alias("reason")))
    sound = decoded.join(broken, ["doc_id", "start", "end"], "left_anti")
    pairs = recall.abbreviation_pairs(texts)
    keys = lex.vectors.select(T.lemma_key(F.col("surface")).alias("key"), "vector").dropDuplicates(["key"]) if lex.vectors is not None else None
    emitted, entries = canonicalise(sound, pairs, docs.select("doc_id", "year") if "year" in docs.columns else None, keys)
    emitted = cut(emitted)
    tracked = emitted.where(F.col("type").isin(*config.output.tracked_types))
    rejected = judged.where("reason IS NOT NULL").select("doc_id", "start", "end", "surface", "proposers", "reason")
    why = F.when(F.col("route") == "denied", F.concat(F.lit("verifier:"), "source")).otherwise("not_tech")
    rejected = rejected.unionByName(named.where("route IN ('rejected', 'denied')").select("doc_id", "start", "end", "surface", "proposers", why.alias("reason"))).unionByName(broken)
    abstained = named.where("route = 'abstained'").drop("route")
    stages = (("proposed", judged), ("pruned", named), ("rejected", rejected), ("abstained", abstained), ("decoded", decoded), ("integrity", broken), ("emitted", emitted), ("tracked", tracked))
    counts = [df.agg(F.lit(n).alias("stage"), F.count("*").alias("n")) for n, df in stages]
    trace = counts[0]
    for c in counts[1:]:
        trace = trace.unionByName(c)
    return Extraction(emitted, rejected, abstained, trace, entries, tracked)


def inspect(docs: DataFrame, doc_id: int, config: Config | None = None, lexicons: Lexicons | None = None) -> Extraction:
    """One document's extraction."""
    return extract(docs.where(F.col("doc_id") == doc_id), config, lexicons)


def trend_tables(mentions: DataFrame, documents: DataFrame, least: float = 0.5, types: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Series and their analyses from mentions (``doc_id, normalized, type, role, confidence``) and ``doc_id, year``."""
    kept = mentions.where(F.col("confidence") >= least)
    if types is not None:
        kept = kept.where(F.col("type").isin(*types))
    role = F.col("role") if "role" in mentions.columns else F.lit("unknown")
    keyed = kept.select("doc_id", F.coalesce("canonical_id", "normalized").alias("key") if "canonical_id" in mentions.columns else F.col("normalized").alias("key"), role.alias("role"))
    series, totals = trends.series_year(keyed, documents), trends.year_totals(documents)
    return {
        "year_totals": totals, "series": series, "share": trends.series_share(series, totals), "top": trends.top_series(series), "emerging": trends.emerging(series, totals),
        "transitions": trends.role_transitions(trends.series_role(keyed, documents), series), "cooccurrence": trends.cooccurrence(keyed),
    }


def evaluate(mentions: DataFrame, gold: DataFrame, zones: DataFrame | None = None, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores and calibration of mentions (with ``confidence``) against annotated spans.

    ``scores``: strict and partial precision, recall and F1, and the shares of partial pairs with
    the right type and role (annotated ``unknown`` roles don't count). With ``zones`` (``doc_id,
    lo, hi``) only spans inside one count, on both sides. ``hallucinated`` (with ``docs``) is the
    share of all emitted mentions whose text isn't their surface.
    """
    emitted = mentions
    if zones is not None:
        mentions, gold = evaluation.in_zone(mentions, zones), evaluation.in_zone(gold, zones)
    mentions, gold = cut(mentions), cut(gold)
    hit = evaluation.align_strict(mentions.select("doc_id", "start", "end"), gold.select("doc_id", "start", "end")).withColumn("label", F.lit(1))
    labelled = cut(mentions.join(hit, ["doc_id", "start", "end"], "left").select(F.col("confidence").alias("score"), F.coalesce("label", F.lit(0)).alias("label")))
    sizes = mentions.agg(F.count("*").alias("n_system")).crossJoin(gold.agg(F.count("*").alias("n_gold")))  # one row each
    partial = cut(evaluation.align_partial(mentions.select("doc_id", "start", "end"), gold.select("doc_id", "start", "end")))
    both = partial.join(mentions.select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), *[F.col(c).alias(f"s_{c}") for c in ("type", "role") if c in mentions.columns]), ["doc_id", "s_start", "s_end"])
    both = both.join(gold.select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), *[F.col(c).alias(f"g_{c}") for c in ("type", "role") if c in gold.columns]), ["doc_id", "g_start", "g_end"])
    right = {}
    for c in ("type", "role"):
        if f"s_{c}" in both.columns and f"g_{c}" in both.columns:
            counted = F.col(f"g_{c}") != "unknown" if c == "role" else F.col(f"g_{c}").isNotNull()
            right[f"{c}_accuracy"] = F.avg(F.when(counted, (F.col(f"s_{c}") == F.col(f"g_{c}")).cast("double")))
    named = lambda df, kind: evaluation.prf(df).select(F.lit(kind).alias("alignment"), "*")
    strict = named(hit.agg(F.count("*").alias("tp")).crossJoin(sizes), "strict")
    loose = named(partial.agg(F.count("*").alias("tp")).crossJoin(sizes), "partial")
    curve = cut(evaluation.risk_coverage(labelled))
    out = {"scores": strict.unionByName(loose), "curve": curve, "aurc": evaluation.aurc(curve), "ece": evaluation.ece(labelled), "points": evaluation.operating_points(curve), "partial": both}
    if right:
        out["accuracy"] = both.agg(*[v.alias(k) for k, v in right.items()])
    if docs is not None:
        read = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
        out["hallucinated"] = emitted.join(docs.select("doc_id", "text"), "doc_id").agg(F.avg((read != F.col("surface")).cast("double")).alias("rate"))
    return out


def run_suite(docs: DataFrame, gold: DataFrame, lexicons: Lexicons | None = None, conditions: dict | None = None) -> DataFrame:
    """``condition, alignment, tp, n_system, n_gold, precision, recall, f1`` of every condition."""
    out = None
    for name, overrides in (conditions or CONDITIONS).items():
        found = extract(docs, Config().override(**overrides), lexicons).mentions
        row = cut(evaluate(found, gold)["scores"]).select(F.lit(name).alias("condition"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def plan(docs: DataFrame, config: Config | None = None) -> DataFrame:
    c = (config or Config()).recall
    return verify.plan(docs, c.llm_windows, cap=c.llm_chars)


def guard_report(rejected: DataFrame) -> DataFrame:
    """``reason, n, share``: what stands before a colon in the reason counts."""
    n = rejected.groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("reason", "n", (F.col("n") / F.col("total")).alias("share"))
