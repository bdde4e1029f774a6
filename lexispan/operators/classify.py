"""Typing and stance: linear scores from weight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import GRANULARITY, PROTO_SELF, PROTO_TECH, TECHNOLOGY_TYPES, TYPE_WEIGHTS, TYPES
from ..functions.text import decay, dot, lemma_key, orthographic, squash, winner_probability

#: Features that are the same for every type.
PLAIN = ("orthographic", "umbrella", "kb_hit", "kb_depth_shallow", "kb_depth_deep", "n_tokens", "has_digit", "has_upper", "all_lower", "hyphenated", "abbrev_pair", "ncvalue", "head_is_tech", "suffix_ing", "suffix_ion")


def type_features(mentions: DataFrame, heads: DataFrame, umbrella: DataFrame | None = None) -> DataFrame:
    """``mentions`` with the features of typing; heads, broadcast, are joined on the last token of the lemma key.

    Optional columns of ``mentions`` are used where present: ``entry_id, depth, ncvalue,
    proposers, llm_type``.
    """
    s = F.col("surface")
    has = set(mentions.columns)
    f = mentions.withColumn("lemma", lemma_key(s)).withColumn("head", F.regexp_extract("lemma", "[^ ]*$", 0))
    f = f.join(F.broadcast(heads.select(F.col("word").alias("head"), F.col("type").alias("head_type"))), "head", "left")
    one = lambda c: c.cast("double")
    depth = F.coalesce("depth", F.lit(-1)) if "depth" in has else F.lit(-1)
    f = f.withColumns(
        {
            "orthographic": F.least(orthographic(s) / 2.5, F.lit(1.0)),
            "kb_hit": one(F.col("entry_id").isNotNull()) if "entry_id" in has else F.lit(0.0),
            "kb_depth_shallow": one(depth.between(0, 1).cast("int")),
            "kb_depth_deep": one((depth >= 3).cast("int")),
            "n_tokens": F.least(F.size(F.split("lemma", " ")), F.lit(5)) / 5.0,
            "has_digit": one(s.rlike("[0-9]").cast("int")),
            "has_upper": one(F.expr("substring(surface, 2)").rlike(r"\p{Lu}").cast("int")),
            "all_lower": one((F.lower(s) == s).cast("int")),
            "hyphenated": one(s.contains("-").cast("int")),
            "abbrev_pair": one(F.array_contains("proposers", "abbrev").cast("int")) if "proposers" in has else F.lit(0.0),
            "ncvalue": squash(F.coalesce("ncvalue", F.lit(0.0))) if "ncvalue" in has else F.lit(0.0),
            "head_is_tech": one(F.col("head_type").isNotNull().cast("int")),
            "suffix_ing": one(F.col("head").endswith("ing").cast("int")),
            "suffix_ion": one((F.col("head").endswith("tion") | F.col("head").endswith("sion")).cast("int")),
            "head_type": F.coalesce("head_type", F.lit("")),
        }
    )
    if umbrella is None:
        return f.withColumn("umbrella", F.lit(0.0))
    listed = umbrella.select(F.col("term").alias("lemma"), F.lit(1.0).alias("umbrella"))
    return f.join(F.broadcast(listed), "lemma", "left").withColumn("umbrella", F.coalesce("umbrella", F.lit(0.0)))


def prototype_features(mentions: DataFrame, vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``mentions`` with ``proto_margin`` and ``proto_<type>``, the back-off where lexicons say little.

    ``vectors`` has ``surface, vector``, ``prototypes`` a vector for each type. The margin is tanh of
    6 times the best cosine to a technology's prototype less the best to another; a type's own
    feature is 6 times its cosine less the mean over types. Without a vector all are 0.
    """
    rows = {r["type"]: [float(v) for v in r["vector"]] for r in prototypes.collect()}  # one for each type
    norm = lambda c: F.sqrt(dot(c, c))
    own = vectors.groupBy(F.lower("surface").alias("__low")).agg(F.first("vector").alias("__v"))
    out = mentions.withColumn("__low", F.lower("surface")).join(own, "__low", "left")
    cosines = {}
    for kind, vector in rows.items():
        length = sum(v * v for v in vector) ** 0.5 or 1.0
        against = F.array(*[F.lit(v / length) for v in vector])
        cosines[kind] = F.coalesce(dot(F.col("__v"), against) / F.nullif(norm(F.col("__v")), F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({f"__c_{k}": c for k, c in cosines.items()})
    tech = [F.col(f"__c_{k}") for k in rows if k in TECHNOLOGY_TYPES] or [F.lit(0.0)]
    rest = [F.col(f"__c_{k}") for k in rows if k not in TECHNOLOGY_TYPES] or [F.lit(0.0)]
    best = lambda cs: F.array_max(F.array(*cs))
    mean = sum((F.col(f"__c_{k}") for k in rows), F.lit(0.0)) / max(1, len(rows))
    new = {"proto_margin": F.tanh(6.0 * (best(tech) - best(rest)))} | {f"proto_{k}": F.when(F.col("__v").isNotNull(), 6.0 * (F.col(f"__c_{k}") - mean)).otherwise(0.0) for k in rows}
    return out.withColumns(new).drop("__low", "__v", *[f"__c_{k}" for k in rows])


def refit_types(labelled: DataFrame, columns: list[str], label: str = "type", least: int = 8):
    """A multinomial logistic regression of types on features, fitted on the cluster; None with fewer than two types of ``least`` rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    counts = labelled.groupBy(label).count().where(F.col("count") >= least).select(label)
    kept = labelled.join(counts, label, "left_semi")
    if counts.count() < 2:
        return None
    indexed = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(kept)
    rows = VectorAssembler(inputCols=columns, outputCol="__x").transform(indexed.transform(kept))
    return indexed.labels, LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", regParam=0.01).fit(rows)


def refit_confidence(labelled: DataFrame, columns: list[str], label: str = "label", least: int = 40) -> dict[str, float] | None:
    """New weights of confidence features, with ``bias``, from decided mentions; None with fewer than ``least`` or one outcome."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = labelled.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
    if n["n"] < least or n["k"] < 2:
        return None
    rows = VectorAssembler(inputCols=columns, outputCol="__x").transform(labelled.withColumn("__y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=0.01).fit(rows)
    return {"bias": float(model.intercept)} | {c: float(w) for c, w in zip(columns, model.coefficients, strict=True)}


def predict_type(features: DataFrame, llm_type: str | None = None) -> DataFrame:
    """``features`` with ``type, margin, prob, granularity``: the greatest linear score, the first in order among equals."""
    single = ~F.col("lemma").contains(" ")
    scores = []
    for t in TYPES:
        w = TYPE_WEIGHTS[t]
        own = (F.col("head_type") == t).cast("int")
        total = F.lit(w["bias"])
        for c in PLAIN:
            if c in w:
                total = total + w[c] * F.col(c)
        total = total + w.get("head_type_match", 0.0) * own + w.get("exact_head_match", 0.0) * own * single.cast("int")
        if "proto_margin" in features.columns:
            total = total + PROTO_TECH.get(t, 0.0) * F.col("proto_margin")
        if f"proto_{t}" in features.columns:
            total = total + PROTO_SELF.get(t, 0.0) * F.col(f"proto_{t}")
        if llm_type is not None:
            total = total + w.get("llm_agrees", 0.0) * F.coalesce((F.col(llm_type) == t).cast("int"), F.lit(0))
        scores.append(total)
    f = features.withColumn("scores", F.array(*scores))
    names = F.array(*map(F.lit, TYPES))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    kind = F.element_at(names, best)
    depth = F.create_map(*[F.lit(x) for pair in GRANULARITY.items() for x in pair])
    return f.withColumns({"type": kind, "margin": F.array_max("scores") - F.element_at(F.sort_array("scores", asc=False), 2), "prob": winner_probability(F.col("scores")), "granularity": F.element_at(depth, kind)}).drop("scores")


#: Entries that a table of cues may have: it is read into the plan.
MOST_CUES = 4_000


def cue_distance(context: Column, phrase: Column, a: Column, b: Column) -> Column:
    """Characters between a mention (``a`` to ``b`` in its context) and the nearest occurrence of a phrase; 0 where they overlap."""
    n = F.length(phrase)
    lo = F.greatest(a - n + 1, F.lit(0))
    left, right = F.instr(F.reverse(F.left(context, a)), F.reverse(phrase)), F.call_function("instr", F.substring(context, b + 1, F.length(context)), phrase)
    none = F.lit(1_000_000)
    return F.when(F.contains(F.substring(context, lo + 1, b + n - 1 - lo), phrase), 0).otherwise(F.least(F.when(left > 0, left - 1).otherwise(none), F.when(right > 0, right - 1).otherwise(none)))


def predict_role(mentions: DataFrame, cues: DataFrame, prior: dict[str | None, dict[str, float]], window: int = 140, section: Column | None = None) -> DataFrame:
    """``mentions`` (doc_id, start, end, surface, text) with ``role, margin, prob, fired``.

    ``cues`` (phrase, role, weight: a lexicon of at most ``MOST_CUES`` entries) are phrases of any
    number of words, looked for in the characters within ``window`` of a mention and in its
    evidence (``ev_start, ev_end``, where present); each counts once, by its nearest occurrence,
    weaker with distance, and not if it stands inside the mention. ``prior`` gives each role's
    score by section; that of None is for all others, and its roles, in order, are the roles
    there are. Nothing fired and a margin under 0.35 is ``unknown``; in an independent claim a
    mention is ``claimed``. Everything is worked out in a mention's own row: nothing is shuffled.
    """
    roles = list(prior[None])
    entries = cues.select("phrase", "role", F.col("weight").cast("double")).where("phrase <> ''").distinct().orderBy("phrase", "role", "weight").limit(MOST_CUES + 1).collect()
    if len(entries) > MOST_CUES:
        raise ValueError(f"more than {MOST_CUES} cues")
    lo, hi = F.greatest(F.lit(0), F.col("start") - window), F.least(F.length("text"), F.col("end") + window)
    if {"ev_start", "ev_end"} <= set(mentions.columns):
        lo, hi = F.least(lo, F.coalesce("ev_start", lo)), F.greatest(hi, F.coalesce("ev_end", hi))
    own = mentions.withColumns({"__lo": lo, "__ctx": F.lower(F.substring("text", lo + 1, hi - lo)), "__low": F.lower("surface")})
    a, b = F.col("start") - F.col("__lo"), F.col("end") - F.col("__lo")
    lexicon = F.array(*[F.struct(F.lit(e[0]).alias("phrase"), F.lit(e[1]).alias("role"), F.lit(e[2]).alias("weight")) for e in entries]) if entries else F.array().cast("array<struct<phrase:string,role:string,weight:double>>")
    fired = F.filter(lexicon, lambda c: F.contains(F.col("__ctx"), c["phrase"]) & ~F.contains(F.col("__low"), c["phrase"]))
    scored = F.transform(fired, lambda c: F.struct(c["role"].alias("role"), (c["weight"] * decay(cue_distance(F.col("__ctx"), c["phrase"], a, b), window)).alias("w")))
    own = own.withColumn("__fired", scored)
    kind = section if section is not None else F.lit(None).cast("string")

    def start_of(role: str) -> Column:
        out = F.lit(float(prior[None].get(role, 0.0)))
        for name, given in prior.items():
            if name is not None:
                out = F.when(kind == name, F.lit(float(given.get(role, 0.0)))).otherwise(out)
        return out

    summed = lambda r: F.aggregate(F.filter("__fired", lambda c: c["role"] == r), F.lit(0.0), lambda acc, c: acc + c["w"])
    # Rounded, so that equal evidence ties whatever the order of its sum; the first role wins a tie.
    own = own.withColumn("__scores", F.array(*[F.round(summed(r) + start_of(r), 9) for r in roles]))
    margin = F.array_max("__scores") - F.element_at(F.sort_array("__scores", asc=False), 2)
    best = F.element_at(F.array(*map(F.lit, roles)), F.array_position("__scores", F.array_max("__scores")).cast("int"))
    role = F.when((F.size("__fired") == 0) & (margin < 0.35), "unknown").otherwise(best)
    claimed = F.coalesce(kind == "claim_independent", F.lit(False))
    return own.withColumns({
        "role": F.when(claimed, "claimed").otherwise(role), "margin": F.when(claimed, 1.0).otherwise(margin),
        "prob": F.when(claimed, 1.0).otherwise(winner_probability(F.col("__scores"))), "fired": F.size("__fired"),
    }).drop("__lo", "__ctx", "__low", "__fired", "__scores")


def trimmed_evidence(evidence: Column, middle: Column, width: int = 320) -> Column:
    """At most ``width`` characters about ``middle``, with marks where something is cut."""
    n = F.length(evidence)
    lo = F.least(F.greatest(middle - width // 2, F.lit(0)), n - width)
    dots = lambda c: F.when(c, "...").otherwise("")
    cut = F.concat(dots(lo > 0), F.substring(evidence, lo + 1, F.lit(width)), dots(lo + width < n))
    return F.when(n <= width, evidence).otherwise(cut)
