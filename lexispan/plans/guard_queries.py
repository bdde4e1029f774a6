"""Queries over guards, typing, stance and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import classify as C
from ..operators import guards as G
from ..operators import profile as P
from ..operators import recall as R
from ..operators import tokens as K
from ..operators.lineage import cut
from .fixtures import fixture, sub
from .recall_queries import CAND_SQL, PHRASE_SQL, surfaces
from .text_queries import _SURFACES_SQL, _surfaces, docs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Mentions of the guard queries: phrases that end in a head noun.
MENTION_SQL = f"""{P.WORDS_SQL},
m AS (SELECT doc_id, start, "end", word, substring(text, (start + 1)::INT, ("end" - start)::INT) AS surface, text
  FROM {PHRASE_SQL} p JOIN documents USING (doc_id) WHERE word IN (SELECT word FROM heads)),
neg AS (SELECT DISTINCT word AS term FROM heads WHERE weight = 1.0)"""


def mentions(spark, sf):
    d = docs(spark, sf)
    h = cut(P.heads(d))
    spans = R.phrase_candidates(d, h).drop("recaller").join(d, "doc_id")
    spans = spans.withColumn("surface", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return spans, h


_KEY = T.lemma_key_sql("surface")
_BARE = T.strip_determiner_sql("trim(surface, ' \t\n')")
REASON_SQL = f"""CASE WHEN length({_BARE}) < 3 THEN 'too_short' WHEN len(string_split_regex({_BARE}, '[ \\t\\n]+')) > 8 THEN 'too_long'
  WHEN regexp_matches({_BARE}, {T.q(G.ALL_FUNCTION)}) THEN 'function_words' WHEN __LISTED__ THEN 'negative_lexicon'
  WHEN regexp_matches({_BARE}, {T.q(G.NUMBER_PATTERN)}) OR regexp_matches({_BARE}, {T.q(G.UNIT_PATTERN)}) THEN 'numeric'
  WHEN regexp_matches({_BARE}, {T.q(G.ORG_PATTERN)}) THEN 'organisation' WHEN regexp_matches({_BARE}, {T.q(G.PERSON_PATTERN)}) THEN 'person'
  WHEN regexp_matches({_BARE}, {T.q(G.DANGLING)}) THEN 'dangling' END"""


def reason_sql(listed):
    return REASON_SQL.replace("__LISTED__", listed)



@query(f"WITH {P.WORDS_SQL}, s AS (SELECT surface, {_KEY} AS k FROM {_SURFACES_SQL} WHERE length(lower(surface)) = length(surface)) SELECT surface, {reason_sql('k IN (SELECT word FROM heads)')} AS reason FROM s")
def negative_guard(spark, sf):
    d = docs(spark, sf)
    plain = _surfaces(spark, sf).where(F.length(F.lower("surface")) == F.length("surface"))
    return G.negative_guard(plain, cut(P.heads(d)).select(F.col("word").alias("term"))).select("surface", "reason")


@query(f"WITH {MENTION_SQL} SELECT doc_id, start, \"end\" <= length(text) AND substring(text, (start + 1)::INT, (\"end\" - start)::INT) = surface AS ok FROM m")
def grounding_guard(spark, sf):
    m, _ = mentions(spark, sf)
    return m.select("doc_id", "start", G.grounded(F.col("text"), F.col("start"), F.col("end"), F.col("surface")).alias("ok"))


# Quotes of the benchmark's items: two of their words as they stand, with other space, in other case, and made up.
_QUOTE_SQL = """SELECT item_id * 4 + k AS id, text, CASE k WHEN 0 THEN w WHEN 1 THEN replace(w, ' ', '  ') WHEN 2 THEN upper(w) ELSE w || ' zzqx zzqx' END AS quote, length(text) // 2 AS anchor
  FROM (SELECT item_id, text, regexp_extract(text, '[a-z]+ [a-z]+', 0) AS w FROM benchmark WHERE length(lower(text)) = length(text)), (VALUES (0), (1), (2), (3)) v(k) WHERE length(w) > 0"""


@query(f"""WITH RECURSIVE q AS ({_QUOTE_SQL}),
f(id, text, quote, anchor, spot, fold) AS (
  SELECT id, text, quote, anchor, instr(text, quote), fold FROM (
    SELECT id, text, quote, anchor, 0 AS fold FROM q UNION ALL SELECT id, lower(text), lower(quote), anchor, 1 FROM q WHERE instr(text, quote) = 0)
  UNION ALL SELECT id, text, quote, anchor, spot + length(quote) - 1 + instr(substring(text, (spot + length(quote))::INT), quote), fold FROM f WHERE spot > 0 AND instr(substring(text, (spot + length(quote))::INT), quote) > 0),
b AS (SELECT id, min_by(spot - 1, abs(spot - 1 - anchor) * 100000000 + spot) AS start, any_value(length(quote)) AS n, any_value(fold) AS fold FROM f WHERE spot > 0 GROUP BY id),
s AS (SELECT id, instr(text, regexp_extract(text, replace(quote, '  ', '[ \\t\\n]+'), 0)) - 1 AS start, length(regexp_extract(text, replace(quote, '  ', '[ \\t\\n]+'), 0)) AS n FROM q WHERE id % 4 = 1 AND id NOT IN (SELECT id FROM b))
SELECT q.id, CASE WHEN b.id IS NOT NULL AND b.fold = 0 THEN 'exact' WHEN s.id IS NOT NULL THEN 'whitespace' WHEN b.id IS NOT NULL THEN 'case' ELSE 'missing' END AS status,
  coalesce(b.start, s.start, -1)::INT AS start, coalesce(b.start + b.n, s.start + s.n, -1)::INT AS "end"
FROM q LEFT JOIN b ON b.id = q.id LEFT JOIN s ON s.id = q.id""")
def grounding_ladder(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length(F.lower("text")) == F.length("text"))
    w = F.regexp_extract("text", "[a-z]+ [a-z]+", 0)
    made = items.select("item_id", "text", w.alias("w")).where("w <> ''").withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    quote = F.when(F.col("k") == 0, F.col("w")).when(F.col("k") == 1, F.replace("w", F.lit(" "), F.lit("  "))).when(F.col("k") == 2, F.upper("w")).otherwise(F.concat("w", F.lit(" zzqx zzqx")))
    quotes = made.select((F.col("item_id") * 4 + F.col("k")).alias("id"), "text", quote.alias("quote"), F.floor(F.length("text") / 2).cast("int").alias("anchor"))
    return G.ground(quotes).select("id", "status", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"))


# DuckDB measures edit distance in bytes: both sides see other characters than ASCII as '?'.
_PLAIN = "(SELECT item_id AS doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM benchmark)"


@query(f"""WITH b AS (SELECT doc_id AS id, text, substring(text, 1, 40) || 'x' AS quote FROM {_PLAIN}), t AS (SELECT * FROM {K.pieces_sql('[^ \\t\\n]+', _PLAIN)}),
  w AS (SELECT t.doc_id AS id, t.start, e."end" AS "end", substring(text, (t.start + 1)::INT, (e."end" - t.start)::INT) AS piece, quote
    FROM t JOIN t e ON t.doc_id = e.doc_id AND e.pos >= t.pos JOIN b ON b.id = t.doc_id AND e."end" - t.start <= 1.4::DOUBLE * length(quote)),
  s AS (SELECT id, start, "end", 1.0::DOUBLE - levenshtein(piece, quote)::DOUBLE / greatest(length(piece), length(quote)) AS similarity FROM w
    WHERE length(piece) >= 0.6::DOUBLE * length(quote) AND length(piece) <= 1.4::DOUBLE * length(quote))
  SELECT id, start, "end", round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, start, "end") AS k FROM s WHERE similarity >= 0.9::DOUBLE - 1e-9) WHERE k = 1""")
def fuzzy_grounding(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))
    quotes = b.select(F.col("item_id").alias("id"), "text", F.concat(F.substring("text", 1, 40), F.lit("x")).alias("quote"))
    return G.fuzzy_windows(quotes).withColumn("similarity", F.round("similarity", 6))


_INJ_DOCS = f"(SELECT doc_id::BIGINT AS doc_id, text FROM {sub('fx_injections')} UNION ALL SELECT doc_id + 1000000, text FROM documents)"


def _injection_docs(spark, sf):
    return fixture(spark, "fx_injections").select(F.col("doc_id").cast("long"), "text").unionByName(docs(spark, sf).withColumn("doc_id", F.col("doc_id") + 1000000))


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, start, \"end\" FROM {K.pieces_sql(p, _INJ_DOCS)}" for f, p in X.INJECTION))
def injection_scan(spark, sf):
    return G.injection_hits(_injection_docs(spark, sf))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {T.q(p)}))::INT AS {f}" for f, p in X.INJECTION) + f" FROM {_INJ_DOCS}")
def document_risk(spark, sf):
    return G.document_risk(_injection_docs(spark, sf))


_ANY = lambda c: "(" + " OR ".join(f"regexp_matches({c}, {T.q(p)})" for _, p in X.INJECTION) + ")"


@query(f"""WITH t AS (SELECT * FROM {K.pieces_sql(K.TOKEN, sub('fx_injections'))}), s AS (SELECT * FROM {K.sentences_sql(sub('fx_injections'))}),
  j AS (SELECT t.doc_id, t.start, t."end", s.start AS ev_start, s."end" AS ev_end, text FROM t ASOF JOIN s ON t.doc_id = s.doc_id AND t.start >= s.start JOIN {sub('fx_injections')} d ON d.doc_id = t.doc_id)
  SELECT doc_id, start, CASE WHEN {_ANY('substring(text, (ev_start + 1)::INT, (ev_end - ev_start)::INT)')} THEN 'reject'
    WHEN {_ANY('substring(text, greatest(1, start - 239)::INT, ("end" + 240 - greatest(0, start - 240))::INT)')} THEN 'abstain' ELSE 'pass' END AS verdict FROM j""")
def injection_guard(spark, sf):
    return G.injection_verdicts(fixture(spark, "fx_injections"))


@query()
def injection_guard_corpus(spark, sf):
    """As injection_guard, over the documents of injection_scan."""
    return G.injection_verdicts(_injection_docs(spark, sf))


@query(f"""WITH {CAND_SQL} SELECT doc_id, start, "end", CASE WHEN list_has_any(proposers, ['abbrev', 'gazetteer']) OR len(proposers) >= 2 THEN 'pass' ELSE 'abstain' END AS verdict FROM cand""")
def consensus_guard(spark, sf):
    return surfaces(spark, sf).select("doc_id", "start", "end", G.consensus_verdict(F.col("proposers")).alias("verdict"))


EVIDENCE_SQL = f"""{MENTION_SQL}, s AS (SELECT * FROM {K.sentences_sql()}),
ev AS (SELECT m.*, s.sent_idx, s.start AS ev_start, least(greatest(s."end", m."end"), length(text))::INT AS ev_end
  FROM m ASOF LEFT JOIN s ON m.doc_id = s.doc_id AND m.start >= s.start)"""


def with_evidence(spark, sf):
    m, h = mentions(spark, sf)
    ev = K.sentence_of(m.select("doc_id", "start", "end", "surface"), K.sentences(docs(spark, sf))).join(docs(spark, sf), "doc_id")
    return ev.withColumn("ev_end", F.least(F.greatest("ev_end", "end"), F.length("text"))), h


@query(f"""WITH {EVIDENCE_SQL} SELECT doc_id, start, ev_start, ev_end, ev_start <= start AND "end" <= ev_end AND contains(substring(text, (ev_start + 1)::INT, (ev_end - ev_start)::INT), surface) AS ok FROM ev""")
def evidence_guard(spark, sf):
    ev, _ = with_evidence(spark, sf)
    ok = G.evidence_ok(F.col("text"), F.col("start"), F.col("end"), F.col("surface"), F.col("ev_start"), F.col("ev_end"))
    return ev.select("doc_id", "start", "ev_start", "ev_end", ok.alias("ok"))


@query(f"""WITH {MENTION_SQL}, y AS (SELECT word, min(1995 + doc_id % 7) AS attested FROM m GROUP BY 1)
  SELECT doc_id, start, CASE WHEN 1995 + doc_id % 7 - 3 + 1 < attested THEN 'abstain' ELSE 'pass' END AS verdict FROM m JOIN y USING (word)""")
def temporal_guard(spark, sf):
    m, _ = mentions(spark, sf)
    m = m.withColumn("word", F.lower(F.regexp_extract("surface", r"[^ \t\n]*$", 0))).withColumn("year", 1995 + F.col("doc_id") % 7)
    first = m.groupBy("word").agg(F.min("year").alias("attested"))
    return m.join(first, "word").select("doc_id", "start", G.temporal_verdict(F.col("year") - 3, F.col("attested")).alias("verdict"))


_HASH = "left(sha256(concat_ws(chr(0), doc_id, start, \"end\", surface)), 16)"


@query(f"WITH {MENTION_SQL} SELECT doc_id, start, CASE WHEN start % 5 = 0 THEN false ELSE {_HASH} = {_HASH} END AS ok FROM m")
def provenance_guard(spark, sf):
    m, _ = mentions(spark, sf)
    right = T.content_hash(F.col("doc_id"), F.col("start"), F.col("end"), F.col("surface"))
    stored = F.when(F.col("start") % 5 == 0, F.lit("0" * 16)).otherwise(right)  # every fifth record is corrupted
    return m.select("doc_id", "start", G.provenance_ok(F.col("doc_id"), F.col("doc_id"), F.array(F.lit("pattern")), stored, right).alias("ok"))


_CASCADE = f"""casc AS (SELECT doc_id, start, {reason_sql(f"{_KEY} IN (SELECT term FROM neg)")} AS reason, CASE WHEN length(surface) % 3 = 0 THEN 1 ELSE 0 END AS n_abstain FROM m)"""


def cascade(spark, sf):
    """Grounding, the negative lexicon and, as a doubt, a surface whose length is a multiple of three."""
    m, h = mentions(spark, sf)
    g = G.negative_guard(m, h.where("weight = 1.0").select(F.col("word").alias("term")))
    reason = F.when(~G.grounded(F.col("text"), F.col("start"), F.col("end"), F.col("surface")), "grounding").otherwise(F.col("reason"))
    return g.select("doc_id", "start", reason.alias("reason"), F.when(F.length("surface") % 3 == 0, 1).otherwise(0).alias("n_abstain"))


@query(f"WITH {MENTION_SQL}, {_CASCADE} SELECT doc_id, start, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN n_abstain > 0 THEN 'abstain' ELSE 'pass' END AS verdict, coalesce(reason, '') AS reason FROM casc")
def guard_cascade(spark, sf):
    c = cascade(spark, sf)
    verdict = F.when(F.col("reason").isNotNull(), "reject").when(F.col("n_abstain") > 0, "abstain").otherwise("pass")
    return c.select("doc_id", "start", verdict.alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"WITH {MENTION_SQL}, {_CASCADE} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM casc GROUP BY 1")
def guard_report(spark, sf):
    c = cascade(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))  # one row for each reason
    return c.crossJoin(total).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT doc_id, 0 AS start FROM documents WHERE false")
def integrity_violations(spark, sf):
    """Mentions whose text, evidence or hash can't be derived again from their document: none."""
    ev, _ = with_evidence(spark, sf)
    c = {n: F.col(n) for n in ("text", "start", "end", "surface", "ev_start", "ev_end")}
    ok = G.grounded(c["text"], c["start"], c["end"], c["surface"]) & G.evidence_ok(*c.values())
    return ev.where(~ok).select("doc_id", "start")


# --- typing and stance --------------------------------------------------------------------------

FEATURE_SQL = f"""{MENTION_SQL},
f AS (SELECT m.doc_id, m.start, m."end", {_KEY} AS lemma, surface,
    least({T.orthographic_sql('surface')} / 2.5::DOUBLE, 1) AS orthographic, least(len(string_split({_KEY}, ' ')), 5) / 5.0::DOUBLE AS n_tokens,
    regexp_matches(surface, '[0-9]')::INT::DOUBLE AS has_digit, regexp_matches(substring(surface, 2), '\\p{{Lu}}')::INT::DOUBLE AS has_upper,
    (lower(surface) = surface)::INT::DOUBLE AS all_lower, contains(surface, '-')::INT::DOUBLE AS hyphenated, m.doc_id AS d FROM m),
g AS (SELECT f.*, regexp_extract(lemma, '[^ ]*$', 0) AS head FROM f),
ft AS (SELECT g.*, (h.word IS NOT NULL)::INT::DOUBLE AS head_is_tech, (head LIKE '%ing')::INT::DOUBLE AS suffix_ing,
    (head LIKE '%tion' OR head LIKE '%sion')::INT::DOUBLE AS suffix_ion, coalesce(h.type, '') AS head_type, NOT contains(lemma, ' ') AS single
  FROM g LEFT JOIN heads h ON h.word = head)"""


@query(f"WITH {FEATURE_SQL} SELECT doc_id, start, lemma, orthographic, n_tokens, has_digit, has_upper, all_lower, hyphenated, head_is_tech, suffix_ing, suffix_ion, head_type FROM ft")
def type_features(spark, sf):
    m, h = mentions(spark, sf)
    f = C.type_features(m, h)
    return f.select("doc_id", "start", "lemma", "orthographic", "n_tokens", "has_digit", "has_upper", "all_lower", "hyphenated", "head_is_tech", "suffix_ing", "suffix_ion", "head_type")


#: Features that the phrases of these queries never have.
_ABSENT = ("umbrella", "kb_hit", "kb_depth_shallow", "kb_depth_deep", "abbrev_pair", "ncvalue")


def _type_score_sql(t):
    w = X.TYPE_WEIGHTS[t]
    parts = [f"{w['bias']}::DOUBLE"] + [f"{w[c]}::DOUBLE * {c}" for c in C.PLAIN if c in w and c not in _ABSENT]
    parts += [f"{w.get('head_type_match', 0.0)}::DOUBLE * (head_type = '{t}')::INT", f"{w.get('exact_head_match', 0.0)}::DOUBLE * (head_type = '{t}' AND single)::INT"]
    return " + ".join(parts)


TYPE_SQL = FEATURE_SQL + f""",
sc AS (SELECT doc_id, start, "end", surface, [{', '.join(_type_score_sql(t) for t in X.TYPES)}] AS s FROM ft),
typed AS (SELECT doc_id, start, "end", surface, (['{"', '".join(X.TYPES)}'])[list_position(s, list_max(s))] AS type,
  round(list_max(s) - list_sort(s, 'DESC')[2], 6) AS margin, round(1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS prob FROM sc)"""


@query(f"WITH {TYPE_SQL} SELECT doc_id, start, type, margin, prob FROM typed")
def type_predict(spark, sf):
    m, h = mentions(spark, sf)
    t = C.predict_type(C.type_features(m, h))
    return t.select("doc_id", "start", "type", F.round("margin", 6).alias("margin"), F.round("prob", 6).alias("prob"))


_WIN = "lower(substring(text, greatest(1, start - 139)::INT, (\"end\" + 140 - greatest(0, start - 140))::INT))"


@query(f"""WITH {MENTION_SQL},
  w AS (SELECT DISTINCT doc_id, start, "end", lower(surface) AS mention, {_WIN} AS ctx, (start - greatest(0, start - 140))::INT AS a, ("end" - greatest(0, start - 140))::INT AS b FROM m),
  c AS (SELECT doc_id, start, "end", role, weight,
      CASE WHEN contains(substring(ctx, greatest(a - length(phrase) + 1, 0)::INT + 1, (b + length(phrase) - 1 - greatest(a - length(phrase) + 1, 0))::INT), phrase) THEN 0 ELSE
        least(coalesce(nullif(instr(reverse(left(ctx, a)), reverse(phrase)), 0) - 1, 1000000), coalesce(nullif(instr(substring(ctx, b + 1), phrase), 0) - 1, 1000000)) END AS dist
    FROM w JOIN cues ON contains(ctx, phrase) WHERE NOT contains(mention, phrase)),
  r AS (SELECT w.doc_id, w.start, w."end", n.role, n.i, 0.1::DOUBLE * n.i + coalesce(sum(c.weight * CASE WHEN dist >= 140 THEN 0.25::DOUBLE ELSE 1 - 0.75::DOUBLE * dist / 140 END), 0) AS score, count(c.weight) AS fired
    FROM w CROSS JOIN (VALUES ('proposed', 0), ('used', 1), ('compared', 2), ('background', 3)) n(role, i)
    LEFT JOIN c ON c.doc_id = w.doc_id AND c.start = w.start AND c."end" = w."end" AND c.role = n.role GROUP BY 1, 2, 3, 4, n.i),
  k AS (SELECT doc_id, start, "end", max_by(role, round(score, 9) * 1000 - i * 1e-7) AS best, list_sort(list(round(score, 9)), 'DESC') AS s, sum(fired) AS fired FROM r GROUP BY 1, 2, 3)
  SELECT doc_id, start, "end", CASE WHEN fired = 0 AND s[1] - s[2] < 0.35 THEN 'unknown' ELSE best END AS role, round(s[1] - s[2], 6) AS margin FROM k""")
def role_predict(spark, sf):
    m, _ = mentions(spark, sf)
    prior = {"proposed": 0.0, "used": 0.1, "compared": 0.2, "background": 0.3}
    r = C.predict_role(m, P.cues(docs(spark, sf)), {None: prior})
    return r.select("doc_id", "start", "end", "role", F.round("margin", 6).alias("margin")).distinct()


@query(f"WITH {MENTION_SQL}, l AS (SELECT doc_id, start, \"end\", {_KEY} AS lemma FROM m), e AS (SELECT word, type FROM heads) SELECT doc_id, start, lemma, coalesce(type, '') AS entry FROM l LEFT JOIN e ON e.word = regexp_extract(lemma, '[^ ]*$', 0)")
def kb_link(spark, sf):
    m, h = mentions(spark, sf)
    return C.type_features(m, h).select("doc_id", "start", "lemma", F.col("head_type").alias("entry"))


@query(f"""WITH {EVIDENCE_SQL}, t AS (SELECT doc_id, start, "end", substring(text, (ev_start + 1)::INT, (ev_end - ev_start)::INT) AS ev, (start + "end") // 2 - ev_start AS mid FROM ev)
  SELECT doc_id, start, md5(CASE WHEN length(ev) <= 320 THEN ev ELSE
    (CASE WHEN least(greatest(mid - 160, 0), length(ev) - 320) > 0 THEN '...' ELSE '' END) || substring(ev, (least(greatest(mid - 160, 0), length(ev) - 320) + 1)::INT, 320)
    || (CASE WHEN least(greatest(mid - 160, 0), length(ev) - 320) + 320 < length(ev) THEN '...' ELSE '' END) END) AS digest FROM t""")
def evidence_trim(spark, sf):
    ev, _ = with_evidence(spark, sf)
    body = F.substring("text", F.col("ev_start") + 1, F.col("ev_end") - F.col("ev_start"))
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int") - F.col("ev_start")
    return ev.select("doc_id", "start", F.md5(C.trimmed_evidence(body, middle)).alias("digest"))
