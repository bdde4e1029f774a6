"""Queries over candidate generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import profile as P
from ..operators import recall as R
from ..operators import tokens as K
from ..operators.lineage import cut
from .fixtures import fixture, sub
from .text_queries import docs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def occurrences(spark, sf):
    return _occurrences(docs(spark, sf))[0]


def _occurrences(d):
    """Occurrences of terms, and the heads, small tables found once."""
    heads = cut(P.heads(d))
    return R.term_occurrences(K.tokens(d), heads, cut(P.closed_class(d))), heads


OCC_SQL = (
    P.WORDS_SQL
    + """,
flag AS (SELECT doc_id, pos, lower(tok) AS word, start, "end", h.word IS NOT NULL AS is_head,
  CASE WHEN length(tok) >= 2 AND c.word IS NULL THEN lower(tok) END AS part
  FROM toks LEFT JOIN heads h ON h.word = lower(tok) LEFT JOIN closed c ON c.word = lower(tok)),
wide AS (SELECT *, lead(word) OVER w AS after,
  """
    + ", ".join(f"lag(part, {i}) OVER w AS p{i}, lag(start, {i}) OVER w AS s{i}" for i in range(1, 5))
    + ", "
    + ", ".join(f"lag(word, {i}) OVER w AS b{i}" for i in range(1, 6))
    + """
  FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
occ AS (
  """
    + " UNION ALL ".join(
        "SELECT doc_id, "
        + " || ' ' || ".join([f"p{i}" for i in range(n - 1, 0, -1)] + ["part"])
        + f" AS term, {n} AS n, {'start' if n == 1 else f's{n - 1}'} AS start, \"end\", b{n} AS before, after FROM wide WHERE is_head AND part IS NOT NULL"
        + "".join(f" AND p{i} IS NOT NULL" for i in range(1, n))
        for n in range(1, 6)
    )
    + """),
stats AS (SELECT term, n, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM occ GROUP BY term, n),
ctx AS (SELECT term, word, count(*)::BIGINT AS c FROM (SELECT term, before AS word FROM occ UNION ALL SELECT term, after FROM occ) WHERE word IS NOT NULL GROUP BY 1, 2),
nested AS (SELECT DISTINCT p.term, container FROM (SELECT term AS container, n, string_split(term, ' ') AS w FROM stats WHERE n > 1) c,
  LATERAL (SELECT array_to_string(c.w[a.a + 1:a.a + m.m], ' ') AS term FROM range(5) a(a), range(1, 5) m(m) WHERE a.a + m.m <= c.n AND m.m < c.n) p
  WHERE p.term IN (SELECT term FROM stats)),
cv AS (SELECT s.term, s.n, s.tf, s.df, log2(s.n + 1.0::DOUBLE) * (s.tf - coalesce(i.inside, 0.0::DOUBLE)) AS cvalue
  FROM stats s LEFT JOIN (SELECT nested.term, sum(tf)::DOUBLE / count(*) AS inside FROM nested JOIN stats ON stats.term = container GROUP BY 1) i USING (term)),
cuew AS (SELECT phrase AS word FROM cues),
nc AS (SELECT cv.*, CASE WHEN cvalue <= 0 THEN cvalue ELSE 0.8::DOUBLE * cvalue + 0.2::DOUBLE * cvalue * coalesce(share, 0) END AS ncvalue
  FROM cv LEFT JOIN (SELECT term, (sum(c) FILTER (word IN (SELECT word FROM cuew)))::DOUBLE / sum(c) AS share FROM ctx GROUP BY 1) x USING (term)),
top AS (SELECT term, ncvalue FROM nc WHERE ncvalue >= 2.0 ORDER BY ncvalue DESC, term LIMIT 400)"""
)


def with_sql(body: str) -> str:
    return f"WITH {OCC_SQL} {body}"


@query(f"WITH {P.WORDS_SQL} SELECT 'head' AS kind, word, type AS what, weight FROM heads UNION ALL SELECT 'closed', word, '', 0.0::DOUBLE FROM closed UNION ALL SELECT 'cue', phrase, role, weight FROM cues")
def corpus_lexicon(spark, sf):
    d = docs(spark, sf)
    out = P.heads(d).select(F.lit("head").alias("kind"), "word", F.col("type").alias("what"), "weight")
    out = out.unionByName(P.closed_class(d).select(F.lit("closed").alias("kind"), "word", F.lit("").alias("what"), F.lit(0.0).alias("weight")))
    return out.unionByName(P.cues(d).select(F.lit("cue").alias("kind"), F.col("phrase").alias("word"), F.col("role").alias("what"), "weight"))


@query(with_sql("SELECT term, n, tf, df FROM stats"))
def ngram_stats(spark, sf):
    return R.term_stats(occurrences(spark, sf))


@query(with_sql("SELECT term, word, c FROM ctx"))
def context_counts(spark, sf):
    return R.context_counts(occurrences(spark, sf))


@query(with_sql("SELECT term, container FROM nested"))
def nesting_pairs(spark, sf):
    occ, heads = _occurrences(docs(spark, sf))
    return R.nesting_pairs(R.term_stats(occ), heads)


def scored_terms(spark, sf):
    """Occurrences, their terms with both values, and the heads."""
    d = docs(spark, sf)
    occ, heads = _occurrences(d)
    return occ, R.ncvalue(R.cvalue(R.with_share(occ, cut(P.cues(d)).select(F.col("phrase").alias("word"))), heads)), heads


@query(with_sql("SELECT term, n, tf, df, round(cvalue, 6) AS cvalue FROM cv"))
def cvalue(spark, sf):
    occ, heads = _occurrences(docs(spark, sf))
    return R.cvalue(R.term_stats(occ), heads).withColumn("cvalue", F.round("cvalue", 6))


@query(with_sql("SELECT term, round(cvalue, 6) AS cvalue, round(ncvalue, 6) AS ncvalue FROM nc"))
def ncvalue(spark, sf):
    return scored_terms(spark, sf)[1].select("term", F.round("cvalue", 6).alias("cvalue"), F.round("ncvalue", 6).alias("ncvalue"))


@query(with_sql("SELECT doc_id, start, \"end\", round(ncvalue, 6) AS ncvalue FROM occ JOIN top USING (term)"))
def cvalue_candidates(spark, sf):
    occ, scored, _ = scored_terms(spark, sf)
    return R.cvalue_candidates(occ, cut(R.top_terms(scored))).select("doc_id", "start", "end", F.round("ncvalue", 6).alias("ncvalue"))


KB_SQL = f"""toks AS (SELECT doc_id, pos::INT AS pos, tok, start, "end" FROM {K.pieces_sql(K.TOKEN)}),
pairs AS (SELECT doc_id, lower(lag(tok) OVER (PARTITION BY doc_id ORDER BY pos)) || ' ' || lower(tok) AS key FROM toks),
kb AS (SELECT key, 'k' || left(md5(key), 8) AS entry_id, (length(key) % 5)::INT AS depth FROM pairs WHERE key IS NOT NULL GROUP BY key
  HAVING count(DISTINCT doc_id) >= {P.KB_SHARE}::DOUBLE * (SELECT count(*) FROM documents)),
runs AS (SELECT doc_id, start, lead("end", 1) OVER w AS "end", lower(tok) || ' ' || lower(lead(tok, 1) OVER w) AS key FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, start, "end", key, entry_id, depth FROM runs JOIN kb USING (key) WHERE length(key) >= 4)"""


def gazetteer(spark, sf):
    d = docs(spark, sf)
    toks = K.tokens(d)
    return R.gazetteer_hits(toks, cut(R.frequent_bigrams(toks, d)))


@query(f"WITH {KB_SQL} SELECT doc_id, start, \"end\", key, entry_id, depth FROM hits")
def gazetteer_hits(spark, sf):
    return gazetteer(spark, sf)


@query(f"""WITH RECURSIVE {KB_SQL},
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC) AS i FROM hits),
  g(doc_id, i, start, "end", key, last, took) AS (
    SELECT doc_id, i, start, "end", key, "end", true FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.i, o.start, o."end", o.key, CASE WHEN o.start >= g.last THEN o."end" ELSE g.last END, o.start >= g.last
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1)
  SELECT doc_id, start, "end", key FROM g WHERE took""")
def gazetteer_longest(spark, sf):
    return R.leftmost_longest(gazetteer(spark, sf)).select("doc_id", "start", "end", "key")


_PAREN_SQL = f"(SELECT doc_id, start, \"end\", trim(substring(tok, 2, (length(tok) - 2)::INT), ' ') AS inner_text FROM {{}})"


@query(" UNION ALL ".join(
    f"SELECT {i} AS part, doc_id::BIGINT AS doc_id, start, \"end\", inner_text AS inner, {T.IS_SHORT_FORM_SQL.format('inner_text')} AS is_short FROM {_PAREN_SQL.format(K.pieces_sql(R.PAREN, s))}"
    for i, s in enumerate(("documents", sub("fx_abbreviations")))))
def short_form_candidates(spark, sf):
    a = R.short_form_candidates(docs(spark, sf)).select(F.lit(0).alias("part"), "*")
    return a.unionByName(R.short_form_candidates(fixture(spark, "fx_abbreviations")).select(F.lit(1).alias("part"), "*"))


_EVERY_SQL = f"(SELECT doc_id::BIGINT AS doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT - 1000, text FROM {sub('fx_abbreviations')})"
_WORD_SQL = "regexp_extract(rtrim(before, ' '), '[^ \\t\\n]*$', 0)"
#: The same alignment as a recursion over the window's characters, from the right.
ABBREV_SQL = f"""WITH RECURSIVE par AS (
  SELECT p.doc_id, p.start, substring(tok, 2, (length(tok) - 2)::INT) AS body, text FROM {K.pieces_sql(R.PAREN, _EVERY_SQL)} p JOIN {_EVERY_SQL} d USING (doc_id)),
i AS (SELECT *, trim(body, ' ') AS inner_text, start + 1 + length(body) - length(ltrim(body, ' ')) AS lo,
  substring(text, greatest(start - 20, 0)::INT + 1, least(start, 20)::INT) AS before FROM par WHERE trim(body, ' ') <> ''),
w AS (
  SELECT doc_id, inner_text AS short, lo AS short_start, f AS from_at, substring(text, (f + 1)::INT, (start - f)::INT) AS win
  FROM (SELECT *, greatest(start - least(length(inner_text) + 5, 2 * length(inner_text)) * {X.WINDOW_WORD}, 0) AS f FROM i WHERE {T.IS_SHORT_FORM_SQL.format('inner_text')})
  UNION ALL
  SELECT doc_id, word, greatest(start - 20, 0) + length(rtrim(before, ' ')) - length(word), lo, inner_text
  FROM (SELECT *, {_WORD_SQL} AS word FROM i WHERE NOT {T.IS_SHORT_FORM_SQL.format('inner_text')}) WHERE {T.IS_SHORT_FORM_SQL.format('word')}),
l AS (SELECT *, lower(win) AS lw, reverse(lower(regexp_replace(short, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS letters, row_number() OVER () AS id FROM w),
g(id, p, placed, spot) AS (
  SELECT id, length(lw), 0::BIGINT, -1::BIGINT FROM l
  UNION ALL
  SELECT g.id, p - 1, placed + took, CASE WHEN took = 1 THEN p - 1 ELSE spot END FROM (
    SELECT g.*, (placed < length(letters) AND substring(lw, p::INT, 1) = substring(letters, (placed + 1)::INT, 1)
      AND (placed < length(letters) - 1 OR p = 1 OR NOT regexp_matches(substring(lw, (p - 1)::INT, 1), '[\\p{{L}}\\p{{N}}]')))::INT AS took
    FROM g JOIN l USING (id) WHERE p > 0 AND placed < length(letters)) g),
done AS (SELECT l.*, spot FROM (SELECT id, max(placed) AS placed, min(spot) FILTER (spot >= 0) AS spot FROM g GROUP BY id) JOIN l USING (id) WHERE placed = length(letters) AND placed > 0),
o AS (SELECT *, regexp_replace(substring(win, (spot + 1)::INT), '[^\\p{{L}}\\p{{N}}]+$', '') AS long_form FROM done)
SELECT doc_id, short_start::INT AS short_start, (short_start + length(short))::INT AS short_end, short, (from_at + spot)::INT AS long_start, (from_at + spot + length(long_form))::INT AS long_end, long_form AS long
FROM o WHERE long_form <> '' AND len(string_split_regex(long_form, '[ \\t\\n]+')) <= {X.LONG_FORM_WORDS}"""


@query(ABBREV_SQL)
def abbrev_pairs(spark, sf):
    fx = fixture(spark, "fx_abbreviations").select((F.col("doc_id").cast("long") - 1000).alias("doc_id"), "text")
    return R.abbreviation_pairs(docs(spark, sf).unionByName(fx))


_LEAD = f"length(regexp_extract(tok, '(?i)^(({'|'.join(X.VAGUE_MODIFIERS)})[ \\t\\n]+)*', 0))"
PHRASE_SQL = f"(SELECT doc_id, (start + {_LEAD})::INT AS start, \"end\", lower(regexp_extract(tok, '[^ \\t\\n]*$', 0)) AS word FROM {K.pieces_sql(R.PHRASE)} WHERE start + {_LEAD} < \"end\")"


@query(f"SELECT doc_id, start, \"end\" FROM {PHRASE_SQL}")
def regex_np_candidates(spark, sf):
    return R.phrase_candidates(docs(spark, sf)).select("doc_id", "start", "end")


@query(f"WITH {P.WORDS_SQL} SELECT count(*)::BIGINT AS n_open, (count(*) FILTER (word IN (SELECT word FROM heads)))::BIGINT AS n_gated FROM {PHRASE_SQL}")
def head_gate_coverage(spark, sf):
    d = docs(spark, sf)
    gated = R.phrase_candidates(d, P.heads(d)).agg(F.count("*").alias("n_gated"))
    return R.phrase_candidates(d).agg(F.count("*").alias("n_open")).crossJoin(gated)  # one row each


def _frame_sql(name, pattern, group, source):
    phrase = f"regexp_extract(tok, {T.q(pattern)}, {group})"
    lead = f"instr(tok, {phrase}) - 1" if group == 1 else f"length(regexp_extract(tok, {T.q(R._before(pattern, group))}, 0))"
    return f"SELECT doc_id, {T.q(name)} AS frame, (start + {lead})::INT AS start, (start + {lead} + length({phrase}))::INT AS \"end\", {phrase} AS surface FROM {K.pieces_sql(pattern, source)}"


@query(" UNION ALL ".join(_frame_sql(*f, s) for s in (sub("fx_frames"), "documents") for f in X.CLAIM_FRAMES))
def claim_frame_candidates(spark, sf):
    return R.claim_frames(fixture(spark, "fx_frames").select(F.col("doc_id").cast("long"), "text").unionByName(docs(spark, sf)))


#: The corpus candidates: phrases with a head, accepted terms, dictionary hits.
CAND_SQL = f"""{OCC_SQL},
pairs AS (SELECT doc_id, lower(lag(tok) OVER (PARTITION BY doc_id ORDER BY pos)) || ' ' || lower(tok) AS key FROM toks),
kb AS (SELECT key, 'k' || left(md5(key), 8) AS entry_id, (length(key) % 5)::INT AS depth FROM pairs WHERE key IS NOT NULL GROUP BY key
  HAVING count(DISTINCT doc_id) >= {P.KB_SHARE}::DOUBLE * (SELECT count(*) FROM documents)),
gruns AS (SELECT doc_id, start, "end", lower(tok) AS key FROM toks
  UNION ALL SELECT doc_id, start, lead("end", 1) OVER w, lower(tok) || ' ' || lower(lead(tok, 1) OVER w) FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, start, lead("end", 2) OVER w, lower(tok) || ' ' || lower(lead(tok, 1) OVER w) || ' ' || lower(lead(tok, 2) OVER w) FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
phrases AS (SELECT doc_id, start, "end" FROM {PHRASE_SQL} WHERE word IN (SELECT word FROM heads)),
parts AS (
  SELECT doc_id, start, "end", 'pattern' AS recaller, NULL::DOUBLE AS ncvalue, NULL::VARCHAR AS entry_id, NULL::INT AS depth FROM phrases
  UNION ALL SELECT doc_id, start, "end", 'cvalue', ncvalue, NULL, NULL FROM occ JOIN top USING (term)
  UNION ALL SELECT doc_id, start, "end", 'gazetteer', NULL, entry_id, depth FROM gruns JOIN kb USING (key) WHERE length(key) >= 4),
cand AS (SELECT doc_id, start, "end", list_sort(list_distinct(list(recaller))) AS proposers, max(ncvalue) AS ncvalue, max(entry_id) AS entry_id, max(depth) AS depth
  FROM parts GROUP BY doc_id, start, "end"),
body AS (SELECT cand.*, substring(text, (start + 1)::INT, ("end" - start)::INT) AS surface, text FROM cand JOIN documents USING (doc_id))"""


def candidates(spark, sf):
    """``doc_id, start, end, proposers, ncvalue, entry_id, depth`` of the whole corpus."""
    d = docs(spark, sf)
    occ, scored, heads = scored_terms(spark, sf)
    parts = [
        R.phrase_candidates(d, heads),
        R.cvalue_candidates(occ, cut(R.top_terms(scored))),
        gazetteer(spark, sf).select("doc_id", "start", "end", F.lit("gazetteer").alias("recaller"), "entry_id", "depth"),
    ]
    return R.merge_candidates(parts)


def surfaces(spark, sf):
    d = docs(spark, sf)
    return candidates(spark, sf).join(d, "doc_id").withColumn("surface", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))


@query(f"WITH {CAND_SQL} SELECT doc_id, start, \"end\", array_to_string(proposers, '+') AS proposers, round(ncvalue, 6) AS ncvalue, entry_id, coalesce(depth, -1) AS depth FROM cand")
def merge_candidates(spark, sf):
    return candidates(spark, sf).select("doc_id", "start", "end", F.array_join("proposers", "+").alias("proposers"), F.round("ncvalue", 6).alias("ncvalue"), "entry_id", F.coalesce("depth", F.lit(-1)).alias("depth"))


_SCORE_SQL = f"""1.6::DOUBLE * len(proposers) + 1.4::DOUBLE * (entry_id IS NOT NULL)::INT + 0.6::DOUBLE * least(coalesce(ncvalue, 0) / 8, 1)
  + 0.5::DOUBLE * list_contains(proposers, 'pattern')::INT + 0.35::DOUBLE * least({T.orthographic_sql('surface')} / 2.5::DOUBLE, 1) + 0.3::DOUBLE * least(len(string_split(surface, ' ')), 4)"""


def with_score(df):
    has = lambda name: F.array_contains("proposers", name).cast("int")
    zero = F.lit(0)
    return df.withColumn("score", R.candidate_score(
        F.size("proposers"), F.col("entry_id").isNotNull().cast("int"), has("abbrev"), has("llm"), zero, F.coalesce("ncvalue", F.lit(0.0)), has("pattern"),
        T.orthographic(F.col("surface")), F.size(F.split("surface", " ")),
    ))


@query(f"WITH {CAND_SQL} SELECT doc_id, start, \"end\", round({_SCORE_SQL}, 6) AS score FROM body")
def candidate_score(spark, sf):
    return with_score(surfaces(spark, sf)).select("doc_id", "start", "end", F.round("score", 6).alias("score"))


@query(f"""WITH {CAND_SQL}, r AS (SELECT doc_id, start, "end", row_number() OVER (PARTITION BY doc_id ORDER BY round({_SCORE_SQL}, 6) DESC, start, "end") AS k FROM body)
  SELECT doc_id, start, "end" FROM r WHERE k <= 20""")
def prune_topk(spark, sf):
    rounded = with_score(surfaces(spark, sf)).withColumn("score", F.round("score", 6))
    return R.prune(rounded, 20).select("doc_id", "start", "end")
