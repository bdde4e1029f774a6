"""Queries over text functions and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tokens as K
from .fixtures import fixture, sub

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _both(function, sql, name):
    """One query over the documents and the raw fixture, reported by length and digest."""

    def run(spark, sf):
        every = docs(spark, sf).unionByName(fixture(spark, "fx_raw").select(F.col("doc_id").cast("long") - 1000, "text").toDF("doc_id", "text"))
        out = function(F.col("text"))
        return every.select("doc_id", F.length(out).alias("n"), F.md5(out).alias("digest"))

    QUERIES[name] = run
    SQL[name] = f"""SELECT doc_id, length(x)::INT AS n, md5(x) AS digest FROM (
      SELECT doc_id, {sql('text')} AS x FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id - 1000, text FROM {sub('fx_raw')}))"""


_both(T.normalise, T.normalise_sql, "normalize_text")
_both(T.fold_characters, T.fold_characters_sql, "fold_characters")
_both(T.dehyphenate, T.dehyphenate_sql, "dehyphenate")
_both(T.mask_citations, T.mask_citations_sql, "mask_citations")
_both(T.collapse_space, T.collapse_space_sql, "whitespace_collapse")

_WORDS = r"[^ \t\n\x0B\f\r]+"


def _surfaces(spark, sf):
    """Distinct words and two-word runs of the documents, and the fixture's surfaces."""
    pairs = r"[A-Za-z]+ [A-Za-z]+"
    d = docs(spark, sf)
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(_WORDS), 0)).alias("surface"))
    runs = d.select(F.explode(F.regexp_extract_all("text", F.lit(pairs), 0)).alias("surface"))
    return words.union(runs).union(fixture(spark, "fx_surfaces").select("surface")).distinct()


_SURFACES_SQL = f"""(SELECT DISTINCT surface FROM (
  SELECT unnest(regexp_extract_all(text, {T.q(_WORDS)})) AS surface FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+')) FROM documents
  UNION ALL SELECT surface FROM {sub('fx_surfaces')}))"""


@query(f"SELECT surface, {T.lemma_key_sql('surface')} AS lemma FROM {_SURFACES_SQL} WHERE length(lower(surface)) = length(surface)")
def lemma_key(spark, sf):
    return _surfaces(spark, sf).where(F.length(F.lower("surface")) == F.length("surface")).select("surface", T.lemma_key(F.col("surface")).alias("lemma"))


@query(f"SELECT surface, {T.strip_determiner_sql('surface')} AS stripped FROM {_SURFACES_SQL}")
def strip_determiner(spark, sf):
    return _surfaces(spark, sf).select("surface", T.strip_determiner(F.col("surface")).alias("stripped"))


@query(f"SELECT surface, {T.orthographic_sql('surface')} AS weight FROM {_SURFACES_SQL}")
def orthographic_score(spark, sf):
    return _surfaces(spark, sf).select("surface", T.orthographic(F.col("surface")).alias("weight"))


_TRIM_SQL = T.q(T._TRIM)
_CORE = f"trim(surface, {_TRIM_SQL})"


@query(f"""WITH c AS (SELECT surface, {_CORE} AS core, length(surface) - length(ltrim(surface, {_TRIM_SQL})) AS lead_cut FROM {_SURFACES_SQL}),
  p AS (SELECT *, length(core) - instr(reverse(core), '(') AS last, length(core) - length(replace(core, '(', '')) AS o, length(core) - length(replace(core, ')', '')) AS c FROM c)
  SELECT surface, lead_cut::INT AS lead_cut, length(CASE WHEN o > c AND last * 2 > length(core) THEN rtrim(left(core, last::INT), {_TRIM_SQL}) ELSE core END)::INT AS kept FROM p""")
def span_trim(spark, sf):
    lead, kept = T.trimmed_bounds(F.col("surface"))
    return _surfaces(spark, sf).select("surface", lead.alias("lead_cut"), kept.alias("kept"))


@query(f"SELECT surface, {T.IS_SHORT_FORM_SQL.format('surface')} AS short_form FROM {_SURFACES_SQL}")
def short_form_test(spark, sf):
    return _surfaces(spark, sf).select("surface", T.is_short_form(F.col("surface")).alias("short_form"))


_TOK_SQL = K.pieces_sql(K.TOKEN)


@query(f"SELECT doc_id, pos::INT AS pos, tok, start, \"end\" FROM {_TOK_SQL}")
def token_offsets(spark, sf):
    return K.tokens(docs(spark, sf))


@query(f"SELECT doc_id, start, left(sha256(concat_ws(chr(0), doc_id, start, \"end\", tok)), 16) AS hash, left(sha1(lower(tok)), 10) AS id FROM {_TOK_SQL}")
def content_hash(spark, sf):
    t = K.tokens(docs(spark, sf))
    return t.select("doc_id", "start", T.content_hash(F.col("doc_id"), F.col("start"), F.col("end"), F.col("tok")).alias("hash"), T.stable_id(F.lower("tok")).alias("id"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def text_to_year(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", T.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query(f"""SELECT * FROM {K.sentences_sql()} UNION ALL
  SELECT doc_id - 1000, sent_idx, start, "end" FROM {K.sentences_sql(sub('fx_sentences'))}""")
def sentence_spans(spark, sf):
    fx = K.sentences(fixture(spark, "fx_sentences")).withColumn("doc_id", F.col("doc_id").cast("long") - 1000)
    return K.sentences(docs(spark, sf)).unionByName(fx)


@query(f"""WITH s AS (SELECT * FROM {K.sentences_sql()}), t AS (SELECT doc_id, start, "end" FROM {_TOK_SQL})
  SELECT t.doc_id, t.start, s.sent_idx, s.start AS ev_start, s."end" AS ev_end
  FROM t ASOF LEFT JOIN s ON t.doc_id = s.doc_id AND t.start >= s.start""")
def sentence_of_offset(spark, sf):
    d = docs(spark, sf)
    return K.sentence_of(K.tokens(d).select("doc_id", "start", "end"), K.sentences(d)).select("doc_id", "start", "sent_idx", "ev_start", "ev_end")


@query(f"SELECT doc_id::BIGINT AS doc_id, ordinal, kind, start, \"end\", claim_number, coalesce(depends_on, 0) AS depends_on FROM {K.claims_sql(sub('fx_claims'))} UNION ALL SELECT doc_id, ordinal, kind, start, \"end\", claim_number, coalesce(depends_on, 0) FROM {K.claims_sql('documents')}")
def claim_sections(spark, sf):
    return K.claims(fixture(spark, "fx_claims")).unionByName(K.claims(docs(spark, sf))).fillna(0, "depends_on")


@query(f"SELECT 'paper' AS family, * FROM {K.heading_sections_sql(sub('fx_papers'))} UNION ALL SELECT 'patent', * FROM {K.heading_sections_sql(sub('fx_patents'), 'patent')} UNION ALL SELECT 'corpus', * FROM {K.heading_sections_sql('documents')}")
def heading_sections(spark, sf):
    named = lambda df, n: df.select(F.lit(n).alias("family"), "*")
    paper, patent = K.heading_sections(fixture(spark, "fx_papers")), K.heading_sections(fixture(spark, "fx_patents"), "patent")
    return named(paper, "paper").unionByName(named(patent, "patent")).unionByName(named(K.heading_sections(docs(spark, sf)), "corpus"))


@query(f"""WITH s AS (SELECT * FROM {K.heading_sections_sql(sub('fx_papers'))}), t AS (SELECT doc_id, start, "end" FROM {K.pieces_sql(K.TOKEN, sub('fx_papers'))})
  SELECT t.doc_id, t.start, t."end", coalesce(min_by(kind, ordinal), 'other') AS section
  FROM t LEFT JOIN s ON t.doc_id = s.doc_id AND s.start <= t.start AND t.start < s."end" GROUP BY 1, 2, 3""")
def section_at_offset(spark, sf):
    fx = fixture(spark, "fx_papers")
    return K.section_at(K.tokens(fx).select("doc_id", "start", "end"), K.heading_sections(fx))


@query()
def section_at_offset_corpus(spark, sf):
    d = docs(spark, sf)
    return K.section_at(K.tokens(d).select("doc_id", "start", "end"), K.heading_sections(d))


_ZONES_SQL = f"(SELECT doc_id, start AS lo, \"end\" + length(tok) AS hi FROM {_TOK_SQL} WHERE length(tok) > 6)"


@query(f"SELECT doc_id, lo::INT AS lo, hi::INT AS hi FROM {K.merge_zones_sql(_ZONES_SQL)}")
def zones_merge(spark, sf):
    t = K.tokens(docs(spark, sf)).where(F.length("tok") > 6)
    return K.merge_zones(t.select("doc_id", F.col("start").alias("lo"), (F.col("end") + F.length("tok")).alias("hi")))


_JSON_CASES = "CASE id WHEN 1 THEN '{\"a\": 1}' WHEN 2 THEN '{\"b\": 2}' WHEN 3 THEN '{\"c\": 3}' WHEN 4 THEN '{\"items\":[1, 2]}' WHEN 7 THEN '{\"items\":[{\"x\": 1}]}' END"


@query(f"SELECT id::INT AS id, {_JSON_CASES} AS object FROM {sub('fx_replies')}")
def json_recovery(spark, sf):
    return fixture(spark, "fx_replies").select("id", T.json_object(F.col("reply")).alias("object"))


@query("""WITH w AS (SELECT doc_id, (doc_id % 300)::DOUBLE AS d, (n_chars % 17)::DOUBLE - 8 AS z FROM documents)
  SELECT doc_id, round(CASE WHEN d >= 140 THEN 0.25::DOUBLE ELSE 1 - 0.75::DOUBLE * d / 140 END, 6) AS decay, round(1 / (1 + exp(-z)), 6) AS sigmoid,
         round(tanh(z / 8), 6) AS squash, round(1 / (1 + exp(least(z, 1.5::DOUBLE) - greatest(z, 1.5::DOUBLE))), 6) AS softmax FROM w""")
def scalar_scores(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    w = d.select("doc_id", (F.col("doc_id") % 300).cast("double").alias("d"), ((F.col("n_chars") % 17).cast("double") - 8).alias("z"))
    soft = T.winner_probability(F.array("z", F.lit(1.5)))
    return w.select("doc_id", F.round(T.decay(F.col("d"), 140), 6).alias("decay"), F.round(T.sigmoid(F.col("z")), 6).alias("sigmoid"), F.round(T.squash(F.col("z")), 6).alias("squash"), F.round(soft, 6).alias("softmax"))
