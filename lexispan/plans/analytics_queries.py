"""Queries over verification, scoring, canonical identity, trends, evaluation and knowledge bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import classify as C
from ..operators import evaluation as E
from ..operators import score as S
from ..operators import tokens as K
from ..operators import trends as N
from ..operators import verify as V
from ..sources import readers as R
from .fixtures import fixture
from .guard_queries import EVIDENCE_SQL, TYPE_SQL, mentions, with_evidence
from .recall_queries import CAND_SQL, surfaces
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


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- verification -------------------------------------------------------------------------------

TECH_LABELS = [0, 1, 2, 3, 4]
UNIT_SQL = """u AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS unit FROM embeddings),
mean AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(unit) AS v, unnest(range(len(unit))) AS i FROM u) GROUP BY 1, 2) GROUP BY 1),
cent AS (SELECT label, list_transform(m, lambda v: v / sqrt(list_sum(list_transform(m, lambda w: w * w)))) AS centroid FROM mean),
cosines AS (SELECT vec_id, cent.label AS proto, list_dot_product(unit, centroid) AS cos FROM u, cent),
marg AS (SELECT vec_id, max_by(proto, round(cos, 9) * 1000 - proto * 1e-12) AS nearest, max(cos) FILTER (proto <= 4) - max(cos) FILTER (proto > 4) AS margin FROM cosines GROUP BY 1)"""


@query(f"WITH {UNIT_SQL} SELECT label, i::INT AS i, round(v, 6) + 0.0 AS value FROM (SELECT label, unnest(centroid) AS v, unnest(range(len(centroid))) AS i FROM cent)")
def prototype_centroids(spark, sf):
    c = V.centroids(read(spark, sf, "embeddings"))
    return c.select("label", F.posexplode("centroid").alias("i", "v")).select("label", "i", (F.round("v", 6) + 0.0).alias("value"))


def _margins(spark, sf):
    e = read(spark, sf, "embeddings")
    return V.margins(e, V.centroids(e), TECH_LABELS)


@query(f"WITH {UNIT_SQL} SELECT vec_id, nearest, round(margin, 6) + 0.0 AS margin FROM marg")
def embedding_margin(spark, sf):
    return _margins(spark, sf).select("vec_id", "nearest", (F.round("margin", 6) + 0.0).alias("margin"))


@query(f"""WITH {UNIT_SQL}, p AS (SELECT vec_id, nearest <= 4 AS tech, vec_id % 3 <> 0 AS claims, 1 / (1 + exp(-12.0::DOUBLE * margin)) AS p FROM marg)
  SELECT vec_id, CASE WHEN claims THEN CASE WHEN p >= 0.65 THEN 'pass' WHEN p <= 0.35 AND NOT tech THEN 'reject' ELSE 'abstain' END ELSE CASE WHEN p <= 0.65 THEN 'pass' ELSE 'abstain' END END AS verdict,
    round(CASE WHEN NOT claims AND p <= 0.65 THEN 1 - p ELSE p END, 6) AS score FROM p""")
def embedding_verdict(spark, sf):
    verdict, score = V.embedding_verdict(F.col("margin"), F.col("nearest") <= 4, F.col("vec_id") % 3 != 0)
    return _margins(spark, sf).select("vec_id", verdict.alias("verdict"), F.round(score, 6).alias("score"))


_KEYED = "left(sha1(concat_ws(chr(0), lower(surface), type, substring(text, (ev_start + 1)::INT, (ev_end - ev_start)::INT))), 16)"
VERIFY_SQL = f"{TYPE_SQL.replace(EVIDENCE_SQL.split(', s AS')[0], EVIDENCE_SQL, 1)}"


def typed_with_evidence(spark, sf):
    ev, h = with_evidence(spark, sf)
    t = C.predict_type(C.type_features(ev, h))
    return t.withColumn("evidence", F.substring("text", F.col("ev_start") + 1, F.col("ev_end") - F.col("ev_start")))


_Q = f"{VERIFY_SQL}, asked AS (SELECT DISTINCT {_KEYED.replace('type', 't.type')} AS qkey FROM typed t JOIN ev USING (doc_id, start, \"end\", surface))"


@query(f"WITH {_Q} SELECT qkey FROM asked")
def verify_dedup(spark, sf):
    return V.questions(typed_with_evidence(spark, sf)).select("qkey")


@query(f"""WITH {_Q}, b AS (SELECT qkey, ('0x' || left(qkey, 2))::INT % 256 AS batch_group FROM asked),
  n AS (SELECT *, row_number() OVER (PARTITION BY batch_group ORDER BY qkey) - 1 AS rn FROM b)
  SELECT qkey, batch_group, (rn // 20)::INT AS batch, (rn % 20)::INT AS slot FROM n""")
def verify_batches(spark, sf):
    return V.batches(V.questions(typed_with_evidence(spark, sf))).select("qkey", "batch_group", "batch", "slot")


#: Every combination of an answer, what the mention claims and whether the type is right.
_ANSWERS = """SELECT row_number() OVER (ORDER BY a, c, o) AS id, a AS is_tech, c AS claims, o AS type_ok FROM
  (VALUES ('yes'), ('no'), ('unsure'), (NULL)) x(a) CROSS JOIN (VALUES (true), (false)) y(c) CROSS JOIN (VALUES (true), (false), (NULL)) z(o)"""


@query("""WITH q AS (SELECT a AS is_tech, c AS claims, o AS type_ok FROM (VALUES ('yes'), ('no'), ('unsure'), (NULL)) x(a), (VALUES (true), (false)) y(c), (VALUES (true), (false), (NULL)) z(o)),
  v AS (SELECT *, CASE is_tech WHEN 'yes' THEN CASE WHEN claims THEN 'pass' ELSE 'abstain' END WHEN 'no' THEN CASE WHEN claims THEN 'reject' ELSE 'pass' END ELSE 'abstain' END AS first FROM q)
  SELECT coalesce(is_tech, '-') AS is_tech, claims, coalesce(type_ok::VARCHAR, '-') AS type_ok, CASE WHEN first = 'pass' AND type_ok IS NOT DISTINCT FROM false THEN 'abstain' ELSE first END AS verdict FROM v""")
def verify_decide(spark, sf):
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return spark.sql(_ANSWERS).select(named("is_tech"), "claims", named("type_ok"), V.decide(F.col("is_tech"), F.col("claims"), F.col("type_ok")).alias("verdict"))


@query("""SELECT event_type AS model, count(*) AS n_calls, round(sum((n * p + n % 7 * p * 0.1::DOUBLE + n % 5 * p * 1.25::DOUBLE + n % 11 * 2 * p) / 1e6), 9) AS cost
  FROM (SELECT event_type, event_id % 1000 AS n, 1.0::DOUBLE + length(event_type) AS p FROM events) GROUP BY 1""")
def usage_cost(spark, sf):
    e = read(spark, sf, "events")
    n = F.col("event_id") % 1000
    calls = e.select(F.col("event_type").alias("model"), n.alias("input"), (n % 7).alias("cached"), (n % 5).alias("written"), (n % 11).alias("output"))
    prices = e.select(F.col("event_type").alias("model")).distinct().withColumn("price_in", 1.0 + F.length("model")).withColumn("price_out", 2.0 * F.col("price_in"))
    return V.usage_cost(calls, prices).withColumn("cost", F.round("cost", 9))


@query("""WITH n AS (SELECT length(text) AS n, least(length(text), 8400) AS read, greatest(8, length(text) // 260) AS found FROM documents),
  a AS (SELECT *, ceil(read / 2800.0::DOUBLE) AS w, floor(found * 0.18::DOUBLE * 0.5::DOUBLE + 1e-9) AS asked, floor(found * 0.03::DOUBLE + 1e-9) AS disputed FROM n)
  SELECT 'proposer' AS stage, sum(w)::BIGINT AS calls, sum(floor(read / 3.6::DOUBLE) + w * 90)::BIGINT AS input, sum(w * 400)::BIGINT AS cached, sum(w * 320)::BIGINT AS output FROM a
  UNION ALL SELECT 'verifier', sum(ceil(asked / 20))::BIGINT, sum(asked * 60)::BIGINT, sum(ceil(asked / 20) * 400)::BIGINT, sum(asked * 25)::BIGINT FROM a
  UNION ALL SELECT 'adjudicator', sum(disputed)::BIGINT, sum(disputed * 560)::BIGINT, 0, sum(disputed * 90)::BIGINT FROM a""")
def plan_cost(spark, sf):
    return V.plan(docs(spark, sf))


# --- confidence, routing, decoding ----------------------------------------------------------------

_W = X.CONFIDENCE_WEIGHTS
_CONF = f"""least(len(proposers), 4) / 4.0::DOUBLE * {_W['n_proposers']} + list_has_any(proposers, ['abbrev', 'gazetteer'])::INT * {_W['trusted_proposer']}::DOUBLE
  + (entry_id IS NOT NULL)::INT * {_W['kb_hit']}::DOUBLE + {_W['grounding_exact']}::DOUBLE + 0.3::DOUBLE * {_W['section_weight']}::DOUBLE + {_W['bias']}::DOUBLE
  + tanh(coalesce(ncvalue, 0) / 5) * {_W['corpus_df']}::DOUBLE + least({T.orthographic_sql('surface')} / 2.5::DOUBLE, 1) * {_W['distinctive_form']}::DOUBLE"""
SCORED_SQL = f"{CAND_SQL}, scored AS (SELECT doc_id, start, \"end\", surface, proposers, round(1 / (1 + exp(-({_CONF}))), 6) AS confidence FROM body)"


def scored(spark, sf):
    c = surfaces(spark, sf)
    feats = S.confidence_features(
        n_proposers=F.size("proposers"), trusted_proposer=F.arrays_overlap("proposers", F.array(*map(F.lit, X.TRUSTED))).cast("int"), kb_hit=F.col("entry_id").isNotNull().cast("int"),
        corpus_df=F.coalesce("ncvalue", F.lit(0.0)), distinctive_form=T.orthographic(F.col("surface")),
    )
    return c.withColumn("confidence", F.round(S.confidence(feats), 6))


@query(f"WITH {SCORED_SQL} SELECT doc_id, start, \"end\", confidence FROM scored")
def confidence(spark, sf):
    return scored(spark, sf).select("doc_id", "start", "end", "confidence")


@query(f"WITH {SCORED_SQL} SELECT CASE WHEN surface LIKE '%x' THEN 'rejected' WHEN confidence < 0.45 THEN 'abstained' ELSE 'emitted' END AS route, count(*)::BIGINT AS n, round(avg(confidence), 4) AS mean FROM scored GROUP BY 1")
def route_mentions(spark, sf):
    r = S.route(F.when(F.col("surface").endswith("x"), "not_tech").otherwise("method"), F.col("confidence"))
    return scored(spark, sf).groupBy(r.alias("route")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


@query()
def decode(spark, sf):
    return S.decode(scored(spark, sf)).select("doc_id", "start", "end", "confidence")


@query("SELECT doc_id, 0 AS a, 0 AS b FROM documents WHERE false")
def decode_violations(spark, sf):
    """Accepted mentions that cross, or equal spans accepted twice: none."""
    kept = S.decode(scored(spark, sf)).select("doc_id", "start", "end")
    pairs = E.overlapping_pairs(kept, kept).where("s_start < g_start AND s_end > g_start AND s_end < g_end")
    return pairs.select("doc_id", F.col("s_start").alias("a"), F.col("g_start").alias("b"))


# --- canonical identity -----------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT unnest(string_split(surface, ' '))[1:3] AS short, surface AS long FROM (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS surface FROM documents) WHERE surface <> ''),
  k AS (SELECT {T.lemma_key_sql('short')} AS short_key, {T.lemma_key_sql('long')} AS long_key FROM p)
  SELECT short_key, max_by(long_key, (n, long_key)) AS long_key FROM (SELECT short_key, long_key, count(*) AS n FROM k WHERE short_key <> long_key GROUP BY 1, 2) GROUP BY 1""")
def alias_map(spark, sf):
    d = docs(spark, sf).select(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0).alias("long")).where("long <> ''").distinct()
    return _aliases(d)


def _aliases(d):
    return S.alias_map(d.select(F.explode(F.split("long", " ")).alias("w"), "long").select(F.left("w", F.lit(3)).alias("short"), "long"))


@query()
def alias_map_texts(spark, sf):
    """As alias_map, over every word pair of the whole texts."""
    return _aliases(docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [A-Za-z]+"), 0)).alias("long")).distinct())


@query(f"""WITH links AS (SELECT p_type AS key, CASE WHEN p_size > 45 AND left(md5(p_type), 1) < '8' THEN 'z' ELSE left(md5(p_type), 1) END AS entry_id, count(*) AS n FROM part GROUP BY 1, 2),
  s AS (SELECT key, min(entry_id) AS entry_id, sum(n) AS n FROM links GROUP BY 1 HAVING count(DISTINCT entry_id) = 1)
  SELECT key, first_value(key) OVER (PARTITION BY entry_id ORDER BY n DESC, key) AS anchor FROM s""")
def kb_merge(spark, sf):
    entry = F.when((F.col("p_size") > 45) & (F.left(F.md5("p_type"), F.lit(1)) < "8"), "z").otherwise(F.left(F.md5("p_type"), F.lit(1)))
    links = read(spark, sf, "part").groupBy(F.col("p_type").alias("key"), entry.alias("entry_id")).agg(F.count("*").alias("n"))
    return S.kb_merge(links)


GROUP_SQL = "grp AS (SELECT key, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,} [A-Za-z]{7,}'))) AS key FROM documents) GROUP BY 1 HAVING count(*) > 1)"


def _groups(spark, sf):
    k = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,} [A-Za-z]{7,}"), 0)).alias("key"))
    return k.groupBy(F.lower("key").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


NIL_SQL = f"""{GROUP_SQL}, g AS (SELECT *, regexp_extract(key, '[^ ]*$') AS head FROM grp),
top AS (SELECT head, key AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY n DESC, key) AS r FROM g) WHERE r <= 40),
pr AS (SELECT least(key, anchor) AS a, greatest(key, anchor) AS b FROM g JOIN top USING (head) WHERE key <> anchor
  UNION SELECT least(g.key, p.key), greatest(g.key, p.key) FROM g JOIN grp p ON p.key = string_split(g.key, ' ')[1] OR p.key = string_split(g.key, ' ')[2])"""


@query(f"WITH {NIL_SQL} SELECT a, b FROM pr")
def nil_pairs(spark, sf):
    return S.nil_pairs(_groups(spark, sf))


@query(f"""WITH RECURSIVE {NIL_SQL}, e AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr),
  r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS node, min(y) AS root FROM r GROUP BY 1""")
def nil_components(spark, sf):
    # All keys of a head meet its first anchor, so that one joins them; the others would add edges alone.
    return S.components(S.nil_pairs(_groups(spark, sf), anchors=1))


ORDER_SQL = """om AS (SELECT o_orderkey AS doc_id, p_name AS key, o_orderstatus AS role, year(o_orderdate)::INT AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
od AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year FROM orders)"""


def order_mentions(spark, sf):
    """The relational corpus: a document is an order, its mentions the names of its parts, the role its status."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    m = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return m.select(F.col("o_orderkey").alias("doc_id"), F.col("p_name").alias("key"), F.col("o_orderstatus").alias("role"), "year")


def order_documents(spark, sf):
    year = F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), year.alias("year"))


@query(f"""WITH {ORDER_SQL} SELECT root, left(sha1(root), 10) AS canonical_id, max_by(key, (len(string_split(key, ' ')), length(key), key)) AS label, count(DISTINCT key) AS n_aliases, count(*) AS n_mentions,
  count(DISTINCT doc_id) AS n_documents, min(year) AS first_seen FROM (SELECT *, split_part(key, ' ', 1) AS root FROM om) GROUP BY 1""")
def canonical_entries(spark, sf):
    m = order_mentions(spark, sf).withColumn("root", F.substring_index("key", " ", 1)).withColumnRenamed("key", "surface")
    return S.canonical_entries(m)


@query(f"WITH {ORDER_SQL}, f AS (SELECT split_part(key, ' ', 1) AS root, min(year) AS first_seen FROM om GROUP BY 1) SELECT doc_id, key, left(sha1(root), 10) AS canonical_id, first_seen FROM om JOIN f ON root = split_part(key, ' ', 1)")
def assign_canonical(spark, sf):
    m = order_mentions(spark, sf).withColumn("root", F.substring_index("key", " ", 1))
    entries = S.canonical_entries(m.withColumnRenamed("key", "surface")).select("root", "canonical_id", "first_seen")
    return m.join(entries, "root").select("doc_id", "key", "canonical_id", "first_seen")


@query(f"WITH {ORDER_SQL} SELECT key, min(year) AS attested_from FROM om GROUP BY 1")
def attestation(spark, sf):
    return order_mentions(spark, sf).groupBy("key").agg(F.min("year").alias("attested_from"))


# --- knowledge base ---------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('root', 0, '', ''), ('ai', 1, '', 'root'), ('search', 2, '', 'ai'), ('neural_networks', 2, 'neural nets', 'ai'), ('cnn', 3, 'convolutional networks', 'neural_networks'),
  ('convolutional_networks', 6, '', ''), ('lost', 6, 'lost topic', ''), ('lost_topic', 6, '', '')) t(id, depth, aliases, parents)""")
def kb_compile(spark, sf):
    kb = R.compile_kb(R.parse_triples(fixture(spark, "fx_triples")), "root")
    return kb.select("id", "depth", F.array_join("aliases", "|").alias("aliases"), F.array_join("parents", "|").alias("parents"))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey < 64 THEN floor(log2(greatest(p_partkey, 1)))::INT ELSE 6 END AS depth FROM part WHERE p_partkey BETWEEN 1 AND 127")
def kb_depth(spark, sf):
    """A binary tree over all part keys: depth is the floor of log2, down to the deepest level of a knowledge base."""
    p = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("o"), F.floor(F.col("p_partkey") / 2).cast("long").cast("string").alias("s"))
    return R.depths(p.where("s <> '0'").withColumn("p", F.lit("superTopicOf")), "1")


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), " + T.q(T.SPACE + "+") + ", ' ', 'g'), ' ')) AS digest FROM pages")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(R.clean_html(F.col("html"))).alias("digest"))


# --- trends -----------------------------------------------------------------------------------------

TREND_SQL = f"""{ORDER_SQL}, tot AS (SELECT year, count(*) AS n FROM od GROUP BY 1),
ser AS (SELECT key, od.year, count(DISTINCT doc_id) AS n_docs FROM om JOIN od USING (doc_id) WHERE od.year IS NOT NULL GROUP BY 1, 2),
shr AS (SELECT k.key, t.year, coalesce(n_docs, 0)::DOUBLE / t.n AS share FROM (SELECT DISTINCT key FROM ser) k CROSS JOIN (SELECT * FROM tot WHERE year IS NOT NULL) t LEFT JOIN ser ON ser.key = k.key AND ser.year = t.year)"""


def _series(spark, sf):
    m, d = order_mentions(spark, sf).drop("year"), order_documents(spark, sf)
    return m, d, N.series_year(m, d), N.year_totals(d)


@query(f"WITH {TREND_SQL} SELECT coalesce(year, 0)::INT AS year, n FROM tot")
def year_totals(spark, sf):
    return N.year_totals(order_documents(spark, sf)).select(F.coalesce("year", F.lit(0)).alias("year"), "n")


@query(f"WITH {TREND_SQL} SELECT key, year, n_docs FROM ser")
def series_year(spark, sf):
    return _series(spark, sf)[2]


@query(f"WITH {TREND_SQL} SELECT key, od.year, om.role, count(*) AS n FROM om JOIN od USING (doc_id) WHERE od.year IS NOT NULL GROUP BY 1, 2, 3")
def series_role(spark, sf):
    m, d, _, _ = _series(spark, sf)
    return N.series_role(m, d)


@query(f"WITH {TREND_SQL} SELECT key, year, round(share, 8) AS share FROM shr")
def series_share(spark, sf):
    _, _, s, t = _series(spark, sf)
    return N.series_share(s, t).withColumn("share", F.round("share", 8))


@query(f"WITH {TREND_SQL} SELECT key, sum(n_docs)::BIGINT AS total FROM ser GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_series(spark, sf):
    return N.top_series(_series(spark, sf)[2])


@query(f"""WITH {TREND_SQL}, rk AS (SELECT year, dense_rank() OVER (ORDER BY year DESC) AS back FROM tot WHERE year IS NOT NULL), fl AS (SELECT 1.0::DOUBLE / sum(n) AS f FROM tot WHERE year IS NOT NULL),
  k AS (SELECT key, regr_slope(share, year::DOUBLE) AS slope, coalesce(avg(share) FILTER (back <= 3), 0) AS recent, coalesce(avg(share) FILTER (back > 3), 0) AS earlier FROM shr JOIN rk USING (year)
    WHERE key IN (SELECT key FROM ser GROUP BY 1 HAVING sum(n_docs) >= 4) GROUP BY 1)
  SELECT key, round(slope, 6) + 0.0 AS slope, round((recent + f) / (earlier + f), 3) AS growth, round(recent, 5) AS recent, round(earlier, 5) AS earlier FROM k, fl ORDER BY 3 DESC, 2 DESC, 1 LIMIT 25""")
def emerging(spark, sf):
    _, _, s, t = _series(spark, sf)
    return N.emerging(s, t).withColumn("slope", F.col("slope") + 0.0)


@query(f"""WITH {TREND_SQL}, rl AS (SELECT key, od.year, om.role, count(*) AS n FROM om JOIN od USING (doc_id) WHERE od.year IS NOT NULL GROUP BY 1, 2, 3),
  h AS (SELECT key, year, row_number() OVER (PARTITION BY key ORDER BY year) <= greatest(1, count(*) OVER (PARTITION BY key) // 2) AS early, count(*) OVER (PARTITION BY key) AS ny, sum(n_docs) OVER (PARTITION BY key) AS total FROM ser),
  a AS (SELECT key, coalesce((sum(n) FILTER (early AND role IN ('F', 'P')))::DOUBLE / sum(n) FILTER (early), 0) AS early, coalesce((sum(n) FILTER (NOT early AND role IN ('F', 'P')))::DOUBLE / sum(n) FILTER (NOT early), 0) AS late
    FROM rl JOIN h USING (key, year) WHERE ny >= 2 AND total >= 6 GROUP BY 1)
  SELECT key, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) + 0.0 AS shift FROM a""")
def role_transitions(spark, sf):
    m, d, s, _ = _series(spark, sf)
    r = N.role_transitions(N.series_role(m, d), s, late_roles=("F", "P"))
    return r.select("key", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), (F.round("shift", 6) + 0.0).alias("shift"))


@query(f"""WITH {ORDER_SQL}, o AS (SELECT DISTINCT doc_id, key FROM om), df AS (SELECT key, count(*) AS df FROM o GROUP BY 1 HAVING count(*) >= 3), n AS (SELECT count(DISTINCT doc_id) AS n FROM o),
  p AS (SELECT x.key AS a, y.key AS b, count(*) AS joint FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.key < y.key GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT a, b, joint, round(ln(joint * n::DOUBLE / (da.df * db.df)), 6) AS pmi FROM p JOIN df da ON da.key = a JOIN df db ON db.key = b, n ORDER BY 4 DESC, 1, 2 LIMIT 40""")
def cooccurrence_pmi(spark, sf):
    return N.cooccurrence(order_mentions(spark, sf))


# --- evaluation ---------------------------------------------------------------------------------------

# System: phrases with a head; gold: those of them at even places, every seventh shifted by one.
GOLD_SQL = f"""{TYPE_SQL}, sys AS (SELECT doc_id, start, "end", type, CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'patent' END AS genre FROM typed),
gold AS (SELECT doc_id, (start + CASE WHEN start % 7 = 0 THEN 1 ELSE 0 END)::INT AS start, "end", CASE WHEN start % 5 = 0 THEN 'task' ELSE type END AS type, genre FROM sys WHERE start % 2 = 0)"""


def system_and_gold(spark, sf):
    m, h = mentions(spark, sf)
    typed = C.predict_type(C.type_features(m.select("doc_id", "start", "end", "surface"), h))
    system = typed.select("doc_id", "start", "end", "type", F.when(F.col("doc_id") % 2 == 0, "paper").otherwise("patent").alias("genre"))
    moved = (F.col("start") + F.when(F.col("start") % 7 == 0, 1).otherwise(0)).alias("start")
    gold = system.where("start % 2 = 0").select("doc_id", moved, "end", F.when(F.col("start") % 5 == 0, "task").otherwise(F.col("type")).alias("type"), "genre")
    return system, gold


@query(f"WITH {GOLD_SQL} SELECT doc_id, start, \"end\" FROM sys SEMI JOIN gold USING (doc_id, start, \"end\")")
def align_strict(spark, sf):
    s, g = system_and_gold(spark, sf)
    return E.align_strict(s.select("doc_id", "start", "end"), g.select("doc_id", "start", "end"))


PAIR_SQL = f"""{GOLD_SQL}, pr AS (SELECT s.doc_id, s.start AS s_start, s."end" AS s_end, g.start AS g_start, g."end" AS g_end,
  (least(s."end", g."end") - greatest(s.start, g.start))::DOUBLE / (greatest(s."end", g."end") - least(s.start, g.start)) AS iou
  FROM sys s JOIN gold g ON s.doc_id = g.doc_id AND s.start < g."end" AND g.start < s."end")"""


@query(f"WITH {PAIR_SQL} SELECT doc_id, s_start, s_end, g_start, g_end, round(iou, 6) AS iou FROM pr")
def align_partial_pairs(spark, sf):
    s, g = system_and_gold(spark, sf)
    return E.overlapping_pairs(s, g).withColumn("iou", F.round("iou", 6))


@query()
def align_partial(spark, sf):
    return E.align_partial(*system_and_gold(spark, sf))


@query("SELECT doc_id, 0 AS start FROM documents WHERE false")
def align_partial_violations(spark, sf):
    """Spans that are aligned more than once, on either side: none."""
    a = E.align_partial(*system_and_gold(spark, sf))
    twice = lambda p: a.groupBy("doc_id", f"{p}_start", f"{p}_end").count().where("count > 1").select("doc_id", F.col(f"{p}_start").alias("start"))
    return twice("s").unionByName(twice("g"))


PRF_SQL = f"""{GOLD_SQL}, hit AS (SELECT sys.*, 1 AS t FROM sys SEMI JOIN gold USING (doc_id, start, "end")),
c AS (SELECT genre, type, 0 AS s, 0 AS g, 1 AS t FROM hit UNION ALL SELECT genre, type, 1, 0, 0 FROM sys UNION ALL SELECT genre, type, 0, 1, 0 FROM gold)"""
_PRF = """tp, n_system, n_gold, round(coalesce(tp / nullif(n_system, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(n_gold, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * (tp / nullif(n_system, 0)::DOUBLE) * (tp / nullif(n_gold, 0)::DOUBLE) / nullif(tp / nullif(n_system, 0)::DOUBLE + tp / nullif(n_gold, 0)::DOUBLE, 0), 0), 6) AS f1"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {PRF_SQL}, a AS (SELECT sum(t)::BIGINT AS tp, sum(s)::BIGINT AS n_system, sum(g)::BIGINT AS n_gold FROM c) SELECT {_PRF} FROM a")
def prf_overall(spark, sf):
    return _rounded(E.prf_by(*system_and_gold(spark, sf), [[]]).drop("genre", "type"))


@query(f"WITH {PRF_SQL}, a AS (SELECT coalesce(genre, 'all') AS genre, coalesce(type, 'all') AS type, sum(t)::BIGINT AS tp, sum(s)::BIGINT AS n_system, sum(g)::BIGINT AS n_gold FROM c GROUP BY GROUPING SETS ((), (genre), (type))) SELECT genre, type, {_PRF} FROM a")
def prf_by_genre_type(spark, sf):
    out = E.prf_by(*system_and_gold(spark, sf), [[], ["genre"], ["type"]])
    return _rounded(out).withColumns({c: F.coalesce(c, F.lit("all")) for c in ("genre", "type")})


@query(f"WITH {GOLD_SQL} SELECT gold.type AS gold_type, " + ", ".join(f"(count(*) FILTER (sys.type = '{t}'))::BIGINT AS {t}" for t in X.TYPES) + " FROM sys JOIN gold USING (doc_id, start, \"end\") GROUP BY 1")
def confusion(spark, sf):
    s, g = system_and_gold(spark, sf)
    both = E.align_strict(s.drop("genre"), g.select("doc_id", "start", "end", F.col("type").alias("gold_type")))
    return both.groupBy("gold_type").pivot("type", X.TYPES).count().fillna(0)


@query(f"WITH {EVIDENCE_SQL} SELECT count(*)::BIGINT AS n, round(avg((substring(text, (start + 1)::INT, (\"end\" - start)::INT) <> surface)::INT), 6) AS rate FROM ev")
def hallucination_rate(spark, sf):
    m, _ = mentions(spark, sf)
    wrong = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface")
    return m.agg(F.count("*").alias("n"), F.round(F.avg(wrong.cast("int").cast("double")), 6).alias("rate"))


CURVE_SQL = """sc AS (SELECT quality AS label, (('0x' || left(md5(doc_id::VARCHAR), 6))::INT % 1000 + 300 * quality) / 1300.0::DOUBLE AS score FROM labels),
lv AS (SELECT round(floor(score * 10000) / 10000, 6) AS score, count(*) AS c, sum(label) AS l FROM sc GROUP BY 1),
cv AS (SELECT score, (sum(c) OVER w)::BIGINT AS n, (sum(l) OVER w)::BIGINT AS hits, (sum(c) OVER w)::DOUBLE / sum(c) OVER () AS coverage, (sum(l) OVER w)::DOUBLE / sum(c) OVER w AS precision FROM lv WINDOW w AS (ORDER BY score DESC))"""


def labelled(spark, sf):
    h = F.conv(F.left(F.md5(F.col("doc_id").cast("string")), F.lit(6)), 16, 10).cast("int")
    return read(spark, sf, "labels").select(F.col("quality").alias("label"), ((h % 1000 + 300 * F.col("quality")) / 1300.0).alias("score"))


@query(f"WITH {CURVE_SQL} SELECT score, n, hits, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM cv")
def risk_coverage(spark, sf):
    return E.risk_coverage(labelled(spark, sf)).withColumns({c: F.round(c, 6) for c in ("coverage", "precision")})


@query(f"""WITH {CURVE_SQL}, p AS (SELECT CASE WHEN lag(coverage) OVER w IS NULL THEN coverage * (1 - precision) ELSE (coverage - lag(coverage) OVER w) * (1 - precision + lag(1 - precision) OVER w) / 2 END AS piece FROM cv WINDOW w AS (ORDER BY n))
  SELECT round(sum(piece), 6) AS aurc FROM p""")
def aurc(spark, sf):
    return E.aurc(E.risk_coverage(labelled(spark, sf))).withColumn("aurc", F.round("aurc", 6))


@query(f"""WITH {CURVE_SQL} SELECT 'precision_at_0.5' AS name, round(min_by(precision, n) FILTER (coverage >= 0.5), 6) AS value FROM cv UNION ALL SELECT 'precision_at_0.8', round(min_by(precision, n) FILTER (coverage >= 0.8), 6) FROM cv
  UNION ALL SELECT 'coverage_at_0.8', round(coalesce(max(coverage) FILTER (precision >= 0.8), 0), 6) FROM cv UNION ALL SELECT 'threshold_for_0.8', round(coalesce(min(score) FILTER (precision >= 0.8), 1), 6) FROM cv
  UNION ALL SELECT 'coverage_at_0.9', round(coalesce(max(coverage) FILTER (precision >= 0.9), 0), 6) FROM cv UNION ALL SELECT 'threshold_for_0.9', round(coalesce(min(score) FILTER (precision >= 0.9), 1), 6) FROM cv""")
def threshold_choice(spark, sf):
    return E.operating_points(E.risk_coverage(labelled(spark, sf))).withColumn("value", F.round("value", 6))


@query(f"WITH {CURVE_SQL} SELECT least(floor(score * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy, round(abs(avg(score) - avg(label)), 6) AS gap FROM sc GROUP BY 1")
def ece(spark, sf):
    return E.ece(labelled(spark, sf)).withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy", "gap")})


@query(f"""WITH {GOLD_SQL}, d AS (SELECT DISTINCT doc_id, start, "end" FROM gold), k AS (SELECT d.*, CASE WHEN EXISTS (SELECT 1 FROM sys WHERE sys.doc_id = d.doc_id AND sys.start = d.start AND sys."end" = d."end" AND sys.start % 3 = 0) THEN 'emitted'
    WHEN EXISTS (SELECT 1 FROM sys WHERE sys.doc_id = d.doc_id AND sys.start = d.start AND sys."end" = d."end") THEN 'withheld' ELSE 'never_proposed' END AS outcome FROM d)
  SELECT outcome, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def loss_attribution(spark, sf):
    s, g = system_and_gold(spark, sf)
    return E.attribute_losses(g, emitted=s.where("start % 3 = 0"), withheld=s).groupBy("outcome").agg(F.count("*").alias("n"))


def _gold_terms(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,} [A-Za-z]{5,}"), 0)).alias("surface"))


@query()
def gold_expand(spark, sf):
    return E.expand_gold(docs(spark, sf), _gold_terms(spark, sf))


@query("SELECT doc_id, 0 AS start FROM documents WHERE false")
def gold_validate(spark, sf):
    d = docs(spark, sf)
    return E.invalid_gold(d, E.expand_gold(d, _gold_terms(spark, sf))).select("doc_id", "start")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('13|' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 50")
def sample_stratified(spark, sf):
    return E.stratified_sample(read(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 50).select("o_orderkey", "o_orderpriority")


def corpus_lexicons(spark, sf):
    """Lexicons from the corpus's own frequencies, which stand in for real ones in the queries."""
    from ..operators import profile as P
    from ..operators import recall as Y
    from ..operators import tokens as K
    from ..operators.lineage import cut
    from .pipeline import Lexicons

    d = docs(spark, sf)
    return Lexicons(cut(P.heads(d)), cut(P.closed_class(d)), cut(P.cues(d)), cut(Y.frequent_bigrams(K.tokens(d), d)), spark.createDataFrame([], "term string"))


@query()
def extract(spark, sf):
    """Emitted mentions of the whole corpus, through every stage."""
    from .pipeline import extract as run

    found = run(docs(spark, sf), lexicons=corpus_lexicons(spark, sf)).mentions
    return found.select("doc_id", "start", "end", "surface", "type", "role", "section", "canonical_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH s AS (SELECT doc_id, kind, start, "end" FROM {K.claims_sql('documents')} UNION ALL SELECT doc_id, kind, start, "end" FROM {K.heading_sections_sql('documents')}),
  f AS (SELECT doc_id, start AS lo, "end" AS hi FROM s WHERE kind IN ('title', 'abstract')
    UNION ALL SELECT doc_id, start, least("end", start + 1400) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM s WHERE kind = 'claim_independent') WHERE k = 1)
  SELECT doc_id, lo::INT AS lo, hi::INT AS hi FROM f UNION ALL SELECT doc_id, 0, least(length(text), 2000)::INT FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM f)""")
def evaluation_zones(spark, sf):
    d = docs(spark, sf)
    sections = K.claims(d).select("doc_id", "kind", "start", "end").unionByName(K.heading_sections(d).select("doc_id", "kind", "start", "end"))
    return E.evaluation_zones(d, sections)


@query("""WITH g AS (SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1), h AS (SELECT key, n, regexp_extract(key, '[^ ]*$') AS head FROM g)
  SELECT a.key AS a, b.key AS b, a.head = b.head OR contains(' ' || a.key || ' ', ' ' || b.key || ' ') OR contains(' ' || b.key || ' ', ' ' || a.key || ' ') AS compatible
  FROM h a JOIN h b ON a.head = b.head AND a.key < b.key""")
def head_compatible(spark, sf):
    g = read(spark, sf, "part").select(F.col("p_name").alias("key")).distinct().withColumn("head", F.substring_index("key", " ", -1))
    b = g.select(F.col("key").alias("b"), "head")
    pairs = g.select(F.col("key").alias("a"), "head").join(b, "head").where("a < b")
    return pairs.select("a", "b", S.head_compatible(F.col("a"), F.col("b")).alias("compatible"))
