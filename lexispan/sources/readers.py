"""Readers: documents, results, annotations, knowledge bases, feeds and pages, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, lemma_key, normalise

_SPAN = "STRUCT<start: INT, end: INT, surface: STRING>"
DOCUMENT = (
    f"doc_id STRING, genre STRING, text STRING, sections ARRAY<STRUCT<kind: STRING, span: {_SPAN}, ordinal: INT, heading: STRING, attrs: MAP<STRING, INT>>>, "
    "metadata STRUCT<source: STRING, source_id: STRING, url: STRING, title: STRING, date: STRING, categories: ARRAY<STRING>, extra: MAP<STRING, STRING>>, raw_sha256 STRING"
)
GOLD = "doc_id STRING, genre STRING, zones ARRAY<ARRAY<INT>>, annotator STRING, notes STRING, mentions ARRAY<STRUCT<start: INT, end: INT, surface: STRING, type: STRING, role: STRING, note: STRING>>"
MENTION = (
    "mention_id STRING, doc_id STRING, start INT, end INT, surface STRING, normalized STRING, type STRING, granularity INT, role STRING, section STRING, "
    "ev_start INT, ev_end INT, confidence DOUBLE, canonical_id STRING, proposers ARRAY<STRING>, config_digest STRING, content_hash STRING"
)
KB = "id STRING, label STRING, aliases ARRAY<STRING>, depth INT, parents ARRAY<STRING>, kb STRING, attested_from INT"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines; blank lines are no rows."""
    return spark.read.schema(DOCUMENT).json(path).where("doc_id IS NOT NULL")


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    docs.write.mode(mode).json(path)


def sections_of(docs: DataFrame) -> DataFrame:
    s = docs.select("doc_id", F.explode("sections").alias("s"))
    return s.select("doc_id", "s.ordinal", "s.kind", "s.span.start", "s.span.end", "s.heading", F.col("s.attrs")["claim_number"].alias("claim_number"), F.col("s.attrs")["depends_on"].alias("depends_on"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents of JSON lines; lines that begin with ``//`` are comments."""
    lines = spark.read.text(path).where("NOT startswith(ltrim(value), '//') AND trim(value) <> ''")
    return lines.select(F.from_json("value", GOLD).alias("g")).select("g.*")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows of tab-separated text; ``#`` lines and rows under four columns are skipped."""
    lines = spark.read.text(path).where("NOT startswith(value, '#') AND trim(value) <> ''")
    c = F.split("value", "\t")
    cell = lambda i: F.trim(F.get(c, F.lit(i)))
    return lines.where(F.size(c) >= 4).select(cell(0).alias("doc_id"), cell(1).alias("surface"), cell(2).alias("type"), cell(3).alias("role"), F.coalesce(cell(4), F.lit("")).alias("note"))


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """The mentions of written results, one a row, as :func:`write_results` was given them."""
    fields = ", ".join(f"{n}: {k}" for n, k in (f.split(" ", 1) for f in MENTION.split(", ")) if n != "doc_id")
    nested = spark.read.schema(f"doc_id STRING, mentions ARRAY<STRUCT<{fields}>>").json(f"{path}/results")
    return nested.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*")


def flat_mentions(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated table of written results."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{path}/mentions")


def write_gold(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Annotated documents as JSON lines; :func:`gold` reads them back."""
    records.write.mode(mode).json(path)


def length_filtered(docs: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Documents whose text has at least ``least`` and at most ``most`` characters."""
    kept = docs.where(F.length("text") >= least)
    return kept if most is None else kept.where(F.length("text") <= most)


def lexicon(spark: SparkSession, path: str, column: str = "term") -> DataFrame:
    """One lower-cased entry a line; blank lines and ``#`` comments are skipped, repeats are one."""
    line = F.lower(F.btrim("value", F.lit(" \t\r")))
    return spark.read.text(path).select(line.alias(column)).where(f"{column} <> '' AND NOT startswith({column}, '#')").distinct()


def head_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, type, weight`` of JSON ``{type: {head: weight}}``; a head of several types has its heaviest, then the first, one."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    rows = raw.select(F.explode("m").alias("type", "heads")).select("type", F.explode("heads").alias("word", "weight"))
    return rows.groupBy(F.lower("word").alias("word")).agg(F.min_by(F.struct("type", "weight"), F.struct(-F.col("weight"), "type")).alias("b")).select("word", "b.type", "b.weight")


def cue_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str | None, dict[str, float]]]:
    """Cues ``phrase, role, weight`` and priors by section of JSON ``{cues: {role: [[phrase, weight]]}, section_prior: {section: {role: prior}}}``."""
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.from_json("value", "cues map<string, array<array<string>>>, section_prior map<string, map<string, double>>").alias("x")).select("x.*")
    rows = both.select(F.explode("cues").alias("role", "entries")).select("role", F.explode("entries").alias("e"))
    cues = rows.select(F.lower(F.col("e")[0]).alias("phrase"), "role", F.col("e")[1].cast("double").alias("weight"))
    first = both.select(F.map_keys("cues").alias("roles"), "section_prior").first()  # one small file
    prior: dict[str | None, dict[str, float]] = {None: dict.fromkeys(first["roles"], 0.0)}
    return cues, prior | {s: dict(p) for s, p in (first["section_prior"] or {}).items()}


def save_kb(kb: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kb.write.mode(mode).json(path)


def load_kb(spark: SparkSession, path: str) -> DataFrame:
    """A saved knowledge base; missing depths are 3, missing lists empty."""
    empty = F.array().cast("array<string>")
    kb = spark.read.schema(KB).json(path)
    return kb.withColumns({"aliases": F.coalesce("aliases", empty), "parents": F.coalesce("parents", empty), "depth": F.coalesce("depth", F.lit(3))})


def kb_lookup(surfaces: DataFrame, index: DataFrame) -> DataFrame:
    """``surfaces`` with the ``entry_id, depth`` of their lemma key, null where the index has none."""
    return surfaces.withColumn("key", lemma_key(F.col("surface"))).join(index.select("key", "entry_id", "depth"), "key", "left")


def kb_prune(kb: DataFrame, negative: DataFrame, least: int = 0) -> DataFrame:
    """Entries whose label isn't a negative term and whose depth is at least ``least``."""
    keyed = kb.where(F.col("depth") >= least).withColumn("__key", lemma_key(F.col("label")))
    return keyed.join(negative.select(F.col("term").alias("__key")), "__key", "left_anti").drop("__key")


def write_results(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested JSON lines, one document a row, and beside them a flat table of tab-separated text."""
    cols = [c for c in found.columns if c != "doc_id"]
    found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in cols if c != "start"]))).alias("mentions")).write.mode(mode).json(f"{path}/results")
    flat = [c for c in ("doc_id", "start", "end", "surface", "type", "role", "section", "confidence", "canonical_id") if c in found.columns]
    found.select(*flat).write.mode(mode).option("sep", "\t").option("header", True).csv(f"{path}/mentions")


def append_new(new: DataFrame, path: str, spark: SparkSession) -> None:
    """Documents whose id isn't stored yet, by year: an incremental load that can be run again."""
    from pyspark.errors import AnalysisException

    try:
        seen = spark.read.parquet(path).select("doc_id")
    except AnalysisException as e:  # a store that is there but can't be read is an error
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        new = new.join(seen, "doc_id", "left_anti")
    new.withColumn("year", F.left("metadata.date", F.lit(4))).write.mode("append").partitionBy("year").parquet(path)


def refuse_overwrite(new: DataFrame, annotated: DataFrame) -> None:
    """Stop if any annotated document would be replaced."""
    clash = new.join(annotated.select("doc_id").distinct(), "doc_id", "left_semi").count()
    if clash:
        raise ValueError(f"{clash} of the documents to write are annotated")


# --- feeds, pages, patents ------------------------------------------------------------------------

FEED_ENTRY = "id STRING, title STRING, summary STRING, published STRING, updated STRING, category ARRAY<STRUCT<_term: STRING>>"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: ``id, title, abstract, published, updated, categories, url``."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(FEED_ENTRY).load(path)
    return entries.select(
        F.regexp_extract("id", r"abs/(.+?)(v[0-9]+)?$", 1).alias("id"), collapse_space(F.col("title")).alias("title"), collapse_space(F.col("summary")).alias("abstract"),
        "published", "updated", F.transform("category", lambda c: c["_term"]).alias("categories"), F.col("id").alias("url"),
    )


def papers(entries: DataFrame) -> DataFrame:
    """``doc_id, genre, text, title_end, date, raw_sha256``: title and abstract as one normalised text."""
    raw = F.concat_ws("\n\n", "title", "abstract")
    text = normalise(raw)
    return entries.select(F.col("id").alias("doc_id"), F.lit("paper").alias("genre"), text.alias("text"), F.length(normalise(F.col("title"))).alias("title_end"), F.left("published", F.lit(10)).alias("date"), F.sha2(raw, 256).alias("raw_sha256"))


def clean_html(html):
    """The text of markup: scripts, styles and tags cut, the five named entities resolved, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return collapse_space(x)


def patent_pages(pages: DataFrame) -> DataFrame:
    """``page_id, title, abstract, claims, description, date`` from pages that mark sections by ``itemprop``."""
    part = lambda name: clean_html(F.regexp_extract("html", rf'(?is)<section[^>]*itemprop="{name}"[^>]*>(.*?)</section>', 1))
    meta = lambda name: F.regexp_extract("html", rf'(?is)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1)
    label = lambda c, name: F.regexp_replace(c, rf"(?i)^{name}\s*", "")
    return pages.select("page_id", meta(r"DC\.title").alias("title"), label(part("abstract"), "abstract").alias("abstract"), label(part("claims"), r"claims?(\s*\([0-9]+\))?").alias("claims"), label(part("description"), "description").alias("description"), meta(r"DC\.date").alias("date"))


def patents(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` and the bounds of the four fields: running lengths, one joiner between fields."""
    fields = ["title", "abstract", "claims", "description"]
    clean = rows.select(F.col("page_id").alias("doc_id"), *[normalise(F.coalesce(c, F.lit(""))).alias(c) for c in fields])
    clean = clean.withColumn("claims", F.regexp_replace("claims", r"(?i)^(what is claimed is|we claim|i claim)\s*:?\s*", ""))
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in fields])
    out, at = clean.withColumn("text", text), F.lit(0)
    for c in fields:
        n = F.length(c)
        out = out.withColumns({f"{c}_start": at, f"{c}_end": at + n})
        at = F.when(n > 0, at + n + 1).otherwise(at)
    return out.drop(*fields)


def patent_frame(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The columns of a patent table that the engine needs, dated and titled rows only; pushed to the scan."""
    cols = ["application_number", "filing_date", "publication_number", "earliest_pgpub_number", "invention_title", "main_cpc_label", "cpc_labels"]
    rows = spark.read.parquet(path).select(*cols).where("application_number IS NOT NULL AND invention_title IS NOT NULL AND filing_date IS NOT NULL")
    return rows.limit(limit) if limit is not None else rows


# --- knowledge bases ------------------------------------------------------------------------------


def parse_triples(triples: DataFrame) -> DataFrame:
    """``s, p, o`` of subject, predicate and object: what follows ``/topics/``, blanks for underscores in labels."""
    topic = lambda c: F.regexp_replace(F.regexp_extract(c, r"/topics/([^>\"]+)", 1), ">$", "")
    predicate = F.regexp_extract("predicate", r"([A-Za-z]+)>?$", 1)
    return triples.select(topic("subject").alias("s"), predicate.alias("p"), topic("object").alias("o"))


def compile_kb(parsed: DataFrame, root: str, max_depth: int = 6) -> DataFrame:
    """``id, label, aliases, parents, depth``: equivalents become aliases of the preferred topic."""
    nodes = parsed.select(F.explode(F.array("s", "o")).alias("id")).where("id <> ''").distinct()
    preferred = parsed.where("p = 'preferentialEquivalent'").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("main"))
    equal = parsed.where("p IN ('relatedEquivalent', 'preferentialEquivalent')").select(F.explode(F.array(F.struct(F.col("s").alias("id"), F.col("o").alias("alias")), F.struct(F.col("o").alias("id"), F.col("s").alias("alias")))).alias("x")).select("x.*")
    labels = parsed.where("p = 'label'").select(F.col("s").alias("id"), F.col("o").alias("alias"))
    names = equal.unionByName(labels).where("id <> alias").groupBy("id").agg(F.array_sort(F.collect_set(F.replace("alias", F.lit("_"), F.lit(" ")))).alias("aliases"))
    parents = parsed.where("p = 'superTopicOf'").groupBy(F.col("o").alias("id")).agg(F.array_sort(F.collect_set("s")).alias("parents"))
    out = nodes.join(preferred, "id", "left").where("main IS NULL").join(names, "id", "left").join(parents, "id", "left").join(depths(parsed, root, max_depth), "id", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", F.replace("id", F.lit("_"), F.lit(" ")).alias("label"), F.coalesce("aliases", empty).alias("aliases"), F.coalesce("parents", empty).alias("parents"), F.coalesce("depth", F.lit(max_depth)).alias("depth"))


def depths(parsed: DataFrame, root: str, max_depth: int = 6) -> DataFrame:
    """``id, depth``: steps from the root along super-topics, a level at a time, at most ``max_depth``."""
    edges = parsed.where("p = 'superTopicOf'").select("s", "o").distinct()
    spark = parsed.sparkSession
    seen = spark.createDataFrame([(root, 0)], "id string, depth int")
    level = seen
    for step in range(1, max_depth + 1):
        level = level.join(edges, level["id"] == edges["s"]).select(F.col("o").alias("id"), F.lit(step).alias("depth")).distinct()
        seen = seen.unionByName(level)
    return seen.groupBy("id").agg(F.min("depth").alias("depth"))


def surface_index(kb: DataFrame, negative: DataFrame | None = None, min_chars: int = 3) -> DataFrame:
    """``key, entry_id, depth``: lemma keys of labels and aliases; the shallowest entry, then the first id, has a key."""
    forms = kb.select("id", "depth", F.explode(F.array_union(F.array("label"), "aliases")).alias("form"))
    keyed = forms.select(lemma_key(F.col("form")).alias("key"), F.col("id").alias("entry_id"), "depth").where(F.length("key") >= min_chars)
    if negative is not None:
        keyed = keyed.join(negative.select(F.col("term").alias("key")), "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy("depth", "entry_id"))
    return keyed.withColumn("rank", first).where("rank = 1").drop("rank")


def kb_table(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """Entries of tab-separated text: id, label, aliases parted by ``|``, optionally a year."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    c = F.split("value", "\t")
    aliases = F.filter(F.split(F.coalesce(F.get(c, F.lit(2)), F.lit("")), r"\|"), lambda a: a != "")
    return lines.where(F.size(c) >= 2).select(F.get(c, F.lit(0)).alias("id"), F.get(c, F.lit(1)).alias("label"), aliases.alias("aliases"), F.lit(depth).alias("depth"), F.get(c, F.lit(3)).try_cast("int").alias("attested_from"))
