"""Tokens, sentences and sections with exact code-point offsets, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ABBREVIATIONS
from ..functions.text import q

TOKEN = "[A-Za-z][A-Za-z0-9/+-]*"


def pieces(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, pos, tok, start, end``: matches of a pattern that never matches nothing.

    Matches and the gaps between them are dealt with as one array, so running lengths give the
    offsets. Texts are dealt out by document once; the window over a document's matches then
    needs no further exchange.
    """
    return with_gaps(docs, pattern, text).where("tok IS NOT NULL").drop("gap")


def with_gaps(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, pos, tok, gap, start, end``: as :func:`pieces`, with the text before each match, and a last
    row without ``tok`` for the rest of the text, whose ``start`` and ``end`` are the text's length.

    What needs a text's length, or what stands between matches, finds it here and needn't join the texts again.
    The number of parts is given, so that Spark doesn't merge them: merged by the size of packed
    texts, one task would sort the many rows that these become.
    """
    dealt = docs.select("doc_id", F.col(text).alias("text")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 0).alias("tok"), F.split("text", pattern, -1).alias("gap"))
    rows = dealt.select("doc_id", F.posexplode(zipped).alias("pos", "z")).select("doc_id", "pos", "z.tok", "z.gap")
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n_tok = F.coalesce(F.length("tok"), F.lit(0))
    end = F.sum(F.length("gap") + n_tok).over(running).cast("int")
    return rows.select("doc_id", "pos", "tok", "gap", (end - n_tok).alias("start"), end.alias("end"))


def tokens(docs: DataFrame) -> DataFrame:
    return pieces(docs, TOKEN)


def pieces_sql(pattern: str, source: str = "documents") -> str:
    """A sub-select with the rows of :func:`pieces`."""
    return f"""(SELECT doc_id, pos, tok, ("end" - length(tok))::INT AS start, "end" FROM (
      SELECT doc_id, pos, tok, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS "end"
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(pattern)})) AS tok,
                   unnest(list_slice(string_split_regex(text, {q(pattern)}), 1, len(regexp_extract_all(text, {q(pattern)})))) AS gap,
                   unnest(range(len(regexp_extract_all(text, {q(pattern)})))) AS pos
            FROM {source})))"""


# --- sentences --------------------------------------------------------------------------------

#: The text up to a sentence's end, and what follows it: closing marks and white space belong to none.
_BOUNDARY = r"[.!?][\"')\]]*[ \t\n\x0B\f\r]+"
_BEFORE = r"[\p{L}\p{N}.-]*$"


def _false_break(prefix: Column) -> Column:
    """Whether the full stop that ends ``prefix`` is an abbreviation's, an initial's or a number's."""
    token = F.btrim(F.lower(F.regexp_extract(F.left(prefix, F.length(prefix) - 1), _BEFORE, 0)), F.lit("."))
    return prefix.endswith(".") & (token.isin(ABBREVIATIONS) | token.rlike(r"^\p{L}$") | token.rlike(r"^\p{N}+$"))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, start, end``: sentences that aren't blank, in order."""
    # The last gap has no boundary after it: it ends with the text. Nothing is joined with the texts again.
    last = F.col("tok").isNull()
    # What stands before a boundary's mark is in the gap: the boundary before ends with white space, which no abbreviation holds.
    prefix = F.concat(F.right("gap", F.lit(40)), F.left("tok", F.lit(1)))
    rows = with_gaps(docs, _BOUNDARY)
    cuts = rows.select("doc_id", "pos", (F.col("start") + F.when(last, 0).otherwise(1)).alias("stop"), F.col("end").alias("resume"), (last & ~F.col("gap").rlike(r"[^ \t\n\x0B\f\r]")).alias("blank"), (last | ~_false_break(prefix)).alias("real")).where("real")
    order = Window.partitionBy("doc_id").orderBy("pos")
    spans = cuts.select("doc_id", "pos", F.coalesce(F.lag("resume").over(order), F.lit(0)).alias("start"), F.col("stop").alias("end"), F.lag("pos").over(order).alias("before"), "blank")
    # Only the rest of a text can be blank, if no false break is in it: every other sentence has its mark.
    blank = F.col("blank") & (F.col("pos") - F.coalesce("before", F.lit(-1)) == 1)
    kept = spans.where((F.col("start") < F.col("end")) & ~blank)
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("sent_idx"), "start", "end")


def sentences_sql(source: str = "documents") -> str:
    names = "(" + ", ".join(map(q, ABBREVIATIONS)) + ")"
    token = f"trim(lower(regexp_extract(left(prefix, (length(prefix) - 1)::INT), {q(_BEFORE)}, 0)), '.')"
    return f"""(
      WITH cuts AS (
        SELECT p.doc_id, p.start AS stop, p."end" AS resume,
               substring(d.text, greatest(1, p.start - 39)::INT, least(41, p.start + 1)::INT) AS prefix
        FROM {pieces_sql(_BOUNDARY, source)} p JOIN {source} d USING (doc_id)
      ), ends AS (
        SELECT doc_id, stop + 1 AS stop, resume FROM cuts
        WHERE NOT (prefix LIKE '%.' AND ({token} IN {names} OR regexp_matches({token}, '^\\p{{L}}$') OR regexp_matches({token}, '^\\p{{N}}+$')))
        UNION ALL SELECT doc_id, length(text)::INT, length(text)::INT FROM {source} WHERE length(text) > 0
      ), spans AS (
        SELECT doc_id, coalesce(lag(resume) OVER (PARTITION BY doc_id ORDER BY stop, resume), 0) AS start, stop AS "end" FROM ends
      )
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS sent_idx, start::INT AS start, "end"::INT AS "end"
      FROM spans JOIN {source} USING (doc_id)
      WHERE start < "end" AND regexp_matches(substring(text, (start + 1)::INT, ("end" - start)::INT), '[^ \\t\\n\\x0B\\f\\r]'))"""


def sentence_of(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """``spans`` (doc_id, start, end) with the sentence that holds their start, else the nearest before it.

    Both sides are ordered together by offset and the last sentence seen is carried on: one
    pass over a document, where a range join would compare all pairs of a long one. Further
    columns of ``sents`` are carried along.
    """
    more = [c for c in sents.columns if c not in ("doc_id", "sent_idx", "start", "end")]
    marks = sents.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), "sent_idx", F.col("start").alias("ev_start"), F.col("end").alias("ev_end"), *more)
    asked = spans.withColumns({"at": F.col("start"), "side": F.lit(1)})
    both = asked.unionByName(marks, allowMissingColumns=True)
    last = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumns({c: F.last(c, ignorenulls=True).over(last) for c in ("sent_idx", "ev_start", "ev_end", *more)})
    return carried.where("side = 1").drop("at", "side")


# --- sections ---------------------------------------------------------------------------------

_CLAIM_START = r"(^|[ \t\n])[0-9]{1,3}[ \t\n]*\.[ \t\n]+[A-Z(]"
_DEPENDS = r"(?i)\b(of|in|according[ \t\n]+to|as[ \t\n]+(claimed|recited|set[ \t\n]+forth)[ \t\n]+in)[ \t\n]+(any[ \t\n]+(one[ \t\n]+)?of[ \t\n]+)?claims?[ \t\n]+([0-9]{1,3})"


def claims(docs: DataFrame) -> DataFrame:
    """``doc_id, ordinal, kind, start, end, claim_number, depends_on`` from numbered claims.

    A claim runs to the next number; one that refers back to another is dependent.
    """
    bare = F.ltrim("tok", F.lit(" \t\n"))
    blank = F.coalesce(F.length("tok") - F.length(bare), F.lit(0))
    starts = with_gaps(docs, _CLAIM_START).select("doc_id", "pos", "tok", (F.col("start") + blank).alias("start"), bare.alias("bare"), F.concat("gap", F.coalesce(F.left("tok", blank), F.lit(""))).alias("gap"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    # A claim is its number and what stands before the next: the row after it begins where it ends.
    found = starts.withColumns({"end": F.lead("start").over(order), "after": F.lead("gap").over(order), "ordinal": F.row_number().over(order) - 1}).where("tok IS NOT NULL")
    depends = F.regexp_extract(F.concat("bare", "after"), _DEPENDS, 5)
    depends = F.when(depends != "", depends.cast("int"))
    kind = F.when(depends.isNull(), "claim_independent").otherwise("claim_dependent")
    return found.select("doc_id", "ordinal", kind.alias("kind"), "start", "end", F.regexp_extract("tok", "([0-9]{1,3})", 1).cast("int").alias("claim_number"), depends.alias("depends_on"))


def claims_sql(source: str) -> str:
    body = "substring(text, (start + 1)::INT, (coalesce(next, length(text)) - start)::INT)"
    depends = f"nullif(regexp_extract({body}, {q(_DEPENDS)}, 5), '')::INT"
    return f"""(
      WITH s AS (SELECT doc_id, (start + length(tok) - length(ltrim(tok, ' \t\n')))::INT AS start, regexp_extract(tok, '([0-9]{{1,3}})', 1)::INT AS claim_number
                 FROM {pieces_sql(_CLAIM_START, source)}),
      f AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS ordinal FROM s)
      SELECT doc_id, ordinal, CASE WHEN {depends} IS NULL THEN 'claim_independent' ELSE 'claim_dependent' END AS kind, start,
             coalesce(next, length(text))::INT AS "end", claim_number, {depends} AS depends_on
      FROM f JOIN {source} USING (doc_id))"""


#: (kind, pattern) tried in order on a heading of capitalised words, with an optional number before it.
PAPER_HEADINGS = (
    ("abstract", r"(?i)^abstract\b"),
    ("introduction", r"(?i)^introduction\b"),
    ("related_work", r"(?i)^(related work|background|prior art|literature)\b"),
    ("method", r"(?i)^(method|methodology|approach|model|architecture|proposed|our |system design|framework)\b"),
    ("experiment", r"(?i)^(experiment|experimental setup|evaluation|setup|dataset)\b"),
    ("results", r"(?i)^(result|finding|analysis|discussion|ablation)\b"),
    ("conclusion", r"(?i)^(conclusion|future work|summary)\b"),
)
PATENT_HEADINGS = (
    ("patent_field", r"(?i)^(technical )?field( of (the )?(invention|disclosure|technology))?$"),
    ("patent_background", r"(?i)^(background|description of (the )?(related|prior) art|prior art)"),
    ("patent_summary", r"(?i)^(brief )?summary( of (the )?invention)?"),
    ("patent_detail", r"(?i)^(detailed description|description of (the )?(preferred|embodiment))"),
)
_PAPER_MARK = r"(^|[. \t\n])([0-9]+(\.[0-9]+)*\.?[ \t\n]+)?[A-Z][A-Za-z ]{2,40}"
_PATENT_MARK = r"[A-Z]{5,}([ ][A-Z]{2,}){0,6}"


def heading_sections(docs: DataFrame, family: str = "paper") -> DataFrame:
    """``doc_id, ordinal, kind, start, end, heading``: from each known heading to the next; none: all is ``other``."""
    mark, headings = (_PAPER_MARK, PAPER_HEADINGS) if family == "paper" else (_PATENT_MARK, PATENT_HEADINGS)
    found = with_gaps(docs, mark)
    # A mark that begins inside a word's blank starts at its first letter or number.
    lead = F.length("tok") - F.length(F.regexp_replace("tok", "^[. \t\n]", ""))
    heading = F.trim(F.regexp_replace("tok", r"^[. \t\n]?([0-9]+(\.[0-9]+)*\.?[ \t\n]+)?", ""))
    kind = F.coalesce(*[F.when(heading.rlike(p), F.lit(k)) for k, p in headings])
    marks = found.select("doc_id", "pos", F.col("tok").isNull().alias("rest"), (F.col("start") + F.coalesce(lead, F.lit(0))).alias("start"), kind.alias("kind"), heading.alias("heading")).where("kind IS NOT NULL OR rest")
    order = Window.partitionBy("doc_id").orderBy("pos")
    # The row of the rest ends the last section; where no heading stands before it, it is the whole text.
    spans = marks.withColumns({"next": F.lead("start").over(order), "before": F.lag("pos").over(order)}).where("NOT rest OR (before IS NULL AND start > 0)")
    either = lambda whole, own: F.when(F.col("rest"), whole).otherwise(own)
    return spans.select(
        "doc_id", (F.row_number().over(order) - 1).alias("ordinal"), either(F.lit("other"), F.col("kind")).alias("kind"), either(F.lit(0), F.col("start")).alias("start"),
        either(F.col("start"), F.col("next")).alias("end"), either(F.lit(""), F.col("heading")).alias("heading"),
    )


def heading_sections_sql(source: str, family: str = "paper") -> str:
    mark, headings = (_PAPER_MARK, PAPER_HEADINGS) if family == "paper" else (_PATENT_MARK, PATENT_HEADINGS)
    heading = r"trim(regexp_replace(tok, '^[. \t\n]?([0-9]+(\.[0-9]+)*\.?[ \t\n]+)?', ''), ' ')"
    kind = "CASE " + " ".join(f"WHEN regexp_matches({heading}, {q(p)}) THEN {q(k)}" for k, p in headings) + " END"
    return f"""(
      WITH m AS (SELECT doc_id, (start + length(tok) - length(regexp_replace(tok, '^[. \\t\\n]', '')))::INT AS start, {kind} AS kind, {heading} AS heading
                 FROM {pieces_sql(mark, source)}),
      k AS (SELECT * FROM m WHERE kind IS NOT NULL),
      e AS (SELECT k.doc_id, start, kind, heading, coalesce(lead(start) OVER (PARTITION BY k.doc_id ORDER BY start), length(text))::INT AS "end"
            FROM k JOIN {source} USING (doc_id)
            UNION ALL SELECT doc_id, 0, 'other', '', length(text)::INT FROM {source} WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM k))
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS ordinal, kind, start, "end", heading FROM e)"""


def clamp_sections(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Sections cut to their text and numbered by place; those that begin past its end go."""
    sized = docs.select("doc_id", F.length("text").alias("n"))
    kept = sections.join(sized, "doc_id").withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "n")}).where("start < end")
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "kind")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("ordinal"), "kind", "start", "end")


def paper_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, ordinal, kind, start, end`` of papers: title and abstract by their given ends (``title_end, abstract_end``), then headings of the body."""
    title = docs.select("doc_id", F.lit("title").alias("kind"), F.lit(0).alias("start"), F.col("title_end").alias("end"))
    abstract = docs.select("doc_id", F.lit("abstract").alias("kind"), F.col("title_end").alias("start"), F.col("abstract_end").alias("end"))
    body = docs.select("doc_id", F.expr("substring(text, abstract_end + 1)").alias("text"), F.col("abstract_end").alias("shift")).where("length(text) > 0")
    own = heading_sections(body.select("doc_id", "text")).join(body.select("doc_id", "shift"), "doc_id")
    own = own.select("doc_id", "kind", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
    return clamp_sections(title.unionByName(abstract).unionByName(own), docs)


def patent_sections(docs: DataFrame) -> DataFrame:
    """Sections of patents with the bounds of their four fields (``title_start, title_end, ...``): claims one by one, the description by its headings."""
    plain = None
    for kind in ("title", "abstract"):
        part = docs.select("doc_id", F.lit(kind).alias("kind"), F.col(f"{kind}_start").alias("start"), F.col(f"{kind}_end").alias("end"))
        plain = part if plain is None else plain.unionByName(part)
    inside = lambda f: docs.select("doc_id", F.expr(f"substring(text, {f}_start + 1, {f}_end - {f}_start)").alias("text"), F.col(f"{f}_start").alias("shift")).where("length(text) > 0")
    for field_, found in (("claims", claims), ("description", lambda d: heading_sections(d, "patent"))):
        part = inside(field_)
        own = found(part.select("doc_id", "text")).join(part.select("doc_id", "shift"), "doc_id")
        plain = plain.unionByName(own.select("doc_id", "kind", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end")))
    return clamp_sections(plain, docs)


def section_at(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """``spans`` with the kind of the first section that covers their start, else ``other``."""
    s = sections.select(F.col("doc_id").alias("sd"), F.col("start").alias("ss"), F.col("end").alias("se"), F.col("kind").alias("sk"), F.col("ordinal").alias("so"))
    hit = spans.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("ss") <= F.col("start")) & (F.col("start") < F.col("se")), "left")
    return hit.groupBy(*spans.columns).agg(F.coalesce(F.min_by("sk", "so"), F.lit("other")).alias("section"))


def merge_zones(zones: DataFrame) -> DataFrame:
    """``doc_id, lo, hi``: intervals merged where one begins at most one past another's end."""
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    top = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col("lo") > top + 1), 1).otherwise(0)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return zones.withColumn("new", new).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def merge_zones_sql(source: str) -> str:
    return f"""(SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM (
      SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN coalesce(lo > max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) THEN 1 ELSE 0 END AS new
        FROM {source})) GROUP BY doc_id, island)"""
