"""Line dedup by a log-template tree, in DataFrame operations only.

A line's path in the tree is its token count and its leading tokens, digits generalised. In its
leaf a token is rated by the number of the leaf's distinct texts that have it at the same
place, in powers of two; a line's templates keep the tokens of one rating and better and
generalise the rest. A template that ``m`` texts share keeps its fixed tokens (``m`` texts or
more have them) apart from field values of up to ``m / 2`` texts at the power of two between,
at every size of the leaf, however often values recur and whatever else the leaf holds. A
template needs a share ``similarity`` of kept tokens, so two lines of one template agree in
that share of places at least; the whole line is a template too. A line of a template found
in two or more documents is dropped, but at the template's first place (smallest doc_id, then
line number) if ``keep_first``, so that a passage stays once in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, maybe_in, table

#: A token with a digit is a variable field. The look-behind keeps the scan linear on long tokens.
_FIELD = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*"
_GAP = r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]"
def _lines(docs: DataFrame) -> DataFrame:
    """Each line, trimmed, with single blanks between tokens and ``<*>`` for tokens with digits.

    A whole text is masked before it is split: no filter on a line can then repeat the masking.
    Plain searches tell which texts need a regex at all.
    """
    text = F.col("text")
    uneven = F.lit(False)
    for gap in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        uneven = uneven | text.contains(gap)
    flat = F.when(uneven, F.regexp_replace(F.regexp_replace(text, _GAP, " "), " ?\n ?", "\n")).otherwise(text)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(flat, _FIELD, "<*>")).otherwise(flat)
    split = F.split(F.trim(masked), "\n")
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.posexplode(split).alias("line_no", "masked")).where("masked <> ''")


def _n_tokens() -> Column:
    return F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1


def dropped_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.75, keep_first: bool = True) -> DataFrame:
    """One row for each line that goes: ``doc_id, key, line_no``.

    A path has ``depth`` tokens, or all but one of a shorter line. A line that may generalise
    no token (up to three at 0.75: one is more than a quarter) is its own and only template.
    Texts are told apart by 128 bits.
    """
    n = _n_tokens()
    need = F.ceil(n * F.lit(float(similarity))).cast("int")
    path = F.least(F.lit(depth), n - 1)
    leaf = F.when((need < n) & (n > 1), F.xxhash64(n, F.call_function("substring_index", F.col("masked"), F.lit(" "), path)))
    own = {"o1": F.xxhash64("masked"), "o2": F.xxhash64(F.lit(1), "masked")}
    lines = _lines(docs)
    slim = materialise(lines.select("doc_id", "key", "line_no", *[v.alias(k) for k, v in own.items()], leaf.alias("leaf")), "lines")
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line_no")
    # Leaves of several texts: only their lines are looked at token by token.
    wide = materialise(slim.where("leaf IS NOT NULL").groupBy("leaf").agg(F.min("o1").alias("x"), F.max("o1").alias("y")).where("x <> y").select("leaf"), "leaves")
    open_lines = lines.select("masked", leaf.alias("leaf"), n.alias("n"), need.alias("need"), path.alias("path")).where("leaf IS NOT NULL")
    # Equal texts meet before their shuffle; then the leaves that the bitmap let through by chance go.
    texts = maybe_in(open_lines, wide, "leaf", "open").where("open").drop("open").distinct().join(wide, "leaf", "left_semi")
    texts = materialise(texts.select("*", *[v.alias(k) for k, v in own.items()]), "texts")
    tokens = texts.select("leaf", "n", "need", "path", "o1", "o2", F.posexplode(F.split("masked", " ")).alias("at", "token")).where("at >= path")
    tokens = tokens.withColumn("cell", F.xxhash64("leaf", "at", "token"))
    rated = tokens.groupBy("cell").agg(F.count("*").alias("count")).where("count > 1")
    rated = materialise(rated.select("cell", F.length(F.bin("count")).alias("rating")), "cells")
    kept = maybe_in(tokens.drop("token"), rated, "cell", "some").where("some").join(rated, "cell")
    lists = kept.groupBy("o1", "o2", "leaf", "n", "need", "path").agg(F.sort_array(F.collect_list(F.struct("at", "cell", "rating"))).alias("cells"))
    lists = lists.where(F.size("cells") + F.col("path") >= F.col("need"))
    shape = lambda q: F.transform(F.filter("cells", lambda c: c["rating"] >= q), lambda c: F.struct(c["at"], c["cell"]))
    shapes = lists.select("*", F.explode(F.array_distinct(F.transform("cells", lambda c: c["rating"]))).alias("q")).withColumn("shape", shape(F.col("q")))
    size = F.size("shape") + F.col("path")
    general = shapes.where((size >= F.col("need")) & (size < F.col("n"))).select("o1", "o2", F.xxhash64("leaf", "shape").alias("t1"), F.xxhash64(F.lit(1), "shape", "leaf").alias("t2"))
    # Where the path alone is enough, the template that keeps nothing else.
    bare = texts.where("path >= need").select("o1", "o2", F.xxhash64("leaf").alias("t1"), F.xxhash64(F.lit(1), "leaf").alias("t2"))
    general = general.unionByName(bare)
    seen = materialise(slim.groupBy("o1", "o2").agg(F.min(place).alias("first"), F.max(who).alias("last")), "seen")
    several = F.struct("first.no_id", "first.doc_id", "first.key") != F.col("last")
    named = materialise(general.join(seen, ["o1", "o2"]), "named")
    recurring = named.groupBy("t1", "t2").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(several).select("t1", "t2", "first")
    drop = named.select("o1", "o2", "t1", "t2").join(recurring, ["t1", "t2"]).select("o1", "o2", "first")
    # A line isn't the first of all its templates if an earlier one leads any.
    drop = drop.unionByName(seen.where(several).select("o1", "o2", "first")).groupBy("o1", "o2").agg(F.min("first").alias("first"))
    gone = slim.join(drop, ["o1", "o2"])
    return (gone.where(F.col("first") != place) if keep_first else gone).select("doc_id", "key", "line_no")


def dedup_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.75, keep_first: bool = True) -> DataFrame:
    """``docs`` with lines of recurring templates cut from ``text``, plus ``n_lines`` and ``n_dropped``.

    Every row stays and other columns pass unchanged; ``n_chars``, if there, is the new length.
    A null text stays null with no lines; an empty text is one blank line; blank lines are
    never dropped. Rows that repeat doc_id and text count as one document. An empty table
    gives an empty table. Only documents that lose a line are shuffled with their texts.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), depth, similarity, keep_first)
    gone = gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone"))
    gone = materialise(gone.select(F.col("doc_id").alias("__ls_id"), F.col("key").alias("__ls_key"), F.col("gone").alias("__ls_gone")), "gone")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(*kept, F.xxhash64("doc_id", "text").alias("__ls_hash"))
    marked = maybe_in(left, gone.select(F.col("__ls_key").alias("__ls_hash")), "__ls_hash", "__ls_some")
    whole = marked.where("NOT __ls_some").withColumn("__ls_gone", F.lit(None).cast("array<int>"))
    some = marked.where("__ls_some").join(gone, (F.col("__ls_hash") == F.col("__ls_key")) & F.col("doc_id").eqNullSafe(F.col("__ls_id")), "left")
    every = whole.unionByName(some.drop("__ls_id", "__ls_key"))
    split = F.split("text", "\n")
    cut = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__ls_gone", i)), "\n")
    text = F.when(F.col("__ls_gone").isNotNull(), cut).otherwise(F.col("text"))
    new = {"text": text, "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)), "n_dropped": F.when(F.col("__ls_gone").isNull(), 0).otherwise(F.size("__ls_gone"))}
    out = every.select(*[new["text"].alias(c) if c == "text" else F.col(c) for c in kept], new["n_lines"].alias("n_lines"), new["n_dropped"].alias("n_dropped"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'),
         '[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS own, line
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), t AS (
  SELECT *, len(string_split(own, ' ')) AS n FROM lines WHERE own <> ''
), p AS (SELECT *, array_to_string(string_split(own, ' ')[1:least(3, n - 1)], ' ') AS head, least(3, n - 1) AS path, ceil(n * 0.75) AS need FROM t
), texts AS (SELECT DISTINCT n, head, path, need, own FROM p WHERE need < n AND n > 1
), tokens AS (
  SELECT * FROM (SELECT *, unnest(string_split(own, ' ')) AS token, unnest(range(n)) AS pos FROM texts) WHERE pos >= path
), cells AS (SELECT n, head, pos, token, length(bin(count(*))) AS rating FROM tokens GROUP BY ALL HAVING count(*) > 1
), kept AS (SELECT * FROM tokens JOIN cells USING (n, head, pos, token)
), ratings AS (SELECT DISTINCT n, head, own, rating AS q FROM kept
), general AS (
  SELECT DISTINCT n, head, own, string_agg(pos || ':' || token, ' ' ORDER BY pos) AS template
  FROM kept JOIN ratings USING (n, head, own) WHERE rating >= q GROUP BY n, head, own, path, need, q
  HAVING count(*) + path >= need AND count(*) + path < n
  UNION ALL SELECT n, head, own, '' FROM texts WHERE path >= need
), named AS (
  SELECT p.doc_id, line_no, p.n, p.head, 'o' || own AS template FROM p
  UNION ALL SELECT p.doc_id, line_no, p.n, p.head, 'g' || template FROM p JOIN general USING (n, head, own)
), recurring AS (
  SELECT n, head, template, min(struct_pack(d := doc_id, l := line_no)) AS first FROM named GROUP BY n, head, template HAVING min(doc_id) <> max(doc_id)
), firsts AS (SELECT doc_id, line_no, min(first) AS first FROM named JOIN recurring USING (n, head, template) GROUP BY doc_id, line_no
), flagged AS (
  SELECT lines.doc_id, lines.line_no, line, first IS NOT NULL AND first <> struct_pack(d := lines.doc_id, l := lines.line_no) AS dropped
  FROM lines LEFT JOIN firsts ON lines.doc_id = firsts.doc_id AND lines.line_no = firsts.line_no
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '') AS text,
       count(*)::INT AS n_lines, (count(*) FILTER (dropped))::INT AS n_dropped
FROM flagged GROUP BY doc_id
"""
