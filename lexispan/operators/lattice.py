"""Phrase candidates from parsed chunks: a lattice of sub-spans over a token table with parts of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import VAGUE_MODIFIERS
from ..functions.text import orthographic

VARIANTS = 10
RIGHT_ENDS = 2
MOST_TOKENS = 6
_NOUNS = ("NOUN", "PROPN")


def chunk_candidates(tokens: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``doc_id, chunk, start, end, surface, n_tokens, orthographic, head_is_tech``.

    ``tokens`` has ``doc_id, chunk, pos, tok, tag, start, end``: the tokens of noun chunks from any
    parser. Chunks whose last token is a noun count. Leading vague modifiers and numbers are
    skipped; then every left end meets the chunk's end and, before it, up to ``RIGHT_ENDS`` others
    that are nouns, longest first, up to ``VARIANTS`` spans of up to ``MOST_TOKENS`` tokens. The
    parts around a coordination, each of them with a noun at its end, are candidates as well.
    """
    item = F.struct("pos", "tok", "tag", "start", "end")
    chunks = tokens.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("t"))
    chunks = chunks.where(F.element_at("t", -1)["tag"].isin(*_NOUNS))
    skip = F.expr(f"aggregate(t, struct(0 AS n, true AS on), (a, x) -> struct(a.n + CAST(a.on AND ({_vague()}) AS INT) AS n, a.on AND ({_vague()}) AS on)).n")
    chunks = chunks.withColumn("t", F.slice("t", skip + 1, F.greatest(F.size("t") - skip, F.lit(0)))).where("size(t) > 0")
    nouns = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["tag"].isin(*_NOUNS))
    rights = F.slice(F.reverse(nouns), F.lit(1), F.lit(RIGHT_ENDS + 1))
    each = chunks.select("doc_id", "chunk", "t", F.posexplode(rights).alias("turn", "r"))
    each = each.select("doc_id", "chunk", "t", "turn", "r", F.explode(F.sequence(F.lit(1), F.col("r"))).alias("l")).where(F.col("r") - F.col("l") < MOST_TOKENS)
    order = Window.partitionBy("doc_id", "chunk").orderBy("turn", "l")
    lattice = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= VARIANTS).select("doc_id", "chunk", "t", "l", "r")
    # Conjuncts: runs between "and"s and "or"s.
    joints = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.lower(F.element_at("t", i)["tok"]).isin("and", "or", "and/or"))
    cut = chunks.where(F.size(joints) > 0).withColumn("j", F.concat(F.array(F.lit(0)), joints, F.array(F.size("t") + 1)))
    runs = cut.select("doc_id", "chunk", "t", F.explode(F.transform(F.sequence(F.lit(1), F.size("j") - 1), lambda i: F.struct((F.element_at("j", i) + 1).alias("l"), (F.element_at("j", i + 1) - 1).alias("r")))).alias("x")).select("doc_id", "chunk", "t", "x.l", "x.r")
    runs = runs.where(F.col("l") <= F.col("r")).where(F.element_at("t", F.col("r"))["tag"].isin(*_NOUNS) & (F.col("r") - F.col("l") < MOST_TOKENS))
    every = lattice.unionByName(runs).dropDuplicates(["doc_id", "chunk", "l", "r"])
    part = F.slice("t", F.col("l"), F.col("r") - F.col("l") + 1)
    out = every.select(
        "doc_id", "chunk", F.element_at("t", F.col("l"))["start"].alias("start"), F.element_at("t", F.col("r"))["end"].alias("end"),
        F.array_join(F.transform(part, lambda x: x["tok"]), " ").alias("surface"), (F.col("r") - F.col("l") + 1).alias("n_tokens"), F.lower(F.element_at("t", F.col("r"))["tok"]).alias("word"),
    )
    out = out.withColumn("orthographic", orthographic(F.col("surface")))
    if heads is None:
        return out.withColumn("head_is_tech", F.lit(False)).drop("word")
    listed = heads.select("word", F.lit(True).alias("listed")).distinct()
    return out.join(listed, "word", "left").withColumn("head_is_tech", F.coalesce("listed", F.lit(False))).drop("word", "listed")


def _vague() -> str:
    words = ", ".join(f"'{w}'" for w in VAGUE_MODIFIERS)
    return f"lower(x.tok) IN ({words}) OR x.tag = 'NUM' OR x.tok RLIKE '^[0-9]+$'"
