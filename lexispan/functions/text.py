"""Scalar text functions as Column expressions, each with the same expression for DuckDB.

Offsets count Unicode code points. Patterns spell their character classes out, since classes
such as ``\\s`` differ between regex engines. A null gives null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DETERMINERS, IRREGULAR, ORTHOGRAPHIC, SINGULAR_IN_S

#: White space as Unicode has it, and the separators U+001C to U+001F.
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FOLD_FROM = "‐‑‒–—―−‘’‚‛“”„      ​‌‍﻿­"
_FOLD_TO = "-------''''\"\"\"      "
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"
_HYPHEN = r"([a-z])-[ \t\x0B\f\r]*\n[ \t\n\x0B\f\r]*([a-z])"
_BRACKETS = r"\[[ \t\n]*[0-9]+([ \t\n]*[,–-][ \t\n]*[0-9]+)*[ \t\n]*\]"
_AUTHORS = r"\(([A-Z][A-Za-z'`-]+([ \t\n]+(et[ \t\n]+al\.?|and|&|,)[ \t\n]*)*)+,?[ \t\n]*[0-9]{4}[a-z]?([ \t\n]*;[ \t\n]*[^()]{0,80}?[0-9]{4}[a-z]?)*\)"
_EDGE = " \t\n.,;:()[]{}\"'"


def q(s: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + s.replace("'", "''") + "'"


def fold_characters(x: Column) -> Column:
    """Ligatures spread out, dashes, quotes and spaces folded, control and zero-width characters dropped."""
    for glyph, plain in _LIGATURES.items():
        x = F.replace(x, F.lit(glyph), F.lit(plain))
    return F.regexp_replace(F.translate(x, _FOLD_FROM, _FOLD_TO), _CONTROL, "")


def fold_characters_sql(x: str) -> str:
    for glyph, plain in _LIGATURES.items():
        x = f"replace({x}, {q(glyph)}, {q(plain)})"
    return f"regexp_replace(translate({x}, {q(_FOLD_FROM)}, {q(_FOLD_TO)}), {q(_CONTROL)}, '', 'g')"


def dehyphenate(x: Column) -> Column:
    """Words parted by a hyphen and a line break, joined if both sides are lower case."""
    return F.regexp_replace(x, _HYPHEN, "$1$2")


def dehyphenate_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(_HYPHEN)}, '\\1\\2', 'g')"


def mask_citations(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, _BRACKETS, " "), _AUTHORS, " ")


def mask_citations_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(_BRACKETS)}, ' ', 'g'), {q(_AUTHORS)}, ' ', 'g')"


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def collapse_space_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(SPACE + '+')}, ' ', 'g'), ' ')"


def normalise(x: Column) -> Column:
    """The text all operators work on: folded, de-hyphenated, without citations, single-spaced."""
    return collapse_space(mask_citations(dehyphenate(fold_characters(x))))


def normalise_sql(x: str) -> str:
    return collapse_space_sql(mask_citations_sql(dehyphenate_sql(fold_characters_sql(x))))


_DET = r"(?i)^(" + "|".join(DETERMINERS) + r")[ \t\n\x0B\f\r]+"


def strip_determiner(x: Column) -> Column:
    return F.regexp_replace(x, _DET, "")


def strip_determiner_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(_DET)}, '')"


def depluralize(w: Column) -> Column:
    """The singular of one lower-case word; protected, irregular and short words first."""
    irregular = F.create_map(*[F.lit(s) for pair in IRREGULAR.items() for s in pair])
    n = F.length(w)
    return (
        F.when((n <= 3) | ~w.rlike(r"^\p{L}+$") | w.isin(SINGULAR_IN_S), w)
        .when(w.isin(list(IRREGULAR)), F.try_element_at(irregular, w))
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.rlike("[sxzh]es$"), F.left(w, n - 2))
        .when(w.endswith("s"), F.left(w, n - 1))
        .otherwise(w)
    )


def depluralize_sql(w: str) -> str:
    names = lambda words: "(" + ", ".join(map(q, words)) + ")"
    irregular = " ".join(f"WHEN {w} = {q(a)} THEN {q(b)}" for a, b in IRREGULAR.items())
    return (
        f"CASE WHEN length({w}) <= 3 OR NOT regexp_matches({w}, '^\\p{{L}}+$') OR {w} IN {names(SINGULAR_IN_S)} THEN {w} {irregular} "
        f"WHEN regexp_matches({w}, '(ss|us|is)$') THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, (length({w}) - 3)::INT) || 'y' "
        f"WHEN regexp_matches({w}, '[sxzh]es$') THEN left({w}, (length({w}) - 2)::INT) WHEN {w} LIKE '%s' THEN left({w}, (length({w}) - 1)::INT) ELSE {w} END"
    )


def lemma_key(x: Column) -> Column:
    """The key under which surfaces of one term meet: lower case, no determiner, last token singular."""
    flat = F.btrim(F.regexp_replace(strip_determiner(F.lower(x)), SPACE + "+", " "), F.lit(_EDGE))
    whole = lambda f: _once(F.regexp_extract(f, r"[^ ]*$", 0), lambda last: F.concat(F.left(f, F.length(f) - F.length(last)), depluralize(last)))
    return _once(flat, whole)


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def lemma_key_sql(x: str) -> str:
    flat = f"trim(regexp_replace({strip_determiner_sql(f'lower({x})')}, {q(SPACE + '+')}, ' ', 'g'), {q(_EDGE)})"
    last = f"regexp_extract({flat}, '[^ ]*$', 0)"
    return f"left({flat}, (length({flat}) - length({last}))::INT) || {depluralize_sql(last)}"


def orthographic(x: Column) -> Column:
    """The greatest weight of the orthographic patterns that the surface has, else 0."""
    return F.greatest(F.lit(0.0), *[F.when(x.rlike(p), F.lit(w)).otherwise(0.0) for _, p, w in ORTHOGRAPHIC])


def orthographic_sql(x: str) -> str:
    return "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN regexp_matches({x}, {q(p)}) THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for _, p, w in ORTHOGRAPHIC) + ")"


_TRIM = " \t\n\r\"'`.,;:()[]{}<>*"


def trimmed_bounds(surface: Column) -> tuple[Column, Column]:
    """Characters to cut on the left and to keep after that: edges trimmed, an unclosed late bracket cut.

    If the trimmed surface has more opening than closing round brackets and the last opening
    one is in its second half, it ends there and is trimmed again on the right.
    """
    lead = F.length(surface) - F.length(F.ltrim(surface, F.lit(_TRIM)))
    core = F.btrim(surface, F.lit(_TRIM))
    opens = F.length(core) - F.length(F.replace(core, F.lit("("), F.lit("")))
    closes = F.length(core) - F.length(F.replace(core, F.lit(")"), F.lit("")))
    last = F.length(core) - F.instr(F.reverse(core), "(")
    cut = F.rtrim(F.left(core, last), F.lit(_TRIM))
    return lead, F.length(F.when((opens > closes) & (last * 2 > F.length(core)), cut).otherwise(core))


def content_hash(doc_id: Column, start: Column, end: Column, surface: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\0", doc_id.cast("string"), start.cast("string"), end.cast("string"), surface), 256), F.lit(16))


def stable_id(x: Column) -> Column:
    return F.left(F.sha1(x), F.lit(10))


def year_of(date: Column) -> Column:
    """The year of an ISO date, or null."""
    return F.when(date.rlike("^[0-9]{4}"), F.left(date, F.lit(4)).cast("int"))


def is_short_form(x: Column) -> Column:
    """Two to ten characters, no blank, an alphanumeric first, an upper-case letter."""
    return F.length(x).between(2, 10) & ~x.contains(" ") & x.rlike(r"^[\p{L}\p{N}]") & x.rlike(r"\p{Lu}")


IS_SHORT_FORM_SQL = r"(length({0}) BETWEEN 2 AND 10 AND NOT contains({0}, ' ') AND regexp_matches({0}, '^[\p{{L}}\p{{N}}]') AND regexp_matches({0}, '\p{{Lu}}'))"


def squash(x: Column) -> Column:
    return F.tanh(x / 8.0)


def sigmoid(z: Column) -> Column:
    """The logistic function, without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def decay(distance: Column, window: float) -> Column:
    """Full weight at a mention, a quarter from the window's edge on."""
    return F.when(distance >= window, F.lit(0.25)).otherwise(1.0 - 0.75 * distance / F.lit(float(window)))


def winner_probability(scores: Column) -> Column:
    """The softmax probability of the greatest score of an array."""
    best = F.array_max(scores)
    return 1.0 / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - best))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def json_object(reply: Column) -> Column:
    """The JSON text in a model's reply: fenced, else the whole, else from the outermost brackets; a list becomes ``items``."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    brackets = F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit(""))
    bare = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & bare(c).rlike(r"^[\{\[]"), bare(c))
    found = F.coalesce(ok(fenced), ok(reply), ok(braces), ok(brackets))
    return F.when(found.startswith("["), F.concat(F.lit('{"items":'), found, F.lit("}"))).otherwise(found)
