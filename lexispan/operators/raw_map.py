"""Normalised text with the place in the raw text that each of its characters comes from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def edited(text: str, at: np.ndarray, edits: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """``text`` and its map after replacements (start, end, new) in order of place; of overlapping ones the first counts.

    A replacement's characters come from the replaced ones in turn, those beyond from its first.
    """
    parts, maps, done = [], [], 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        if start < done:
            continue
        own = start + np.arange(len(new))
        own[own >= end] = start
        parts += [text[done:start], new]
        maps += [at[done:start], at[own] if len(new) else at[:0]]
        done = end
    return "".join([*parts, text[done:]]), np.concatenate([*maps, at[done:]])


def _java(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


_FOLD = dict(zip(T._FOLD_FROM, T._FOLD_TO, strict=False)) | {c: "" for c in T._FOLD_FROM[len(T._FOLD_TO) :]} | T._LIGATURES
_STEPS = (
    (re.compile("|".join(map(re.escape, _FOLD))), lambda m: _FOLD[m[0]]),
    (_java(T._CONTROL), lambda m: ""),
    (_java(T._HYPHEN), lambda m: m[1] + m[2]),
    (_java(T._BRACKETS), lambda m: " "),
    (_java(T._AUTHORS), lambda m: " "),
    (_java(T.SPACE + "+"), lambda m: " "),
)


def normalised(raw: str) -> tuple[str, np.ndarray]:
    """What :func:`lexispan.functions.text.normalise` gives, with the map to the raw text."""
    text, at = raw, np.arange(len(raw))
    for pattern, new in _STEPS:
        edits = []
        for m in pattern.finditer(text):
            if m.re is _STEPS[2][0]:  # only what stands between the two letters goes
                edits.append((m.end(1), m.start(2), ""))
            else:
                edits.append((*m.span(), new(m)))
        text, at = edited(text, at, edits)
    lead, kept = len(text) - len(text.lstrip(" ")), text.strip(" ")
    return kept, at[lead : lead + len(kept)]


def with_raw_index(docs: DataFrame) -> DataFrame:
    """``doc_id, raw, text, raw_index`` of raw ``doc_id, text``; a null text counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [normalised(t or "") for t in frame["raw"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "raw": frame["raw"], "text": [t for t, _ in found], "raw_index": [a.astype("int32") for _, a in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).mapInPandas(run, f"doc_id {kind}, raw string, text string, raw_index array<int>")


def raw_span(index: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The raw span of a normalised one, at least one character; an empty text has 0 to 0."""
    n = F.size(index)
    lo = F.when(n > 0, F.get(index, F.least(start, n - 1))).otherwise(0)
    hi = F.when(n > 0, F.get(index, F.least(F.greatest(end - 1, F.lit(0)), n - 1)) + 1).otherwise(0)
    return lo, F.when(n > 0, F.greatest(hi, lo + 1)).otherwise(0)


def raw_quote(raw: Column, index: Column, start: Column, end: Column) -> Column:
    lo, hi = raw_span(index, start, end)
    return F.substring(raw, lo + 1, hi - lo)
