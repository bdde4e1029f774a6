"""Secret scans: fixed patterns, and random strings found by their token efficiency.

Text that a vocabulary was made for packs many characters in a token; random strings pack few.
A run of base-64 characters with fewer than ``RATIO`` characters a token is reported as
``random``, unless it is a known kind of digest or identifier or lies in a span of a pattern.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO = 2.2
#: Runs under 20 characters are judged more strictly: a few tokens say less.
RATIO_SHORT = 1.9
SHORTEST = 16

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same as shorter ones dropped
KINDS = ("assign", "access", "hex", "random")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
_DIGESTS = frozenset({32, 40, 56, 64, 96, 128})


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def known_shape(s: str) -> bool:
    """Digests and identifiers that look random but are no secrets, numbers and rules of dashes."""
    if _UUID.fullmatch(s) or (_HEX_ONLY.fullmatch(s) and len(s) in _DIGESTS):
        return True
    return not any(c.isalpha() for c in s)


def random_looking(s: str, path: str) -> bool:
    """Whether ``s`` packs few characters in a token: as a whole, and in its letters if they stand apart from digits."""
    encode = _encoding(path).encode_ordinary
    ratio = RATIO if len(s) >= 20 else RATIO_SHORT
    if len(s) >= ratio * len(encode(s)):
        return False
    parts = [p for p in re.split(r"[/_+-]", s.rstrip("=")) if p]
    if not all(p.isalpha() or p.isdigit() for p in parts):
        return True
    # Names and paths of words have word-like parts, however many signs and numbers join them.
    letters = [p for p in parts if p.isalpha()]
    return sum(map(len, letters)) < ratio * sum(len(encode(p)) for p in letters)


def spans(text: str, path: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and those that the token-efficiency test adds: (start, kind as numbered in KINDS, end)."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    added = []
    for m in _RUN.finditer(text):
        s = m[0]
        if known_shape(s) or any(x < m.end() and m.start() < y for x, _, y in base):
            continue
        if random_looking(s, path):
            added.append((m.start(), 3, m.end()))
    return base, added


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in found)


def scan_secrets(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, n_random`` (long), ``base_sha256`` and ``spans``.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and kind. A null
    text counts as empty and has no spans (an empty string). Each row is scanned by itself:
    repeated rows give equal values. Other columns pass; those of the new names are replaced.
    """
    path = path or vocabulary_path()
    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_random": "long", "base_sha256": "string", "spans": "string"}
    kept = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)):
                base, added = spans(t.as_py() or "", path)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(new)
            arrays = [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, kind in zip(columns, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
