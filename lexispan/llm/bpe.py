"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every new word; a proposal is right if each pair
of neighbours is itself what merging gives for the two tokens' bytes, so one vectorised test
of all pairs verifies it. Only words that fail are merged exactly. The vocabulary is a file
named by a parameter; it is read once in each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import kept_in_worker, table

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers: the older half goes but for those met since, which costs time only.
REMEMBERED = 500_000
PAIRS_REMEMBERED = 500_000
#: Rows that a worker encodes at a time; a batch of Spark's may have 10,000 and more.
SLICE = 512
_SHIFT = 1 << 20
_NEVER = 1 << 60

# White space as Unicode's White_Space property has it: `\s` of Python also takes U+001C..1F.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: In texts of these characters alone the letters are the ranges named here, and `re`, which is faster, does.
_PLAIN = re.compile(r"[^\t\n\x20-\x7eÀ-ÖØ-öø-ɏ]")
_PLAIN_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\t\n A-Za-z0-9À-ÖØ-öø-ɏ]+|[\t\n ]+(?![^\t\n ])|[\t\n ]+")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str) -> list[str]:
    """The words within which tokens lie."""
    return (_WORDS if _PLAIN.search(text) else _PLAIN_WORDS).findall(text)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with merges and added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.id_of = vocab
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])
        #: Rank of the merge of two ids (left id times _SHIFT plus right id), and the id that each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (x, y) in enumerate(merges):
            left, right = bytes(byte[c] for c in x), bytes(byte[c] for c in y)
            self.rank.setdefault(vocab[left] * _SHIFT + vocab[right], rank)
            self.made.append(vocab[left + right])
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.longest: dict[int, list[int]] = {}
        by_first: dict[int, set[int]] = {}
        for b in vocab:
            by_first.setdefault(b[0], set()).add(len(b))
        self.longest = {k: sorted(v, reverse=True) for k, v in by_first.items()}
        self.decimal = [str(i) for i in range(size)]
        #: Ids of words as bytes alone: with their decimal text beside them a worker takes 86 MB more when all are remembered.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.exact = 0

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked pair first, leftmost among equals."""
        byte_id, get, made = self.byte_id, self.rank.get, self.made
        ids = [byte_id[b] for b in word]
        if len(ids) > 200:
            return self._merged_long(ids)
        ranks = [get(x * _SHIFT + y, _NEVER) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            i = ranks.index(rank)
            ids[i : i + 2] = (made[rank],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] * _SHIFT + ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] * _SHIFT + ids[i], _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        import heapq

        get, made, n = self.rank.get, self.made, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * _SHIFT + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] * _SHIFT + ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := get(ids[h] * _SHIFT + ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            for size in longest[word[at]]:
                if size <= n - at and (i := id_of.get(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair, left id times 2**32 plus right id: whether merging its bytes gives it back."""
        distinct, where = np.unique(keys, return_inverse=True)
        if len(self.pairs) > PAIRS_REMEMBERED:
            self.pairs.clear()
        flags = np.empty(len(distinct), dtype=bool)
        for i, key in enumerate(distinct.tolist()):
            ok = self.pairs.get(key)
            if ok is None:
                x, y = key >> 32, key & 0xFFFFFFFF
                ok = self.pairs[key] = self.merged(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
            flags[i] = ok
        return flags[where]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered yet: speculate, verify all pairs at once, merge what fails."""
        raw = [w.encode() for w in words]
        tokens = [self.proposed(b) for b in raw]
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter((i for t in tokens for i in t), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[inner[~self.compatible((flat[inner] << 32) | flat[inner + 1])]]) if len(inner) else inner
        for i in bad.tolist():
            tokens[i] = self.merged(raw[i])
        self.exact += len(bad)
        # A token that merging cannot reach by itself is never right as a whole word either.
        for w, t, b in zip(words, tokens, raw, strict=True):
            if len(t) == 1 and len(b) > 1 and self.merged(b) != t:
                t = self.merged(b)
            self.known[w] = np.array(t, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text the ids as decimal text and as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED // 2 or not self.known:
            self.older, self.known = self.known, {}
            for s, i in self.added.items():
                self.known[s] = np.array([i], dtype="<u4").tobytes()
        get, rows, new = self.known.get, [], set()
        for text in texts:
            if self.split_added is not None and any(a in text for a in self.added):
                words: list[str] = []
                for part in self.split_added.split(text):
                    words += [part] if part in self.added else words_of(part)
            else:
                words = words_of(text)
            found = list(map(get, words))
            gaps = [i for i, f in enumerate(found) if f is None] if None in found else ()
            new.update(words[i] for i in gaps)
            rows.append((words, found, gaps))
        if new:
            self.learn(met_again(new, self.known, self.older))
        for words, found, gaps in rows:
            for i in gaps:
                found[i] = self.known[words[i]]
            raw = b"".join(found)
            yield ",".join(map(self.decimal.__getitem__, np.frombuffer(raw, dtype="<u4").tolist())), raw

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; sequences that aren't UTF-8 become U+FFFD, as text can hold no others."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


def met_again(words: set[str], known: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
    """Move those of ``words`` that ``older`` has into ``known``; the others."""
    found = [(w, older[w]) for w in words if w in older]
    known.update(found)
    return list(words.difference(w for w, _ in found))


def load(path: str) -> Bpe:
    return kept_in_worker(("bpe", path), lambda: Bpe(path))


def _groups(values: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that memory follows no batch's size."""
    run, size = [], 0
    for v in values:
        run.append(v)
        size += len(v)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and, with ``ids``, the token ids as ``token_ids``.

    A null text counts as empty; an empty text has no tokens. The strings of added tokens
    (as ``<|endoftext|>``) are those tokens, as the tokenizers library has it. Other columns
    pass unchanged, and columns of the new names are replaced. Each row is encoded by itself,
    so repeated rows give equal values, and an empty table an empty one.
    """
    path = path or tokenizer_path()
    new = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if ids:
        new["token_ids"] = ("array<int>", pa.list_(pa.int32()))
    kept = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v[0]}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            at = 0
            column = batch.column(batch.schema.get_field_index(text))
            for texts in _groups([t or "" for t in column.to_pylist()]):
                counts, shas, decoded, lists = [], [], [], []
                for as_text, raw in bpe.encode(texts):
                    own = np.frombuffer(raw, dtype="<u4")
                    counts.append(len(own))
                    shas.append(hashlib.sha256(as_text.encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                    if ids:
                        lists.append(own.astype(np.int32))
                part = batch.slice(at, len(texts))
                at += len(texts)
                arrays = [pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)] + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new])

    return kept.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
