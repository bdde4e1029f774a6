"""Token ids in directly addressable codes, written as files and read back.

A segment holds the ids of consecutive documents. Ids are cut into chunks of eight bits; level
k keeps chunk k of every id that has one, a bitmap that says which of these continue on the
next level, and a directory with the number of set bits before every 512th. The i-th id is
found by following its bit down the levels with two look-ups a level, without decoding a
block. Segments are rows of a Parquet table, so Spark's commit protocol guards the files.

Layout of a segment, little-endian: ``b"DAC1"``, version, levels, documents, ids (4 x uint32);
ids' documents: doc_id int64, null flag uint8, first id uint64 (one more for the end); for each
level: entries uint64, chunks uint8, bitmap (bit i of byte i // 8), directory uint32; crc32.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import met_again, tokenizer_path, words_of
from .common import kept_in_worker, materialise, table

END = 0
#: Ids a segment holds, unless one document has more; segments end with a document.
SEGMENT_IDS = 1 << 20
#: Words that a worker remembers: the older half goes but for those met since, which costs time only.
REMEMBERED = 1_000_000
#: Words that the library gets as one text; longer ones take it more time a word.
RUN = 500
_BLOCK = 512


class DacSegment:
    """Directly addressable codes of one array of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, ids: np.ndarray) -> DacSegment:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(bits).astype(np.uint32), np.arange(0, len(bits), _BLOCK // 8)) if len(bits) else np.empty(0, np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)[:-1]]) if len(counts) else counts
            levels.append((rest.astype(np.uint8), bits, ranks))  # the lowest eight bits
            rest = rest[more] >> 8
            if not len(rest):
                return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """The i-th id alone."""
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            part = bits[block * _BLOCK // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(part).sum())
        return out

    def all(self) -> np.ndarray:
        out = self.levels[0][0].astype(np.uint32)
        at = None
        for k in range(1, len(self.levels)):
            chunks, bits, _ = self.levels[k - 1]
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = more if at is None else at[more]
            out[at] |= self.levels[k][0].astype(np.uint32) << np.uint32(8 * k)
        return out


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    firsts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    dac = DacSegment.build(flat)
    parts = [b"DAC1", struct.pack("<4I", 1, len(dac.levels), len(doc_ids), len(flat))]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), firsts.tobytes()]
    for chunks, bits, ranks in dac.levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, DacSegment]:
    """Doc ids, the first id of each (one more for the end), and the codes."""
    if raw[:4] != b"DAC1" or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole segment of directly addressable codes")
    _, n_levels, n_docs, _ = struct.unpack_from("<4I", raw, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    ids, nulls, firsts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
    levels = []
    for _ in range(n_levels):
        (n,) = struct.unpack_from("<Q", raw, at)
        at += 8
        levels.append((take("u1", n), take("u1", (n + 7) // 8), take("<u4", (n + _BLOCK - 1) // _BLOCK)))
    return [None if null else int(i) for i, null in zip(ids, nulls, strict=True)], firsts, DacSegment(levels)


class WordTokenizer:
    """The tokenizers library, asked once for each distinct word that a worker remembers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        byte_start = {i: s[:1] == "Ġ" for s, i in self.lib.get_vocab().items()}
        self.opens = np.zeros(max(byte_start) + 1, dtype=bool)
        self.opens[[i for i, x in byte_start.items() if x]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[str]) -> None:
        # Words of a blank and letters stay words when they stand one after the other.
        spaced: list[str] = []
        rest: list[str] = []
        for w in words:
            (spaced if w[0] == " " and w[1:].isalpha() else rest).append(w)
        for at in range(0, len(spaced), RUN):
            run = spaced[at : at + RUN]
            ids = self._ids("".join(run))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(run):
                rest += run
                continue
            raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), ids.nbytes]
            self.known.update(zip(run, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        for w, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        get, rows, new = self.known.get, [], set()
        for t in texts:
            if any(a in t for a in self.added):
                rows.append(None)  # an added token's string: the library takes the whole text
                continue
            words = words_of(t)
            found = list(map(get, words))
            gaps = [i for i, f in enumerate(found) if f is None] if None in found else ()
            new.update(words[i] for i in gaps)
            rows.append((words, found, gaps))
        if new:
            self.learn(met_again(new, self.known, self.older))
        for text, row in zip(texts, rows, strict=True):
            if row is None:
                yield self._ids(text)
                continue
            words, found, gaps = row
            for i in gaps:
                found[i] = self.known[words[i]]
            yield np.frombuffer(b"".join(found), dtype="<u4")


def _tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads that wait for words cost CPU
    return kept_in_worker(("words", path), lambda: WordTokenizer(path))


def write_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The written segments of ``doc_id, text``, in ascending doc_id order: ``part, seq, n_ids, segment``.

    A null text counts as empty: it has the end id alone. Null doc_ids come first; rows that
    repeat a doc_id stand in the order of their texts. An empty table gives no segments.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, tokenizer = TaskContext.get().partitionId(), 0, _tokenizer(path)
        doc_ids: list = []
        ids: list = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total, doc_ids, ids
            raw = write_segment(doc_ids, ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([total], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "n_ids", "segment"])
            seq, total, doc_ids, ids = seq + 1, 0, [], []
            return out

        end = np.array([END], dtype=np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for d, own in zip(some.column(0).to_pylist(), tokenizer.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    doc_ids.append(d)
                    ids.append(np.concatenate([own, end]))
                    total += len(own) + 1
                    if total >= SEGMENT_IDS:
                        yield flush()
        if doc_ids:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part int, seq long, n_ids long, segment binary"), "segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written segments."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.select("part", "seq", within.alias("start")).join(parts, "part").select("part", "seq", (F.col("start") + F.col("part_start")).alias("segment_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc_ids, firsts, dac = read_segment(raw.as_py())
                ids = memoryview(dac.all().astype("<u4").tobytes())
                cuts = firsts.tolist()
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(cuts[:-1], pa.int64()),
                        pa.array([y - x for x, y in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        pa.array([zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "seq", "segment").mapInArrow(run, "part int, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
