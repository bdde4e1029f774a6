"""A quality classifier by co-training of two views of a document.

One classifier sees the text (hashed words and word pairs, and its shape), the other the
metadata (language, source, declared length). Over some rounds each scores all documents, and
the ones of either class that it is surest of, by probabilities calibrated on labelled
documents kept apart, teach the other with that probability. Both calibrated views are then
combined, and every document is scored. Only the labelled rows to fit on are a sample: at
most ``labelled``, in the order of a digest of their ids. Each round passes over all
documents and gathers its ``added`` surest of each class and view.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, materialise, table

LABELLED = 12_000
ROUNDS = 2
#: Pseudo-labels of each class that a view gives in a round, and their weight beside a label's.
ADDED = 1_000
TRUST = 0.5
THRESHOLD = 0.5
#: Cells that words and word pairs are hashed to; their numbers have 16 bits.
CELLS = 1 << 15
#: Rows that a worker holds features of at a time; a batch of Spark's may have 10,000 and more.
SLICE = 512

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOURCES = 64


def text_features(text: str) -> tuple[list[float], np.ndarray]:
    """Shape of a text (lengths, repetition, kinds of characters) and the cells of its words and pairs."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space, as WORD
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    pairs = np.sort((codes[:-1] << np.uint64(32)) | codes[1:])
    mixed = (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    counts = _runs(np.sort(codes))
    seen = np.zeros(CELLS, bool)
    seen[codes & np.uint64(CELLS - 1)] = True
    seen[mixed & np.uint64(CELLS - 1)] = True
    lines = raw.split(b"\n")
    n, m = max(1, len(words)), max(1, len(words) - 1)
    units = np.frombuffer(raw, np.uint8)
    points = units[(units & 0xC0) != 0x80]  # the first byte of each code point
    bytes_ = np.bincount(units, minlength=256)
    size = max(1, len(raw))
    shape = [
        np.log1p(len(words)),
        len(counts) / n,
        int(counts.max(initial=0)) / n,
        len(_runs(pairs)) / m,
        len(set(lines)) / len(lines),
        n / len(lines),
        len(text) / n,
        int(np.diff(np.flatnonzero(_SPACE[points]), prepend=-1, append=len(points)).max()) - 1,
        bytes_[_UPPER].sum() / size,
        bytes_[_DIGIT].sum() / size,
        bytes_[_PUNCTUATION].sum() / size,
        bytes_[124] / n,
        bytes_[128:].sum() / size,
    ]
    return shape, np.flatnonzero(seen).astype(np.int16)


def _runs(x: np.ndarray) -> np.ndarray:
    """How often each value of a sorted array stands there."""
    return np.diff(np.flatnonzero(x[1:] != x[:-1]), prepend=-1, append=len(x) - 1) if len(x) else np.empty(0, np.int64)


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, float]:
    """Codes of language and source (digests, so that no list of them is needed) and the log of the length."""
    code = lambda s, n: 0 if s is None else 1 + zlib.crc32(s.encode()) % (n - 1)
    return code(lang, 16), code(source, _SOURCES), -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))


@dataclass
class Rows:
    """Features of some documents: shape, cells and metadata."""

    shape: np.ndarray
    cells: list[np.ndarray]
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.cells)

    def take(self, rows: np.ndarray) -> Rows:
        at = np.flatnonzero(rows) if rows.dtype == bool else rows
        return Rows(self.shape[at], [self.cells[i] for i in at], self.meta[at])

    def plus(self, other: Rows) -> Rows:
        return Rows(np.vstack([self.shape, other.shape]), self.cells + other.cells, np.vstack([self.meta, other.meta]))


def rows_of(texts: list[str | None], meta: list[tuple]) -> Rows:
    found = [text_features(t or "") for t in texts]
    shape = np.array([f[0] for f in found], dtype=float).reshape(-1, 13)
    return Rows(shape, [f[1] for f in found], np.array([meta_features(*m) for m in meta], dtype=float).reshape(-1, 3))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(d: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton's method; ``y`` may lie between 0 and 1."""
    beta = np.zeros(d.shape[1])
    for _ in range(25):
        p = _sigmoid(d @ beta)
        g = d.T @ (w * (p - y)) + ridge * beta
        h = (d * (w * p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _one_hot(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.eye(len(cut) + 1)[np.searchsorted(cut, x, side="right")]


def _quantiles(x: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, 17)[1:-1]))


@dataclass
class View:
    """A linear classifier of one view, with a calibration."""

    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: Rows) -> np.ndarray:
        return self.design(x) @ self.weights

    def fit(self, x: Rows, y: np.ndarray, w: np.ndarray) -> View:
        self.weights = _logistic(self.design(x), y, w, 1.0)
        return self

    def calibrate(self, x: Rows, y: np.ndarray) -> View:
        z = self.raw(x)
        a, b = _logistic(np.column_stack([z, np.ones(len(z))]), y, np.ones(len(y)), 1e-2)
        self.scale = (float(a), float(b))
        return self

    def logit(self, x: Rows) -> np.ndarray:
        return self.raw(x) * self.scale[0] + self.scale[1]


@dataclass
class Meta(View):
    """Codes of language and source one-hot, the length in bins."""

    def design(self, x: Rows) -> np.ndarray:
        if not self.cuts:
            self.cuts = [_quantiles(x.meta[:, 2])]
        m = x.meta
        return np.hstack([np.ones((len(x), 1)), np.eye(16)[m[:, 0].astype(int)], np.eye(_SOURCES)[m[:, 1].astype(int)], _one_hot(m[:, 2], self.cuts[0])])


@dataclass
class Text(View):
    """Shape in bins, any dependence on each; and a weight for each cell, scaled by the root of a text's cells."""

    content: np.ndarray = field(default_factory=lambda: np.zeros(CELLS))

    def design(self, x: Rows) -> np.ndarray:
        if not self.cuts:
            self.cuts = [_quantiles(x.shape[:, i]) for i in range(x.shape.shape[1])]
        return np.hstack([np.ones((len(x), 1)), *[_one_hot(x.shape[:, i], c) for i, c in enumerate(self.cuts)]])

    def raw(self, x: Rows) -> np.ndarray:
        words = np.array([self.content[c].sum() / np.sqrt(len(c)) if len(c) else 0.0 for c in x.cells])
        return self.design(x) @ self.weights + words

    def fit(self, x: Rows, y: np.ndarray, w: np.ndarray) -> Text:
        """Full gradients with Adam's steps: the same result in every run."""
        d = self.design(x)
        sizes = np.array([len(c) for c in x.cells])
        # Cells of some documents at a time: the driver has to hold no number for each cell of all.
        parts = [(part, np.concatenate([*x.cells[part], np.empty(0, np.int16)])) for part in (slice(i, i + SLICE) for i in range(0, len(x), SLICE))]
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        theta = np.zeros(d.shape[1] + CELLS)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, 121):
            z, of_cells = d @ theta[: d.shape[1]], np.zeros(CELLS)
            e = np.empty(len(x))
            for part, at in parts:
                row = np.repeat(np.arange(len(sizes[part])), sizes[part])
                z[part] += scale[part] * np.bincount(row, theta[d.shape[1] :][at], minlength=len(sizes[part]))
                e[part] = w[part] * (_sigmoid(z[part]) - y[part])
                of_cells += np.bincount(at, (e[part] * scale[part])[row], minlength=CELLS)
            g = np.concatenate([d.T @ e, of_cells]) + theta
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta -= 0.08 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.content = theta[: d.shape[1]], theta[d.shape[1] :]
        return self


@dataclass
class CoTrained:
    """Both views and their combination; ``prior`` alone where nothing could be learned."""

    prior: float
    text: Text | None = None
    meta: Meta | None = None
    mix: tuple[float, float, float] = (1.0, 0.0, 0.0)
    taught: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels each view got in a round: text, metadata

    def scores(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None or not len(x):
            return tuple(np.full(len(x), self.prior) for _ in range(3))
        a, b = self.text.logit(x), self.meta.logit(x)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def cotrain(x: Rows, y: np.ndarray, surest, rounds: int = ROUNDS) -> CoTrained:
    """Fit on labelled rows (``y``: 0, 1); every fourth calibrates.

    ``surest(model, taken)`` gives, for the text and the metadata view, the rows of the unlabelled
    documents that it is surest of in either class, with its probabilities; each row once.
    """
    prior = float(y.mean()) if len(y) else 1.0
    hold = np.arange(len(y)) % 4 == 3
    if len(y) < 20 or any(part.min() == part.max() for part in (y[hold], y[~hold])):
        return CoTrained(prior)
    model = CoTrained(prior, Text(), Meta())
    views = (model.text, model.meta)
    own, held = x.take(~hold), x.take(hold)
    lessons = [(own, y[~hold], np.ones(int((~hold).sum()))) for _ in views]
    for turn in range(rounds + 1):
        for view, lesson in zip(views, lessons, strict=True):
            view.fit(*lesson).calibrate(held, y[hold])
        if turn == rounds:
            break
        given = surest(model)
        for v, (rows, p) in enumerate(given):  # what a view is sure of teaches the other
            a, b, w = lessons[1 - v]
            lessons[1 - v] = (a.plus(rows), np.concatenate([b, p]), np.concatenate([w, np.full(len(p), TRUST)]))
        model.taught.append((len(given[1][1]), len(given[0][1])))
    z = np.column_stack([views[0].logit(held), views[1].logit(held), np.ones(int(hold.sum()))])
    model.mix = tuple(float(c) for c in _logistic(z, y[hold], np.ones(int(hold.sum())), 1e-2))
    return model


_VIEW = "text", "lang", "source", "n_chars"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _features(batch: pa.RecordBatch) -> Rows:
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _VIEW]
    return rows_of(columns[0], list(zip(*columns[1:], strict=True)))


def _gathered(docs: DataFrame, extra: list[str]) -> tuple[Rows, list[list]]:
    """Features of a bounded table, in the order of ``extra``, and the columns ``extra``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _slices(batches):
            x = _features(batch)
            arrays = [pa.array(list(np.hstack([x.shape, x.meta])), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x.cells)]), pa.int32()), pa.array(np.concatenate([*x.cells, np.empty(0, np.int16)]), pa.int16()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in extra), *arrays], names=[*extra, "x", "cells"])

    own = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    rows = docs.select(*extra, *_VIEW).mapInArrow(run, f"{own}, x array<double>, cells array<smallint>").orderBy(*extra, "x").toArrow()
    columns = [rows[c].to_pylist() for c in extra]
    if not rows.num_rows:
        return Rows(np.empty((0, 13)), [], np.empty((0, 3))), columns
    # Arrays all the way: as Python numbers the cells would take ten times the memory.
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)
    lists = rows["cells"].combine_chunks()
    cells = np.split(lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[1:-1])
    return Rows(x[:, :13], cells, x[:, 13:]), columns


def _surest(docs: DataFrame, model: CoTrained, known: np.ndarray, taken: set, added: int) -> list[tuple[Rows, np.ndarray]]:
    """For both views, the unlabelled documents that they are surest of: a pass over all documents.

    A task keeps ``added`` of each view and class; of these, the surest ``added`` of all are
    taken (ties by a digest), each once in a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        best: dict[tuple[int, int], list] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
        for batch in _slices(batches):
            ids = np.array([-(1 << 63) if d is None else d for d in batch.column(0).to_pylist()], dtype=np.int64)
            digests = batch.column(1).to_pylist()
            a, b, _ = model.scores(_features(batch))
            free = ~np.isin(ids, known) & (ids != -(1 << 63))
            for v, p in enumerate(np.round((a, b), 9)):  # batches of other sizes sum in another order
                for c in (0, 1):
                    heap, sure = best[v, c], (p if c else 1 - p)
                    at = np.flatnonzero(free & (sure >= heap[0][0])) if len(heap) == added else np.flatnonzero(free)
                    for i in at.tolist():
                        if (int(ids[i]), digests[i]) in taken:
                            continue
                        item = (float(sure[i]), -digests[i], -int(ids[i]))
                        heapq.heappush(heap, item) if len(heap) < added else heapq.heappushpop(heap, item)
        rows = [(v, c, s, -h, -d) for (v, c), heap in best.items() for s, h, d in heap]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["view", "class", "sure", "h", "id"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", *_VIEW).alias("h"), *_VIEW)
    found = materialise(keyed.mapInArrow(run, "view int, class int, sure double, h long, id long"), "surest")
    out = []
    for v in (0, 1):
        rows = None
        for c in (0, 1):
            top = found.where((F.col("view") == v) & (F.col("class") == c)).distinct().orderBy(F.desc("sure"), "h", "id").limit(added)
            rows = top if rows is None else rows.unionByName(top)
        # A document that is among the surest of both classes (few documents) counts where it is surer.
        chosen = rows.groupBy("id", "h").agg(F.max_by("class", "sure").alias("class"), F.max("sure").alias("sure")).collect()  # at most 2 x added
        if not chosen:
            out.append((Rows(np.empty((0, 13)), [], np.empty((0, 3))), np.empty(0)))
            continue
        wanted = docs.sparkSession.createDataFrame([(r.id, r.h, r.sure if r["class"] else 1 - r.sure) for r in chosen], "id long, h long, p double")
        hit = keyed.join(F.broadcast(wanted), ["id", "h"]).dropDuplicates(["id", "h"])  # repeats are equal in all that is read
        x, (ids, hs, p) = _gathered(hit, ["id", "h", "p"])
        taken.update(zip(ids, hs, strict=True))
        out.append((x, np.array(p, dtype=float)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, added: int = ADDED) -> CoTrained:
    """Fit on a bounded sample of labelled rows and on pseudo-labels from all others.

    Rows of ``labels`` without an id or label don't count; several for an id vote (a tie is 1).
    Of several documents with a labelled id, the one of the smallest digest is fitted on.
    """
    digest = F.xxhash64("doc_id", F.lit(11))
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    chosen = materialise(votes.withColumn("o", digest).orderBy("o", "doc_id").limit(labelled), "chosen")  # a bounded number of ids
    known = docs.select("doc_id", F.xxhash64("doc_id", *_VIEW).alias("h"), F.struct(*_VIEW).alias("r")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("o", "doc_id", "y").agg(F.min_by("r", "h").alias("r")).select("o", "doc_id", "y", "r.*")
    x, (_, ids, y) = _gathered(known, ["o", "doc_id", "y"])
    ids, taken = np.array(ids, dtype=np.int64), set()
    return cotrain(x, np.array(y, dtype=float), lambda model: _surest(docs, model, ids, taken, added), rounds)


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_text, p_meta, score`` (chances of good quality) and ``keep``.

    Null texts count as empty; null language, source or length are values of their own. A row is
    scored by itself, so repeated rows score alike. Columns of the new names are replaced.
    Without labels of both kinds all rows get the share of good labels (1 without labels).
    """
    new = {"p_text": "double", "p_meta": "double", "score": "double", "keep": "boolean"}
    kept = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in new.items()])
    fitted = model.text is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            parts = [model.scores(_features(part)) for part in _slices(iter([batch]))]
            a, b, s = (np.concatenate([np.empty(0), *own]) for own in zip(*parts, strict=True)) if parts else [np.empty(0)] * 3
            keep = s >= threshold if fitted else np.ones(len(s), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b), pa.array(s), pa.array(keep)], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "score", "keep")
