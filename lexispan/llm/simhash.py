"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into blocks; close pairs agree in some of them, so documents meet on
block keys and their Hamming distance is then verified. Nothing emits all pairs of a group:
each bucket first compares its members with one hub, connected components are formed, and
only members that the components leave apart are compared further.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, connected_components, let_go, materialise, maybe_in, table

_WORDS = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ONES = np.uint64(0x0101010101010101)
_SEED = 42
_CHUNK = 1 << 16
#: Sets of so many shingles at most meet by prefix filtering, which misses no link: their bits say too little.
EXACT = 64
#: Comparisons that a bucket may take before it is split.
CROWD = 1_000_000


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` lower-cased words, repeats included; fewer words are one run; none: empty."""
    words = _WORDS.findall(text if text.islower() else text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    runs = zip(*(itertools.islice(words, i, None) for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter((h(" ".join(r), _SEED) for r in runs), dtype=np.uint64, count=n)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each of the 64 bits set; bytes count up to 255 rows at once."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        starts = np.arange(0, len(part), 255)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & _ONES, starts)
            total[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return total


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of each shingle (i = 0: the hash itself)."""
    if i == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, longs: int = 1) -> list[int]:
    """``longs`` times 64 bits; a bit is 1 if set in over half of the hashes. No hashes: zero."""
    out = []
    for i in range(longs):
        bits = _bit_counts(_mixed(h, i)) * 2 > len(h)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def add_fingerprints(docs: DataFrame, size: int, longs: int = 1, distinct: bool = False, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``fp``, an array of ``longs`` longs. A null text counts as empty."""
    kept = [f for f in docs.schema if f.name not in (text, "fp")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            fps = []
            for t in batch.column(batch.schema.get_field_index(text)):
                h = shingle_hashes(t.as_py() or "", size)
                fps.append(fingerprint(np.unique(h) if distinct else h, longs))
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(fps, pa.list_(pa.int64()))], names=[*names, "fp"])

    return docs.mapInArrow(run, schema)


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def block_keys(fp: Column, blocks: int, agree: int) -> Column:
    """``key, used`` of a 64-bit fingerprint: one for each choice of ``agree`` of its ``blocks`` blocks.

    Two fingerprints within ``blocks - agree`` bits share a key at least; ``used`` are the bits
    that members of its bucket agree in.
    """
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        mask = F.lit(_signed(sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen))).cast("long")
        keys.append(F.struct(F.xxhash64(F.lit(k), fp.bitwiseAND(mask)).alias("key"), mask.alias("used")))
    return F.array(*keys)


def link_components(members: DataFrame, close, sketches: DataFrame | None = None, verify=None, split=None, splits: int = 64, crowd: int = CROWD) -> DataFrame:
    """Components of nodes that share a bucket and are close: ``node, label`` for nodes with links.

    ``members`` has ``key, node`` and what ``split`` needs; ``close(x, y)`` is a condition on two
    sketches, which ``sketches`` gives by node (a node is its own sketch without it), and
    ``verify`` an optional exact filter of pairs ``a, b``. Every bucket's members meet its
    smallest node first. A bucket that still holds several components compares the members
    outside its largest component with those of other components. Where that takes over
    ``crowd`` comparisons, ``split`` gives the bucket's members finer keys, such that every
    close pair of the bucket shares one, and these go the same way, ``splits`` times at most; so
    no large group is compared with itself as a whole. Every close pair that shares a bucket ends in one component.
    """
    verify = verify or (lambda pairs: pairs.where(close(F.col("a"), F.col("b"))))
    links, level = None, members
    for turn in itertools.count():
        hubs = level.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
        # Rows an explode makes aren't in Spark's estimate, so it would broadcast the keys of all buckets through the driver.
        shared = materialise(level.join(hubs.hint("merge"), "key"), "shared")
        if turn and shared.isEmpty():
            break
        first = materialise(verify(shared.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()).select("a", "b"), "links")
        links = first if links is None else links.unionByName(first)
        labels = connected_components(links)
        placed = shared.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = placed.groupBy("key", "label").count()
        mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("n"), F.max("count").alias("top")).where("parts > 1")
        mixed = materialise(mixed.select("key", "main", ((F.col("n") - F.col("top")) * F.col("n") > crowd).alias("crowded")), "mixed")
        again = split is not None and turn < splits
        few = mixed.where("NOT crowded") if again else mixed
        placed = placed.join(few.select("key", "main"), "key")
        placed = materialise(placed.join(sketches, "node") if sketches is not None else placed.withColumn("sketch", F.col("node")), "placed")
        other = placed.select(F.col("key"), F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("label").alias("lb"), F.col("main").alias("mb"))
        outside = placed.where("label <> main").select("key", F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("label").alias("la"))
        pairs = (
            outside.join(other, "key")
            .where((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("mb")) | (F.col("a") < F.col("b"))) & close(F.col("sa"), F.col("sb")))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        links = links.unionByName(materialise(verify(pairs).select("a", "b"), "links"))
        crowded = mixed.where("crowded").select("key")
        if not again or crowded.isEmpty():
            break
        level = materialise(split(shared.drop("hub").join(crowded, "key", "left_semi")), "split")
    return connected_components(links)


def finer_blocks(distance: int):
    """Splits crowded buckets (``key, node, used``: the bits their members agree in) by the bits not used yet.

    Two fingerprints within ``distance`` bits agree in one of ``distance + 1`` parts of the
    other bits. Fingerprints that agree in all bits are one node, so splitting ends.
    """

    def split(crowded: DataFrame) -> DataFrame:
        rows = []
        for (used,) in crowded.select("used").distinct().collect():  # one for each choice of blocks, whatever the data
            free = [b for b in range(64) if not used >> b & 1]
            for g in range(distance + 1):
                part = sum(1 << b for b in free[g :: distance + 1])
                rows.append((used, _signed(part), _signed((used | part) & (2**64 - 1))))
        parts = crowded.sparkSession.createDataFrame(rows, "used long, part long, next long").where("part <> 0")
        finer = F.xxhash64("key", "part", F.col("node").bitwiseAND(F.col("part")))
        return crowded.join(F.broadcast(parts), "used").select(finer.alias("key"), "node", F.col("next").alias("used"))

    return split


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 & 1 else x


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    A null or wordless text has fingerprint zero and links like any other. ``component_id`` is
    the smallest doc_id reachable over links of at most ``distance`` bits (null ids are never
    the smallest; a component of null ids alone has a null id). Repeated rows share their
    component. ``blocks`` must exceed ``distance``; more blocks make narrower buckets.
    """
    rows = add_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", F.col("fp")[0].alias("node"))
    rows = materialise(rows, "fingerprints")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    members = nodes.select("node", F.explode(block_keys(F.col("node"), blocks, blocks - distance)).alias("x")).select("node", "x.*")
    labels = link_components(members, lambda x, y: hamming(x, y) <= distance, split=finer_blocks(distance))
    placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "label").select("node", "component_id")
    return rows.join(known, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicate documents by similarity of word shingles ---------------------------------

#: Cells of the count of shingles, and the share of all from which a cell's shingles come last in the order.
CELLS = 1 << 20
HEAVY = 2.0**-20
#: Shingles of a set that its row carries beyond its prefix, for splitting.
SPARE = 6
#: Longs of the bitmap of a set's first shingles.
MARKS = 8
_LONGS = 2


def _map_text(df: DataFrame, kept: list[str], schema: str, make, names: list[str]) -> DataFrame:
    """``kept`` columns and what ``make`` gives for each text, as columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        types = None
        for batch in batches:
            rows = [make(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            types = types or [pa.int64() if not s.startswith("array") else pa.list_(pa.int64()) for s in kinds]
            new = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *new], names=[*kept, *names])

    kinds = [part.split()[1] for part in schema.split(", ")]
    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, "text").mapInArrow(run, f"{own}, {schema}" if kept else schema)


def heavy_cells(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of shingles by cell of their hash, over all texts; 0 but for shares of ``HEAVY`` and more.

    A task counts all its shingles and sends the cells that are heavy in its own part, so at most
    1 / HEAVY rows; as many at most are heavy over all and reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                cells, n = np.unique(shingle_hashes(t.as_py() or "", size) >> np.uint64(44), return_counts=True)
                counts[cells.astype(np.int64)] += n
        total = int(counts.sum())
        at = np.flatnonzero((counts >= 16) & (counts >= HEAVY * total))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[at], total), pa.int64())], names=["cell", "n"])

    sums = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "cells")
    total = sums.where("cell = -1").agg(F.sum("n")).first()[0] or 0
    found = sums.where(F.col("cell").between(0, CELLS - 1) & (F.col("n") >= HEAVY * total)).toArrow()
    out = np.zeros(CELLS, dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set of ``n``, in any order common to all, hold one of every set that similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _add_sets(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``doc_id, key, h1, h2, n, f1, f2, first, marks``: digest, size, SimHash, first shingles and their bitmap of each text's set."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_cells(docs, size))  # 8 MB

    def make(text: str) -> tuple:
        h = np.unique(shingle_hashes(text, size))
        digest = xxhash.xxh3_128_intdigest(h.tobytes())
        ordered = h[np.lexsort((h, heavy.value[(h >> np.uint64(44)).astype(np.int64)]))] if len(h) else h
        first = ordered[: prefix_length(len(h), similarity) + SPARE]
        return (_signed(digest >> 64), _signed(digest & (2**64 - 1)), len(h), *fingerprint(h, _LONGS), first.view(np.int64), _marks(first))

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return _map_text(keyed, ["doc_id", "key"], "h1 long, h2 long, n long, f1 long, f2 long, first array<bigint>, marks array<bigint>", make, ["h1", "h2", "n", "f1", "f2", "first", "marks"])


def _needed(similarity: float) -> Column:
    return F.ceil(F.col("n") * F.lit(float(similarity)) - F.lit(1e-9)).cast("int")


def longer_prefixes(nodes: DataFrame, similarity: float):
    """Splits crowded buckets (``key, node, chosen``: the shingles their members share) by one more shingle.

    Sets this similar share ``l`` of their first n - ceil(similarity n) + l shingles at least. A
    set that can't hold more than it shares already stays with its like.
    """

    def split(crowded: DataFrame) -> DataFrame:
        some = crowded.join(nodes.select("node", "n", "first"), "node").withColumn("l", F.size("chosen") + 1)
        room = F.col("n") - _needed(similarity) + F.col("l")
        more = F.array_except(F.slice("first", F.lit(1), F.least(room, F.size("first")).cast("int")), "chosen")
        more = F.when(_needed(similarity) < F.col("l"), F.array_append(more, F.lit(None).cast("long"))).otherwise(more)
        each = some.select("node", "chosen", F.explode(more).alias("e"))
        chosen = F.array_sort(F.array_append("chosen", F.col("e")))
        return each.select(chosen.alias("chosen"), "node").select(F.xxhash64("chosen").alias("key"), "node", "chosen").distinct()

    return split


def _marks(first: np.ndarray) -> np.ndarray:
    """A bitmap of shingles: bits that two bitmaps don't share are as many shingles at least that the sets don't."""
    bits = np.zeros(64 * MARKS, dtype=bool)
    bits[(first & np.uint64(64 * MARKS - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def _may_be_alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets may be this similar: by size, by SimHash within six standard deviations (not small sets), by first shingles.

    In an order common to all, a shingle that two sets share stands among the first of both, or
    else beyond the first of the set whose first end earlier; so first shingles miss no link.
    """
    bits = 64 * _LONGS
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = bits * differ + 6 * math.sqrt(bits * differ * (1 - differ))
    small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    far = hamming(x["f1"], y["f1"]) + hamming(x["f2"], y["f2"])
    apart = sum((hamming(x["marks"][i], y["marks"][i]) for i in range(MARKS)), F.lit(0))
    shared = (x["p"] + y["p"] - apart) / 2 + F.greatest(x["n"] - x["p"], y["n"] - y["p"])
    return (small >= similarity * large) & ((small <= EXACT) | (far <= most)) & (shared >= (x["n"] + y["n"]) * (similarity / (1 + similarity)) - 1e-6)


def near_duplicate_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, key, node`` of ``docs``, and ``node, label`` of shingle sets with near copies.

    Two texts link if the Jaccard similarity of their sets of ``size``-word shingles is
    ``similarity`` or more; every link is found. Blocks of a SimHash can't do that at 0.8: a
    bit differs with chance 0.152, so two texts differ in 10 of 64 bits, blocks that 95 % of
    links survive need about 3 n^0.24 keys each (110 for 2e5 texts, 800 for 1e9). So candidates
    share one of their first 0.2 n + 1 shingles in an order common to all, frequent ones last
    (prefix filtering: a fifth of the text's words whatever the number of texts), and SimHash
    verifies them by its Hamming distance over 128 bits, and their first shingles by how many
    they share, before the exact similarity does.
    """
    rows = materialise(_add_sets(docs, size, similarity), "shingled")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("rep")
    nodes = rows.groupBy("h1", "h2").agg(rep, *[F.first(c).alias(c) for c in ("n", "f1", "f2", "first", "marks")])
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.explode(F.slice("first", F.lit(1), F.greatest(F.col("n") - _needed(similarity) + 1, F.lit(0)).cast("int"))).alias("shingle"))
    common = materialise(each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").select("shingle"), "common")
    members = maybe_in(each, common, "shingle", "some").where("some").select(F.col("shingle").alias("key"), "node", F.array("shingle").alias("chosen"))
    sketches = nodes.select("node", F.struct("n", "f1", "f2", F.size("first").alias("p"), "marks").alias("sketch"))
    texts = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
        near = materialise(near.where(_may_be_alike(F.col("x"), F.col("y"), similarity)).select("a", "b"), "near")
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep.doc_id", "rep.key"), "node")
        wanted = materialise(wanted.select("node", F.col("doc_id").alias("rep_id"), F.col("key").alias("rep_key")), "wanted")
        found = maybe_in(texts, wanted.select(F.col("rep_key").alias("key")), "key", "some").where("some").drop("some")
        found = found.join(wanted, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text").dropDuplicates(["node"])
        sets = materialise(_map_text(found, ["node"], "shingles array<bigint>", lambda t: (np.unique(shingle_hashes(t, size)).view(np.int64),), ["shingles"]), "sets")
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return near.join(x, "a").join(y, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")

    labels = link_components(members, lambda x, y: _may_be_alike(x, y, similarity), sketches, verify, longer_prefixes(nodes, similarity), SPARE)
    return rows.select("doc_id", "key", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "key", "node"), labels


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Groups are connected over links (see :func:`near_duplicate_groups`). Equal texts always
    link; texts without words (null and empty too) link with each other. Among equal ids the
    smallest text hash stays, and of rows that repeat a document all stay or none. A null
    doc_id comes last. An empty table gives an empty table.
    """
    rows, labels = near_duplicate_groups(docs.select("doc_id", "text"), size, similarity)
    placed = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    placed = materialise(placed.groupBy("label", "doc_id", "key").agg(F.count("*").alias("rows")), "placed")
    kept = placed.groupBy("label").agg(F.min(who).alias("keep"), F.count("*").alias("n")).where("n > 1").select("label", "keep")
    gone = placed.join(kept, "label").where(F.col("keep") != who).select(F.col("doc_id").alias("__ls_id"), F.col("key").alias("__ls_key"))
    gone = materialise(gone, "gone")
    hashed = maybe_in(docs.withColumn("__ls_hash", F.xxhash64("doc_id", "text")), gone.select(F.col("__ls_key").alias("__ls_hash")), "__ls_hash", "__ls_some")
    same = (F.col("__ls_hash") == F.col("__ls_key")) & F.col("doc_id").eqNullSafe(F.col("__ls_id"))
    stay = hashed.where("NOT __ls_some").unionByName(hashed.where("__ls_some").join(gone, same, "left_anti"))
    return stay.select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
