"""Operators over whole corpora, against brute force, held-out labels and DuckDB."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lexispan.llm import line_dedup, mixing, quality, simhash, weighted_sampling
from lexispan.llm.common import connected_components


def _roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 540)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)] + [(7000, 7000)]
    r.shuffle(pairs)
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    want = _roots(pairs, {x for p in pairs for x in p})
    assert got == want


# --- line dedup -----------------------------------------------------------------------------------

LINES = [
    (1, "Posted by user 17 on page 3 of the forum\nUnique first line of one document\n\nshort"),
    (2, "Posted by user 99 on page 4 of the forum\nAnother line that nobody else has written\nshort"),
    (3, "The quick brown fox jumps over the lazy sleeping dog today\nA third"),
    (4, "The quick brown fox jumps over the lazy sleeping cat today\nA fourth"),
    (5, "The quick brown fox walks under a tall waking horse now\nA fifth"),
    (6, "  Posted by\tuser 5 on page 6 of the forum \n\n"),
]


def test_templates_drop_all_but_the_first_line(spark):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(LINES, "doc_id long, text string")).collect()}
    assert got[1] == LINES[0][1]
    assert got[2] == "Another line that nobody else has written"
    assert got[3] == LINES[2][1] and got[5] == LINES[4][1]
    assert got[4] == "A fourth"
    assert got[6] == "\n"


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LINES)
    want = sorted(con.sql(line_dedup.OP1_SQL).fetchall())
    got = line_dedup.dedup_lines(spark.createDataFrame(LINES, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("n", [100, 3000])
def test_templates_with_recurring_field_values(spark, n):
    r = random.Random(n)
    name = lambda: "".join(chr(97 + int(c)) for c in str(r.randint(100, 399)))
    docs = [(i, f"the forum member named {name()} has written a reply to {name()} this morning") for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).where("n_dropped = 0").collect()
    assert [x.doc_id for x in got] == [0]


def test_crossed_fields_of_few_values(spark):
    docs = lambda a, b: [(i * 10 + j, f"the weather report for {x} was sent to {y} on time today") for i, x in enumerate(a) for j, y in enumerate(b)]
    for rows in (docs(["north", "south", "west"], ["anna", "bert", "carl"]), docs(["north", "south"], ["anna", "bert"])):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert [r.doc_id for r in line_dedup.dedup_lines(df).where("n_dropped = 0").collect()] == [0]
        assert line_dedup.dedup_lines(df, keep_first=False).where("text <> ''").count() == 0


def _brute_force(rows):
    """Documents' lines that go, by comparing ratings of whole leaves in plain Python."""
    own, texts = {}, defaultdict(set)
    for d, text in rows:
        for i, line in enumerate(text.split("\n")):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in re.split(r"[ \t\x0b\x0c\r]+", line.strip(" \t\x0b\x0c\r")))
            if tokens != ("",):
                own[d, i] = tokens
                texts[len(tokens), tokens[: min(3, len(tokens) - 1)]].add(tokens)
    groups = defaultdict(set)
    for at, tokens in own.items():
        n, path = len(tokens), min(3, len(tokens) - 1)
        peers = texts[n, tokens[:path]]
        counts = [sum(p[k] == tokens[k] for p in peers) for k in range(n)]
        groups["own", tokens].add(at)
        for level in range(1, 40):
            kept = tuple(w if k < path or counts[k] >= 2**level else None for k, w in enumerate(tokens))
            if n > 1 and sum(w is not None for w in kept) >= 0.75 * n:
                groups["some", kept].add(at)
    return {at for g in groups.values() if len({d for d, _ in g}) > 1 for at in g if at != min(g)}


def test_line_dedup_against_brute_force(spark, sf):
    r = random.Random(5)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = "alpha beta gamma delta".split()
    made = ["\n".join(" ".join([r.choice(["run of", "log for the"]), *(r.choice(words[: r.randint(1, 4)]) for _ in range(r.randint(1, 6)))]) for _ in range(5)) for _ in range(150)]
    for data in (rows, list(enumerate(made))):
        gone = line_dedup.dropped_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert {(x.doc_id, x.line_no) for x in gone} == _brute_force(data)


def test_the_pipeline_generalises_the_fourth_token(spark):
    import corpus_pipeline

    rows = [(i, f"Posted by user {w} on the page of the forum", "en", "a", 1) for i, w in enumerate(["Alice", "Bob", "Carol"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id: x.text for x in corpus_pipeline.lines(spark, docs, "").collect()} == {0: rows[0][1], 1: "", 2: ""}


# --- SimHash --------------------------------------------------------------------------------------


def test_simhash_query_against_brute_force(spark, sf):
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = {r.doc_id: shingled(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(fps)
    want = _roots([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("crowd", [400])  # so few that buckets are split
def test_dense_groups_keep_every_link(spark, crowd):
    """Fingerprints a few bits apart in chains, with many in one ball."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(200)} | {r.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(s,) for s in signed], "node long")
    members = nodes.select("node", F.explode(simhash.block_keys(F.col("node"), 6, 3)).alias("x")).select("node", "x.*")
    labels = {x.node: x.label for x in simhash.link_components(members, lambda x, y: simhash.hamming(x, y) <= 3, split=simhash.finer_blocks(3), crowd=crowd).collect()}
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    want = _roots(pairs, {x for p in pairs for x in p})
    assert labels == want


def test_keys_of_all_buckets_are_not_broadcast(spark, monkeypatch):
    """Twenty keys a text: Spark's estimate leaves out the rows an explode makes, and the driver's memory goes with them."""
    plans, write = [], simhash.materialise

    def seen(df, label):
        if label == "shared":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "materialise", seen)
    docs = spark.createDataFrame([(i, f"text {i % 7} of some words") for i in range(40)], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 40
    assert plans and not any("BroadcastExchange" in p for p in plans)


def _near_fixture():
    r = random.Random(6)
    docs, i = [], 0
    for _ in range(40):
        words = [r.choice("abcdefghijklmnop") + str(r.randint(0, 400)) for _ in range(r.randint(60, 200))]
        for k in range(r.randint(1, 6)):
            own = list(words)
            for _ in range(k):
                own[r.randrange(len(own))] = f"edit{r.random()}"
            docs.append((i, " ".join(own)))
            i += 1
    return docs


@pytest.mark.parametrize("crowd", [30])  # so few that buckets are split
def test_near_duplicates_against_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash.link_components, "__defaults__", (*simhash.link_components.__defaults__[:-1], crowd))
    docs = _near_fixture()
    # A passage that stands in every document, which alone makes no copies.
    docs = [(d, t + " here is a passage that all of them hold at the end of it") for d, t in docs]
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {d for d, root in _roots(links, ids).items() if d == root}
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_small_sets_lose_no_link(spark):
    r, docs = random.Random(9), []
    for n in [5, 6, 7, 8, 9, 10, 12, 16, 19, 24, 34, 48, 64, 68] * 30:
        words = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        more = max(1, (n - 4) // 4) if n > 7 else 0
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(words + [f"x{r.random()}" for _ in range(more)]))]
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in docs}
    ids = sorted(sets)
    links = [(a, a + 1) for a in ids[::2] if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])]
    assert len(links) > 300
    want = {d for d, root in _roots(links, ids).items() if d == root}
    assert {x.doc_id for x in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


# --- fingerprints by weighted sampling --------------------------------------------------------------


def test_likeness_estimates_generalised_jaccard(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    got = {r.doc_id: r for r in weighted_sampling.op2_fingerprints(spark, sf).collect()}
    count = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
    gap = []
    for i, row in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)].text, len(row.text)
        edited = row.text[: n - n // 2] + after[: n // 2]
        r = got[row.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            x, y = count(row.text), count(other)
            gap.append(near - sum((x & y).values()) / max(1, sum((x | y).values())))
    assert abs(np.mean(gap)) < 0.02 and np.sqrt(np.mean(np.square(gap))) < 0.07


def test_equal_and_wordless_texts(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a b b c"), (3, None), (4, ""), (5, "z")], "doc_id long, text string")
    got = {r.doc_id: r for r in weighted_sampling.edited_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0
    assert got[4].near_next == 1.0 and got[5].near_next == 0.0 and got[3].edited_sha256 == hashlib.sha256(b"").hexdigest()


# --- mixing -----------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_and_reruns_agree(spark):
    r = random.Random(8)
    docs = [(i, " ".join(["w"] * r.randint(1, 40)), "tiny" if i < 5 else f"s{i % 6}" if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    by = defaultdict(list)
    for x in out:
        by[x.source].append(x)
        assert x.taken <= 3 * x.size and x.taken == x.copies * x.size
    assert by["tiny"][0].target == 3 * by["tiny"][0].source_size
    assert abs(sum(v[0].target for v in by.values()) - sum(x.size for x in out)) < 1e-6
    for rows in by.values():
        assert abs(sum(x.taken for x in rows) - rows[0].target) <= max(x.size for x in rows)


def test_preferences_are_inclusion_odds(spark):
    docs = [(i, "w w w w", "a" if i % 4 else "b", float(1 + 2 * (i % 2)) if i % 10 else None) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, liked double")
    rows = [r for r in mixing.mix(df, weights=(1, 4), preference="liked").collect() if r.source == "a"]
    target, mean = rows[0].target / rows[0].source_size, np.mean([r.liked or 1.0 for r in rows])
    assert target < 0.5 and abs(sum(r.taken for r in rows) - rows[0].target) <= 4
    for liked in (1.0, 3.0):
        share = np.mean([r.copies for r in rows if (r.liked or 1.0) == liked])
        assert abs(share - target * liked / mean) < 0.04


# --- quality ----------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in held]) > 0.97
    assert np.mean([r.keep for r in held if r.quality == 1]) > 0.98


def test_views_teach_each_other():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 1200).astype(float)
    shape = np.column_stack([y + 0.4 * r.normal(size=1200), *[r.normal(size=1200) for _ in range(12)]])
    cells = [np.unique(r.integers(0, 400, 20)).astype(np.int32) for _ in y]
    x = quality.Rows(shape, cells, np.column_stack([1 + y, 1 + r.integers(0, 60, 1200), r.normal(size=1200)]))
    pool = x.take(np.arange(200, 1000))

    def surest(model):
        out = []
        for p in model.scores(pool)[:2]:
            at = np.concatenate([np.argsort(p)[:50], np.argsort(-p)[:50]])
            out.append((pool.take(at), p[at]))
        return out

    model = quality.cotrain(x.take(np.arange(200)), y[:200], surest)
    a, b, s = model.scores(x.take(np.arange(1000, 1200)))
    assert model.taught == [(100, 100)] * quality.ROUNDS
    assert ((s > 0.5) == (y[1000:] == 1)).mean() > 0.97 and ((b > 0.5) == (y[1000:] == 1)).mean() > 0.95


def test_both_views_teach_on_the_corpus_and_labelled_rows_do_not_come_back(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels, added=40)
    assert all(text > 0 and meta > 0 for text, meta in model.taught)
    known = np.array([r.doc_id for r in labels.collect()])
    taken: set = set()
    rows = quality._surest(docs, model, known, taken, 25)
    assert not {d for d, _ in taken} & set(known.tolist()) and all(len(p) == len(x) > 25 for x, p in rows)
    again = quality.train(docs.repartition(5), labels, added=40)
    assert again.taught == model.taught and np.allclose(again.meta.weights, model.meta.weights)


def _plain_features(text):
    """Shape and cells, word by word."""
    words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    codes = [zlib.crc32(w.encode()) for w in words]
    pairs = [a << 32 | b for a, b in zip(codes, codes[1:], strict=False)]
    mixed = [(p * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 49 for p in pairs]
    n, m, lines = max(1, len(words)), max(1, len(words) - 1), text.split("\n")
    share = lambda f, of: sum(map(f, raw)) / of
    size = max(1, len(raw))
    shape = [
        np.log1p(len(words)), len(set(codes)) / n, max(Counter(codes).values(), default=0) / n, len(set(pairs)) / m, len(set(lines)) / len(lines), n / len(lines), len(text) / n,
        max(map(len, words), default=0), share(lambda b: 65 <= b < 91, size), share(lambda b: 48 <= b < 58, size), share(lambda b: 33 <= b < 127 and not chr(b).isalnum(), size), share(lambda b: b == 124, n), share(lambda b: b >= 128, size),
    ]
    return shape, sorted({c % quality.CELLS for c in codes + mixed})


def _some_texts(sf):
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]


def test_text_features_word_by_word_and_cheap(sf):
    """Three passes over all texts make them: the budget leaves each less than four times a plain search for words."""
    texts = _some_texts(sf)
    for t in [*texts, "", "a", "a b a b", " \n\x0b é\x85b\xa0c d \x1c e", "😀 ﬁ", "a\x1cb\x1fc", "\n\n"]:
        shape, cells = quality.text_features(t)
        want = _plain_features(t)
        assert np.allclose(shape, want[0], rtol=1e-12) and cells.tolist() == want[1]

    def seconds(f):
        times = []
        for _ in range(5):
            at = time.process_time()
            for t in texts:
                f(t)
            times.append(time.process_time() - at)
        return min(times)

    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert seconds(quality.text_features) < 4 * seconds(words.findall)


def test_a_worker_holds_features_of_few_rows(spark, sf):
    """A batch of Spark's has 10,000 rows; features of all at once took an executor over its memory."""
    import pyarrow as pa

    texts = [" ".join(t.split()[:60]) for t in _some_texts(sf)]
    kinds, runs = "doc_id long, text string, lang string, source string, n_chars long", []

    class Rows:
        schema = spark.createDataFrame([], kinds).schema
        columns = schema.names

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            runs.append(run)

    y = np.arange(40) % 2
    x = quality.rows_of(texts[:40], [("en", "a", 1)] * 40)
    model = quality.CoTrained(0.5, quality.Text().fit(x, y, np.ones(40)), quality.Meta().fit(x, y, np.ones(40)))
    quality.score(Rows(), model)
    some = (texts * (10_000 // len(texts) + 1))[:10_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(some), pa.array(["en"] * 10_000), pa.array(["a"] * 10_000), pa.array([1] * 10_000)], names=Rows.columns)
    tracemalloc.start()
    out = list(runs[0](iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.num_rows for b in out] == [10_000, 0] and peak < 16e6
    apart = model.scores(quality.rows_of(some[700:720], [("en", "a", 1)] * 20))
    assert np.allclose(out[0]["score"].to_numpy()[700:720], apart[2])


def test_the_driver_fits_on_some_documents_at_a_time():
    """Numbers for each cell of all labelled documents at once took the driver over its memory."""
    r = np.random.default_rng(5)
    cells = [np.flatnonzero(r.random(quality.CELLS) < 0.025).astype(np.int16) for _ in range(3000)]
    y = np.arange(3000) % 2
    x = quality.Rows(r.normal(size=(3000, 13)), cells, np.zeros((3000, 3)))
    tracemalloc.start()
    quality.Text().fit(x, y, np.ones(3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_a_worker_remembers_only_the_ids_of_words():
    """BPE's memory stays in the workers that the pipeline uses again."""
    from lexispan.llm.bpe import Bpe, tokenizer_path

    bpe, r = Bpe(tokenizer_path()), random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, 20_000, 500)]
    list(bpe.encode(texts[:1]))
    tracemalloc.start()
    for t in texts[1:]:
        list(bpe.encode([t]))
    bpe.pairs.clear()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / 19_500 < 180


class _Runs:
    """Stands for a table: keeps what would run on a worker."""

    def __init__(self, schema) -> None:
        self.schema, self.columns = schema, schema.names

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run


def test_the_next_operator_gets_the_memory_of_bpe_back(spark):
    """The pipeline's stages share workers: words that BPE remembers took the classifier over an executor's memory."""
    import pyarrow as pa

    from lexispan.llm import bpe

    docs = _Runs(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(50)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts), pa.array(["en"] * 600), pa.array(["a"] * 600), pa.array([450] * 600)], names=docs.columns)
    steps = [lambda: quality.score(docs, quality.CoTrained(1.0)), lambda: simhash.add_fingerprints(docs, 5)]
    for step in steps:
        tracemalloc.start()
        bpe.encode_documents(docs)
        out = list(docs.run(iter([batch])))
        assert sum(b.num_rows for b in out) == 600
        held = tracemalloc.get_traced_memory()[0]
        step()
        del out
        list(docs.run(iter([batch])))
        left = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert held > 10e6 and left < 2e6


def test_bpe_keeps_the_words_it_meets_and_forgets_the_others(monkeypatch):
    from lexispan.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    own, r, learned = bpe.Bpe(bpe.tokenizer_path()), random.Random(4), Counter()
    learn, most = own.learn, 0
    own.learn = lambda words: (learned.update(words), learn(words))
    often = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(100)]
    for _ in range(100):
        text = " " + " ".join(often + ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(200)])
        ((_, raw),) = own.encode([text])
        assert own.decode(np.frombuffer(raw, dtype="<u4")).decode() == text
        most = max(most, len(own.known) + len(own.older))
    assert all(learned[" " + w] == 1 for w in often)
    assert most < 2 * (1000 + 310)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_both_kinds_of_labels_all_is_kept(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.keep and r.score == 1.0 for r in out)


def test_fingerprints_have_64_samples_and_no_shortcut_shows(spark):
    r = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 60)))) for i in range(80)], "doc_id long, text string")
    full = sorted(map(tuple, weighted_sampling.edited_fingerprints(docs, enough=None).collect()))
    for enough in (weighted_sampling.ENOUGH, 0.7):  # the second leaves many samples without a draw at first
        assert sorted(map(tuple, weighted_sampling.edited_fingerprints(docs, enough=enough).collect())) == full
    assert len(full[0][3]) == 8 * 64


def test_next_in_order_with_far_ids(spark):
    ids = [9 * 10**18, *range(500), None]
    keys = spark.createDataFrame([(d, i, -i) for i, d in enumerate(ids)], "doc_id long, k1 long, k2 long")
    got = {r.k1: r.next.k1 for r in weighted_sampling.next_in_order(keys, rows_a_bin=50).collect()}
    order = [i for i, d in sorted(enumerate(ids), key=lambda x: (x[1] is None, -(x[1] or 0)))]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_small_texts_with_a_passage_in_common_make_few_pairs(spark, monkeypatch):
    passage = [f"p{i}" for i in range(32)]
    texts = [" ".join([*passage, *(f"own{i}x{j}" for j in range(6))]) for i in range(300)]
    texts += [texts[0] + " more", texts[7].removesuffix(" own7x5"), "front " + texts[7]]
    compared, link = [], simhash.link_components

    def counted(members, close, sketches, verify, *rest):
        return link(members, close, sketches, lambda pairs: compared.append(pairs.count()) or verify(pairs), *rest)

    monkeypatch.setattr(simhash, "link_components", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, labels = simhash.near_duplicate_groups(docs)
    groups: dict[int, set[int]] = {}
    for r in rows.join(labels, "node").collect():
        groups.setdefault(r.label, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[0, 300], [7, 301, 302]]
    assert sum(compared) < 5 * len(texts)  # before first shingles were compared: 45,000
