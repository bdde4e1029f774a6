"""Every operator: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from lexispan.llm import bpe, licenses, line_dedup, media, mixing, quality, secrets, simhash, token_store, weighted_sampling

LABELS = "doc_id long, quality int, toxic int"


def _media(d):
    return media.read_media(media.store_texts(d))


def _quality(d):
    return quality.classify(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], LABELS))


OPERATORS = {
    "line_dedup": line_dedup.dedup_lines, "cws": weighted_sampling.edited_fingerprints, "quality": _quality, "media": _media, "simhash": simhash.simhash_components,
    "secrets": secrets.scan_secrets, "mix": mixing.mix, "tokens": lambda d: token_store.read_tokens(token_store.write_tokens(d)), "licenses": licenses.scan_licenses, "bpe": bpe.encode_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_back(name, odd):
    out = OPERATORS[name](odd).select("doc_id").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_empty_table(name, none):
    assert OPERATORS[name](none).count() == 0


CLASHES = ["key", "line_no", "n_lines", "size", "target", "copies", "feature", "media", "spans", "n_tokens", "score", "keep", "licenses", "fp", "node", "label", "bucket"]


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_may_have_any_name(name, odd):
    plain = OPERATORS[name](odd)
    known = set(odd.columns)
    shared = [c for c in plain.columns if c not in ("fp",)]
    clashing = OPERATORS[name](odd.withColumns({c: F.lit("mine") for c in CLASHES if c not in known}))
    a = sorted(map(str, plain.select(*shared).collect()))
    b = sorted(map(str, clashing.select(*shared).collect()))
    assert a == b


def test_equal_rows_get_equal_values(odd):
    for name in ("line_dedup", "cws", "media", "simhash", "secrets", "licenses", "bpe"):
        rows = [tuple(r) for r in OPERATORS[name](odd).where("doc_id = 5").collect()]
        assert len(rows) == 3 and len(set(rows)) == 2, name


def test_near_duplicates_on_odd_rows(odd, none):
    kept = simhash.drop_near_duplicates(odd)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(5) == 3 and 1 in ids and 2 not in ids and None in ids  # texts without words are one group
    assert simhash.drop_near_duplicates(none).count() == 0
