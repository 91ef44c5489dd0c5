"""Bloom filters and exact dedup against a direct grouping."""

import hashlib
from collections import defaultdict

import pytest

from colloquy.llm import bloom
from colloquy.llm.exact_dedup import copy_groups, drop_copies, flag_repeats

SCHEMA = "doc_id long, text string, maybe boolean, h long, sha string"


def rows():
    out = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"text {i % 40}") for i in range(120)]
    out += [(2000 + i, "hot") for i in range(400)] + [(5, "text 5"), (None, "text 7"), (None, "lone"), (None, "lone")]
    return [*out, (3000, ""), (3001, None), (3002, " "), (3003, "é"), (3004, "é"), (2399, "hot")]


def brute(data):
    groups = defaultdict(list)
    for d, t in data:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(t.encode()).hexdigest(), True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, sha))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, None, 1, "x") for d, t in rows()], SCHEMA)


@pytest.mark.parametrize("mb", [64, 0])
def test_groups(spark, docs, mb, monkeypatch):
    if mb == 0:  # one block for everything: many false hits, same result
        monkeypatch.setattr(bloom, "BITS_PER_ROW", 0)
    got = copy_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(
        ((d, t) for d, t in {(k, s) for _, k, _, y, s in brute(rows()) if y} for d, t in [(d, next(
            x or "" for _, x in rows() if hashlib.sha256((x or "").encode()).hexdigest() == t))]), key=str)


def test_unique_rows_pass(spark, docs):
    flagged = {(r["_row"].doc_id, r.maybe) for r in flag_repeats(docs).collect()}
    assert all((i, True) in flagged for i in range(40))
    assert sum(1 for i in range(40, 300) if (i, True) in flagged) < 10


def test_filter_has_no_false_negatives(spark):
    inside = spark.range(2000).selectExpr("xxhash64(id) AS h")
    blocks = bloom.filter_blocks(2000)
    filters = bloom.build_filter(inside, blocks)
    asked = spark.range(20_000).selectExpr("id", "xxhash64(id) AS h")
    hits = bloom.apply_filter(asked, "h", filters, blocks, "hit").where("hit")
    assert hits.where("id < 2000").count() == 2000 and hits.count() < 2400


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert copy_groups(none).count() == 0 and drop_copies(none).count() == 0
