"""Exact dedup against a dictionary of normalised texts."""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from normlearn.llm import exact_dedup as D

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(text):
    return (text or "").translate(LOWER)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(docs, **options):
    found = D.exact_dedup(docs, **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == brute(docs.collect())
    stay = defaultdict(list)
    for r in found:
        stay[r.text_sha256].append((r.kept, r.doc_id, r.keep_id))
    for rows in stay.values():
        assert sum(kept for kept, _, _ in rows) == 1
        assert all(doc_id == keep_id for kept, doc_id, keep_id in rows if kept)


def test_edges(edge_docs):
    check(edge_docs)


@pytest.mark.parametrize("size", [1, 3, 16])
def test_block_sizes(edge_docs, size):
    check(edge_docs.filter("length(text) < 200 or text is null"), block_bytes=size)


def test_names_do_not_depend_on_the_hash(edge_docs):
    """A hash that is the same for all blocks of a length still gives right names."""
    check(edge_docs.filter("length(text) < 200 or text is null"), block_bytes=4, block_hash=lambda b: F.octet_length(b).cast("long"))


def test_texts_with_equal_blocks_in_another_order(shipped):
    texts = ["aabb", "bbaa", "aabbaabb", "aabb", "aabba", "aabbaa", "aabbaabb", "AABB"]
    check(shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=2)


def test_empty(no_docs):
    assert D.exact_dedup(no_docs).collect() == []
    assert D.keep_one(no_docs).columns == no_docs.columns


def test_keep_one_row_of_each_text(edge_docs):
    kept = D.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {plain(r.text) for r in edge_docs.collect()}


def test_query_matches_its_sql(shipped, sf_dir, same_rows):
    same_rows(D.op10_exact_dedup(shipped, sf_dir), D.ORACLE)


def test_plan_has_no_python(edge_docs):
    plan = D.exact_dedup(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_are_ranks_and_do_not_depend_on_partitions(documents):
    names = []
    for parts in (1, 7):
        rows = D.block_identities(documents.repartition(parts), block_bytes=64).collect()
        names.append(sorted((r.doc_id, r.n_blocks, r.name) for r in rows))
    assert names[0] == names[1]
    singles = sorted({(plain(r.text).encode()[:32], name) for r, (_, n, name) in zip(sorted(documents.collect(), key=lambda r: r.doc_id), names[0], strict=True) if n == 1})
    ranks = [name for _, name in singles]
    assert all(a[1] < b[1] for a, b in zip(singles, singles[1:]) if a[0] < b[0]) and len(ranks) > 3


def test_keep_one_of_many_rows_without_an_id(shipped):
    rows = [(None, "the same text")] * 500 + [(None, "other")] * 2 + [(1, "the same text")]
    kept = D.keep_one(shipped.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == [(1, "the same text"), (None, "other")]
