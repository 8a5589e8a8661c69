"""The compression classifier: held-out accuracy, and rows that say nothing."""

from __future__ import annotations

import zlib

import pytest

from normlearn.llm import quality as Q


@pytest.fixture(scope="module")
def larger(shipped):
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return shipped.read.parquet(f"{path}/documents.parquet"), shipped.read.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy(larger):
    docs, labels = larger
    model = Q.learn(docs, labels)
    found = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert len(found) == docs.count()
    rows = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(s.predicted == q for s, q in rows) / len(rows) > 0.97
    good = [s.predicted for s, q in rows if q]
    assert sum(good) / len(good) > 0.98
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    # calibrated: of rows scored around p, about p are good
    for low, high in ((0.0, 0.5), (0.5, 1.01)):
        part = [(s.score, q) for s, q in rows if low <= s.score < high]
        assert abs(sum(s for s, _ in part) / len(part) - sum(q for _, q in part) / len(part)) < 0.06
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in found.items() if r.predicted}


def test_held_out_labels_are_not_learned(larger):
    """Turning the labels of held-out rows around changes nothing."""
    from pyspark.sql import functions as F

    docs, labels = larger
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.learn(docs, labels, 300) == Q.learn(docs, turned, 300)


def test_edges(edge_docs, no_docs, larger):
    model = Q.learn(*larger, 600)
    found = Q.score(edge_docs, model).collect()
    assert len(found) == edge_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4)}) == 1
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert Q.score(no_docs, model).collect() == [] and Q.keep_good(no_docs, model).collect() == []
    assert Q.keep_good(edge_docs, model).columns == edge_docs.columns


def test_without_labels_every_score_is_the_prior(shipped, edge_docs):
    none = shipped.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1)], "doc_id long, quality int")
    model = Q.learn(edge_docs, none)
    assert not model.weights and all(r.score == model.prior for r in Q.score(edge_docs, model).collect())


def test_without_a_model_everything_is_kept(edge_docs):
    """Also where good labels are the rarer ones, so that the prior is below a half."""
    assert Q.keep_good(edge_docs, Q.fit([b"good"], [b"bad"] * 5)).count() == edge_docs.count()


def test_long_texts_leave_their_places_in_the_sample(shipped):
    rows = [(k, f"text {k} " * (9000 if k % 2 else 3), k // 2 % 2) for k in range(160)]
    table = lambda some: shipped.createDataFrame(some, "doc_id long, text string, quality int")
    whole, short = table(rows), table(rows[::2])
    learned = Q.learn(whole, whole.select("doc_id", "quality"), 12)
    assert learned.prior == 0.5 and learned == Q.learn(short, short.select("doc_id", "quality"), 12)


def test_scores_are_those_of_the_formula(larger):
    """Every score again, text by text: two compressed sizes, their differences, the calibration."""
    import math

    import zstandard

    docs, labels = larger
    model = Q.learn(docs, labels, 400)
    coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (model.good, model.bad)]
    rows = docs.limit(2000)
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    for r in Q.score(rows, model).collect():
        good, bad = (len(c.compress(texts[r.doc_id])) for c in coders)
        n = max(1, len(texts[r.doc_id]))
        per_byte, shrunk = (bad - good) / n, min((good + bad) / (2 * n), 1.5)
        x = [per_byte, (bad - good) / (good + bad), shrunk, shrunk * shrunk, math.log(n), per_byte * math.log(n)]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def test_the_difference_alone_ranks_texts(larger):
    """Of a good and a bad held-out text, the compressed sizes' difference puts the good one first nearly always."""
    import numpy as np

    docs, labels = larger
    scorer = Q.Scorer(Q.learn(docs, labels))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in docs.filter(Q.held_out(docs["doc_id"])).collect() if r.doc_id in quality]
    x = scorer.features([(r.text or "").encode() for r in rows])[:, 0]
    y = np.array([quality[r.doc_id] for r in rows])
    order = (x[y == 1][:, None] > x[y == 0][None, :]).mean()
    assert order > 0.97


def test_repeated_ids_do_not_enlarge_the_sample(shipped):
    rows = [(k % 40, f"text number {k % 40} with copy {k} " * 5, k % 2) for k in range(4000)]
    table = shipped.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = shipped.createDataFrame([(k, k % 2) for k in range(40)] * 5, "doc_id long, quality int")
    assert Q.learn(table, labels, 30) == Q.learn(table.repartition(5), labels.distinct(), 30)
