"""Language-model scoring against counts in dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from normlearn.llm import lm_scoring as M
from normlearn.llm.near_dup import word_hashes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return [w.lower() for w in WORDS.findall((text or "").encode())]


def brute(docs, target, spec):
    """(score rows) by dictionaries."""
    count = Counter(w for t in docs for w in words_of(t))
    hashes = dict(zip(count, word_hashes(*_flat(count), spec.key or 0)[0].view(np.int64).tolist(), strict=True)) if count else {}
    known = set(sorted(count, key=lambda w: (-count[w], hashes[w]))[: spec.words])  # None: all

    def line(text):
        return ["<s>", *[w if w in known else "<unk>" for w in words_of(text)], "</s>"]

    def model(texts):
        single, double, context = Counter(), Counter(), Counter()
        for t in texts:
            x = line(t)
            single.update(x[1:])
            context.update(x[:-1])
            double.update(zip(x, x[1:]))
        total = sum(single.values())

        def loss(a, b):
            p1 = (single[b] + spec.extra) / (total + spec.extra * (len(known) + 2))
            share = context[a] / (context[a] + spec.pull)
            return -math.log(share * double[a, b] / max(context[a], 1) + (1 - share) * p1)

        return loss

    models = model(target), model(docs)
    out = []
    for t in docs:
        x = line(t)
        means = [sum(m(a, b) for a, b in zip(x, x[1:])) / (len(x) - 1) for m in models]
        out.append((len(x) - 2, *means))
    return out


def _flat(words):
    raw = b" ".join(words)
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


@pytest.mark.parametrize("spec", [M.LmSpec(), M.LmSpec(words=20, key=77)])
@pytest.mark.parametrize("which", ["edge_docs", "documents"])
def test_losses(request, shipped, which, spec):
    docs = request.getfixturevalue(which)
    target = shipped.createDataFrame([("the quick brown dog runs",), ("over the lazy fox",), (None,)], "text string")
    texts = [r.text for r in docs.collect()][:200]
    ids = [r.doc_id for r in docs.collect()][:200]
    part = shipped.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = M.score(part, target, spec).collect()
    expected = brute(texts, ["the quick brown dog runs", "over the lazy fox", None], spec)
    a = np.array(sorted((r.n_words, r.target_loss, r.background_loss) for r in found))
    assert a == pytest.approx(np.array(sorted(expected)), abs=1e-9)
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in found)


def test_target_texts_score_lowest(shipped, sf_dir):
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet")
    target = docs.filter("lang = 'fr'").limit(10)
    ids = {r.doc_id for r in target.collect()}
    found = sorted(M.score(docs, target).collect(), key=lambda r: r.score)
    assert sum(r.doc_id in ids for r in found[: len(ids) + 5]) >= 0.8 * len(ids)


def test_edges(shipped, edge_docs, no_docs):
    target = shipped.createDataFrame([("the",)], "text string")
    found = M.score(edge_docs, target).collect()
    assert len(found) == edge_docs.count() and all(math.isfinite(r.score) for r in found)
    assert len({(r.target_loss, r.background_loss) for r in found if r.doc_id in (3, 4, 5)}) == 1
    assert M.score(no_docs, target).collect() == []
    none = M.score(edge_docs, no_docs).collect()
    assert len(none) == len(found) and all(math.isfinite(r.score) for r in none)


def test_models_hold_every_word_and_bigram(shipped):
    """More words and bigrams than a model of fixed size has room for, and each counts by itself."""
    texts = [" ".join(f"w{(k * 997 + j * j) % 60_000}" for j in range(600)) for k in range(400)]
    assert len({w for t in texts for w in words_of(t)}) > 50_000
    target = texts[::40]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = M.score(docs, shipped.createDataFrame([(t,) for t in target], "text string"))
    expected = brute(texts, target, M.LmSpec())
    for r in found.collect():
        n, of_target, of_all = expected[r.doc_id]
        assert (r.n_words, r.target_loss, r.background_loss) == (n, pytest.approx(of_target), pytest.approx(of_all))


def test_chunks_do_not_change_the_losses(shipped, documents, monkeypatch):
    target = documents.limit(5)
    rows = lambda: sorted((r.doc_id, r.n_words, round(r.score, 9)) for r in M.score(documents, target).collect())
    whole = rows()
    monkeypatch.setattr(M, "CHUNK_BYTES", 5000)
    assert rows() == whole


def test_parts_of_the_key_space_do_not_change_the_losses(shipped, documents, monkeypatch):
    docs, target = documents.limit(60), documents.limit(5)
    rows = lambda: sorted((r.doc_id, r.n_words, round(r.score, 9)) for r in M.score(docs, target).collect())
    whole = rows()
    words = sum(n + 1 for _, n, _ in whole)
    parts = int(shipped.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(M, "PART_KEYS", 2 * words // (4 * parts))  # some times as many
    assert rows() == whole


def test_query_matches_its_sql(shipped, sf_dir, same_rows):
    same_rows(M.op7_lm_scoring(shipped, sf_dir), M.ORACLE)
