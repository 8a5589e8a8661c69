"""The pipeline's stages against plain versions on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as P
import pytest

from normlearn.llm import quality

from .test_exact_dedup import plain
from .test_near_dup import brute


@pytest.fixture(scope="module")
def steps(shipped, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(shipped, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(shipped.read.parquet(f"{folder}/{k}"))
    return out


def test_columns(steps):
    for frame in steps[1:-1]:
        assert frame.dtypes == steps[0].dtypes


def test_quality_rejects_what_the_classifier_rejects(shipped, sf_dir, steps):
    model = quality.learn(steps[0], shipped.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score(steps[0], model).collect() if r.predicted}
    assert {r.doc_id for r in steps[1].collect()} == good


def test_exact_copies_go(steps):
    last = {}
    for r in steps[1].collect():
        last[plain(r.text)] = max(r.doc_id, last.get(plain(r.text), r.doc_id))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(last.values())


def test_near_copies_go(steps):
    expected = [doc_id for doc_id, _, component in brute(steps[2].collect(), 80) if doc_id == component]
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(expected)


def test_mixed_texts_are_prefixes(steps):
    texts = {r.doc_id: r.text or "" for r in steps[3].collect()}
    for r in steps[4].collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)


def test_everything_is_packed(steps, library):
    rows = steps[4].collect()
    total = sum(len(e.ids) + 1 for e in library.encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False))
    assert sum(r.length for r in steps[5].collect()) == total


def test_run_gives_the_rows_of_the_stages(shipped, sf_dir, steps):
    """All but the windows, which depend on how rows are dealt to tasks."""
    pieces = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    found = P.run(shipped, sf_dir).collect()
    assert pieces(found) == pieces(steps[5].collect())
    assert sum(r.length for r in found) == sum(r.length for r in steps[5].collect())


def plain_stages(rows, good, percent=80):
    """Texts that stay after the first three stages, by dictionaries and all pairs, for rows with different ids."""
    rows = [r for r in rows if r.doc_id in good]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[plain(r.text)] = r
    rows = list(last.values())
    return [r for r, (doc_id, _, component) in zip(rows, brute(rows, percent), strict=True) if doc_id == component]


def test_stages_together_are_the_plain_version(shipped, sf_dir, steps):
    model = quality.learn(steps[0], shipped.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score(steps[0], model).collect() if r.predicted}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(r.doc_id for r in plain_stages(steps[0].collect(), good))


@pytest.fixture
def edge_dir(shipped, edge_docs, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names; labels with nulls and repeats."""
    edge_docs.unionByName(edge_docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 0), (3, 0, 0), (8, 1, 1), (99, 0, 1)]
    shipped.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_edge_rows_through_all_stages(shipped, edge_dir):
    docs = shipped.read.parquet(f"{edge_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(shipped, docs, edge_dir).write.parquet(f"{edge_dir}/stage-{k}")
        docs = shipped.read.parquet(f"{edge_dir}/stage-{k}")
        assert docs.columns == columns
        kept.append(docs.count())
    # too few labels for a model: all stay; then one row of each text, of which no two are near copies
    texts = {plain(r.text) for r in shipped.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    assert kept[1] == kept[0] and kept[2] == len(texts) and kept[3] == kept[2]
    assert len({(r.doc_id, r.doc_tokens) for r in P.run(shipped, edge_dir).collect()}) > 0


def test_empty_tables_through_all_stages(shipped, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = P.run(shipped, str(tmp_path))
    assert found.collect() == [] and "sequence_id" in found.columns


def test_only_null_rows_through_all_stages(shipped, tmp_path):
    rows = [(None, None, None, None, None)] * 3
    shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # a text without tokens is never taken into the mix
    assert P.run(shipped, str(tmp_path)).collect() == []
