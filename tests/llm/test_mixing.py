"""The mix against recursive water filling and a sorted prefix, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from normlearn.llm import mixing as M

SPEC = M.MixSpec()


def fill(budget, children):
    """[(key, cap, weight)] -> allocations: by weight, what one cannot take goes to the others."""
    given, left = {}, {k: (c, w) for k, c, w in children}
    budget = min(budget, sum(c for _, c, _ in children))
    rest = budget
    while left:
        total = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if Fraction(rest * w, total) >= c]
        if not full:
            break
        for k in full:
            given[k] = left.pop(k)[0]
        rest = budget - sum(given.values())
    for k, (c, w) in left.items():
        given[k] = Fraction(rest * w, sum(w for _, w in left.values()))
    return given


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def domain(source, spec):
    number = re.search(r"([0-9]+)$", source or "")
    return f"d{(int(number[1][-9:]) if number else 0) % spec.domains}"


def check(docs, spec=SPEC):
    rows = docs.collect()
    found = M.take(docs, spec).collect()
    assert len(found) == len(rows)
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in rows:
        tree[domain(r.source, spec)][r.lang][r.source] += words(r.text)
    total = sum(n for a in tree.values() for b in a.values() for n in b.values())
    taken = defaultdict(int)
    for r in found:
        assert r.domain == domain(r.source, spec)
        assert r.tokens_taken == r.copies * r.n_tokens + r.partial_tokens
        assert 0 <= r.partial_tokens < max(r.n_tokens, 1)
        taken[r.domain, r.lang, r.source] += r.tokens_taken
    weight = lambda weights, k: weights.get(k, spec.default_weight)
    cap = lambda node: spec.max_epochs * (node if isinstance(node, int) else sum(cap(c) // spec.max_epochs for c in node.values()))
    top = fill(total * spec.budget[0] // spec.budget[1], [(k, cap(v), weight(spec.domain_weights, k)) for k, v in tree.items()])
    for d, langs in tree.items():
        middle = fill(top[d], [(k, cap(v), weight(spec.lang_weights, k)) for k, v in langs.items()])
        for lang, sources in langs.items():
            low = fill(middle[lang], [(k, cap(v), weight(spec.source_weights, k)) for k, v in sources.items()])
            for source in sources:
                # rounded at each of three levels
                assert abs(taken[d, lang, source] - low[source]) <= 3
    assert sum(taken.values()) == min(total * spec.budget[0] // spec.budget[1], total * spec.max_epochs)
    # in the test tables rows without an id have different numbers of words
    prefixes(found, spec, {words(r.text): f"null:{hashlib.md5((r.text or '').encode()).hexdigest()}" for r in rows if r.doc_id is None})


def prefixes(found, spec, own):
    """In each leaf the last epoch takes a prefix of its seeded order, the last document of it in part."""
    leaves = defaultdict(list)
    for r in found:
        if r.n_tokens:
            leaves[r.domain, r.lang, r.source].append(r)
    for rows in leaves.values():
        epochs = min(r.copies for r in rows)
        key = lambda r: (hashlib.md5(f"{spec.seed}:{epochs}:{own[r.n_tokens] if r.doc_id is None else r.doc_id}".encode()).hexdigest())  # noqa: B023,E731
        ordered = sorted(rows, key=lambda r: (key(r), r.doc_id is not None, r.doc_id or 0, r.n_tokens))
        state = [2 if r.copies > epochs else 1 if r.partial_tokens else 0 for r in ordered]
        assert state == sorted(state, reverse=True) and state.count(1) <= 1


@pytest.mark.parametrize(
    "spec",
    [
        SPEC,
        M.MixSpec(budget=(3, 1), max_epochs=4),
        M.MixSpec(budget=(100, 1)),
        M.MixSpec(budget=(1, 50), lang_weights={"fr": 100}, source_weights={"src1": 50}),
        M.MixSpec(domains=1, budget=(0, 1)),
    ],
)
def test_budgets_and_prefixes(documents, edge_docs, spec):
    check(edge_docs, spec)
    check(documents, spec)


def test_shortage_goes_to_siblings_before_others(shipped):
    """src0 of d0 has too little; what is missing goes to src4 of the same language, not to d1."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(2), "en", "src0"), (2, text(100), "en", "src4"), (3, text(100), "en", "src1")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spec = M.MixSpec(domains=4, domain_weights={"d0": 1, "d1": 1}, budget=(60, 202), max_epochs=1)
    taken = {r.doc_id: r.tokens_taken for r in M.take(docs, spec).collect()}
    assert taken == {1: 2, 2: 28, 3: 30}


def test_mixed_rows(documents, edge_docs):
    for docs in (edge_docs, documents):
        plan = defaultdict(int)
        for r in M.take(docs).collect():
            plan[r.doc_id, r.n_tokens] += r.tokens_taken
        rows = M.mix(docs)
        assert rows.columns == docs.columns
        texts = defaultdict(set)
        for r in docs.collect():
            texts[r.doc_id].add(r.text or "")
        total = 0
        for r in rows.collect():
            assert any(t.startswith(r.text) for t in texts[r.doc_id])
            total += words(r.text)
        assert total == sum(plan.values())


def test_many_rows_without_an_id_are_not_sorted_in_one_bucket(shipped):
    """A third of all rows has no id, a third no tokens."""
    rows = [(k if k % 3 else None, "" if k % 3 == 1 else f"w{k} " * (1 + k % 7), "en", "src1") for k in range(900)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = M.take(docs, M.MixSpec(budget=(1, 2))).collect()
    total = sum(words(r[1]) for r in rows)
    assert len(found) == 900 and sum(r.tokens_taken for r in found) == total // 2
    placed = M._ordered(M._narrow(docs, SPEC, "doc_id", "text"), shipped.createDataFrame([("d1\x1f=en\x1f=src1", 0)], "__leaf string, __epochs long"), SPEC)
    assert max(r["count"] for r in placed.filter("__n > 0").groupBy("__d0", "__d1").count().collect()) < 5


def test_empty(no_docs):
    assert M.take(no_docs).collect() == []
    assert M.mix(no_docs).collect() == []


def test_query_matches_its_sql(shipped, sf_dir, same_rows):
    same_rows(M.op1_source_mix(shipped, sf_dir), M.oracle())


def test_plan_has_no_python(edge_docs):
    plan = M.take(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
