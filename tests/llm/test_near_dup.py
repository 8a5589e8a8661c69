"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest

from normlearn.llm import near_dup as N
from normlearn.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, percent):
    """(doc_id, set size, component) of each row, by comparing all pairs."""
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    label[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, r in enumerate(rows):
        ids = least.setdefault(find(k), [])
        if r.doc_id is not None:
            ids.append(r.doc_id)
    return [(r.doc_id, len(s), min(least[find(k)], default=None) if s else r.doc_id) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def check(docs, spec=N.JoinSpec()):
    found = N.near_duplicates(docs, spec).collect()
    expected = brute(docs.collect(), spec.percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=str) == sorted(expected, key=str)
    for r in found:
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)


@pytest.mark.parametrize("which", ["edge_docs", "documents", "no_docs"])
def test_tables(request, which):
    check(request.getfixturevalue(which))


def copies(n, edits, length, seed, start=0):
    """Texts from one text with some words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        yield start + k, " ".join(words)


@pytest.mark.parametrize("spec", [N.JoinSpec(), N.JoinSpec(percent=80), N.JoinSpec(small=8), N.JoinSpec(small=8, depth=2)])
def test_a_large_group_of_near_copies(shipped, spec):
    """Nodes branch several times, and with little depth they are compared in blocks."""
    rows = [*copies(150, 6, 120, 1), *copies(60, 2, 90, 2, 1000), *copies(40, 30, 150, 3, 2000)]
    rows += [(3000 + k, f"common passage of words that many texts share in the middle {'z' * k} end {k}") for k in range(60)]
    check(shipped.createDataFrame(rows, "doc_id long, text string"), spec)


def test_rows_compared_grow_with_a_group_and_not_with_its_square(shipped, monkeypatch):
    """Members of the groups that are compared, for groups of near copies of two sizes, with some texts that link with few."""
    candidates, met = N._candidates, []

    def counted(lists, *more):
        met.append(sum(len(r.members) for r in lists.collect()))
        return candidates(lists, *more)

    monkeypatch.setattr(N, "_candidates", counted)
    each = []
    for n in (100, 400):
        met.clear()
        rows = [*copies(n, 3, 300, 1), *((5000 + k, t) for k, (_, t) in enumerate(copies(12, 30, 300, 1)))]
        docs = shipped.createDataFrame(rows, "doc_id long, text string")
        check(docs, N.JoinSpec(percent=80, small=16, key=1))
        each.append(sum(met) / len(rows))
    assert each[1] < 1.5 * each[0]


def test_isolated_pairs_in_a_large_group_of_unlike_texts(shipped):
    """Pages of one template (similarity 0.70), some of them in pairs just above the threshold, at nodes of many levels."""
    template = [f"t{k}" for k in range(160)]
    rows = []
    for k in range(500):
        own = [f"p{k}x{j}" for j in range(34)]
        rows.append((k, " ".join(template + own)))
        if k < 100:
            rows.append((1000 + k, " ".join(template + own[:14] + [f"q{k}x{j}" for j in range(20)])))
    spec = N.JoinSpec(percent=80, small=4)
    found = N.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string"), spec).collect()
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.80 < len(a & b) / len(a | b) < 0.82
    missed = [r.doc_id for r in found if r.component_id != r.doc_id % 1000]
    assert missed == []


def test_threshold_is_exact(shipped):
    """17 of 20 shingles in common is a link, one less is not."""
    base = [f"a{k}" for k in range(22)]
    for extra, linked in ((2, True), (4, False)):
        other = base[: 22 - 0] + [f"b{k}" for k in range(extra)]
        docs = shipped.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        assert (100 * len(a & b) >= 85 * len(a | b)) == linked
        assert ({r.component_id for r in N.near_duplicates(docs).collect()} == {1}) == linked


def test_shingle_hashes_are_those_of_words():
    texts = ["One two three FOUR five six", "", "a b", "  x\ty ", "one two three four five six", "b a"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, bounds = N.shingle_hashes(*N.word_hashes(np.frombuffer(raw, np.uint8), offsets), 5)
    sets = [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 0, 1, 1, 2, 1]
    assert sets[0] == sets[4] and sets[2] != sets[5]


def test_exact_sets_of_any_size():
    rng = np.random.default_rng(1)
    members = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 50, 80, 100, 120, 100)]
    linked = N.linked_sets(members, 85)
    for a, x in enumerate(members):
        for b, y in enumerate(members):
            common = len(np.intersect1d(x, y))
            assert linked[a, b] == (100 * common >= 85 * (len(x) + len(y) - common))


def test_keep_one(shipped, edge_docs):
    kept = N.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 3, 4, 5, 6, 8, 8, 8, None, None, 9, 10, 11, -5], key=str)


def test_keep_one_where_ids_repeat(shipped):
    """Exactly the rows marked kept stay, and one of two near copies with the same id."""
    base = [f"a{k}" for k in range(60)]
    near, other = " ".join([*base[:-1], "z"]), " ".join(f"b{k}" for k in range(30))
    twice, nearly = " ".join(f"c{k}" for k in range(60)), " ".join([*(f"c{k}" for k in range(59)), "y"])
    rows = [(1, " ".join(base)), (2, near), (2, other), (2, ""), (3, twice), (3, nearly), (4, twice), (5, near)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in N.keep_one(docs).collect()]
    threes = [k for k in kept if k[0] == 3]
    assert len(threes) == 1 and threes[0] in rows
    assert sorted(k for k in kept if k[0] != 3) == sorted([rows[0], rows[2], rows[3]])


def test_components_of_chains_stars_and_nothing(shipped):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200), (200, 300)]
    found = {r.u: r.v for r in components(shipped.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 150), 100), 300: 200}
    assert components(shipped.createDataFrame([], "u long, v long")).collect() == []


def test_query_matches_its_sql(shipped, sf_dir, same_rows):
    same_rows(N.op8_near_dup(shipped, sf_dir), N.ORACLE)


def test_words_with_equal_polynomial_hashes_are_not_linked(shipped):
    """Thue-Morse words and their complements: every polynomial modulo 2^64 gives both the same value."""
    words = ["".join("ab"[k.bit_count() & 1] for k in range(n)) for n in (16, 64, 1024, 4096)]
    other = str.maketrans("ab", "ba")
    texts = [t for w in words for t in (w, w.translate(other), f"a b {w} c d e", f"a b {w.translate(other)} c d e")]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)
    assert N.keep_one(docs, N.JoinSpec(percent=80)).count() == len(texts)


def test_keys_change_hashes_and_no_result(shipped, documents):
    raw, offsets = np.frombuffer(b"one two " + b"x" * 70, np.uint8), np.array([0, 78])
    a, b = N.word_hashes(raw, offsets, 1)[0], N.word_hashes(raw, offsets, 2)[0]
    assert len(a) == 3 and not set(a.tolist()) & set(b.tolist())
    rows = [sorted(map(tuple, N.near_duplicates(documents, N.JoinSpec(key=k)).drop("class_key").collect())) for k in (1, 2)]
    assert rows[0] == rows[1]


def test_pairs_beside_a_connected_group(shipped):
    """In nodes of texts that are mostly linked, a pair that only links with each other is found, with one pick a level and one tree."""
    template = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join([*template, f"own{k}"])) for k in range(300)]  # all linked
    for k in range(12):  # 0.77 to the others, 0.9 to each other
        own = [f"p{k}x{j}" for j in range(50)]
        rows.append((1000 + 2 * k, " ".join(template[:190] + own)))
        rows.append((1001 + 2 * k, " ".join(template[:190] + own[:38] + [f"q{k}x{j}" for j in range(12)])))
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    check(docs, N.JoinSpec(small=8, trees=1, picks=(1,)))


def test_groups_of_many_shingles_are_compared_in_parts(shipped):
    rng = np.random.default_rng(3)
    spec = N.JoinSpec(shingles=1000)
    for _ in range(30):
        size = rng.integers(1, 700, 40)
        cid = rng.permutation(100)[:40]
        groups = N.parted(cid, size, spec)
        of = dict(zip(cid.tolist(), size.tolist(), strict=True))
        together = {(a, b) for g in groups for a in g.tolist() for b in g.tolist()}
        for a, m in of.items():
            for b, n in of.items():
                assert (a, b) in together or 100 * min(m, n) < 85 * max(m, n) or a == b
        assert all(sum(of[c] for c in g.tolist()) <= 1000 or sum(of[c] > 500 for c in g.tolist()) for g in groups)
    rows = [*copies(60, 6, 120, 1), *copies(30, 3, 90, 2, 1000)]
    check(shipped.createDataFrame(rows, "doc_id long, text string"), spec)


def test_recall_of_queries_in_deep_nodes(shipped):
    """Rows whose id is divisible by 50 against all rows, where nodes branch over many levels."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(1200):  # similarity of about 0.6 between texts; every fifth has a partner at the threshold
        words = list(base)
        for j in rng.sample(range(150), 7):
            words[j] = f"c{k}x{j}"
        rows.append((2 * k, " ".join(words)))
        if k % 5 == 0:
            near = list(words)
            for j in (3, 90):
                near[j] = f"d{k}x{j}"
            rows.append((2 * k + 1, " ".join(near)))
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs, N.JoinSpec(small=4, depth=12)).collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) >= 40 and sum(found[a] == found[b] for a, b in links) >= 0.98 * len(links)


def test_large_offsets():
    import pyarrow as pa

    for kind in (pa.binary(), pa.large_binary()):
        raw, offsets = N.bytes_of(pa.array([b"ab", b"", b"cde"], kind).slice(1))
        assert raw.tobytes() == b"cde" and offsets.tolist() == [0, 0, 3]
