"""Pre-tokens, counts, packing and token files against the library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normlearn.llm import packing, pretokens, token_counts, token_files


def coded(library, texts):
    return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.fixture(scope="module")
def table():
    return pretokens.Table(token_counts.vocabulary(), bits=12, pool=1 << 12)  # so small that entries are replaced


def test_random_texts(library, table):
    rng = random.Random(5)
    parts = list("ab s't're've'll'd'm  \n\n\t\r\x0b\x85\xa0é1²½ß.,-''\"ÀÑ\x1c\x1f…İǅ") + ["<|endoftext|>", "日本", "'s", "'ll", " '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F)), max_size=8))
def test_any_latin_texts(library, table, texts):
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)


def test_long_texts_come_in_parts(library, table, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK", 50)
    texts = ["it's a  long text,\n with we'll  and 123 numbers \xa0 " * 30, "x" * 400, " " * 300, "a " * 200, "", "é'll " * 60]
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)
    assert [x.tolist() for x in table.ids(texts, 7)] == [x + [7] for x in coded(library, texts)]


def complement(text):
    return text.translate(str.maketrans("ab", "ba"))


def thue_morse(n):
    """A word whose polynomial hashes modulo 2^64 equal those of its complement, whatever their base."""
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


ADVERSARIAL = [x for k in range(2, 13) for w in [thue_morse(1 << k)] for x in (w, complement(w), f"{w} {complement(w)}", f"日本{w}")]


def test_equal_hashes_are_no_equal_pretokens(library, table):
    """Ids come from the same bytes, whatever their hash: adversarial words, and words that share all slots."""
    assert [x.tolist() for x in table.ids(ADVERSARIAL)] == coded(library, ADVERSARIAL)
    words = [complement(ADVERSARIAL[-4]), thue_morse(1024), complement(thue_morse(1024))]
    counts = token_counts.count_texts(words, token_counts.vocabulary(), token_counts.hot_table(words[:2], token_counts.vocabulary()))
    assert counts.tolist() == [len(x) for x in coded(library, words)]


def test_equal_keys_for_all(library, monkeypatch):
    """With one hash for all pre-tokens everything is compared by its bytes."""
    monkeypatch.setattr(pretokens, "scrambled", lambda x: x * np.uint64(0))
    table = pretokens.Table(token_counts.vocabulary(), bits=4)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(20)) for _ in range(300)]
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)


def test_random_pretokens(library, table):
    rng = random.Random(9)
    alphabet = list("abeinrst '“”’—…дожирувпч日本語の漢字テスト😀👍🏽12٣५　\u2028é\x00")
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(50)) for _ in range(2000)]
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=8))
def test_any_texts(library, table, texts):
    assert [x.tolist() for x in table.ids(texts)] == coded(library, texts)


def test_classes_are_the_librarys(library):
    """Letters, numbers and white space of all code points that are assigned here."""
    codes = [c for c in range(pretokens.LAST) if not 0xD800 <= c < 0xE000 and pretokens._classes()[c]]
    for kind, before in ((pretokens.LETTER, "a"), (pretokens.NUMBER, "1"), (pretokens.OTHER, "!")):
        for at in range(0, len(codes), 20000):
            part = codes[at : at + 20000]
            starts = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str("".join(before + chr(c) for c in part))}
            assert [c for k, c in enumerate(part) if 2 * k + 1 not in starts] == [c for c in part if pretokens._classes()[c] == kind]


def known(docs, library):
    rows = docs.collect()
    return [(r.doc_id, r.text or "", ids) for r, ids in zip(rows, coded(library, [r.text or "" for r in rows]), strict=True)]


@pytest.mark.parametrize("which", ["edge_docs", "documents", "no_docs"])
def test_counts(request, library, which):
    docs = request.getfixturevalue(which)
    found = sorted(map(tuple, token_counts.token_counts(docs, limit=50).collect()), key=str)
    assert found == sorted(((d, len(t.encode()), len(i), len(i) > 50) for d, t, i in known(docs, library)), key=str)


def test_counts_do_not_depend_on_the_sample(edge_docs):
    few, many = (sorted(token_counts.token_counts(edge_docs, sample_rows=n).collect(), key=str) for n in (1, 100))
    assert few == many


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(edge_docs, name):
    path = token_counts.vocabulary(name)
    rows = edge_docs.collect()
    if name.endswith(".model"):
        import sentencepiece

        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([r.text or "" for r in rows])]
    else:
        from tokenizers import Tokenizer

        expected = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    found = token_counts.token_counts(edge_docs, path).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == sorted(zip([r.doc_id for r in rows], expected, strict=True), key=str)


def test_sum_of_squares_choice():
    rng = np.random.default_rng(2)
    packer = packing.Packer(16)
    for n in rng.integers(1, 40, 600).tolist():
        rest = n % 16
        if rest:
            options = {}
            for h in [0, *np.flatnonzero(packer.level).tolist()]:
                if h + rest <= 16:
                    level = packer.level.copy()
                    level[h] -= h > 0
                    if h + rest < 16:
                        level[h + rest] += 1
                    options[h] = (int((level**2).sum()), -h)
            assert packer.best(rest) == min(options, key=options.get)
        for window in packer.add(1, np.arange(n)):
            assert sum(len(p[3]) for p in window) == 16
        assert [len(packer.open.get(h, [])) for h in range(17)] == packer.level.tolist()
    last = [sum(len(p[3]) for p in w) for w in packer.close()]
    assert all(n == 16 for n in last[:-1]) and 0 < last[-1] <= 16


def test_open_windows_are_bounded():
    """Documents that leave windows nearly full, and of any length: few ids are held, and all windows but one are full."""
    rng = np.random.default_rng(6)
    for lengths in ([1500] * 100_000, rng.integers(1100, 2000, 20_000).tolist(), rng.integers(1, 6000, 20_000).tolist()):
        packer, most, seen = packing.Packer(2048, 1 << 16), 0, 0
        ids = np.arange(6000, dtype=np.uint16)
        for k, n in enumerate(lengths):
            for window in packer.add(k, ids[:n]):
                assert sum(len(p[3]) for p in window) == 2048
                seen += 2048
            most = max(most, packer.held)
        assert most <= 1 << 16 and packer.held == sum(h * len(w) for h, w in packer.open.items())
        last = [sum(len(p[3]) for p in w) for w in packer.close()]
        assert all(n == 2048 for n in last[:-1]) and seen + sum(last) == sum(lengths) and not packer.held


def test_pieces_cut_while_packing_cover_their_documents():
    packer, pieces = packing.Packer(32, 100), defaultdict(list)
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 99, n) for n in rng.integers(1, 80, 500)]
    windows = [w for k, x in enumerate(texts) for w in packer.add(k, x)] + list(packer.close())
    for window in windows:
        for k, start, total, ids in window:
            assert total == len(texts[k])
            pieces[k].append((start, ids.tolist()))
    assert [[i for _, ids in sorted(pieces[k]) for i in ids] for k in range(500)] == [x.tolist() for x in texts]


@pytest.mark.parametrize(("which", "window"), [("edge_docs", 2048), ("edge_docs", 7), ("documents", 2048), ("no_docs", 2048)])
def test_packing_round_trip(request, library, which, window):
    docs = request.getfixturevalue(which)
    pieces = packing.digests(packing.pack(docs, window=window)).collect()
    ids = packing.pack(docs, window=window).collect()
    expected = sorted([(d, crc(i + [1]), len(i) + 1) for d, _, i in known(docs, library)], key=str)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in ids:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    back = []
    for (doc_id, total), parts in documents.items():
        parts.sort()
        rows = sum(start == 0 for start, _, _ in parts)  # repeated rows
        assert sum(n for _, n, _ in parts) == rows * total
        if rows == 1:
            assert [s for s, _, _ in parts] == np.cumsum([0, *[n for _, n, _ in parts]])[:-1].tolist()
            back.append((doc_id, zlib.crc32(b"".join(p for _, _, p in parts)), total))
    assert set(back) <= set(expected)
    assert sum(r.length for r in pieces) == sum(n for _, _, n in expected)
    full = sum(sum(n for _, n in s) == window for s in sequences.values())
    assert full >= len(sequences) - docs.rdd.getNumPartitions()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps, dtype=np.int64)
    coded_ = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.build(values).to_bytes()))
    assert coded_.values().tolist() == values.tolist()
    for a, b in ((0, 1), (3, 300), (255, 257), (256, 512), (len(values) // 2, len(values))):
        assert coded_.between(min(a, len(values)), min(b, len(values))).tolist() == values[a:b].tolist()
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert coded_.select(i) == values[i]


def test_elias_fano_is_small_and_selects_everywhere():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    data = token_files.EliasFano.build(values)
    assert [data.select(i) for i in range(0, 5000, 7)] == values[::7].tolist()
    assert 8 * len(data.to_bytes()) < 5000 * (2 + np.log2(values[-1] / 5000) + 1)
    with pytest.raises(IndexError):
        data.select(5000)


@pytest.mark.parametrize(("which", "file_ids"), [("edge_docs", 1 << 25), ("edge_docs", 30), ("documents", 1 << 25), ("documents", 3000), ("no_docs", 9)])
def test_token_files(request, shipped, library, which, file_ids, tmp_path):
    docs = request.getfixturevalue(which)
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write_token_files(docs, folder, files=3, file_ids=file_ids)
    assert file_ids > 1 << 20 or which == "no_docs" or len(manifest) > 3
    found = token_files.read_token_files(shipped, folder, manifest, with_ids=True).collect()
    rows = sorted(known(docs, library), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, expected = 0, []
    for doc_id, _, ids in rows:
        expected.append((doc_id, at, len(ids) + 1, crc(ids + [2]), ids + [2]))
        at += len(ids) + 1
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    for m in manifest:
        with open(m["path"], "rb") as f:
            file = token_files.TokenFile(f)
            for i in range(len(file)):
                assert file.document(i).tolist() in [e[4] for e in expected]
                assert m["base"] + file.bounds(i)[0] in [e[1] for e in expected]
            assert [d for names, _, _ in file.runs() for d in names] == file.doc_ids()


@pytest.mark.parametrize(("ids", "documents"), [(5, 3), (40, 100), (1000, 2)])
def test_runs_read_all_documents_in_bounded_parts(tmp_path, monkeypatch, ids, documents):
    monkeypatch.setattr(token_files, "READ_IDS", ids)
    monkeypatch.setattr(token_files, "READ_DOCUMENTS", documents)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1000, n) for n in rng.integers(0, 30, 700)]
    names = [None, None, *np.sort(rng.integers(-5, 400, 698)).tolist()]
    writer = token_files.Writer(open(tmp_path / "x", "wb"), 2)
    for name, x in zip(names, texts, strict=True):
        writer.add(name, x)
    writer.close()
    with open(tmp_path / "x", "rb") as f:
        back, known = [], []
        for doc_ids, edges, held in token_files.TokenFile(f).runs():
            assert len(doc_ids) <= documents and (len(held) <= ids or len(doc_ids) == 1)
            known += doc_ids
            back += [held[a:b].tolist() for a, b in zip(edges[:-1] - edges[0], edges[1:] - edges[0], strict=True)]
    assert known == names and back == [x.tolist() for x in texts]
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes(bytes(200))
        token_files.TokenFile(open(tmp_path / "y", "rb"))


def test_names_of_file_systems(tmp_path):
    assert token_files._file_system(f"file://{tmp_path}/a")[1] == f"{tmp_path}/a"
    with pytest.raises(Exception, match="(?i)scheme|uri|filesystem"):
        token_files._file_system("nosuch://bucket/a")
