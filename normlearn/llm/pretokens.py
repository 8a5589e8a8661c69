"""Byte-level BPE over whole batches of texts, with each distinct pre-token encoded once.

The pre-tokenizer of the byte-level vocabulary cuts a text into pre-tokens, which
the BPE model encodes one by one.  Here the cuts of many texts are found at once
on an array of code points, and a table of fixed size maps a pre-token to what the
``tokenizers`` library returned for it.  Only what the table does not hold goes to
the library.  An entry holds the pre-token's own bytes (longer ones than KEY_BYTES
are keys of a dictionary), and a hit needs all of them to be equal, so ids are
always the library's.  Texts with an added token's string, or with a code point
that is not assigned in Python's Unicode version, go to the library whole.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17  # characters handled at once; bounds what a worker holds besides its table
UNASSIGNED, SPACE, LETTER, NUMBER, OTHER = range(5)
U64 = np.uint64
LAST = 0x32400  # beyond it there are tags, variation selectors and private use
KEY_WORDS = 4  # of eight bytes
KEY_BYTES = 8 * KEY_WORDS
LONG_BYTES = 4 << 20  # of longer pre-tokens kept
_MULTIPLY, _MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: The low bytes of a word, by their number.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)

#: The code points with Unicode's property White_Space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = "".join(map(chr, WHITE_SPACE))
#: Where a pre-token starts in any case: white space after something else, a letter or number after a mark.
_EDGE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[^\\s\\w'])(?=[^\\W_])")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point below LAST; all others, which are hardly used, count as unassigned."""
    of = {"L": LETTER, "N": NUMBER, "Cn": UNASSIGNED}
    out = np.full(LAST + 1, UNASSIGNED, np.uint8)
    for code in range(LAST):
        kind = unicodedata.category(chr(code))
        out[code] = of.get(kind, of.get(kind[0], OTHER))
    out[list(WHITE_SPACE)] = SPACE
    return out


def _kinds(codes: np.ndarray) -> np.ndarray:
    return _classes()[codes if codes.dtype == np.uint8 else np.minimum(codes, LAST)]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> U64(32))
    x = x * _MIX
    x = x ^ (x >> U64(29))
    x = x * _MULTIPLY
    return x ^ (x >> U64(32))


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, and from KEY_BYTES places after it (zeros), as integers."""
    padded = data + bytes(KEY_BYTES + 8)
    return np.ndarray((len(data) + KEY_BYTES,), "<u8", padded, strides=(1,))


def _word(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, j: int) -> np.ndarray:
    """The j-th eight bytes of each span, zeros after its end."""
    return words[starts + 8 * j] & _MASKS[np.clip(sizes - 8 * j, 0, 8)]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span under ``key``; spans of up to 64 bytes are hashed together."""
    sizes, words = ends - starts, _words(data)
    out = scrambled(sizes.astype(U64) ^ U64(key))
    rest = np.arange(len(starts))
    for j in range(8):
        rest = rest[(sizes[rest] > 8 * j) & (sizes[rest] <= 64)]
        if not len(rest):
            break
        out[rest] = scrambled(out[rest] ^ _word(words, starts[rest], sizes[rest], j))
    secret = int(key).to_bytes(8, "little")
    for k in np.flatnonzero(sizes > 64).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=secret).digest()
        out[k] = U64(int.from_bytes(digest, "little"))
    return out


def cut(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for texts laid end to end that start at ``begins`` (none is empty)."""
    n = len(codes)
    kind = _kinds(codes)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last character of white space before something else stands alone, or before it if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe starts a pre-token
    mark = np.flatnonzero(codes[:-1] == 39)
    mark = mark[start[mark] & (kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        one = codes[mark + 1]
        there = mark + 2 < n
        after = np.minimum(mark + 2, n - 1)
        two = np.where(there & ~first[after], codes[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return np.flatnonzero(start[:n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _for_library(text: str, special: tuple[str, ...]) -> bool:
    """Whether a text has a string of an added token, or a code point without a class."""
    if any(s in text for s in special):
        return True
    return not text.isascii() and max(text) >= chr(0x370) and not _kinds(_codes(text)).all()


def segments(texts: list[str], special: tuple[str, ...]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about CHUNK characters: numbers of texts, and what is to be cut of them.

    A text longer than that comes in parts, cut where a pre-token starts in any
    case.  Texts for the library are given alone, with the number alone negated and
    less by one.
    """
    numbers, parts, total = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if _for_library(text, special):
            yield [-1 - k], [text]
            continue
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                edge = _EDGE.search(text, at + CHUNK)
                end = edge.start() if edge else end
            numbers.append(k)
            parts.append(text[at:end] if at or end < len(text) else text)
            total += end - at
            at = end
            if total >= CHUNK:
                yield numbers, parts
                numbers, parts, total = [], [], 0
    if parts:
        yield numbers, parts


@dataclass(frozen=True)
class Pieces:
    """The pre-tokens of texts laid end to end."""

    data: bytes
    starts: np.ndarray  # bytes
    ends: np.ndarray
    first: np.ndarray  # each part's first pre-token

    @classmethod
    def of(cls, parts: list[str]) -> Pieces:
        text = "".join(parts)
        data = text.encode("utf-8", "surrogatepass")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        plain = len(data) == len(text)
        codes = np.frombuffer(data, np.uint8) if plain else _codes(text)
        starts = cut(codes, begins)
        first = np.searchsorted(starts, begins)
        if not plain:
            upto = np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
            starts = np.append(0, upto)[starts]
        return cls(data, starts, np.append(starts[1:], len(data)), first)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, sizes, hashes): the bytes of each pre-token as KEY_WORDS integers, its size, a hash of both."""
        sizes, words = self.ends - self.starts, _words(self.data)
        rows = np.empty((len(sizes), KEY_WORDS), U64)
        hashes = scrambled(sizes.astype(U64))
        for j in range(KEY_WORDS):
            rows[:, j] = _word(words, self.starts, sizes, j)
            hashes = scrambled(hashes ^ rows[:, j])
        return rows, sizes, hashes


class Slots:
    """A table of fixed size from pre-tokens of up to KEY_BYTES bytes to numbers.

    A pre-token has two slots.  The first one keeps what came first, the second one what came last.
    """

    def __init__(self, bits: int, **columns) -> None:
        self.shift = U64(64 - bits)
        self.rows = np.zeros((1 << bits, KEY_WORDS), U64)
        self.sizes = np.zeros(1 << bits, np.uint8)  # 0: an empty slot
        self.columns = {name: np.zeros(1 << bits, kind) for name, kind in columns.items()}

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def _equal(self, slot: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        hit = self.sizes[slot] == sizes  # larger ones than KEY_BYTES are in no slot
        held = self.rows[slot]
        for j in range(KEY_WORDS):
            hit &= held[:, j] == rows[:, j]
        return hit

    def find(self, rows: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, hit) of each pre-token; a hit has the same bytes."""
        slot = self._slot(hashes)
        hit = self._equal(slot, rows, sizes)
        rest = np.flatnonzero(~hit)
        if len(rest):
            slot[rest] = self._slot(hashes[rest] * _MULTIPLY)
            hit[rest] = self._equal(slot[rest], rows[rest], sizes[rest])
        return slot, hit

    def put(self, rows: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, **columns: np.ndarray) -> None:
        """Adds new pre-tokens; of several for one slot the first one gets it."""
        left = np.arange(len(sizes))
        for again in (False, True):
            slot = self._slot(hashes[left] * _MULTIPLY if again else hashes[left])
            free = np.flatnonzero((self.sizes[slot] == 0) | again)
            slot, first = np.unique(slot[free], return_index=True)
            some = left[free[first]]
            self.rows[slot], self.sizes[slot] = rows[some], sizes[some]
            for name, values in columns.items():
                self.columns[name][slot] = values[some]
            left = np.setdiff1d(left, some)

    def clear(self) -> None:
        self.sizes[:] = 0


class Table:
    """Pre-tokens' ids as the library gives them, in memory of fixed size."""

    def __init__(self, path: str, bits: int = 20, pool: int = 6 << 20) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.limit = pool
        self.slots = Slots(bits, at=np.int32, count=np.uint16)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0
        # half the size where ids fit
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.pool = np.zeros(pool, self.kind)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all ids end to end.

        Pre-tokens that are not white space go to the library as lines of one text:
        a line feed before any of them is a pre-token of its own, and in none of them.
        """
        sizes = np.zeros(len(pieces), np.int64)
        lines = [k for k, piece in enumerate(pieces) if not piece[-1].isspace()]
        if lines and len(self.line) == 1:
            ids = np.asarray(self._library(["\n".join([pieces[k] for k in lines])])[0], self.kind)
            feeds = np.flatnonzero(ids == self.line[0])
            if len(feeds) == len(lines) - 1:
                edges = np.concatenate([[-1], feeds, [len(ids)]])
                rest = sorted(set(range(len(pieces))).difference(lines))
                other = self._library([pieces[k] for k in rest])
                sizes[lines] = np.diff(edges) - 1
                sizes[rest] = [len(x) for x in other]
                flat = np.zeros(int(sizes.sum()), self.kind)
                begin = np.cumsum(sizes) - sizes
                of_lines = np.repeat(begin[lines] - (np.cumsum(sizes[lines]) - sizes[lines]), sizes[lines])
                flat[of_lines + np.arange(len(of_lines))] = np.delete(ids, feeds)
                for k, x in zip(rest, other, strict=True):
                    flat[begin[k] : begin[k] + len(x)] = x
                return sizes, flat
        found = self._library(pieces)
        sizes[:] = [len(x) for x in found]
        return sizes, np.fromiter((i for x in found for i in x), self.kind, int(sizes.sum()))

    def lookup(self, pieces: Pieces, keys=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, at, count): the ids of each pre-token are pool[at : at + count]."""
        rows, sizes, hashes = keys or pieces.keys()
        slot, hit = self.slots.find(rows, sizes, hashes)
        at, count = self.slots.columns["at"][slot].astype(np.int64), self.slots.columns["count"][slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if not len(missed):
            return self.pool, at, count
        # the pre-tokens to encode, each once: by hash where the bytes are equal, else (and long ones) by their bytes
        short = missed[sizes[missed] <= KEY_BYTES]
        _, where, back = np.unique(hashes[short], return_index=True, return_inverse=True)
        same = (sizes[short] == sizes[short[where][back]]) & (rows[short] == rows[short[where][back]]).all(1)
        rest, back, where = short[same].tolist(), back[same].tolist(), short[where].tolist()
        data, starts, ends = pieces.data, pieces.starts, pieces.ends
        new = [data[starts[k] : ends[k]] for k in where]
        seen: dict[bytes, int] = {}
        for k in [*short[~same].tolist(), *missed[sizes[missed] > KEY_BYTES].tolist()]:
            piece = data[starts[k] : ends[k]]
            known = self.long.get(piece)
            if known:
                at[k], count[k] = known
                continue
            n = seen.setdefault(piece, len(new))
            if n == len(new):
                new.append(piece)
                where.append(k)
            back.append(n)
            rest.append(k)
        if not new:
            return self.pool, at, count
        many, flat = self._coded([p.decode("utf-8", "surrogatepass") for p in new])
        begin = np.cumsum(many) - many
        if self.used + len(flat) > self.limit:  # start again; what this batch found stays valid in a copy
            pool = np.concatenate([self.pool[: self.used], flat])
            at[rest], count[rest] = (begin + self.used)[back], many[back]
            self.slots.clear()
            self.long.clear()
            self.used = self.long_bytes = 0
            self.pool = np.zeros(self.limit, self.kind)
            return pool, at, count
        self.pool[self.used : self.used + len(flat)] = flat
        begin = begin + self.used
        self.used += len(flat)
        at[rest], count[rest] = begin[back], many[back]
        where = np.array(where)
        short = (sizes[where] <= KEY_BYTES) & (many < 1 << 16)
        some = where[short]
        self.slots.put(rows[some], sizes[some], hashes[some], at=begin[short], count=many[short])
        for n, piece in enumerate(new):
            if len(piece) > KEY_BYTES and self.long_bytes + len(piece) <= LONG_BYTES:
                self.long[piece] = (int(begin[n]), int(many[n]))
                self.long_bytes += len(piece)
        return self.pool, at, count

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of texts, ids and where each text's begin, laid end to end) for parts of ``texts`` in order.

        A text may come in several parts, one after the other.
        """
        for numbers, parts in segments(texts, self.special):
            if numbers[0] < 0:
                ids = np.asarray(self._library(parts)[0], np.uint32)
                yield np.array([-1 - numbers[0]]), ids, np.array([0, len(ids)])
                continue
            pieces = Pieces.of(parts)
            pool, at, count = self.lookup(pieces)
            upto = np.cumsum(count)
            total = int(upto[-1])
            ids = pool[np.repeat(at - (upto - count), count) + np.arange(total)].astype(np.uint32)
            yield np.array(numbers), ids, np.append((upto - count)[pieces.first], total)

    def ids(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, and ``end`` after each if given."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, ids, edges in self.encode(texts):
            for k, a, b in zip(numbers.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[k].append(ids[a:b])
        last = [] if end is None else [np.array([end], np.uint32)]
        return [np.concatenate(x + last) if len(x + last) != 1 else (x + last)[0] for x in (y or [np.zeros(0, np.uint32)] for y in out)]


def trimmed() -> None:
    """Gives memory that is free in this process back to the system, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@lru_cache(1)
def table(path: str) -> Table:
    """The worker's table for a vocabulary; it lives as long as the worker."""
    return Table(path)
