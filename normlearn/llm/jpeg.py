"""The first component (grey or luma) of JPEG frames, as Motion-JPEG holds them.

Decoded are 8-bit sequential Huffman frames (SOF0, SOF1 of ITU-T T.81) of any size,
number of components, sampling and scans, with restarts, and lossless frames (SOF3)
of one component without restarts, with any predictor.  A frame without Huffman
tables has the usual ones, as Motion-JPEG leaves them out.  Other components are
read over.  Progressive, arithmetic and other frames are a ValueError, as is data
that ends early or is no JPEG.

The codes of a scan are read one by one; transforms run over all blocks at once.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Number of codes of each length and the first symbols of the usual tables (T.81, K.3).
# The symbols not listed follow in ascending order.
DC_LUMA = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_CHROMA = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
AC_LUMA = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_LUMA_FIRST = bytes.fromhex(
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"
)
AC_CHROMA = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_CHROMA_FIRST = bytes.fromhex(
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"
)

#: Places of the coefficients in the order of a scan: along the diagonals, in turns downwards and upwards.
ZIGZAG = np.array(
    [8 * r + c for r, c in sorted(np.ndindex(8, 8), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))]
)
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(64)
def codes(counts: tuple[int, ...], symbols: bytes) -> list[int]:
    """For any 16 bits, the symbol of the code they start with, plus 256 times its length; 0 where there is none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << (16 - length)
            if first >= 1 << 16:
                raise ValueError("too many codes in a table")
            table[first : first + (1 << (16 - length))] = symbol | length << 8
            code += 1
        at += n
        code <<= 1
    return table.tolist()


def _rest(first: bytes) -> bytes:
    every = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return first + bytes(sorted(set(every) - set(first)))


@lru_cache(1)
def usual_tables() -> dict[tuple[int, int], list[int]]:
    """The tables by (class, destination)."""
    dc = bytes(range(12))
    return {
        (0, 0): codes(DC_LUMA, dc), (0, 1): codes(DC_CHROMA, dc),
        (1, 0): codes(AC_LUMA, _rest(AC_LUMA_FIRST)), (1, 1): codes(AC_CHROMA, _rest(AC_CHROMA_FIRST)),
    }


@dataclass
class _Frame:
    process: int = 0
    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # name, across, down, quantisers
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], list[int]] = field(default_factory=lambda: dict(usual_tables()))
    restart: int = 0


def luma(image: bytes) -> np.ndarray:
    """The first component's samples, shape (height, width), of 8 bits."""
    try:
        return _luma(image)
    except (struct.error, IndexError, KeyError) as error:
        raise ValueError("the image ends early or names what it does not hold") from error


def _luma(image: bytes) -> np.ndarray:
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    frame, at = _Frame(), 2
    while True:
        if image[at] != 0xFF:
            raise ValueError("no marker where one must be")
        while image[at + 1] == 0xFF:
            at += 1
        marker = image[at + 1]
        if marker == 0xD9:
            raise ValueError("no scan of the first component")
        size = struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment ends early")
        at += 2 + size
        if marker == 0xDB:
            _quantisers(body, frame)
        elif marker == 0xC4:
            _tables(body, frame)
        elif marker == 0xDD:
            frame.restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            frame.process = marker
            bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            if bits != 8 or not frame.height or not frame.width or not n or any(not a or not d for _, a, d, _ in frame.components):
                raise ValueError("only frames of 8 bits and a known size are decoded")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError(f"frames of the process {marker:#x} are not decoded")
        elif marker == 0xDA:
            end = _END.search(image, at)
            stop = end.start() if end else len(image)
            names = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
            if frame.components[0][0] in names:
                coded = image[at:stop]
                if frame.process == 0xC3:
                    return _lossless(coded, frame, names, body[-3], body[-1] & 15)
                return _sequential(coded, frame, names)
            at = stop


def _quantisers(body: bytes, frame: _Frame) -> None:
    at = 0
    while at < len(body):
        wide, name = body[at] >> 4, body[at] & 15
        values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float64)
        frame.quantisers[name] = values
        at += 1 + (128 if wide else 64)


def _tables(body: bytes, frame: _Frame) -> None:
    at = 0
    while at < len(body):
        counts = tuple(body[at + 1 : at + 17])
        n = sum(counts)
        symbols = body[at + 17 : at + 17 + n]
        if len(symbols) != n:
            raise ValueError("a table ends early")
        frame.tables[body[at] >> 4, body[at] & 15] = codes(counts, symbols)
        at += 17 + n


def _windows(coded: bytes) -> list[int]:
    """For each byte, the 24 bits that begin with it; after the last byte come ones."""
    plain = np.frombuffer(coded.replace(b"\xff\x00", b"\xff") + b"\xff" * 6, np.uint8).astype(np.int64)
    return ((plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]).tolist()


def _sequential(coded: bytes, frame: _Frame, names: dict[int, tuple[int, int]]) -> np.ndarray:
    """The blocks of a scan, all of one component or some of each in turn."""
    most = [max(c[k] for c in frame.components) for k in (1, 2)]
    name, across, down, quantiser = frame.components[0]
    width, height = -(-frame.width * across // most[0]), -(-frame.height * down // most[1])
    units = []  # of each turn: whether it is of the first component, its slot, its tables
    if len(names) == 1:
        across = down = 1
        columns, rows = -(-width // 8), -(-height // 8)
    else:
        columns, rows = -(-frame.width // (8 * most[0])), -(-frame.height // (8 * most[1]))
    for slot, (other, a, d, _) in enumerate(frame.components):
        if other in names:
            dc, ac = names[other]
            each = 1 if len(names) == 1 else a * d
            units += [(other == name, slot, frame.tables[0, dc], frame.tables[1, ac])] * each
    turns = columns * rows
    places: list[int] = []
    values: list[int] = []
    block = 0
    parts = _RESTART.split(coded) if frame.restart else [coded]
    every = frame.restart or turns
    if len(parts) != -(-turns // every):
        raise ValueError("the number of restarts is not that of the size")
    for k, part in enumerate(parts):
        block = _blocks(_windows(part), min(every, turns - k * every), units, len(frame.components), block, places, values)
    found = np.zeros(block * 64)
    found[places] = values
    found = found.reshape(-1, 64) * frame.quantisers[quantiser]
    spread = np.empty_like(found)
    spread[:, ZIGZAG] = found
    basis = _cosines()
    samples = basis.T @ spread.reshape(-1, 8, 8) @ basis + 128
    samples = np.clip(np.rint(samples), 0, 255).astype(np.uint8)
    whole = samples.reshape(rows, columns, down, across, 8, 8).transpose(0, 2, 4, 1, 3, 5)
    return whole.reshape(rows * down * 8, columns * across * 8)[:height, :width]


@lru_cache(1)
def _cosines() -> np.ndarray:
    """Row u holds the cosine of frequency u at the eight samples."""
    u, x = np.ogrid[:8, :8]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u, 0.5, 8**-0.5)


def _blocks(
    windows: list[int], turns: int, units: list, n: int, block: int, places: list[int], values: list[int]
) -> int:
    """Adds places and values of the first component's coefficients; returns the number of its blocks so far."""
    before, p = [0] * n, 0
    last = 8 * (len(windows) - 4)  # bits of the data
    for _ in range(turns):
        for wanted, slot, dc, ac in units:
            hit = dc[(windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF]
            if not hit:
                raise ValueError("no such code")
            p += hit >> 8
            size = hit & 255
            if size:
                if size > 11:
                    raise ValueError("a difference of too many bits")
                extra = ((windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF) >> (16 - size)
                p += size
                before[slot] += extra if extra >> (size - 1) else extra - (1 << size) + 1
            base = 64 * block
            if wanted:
                places.append(base)
                values.append(before[slot])
                block += 1
            k = 1
            while k < 64:
                hit = ac[(windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF]
                if not hit:
                    raise ValueError("no such code")
                p += hit >> 8
                size, run = hit & 15, (hit >> 4) & 15
                if not size:
                    if run != 15:
                        break
                    k += 16
                    continue
                k += run
                if k > 63:
                    raise ValueError("a block of too many coefficients")
                extra = ((windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF) >> (16 - size)
                p += size
                if wanted:
                    places.append(base + k)
                    values.append(extra if extra >> (size - 1) else extra - (1 << size) + 1)
                k += 1
        if p > last:
            raise ValueError("the coded data ends early")
    return block


def _lossless(coded: bytes, frame: _Frame, names: dict[int, tuple[int, int]], predictor: int, shift: int) -> np.ndarray:
    """Samples predicted from those to the left (a), above (b) and between (c)."""
    if len(frame.components) != 1 or frame.restart or not 1 <= predictor <= 7 or shift:
        raise ValueError("lossless frames of several components, with restarts or shifted are not decoded")
    table = frame.tables[0, names[frame.components[0][0]][0]]
    windows, p = _windows(coded), 0
    out: list[list[int]] = []
    for r in range(frame.height):
        row: list[int] = []
        above = out[-1] if r else row
        for c in range(frame.width):
            hit = table[(windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF]
            if not hit or hit & 255 > 16:
                raise ValueError("no such code")
            p += hit >> 8
            size = hit & 255
            d = 1 << 15 if size == 16 else 0
            if 0 < size < 16:
                extra = ((windows[p >> 3] >> (8 - (p & 7))) & 0xFFFF) >> (16 - size)
                p += size
                d = extra if extra >> (size - 1) else extra - (1 << size) + 1
            if not r or not c:
                guess = row[-1] if c else above[0] if r else 128
            else:
                left, up, between = row[-1], above[c], above[c - 1]
                guess = (
                    left, up, between, left + up - between,
                    left + ((up - between) >> 1), up + ((left - between) >> 1), (left + up) >> 1,
                )[predictor - 1]
            row.append((guess + d) & 0xFFFF)
        out.append(row)
    if p > 8 * (len(windows) - 4):
        raise ValueError("the coded data ends early")
    return (np.array(out) & 255).astype(np.uint8)
