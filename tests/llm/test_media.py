"""Media columns: round trips, a scalar decoder, and shots."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from normlearn.llm import jpeg as J
from normlearn.llm import media as M


def slow_decode(image: bytes) -> np.ndarray:
    """A lossless JPEG decoder bit by bit, from the markers alone."""
    at, tables = 2, {}
    while True:
        marker, size = struct.unpack_from(">HH", image, at)
        body = image[at + 4 : at + 2 + size]
        if marker == 0xFFC3:
            height, width = struct.unpack_from(">HH", body, 1)
        if marker == 0xFFC4:
            code, names = 0, iter(body[17:])
            for length in range(1, 17):
                for _ in range(body[length]):
                    tables[length, code] = next(names)
                    code += 1
                code <<= 1
        at += 2 + size
        if marker == 0xFFDA:
            break
    data = image[at:-2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in data)
    out, p = np.zeros((height, width), int), 0
    for r in range(height):
        for c in range(width):
            length = 1
            while (length, int(bits[p : p + length], 2)) not in tables:
                length += 1
            n = tables[length, int(bits[p : p + length], 2)]
            p += length
            extra = int(bits[p : p + n], 2) if n else 0
            p += n
            d = extra if not n or extra >> (n - 1) else extra - (1 << n) + 1
            before = out[r, c - 1] if c else out[r - 1, 0] if r else 128
            out[r, c] = (before + d) & 255
    return out


def test_frames_are_standard_and_lossless():
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 256, (24, 24)), np.zeros((24, 24)), np.full((24, 24), 255), np.arange(576).reshape(24, 24) % 256]
    frames.append(np.where(rng.random((24, 24)) < 0.5, 0, 255))
    samples = np.array(frames).astype(np.uint8)
    images = M.encode_frames(samples)
    assert all(x[:2] == b"\xff\xd8" and x[-2:] == b"\xff\xd9" for x in images)
    assert (M.decode_frames(images) == samples).all()
    for image, frame in zip(images, samples, strict=True):
        assert (slow_decode(image) == frame).all()


def test_avi_with_and_without_index():
    images = M.encode_frames(np.random.default_rng(2).integers(0, 256, (5, 24, 24)).astype(np.uint8))
    data = M.write_avi(images)
    assert struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    read = M.read_avi(data)
    assert read.frames == images and (read.width, read.height, read.micros) == (24, 24, 40000)
    assert M.read_avi(data[: data.rindex(b"idx1")]).frames == images
    with pytest.raises(ValueError):
        M.read_avi(b"RIFF0000WAVE")
    with pytest.raises(ValueError):
        M.decode_frames([images[0].replace(b"\xff\xc3", b"\xff\xc0")])


def test_shots_at_sudden_changes():
    rng = np.random.default_rng(3)
    dark, light = rng.integers(0, 60, (8, 24, 24)), rng.integers(180, 255, (6, 24, 24))
    steps = M.histogram_steps(np.concatenate([dark, light, dark]).astype(np.uint8))
    assert M.shots(steps) == [(0, 8), (8, 14), (14, 22)]
    assert M.shots(M.histogram_steps(dark.astype(np.uint8))) == [(0, 8)]


@pytest.mark.parametrize("which", ["edge_docs", "documents", "no_docs"])
def test_columns(request, which):
    docs = request.getfixturevalue(which)
    media = M.to_media(docs)
    rows = {}
    for r in docs.collect():
        data = (r.text or "").encode()
        rows[str(r.doc_id), hashlib.sha256(M.payload(r.text or "")).hexdigest()] = len(data)
    found = M.digests(media).collect()
    assert len(found) == docs.count()
    for r in found:
        assert rows[str(r.doc_id), r.payload_sha256] == r.n_bytes
        assert r.payload_bytes == max(1, -(-r.n_bytes // 576)) * 576
    for r in media.collect():
        frames = M.decode_frames(M.read_avi(bytes(r.media)).frames)
        assert frames.tobytes() == bytes(r.payload)
        assert [c.first_frame for c in r.clips][0] == 0 and r.clips[-1].end_frame == len(frames)
        assert all(a.end_frame == b.first_frame for a, b in zip(r.clips, r.clips[1:]))
    tails = {zlib.crc32(bytes(r.payload)[-32:]) for r in media.collect()}
    assert tails == {r.tail_crc32 for r in found}
    assert M.clips(media).count() >= len(found)


def test_equal_texts_have_equal_values(edge_docs):
    found = [r for r in M.digests(M.to_media(edge_docs)).collect() if r.doc_id in (6, 7)]
    assert found[0][1:] == found[1][1:]


def jvm_jpeg(spark, samples: np.ndarray) -> bytes:
    """A baseline JPEG image by Java's encoder: grey of (h, w), or of (h, w, 3) with colours at half size."""
    jvm = spark._jvm
    height, width = samples.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if samples.ndim == 2 else 5)
    if samples.ndim == 2:
        raster = image.getRaster()
        for (r, c), v in np.ndenumerate(samples):
            raster.setSample(c, r, 0, int(v))
    else:
        for r, c in np.ndindex(height, width):
            red, green, blue = map(int, samples[r, c])
            image.setRGB(c, r, red << 16 | green << 8 | blue)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def jvm_luma(spark, image: bytes) -> np.ndarray:
    read = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(image))
    height, width, bands = read.getHeight(), read.getWidth(), read.getRaster().getNumBands()
    raster = read.getRaster()
    out = np.zeros((height, width, bands))
    for r, c, k in np.ndindex(height, width, bands):
        out[r, c, k] = raster.getSample(c, r, k)
    return out[:, :, 0] if bands == 1 else out @ [0.299, 0.587, 0.114]


def without_tables(image: bytes) -> bytes:
    """The image without its Huffman tables, as Motion-JPEG often has it."""
    at, out = 2, image[:2]
    while image[at + 1] != 0xDA:
        size = 2 + struct.unpack_from(">H", image, at + 2)[0]
        out += b"" if image[at + 1] == 0xC4 else image[at : at + size]
        at += size
    return out + image[at:]


@pytest.mark.parametrize("shape", [(8, 8), (17, 33), (37, 51, 3), (16, 16, 3), (1, 1), (9, 70, 3)])
def test_baseline_frames_of_another_writer(spark, shape):
    rng = np.random.default_rng(sum(shape))
    y, x = np.mgrid[: shape[0], : shape[1]]
    samples = 40 + (3 * x + 2 * y) % 160 + rng.integers(0, 8, shape[:2])
    if len(shape) == 3:  # soft colours, which no conversion cuts off
        samples = np.stack([samples, samples + 10, samples - 10], -1)
    image = jvm_jpeg(spark, samples)
    got, wanted = J.luma(image).astype(float), jvm_luma(spark, image)
    assert got.shape == shape[:2] and np.abs(got - wanted).max() <= 1.6
    assert (J.luma(without_tables(image)) == got).all()
    short = image[: len(image) * 3 // 4]
    for bad in (b"", b"\xff\xd8", image[:40], image.replace(b"\xff\xc0", b"\xff\xc2"), short[:-2] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            J.luma(bad)


def grey_image(samples: np.ndarray, restart: int) -> bytes:
    """A baseline image, coded symbol by symbol, with restarts after so many blocks."""
    basis = np.array([[(0.125 if not u else 0.25) ** 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    order = []
    for total in range(15):
        line = [(r, total - r) for r in range(8) if 0 <= total - r < 8]
        order += line if total % 2 else line[::-1]
    dc = {n: f"{n:04b}" for n in range(12)}  # a table of its own: 4 bits a size
    ac = {s: f"{k:08b}" for k, s in enumerate([0, 0xF0] + [r << 4 | n for r in range(16) for n in range(1, 11)])}
    amplitude = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    parts, bits, before = [], "", 0
    blocks = [samples[r : r + 8, c : c + 8] for r in range(0, samples.shape[0], 8) for c in range(0, samples.shape[1], 8)]
    for k, block in enumerate(blocks):
        if restart and k and not k % restart:
            parts, bits, before = [*parts, bits], "", 0
        values = np.rint(basis @ (block - 128.0) @ basis.T).astype(int)
        flat = [int(values[at]) for at in order]
        bits += dc[abs(flat[0] - before).bit_length()] + amplitude(flat[0] - before)
        before, run = flat[0], 0
        for at in range(1, 64):
            if not any(flat[at:]):
                bits += ac[0]
                break
            if not flat[at]:
                run += 1
                continue
            bits += ac[0xF0] * (run // 16) + ac[run % 16 << 4 | abs(flat[at]).bit_length()] + amplitude(flat[at])
            run = 0
    parts.append(bits)
    data = b""
    for k, bits in enumerate(parts):
        bits += "1" * (-len(bits) % 8)
        data += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        data += bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"\xff\xd9"
    part = lambda mark, body: struct.pack(">HH", mark, 2 + len(body)) + body
    tables = bytes([0x00]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(dc) + bytes([0x10]) + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)
    size = struct.pack(">BHHB", 8, *samples.shape, 1) + b"\x01\x11\x00"
    head = part(0xFFDB, b"\x00" + b"\x01" * 64) + part(0xFFC0, size) + part(0xFFC4, tables)
    head += part(0xFFDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + head + part(0xFFDA, b"\x01\x01\x00\x00\x3f\x00") + data


@pytest.mark.parametrize("restart", [0, 1, 3, 12])
def test_restarts_own_tables_and_all_frequencies(restart):
    samples = np.random.default_rng(4).integers(0, 256, (24, 40))
    assert np.abs(J.luma(grey_image(samples, restart)).astype(int) - samples).max() <= 1


def test_lossless_frames_in_general():
    samples = np.random.default_rng(5).integers(0, 256, (3, 24, 24)).astype(np.uint8)
    for image, frame in zip(M.encode_frames(samples), samples, strict=True):
        assert (J.luma(image) == frame).all()


def test_usual_tables():
    """Codes that the standard prints."""
    tables = J.usual_tables()
    for key, bits, symbol in (((1, 0), "1010", 0), ((1, 0), "11111111001", 0xF0), ((1, 1), "1111111010", 0xF0), ((1, 1), "00", 0),
                              ((1, 0), "1111111111111110", 0xFA), ((0, 1), "11111111110", 11), ((0, 0), "111111110", 11)):
        assert tables[key][int(bits.ljust(16, "0"), 2)] == symbol | len(bits) << 8


def test_clips_of_files_of_another_writer(shipped):
    rng = np.random.default_rng(6)
    dark, light = rng.integers(0, 60, (6, 32, 48)), rng.integers(180, 255, (5, 32, 48))
    frames = [grey_image(f, 0) for f in np.concatenate([dark, light])]
    data = M.write_avi([*frames[:4], b"", *frames[4:]])
    wanted = [(0, 0, 7, 0, 280), (1, 7, 12, 280, 480)]
    index = data.rindex(b"idx1")
    movi = data.index(b"movi")
    body = data[movi + 4 : index]
    grouped = data[: movi - 8] + M._chunk(b"LIST", b"movi" + M._chunk(b"LIST", b"rec " + body))  # no index
    further = data[:index] + b"RIFF" + struct.pack("<I", 16 + len(body)) + b"AVIX" + M._chunk(b"LIST", b"movi" + body)
    rows = [
        (1, data, "x"), (2, grouped, "x"), (3, None, "x"), (4, b"", "x"), (5, data[:200], "x"), (1, data, "x"), (None, data, "x"),
        (6, data.replace(b"\xff\xc0", b"\xff\xc2"), "x"), (7, further, "x"), (8, data[: index - 4000], "x"),
    ]
    files = shipped.createDataFrame(rows, "doc_id long, media binary, shot string")
    found: dict = {}
    for r in M.file_clips(files).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for key, times in ((1, 2), (2, 1), (None, 1)):
        assert sorted(found[key]) == sorted([(*w, None) for w in wanted] * times)
    assert [f[:3] for f in sorted(found[7])] == [(0, 0, 7), (1, 7, 12), (2, 12, 19), (3, 19, 24)]
    for key in (3, 4, 5, 6, 8):
        assert len(found[key]) == 1 and found[key][0][:5] == (None,) * 5 and found[key][0][5]
    assert M.file_clips(files.limit(0)).count() == 0


def test_clips_of_files_equal_those_of_the_writer(documents):
    media = M.to_media(documents.where("length(text) < 3000")).limit(60)
    own = sorted(map(tuple, M.clips(media).collect()))
    assert sorted(tuple(r)[:6] for r in M.file_clips(media).collect()) == own and len(own) >= 60
