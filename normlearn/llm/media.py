"""Motion-JPEG in AVI: write, parse by the RIFF index, decode intra frames, find shots.

Frames are lossless JPEG images (process SOF3 of ITU-T T.81): 8-bit grey samples,
predicted from the left (the first column from above) and Huffman coded, so bytes
go in and come back exactly.  Coding and decoding run over many frames at once:
one numpy step handles the same sample of every frame.

A shot ends where the histogram difference of two frames stands out from those
before it in the same shot: it must exceed their mean by ``factor`` standard
deviations, and a floor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlearn.llm import jpeg

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
PAD = 255
BINS = 16
#: Lengths of the Huffman codes of the categories 0 to 8 of a sample's difference.
CODE_LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)


@lru_cache(1)
def _codes() -> list[tuple[int, int]]:
    """(code, length) of each category: canonical codes, as a decoder makes them from the lengths."""
    order = sorted(range(len(CODE_LENGTHS)), key=lambda c: (CODE_LENGTHS[c], c))
    code, last, out = 0, 0, {}
    for c in order:
        code <<= CODE_LENGTHS[c] - last
        last = CODE_LENGTHS[c]
        out[c] = (code, last)
        code += 1
    return [out[c] for c in range(len(CODE_LENGTHS))]


@lru_cache(1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255."""
    bits, count = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = _codes()[category]
        extra = d if d > 0 else d + (1 << category) - 1
        bits[d + 255], count[d + 255] = (code << category) | (extra if category else 0), length + category
    return bits, count


@lru_cache(1)
def _head() -> bytes:
    """Everything of an image before its coded samples."""
    order = sorted(range(len(CODE_LENGTHS)), key=lambda c: (CODE_LENGTHS[c], c))
    counts = bytes(sum(x == n for x in CODE_LENGTHS) for n in range(1, 17))
    table = struct.pack(">HHB", 0xFFC4, 2 + 17 + len(order), 0) + counts + bytes(order)
    frame = struct.pack(">HHBHHBBBB", 0xFFC3, 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 1, 0, 0)  # predictor 1, no point transform
    return struct.pack(">H", 0xFFD8) + frame + table + scan


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of ``samples``, shape (frames, SIDE, SIDE)."""
    n = len(samples)
    if not n:
        return []
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    bits, count = _encoder()
    index = (diff.reshape(n, FRAME) + 255).astype(np.int64)
    size = count[index]
    ends = np.cumsum(size, axis=1)
    length = (ends[:, -1] + 7) // 8  # bytes a frame
    base = np.cumsum(length) - length
    end = (ends + 8 * base[:, None]).reshape(-1)  # each code's end, in bits
    size, value = size.reshape(-1), bits[index].reshape(-1).astype(np.uint32)
    start = end - size
    byte = start >> 3
    # a code has at most 12 bits, so it touches three bytes at most: place it in a window of 24 bits
    window = value << (24 - (start & 7) - size).astype(np.uint32)
    total = int(length.sum())
    out = np.zeros(total + 3, np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        part = (window >> np.uint32(shift)) & np.uint32(255)
        # bits of different codes do not overlap, so their sum is their union
        out += np.bincount(byte + k, part, total + 3).astype(np.uint8)
    # the unused bits of a frame's last byte are ones
    spare = (8 * length - ends[:, -1]).astype(np.int64)
    out[base + length - 1] |= ((1 << spare) - 1).astype(np.uint8)
    out = out[:total]
    marks = np.flatnonzero(out == 255)
    stuffed = np.insert(out, marks + 1, 0).tobytes()
    before = np.searchsorted(marks, np.append(base, total))
    edges = (np.append(base, total) + before).tolist()
    head = _head()
    return [head + stuffed[a:b] + b"\xff\xd9" for a, b in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """The difference and the number of bits of the code that any 16 bits start with."""
    value, size = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    bits, count = _encoder()
    for d in range(-255, 256):
        n = int(count[d + 255])
        first = int(bits[d + 255]) << (16 - n)
        value[first : first + (1 << (16 - n))], size[first : first + (1 << (16 - n))] = d, n
    return value, size


def _parsed(image: bytes) -> tuple[int, int, tuple, int]:
    """Height, width, code lengths and where the coded samples begin, from an image's markers."""
    at, height, width, lengths = 2, 0, 0, ()
    while True:
        marker, size = struct.unpack_from(">HH", image, at)
        if marker == 0xFFC3:
            if image[at + 4] != 8 or image[at + 9] != 1:
                raise ValueError("only 8-bit images of one component are decoded")
            height, width = struct.unpack_from(">HH", image, at + 5)
        elif marker == 0xFFC4:
            counts, names = image[at + 5 : at + 21], image[at + 21 : at + 2 + size]
            each = [n for n, c in enumerate(counts, 1) for _ in range(c)]
            lengths = tuple(n for _, n in sorted(zip(names, each, strict=True)))
        elif marker == 0xFFDA:
            return height, width, lengths, at + 2 + size
        elif 0xFFC0 <= marker <= 0xFFCF:
            raise ValueError(f"frames of the process {marker:#x} are not decoded")
        at += 2 + size


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples of lossless JPEG images of SIDE x SIDE, shape (frames, SIDE, SIDE)."""
    if not images:
        return np.zeros((0, SIDE, SIDE), np.uint8)
    head = _head()
    begin = []
    for image in images:
        if image.startswith(head):
            begin.append(len(head))
            continue
        height, width, lengths, at = _parsed(image)
        if (height, width, lengths) != (SIDE, SIDE, CODE_LENGTHS):
            raise ValueError("another size or code table than this writer's")
        begin.append(at)
    coded = [image[a:-2] for image, a in zip(images, begin, strict=True)]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    length = np.fromiter(map(len, coded), np.int64, len(coded))
    base = np.cumsum(length) - length
    # drop the zero after each 255
    stuffed = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
    plain = np.append(np.delete(raw, stuffed), np.zeros(4, np.uint8)).astype(np.uint32)
    base = base - np.searchsorted(stuffed, base)
    window = (plain[:-3] << np.uint32(24)) | (plain[1:-2] << np.uint32(16)) | (plain[2:-1] << np.uint32(8)) | plain[3:]
    value, size = _decoder()
    at = base * 8
    diff = np.empty((FRAME, len(images)), np.int16)
    for k in range(FRAME):
        code = (window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        diff[k] = value[code]
        at += size[code]
    x = diff.T.reshape(-1, SIDE, SIDE).astype(np.int64)
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1) + 128
    return (np.cumsum(x, axis=2) & 255).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(images: list[bytes]) -> bytes:
    """An AVI file of one video stream with an index."""
    most = max(map(len, images), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0, FRAME, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams)
    parts, index, at = [], [], 4
    for data in images:
        parts.append(_chunk(b"00dc", data))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(data)))
        at += len(parts[-1])
    body = head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"AVI " + body


@dataclass(frozen=True)
class Avi:
    micros: int
    width: int
    height: int
    frames: list[bytes]


def read_avi(data: bytes) -> Avi:
    """The frames of the first video stream of an AVI file, by its index, or by walking its chunks where it has none.

    Chunks in ``rec`` lists and in further RIFF parts of long files are walked too.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros = width = height = 0
    lists, index = [], None
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"RIFF":  # a further part: its chunks follow
            at += 12
            continue
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            main = data.index(b"avih", at) + 8
            micros, (width, height) = struct.unpack_from("<I", data, main)[0], struct.unpack_from("<II", data, main + 32)
            video = data.find(b"strh", main)
            while 0 <= video < at + size and data[video + 8 : video + 12] != b"vids":
                video = data.find(b"strh", video + 4)
            if 0 <= video < at + size:
                scale, rate = struct.unpack_from("<II", data, video + 28)
                micros = 1_000_000 * scale // rate if scale and rate else micros
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            lists.append((at + 8, min(at + 8 + size, len(data))))
        elif name == b"idx1" and index is None:
            index = (at + 8, min(size, len(data) - at - 8))
        at += 8 + size + (size & 1)
    if not lists:
        raise ValueError("an AVI file without frames")
    found: list[tuple[bytes, int, int]] = []
    for k, (begin, end) in enumerate(lists):
        found += _indexed(data, begin, index) if index and not k else _walked(data, begin + 4, end)
    frames = [(name, begin, size) for name, begin, size in found if name[2:] in (b"dc", b"db")]
    if any(begin + size > len(data) for _, begin, size in frames):
        raise ValueError("the file ends early")
    return Avi(micros, width, height, [data[b : b + n] for name, b, n in frames if name[:2] == frames[0][0][:2]])


def _indexed(data: bytes, movi: int, index: tuple[int, int]) -> list[tuple[bytes, int, int]]:
    """Name, first byte and size of the chunks that an index lists."""
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]):
        begin = movi + offset + 8
        if data[begin - 8 : begin - 4] != name:  # some writers count from the file's start
            begin = offset + 8
        out.append((name, begin, size))
    return out


def _walked(data: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """The same, of the chunks from ``at`` to ``end``."""
    out = []
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":  # a group of chunks: they follow
            at += 12
            continue
        out.append((name, at + 8, size))
        at += 8 + size + (size & 1)
    return out


def clips_of_file(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Microseconds a frame, and (first, past the last) frame of each shot of a Motion-JPEG AVI file of any size.

    Frames are decoded one at a time, of which only the histograms stay.  An empty
    frame repeats the one before.
    """
    avi = read_avi(data)
    if not avi.frames or not avi.micros:
        raise ValueError("no frames, or no time of a frame")
    counts, pixels = [], 0
    for image in avi.frames:
        if not image and counts:
            counts.append(counts[-1])
            continue
        samples = jpeg.luma(image)
        if pixels not in (0, samples.size):
            raise ValueError("frames of unequal size")
        pixels = samples.size
        counts.append(np.bincount(samples.reshape(-1) >> 4, minlength=BINS))
    whole = np.array(counts)
    steps = np.zeros(len(whole), np.int64)
    steps[1:] = np.abs(whole[1:] - whole[:-1]).sum(1)
    return avi.micros, shots(steps, floor=pixels // 4)


def file_clips(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per shot of a column of AVI files: doc_id, shot, first_frame, end_frame, start_ms, end_ms, error.

    The files hold Motion-JPEG of any writer (see ``jpeg``).  Null, empty and other
    bytes that cannot be read as such give one row with a null shot and the reason as
    ``error``, which is null elsewhere.  Null ids stay null, repeated rows are read
    each, an empty table gives an empty result, and other columns are ignored.
    """
    names = ["doc_id", "shot", "first_frame", "end_frame", "start_ms", "end_ms", "error"]
    schema = "doc_id long, shot int, first_frame int, end_frame int, start_ms long, end_ms long, error string"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                try:
                    micros, found = clips_of_file(data.as_py() or b"")
                except (ValueError, struct.error) as error:
                    rows.append((key, None, None, None, None, None, str(error)))
                    continue
                rows += [(key, k, a, b, a * micros // 1000, b * micros // 1000, None) for k, (a, b) in enumerate(found)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    source = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return source.mapInArrow(run, schema)


def histogram_steps(samples: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of the histograms of each frame and the one before; 0 for the first."""
    n = len(samples)
    bins = (samples.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    counts = np.bincount(bins.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    out = np.zeros(n, np.int64)
    out[1:] = np.abs(counts[1:] - counts[:-1]).sum(1)
    return out


def shots(steps: np.ndarray, factor: float = 3.0, floor: int = FRAME // 4) -> list[tuple[int, int]]:
    """(first, past the last) frame of each shot.  A shot's first two steps need to pass twice the floor."""
    out, begin, n, total, squares = [], 0, 0, 0, 0
    for k, step in enumerate(steps.tolist()):
        if not k:
            continue
        if n < 2:
            limit = 2.0 * floor
        else:
            mean = total / n
            limit = max(float(floor), 2 * mean, mean + factor * max(0.0, squares / n - mean * mean) ** 0.5)
        if step > limit:
            out.append((begin, k))
            begin, n, total, squares = k, 0, 0, 0
        else:
            n, total, squares = n + 1, total + step, squares + step * step
    return [*out, (begin, len(steps))] if len(steps) else out


@dataclass(frozen=True)
class Stored:
    """A payload as media: what was written, and what came back."""

    media: bytes
    payload: bytes
    steps: np.ndarray
    clips: list[tuple[int, int]]


BATCH = 1 << 11  # frames coded at once


def store(payloads: list[bytes]) -> Iterator[Stored]:
    """Each payload (of whole frames) written as an AVI file, and read from those bytes again."""
    group: list[bytes] = []
    held = 0
    for k, payload in enumerate(payloads):
        group.append(payload)
        held += len(payload)
        if held >= BATCH * FRAME or k + 1 == len(payloads):
            yield from _store(group)
            group, held = [], 0


def _store(payloads: list[bytes]) -> Iterator[Stored]:
    counts = [len(p) // FRAME for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE)
    images: list[bytes] = []
    for at in range(0, len(samples), BATCH):
        images += encode_frames(samples[at : at + BATCH])
    files, at = [], 0
    for n in counts:
        files.append(write_avi(images[at : at + n]))
        at += n
    del images, samples
    read = [read_avi(f).frames for f in files]
    flat = [x for frames in read for x in frames]
    back = np.concatenate([decode_frames(flat[a : a + BATCH]) for a in range(0, len(flat), BATCH)])
    steps = histogram_steps(back)
    at = 0
    for file, n in zip(files, counts, strict=True):
        own = steps[at : at + n].copy()
        own[0] = 0
        yield Stored(file, back[at : at + n].tobytes(), own, shots(own))
        at += n


def payload(text: str) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of a frame."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (an AVI file), payload (read back), steps, clips.

    ``steps`` are the histogram differences; ``clips`` has shot, first_frame,
    end_frame, start_ms and end_ms.  Null and empty texts are one frame of padding.
    Null ids stay null; repeated rows give a file each; an empty table gives an
    empty result; other columns are ignored.
    """
    clip = "array<struct<shot:int,first_frame:int,end_frame:int,start_ms:long,end_ms:long>>"
    schema = f"doc_id long, n_bytes long, media binary, payload binary, steps array<int>, clips {clip}"
    types = pa.list_(
        pa.struct([(k, t) for k, t in zip(("shot", "first_frame", "end_frame", "start_ms", "end_ms"), (pa.int32(),) * 3 + (pa.int64(),) * 2, strict=True)])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at, to in groups([len(t) for t in texts]):
                part = [payload(t) for t in texts[at:to]]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts[at:to]]
                out = list(store(part))
                clips = [
                    [
                        {"shot": k, "first_frame": a, "end_frame": b, "start_ms": a * 1000 // FPS, "end_ms": b * 1000 // FPS}
                        for k, (a, b) in enumerate(s.clips)
                    ]
                    for s in out
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[at:to], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([s.media for s in out], pa.binary()),
                        pa.array([s.payload for s in out], pa.binary()),
                        pa.array([s.steps.astype(np.int32) for s in out], pa.list_(pa.int32())),
                        pa.array(clips, types),
                    ],
                    ["doc_id", "n_bytes", "media", "payload", "steps", "clips"],
                )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return source.mapInArrow(run, schema)


def groups(lengths: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose lengths sum to about ``most``; a longer row is alone."""
    begin, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += max(n, FRAME)
    if begin < len(lengths):
        yield begin, len(lengths)


def clips(media: DataFrame) -> DataFrame:
    """A row per shot of ``to_media``: doc_id, shot, first_frame, end_frame, start_ms, end_ms."""
    return media.select("doc_id", F.inline("clips"))


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of ``to_media``; ``feature`` has the number of frames and where each shot begins."""
    begins = F.transform("clips", lambda c: c["start_ms"].cast("string"))
    steps = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x)
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.col("payload").substr(F.octet_length("payload") - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("frames="), F.size("steps")),
            F.concat(F.lit("shots="), F.size("clips")),
            F.concat(F.lit("starts_ms="), F.array_join(begins, ",")),
            F.concat(F.lit("change="), steps),
        ).alias("feature"),
    )


def op9_media(spark, sf_dir: str) -> DataFrame:
    return digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))

