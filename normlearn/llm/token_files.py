"""Files of token ids with Elias-Fano encoded document boundaries.

A file holds the ids of its documents end to end and, in place of a table of
64-bit offsets, the non-decreasing ends of the documents as an Elias-Fano
sequence: the low bits of each value packed, the high bits in unary, and 32-bit
samples of the positions of every 256th one bit for ``select``.  That takes about
2 + log2(ids / documents) bits a document.  Ascending doc_ids are kept in the
same way.  Both sequences and a header of fixed size follow the ids, so a writer
needs no more memory than some texts and the boundaries, and begins a new file
after ``FILE_IDS`` ids or ``FILE_DOCUMENTS`` documents.  A reader selects the
documents it wants and reads their ids only.

Rows are dealt to writers by ranges of doc_id and sorted in them, so the files in
order hold all documents in ascending order.  A file is written under a name of
its own and then moved to its final name; a task that runs again writes the same.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens, scratch
from .token_counts import vocabulary

END_ID = 2
MAGIC = b"EFTOKEN2"
#: Documents, null ids, least id, ids, bytes an id, bytes of both sequences, magic; at the end of a file.
HEADER = struct.Struct("<qqqqqqq8s")
FILE_IDS, FILE_DOCUMENTS = 1 << 25, 1 << 18
READ_IDS, READ_DOCUMENTS = 1 << 20, 1024  # read at once, but for a longer document
SAMPLE = 256
ROWS = 128  # texts encoded at once


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, with ``select``."""

    HEAD = struct.Struct("<qqqq")  # values, low bits, bytes of the high part, bytes of the low part

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        parts = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros(0, np.uint8)
        high, low = np.packbits(bits, bitorder="little"), np.packbits(parts.reshape(-1), bitorder="little")
        return cls(n, low_bits, high, low, ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.high), len(self.low))
        return head + self.high.tobytes() + self.low.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, high, low = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        raw = np.frombuffer(data, np.uint8, high + low, at)
        return cls(n, low_bits, raw[:high], raw[high:], np.frombuffer(data, "<u4", -(-n // SAMPLE), at + high + low))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the bits up to it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # one bits still to pass
        byte = at >> 3
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        window[: at & 7] = 0
        while (count := int(window.sum())) <= left:
            left -= count
            byte += 1
            window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        position = 8 * byte + int(np.flatnonzero(window)[left])
        return ((position - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def _lows(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for b in range(self.low_bits):
            at = index * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def between(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th, from the samples around them."""
        if a >= b:
            return np.zeros(0, np.int64)
        index, before = np.arange(a, b), a // SAMPLE
        last = (b - 1) // SAMPLE + 1
        low = int(self.samples[before]) >> 3
        high = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[low:high], bitorder="little")) + 8 * low
        ones = ones[np.searchsorted(ones, int(self.samples[before])) :]
        ones = ones[index - before * SAMPLE]
        return ((ones - index) << self.low_bits) | self._lows(index)

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.between(0, self.n)


class Writer:
    """One file: ids as they come, then the boundaries.  doc_ids ascend, nulls first."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.ids)

    def close(self) -> None:
        known = np.array([d for d in self.doc_ids if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        names = EliasFano.build(known - least).to_bytes()
        ends = EliasFano.build(np.array(self.ends, np.int64)).to_bytes()
        sizes = (len(self.doc_ids), len(self.doc_ids) - len(known), least, self.ids, self.width, len(names), len(ends))
        self.out.write(names + ends + HEADER.pack(*sizes, MAGIC))
        self.out.close()


class TokenFile:
    """A file of ``Writer``: any document's ids by its place in the file.  ``source`` can seek and read."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        *sizes, magic = HEADER.unpack(self._read(size - HEADER.size, HEADER.size)) if size >= HEADER.size else (0, b"")
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.nulls, self.least, self.total, self.width, names, ends = sizes
        at = self.total * self.width
        self.names = EliasFano.from_bytes(memoryview(self._read(at, names)))
        self.ends = EliasFano.from_bytes(memoryview(self._read(at + names, ends)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return self.documents

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self._read(a * self.width, (b - a) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))

    def doc_ids(self, a: int = 0, b: int | None = None) -> list[int | None]:
        b = self.documents if b is None else b
        known = self.names.between(max(a - self.nulls, 0), max(b - self.nulls, 0)) + self.least
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + known.tolist()

    def runs(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(doc_ids, edges, ids) of documents that follow each other; document k's ids are ids[edges[k] - edges[0] : ...]."""
        a = 0
        while a < self.documents:
            start = self.ends.select(a - 1) if a else 0
            b = min(a + READ_DOCUMENTS, self.documents)
            if self.ends.select(b - 1) - start > READ_IDS:  # the most documents that fit, one at least
                fits, b = a, b - 1
                while fits + 1 < b:
                    middle = (fits + b) // 2
                    fits, b = (middle, b) if self.ends.select(middle - 1) - start <= READ_IDS else (fits, middle)
                b = max(fits, a + 1)
            edges = np.append(start, self.ends.between(a, b))
            yield self.doc_ids(a, b), edges, self.ids(start, int(edges[-1]))
            a = b


#: Names that Hadoop's file systems use, and those of the same stores here.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _file_system(uri: str):
    """(file system, path) of a folder; raises where its scheme is one that pyarrow does not know."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}" if mark else uri)


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end_id: int = END_ID,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> list[dict]:
    """Writes the ids of all texts of ``docs``, each followed by ``end_id``, to files in ``folder``.

    Returns the files in order, each with its path, documents, ids and the ids in
    all files before it (``base``); the same list is in ``manifest.json``.  A file
    ends after ``file_ids`` ids.  Null and empty texts are ``end_id`` alone; null ids
    come first; rows with the same doc_id are ordered by text.  An empty table gives
    no file.  ``folder`` is on a file system that pyarrow knows (local, HDFS, S3,
    Google and Azure stores); others are an error.
    """
    path = path or vocabulary()
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    dealt = source.repartitionByRange(files, "doc_id") if files else source.repartitionByRange("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pretokens.table(path)
        width = 2 if max(table.library.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        part, number = TaskContext.get().partitionId(), 0
        target, root = _file_system(folder)
        writer = own = None

        def done() -> pa.RecordBatch:
            writer.close()
            name = f"{root}/tokens-{part:06d}-{number:04d}.ef"
            target.move(own, name)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "number": [number], "path": [name], "documents": [len(writer.ends)], "ids": [writer.ids]}
            )

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                coded = table.ids(rows.column("text").to_pylist(), end_id)
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), coded, strict=True):
                    if writer is None:
                        target.create_dir(root)
                        own = f"{root}/.{uuid.uuid4().hex}"
                        writer = Writer(target.open_output_stream(own), width)
                    writer.add(doc_id, ids)
                    if writer.ids >= file_ids or len(writer.ends) >= FILE_DOCUMENTS:
                        yield done()
                        writer, number = None, number + 1
        if writer is not None:
            yield done()
        pretokens.trimmed()

    made = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(
        run, "part long, number long, path string, documents long, ids long"
    )
    manifest, base = [], 0
    for row in sorted(made.collect()):  # a short row a file
        manifest.append({"path": row.path, "documents": row.documents, "ids": row.ids, "base": base})
        base += row.ids
    if manifest:
        target, root = _file_system(folder)
        with target.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (over all files), n_tokens, ids_crc32.

    ``with_ids`` adds the ids as an array.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = [(m["path"], m["base"]) for m in manifest]
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _file_system(folder)[0].open_input_file(path) as f:
                    for names, edges, ids in TokenFile(f).runs():
                        spans = list(zip((edges[:-1] - edges[0]).tolist(), (edges[1:] - edges[0]).tolist(), strict=True))
                        out = {
                            "doc_id": pa.array(names, pa.int64()),
                            "start": pa.array(edges[:-1] + base),
                            "n_tokens": pa.array(np.diff(edges)),
                            "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in spans], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(out)

    return listed.mapInArrow(run, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch.fresh_path(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, manifest)
