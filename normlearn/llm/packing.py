"""Packing token ids into windows with the sum-of-squares rule.

A task packs its own rows, so nothing is shuffled.  An array holds, for each fill
level, the number of windows filled to it.  A document gives as many full windows
as it can; what is left goes to the level (or a new window) where the sum of the
squares of those numbers becomes smallest, ties to the fullest window.  A window
that reaches its length is done.  Where the open windows hold more than HELD ids,
and when the task ends, they are put together: the emptiest windows are emptied
into the fullest, cutting documents where needed.  So a task holds a bounded number
of ids, and at most one of its windows is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .token_counts import vocabulary

WINDOW, END_ID = 2048, 1
HELD = 1 << 21  # ids in the open windows of a task
ROWS = 128  # texts encoded at once
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: (doc_id, start, doc_tokens, ids)
Piece = tuple


class Packer:
    """Windows of one task.  ``add`` and ``close`` return the windows that are done, as lists of pieces."""

    def __init__(self, size: int, most: int = HELD) -> None:
        self.size, self.most = size, most
        self.held = 0  # ids in open windows
        self.level = np.zeros(size + 1, np.int64)  # windows by fill; none counted at 0 and size
        self.open: dict[int, list[list[Piece]]] = {}

    def _taken(self, h: int) -> list[Piece]:
        self.level[h] -= 1
        self.held -= h
        return self.open[h].pop()

    def _opened(self, h: int, window: list[Piece]) -> None:
        self.level[h] += 1
        self.held += h
        self.open.setdefault(h, []).append(window)

    def best(self, n: int) -> int:
        """The level to put ``n`` ids on top of: 0 is a new window."""
        level, size = self.level, self.size
        # squares after moving one window from h to h + n, less squares before
        change = 2 * (level[n : size + 1] - level[: size - n + 1]) + 2
        change[-1] = 1 - 2 * level[size - n]
        change[0] = 2 * level[n] + 1 if n < size else 0
        usable = level[: size - n + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(size - n - np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, size = len(ids), self.size
        whole = total // size * size
        for at in range(0, whole, size):
            yield [(doc_id, at, total, ids[at : at + size])]
        rest = total - whole
        if not rest:
            return
        h = self.best(rest)
        window = self._taken(h) if h else []
        window.append((doc_id, whole, total, ids[whole:]))
        if h + rest == size:
            yield window
        else:
            self._opened(h + rest, window)
            if self.held > self.most:
                yield from self.together(self.most // 2)

    def together(self, left: int) -> Iterator[list[Piece]]:
        """Fills windows out of the emptiest ones until no more than ``left`` ids, or one window, are open."""
        while self.held > left:
            levels = np.flatnonzero(self.level)
            top = int(levels[-1])
            window, room = self._taken(top), self.size - top
            while room and self.held:
                low = int(np.argmax(self.level > 0))
                other = self._taken(low)
                doc_id, start, total, ids = other.pop()
                fits = min(room, len(ids))
                window.append((doc_id, start, total, ids[:fits]))
                if fits < len(ids):
                    other.append((doc_id, start + fits, total, ids[fits:]))
                if other:
                    self._opened(low - fits, other)
                room -= fits
            if room:  # there was no other window
                self._opened(self.size - room, window)
                return
            yield window

    def close(self) -> Iterator[list[Piece]]:
        yield from self.together(0)
        for h in np.flatnonzero(self.level).tolist():  # at most one
            yield self._taken(h)


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ids of each text of ``docs``, then ``end_id``, in windows of at most ``window`` ids.

    One row per piece: doc_id, start (ids of the document before it), length, ids
    (little-endian 32-bit), doc_tokens, sequence_id, offset (in the window).  The
    pieces of a document cover it; the offsets of a window have no gaps.

    Null and empty texts are ``end_id`` alone.  Null ids stay null and repeated
    rows are packed each.  An empty table gives an empty result; other columns
    are ignored.  Windows depend on how rows are dealt to tasks.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, packer = pretokens.table(path), Packer(window)
        sequence = TaskContext.get().partitionId() << 33
        done: list[list[Piece]] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            nonlocal sequence, held
            rows = []
            for pieces in done:
                offset = 0
                for doc_id, start, total, ids in pieces:
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            done.clear()
            held = 0
            pretokens.trimmed()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = table.ids(part.column("text").to_pylist(), end_id)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    for full in packer.add(doc_id, ids):
                        done.append(full)
                        held += 1
                if held >= 250:
                    yield flushed()
        done.extend(packer.close())
        if done:
            yield flushed()

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return source.mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of the ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
