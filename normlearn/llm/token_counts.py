"""Token counts of whole texts by a two-tier lookup on the map side.

A compact table of the token counts of frequent pre-tokens is built once from a
bounded sample and broadcast.  A task cuts its texts into pre-tokens, looks them
up there, takes those that are missing from its worker's own cache, and lets the
library encode only what neither holds.  No pre-token is shuffled.

Both tiers hold what the library returned for the same bytes, so counts do not
depend on the sample.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens

HOT_BITS = 16  # the broadcast table has 2^16 slots of 35 bytes
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 4 << 20
ROWS = 128  # texts counted at once


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hot_table(texts: list[str], path: str, bits: int = HOT_BITS) -> pretokens.Slots:
    """The token counts of the most frequent pre-tokens of ``texts``."""
    table = pretokens.Table(path, bits=16, pool=1 << 21)
    seen: dict[bytes, list[int]] = {}
    for numbers, parts in pretokens.segments(texts, table.special):
        if numbers[0] < 0:
            continue
        pieces = pretokens.Pieces.of(parts)
        count = table.lookup(pieces)[2].tolist()
        for a, b, n in zip(pieces.starts.tolist(), pieces.ends.tolist(), count, strict=True):
            if b - a <= pretokens.KEY_BYTES and n < 1 << 16:
                seen.setdefault(pieces.data[a:b], [n, 0])[1] += 1
    hot = pretokens.Slots(bits, count=np.uint16)
    best = sorted(seen.items(), key=lambda x: (-x[1][1], x[0]))  # the most frequent one takes its slot
    if best:
        sizes = np.array([len(p) for p, _ in best])
        ends = np.cumsum(sizes)
        rows, sizes, hashes = pretokens.Pieces(b"".join(p for p, _ in best), ends - sizes, ends, ends[:0]).keys()
        hot.put(rows, sizes, hashes, count=np.array([n for _, (n, _) in best]))
    return hot


def _counted(table: pretokens.Table, parts: list[str], hot: pretokens.Slots) -> tuple[np.ndarray, np.ndarray]:
    """The token count of each pre-token of ``parts``, and where each part's begin."""
    pieces = pretokens.Pieces.of(parts)
    rows, sizes, hashes = pieces.keys()
    slot, hit = hot.find(rows, sizes, hashes)
    count = hot.columns["count"][slot].astype(np.int64)
    rest = np.flatnonzero(~hit)
    if len(rest):
        missed = pretokens.Pieces(pieces.data, pieces.starts[rest], pieces.ends[rest], rest[:0])
        count[rest] = table.lookup(missed, (rows[rest], sizes[rest], hashes[rest]))[2]
    return count, pieces.first


def is_byte_level(path: str) -> bool:
    """Whether a .json vocabulary is plain byte-level BPE, which counts pre-token by pre-token."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(plain and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec.get("truncation"))


def _library_counts(path: str, texts: list[str]) -> list[int]:
    """Counts of whole texts by the library of the vocabulary."""
    if path.endswith(".model"):
        import sentencepiece

        return list(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: list[str], path: str, hot) -> np.ndarray:
    """The number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    if hot is None:
        out[:] = _library_counts(path, texts)
        return out
    table = pretokens.table(path)
    for numbers, parts in pretokens.segments(texts, table.special):
        if numbers[0] < 0:
            out[-1 - numbers[0]] = len(table._library(parts)[0])
            continue
        count, first = _counted(table, parts, hot)
        np.add.at(out, numbers, np.add.reduceat(count, first))
    return out


def _sample(source: DataFrame, rows: int) -> list[str]:
    """Whole texts of rows from all over the table, of SAMPLE_BYTES together at most."""
    many = source.count()
    share = min(1.0, 1.2 * rows / max(many, 1))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    size = F.octet_length("text")
    picked = source.filter(chance & (size <= SAMPLE_BYTES // 64)).select("text").limit(min(rows, 64 * (SAMPLE_BYTES >> 16)))
    out, total = [], 0
    for r in picked.toLocalIterator():
        total += len(r.text)
        if total > SAMPLE_BYTES:
            break
        out.append(r.text)
    return out


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts are the library's for the whole text, without special tokens added.
    Null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated
    rows are counted each; an empty table gives an empty result; other columns
    are ignored.  The sample (about ``sample_rows`` rows by a hash of the row, whole
    texts of SAMPLE_BYTES together at most) only decides which counts are broadcast.
    """
    path = path or vocabulary()
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    hot = None
    if is_byte_level(path):
        hot = hot_table(_sample(source, sample_rows), path)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = range(0, batch.num_rows, ROWS)
            text = batch.column("text")
            each = [count_texts(text.slice(at, ROWS).to_pylist(), path, shared.value) for at in parts]
            n = np.concatenate(each) if each else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
