"""Cross-entropy difference of two n-gram models.

A target model (of chosen texts) and a background model (of the whole corpus)
share one vocabulary, order and smoothing.  A document's score is the mean over
its words of the target's loss less the background's, in nats: the lower, the
more the document is like the target.

The vocabulary is all words of the corpus, or the ``words`` most frequent ones
where that is set; other words are one unknown word.  Words and bigrams are counted
one by one, under 64-bit hashes of their bytes with a key that is drawn for each
run, so the models grow with the corpus; of N distinct ones about N^2 / 2^65 share
their count with another one.  No
process holds a whole model: texts are put together in chunks of bounded size,
the distinct keys of a chunk go with their counts to the part of the key space
they lie in, are summed there over all chunks, and the sums go back to the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .near_dup import _WORDS, bytes_of, with_key, word_hashes
from .pretokens import U64, scrambled, trimmed

ROWS = 256  # texts handled at once
CHUNK_BYTES = 1 << 22  # of text, after which a chunk ends; a longer text is one whole
PART_KEYS = 1 << 22  # words and bigrams summed at once, so the parts of the key space grow in number with the corpus
BEGIN, END, UNKNOWN = U64(1), U64(2), U64(3)  # in place of a word's hash


@dataclass(frozen=True)
class LmSpec:
    words: int | None = None  # of the vocabulary; None: all
    pull: float = 8.0  # a word's bigrams weigh count / (count + pull) against its unigram
    extra: float = 0.5  # added to each unigram count
    key: int | None = None  # of the hashes of words; None: drawn for each run


@dataclass(frozen=True)
class Keys:
    """Distinct words (begin and end included) and bigrams of a chunk."""

    keys: np.ndarray  # sorted; of words odd, of bigrams even
    often: np.ndarray  # by key
    place: np.ndarray  # in ``keys``, of the words, then of the bigrams
    before: np.ndarray  # of each distinct bigram, an index of the words
    after: np.ndarray
    bigram: np.ndarray  # of each bigram of the chunk, in the order of texts, an index of the distinct ones
    text: np.ndarray  # of each bigram of the chunk


def _keys(words: np.ndarray, edges: np.ndarray, vocabulary: np.ndarray | None) -> Keys:
    texts, count = len(edges) - 1, np.diff(edges)
    if vocabulary is not None:
        n = len(vocabulary)
        place = np.searchsorted(vocabulary, words)
        known = vocabulary[np.minimum(place, n - 1)] == words if n else np.zeros(len(words), bool)
        words = np.where(known, words, UNKNOWN)
    # each text is begin, its words, end
    line = np.full(len(words) + 2 * texts, BEGIN)
    line[np.arange(len(words)) + np.repeat(2 * np.arange(texts) + 1, count)] = words
    last = np.cumsum(count + 2) - 1
    line[last] = END
    names, ids, single = np.unique(line, return_inverse=True, return_counts=True)
    pairs = np.ones(len(line), bool)
    pairs[last] = False
    at = np.flatnonzero(pairs)
    codes, bigram, double = np.unique(ids[at] * len(names) + ids[at + 1], return_inverse=True, return_counts=True)
    before, after = codes // len(names), codes % len(names)
    keys = np.concatenate([scrambled(names) | U64(1), scrambled(scrambled(names[before]) + names[after]) & ~U64(1)])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    often = np.concatenate([single, double])[order]
    return Keys(keys[order], often, place, before, after, bigram, np.repeat(np.arange(texts), count + 1))


def _losses(k: Keys, counts: np.ndarray, total: int, types: int, spec: LmSpec) -> np.ndarray:
    """-log p(after | before) of the distinct bigrams, interpolated with the unigram; ``counts`` is by key."""
    counts = counts[k.place].astype(float)
    single, pair = counts[: len(counts) - len(k.before)], counts[len(counts) - len(k.before) :]
    context = single[k.before]
    share = context / (context + spec.pull)
    alone = (single[k.after] + spec.extra) / (total + spec.extra * types)
    return -np.log(share * pair / np.maximum(context, 1) + (1 - share) * alone)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")


def _hashes(texts: pa.Array, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a column, made from some texts at a time."""
    words, edges, n = [], [np.zeros(1, np.int64)], 0
    for at in range(0, len(texts), ROWS):
        w, e = word_hashes(*bytes_of(texts.slice(at, ROWS)), key)
        words.append(w)
        edges.append(e[1:] + n)
        n += len(w)
    return np.concatenate([np.zeros(0, U64), *words]), np.concatenate(edges)


def _rows(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    doc_id = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def vocabulary(docs: DataFrame, n: int, text_col: str = "text", key: int = 0) -> np.ndarray:
    """Sorted hashes of the ``n`` most frequent words; ties by the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                words, _ = word_hashes(*bytes_of(batch.column("text").slice(at, ROWS)), key)
                names, often = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(often)], ["word", "n"])

    counts = _rows(docs, text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(n).toArrow()
    return np.sort(top.column("word").to_numpy().astype(np.int64).view(U64))


def _chunks(rows: DataFrame) -> DataFrame:
    """chunk, n_texts, n_words and texts (a compressed stream of doc_id and text), all rows once."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).combine_chunks()
        words = len(_hashes(_column(table, "text"))[0])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays(
            [pa.array([table.num_rows]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["n_texts", "n_words", "texts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            a = 0
            while a < batch.num_rows:
                # up to the text that fills the chunk
                b = min(int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES - size)), batch.num_rows)
                b = max(b, a + 1)
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= CHUNK_BYTES:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)
        trimmed()

    made = rows.mapInArrow(run, "n_texts long, n_words long, texts binary")
    return made.select(F.monotonically_increasing_id().alias("chunk"), "n_texts", "n_words", "texts")


def _texts(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _dealt(chunks: DataFrame, parts: int, target: bool, shared, key: int) -> DataFrame:
    """The keys of each chunk by the part of the key space, with their counts in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                k = _keys(*_hashes(_column(_texts(texts.as_buffer()), "text"), key), shared.value)
                part = ((k.keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                edges = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), chunk)),
                        pa.array(np.full(len(some), target)),
                        pa.array([k.keys[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary()),
                        pa.array([_packed(k.often[edges[p] : edges[p + 1]]) for p in some], pa.binary()),
                    ],
                    ["part", "chunk", "target", "keys", "often"],
                )
        trimmed()

    return chunks.select("chunk", "texts").mapInArrow(
        run, "part int, chunk long, target boolean, keys binary, often binary"
    )


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows with the same value of ``column``, which follow each other."""
    held: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _summed(dealt: DataFrame, parts: int) -> DataFrame:
    """For each chunk and part: the counts of its keys over all of the corpus and of the target.

    A row with a null chunk has the number of distinct words of the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part"):
            rows.sort(key=lambda r: r["target"])
            keys = [np.frombuffer(r["keys"], U64) for r in rows]
            often = np.concatenate([_unpacked(r["often"]) for r in rows])
            edges = np.cumsum([0, *map(len, keys)])
            docs = [k for k, r in enumerate(rows) if not r["target"]]
            cut = edges[len(docs)]
            names, at = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.bincount(at[:cut], often[:cut], len(names)).astype(np.int64)
            chosen = np.bincount(at[cut:], often[cut:], len(names)).astype(np.int64)
            of = lambda x, k: _packed(x[at[edges[k] : edges[k + 1]]])  # noqa: E731, B023
            words = int(((names & U64(1)).astype(bool) & (every > 0)).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *[rows[k]["chunk"] for k in docs]], pa.int64()),
                    pa.array(np.full(len(docs) + 1, rows[0]["part"], np.int32)),
                    pa.array([words, *[0] * len(docs)], pa.int64()),
                    pa.array([None, *[of(every, k) for k in docs]], pa.binary()),
                    pa.array([None, *[of(chosen, k) for k in docs]], pa.binary()),
                ],
                ["chunk", "part", "n_words", "every", "chosen"],
            )
        trimmed()

    rows = dealt.repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "chunk long, part int, n_words long, every binary, chosen binary")


def score(
    docs: DataFrame,
    target: DataFrame,
    spec: LmSpec = LmSpec(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, target_loss, background_loss, score.

    Losses are means over the words and the end of the text.  Null and empty texts
    have the end alone.  Null ids stay null; repeated rows count and are scored
    each; an empty target has no counts, so every word costs the same there; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    spec = with_key(spec)
    names = None if spec.words is None else vocabulary(docs, spec.words, text_col, spec.key)
    shared = spark.sparkContext.broadcast(names)
    chunks = scratch.written(_chunks(_rows(docs, text_col, id_col)), "lm-chunks")
    chosen = scratch.written(_chunks(_rows(target, target_text)), "lm-target")
    totals = [x.agg(F.sum(F.col("n_texts") + F.col("n_words"))).first()[0] or 0 for x in (chosen, chunks)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * sum(totals) // PART_KEYS))
    dealt = _dealt(chunks, parts, False, shared, spec.key).unionByName(_dealt(chosen, parts, True, shared, spec.key))
    counts = scratch.written(_summed(dealt, parts), "lm-counts")
    # begin and end are keyed like words; the end is predicted, the begin never
    distinct = (counts.agg(F.sum("n_words")).first()[0] or 0) - 2
    types = (distinct if names is None else len(names)) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "chunk"):
            table = _texts(rows[0]["texts"])
            words, edges = _hashes(_column(table, "text"), spec.key)
            k, n = _keys(words, edges, shared.value), np.diff(edges)
            mean = []
            for name, total in zip(("chosen", "every"), totals, strict=True):
                counts = np.concatenate([_unpacked(r[name]) for r in rows[1:]])
                loss = _losses(k, counts, total, types, spec)
                mean.append(np.bincount(k.text, loss[k.bigram], len(n)) / (n + 1))
            yield pa.RecordBatch.from_arrays(
                [_column(table, "doc_id"), *map(pa.array, (n, *mean, mean[0] - mean[1]))],
                ["doc_id", "n_words", "target_loss", "background_loss", "score"],
            )
        trimmed()

    empty = F.lit(None).cast("binary")
    rows = chunks.select("chunk", F.lit(-1).alias("part"), "texts", empty.alias("every"), empty.alias("chosen"))
    back = counts.filter("chunk is not null").select("chunk", "part", empty.alias("texts"), "every", "chosen")
    rows = rows.unionByName(back).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    return rows.mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def _sql() -> str:
    """The same by the formulas, over rows of words; begin is an empty word, end is null in its place."""
    spec = LmSpec()

    def model(name: str, table: str) -> str:
        return f"""{name}_line AS (SELECT unnest(list_concat([''], w, [NULL])) AS a, unnest(list_concat(w, [NULL, NULL])) AS b,
  unnest(range(0, len(w) + 2)) <= len(w) AS inside FROM (SELECT {_WORDS} AS w FROM {table})),
{name}_one AS (SELECT coalesce(a, chr(10)) AS a, count(*) AS n FROM {name}_line GROUP BY 1),
{name}_two AS (SELECT a, coalesce(b, chr(10)) AS b, count(*) AS n FROM {name}_line WHERE inside GROUP BY 1, 2),
{name}_total AS (SELECT count(*) AS total FROM {name}_line WHERE inside)"""

    def loss(name: str) -> str:
        alone = f"(coalesce(s{name}.n, 0) + {spec.extra}) / (total_{name} + {spec.extra} * types)"
        context = f"coalesce(c{name}.n, 0)"
        share = f"{context} / ({context} + {spec.pull}::DOUBLE)"
        return f"-ln({share} * coalesce(p{name}.n, 0) / greatest({context}, 1) + (1 - {share}) * {alone})"

    def joined(name: str) -> str:
        return f"""LEFT JOIN {name}_one c{name} ON c{name}.a = x.a LEFT JOIN {name}_one s{name} ON s{name}.a = x.b
  LEFT JOIN {name}_two p{name} ON p{name}.a = x.a AND p{name}.b = x.b"""

    return f"""WITH {model('d', 'documents')}, {model('t', 'benchmark')},
types AS (SELECT count(*) AS types FROM d_one),
totals AS (SELECT d_total.total AS total_d, t_total.total AS total_t, types FROM d_total, t_total, types),
rows_ AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
x AS (SELECT r, a, coalesce(b, chr(10)) AS b FROM (SELECT r, unnest(list_concat([''], w)) AS a, unnest(list_concat(w, [NULL])) AS b FROM rows_)),
each AS (SELECT r, avg({loss('t')}) AS target_loss, avg({loss('d')}) AS background_loss
  FROM x, totals {joined('t')} {joined('d')} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(target_loss, 6) AS target_loss, round(background_loss, 6) AS background_loss,
  round(target_loss - background_loss, 6) + 0.0 AS score FROM rows_ JOIN each ON rows_.r = each.r"""


ORACLE = _sql()


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    six = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return rows.select("doc_id", "n_words", six("target_loss"), six("background_loss"), six("score"))
