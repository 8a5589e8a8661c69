"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on texts labelled good, one on texts labelled bad.  The
difference of a text's two compressed sizes, per byte of the text and per byte of
both results, is what tells them apart; a logistic calibration, fitted on labelled
texts that neither dictionary has seen, turns it into a score.  The length of the
text and how well it compresses at all are inputs of the calibration too, since the
same difference says less about a short text than about a long one.

The dictionaries and the calibration are fitted on a bounded sample of labelled
rows (``sample_rows`` of each label, by the order of a hash of doc_id, texts of at
most SAMPLE_BYTES); every whole text is scored.  Labels, language, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import trimmed

SAMPLE_ROWS = 1800
SAMPLE_BYTES = 32768
DICTIONARY_BYTES = 112640
LEVEL = 3
SEEN_SHARE = 2 / 3  # of the sample, for the dictionaries; the rest is for the calibration


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; without dictionaries every score is ``prior``."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.sizes = [_compressor(d) for d in (model.good, model.bad)] if model.weights else []

    def features(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([[len(c.compress(t)) for c in self.sizes] for t in texts], float).reshape(-1, 2)
        return _features(sizes[:, 0], sizes[:, 1], np.array([max(1, len(t)) for t in texts], float))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.sizes:
            return np.full(len(texts), self.model.prior)
        z = (self.features(texts) - np.array(self.model.mean)) / np.array(self.model.scale)
        return _sigmoid(self.model.weights[0] + z @ np.array(self.model.weights[1:]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(data)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False)


def _features(good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    per_byte, both = (bad - good) / n, np.minimum((good + bad) / (2 * n), 1.5)
    return np.column_stack([per_byte, (bad - good) / (good + bad), both, both**2, np.log(n), per_byte * np.log(n)])


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """The model for labelled texts.  With too few of either label, the share of good ones is the score."""
    cut_good, cut_bad = math.ceil(len(good) * SEEN_SHARE), math.ceil(len(bad) * SEEN_SHARE)
    prior = (len(good) + 1) / (len(good) + len(bad) + 2)
    if min(cut_good, cut_bad) < 8 or len(good) == cut_good or len(bad) == cut_bad:
        return Model(b"", b"", prior=prior)
    dictionaries = []
    for texts in (good[:cut_good], bad[:cut_bad]):
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, texts)) // 4))
        try:
            dictionaries.append(zstandard.train_dictionary(size, texts).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            return Model(b"", b"", prior=prior)
    blank = (0.0,) * 6
    model = Model(*dictionaries, blank, (1.0,) * 6, (0.0, *blank))
    x = Scorer(model).features(good[cut_good:] + bad[cut_bad:])
    y = np.repeat([1.0, 0.0], [len(good) - cut_good, len(bad) - cut_bad])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = _logistic(z, y)
    return Model(*dictionaries, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), prior)


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        x = z @ w
        return float(np.sum(np.logaddexp(0, x) - y * x) + 0.5 * ridge * w @ w)

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = _sigmoid(z @ w)
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, z.T @ (p - y) + ridge * w)
        now, size = loss(w), 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - loss(w) < 1e-9 * (1 + now):
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``fit`` on the sample of ``labels`` (doc_id, quality) that may be learned."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("__id").isNotNull() & ~held_out(F.col("__id"))).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text")).filter(F.octet_length("__text") <= SAMPLE_BYTES)
    # the sample is drawn from rows that can be learned, so that a longer text gives its place to the next row
    known = known.join(texts.select("__id"), "__id", "left_semi")
    order = F.xxhash64("__id")
    picked = [
        known.filter(F.col("quality") == q).select("__id", "quality").orderBy(order, "__id").limit(sample_rows)
        for q in (1, 0)
    ]
    # one text of an id, so that repeated ids cannot give more rows than were picked
    rows = (
        texts.join(picked[0].unionByName(picked[1]), "__id")
        .groupBy("__id", "quality")
        .agg(F.min(F.col("__text").cast("binary")).alias("__text"))
        .collect()
    )
    rows.sort(key=lambda r: (-(r["__id"] * 2654435761 % (1 << 32)), r["__id"], bytes(r["__text"])))
    of = lambda q: [bytes(r["__text"]) for r in rows if r.quality == q]
    return fit(of(1), of(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts are scored as empty.  Null ids stay null and are not held
    out; repeated rows are scored each; an empty table gives an empty result; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )
        trimmed()

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject; all of them where it could not be fitted."""
    if not model.weights:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(scorer.scores(texts) >= 0.5))
        trimmed()

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
