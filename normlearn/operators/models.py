"""A catalog of models: coefficients and the gradient of their last pass, by number.

Mirrors model-state functions of a database: push allocates, put sets the
coefficients and clears the gradient, get returns both, pop drops.  State is on the
driver; ``save`` and ``load`` keep a catalog as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlearn.functions import vectors as V
from normlearn.operators.data import NormalizedData
from normlearn.plans import gradient as G

CATALOG_SCHEMA = "mid int, d_s int, d_r int, w array<double>, g array<double>"


@dataclass
class Model:
    """``d_s`` entity and ``d_r`` attribute features; a flat model has only the former."""

    d_s: int
    d_r: int
    w: np.ndarray
    g: np.ndarray


@dataclass
class Catalog:
    models: dict[int, Model] = field(default_factory=dict)

    def push(self, mid: int, d_s: int, d_r: int = 0) -> Model:
        if mid in self.models:
            raise ValueError(f"model {mid} is there already")
        self.models[mid] = Model(d_s, d_r, np.zeros(d_s + d_r), np.zeros(d_s + d_r))
        return self.models[mid]

    def __getitem__(self, mid: int) -> Model:
        if mid not in self.models:
            raise KeyError(f"no model {mid}")
        return self.models[mid]

    def put(self, mid: int, w) -> None:
        model, w = self[mid], np.array(w, float)
        if w.shape != model.w.shape:
            raise ValueError(f"model {mid} has {len(model.w)} coefficients, not {len(w)}")
        model.w, model.g = w, np.zeros(len(w))

    def get(self, mid: int) -> np.ndarray:
        """Coefficients, then the gradient."""
        return np.concatenate([self[mid].w, self[mid].g])

    def pop(self, mid: int) -> None:
        self[mid]  # an unknown number is an error
        del self.models[mid]

    def gradient(self, mid: int, data: NormalizedData | DataFrame, approach: str = "f", k: int | None = None) -> float:
        """The loss of a pass over normalized data or flat rows (label, x); adds to the model's gradient."""
        model = self[mid]
        w = model.w.tolist()
        plan = G.build(data, w, approach, None, k) if isinstance(data, NormalizedData) else G.over_rows(data, w)
        loss, g = G.collected(plan)
        model.g = model.g + g
        return loss

    def loss(self, mid: int, x: Column, y: Column) -> Column:
        """A row's loss."""
        return V.row_loss(V.sign_label(y), V.dot_literal(x, self[mid].w.tolist()))

    def probability(self, mid: int, x: Column) -> Column:
        return V.sigmoid(V.dot_literal(x, self[mid].w.tolist()))

    def register(self, spark: SparkSession, mid: int) -> None:
        """``model_<mid>_loss(x, y)`` and ``model_<mid>_probability(x)`` as SQL functions with the present coefficients."""
        w = ", ".join(f"{v!r}D" for v in self[mid].w.tolist())
        wx = f"aggregate(zip_with(x, array({w}), (a, b) -> a * b), 0D, (s, v) -> s + v)"
        make = "CREATE OR REPLACE TEMPORARY FUNCTION"
        spark.sql(f"{make} model_{mid}_probability(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1D / (1D + exp(-{wx}))")
        y = "CASE WHEN y > 0 THEN 1D WHEN y IS NOT NULL THEN -1D END"
        spark.sql(
            f"{make} model_{mid}_loss(x ARRAY<DOUBLE>, y DOUBLE) RETURNS DOUBLE "
            f"RETURN greatest(-({y}) * {wx}, 0D) + log1p(exp(-abs({wx})))"
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(mid, m.d_s, m.d_r, m.w.tolist(), m.g.tolist()) for mid, m in sorted(self.models.items())]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        rows = spark.read.schema(CATALOG_SCHEMA).parquet(path).collect()  # a row a model
        return cls({r.mid: Model(r.d_s, r.d_r, np.array(r.w), np.array(r.g)) for r in rows})


def random_vector(n: int, seed: int) -> Column:
    """n uniform numbers between 0 and 1, others in each row."""
    # Spark adds a partition's number to a seed, so seeds lie far apart
    return F.array(*[F.rand(seed + 1_000_003 * i) for i in range(n)])
