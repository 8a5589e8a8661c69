"""Training: descent methods with a backtracking line search over any plan.

The driver holds the coefficients; each pass is one Spark job that returns one
row.  A line search evaluates several step sizes in one job, since a row's product
is linear in the step, and takes the first that passes, as one at a time would.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from normlearn.functions import vectors as V
from normlearn.operators.data import NormalizedData, parts_by_key, validate
from normlearn.plans import gradient as G
from normlearn.sources.spec import TrainSpec

ARMIJO, SHRINK, RUNGS, MEMORY = 1e-4, 0.5, 8, 5
TRACE_SCHEMA = "iter int, loss double, grad_norm double, ls_count int, alpha double"


@dataclass
class FitResult:
    """Coefficients, and a row per iteration: iter, loss, grad_norm, ls_count, alpha (before it is enlarged)."""

    w: np.ndarray
    trace: list[tuple] = field(default_factory=list)
    status: str = "iterations"

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, TRACE_SCHEMA)

    def model_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.w)], "i int, w double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The coefficients as Parquet."""
        self.model_frame(spark).write.mode("overwrite").parquet(path)

    def to_json(self) -> str:
        return json.dumps({"w": self.w.tolist(), "status": self.status, "trace": self.trace})


class SearchFailed(RuntimeError):
    pass


@dataclass
class Objective:
    """Loss and gradient with the regulariser, and the loss along a direction."""

    gradient: Callable[[np.ndarray], tuple[float, np.ndarray]]
    along: Callable[[np.ndarray, np.ndarray, list[float]], list[float]]
    regularizer: float

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = self.gradient(w)
        return loss + self.regularizer * 0.5 * float(w @ w), g + self.regularizer * w

    def steps(self, w: np.ndarray, p: np.ndarray, alphas: list[float]) -> list[float]:
        losses = self.along(w, p, alphas)
        return [x + self.regularizer * 0.5 * float((w + a * p) @ (w + a * p)) for x, a in zip(losses, alphas, strict=True)]


def line_search(objective: Objective, start: float, phi0: float, slope: float, w: np.ndarray, p: np.ndarray, most: int) -> tuple[float, int]:
    """(step, trials): the first of start, start/2, ... with enough decrease.

    The objective is convex, so it decreases nowhere along a direction of no descent,
    and a step that seems to pass there passes by rounding alone.
    """
    if not slope < 0:
        raise SearchFailed(f"the direction does not descend: its slope is {slope}")
    tried = 0
    while tried < most:
        alphas = [start * SHRINK**k for k in range(tried, min(tried + RUNGS, most))]
        for alpha, phi in zip(alphas, objective.steps(w, p, alphas), strict=True):
            tried += 1
            if phi <= phi0 + ARMIJO * alpha * slope:
                return alpha, tried
    raise SearchFailed(f"no step from {start} on decreases the loss enough after {most} trials")


def _two_loops(pairs: list[tuple[np.ndarray, np.ndarray]], g: np.ndarray, compat: bool) -> np.ndarray:
    """The L-BFGS direction.  ``compat`` recomputes the first loop's coefficients in the second from its final vector."""
    usable = [(s, t) for s, t in pairs if t @ t > 0 and s @ t != 0 and (compat or s @ t > 0)]
    if not usable:
        return -g
    q, first = g.copy(), []
    for s, t in reversed(usable):
        c = (s @ q) / (s @ t)
        first.append(c)
        q = q - c * t
    s, t = usable[-1]
    r = (s @ t) / (t @ t) * q
    for (s, t), c in zip(usable, reversed(first), strict=True):
        c = (s @ q) / (s @ t) if compat else c
        r = r + (c - (t @ r) / (s @ t)) * s
    return -r


def minimize(objective: Objective, w: np.ndarray, spec: TrainSpec) -> FitResult:
    """Runs ``spec.algo`` from w.  The line search's step, enlarged by ``spec.grow``, is used.

    The next search starts from it, and the first one from ``spec.stepsize``; those of L-BFGS all start from 1.
    """
    out = FitResult(w)
    step, before, pairs = spec.stepsize, None, []
    for k in range(spec.iters):
        loss, g = objective.at(w)
        size = float(g @ g)
        out.trace.append((k + 1, loss, math.sqrt(size), None, None))
        if spec.tolerance is not None and before and before[0] and (before[0] - loss) / before[0] <= spec.tolerance:
            out.status = "tolerance"
            break
        if not size:
            out.status = "stationary"
            break
        p = -g
        if before and spec.algo == "cgd":
            old = float(before[1] @ before[1])
            p = -g + (size / old if old else 1.0) * before[2]
            if spec.restart and g @ p >= 0:
                p = -g
        elif before and spec.algo in ("lbfgs", "lbfgs_compat"):
            pairs = [*pairs, (w - before[3], g - before[1])][-MEMORY:]
            p = _two_loops(pairs, g, spec.algo == "lbfgs_compat")
        quasi = spec.algo.startswith("lbfgs")
        try:
            alpha, trials = line_search(objective, 1.0 if quasi else step, loss, float(g @ p), w, p, spec.max_trials)
        except SearchFailed:
            out.status = "line search failed"
            break
        out.trace[-1] = (k + 1, loss, math.sqrt(size), trials, alpha)
        before = (loss, g, p, w)
        step = spec.grow * alpha
        w = w + step * p
        out.w = w
    return out


def _objective(
    spark: SparkSession,
    gradient: Callable[[Sequence[float]], DataFrame],
    products: Callable[[list[Sequence[float]]], DataFrame],
    regularizer: float,
) -> Objective:
    """An objective by plans of a pass and of rows' products; coefficients and steps are no part of their code."""

    def along(w: np.ndarray, p: np.ndarray, steps: list[float]) -> list[float]:
        d, every = len(w), V.Coefficients.of(spark, [*w.tolist(), *p.tolist(), *steps])
        return list(G.ladder(products([every[:d], every[d : 2 * d]]), every[2 * d :]).first())

    return Objective(lambda w: G.collected(gradient(V.Coefficients.of(spark, w.tolist()))), along, regularizer)


def fit(data: NormalizedData, spec: TrainSpec = TrainSpec(), table: DataFrame | None = None, check: bool = True) -> FitResult:
    """Trains over ``data``; approaches m and t over its join, which ``table`` may give."""
    counts = validate(data, spec.strict_fk) if check or spec.approach == "auto" else {}
    if spec.approach == "sr":
        data = data.split(spec.srsplits).kept()
    else:
        data = data.cached(parts_by_key(data, counts) if counts and spec.approach in ("s", "f", "fsql", "auto") else None)
    approach, joined = spec.approach, None
    try:
        if approach == "auto":
            approach = G.choose(data, counts["n_s"], counts["n_r"])
        if approach in ("m", "t"):
            joined = (table if table is not None else G.denormalized(data)).persist()
        objective = _objective(
            data.s.sparkSession,
            lambda w: G.build(data, w, approach, joined, spec.srsplits),
            lambda vectors: G.products(data, vectors, approach, joined),
            spec.regularizer,
        )
        return minimize(objective, np.full(data.d, spec.w_init), spec)
    finally:
        data.release()
        if joined is not None:
            joined.unpersist()


def fit_rows(rows: DataFrame, spec: TrainSpec, d: int | None = None) -> FitResult:
    """Trains over one flat table (label, x)."""
    from pyspark.sql import functions as F

    rows = rows.select(V.sign_label(F.col("label").cast("double")).alias("label"), F.col("x").cast("array<double>").alias("x"))
    rows = rows.dropna().persist()
    try:
        if d is None:
            first = rows.select(F.size("x")).first()
            d = first[0] if first else 0
        objective = _objective(
            rows.sparkSession,
            lambda w: G.over_rows(rows, w),
            lambda vectors: rows.select("label", *[V.dot_literal(F.col("x"), v).alias(f"p{i}") for i, v in enumerate(vectors)]),
            spec.regularizer,
        )
        return minimize(objective, np.full(d, spec.w_init), spec)
    finally:
        rows.unpersist()


def predict(data: NormalizedData, w: np.ndarray, factorized: bool = True) -> DataFrame:
    """sid and the probability of label 1 for each joined row."""
    from pyspark.sql import functions as F

    if factorized:
        rows = G.scored(data, list(w)).select("sid", "wx")
    else:
        rows = G.denormalized(data).select("sid", V.dot_literal(F.col("x"), list(w)).alias("wx"))
    return rows.select("sid", V.sigmoid(F.col("wx")).alias("p"))
