"""Loss and gradient of a logistic model over normalized data, by interchangeable plans.

Every plan is a lazy DataFrame of one row (loss, g0, g1, ...) with the sums over
all joined rows, without the regulariser.  They differ in what they join:

* ``materialize``: the join is written or cached once, each pass scans it;
* ``stream``: entity rows join whole attribute rows, in each pass;
* ``stream_reuse``: the same in hash partitions of the key that both tables share;
* ``factorized``: entity rows join one number per attribute row, its part of the
  product; sums per key then join the attribute vectors, once per key;
* ``fsql``: the same with its intermediate tables spelled out.

Partial sums happen before each shuffle, so no plan moves more than one row per
key and task, apart from the joins.  Spark broadcasts an attribute side that is
small by its own size estimate, and splits skewed partitions of others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlearn.functions import vectors as V
from normlearn.operators.data import NormalizedData


def names(d: int) -> list[str]:
    return [f"g{i}" for i in range(d)]


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _sums(d: int, x: str, scale: str = "c", first: int = 0) -> list[Column]:
    return [_sum(F.col(scale) * F.get(x, i)).alias(f"g{first + i}") for i in range(d)]


def denormalized(data: NormalizedData, key: str = "sid") -> DataFrame:
    """The join: sid or rid (``key``), label, x.  Entity rows without a match are not in it."""
    joined = data.s.join(data.r, data.s["forkey"] == data.r["rid"])
    return joined.select(key, "label", F.concat("xs", "xr").alias("x"))


def _products(parts: Sequence[tuple[str, Sequence[float]]]) -> Column:
    """The product of a row's vectors, taken one by one, with their coefficients."""
    d = sum(len(w) for _, w in parts)
    out = V.dot_literal(F.col(parts[0][0]), parts[0][1], d)
    for column, w in parts[1:]:
        out = out + V.dot_literal(F.col(column), w, d)
    return out


def _scaled(rows: DataFrame, parts: Sequence[tuple[str, Sequence[float]]], keep: Sequence[str] = ()) -> DataFrame:
    """Each row's loss (l), gradient scale (c) and vectors."""
    columns = [name for name, _ in parts]
    rows = rows.select(*keep, "label", *columns, _products(parts).alias("wx"))
    return rows.select(
        *keep, *columns, V.row_loss(F.col("label"), F.col("wx")).alias("l"), V.gradient_scale(F.col("label"), F.col("wx")).alias("c")
    )


#: A vector column, the column it is scaled by, its length, and its place in the gradient.
Part = tuple[str, str, int, int]


def _times(x: str, c: Column) -> Column:
    return F.transform(x, lambda v: v * c)


def _totals(rows: DataFrame, plain: Sequence[Column], parts: Sequence[Part], by: str | None = None) -> DataFrame:
    """``plain`` sums and the sums of scaled vectors as g0, g1, ..., of all rows or of those of each ``by``.

    Short vectors are summed element by element in generated code.  Long ones are
    summed whole by the vector summary aggregate, which also has partial sums.
    """
    sums, picked = list(plain), []
    for x, c, n, first in parts:
        if n <= V.UNROLL:
            sums += _sums(n, x, c, first)
            picked += [F.col(f"g{first + i}") for i in range(n)]
        else:
            sums.append(vector_to_array(Summarizer.sum(array_to_vector(_times(x, F.col(c))))).alias(f"v{first}"))
            picked += [F.coalesce(F.get(f"v{first}", i), F.lit(0.0)).alias(f"g{first + i}") for i in range(n)]
    if by:
        summed = rows.groupBy(by).agg(*sums)
    else:
        if any(n > V.UNROLL for _, _, n, _ in parts):  # the vector summary needs a row
            rows = rows.unionByName(_zero_row(rows, parts))
        summed = rows.agg(*sums)
    of_parts = {f"g{first + i}" for _, _, n, first in parts for i in range(n)} | {f"v{first}" for *_, first in parts}
    return summed.select(*[c for c in summed.columns if c not in of_parts], *picked)


def _zero_row(rows: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """A row like ``rows`` that adds nothing to any sum."""
    lengths = {x: n for x, _, n, _ in parts}
    columns = [
        (V.zeros(lengths[c]) if c in lengths else (F.lit(None) if t.startswith("array") else F.lit(0)).cast(t)).alias(c)
        for c, t in rows.dtypes
    ]
    return rows.sparkSession.range(1).select(*columns)


def _gradient(rows: DataFrame, parts: Sequence[tuple[str, Sequence[float]]], by: str | None = None) -> DataFrame:
    """The loss and the gradient over the vectors in their order, of rows of ``_scaled``."""
    places, first = [], 0
    for column, w in parts:
        places.append((column, "c", len(w), first))
        first += len(w)
    return _totals(rows, [_sum(F.col("l")).alias("loss")], places, by)


def over_rows(rows: DataFrame, w: Sequence[float]) -> DataFrame:
    """One pass over rows (label, x)."""
    parts = [("x", w)]
    return _gradient(_scaled(rows, parts), parts)


def materialize(table: DataFrame, w: Sequence[float]) -> DataFrame:
    """A pass over the written or cached join."""
    return over_rows(table, w)


def _sides(data: NormalizedData, w: Sequence[float]) -> list[tuple[str, Sequence[float]]]:
    """Both tables' vectors and their coefficients; the vectors are never put together."""
    return [("xs", w[: data.d_s]), ("xr", w[data.d_s :])]


def stream(data: NormalizedData, w: Sequence[float]) -> DataFrame:
    parts = _sides(data, w)
    joined = data.s.join(data.r, data.s["forkey"] == data.r["rid"])
    return _gradient(_scaled(joined, parts), parts)


def stream_reuse(data: NormalizedData, w: Sequence[float], k: int) -> DataFrame:
    """The sum over k hash partitions of the key, each joined by itself.

    Tables that are split already (``NormalizedData.split``, kept for the passes of
    a training run) are used as they are; others are split in this pass.
    """
    if data.dealt != k:
        data = data.split(k)
    joined = data.s.join(data.r.hint("merge"), data.s["forkey"] == data.r["rid"])
    parts = _sides(data, w)
    each = _gradient(_scaled(joined.select(F.spark_partition_id().alias("part"), "label", "xs", "xr"), parts, ["part"]), parts, "part")
    return each.agg(_sum(F.col("loss")).alias("loss"), *[_sum(F.col(g)).alias(g) for g in names(len(w))])


def partial_products(data: NormalizedData, w_r: Sequence[float]) -> DataFrame:
    """rid and the attribute part of the product (pdp)."""
    return data.r.select("rid", V.dot_literal(F.col("xr"), w_r, data.d).alias("pdp"))


def scored(data: NormalizedData, w: Sequence[float], partial: DataFrame | None = None) -> DataFrame:
    """sid, rid, xs, wx, l (loss), c (gradient scale) of each entity row, from the partial products."""
    partial = partial_products(data, w[data.d_s :]) if partial is None else partial
    joined = data.s.join(partial, data.s["forkey"] == partial["rid"])
    wx = F.col("pdp") + V.dot_literal(F.col("xs"), w[: data.d_s], data.d)
    rows = joined.select("sid", "rid", "label", "xs", wx.alias("wx"))
    return rows.select(
        "sid", "rid", "xs", "wx",
        V.row_loss(F.col("label"), F.col("wx")).alias("l"), V.gradient_scale(F.col("label"), F.col("wx")).alias("c"),
    )


def per_key(data: NormalizedData, w: Sequence[float], partial: DataFrame | None = None) -> DataFrame:
    """For each key with entity rows: loss, sg (sum of scales), and gs, the entity part of the gradient.

    Short gradients are columns g0, g1, ... in place of the vector gs.
    """
    plain = [F.sum("l").alias("loss"), F.sum("c").alias("sg")]
    rows = scored(data, w, partial)
    if data.d_s <= V.UNROLL:
        return rows.groupBy("rid").agg(*plain, *_sums(data.d_s, "xs"))
    whole = vector_to_array(Summarizer.sum(array_to_vector(_times("xs", F.col("c")))))
    return rows.groupBy("rid").agg(*plain, whole.alias("gs"))


def _entity_side(d_s: int) -> tuple[list[Column], list[Part]]:
    """What of ``per_key`` gives the loss and the entity part of the gradient: plain sums, and vectors to sum."""
    loss = _sum(F.col("loss")).alias("loss")
    if d_s <= V.UNROLL:
        return [loss, *[_sum(F.col(g)).alias(g) for g in names(d_s)]], []
    return [loss], [("gs", "one", d_s, 0)]


def entity_sums(keys: DataFrame, d_s: int) -> DataFrame:
    """The entity side's totals of ``per_key``: loss and its part of the gradient."""
    plain, parts = _entity_side(d_s)
    return _totals(keys.withColumn("one", F.lit(1.0)), plain, parts)


def attribute_sums(keys: DataFrame, data: NormalizedData) -> DataFrame:
    """The attribute part of the gradient, from the sums of scales of ``per_key``."""
    joined = keys.select("rid", "sg").join(data.r, "rid").select("sg", "xr")
    return _totals(joined, [], [("xr", "sg", data.d_r, data.d_s)])


def factorized(data: NormalizedData, w: Sequence[float]) -> DataFrame:
    """Both sides' sums from one pass over the sums per key."""
    joined = per_key(data, w).join(data.r, "rid").drop("rid").withColumn("one", F.lit(1.0))
    plain, parts = _entity_side(data.d_s)
    return _totals(joined, plain, [*parts, ("xr", "sg", data.d_r, data.d_s)])


def hs_plus(data: NormalizedData, w: Sequence[float]) -> DataFrame:
    """rid and lg = [loss, sum of scales, entity part of the gradient]."""
    keys = per_key(data, w)
    head = ["loss", "sg", *(names(data.d_s) if data.d_s <= V.UNROLL else [])]
    lg = F.array(*head) if data.d_s <= V.UNROLL else F.concat(F.array(*head), "gs")
    return keys.select("rid", lg.alias("lg"))


def fsql(data: NormalizedData, w: Sequence[float]) -> DataFrame:
    joined = hs_plus(data, w).join(data.r, "rid")
    of_lg = [F.get("lg", 2 + i).alias(g) for i, g in enumerate(names(data.d_s))]
    if data.d_s > V.UNROLL:
        of_lg = [F.slice("lg", 3, data.d_s).alias("gs")]
    rows = joined.select(F.get("lg", 0).alias("loss"), F.get("lg", 1).alias("sg"), F.lit(1.0).alias("one"), "xr", *of_lg)
    plain, parts = _entity_side(data.d_s)
    return _totals(rows, plain, [*parts, ("xr", "sg", data.d_r, data.d_s)])


#: What ``auto`` needs to see before it factorizes: attribute vectors this wide, and
#: this many entity rows per key; measured with narrow and wide attribute tables.
WIDE, MANY = 8, 5


def choose(data: NormalizedData, n_s: int, n_r: int) -> str:
    """The approach for tables of these sizes."""
    return "f" if data.d_r >= WIDE and n_s >= MANY * max(n_r, 1) else "s"


def build(data: NormalizedData, w: Sequence[float], approach: str, table: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """The pass of an approach: m and t need the joined ``table``, sr needs ``k``."""
    if len(w) != data.d:
        raise ValueError(f"{len(w)} coefficients for {data.d} features")
    if approach in ("m", "t"):
        return materialize(table if table is not None else denormalized(data), w)
    if approach == "s":
        return stream(data, w)
    if approach == "sr":
        return stream_reuse(data, w, k)
    if approach == "f":
        return factorized(data, w)
    if approach == "fsql":
        return fsql(data, w)
    raise ValueError(f"no plan for approach {approach!r}")


def products(data: NormalizedData, vectors: Sequence[Sequence[float]], approach: str, table: DataFrame | None = None) -> DataFrame:
    """label and p0, p1, ...: the products of each joined row with several vectors, factorized where the approach is."""
    if approach in ("f", "fsql"):
        parts = data.r.select("rid", *[V.dot_literal(F.col("xr"), w[data.d_s :]).alias(f"q{i}") for i, w in enumerate(vectors)])
        joined = data.s.join(parts, data.s["forkey"] == parts["rid"])
        return joined.select(
            "label", *[(F.col(f"q{i}") + V.dot_literal(F.col("xs"), w[: data.d_s])).alias(f"p{i}") for i, w in enumerate(vectors)]
        )
    rows = table if table is not None else denormalized(data)
    return rows.select("label", *[V.dot_literal(F.col("x"), w).alias(f"p{i}") for i, w in enumerate(vectors)])


def ladder(products_: DataFrame, steps: Sequence[float]) -> DataFrame:
    """phi0, phi1, ...: the loss at w + step * p for each step, from products with w (p0) and p (p1), in one pass."""
    y, wx, px = F.col("label"), F.col("p0"), F.col("p1")
    return products_.agg(*[_sum(V.row_loss(y, wx + V.coefficient(steps, i) * px)).alias(f"phi{i}") for i in range(len(steps))])


def collected(plan: DataFrame) -> tuple[float, np.ndarray]:
    """(loss, gradient) of a plan's one row."""
    row = plan.first()
    return float(row[0]), np.array(row[1:], float)
