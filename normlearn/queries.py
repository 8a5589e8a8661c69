"""Registry of the engine's own queries over the driver's tables, and their DuckDB SQL.

Most take S = lineitem (key l_partkey) and R = part, with the label 1 for returned
items and coefficients of 0.1.  Floating results are rounded to 6 decimals, since
sums depend on their order.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlearn import training_sql
from normlearn.functions import sql as sql_functions
from normlearn.functions import vectors as V
from normlearn.operators import train as T
from normlearn.operators.data import NormalizedData, normalized
from normlearn.operators.models import Catalog, random_vector
from normlearn.plans import gradient as G
from normlearn.sources import datagen, spec, tables, text, workspace
from normlearn.sources.spec import TrainSpec
from normlearn.streaming import incremental

W = [0.1] * 5
LAMBDA = 2.0
TOLERANCE = 0.02


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def main_data(spark: SparkSession, sf_dir: str) -> NormalizedData:
    """lineitem and part."""
    s = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sid"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_partkey").alias("forkey"),
        # + 0.0 turns a negative zero into zero
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10 + 0.0, F.col("l_tax") * 10 + 0.0).alias("xs"),
    )
    r = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rid"), F.array(F.col("p_size") / 50, F.col("p_retailprice") / 2000).alias("xr")
    )
    return normalized(s, r, d_s=3, d_r=2)


def orders_data(spark: SparkSession, sf_dir: str) -> NormalizedData:
    """orders and customer."""
    s = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sid"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_custkey").alias("forkey"),
        F.array(F.col("o_totalprice") / 5e5).alias("xs"),
    )
    r = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.array(F.col("c_acctbal") / 1e4).alias("xr"))
    return normalized(s, r, d_s=1, d_r=1)


def events_data(spark: SparkSession, sf_dir: str) -> NormalizedData:
    """events and customer."""
    s = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sid"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("user_id").alias("forkey"),
        F.array(F.col("value") / 500).alias("xs"),
    )
    r = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.array(F.col("c_acctbal") / 1e4).alias("xr"))
    return normalized(s, r, d_s=1, d_r=1)


def wide_data(spark: SparkSession, sf_dir: str) -> NormalizedData:
    """lineitem and embeddings: 64 attribute features.  Entity rows whose part has no vector have no match."""
    s = main_data(spark, sf_dir).s
    r = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("rid"), F.transform("embedding", lambda v: v.cast("double")).alias("xr")
    )
    return normalized(s, r, d_s=3, d_r=64)


def _rounded(rows: DataFrame) -> DataFrame:
    """Double columns with 6 decimals; a negative zero becomes zero."""
    return rows.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _spread(rows: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """An array column as n columns."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *[F.get(column, i).alias(f"{prefix}{i}") for i in range(n)])


# ---- sources -------------------------------------------------------------------


def _round_trip(write: Callable, read: Callable, rows: Callable, n: int, column: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace.fresh(spark, "text")
        write(rows(main_data(spark, sf_dir)), path)
        return _rounded(_spread(read(spark, path), column, n, "x"))

    return query


def _materialize_t(key: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace.fresh(spark, "joined")
        G.denormalized(main_data(spark, sf_dir), key).write.parquet(path)
        return _rounded(_spread(spark.read.parquet(path), "x", 5, "x"))

    return query


# ---- passes --------------------------------------------------------------------


def _pass(plan: Callable[[NormalizedData], DataFrame], data: Callable = main_data) -> Callable:
    return lambda spark, sf_dir: _rounded(plan(data(spark, sf_dir)))


def _materialized(data: NormalizedData) -> DataFrame:
    path = workspace.fresh(data.s.sparkSession, "joined")
    G.denormalized(data).write.parquet(path)
    return G.materialize(data.s.sparkSession.read.parquet(path), W)


def _array_form(data: NormalizedData) -> DataFrame:
    """The sums as one array, as an aggregate function over joined rows returns them."""
    packed = G.stream(data, W).select(F.array("loss", *G.names(5)).alias("lg"))
    return _spread(packed, "lg", 6, "lg")


def _auto(data: NormalizedData) -> DataFrame:
    counts = data.s.agg(F.count("*")).first()[0], data.r.agg(F.count("*")).first()[0]
    return G.build(data, W, G.choose(data, *counts))


def _cross_state(data: NormalizedData) -> DataFrame:
    """The two one-row states of the factorized pass, put side by side on a constant condition."""
    keys = G.per_key(data, W)
    return G.entity_sums(keys, data.d_s).join(F.broadcast(G.attribute_sums(keys, data)), F.lit(True))


def _with_regulariser(data: NormalizedData) -> DataFrame:
    half = LAMBDA * 0.5 * float(np.dot(W, W))
    rows = G.factorized(data, W)
    return rows.select((F.col("loss") + half).alias("loss"), *[(F.col(g) + LAMBDA * w).alias(g) for g, w in zip(G.names(5), W, strict=True)])


def _sql_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = main_data(spark, sf_dir)
    sql_functions.register(spark)
    data.s.createOrReplaceTempView("normlearn_s")
    data.r.createOrReplaceTempView("normlearn_r")
    w = "array(0.1D, 0.1D, 0.1D, 0.1D, 0.1D)"
    sums = ", ".join(f"coalesce(sum(row_gscale(label, wx) * get(x, {i})), 0D) AS g{i}" for i in range(5))
    return _rounded(
        spark.sql(
            f"SELECT coalesce(sum(row_loss(label, wx)), 0D) AS loss, {sums} FROM (SELECT label, x, vec_dot(x, {w}) AS wx "
            "FROM (SELECT label, vec_concat(xs, xr) AS x FROM normlearn_s JOIN normlearn_r ON rid = forkey))"
        )
    )


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factorized pass over lineitem read as a stream of files."""
    data = main_data(spark, sf_dir)
    path, out = workspace.fresh(spark, "arriving"), workspace.fresh(spark, "sums")
    data.s.repartition(4).write.parquet(path)
    arriving = spark.readStream.schema(data.s.schema).option("maxFilesPerTrigger", 2).parquet(path)
    incremental.start(arriving, data.r, W, data.d_s, out, workspace.fresh(spark, "progress")).awaitTermination()
    return _rounded(incremental.totals(spark, out, data.d))


# ---- rows ----------------------------------------------------------------------


def _row(column: Callable[[Column, Column, Column], Column], name: str) -> Callable:
    """A function of (label, x, wx) for each joined row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = G.denormalized(main_data(spark, sf_dir))
        rows = rows.select("sid", "label", "x", V.dot_literal(F.col("x"), W).alias("wx"))
        return _rounded(rows.select("sid", column(F.col("label"), F.col("x"), F.col("wx")).alias(name)))

    return query


def _kernel(column: Callable[[], Column], vector: bool = True) -> Callable:
    """A kernel of each entity vector xs, with sid."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = main_data(spark, sf_dir).s.select("sid", column().alias("v"))
        return _rounded(_spread(rows, "v", 3, "v") if vector else rows)

    return query


def _concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null on either side gives the other: every third row has a null on the left, every fifth on the right."""
    rows = main_data(spark, sf_dir).s
    left = F.when(F.col("sid") % 3 != 0, F.col("xs"))
    right = F.when(F.col("sid") % 5 != 0, F.col("xs"))
    rows = rows.select("sid", V.concat_array(left, right).alias("v"))
    return _rounded(_spread(rows.withColumn("n", F.size("v")).withColumn("n", F.when(F.col("v").isNotNull(), F.col("n"))), "v", 6, "v"))


def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), V.zeros(3).alias("v"))
    return _spread(rows, "v", 3, "v")


# ---- training ------------------------------------------------------------------


def _spec(algo: str, **more) -> TrainSpec:
    return TrainSpec(**({"approach": "f", "algo": algo, "iters": 5, "w_init": 0.0, "stepsize": 1e-3, "regularizer": LAMBDA} | more))


def _traced(found: T.FitResult, spark: SparkSession, iters: int) -> DataFrame:
    """A trace with 4 decimals (9 of the step), since later iterations carry on the rounding of earlier ones.

    Of ``iters`` iterations, those after one that found no step have nulls.
    """
    done = len(found.trace)
    rest = [(k + 1, None, None, None, None) for k in range(done, iters)] if found.status != "tolerance" else []
    rows = T.FitResult(found.w, found.trace + rest).trace_frame(spark)
    four = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return rows.select("iter", four("loss"), four("grad_norm"), "ls_count", (F.round("alpha", 9) + 0.0).alias("alpha"))


def _trace(algo: str, **more) -> Callable:
    run = _spec(algo, **more)
    return lambda spark, sf_dir: _traced(T.fit(main_data(spark, sf_dir), run), spark, run.iters)


def _flat_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained over one flat table, with parameters as command-line arguments."""
    rows = G.denormalized(main_data(spark, sf_dir))
    run = spec.from_arguments(["cgd", "5", "0.0", "1e-3", str(LAMBDA)])
    return _traced(T.fit_rows(rows, run, 5), spark, run.iters)


def _spec_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters from a file; what it does not name has its default."""
    with tempfile.NamedTemporaryFile("w", suffix=".json") as file:
        json.dump({"algo": "cgd", "approach": "s", "iters": 3, "stepsize": 0.002}, file)
        file.flush()
        run = spec.from_json(file.name)
    return _traced(T.fit(main_data(spark, sf_dir), run), spark, run.iters)


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark, "model")
    T.fit(main_data(spark, sf_dir), _spec("bgd")).save(spark, path)
    return _rounded(spark.read.parquet(path))


def _step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients after one step of gradient descent."""
    return _rounded(T.fit(main_data(spark, sf_dir), _spec("bgd", iters=1, w_init=0.1)).model_frame(spark))


def _model_state(d_r: int) -> Callable:
    """The life of a model: its coefficients and gradient after it is made, set, used in two passes, set again and dropped.

    ``d_r`` is 0 for a model over flat rows.  The catalog is written and read again before its use.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, path, seen = main_data(spark, sf_dir), workspace.fresh(spark, "catalog"), []
        rows = data if d_r else G.denormalized(data)
        catalog = Catalog()
        note = lambda step: seen.extend((step, i, float(v)) for i, v in enumerate(catalog.get(3)))
        catalog.push(3, 5 - d_r, d_r)
        note("made")
        catalog.put(3, W)
        catalog.save(spark, path)
        catalog = Catalog.load(spark, path)
        note("set")
        catalog.gradient(3, rows)
        note("one pass")
        catalog.gradient(3, rows)
        note("two passes")
        catalog.put(3, [2 * v for v in W])
        note("set again")
        catalog.pop(3)
        seen.extend(("dropped", m, 1.0) for m in catalog.models)
        return _rounded(spark.createDataFrame(seen, "step string, i int, v double"))

    return query


def _model_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog model's loss and probability as SQL functions, by its number."""
    catalog = Catalog()
    catalog.push(4, 3, 2)
    catalog.put(4, W)
    catalog.register(spark, 4)
    tables.register(normlearn_t=G.denormalized(main_data(spark, sf_dir)))
    return _rounded(spark.sql("SELECT sid, model_4_loss(x, label) AS l, model_4_probability(x) AS p FROM normlearn_t"))


STEPS = [0.01 * 0.5**k for k in range(8)]


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss along a direction for eight steps, in one pass."""
    data = main_data(spark, sf_dir)
    return _rounded(G.ladder(G.products(data, [W, [-1.0, 0.5, 0.25, 1.0, -2.0]], "f"), STEPS))


def _generated(kind: str, **more) -> Callable:
    """A generated table, row by row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, x, n = {
            "s": lambda: (datagen.entity_rows(spark, 10, 50, 4, 7, **more), "xs", 3),
            "r": lambda: (datagen.attribute_rows(spark, 50, 4, 7, **more), "xr", 7),
            "t": lambda: (datagen.flat_rows(spark, 10, 50, 4, 7, **more), "x", 10),
        }[kind]()
        return _rounded(_spread(rows, x, n, "x"))

    return query


def _generated_sink(format_: int, kind: str) -> Callable:
    """A table that the generator wrote (over another one), read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, r = workspace.fresh(spark, "generated-s"), workspace.fresh(spark, "generated-r")
        datagen.write_tables(spark, s, r, 1 - format_, 2, 3, 4, 7)
        datagen.write_tables(spark, s, r, format_, 10, 50, 4, 7, 0.5)
        rows, x, n = (
            (tables.source(spark, s, format_, tables.ENTITY), "xs", 3)
            if kind == "s"
            else (tables.source(spark, r, format_, tables.ATTRIBUTE), "xr", 7)
        )
        return _rounded(_spread(rows, x, n, "x"))

    return query


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether random vectors lie where they should, their mean is near a half and no two numbers are equal."""
    rows = _table(spark, sf_dir, "lineitem").select(random_vector(3, 5).alias("v"))
    each = rows.select(F.explode("v").alias("v"))
    return each.agg(
        F.count("*").alias("n"), ((F.min("v") >= 0) & (F.max("v") < 1)).alias("within"),
        (F.abs(F.avg("v") - 0.5) < 0.02).alias("centred"), (F.abs(F.variance("v") - 1 / 12) < 0.005).alias("spread"),
        (F.countDistinct("v") > 0.999 * F.count("*")).alias("differ"),
    )


# ---- tables --------------------------------------------------------------------


def _copied(kind: str) -> Callable:
    """Lines copied into a table, read through SQL by its name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, lines, path = main_data(spark, sf_dir), workspace.fresh(spark, "lines"), workspace.fresh(spark, "table")
        if kind == "s":
            text.write_plain_s(data.s, lines)
            tables.load(spark, lines, path, tables.ENTITY, "normlearn_copied_s")
            rows = spark.sql("SELECT forkey, count(*) AS n, sum(label) AS y, sum(get(xs, 0)) AS x0 FROM normlearn_copied_s GROUP BY forkey")
        else:
            text.write_plain_r(data.r, lines)
            tables.load(spark, lines, path, tables.ATTRIBUTE, "normlearn_copied_r")
            rows = spark.sql("SELECT rid, get(xr, 0) AS x0, get(xr, 1) AS x1, size(xr) AS n FROM normlearn_copied_r")
        return _rounded(rows)

    return query


def _sunk(format_: int, kind: str) -> Callable:
    """A table through the sink of a format, over one of another content."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, path = main_data(spark, sf_dir), workspace.fresh(spark, "sink")
        rows, schema, x, n = (data.s, tables.ENTITY, "xs", 3) if kind == "s" else (data.r, tables.ATTRIBUTE, "xr", 2)
        tables.sink(rows.limit(1), path, format_)
        tables.sink(rows, path, format_)
        return _rounded(_spread(tables.source(spark, path, format_, schema), x, n, "x"))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    y_wx = lambda f: lambda y, x, wx: f(y, wx)
    # columns exist only with a session, so they are made when a query runs
    index = lambda: F.array(F.lit(0), F.lit(2), F.lit(2))
    values = lambda: V.vector([0.5, 2.0, -1.0])
    xs = lambda: F.col("xs")
    return {
        # sources and sinks
        "etl_s": _round_trip(text.write_plain_s, text.read_plain_s, lambda d: d.s, 3, "xs"),
        "etl_r": _round_trip(text.write_plain_r, text.read_plain_r, lambda d: d.r, 2, "xr"),
        "hive_text_s": _round_trip(text.write_hive_s, text.read_hive_s, lambda d: d.s, 3, "xs"),
        "hive_text_r": _round_trip(text.write_hive_r, text.read_hive_r, lambda d: d.r, 2, "xr"),
        "flat_t": _round_trip(text.write_flat, text.read_flat, G.denormalized, 5, "x"),
        "copied_s": _copied("s"),
        "copied_r": _copied("r"),
        "sink_binary_s": _sunk(tables.BINARY, "s"),
        "sink_binary_r": _sunk(tables.BINARY, "r"),
        "sink_text_s": _sunk(tables.TEXT, "s"),
        "sink_text_r": _sunk(tables.TEXT, "r"),
        "materialize_t": _materialize_t("sid"),
        "materialize_t_rid": _materialize_t("rid"),
        # passes
        "stream_lossgrad": _pass(lambda d: G.stream(d, W)),
        "materialize_lossgrad": _pass(_materialized),
        "stream_reuse_lossgrad": _pass(lambda d: G.stream_reuse(d, W, 4)),
        "fact_lossgrad": _pass(lambda d: G.factorized(d, W)),
        "fsql_lossgrad": _pass(lambda d: G.fsql(d, W)),
        "auto_lossgrad": _pass(_auto),
        "sql_lossgrad": _sql_pass,
        "incremental_lossgrad": _streamed,
        "lossgrad_array": _pass(_array_form),
        "loss_sum": _pass(lambda d: G.scored(d, W).agg(F.sum("l").alias("loss"))),
        "l2_lossgrad": _pass(_with_regulariser),
        "orders_lossgrad": _pass(lambda d: G.factorized(d, W[:2]), orders_data),
        "events_lossgrad": _pass(lambda d: G.factorized(d, W[:2]), events_data),
        "wide_stream_lossgrad": _pass(lambda d: G.stream(d, [0.1] * 67), wide_data),
        "wide_fact_lossgrad": _pass(lambda d: G.factorized(d, [0.1] * 67), wide_data),
        # the factorized pass piece by piece
        "fsql_hr": _pass(lambda d: G.partial_products(d, W[3:])),
        "fact_sum_g": _pass(lambda d: G.per_key(d, W).select("rid", "sg")),
        "fact_s_pass": _pass(lambda d: G.entity_sums(G.per_key(d, W), 3)),
        "fact_r_pass": _pass(lambda d: G.attribute_sums(G.per_key(d, W), d)),
        "fact_cross_state": _pass(_cross_state),
        "fsql_hsplus": _pass(lambda d: _spread(G.hs_plus(d, W), "lg", 5, "lg")),
        # rows
        "dot": _row(lambda y, x, wx: V.dot(x, V.vector(W)), "wx"),
        "sigmoid": _row(lambda y, x, wx: V.sigmoid(wx), "p"),
        "row_loss": _row(y_wx(V.row_loss), "l"),
        "row_gscale": _row(y_wx(V.gradient_scale), "c"),
        "predict": lambda s, d: _rounded(T.predict(main_data(s, d), np.array(W), factorized=False)),
        "predict_fact": lambda s, d: _rounded(T.predict(main_data(s, d), np.array(W))),
        "concat_array": _concat,
        "zeros": _zeros,
        # kernels
        "k_ball_project": _kernel(lambda: V.ball_project(xs(), 0.5)),
        "k_sparse_dot": _kernel(lambda: V.sparse_dot(xs(), index(), values()), vector=False),
        "k_axpy": _kernel(lambda: V.axpy(xs(), V.vector([1.0, 2.0, 3.0]), 0.5)),
        "k_sparse_add": _kernel(lambda: V.sparse_add(xs(), index(), 0.25)),
        "k_sparse_axpy": _kernel(lambda: V.sparse_axpy(xs(), index(), values(), 0.25)),
        "k_scale": _kernel(lambda: V.scale(xs(), 3.0)),
        "k_sqnorm": _kernel(lambda: V.squared_norm(xs()), vector=False),
        "k_l1_mask": _kernel(lambda: V.l1_shrink_at(xs(), 0.3, index())),
        "k_l2": _kernel(lambda: V.l2_shrink(xs(), 0.3)),
        "k_l1": _kernel(lambda: V.l1_shrink(xs(), 0.3)),
        "k_logsum": _kernel(lambda: V.log_sum(F.get(xs(), 0), F.get(xs(), 1)), vector=False),
        # training
        "bgd_trace": _trace("bgd"),
        "cgd_trace": _trace("cgd"),
        "lbfgs_trace": _trace("lbfgs"),
        "lbfgs_compat_trace": _trace("lbfgs_compat"),
        "single_trace": _flat_trace,
        "sr_trace": _trace("bgd", approach="sr", srsplits=4, iters=3),
        "tolerance_trace": _trace("bgd", tolerance=TOLERANCE),
        "spec_trace": _spec_trace,
        "bgd_model": _model,
        "bgd_step1": _step,
        "line_search_phi": _ladder,
        # generators
        "generated_s": _generated("s"),
        "generated_r": _generated("r"),
        "generated_t": _generated("t", deviation=2.0, seed=3),
        "generated_binary_s": _generated_sink(tables.BINARY, "s"),
        "generated_binary_r": _generated_sink(tables.BINARY, "r"),
        "generated_text_s": _generated_sink(tables.TEXT, "s"),
        "generated_text_r": _generated_sink(tables.TEXT, "r"),
        "random_vectors": _random,
        # models by number
        "model_state": _model_state(0),
        "fact_model_state": _model_state(2),
        "model_functions": _model_functions,
    }


# ---- SQL -----------------------------------------------------------------------

_BASE = """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS sid, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label,
  l_partkey AS forkey, l_quantity / 50 AS x0, l_discount * 10 + 0.0 AS x1, l_tax * 10 + 0.0 AS x2 FROM lineitem),
r AS (SELECT p_partkey AS rid, p_size / 50 AS x3, p_retailprice / 2000 AS x4 FROM part),
t AS (SELECT *, (x0 + x1 + x2 + x3 + x4) * 0.1::DOUBLE AS wx FROM s JOIN r ON rid = forkey),
z AS (SELECT *, greatest(-label * wx, 0) + ln(1 + exp(-abs(wx))) AS l, -label / (1 + exp(label * wx)) AS c FROM t)
"""


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


_G = [f"coalesce(sum(c * x{i}), 0)" for i in range(5)]
_GS = ", ".join(_r(g, f"g{i}") for i, g in enumerate(_G))
_LOSSGRAD = f"{_BASE} SELECT {_r('coalesce(sum(l), 0)', 'loss')}, {_GS} FROM z"
_XS = ", ".join(_r(f"x{i}", f"x{i}") for i in range(3))
_XR = f"{_r('x3', 'x0')}, {_r('x4', 'x1')}"


def _vector_sql(expression: str) -> str:
    """A list expression over xs as three columns."""
    picked = ", ".join(_r(f"v[{i + 1}]", f"v{i}") for i in range(3))
    return f"{_BASE} SELECT sid, {picked} FROM (SELECT sid, {expression} AS v FROM (SELECT sid, [x0, x1, x2] AS xs FROM s))"


def _two_table(entity: str, key: str, label: str, x0: str) -> str:
    return f"""WITH t AS (SELECT CASE WHEN {label} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label, {x0} AS x0, c_acctbal / 10000 AS x1
  FROM {entity} JOIN customer ON {key} = c_custkey),
z AS (SELECT *, label * (x0 + x1) * 0.1::DOUBLE AS m FROM t)
SELECT {_r('sum(greatest(-m, 0) + ln(1 + exp(-abs(m))))', 'loss')}, {_r('sum(-label / (1 + exp(m)) * x0)', 'g0')},
  {_r('sum(-label / (1 + exp(m)) * x1)', 'g1')} FROM z"""


def _wide_sql() -> str:
    sums = ", ".join(_r(f"sum(c * x{i})", f"g{i}") for i in range(3))
    rest = ", ".join(_r(f"sum(c * e[{j + 1}]::DOUBLE)", f"g{3 + j}") for j in range(64))
    head = _BASE.split(",\nr AS")[0]
    return f"""{head}, t AS (SELECT *, embedding::DOUBLE[] AS e FROM s JOIN embeddings ON vec_id = forkey),
u AS (SELECT *, (x0 + x1 + x2 + list_sum(e)) * 0.1::DOUBLE AS wx FROM t),
z AS (SELECT *, greatest(-label * wx, 0) + ln(1 + exp(-abs(wx))) AS l, -label / (1 + exp(label * wx)) AS c FROM u)
SELECT {_r('sum(l)', 'loss')}, {sums}, {rest} FROM z"""


def _step_sql() -> str:
    half = LAMBDA * 0.5 * float(np.dot(W, W))
    sums = ", ".join(f"{g} + {LAMBDA} * 0.1::DOUBLE AS g{i}" for i, g in enumerate(_G))
    norm = " + ".join(f"g{i} * g{i}" for i in range(5))
    moved = " + ".join(f"(0.1::DOUBLE - a * g{i}) * x{i}" for i in range(5))
    length = " + ".join(f"(0.1::DOUBLE - a * g{i}) * (0.1::DOUBLE - a * g{i})" for i in range(5))
    rows = " UNION ALL ".join(f"SELECT {i} AS i, round(0.1::DOUBLE - 1.2 * a * g{i}, 6) + 0.0 AS w FROM best" for i in range(5))
    return f"""{_BASE}, o AS (SELECT sum(l) + {half} AS loss, {sums} FROM z),
n AS (SELECT *, {norm} AS nn FROM o),
a AS (SELECT 0.001::DOUBLE * pow(0.5::DOUBLE, k) AS a FROM range(24) q(k)),
m AS (SELECT a, any_value(loss) AS loss, any_value(nn) AS nn, any_value({length}) AS len,
  sum(greatest(-label * ({moved}), 0) + ln(1 + exp(-abs({moved})))) AS phi FROM t, n, a GROUP BY a),
best AS (SELECT b.a, n.* FROM n, (SELECT max(a) AS a FROM m WHERE phi + {LAMBDA} * 0.5 * len <= loss - 0.0001::DOUBLE * a * nn) b)
{rows}"""


def _ladder_sql() -> str:
    px = "-x0 + 0.5::DOUBLE * x1 + 0.25::DOUBLE * x2 + x3 - 2 * x4"
    sums = ", ".join(
        _r(f"sum(greatest(-label * (wx + {a!r}::DOUBLE * px), 0) + ln(1 + exp(-abs(wx + {a!r}::DOUBLE * px))))", f"phi{i}")
        for i, a in enumerate(STEPS)
    )
    return f"{_BASE} SELECT {sums} FROM (SELECT *, {px} AS px FROM t)"


def _model_state_sql() -> str:
    steps = ["made", "set", "one pass", "two passes", "set again"]
    rows = [f"SELECT '{step}' AS step, {i}::INT AS i, {w!r}::DOUBLE AS v" for step, w in zip(steps, (0.0, 0.1, 0.1, 0.1, 0.2), strict=True) for i in range(5)]
    rows += [
        f"SELECT '{step}' AS step, {5 + i}::INT AS i, {_r(f'{n} * {_G[i]}', 'v')} FROM z"
        for step, n in zip(steps, (0, 0, 1, 2, 0), strict=True)
        for i in range(5)
    ]
    return f"{_BASE} {' UNION ALL '.join(rows)}"


def _generated_sql(kind: str, deviation: float = 1.0, shift: bool = True, seed: int = 1) -> str:
    """The generator's rule: two uniform numbers from a digest give a normal one."""

    def uniform(text: str, at: int = 1) -> str:
        return f"(('0x' || substr(md5({text}), {at}, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE"

    def normal(table: str, key: str, i: int) -> str:
        text = f"'{table}:{seed}:{i}:' || {key}"
        return f"sqrt(-2 * ln({uniform(text)})) * cos(2 * pi() * {uniform(text, 13)}) * {deviation!r}::DOUBLE"

    raw = ", ".join(uniform(f"'w:{seed}:{i}'") + f" - 0.5::DOUBLE AS u{i}" for i in range(10))
    length = "sqrt(" + " + ".join(f"u{i} * u{i}" for i in range(10)) + ")"
    w = ", ".join(f"u{i} / {length} AS w{i}" for i in range(10))
    around = "label" if shift else "0"
    xs = ", ".join(f"({normal('s', 'sid', i)} + {around}) * w{i} AS x{i}" for i in range(3))
    xr = ", ".join(f"{normal('r', 'rid', i)} * w{3 + i} AS x{3 + i}" for i in range(7))
    y = f"CASE WHEN {uniform(f"'y:{seed}:0:' || sid")} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    base = f"""WITH raw AS (SELECT {raw}), w AS (SELECT {w} FROM raw),
y AS (SELECT range AS sid, (range - 1) // 10 + 1 AS forkey, {y} AS label FROM (SELECT range, range AS sid FROM range(1, 501))),
s AS (SELECT sid, label, forkey, {xs} FROM y, w), r AS (SELECT rid, {xr} FROM range(1, 51) q(rid), w)"""
    if kind == "s":
        return f"{base} SELECT sid, label, forkey, {', '.join(_r(f'x{i}', f'x{i}') for i in range(3))} FROM s"
    if kind == "r":
        return f"{base} SELECT rid, {', '.join(_r(f'x{3 + i}', f'x{i}') for i in range(7))} FROM r"
    return f"{base} SELECT sid, label, {', '.join(_r(f'x{i}', f'x{i}') for i in range(10))} FROM s JOIN r ON rid = forkey"


def oracle_sql() -> dict[str, str]:
    lg = ["sum(l)", "sum(c)", *[f"sum(c * x{i})" for i in range(3)]]
    concat = ", ".join(_r(f"v[{i + 1}]", f"v{i}") for i in range(6))
    t_columns = ", ".join(_r(f"x{i}", f"x{i}") for i in range(5))
    norm = "list_sum(list_transform(xs, lambda v: v * v))"
    soft = "CASE WHEN v > 0.3 THEN v - 0.3::DOUBLE WHEN v < -0.3 THEN v + 0.3::DOUBLE ELSE 0.0::DOUBLE END"
    plain_s = f"{_BASE} SELECT sid, label, forkey, {_XS} FROM s"
    plain_r = f"{_BASE} SELECT rid, {_XR} FROM r"
    pdp = f"{_BASE} SELECT rid, {_r('(x3 + x4) * 0.1::DOUBLE', 'pdp')} FROM r"
    return {
        "etl_s": plain_s,
        "etl_r": plain_r,
        "hive_text_s": plain_s,
        "hive_text_r": plain_r,
        "copied_s": f"{_BASE} SELECT forkey, count(*) AS n, {_r('sum(label)', 'y')}, {_r('sum(x0)', 'x0')} FROM s GROUP BY forkey",
        "copied_r": f"{_BASE} SELECT rid, {_XR}, 2::INT AS n FROM r",
        "sink_binary_s": plain_s,
        "sink_binary_r": plain_r,
        "sink_text_s": plain_s,
        "sink_text_r": plain_r,
        "flat_t": f"{_BASE} SELECT sid, label, {t_columns} FROM t",
        "materialize_t": f"{_BASE} SELECT sid, label, {t_columns} FROM t",
        "materialize_t_rid": f"{_BASE} SELECT rid, label, {t_columns} FROM t",
        **dict.fromkeys(
            (
                "stream_lossgrad", "materialize_lossgrad", "stream_reuse_lossgrad", "fact_lossgrad", "fsql_lossgrad",
                "auto_lossgrad", "sql_lossgrad", "incremental_lossgrad", "fact_cross_state",
            ),
            _LOSSGRAD,
        ),
        "lossgrad_array": f"{_BASE} SELECT {_r('sum(l)', 'lg0')}, {', '.join(_r(g, f'lg{i + 1}') for i, g in enumerate(_G))} FROM z",
        "loss_sum": f"{_BASE} SELECT {_r('sum(l)', 'loss')} FROM z",
        "l2_lossgrad": f"{_BASE} SELECT {_r(f'sum(l) + {LAMBDA * 0.5 * float(np.dot(W, W))!r}::DOUBLE', 'loss')}, "
        + ", ".join(_r(f"{g} + {LAMBDA} * 0.1::DOUBLE", f"g{i}") for i, g in enumerate(_G)) + " FROM z",
        "orders_lossgrad": _two_table("orders", "o_custkey", "o_orderstatus = 'F'", "o_totalprice / 500000"),
        "events_lossgrad": _two_table("events", "user_id", "event_type = 'purchase'", "value / 500"),
        "wide_stream_lossgrad": _wide_sql(),
        "wide_fact_lossgrad": _wide_sql(),
        "fsql_hr": pdp,
        "fact_sum_g": f"{_BASE} SELECT rid, {_r('sum(c)', 'sg')} FROM z GROUP BY rid",
        "fact_s_pass": f"{_BASE} SELECT {_r('sum(l)', 'loss')}, {', '.join(_r(g, f'g{i}') for i, g in enumerate(_G[:3]))} FROM z",
        "fact_r_pass": f"{_BASE} SELECT {', '.join(_r(g, f'g{i + 3}') for i, g in enumerate(_G[3:]))} FROM z",
        "fsql_hsplus": f"{_BASE} SELECT rid, {', '.join(_r(e, f'lg{i}') for i, e in enumerate(lg))} FROM z GROUP BY rid",
        "dot": f"{_BASE} SELECT sid, {_r('wx', 'wx')} FROM t",
        "sigmoid": f"{_BASE} SELECT sid, {_r('1 / (1 + exp(-wx))', 'p')} FROM t",
        "row_loss": f"{_BASE} SELECT sid, {_r('l', 'l')} FROM z",
        "row_gscale": f"{_BASE} SELECT sid, {_r('c', 'c')} FROM z",
        "predict": f"{_BASE} SELECT sid, {_r('1 / (1 + exp(-wx))', 'p')} FROM t",
        "predict_fact": f"{_BASE} SELECT sid, {_r('1 / (1 + exp(-wx))', 'p')} FROM t",
        "concat_array": f"{_BASE} SELECT sid, {concat}, len(v)::INT AS n FROM (SELECT sid, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a "
        "ELSE list_concat(a, b) END AS v FROM (SELECT sid, CASE WHEN sid % 3 <> 0 THEN [x0, x1, x2] END AS a, "
        "CASE WHEN sid % 5 <> 0 THEN [x0, x1, x2] END AS b FROM s))",
        "zeros": "SELECT n_nationkey::BIGINT AS k, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2 FROM nation",
        "k_ball_project": _vector_sql(f"CASE WHEN {norm} > 0.25 THEN list_transform(xs, lambda v: v * (0.5::DOUBLE / sqrt({norm}))) ELSE xs END"),
        "k_sparse_dot": f"{_BASE} SELECT sid, {_r('x0 * 0.5::DOUBLE + x2 * 2 - x2', 'v')} FROM s",
        "k_axpy": _vector_sql("[xs[1] + 0.5::DOUBLE, xs[2] + 1, xs[3] + 1.5::DOUBLE]"),
        "k_sparse_add": _vector_sql("[xs[1] + 0.25::DOUBLE, xs[2], xs[3] + 0.5::DOUBLE]"),
        "k_sparse_axpy": _vector_sql("[xs[1] + 0.125::DOUBLE, xs[2], xs[3] + 0.25::DOUBLE]"),
        "k_scale": _vector_sql("list_transform(xs, lambda v: v * 3)"),
        "k_sqnorm": f"{_BASE} SELECT sid, {_r('x0 * x0 + x1 * x1 + x2 * x2', 'v')} FROM s",
        # element 2 is listed twice and shrinks twice, one after the other
        "k_l1_mask": _vector_sql(f"[list_transform([xs[1]], lambda v: {soft})[1], xs[2], "
        f"list_transform(list_transform([xs[3]], lambda v: {soft}), lambda v: {soft})[1]]"),
        "k_l2": _vector_sql("list_transform(xs, lambda v: v / 1.3::DOUBLE)"),
        "k_l1": _vector_sql(f"list_transform(xs, lambda v: {soft})"),
        "k_logsum": f"{_BASE} SELECT sid, {_r('greatest(x0, x1) + ln(1 + exp(-abs(x0 - x1)))', 'v')} FROM s",
        "bgd_step1": _step_sql(),
        "line_search_phi": _ladder_sql(),
        "bgd_trace": training_sql.trace(_BASE, "bgd", 5, 1e-3, 0.0, LAMBDA),
        "cgd_trace": training_sql.trace(_BASE, "cgd", 5, 1e-3, 0.0, LAMBDA),
        "lbfgs_trace": training_sql.trace(_BASE, "lbfgs", 5, 1e-3, 0.0, LAMBDA),
        "lbfgs_compat_trace": training_sql.trace(_BASE, "lbfgs_compat", 5, 1e-3, 0.0, LAMBDA),
        "single_trace": training_sql.trace(_BASE, "cgd", 5, 1e-3, 0.0, LAMBDA),
        "sr_trace": training_sql.trace(_BASE, "bgd", 3, 1e-3, 0.0, LAMBDA),
        "tolerance_trace": training_sql.trace(_BASE, "bgd", 5, 1e-3, 0.0, LAMBDA, tolerance=TOLERANCE),
        "spec_trace": training_sql.trace(_BASE, "cgd", 3, 0.002, 0.01, 0.1),
        "bgd_model": training_sql.model(_BASE, "bgd", 5, 1e-3, 0.0, LAMBDA),
        "generated_s": _generated_sql("s"),
        "generated_r": _generated_sql("r"),
        "generated_t": _generated_sql("t", deviation=2.0, seed=3),
        **dict.fromkeys(("generated_binary_s", "generated_text_s"), _generated_sql("s", deviation=0.5, shift=False)),
        **dict.fromkeys(("generated_binary_r", "generated_text_r"), _generated_sql("r", deviation=0.5)),
        "random_vectors": "SELECT 3 * count(*) AS n, true AS within, true AS centred, true AS spread, true AS differ FROM lineitem",
        "model_state": _model_state_sql(),
        "fact_model_state": _model_state_sql(),
        "model_functions": f"{_BASE} SELECT sid, {_r('l', 'l')}, {_r('1 / (1 + exp(-wx))', 'p')} FROM z",
    }
