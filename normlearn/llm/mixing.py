"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree domain - language - source hold documents.  Each node hands
its budget of tokens down to its children by their weights.  What a child cannot
take (its leaves times the allowed epochs hold fewer tokens) goes to its siblings
by their weights, and only what no child can take is missing at the parent, where
it went to the parent's siblings in the same way.  Done from the root down over
the capacities of subtrees, that is a water filling per node, here in closed form
with exact integers over window functions.

A leaf with N tokens and a budget of A takes floor(A / N) whole epochs and then
the first A mod N tokens of one more epoch, whose order is a seeded hash.  The
last document of that prefix is taken in part.  The prefix is found with sums
over hash buckets, refined twice, so only the documents of one small bucket are
ever sorted, and a leaf with a third of all rows costs no task more than others.

Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

TOKEN = r"[^\x20\x09-\x0D]+"
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class MixSpec:
    """Targets of a mix.  Weights are positive integers; what is not listed has ``default_weight``.

    ``budget`` is a share of all tokens as (numerator, denominator); ``max_epochs``
    how often a document may be taken at most.
    """

    domains: int = 4
    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget: tuple[int, int] = (9, 10)
    max_epochs: int = 2
    seed: int = 17


def _weight(col: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for key in sorted(weights):
        out = F.when(col == F.lit(key), F.lit(weights[key])).otherwise(out)
    return out.cast("long")


def _domain(source: Column, spec: MixSpec) -> Column:
    """The domain of a source: its trailing number modulo the count of domains, d0 where it has none."""
    number = F.coalesce(F.expr("try_cast(right(regexp_extract(source, '([0-9]+)$', 1), 9) as long)"), F.lit(0))
    return F.concat(F.lit("d"), (number % spec.domains).cast("string"))


def _fill(nodes: DataFrame, parent: list[str], node: str, budget: Column) -> DataFrame:
    """Water filling: each row of ``nodes`` (cap, weight) gets alloc, out of its parent's ``budget``.

    In the order of cap / weight the first k children get all they can hold; the
    others share the rest by weight, with cumulative rounding, so allocations sum
    to min(budget, all capacities) exactly.
    """
    family = Window.partitionBy(*parent)
    # exact comparison of cap / weight: both are integers and the ratio is kept to 18 decimals
    ratio = F.col("cap").cast("decimal(20,0)") / F.col("weight").cast("decimal(10,0)")
    order = family.orderBy(ratio.asc(), F.col(node).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: c.cast(WIDE)
    rows = (
        nodes.withColumn("wanted", budget)
        .withColumn("given", F.least("wanted", F.sum("cap").over(family)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", wide(F.col("cap")) * F.col("weight_from").cast("decimal(12,0)") <= wide(F.col("given") - F.col("cap_before")) * F.col("weight").cast("decimal(12,0)"))
        # once one child is not full, none after it is
        .withColumn("full", F.min(F.col("full").cast("int")).over(upto) == 1)
        .withColumn("rest", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(family))
    )
    open_weight = F.when(F.col("full"), F.lit(0).cast("long")).otherwise(F.col("weight"))
    rows = (
        rows.withColumn("open", F.sum(open_weight).over(family))
        .withColumn("open_upto", F.sum(open_weight).over(upto))
    )
    share = lambda c: F.expr(f"cast(cast(rest as {WIDE}) * cast({c} as decimal(12,0)) div greatest(open, 1) as long)")
    return rows.withColumn(
        "alloc", F.when(F.col("full"), F.col("cap")).otherwise(share("open_upto") - share("(open_upto - weight)"))
    )


def leaf_budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """Budgets of the leaves.  ``leaves``: leaf, domain, lang, source, tokens; returned with ``alloc``.

    One row per leaf goes in and out; the number of leaves is that of the sources,
    not of the documents.
    """
    weigh = lambda c, weights: _weight(F.col(c), weights, spec.default_weight)
    leaves = leaves.withColumn("cap", F.col("tokens") * spec.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumns({"root": F.lit(1), "weight": weigh("domain", spec.domain_weights)})
    domains = domains.withColumn("total", F.sum("tokens").over(Window.partitionBy("root")))
    wanted = F.expr(f"cast(cast(total as {WIDE}) * {spec.budget[0]} div {spec.budget[1]} as long)")
    top = _fill(domains, ["root"], "domain", wanted).select("domain", F.col("alloc").alias("from_domain"))
    langs = langs.join(top, "domain").withColumn("weight", weigh("lang", spec.lang_weights))
    middle = _fill(langs, ["domain"], "lang", F.col("from_domain")).select(
        F.col("domain").alias("in_domain"), F.col("lang").alias("in_lang"), F.col("alloc").alias("from_lang")
    )
    same = (F.col("domain") == F.col("in_domain")) & F.col("lang").eqNullSafe(F.col("in_lang"))
    low = leaves.join(middle, same).withColumn("weight", weigh("source", spec.source_weights))
    return _fill(low, ["domain", "lang"], "source", F.col("from_lang")).select(
        "leaf", "domain", "lang", "source", "tokens", "alloc"
    )


def _leaf(spec: MixSpec) -> dict[str, Column]:
    """The columns that place a row in the tree; the leaf's name tells null from any text."""
    domain = _domain(F.col("source"), spec)
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return {"__domain": domain, "__leaf": F.concat_ws("\x1f", domain, part("lang"), part("source"))}


def _count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def _own(doc_id: Column, text: Column) -> Column:
    """What tells rows without an id apart: many of them must not share one place in the order."""
    return F.when(doc_id.isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _bucket(k: int) -> Column:
    """The k-th byte of the key that orders the last epoch."""
    return F.conv(F.substring("__key", 1 + 2 * k, 2), 16, 10).cast("int")


def _ordered(rows: DataFrame, leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """``rows`` (__leaf, __id, __own) with the plan of their leaf and their place in its last epoch."""
    name = F.coalesce(F.col("__id").cast("string"), F.concat(F.lit("null:"), F.col("__own")))
    text = F.concat_ws(":", F.lit(str(spec.seed)), F.col("__epochs"), name)
    rows = rows.join(leaves, "__leaf").withColumn("__key", F.md5(text))
    return rows.withColumns({"__d0": _bucket(0), "__d1": _bucket(1)})


def _plan(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per leaf: __epochs, __need (tokens of the last epoch), and the buckets where its prefix ends.

    ``rows``: __leaf, __domain, lang, source, __id, __n; read three times.
    """
    leaves = rows.groupBy(F.col("__leaf").alias("leaf"), F.col("__domain").alias("domain"), "lang", "source").agg(
        F.sum("__n").alias("tokens")
    )
    leaves = leaf_budgets(scratch.written(leaves, "leaves"), spec).select(
        F.col("leaf").alias("__leaf"),
        F.expr("case when tokens > 0 then alloc div tokens else 0 end").alias("__epochs"),
        F.expr("case when tokens > 0 then alloc % tokens else 0 end").alias("__need"),
    )
    leaves = scratch.written(leaves, "budgets")
    edge = leaves.withColumns({"__sofar": F.lit(0).cast("long")})
    for k in range(2):
        inside = _ordered(rows, edge.select("__leaf", "__epochs", "__need", "__sofar", *[f"__e{i}" for i in range(k)]), spec)
        inside = inside.filter("__need > 0")
        for i in range(k):
            inside = inside.filter(F.col(f"__d{i}") == F.col(f"__e{i}"))
        state = ["__leaf", "__epochs", "__need", "__sofar", *[f"__e{i}" for i in range(k)]]
        sums = inside.groupBy(*state, F.col(f"__d{k}").alias(f"__e{k}")).agg(F.sum("__n").alias("t"))
        upto = F.col("__sofar") + F.sum("t").over(Window.partitionBy("__leaf").orderBy(f"__e{k}"))
        sums = sums.withColumn("upto", upto)
        # the one bucket in which the sum reaches the need
        found = sums.filter((F.col("upto") >= F.col("__need")) & (F.col("upto") - F.col("t") < F.col("__need")))
        found = found.withColumn("__sofar", F.col("upto") - F.col("t")).drop("t", "upto")
        edge = scratch.written(found, f"edge-{k}")
    return scratch.written(leaves.join(edge.select("__leaf", "__e0", "__e1", "__sofar"), "__leaf", "left"), "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame, spec: MixSpec, tie: list[Column]) -> DataFrame:
    """``rows`` with __copies (whole) and __part (tokens of a further copy that the prefix ends in)."""
    placed = _ordered(rows, plan, spec)
    here, below = F.struct("__d0", "__d1"), F.struct("__e0", "__e1")
    side = F.when(F.coalesce(F.col("__e0"), F.lit(-1)) < 0, F.lit(1)).when(here < below, F.lit(-1)).when(here == below, F.lit(0))
    placed = placed.withColumn("__side", side.otherwise(F.lit(1)))
    line = Window.partitionBy("__leaf").orderBy("__key", *tie).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__need") - F.col("__sofar") - F.coalesce(F.sum("__n").over(line), F.lit(0))
    # rows without tokens take no part in the sums, so any number of them is never sorted
    inner = placed.filter("__side = 0 and __n > 0").withColumn("__got", F.greatest(F.least(F.col("__n"), left), F.lit(0)))
    outer = placed.filter("__side <> 0 or __n = 0").withColumn(
        "__got", F.when(F.col("__side") < 0, F.col("__n")).otherwise(F.lit(0)).cast("long")
    )
    both = outer.unionByName(inner)
    whole = (F.col("__n") > 0) & (F.col("__got") == F.col("__n"))
    epochs = F.when(F.col("__n") > 0, F.col("__epochs")).otherwise(F.lit(0).cast("long"))
    return both.withColumns(
        {
            "__copies": epochs + whole.cast("long"),
            "__part": F.when(whole, F.lit(0)).otherwise(F.col("__got")).cast("long"),
        }
    )


def _narrow(docs: DataFrame, spec: MixSpec, id_col: str, text_col: str) -> DataFrame:
    return scratch.written(
        docs.select(
            F.col(id_col).cast("long").alias("__id"),
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            _count(F.col(text_col)).alias("__n"),
            _own(F.col(id_col).cast("long"), F.col(text_col)).alias("__own"),
        ).withColumns(_leaf(spec)),
        "mix-rows",
    )


def take(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How much of each row of ``docs`` the mix takes.

    Columns: doc_id, domain, lang, source, n_tokens (runs of characters other than
    white space), copies (how many epochs take the row whole), partial_tokens
    (tokens of one further copy that the prefix ends in), tokens_taken.

    Null lang or source is a leaf of its own.  Null and empty texts have no tokens;
    they, and all rows of a leaf without budget, get 0 copies.  Rows with the same
    doc_id follow each other in the order of their number of tokens; rows without
    one are ordered by a hash of their text.  An empty table gives an empty result;
    other columns are ignored.
    """
    rows = _narrow(docs, spec, id_col, text_col)
    out = _taken(rows, _plan(rows, spec), spec, [F.col("__id").asc_nulls_first(), F.col("__n")])
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__domain").alias("domain"),
        "lang",
        "source",
        F.col("__n").alias("n_tokens"),
        F.col("__copies").alias("copies"),
        F.col("__part").alias("partial_tokens"),
        (F.col("__copies") * F.col("__n") + F.col("__part")).alias("tokens_taken"),
    )


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: a row for each copy.

    The last document of a leaf's prefix has its text cut after the tokens taken.
    Rows that the mix does not take are gone.  Ties and nulls as in ``take``.
    """
    rows = _narrow(docs, spec, id_col, text_col)
    # the caller's columns in one struct, so that their names clash with none
    row = F.col("row")
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select(
        "row",
        row[id_col].cast("long").alias("__id"),
        row["lang"].cast("string").alias("lang"),
        row["source"].cast("string").alias("source"),
        _count(row[text_col]).alias("__n"),
        _own(row[id_col].cast("long"), row[text_col]).alias("__own"),
    )
    tie = [F.col("__id").asc_nulls_first(), F.col("__n"), row[text_col]]
    out = _taken(wide.withColumns(_leaf(spec)), _plan(rows, spec), spec, tie)
    whole = out.filter("__copies > 0").select("row", F.explode(F.expr("sequence(1, __copies)")).alias("copy")).select("row.*")
    # cut where a token ends: the pieces put together are the text
    pieces = F.split(row[text_col], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("__part").cast("int")), "")
    return whole.unionByName(out.filter("__part > 0").select(row.withField(text_col, cut).alias("row")).select("row.*"))


def oracle(spec: MixSpec = MixSpec()) -> str:
    """DuckDB SQL for ``take`` over documents."""
    case = lambda c, weights: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in sorted(weights.items())) + f" ELSE {spec.default_weight} END" if weights else str(spec.default_weight)

    def fill(source: str, parent: str, node: str, out: str) -> str:
        return f"""
{out}1 AS (SELECT *, least(wanted, sum(cap) OVER (PARTITION BY {parent})) AS given,
  coalesce(sum(cap) OVER b, 0) AS cap_before,
  sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0) AS weight_from
  FROM {source} WINDOW b AS (PARTITION BY {parent} ORDER BY cap::DECIMAL(20,0) / weight, {node} NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}2 AS (SELECT *, min(CASE WHEN cap::HUGEINT * weight_from <= (given - cap_before)::HUGEINT * weight THEN 1 ELSE 0 END)
  OVER (PARTITION BY {parent} ORDER BY cap::DECIMAL(20,0) / weight, {node} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS is_full FROM {out}1),
{out}3 AS (SELECT *, given - sum(CASE WHEN is_full = 1 THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
  sum(CASE WHEN is_full = 1 THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open,
  sum(CASE WHEN is_full = 1 THEN 0 ELSE weight END) OVER (PARTITION BY {parent} ORDER BY cap::DECIMAL(20,0) / weight, {node} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_upto FROM {out}2),
{out} AS (SELECT *, (CASE WHEN is_full = 1 THEN cap ELSE (rest::HUGEINT * open_upto) // greatest(open, 1) - (rest::HUGEINT * (open_upto - weight)) // greatest(open, 1) END)::BIGINT AS alloc FROM {out}3)"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS own, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
  'd' || (coalesce(try_cast(right(regexp_extract(source, '([0-9]+)$', 1), 9) AS BIGINT), 0) % {spec.domains}) AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {spec.max_epochs} AS cap FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, sum(tokens)::BIGINT AS tokens, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
doms AS (SELECT 1 AS root, domain, sum(tokens)::BIGINT AS tokens, sum(cap)::BIGINT AS cap, {case('domain', spec.domain_weights)} AS weight,
  ((sum(sum(tokens)) OVER ())::HUGEINT * {spec.budget[0]} // {spec.budget[1]})::BIGINT AS wanted FROM langs GROUP BY domain),
{fill('doms', 'root', 'domain', 'top')},
langs_in AS (SELECT l.*, t.alloc AS wanted, {case('l.lang', spec.lang_weights)} AS weight FROM langs l JOIN top t USING (domain)),
{fill('langs_in', 'domain', 'lang', 'middle')},
leaves_in AS (SELECT l.*, m.alloc AS wanted, {case('l.source', spec.source_weights)} AS weight FROM leaves l
  JOIN middle m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang),
{fill('leaves_in', 'domain, lang', 'source', 'low')},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN alloc % tokens ELSE 0 END AS need FROM low),
e AS (SELECT d.*, p.epochs, p.need, md5('{spec.seed}:' || p.epochs || ':' || coalesce(doc_id::VARCHAR, 'null:' || own)) AS k FROM d JOIN plan p
  ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT *, greatest(least(n_tokens, need - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS got FROM e)
SELECT doc_id, domain, lang, source, n_tokens,
  CASE WHEN n_tokens > 0 THEN epochs + CASE WHEN got = n_tokens THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies,
  CASE WHEN got = n_tokens THEN 0 ELSE got END::BIGINT AS partial_tokens,
  CASE WHEN n_tokens > 0 THEN epochs * n_tokens + got ELSE 0 END::BIGINT AS tokens_taken FROM g
"""


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return take(spark.read.parquet(f"{sf_dir}/documents.parquet"))
