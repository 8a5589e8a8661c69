"""An entity table and an attribute table, related by a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlearn.functions import vectors as V


@dataclass(frozen=True)
class Names:
    """Column names of the caller's tables."""

    sid: str = "sid"
    label: str = "label"
    forkey: str = "forkey"
    xs: str = "xs"
    rid: str = "rid"
    xr: str = "xr"
    x: str = "x"


@dataclass(frozen=True)
class NormalizedData:
    """``s``: sid, label (-1 or 1), forkey, xs; ``r``: rid, xr; d_s and d_r features.

    Rows with a null label, vector or key take no part, as in the reference
    semantics of strict functions.  Keys may be any integers, 0 included.
    """

    s: DataFrame
    r: DataFrame
    d_s: int
    d_r: int
    dealt: int | None = None  # into how many parts both tables are dealt by key and sorted, if they are

    @property
    def d(self) -> int:
        return self.d_s + self.d_r

    def cached(self, parts: int | None = None) -> NormalizedData:
        """Both tables kept for many passes; with ``parts``, dealt out by the key once, so that passes shuffle neither.

        Entity rows read from fewer files than there are cores are dealt to all cores.
        """
        s, r = (self.s.repartition(parts, "forkey"), self.r.repartition(parts, "rid")) if parts else (self.s, self.r)
        cores = s.sparkSession.sparkContext.defaultParallelism
        if not parts and s.rdd.getNumPartitions() < cores:
            s = s.repartition(cores)
        return NormalizedData(s.persist(), r.persist(), self.d_s, self.d_r)

    def split(self, k: int) -> NormalizedData:
        """Both tables in k parts by the hash of the key, sorted by it: joins need neither a shuffle nor a sort."""
        s = self.s.repartition(k, "forkey").sortWithinPartitions("forkey")
        return NormalizedData(s, self.r.repartition(k, "rid").sortWithinPartitions("rid"), self.d_s, self.d_r, k)

    def kept(self) -> NormalizedData:
        """Both tables as they are, kept for many passes."""
        return NormalizedData(self.s.persist(), self.r.persist(), self.d_s, self.d_r, self.dealt)

    def release(self) -> None:
        self.s.unpersist()
        self.r.unpersist()


def normalized(s: DataFrame, r: DataFrame, names: Names = Names(), d_s: int | None = None, d_r: int | None = None) -> NormalizedData:
    """The two tables with the engine's names.  Widths that are not given are read from a row."""
    s = s.select(
        F.col(names.sid).cast("long").alias("sid"),
        V.sign_label(F.col(names.label).cast("double")).alias("label"),
        F.col(names.forkey).cast("long").alias("forkey"),
        F.col(names.xs).cast("array<double>").alias("xs"),
    ).dropna(subset=["label", "forkey", "xs"])
    r = r.select(F.col(names.rid).cast("long").alias("rid"), F.col(names.xr).cast("array<double>").alias("xr")).dropna()
    return NormalizedData(s, r, _width(s, "xs") if d_s is None else d_s, _width(r, "xr") if d_r is None else d_r)


def _width(rows: DataFrame, column: str) -> int:
    first = rows.select(F.size(column).alias("n")).first()
    return first.n if first else 0


def validate(data: NormalizedData, strict_fk: bool = False) -> dict[str, int]:
    """Sizes of the tables: n_s, n_r and most_s, the entity rows of the most frequent key.

    Raises for duplicate rids, unequal lengths and, if strict, unmatched keys.
    """
    s, r = _sizes(data.s, "forkey", "xs", data.d_s), _sizes(data.r, "rid", "xr", data.d_r)
    if s.bad or r.bad:
        raise ValueError(f"vectors of other lengths than {data.d_s} and {data.d_r}: {s.bad} entity, {r.bad} attribute rows")
    if r.most > 1:
        raise ValueError("attribute keys are not unique")
    if strict_fk and not data.s.join(data.r, data.s["forkey"] == data.r["rid"], "left_anti").isEmpty():
        raise ValueError("entity rows refer to attribute rows that are not there")
    return {"n_s": s.n, "n_r": r.n, "most_s": s.most}


def _sizes(rows: DataFrame, key: str, x: str, d: int):
    """n (rows), bad (vectors not of length d) and most (rows of the most frequent key), in one job."""
    each = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.size(x) != d).alias("bad"))
    sums = [F.coalesce(f(c), F.lit(0)).alias(name) for f, c, name in ((F.sum, "n", "n"), (F.sum, "bad", "bad"), (F.max, "n", "most"))]
    return each.agg(*sums).first()


def parts_by_key(data: NormalizedData, sizes: dict[str, int]) -> int | None:
    """Into how many parts to deal both tables by key, or None where that does not pay.

    It pays where the attribute table is too large to be broadcast in each pass.
    It does not where one key would make a part several times the others': there
    the joins shuffle in each pass, and Spark splits the key's partition.
    """
    conf = data.s.sparkSession.conf
    limit = conf.get("spark.sql.autoBroadcastJoinThreshold")
    digits = limit.lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 1)
    most = int(digits[:-1] if factor > 1 else digits) * factor
    if sizes["n_r"] * (8 * data.d_r + 24) <= most:
        return None
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    return None if sizes["most_s"] > 3 * max(1, sizes["n_s"] // parts) else parts
