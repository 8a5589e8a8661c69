"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes.  The distinct
blocks are sorted (by their first bytes, then by their hash) and their ranks are
their names; then the names of adjacent blocks are paired, the distinct pairs are
sorted and get their ranks as names, and so on until each text has one name.  Ranks
are those of all rows, so names do not depend on how rows are dealt to tasks.  Two
texts of the same number of blocks have the same name if and only if they are
equal: names are given to contents, never to hashes.  A 64-bit hash only carries a
name back to its occurrences; hashes that stand for more than one content are found
and joined by content instead.

Only DataFrame operations are used.  Distinct contents are combined before the
shuffle, so copies in any number cost one row per task; names are joined back in
plain equi-joins, which Spark splits where they are skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4096
HEAD_BYTES = 32  # of a block, by which it is sorted


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _named(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Each row of ``distinct`` with its rank, from 0, in ``order``, which no two rows share.

    The rows are sorted in ranges; a range's ranks start after the rows of those before it.
    """
    rows = scratch.written(distinct, f"{name}-distinct")
    ranges = scratch.written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("__at", 33)
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))  # one row a range
    first = F.sum("__rows").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__rows")
    first = F.broadcast(sizes.select("__part", first.alias("__first")))
    placed = ranges.withColumn("__part", part).join(first, "__part")
    return placed.withColumn(name, F.col("__first") + F.col("__at") - F.shiftleft("__part", 33)).drop("__at", "__part", "__first")


def block_identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, sha (of the normalised text), n_blocks, name.

    (n_blocks, name) is equal for two rows exactly if their normalised texts are.
    rid numbers the rows.  Empty and null texts have one empty block.
    """
    text = F.encode(normalised(F.col(text_col)), "UTF-8")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"))
    last = F.greatest(F.ceil(F.octet_length("body") / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.col("body").substr(i * block_bytes + 1, F.lit(block_bytes))
    )
    rows = scratch.written(
        source.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.sha2("body", 256).alias("sha"),
            F.transform(blocks, lambda b: block_hash(b)).alias("hashes"),
        ),
        "block-rows",
    )
    pieces = source.select(F.explode(blocks).alias("block")).select(block_hash(F.col("block")).alias("h"), "block")
    contents = pieces.groupBy("h", "block").agg(F.lit(1).alias("one"))
    # which of several blocks with one hash and the same first bytes comes first does not matter: they are named by content
    contents = contents.select("h", F.col("block").substr(1, HEAD_BYTES).alias("head"))
    names = scratch.written(_named(contents, ["head", "h"], "name").select("h", "name"), "block-names")
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    occurs = rows.select("rid", F.posexplode("hashes").alias("idx", "h"))
    if shared.isEmpty():
        current = occurs.join(names, "h").select("rid", "idx", "name")
    else:
        current = _by_content(docs, id_col, text_col, block_bytes, block_hash, rows, names, shared)
    current = scratch.written(current.select("rid", "idx", "name"), "level-0")
    sizes = rows.select("rid", F.size("hashes").alias("n_blocks"))
    most = sizes.agg(F.max("n_blocks")).first()[0] or 1
    single = sizes.filter("n_blocks = 1").join(current, "rid").select("rid", "n_blocks", "name")
    done = [single]
    current = current.join(sizes.filter("n_blocks > 1"), "rid")
    width, level = most, 0
    while width > 1:
        level += 1
        width = -(-width // 2)
        # idx runs over the names of a text; an odd last name is paired with null
        pairs = scratch.written(
            current.groupBy("rid", "n_blocks", F.shiftright("idx", 1).alias("idx")).agg(
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
            ),
            f"pairs-{level}",
        )
        given = scratch.written(
            _named(pairs.select("a", "b").distinct(), ["a", "b"], "name"),
            f"pair-names-{level}",
        )
        same = (pairs["a"] == given["a"]) & pairs["b"].eqNullSafe(given["b"])
        current = pairs.join(given, same).select("rid", "n_blocks", "idx", "name")
        # a text of n blocks has one name left after ceil(log2(n)) levels
        finished = F.col("n_blocks") <= 2**level
        done.append(current.filter(finished).select("rid", "n_blocks", "name"))
        current = current.filter(~finished)
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return rows.select("rid", "doc_id", "sha").join(named, "rid")


def _by_content(docs, id_col, text_col, block_bytes, block_hash, rows, names, shared) -> DataFrame:
    """Occurrences with names where some hashes stand for several contents: those join by content.

    Reads the texts of the rows concerned once more; they are found by their hash
    of the whole text and their position does not matter, since equal texts get
    equal names.
    """
    text = F.encode(normalised(F.col(text_col)), "UTF-8")
    last = F.greatest(F.ceil(F.octet_length("body") / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.col("body").substr(i * block_bytes + 1, F.lit(block_bytes))
    )
    occurs = (
        docs.select(text.alias("body"))
        .select(F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("len"), F.posexplode(blocks).alias("idx", "block"))
        .withColumn("h", block_hash(F.col("block")))
        .join(shared, "h", "left_semi")
        .select("sha", "idx", "h", "block")
        .distinct()
    )
    content = scratch.written(occurs, "shared-hash-blocks")
    given = scratch.written(
        _named(content.select("block").distinct(), ["block"], "name").withColumn("name", -1 - F.col("name")),
        "shared-hash-names",
    )
    by_text = content.join(given, "block").select("sha", "idx", "name")
    where = rows.select("rid", "sha", F.posexplode("hashes").alias("idx", "h"))
    plain = where.join(shared, "h", "left_anti").join(names, "h").select("rid", "idx", "name")
    special = where.join(shared, "h", "left_semi").join(by_text, ["sha", "idx"]).select("rid", "idx", "name")
    return plain.unionByName(special)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``, dropped ones too.

    Columns: doc_id, keep_id (of the row that stays: the largest doc_id of the
    equal texts), group_size, kept, text_sha256 (of the normalised text).

    Null and empty texts are equal.  Of rows with the same doc_id and text one
    stays.  Null ids come before all others; keep_id is null where a group has no
    id.  An empty table gives an empty result; other columns are ignored.
    """
    point = scratch.mark()
    named = scratch.written(block_identities(docs, id_col, text_col, **options), "identities")
    scratch.remove_since(point, named)
    groups = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
    )
    # written, so that the join has two shuffled sides and Spark can split the partition of a large group
    groups = scratch.written(groups, "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Rows are found by doc_id and normalised text; where several rows share both,
    one of them stays.
    """
    point = scratch.mark()
    found = exact_dedup(docs, id_col, text_col, **options)
    # summed before the shuffle, however many rows share an id and a text
    same = found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    stay = same.agg(F.max("kept").alias("kept"), (F.count("*") > 1).alias("again")).filter("kept").drop("kept")
    stay = scratch.written(stay, "kept")
    scratch.remove_since(point, stay)
    # the caller's columns in one struct, so that their names clash with none
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = F.col("row")
    mark = F.sha2(F.encode(normalised(row[text_col]), "UTF-8"), 256)
    joined = rows.withColumn("mark", mark).join(stay, row[id_col].cast("long").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("sha")))
    once = joined.filter(~F.col("again"))
    many = joined.filter("again").dropDuplicates(["id", "sha"])
    return once.unionByName(many).select("row.*")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
