"""Near duplicates by a chosen-path similarity join over word shingles.

Documents with the same set of shingles form a class.  Each class has a signature
of minwise tokens.  A tree starts with all classes in one node; a node picks places
of the signature by a hash of its own path, three for each of its picks, and its
members go to the children named by their three tokens.  Nodes with few members
are compared exhaustively, larger ones branch again, and independent trees repeat
this to reach the target recall.  A pair at the threshold meets in a child with
probability percent^tokens a pick (0.61 at 0.85, 0.51 at 0.80).  A node that shrinks
faster than that holds mostly pairs below the threshold and has ``wide`` picks, so
that such a pair has 1.5 children in common or more at every level: it is missed by
all six trees with a probability below 1e-6 at 0.85 and of about 1e-4 at 0.80 at
any depth.  A node that shrinks slower holds mostly links: it branches on with fewer
picks to find them, and then its members that are not connected to most of the
others are compared with all of its members, so nothing is left to chance there.
The same is done for nodes that are too deep.

Links matter only between components, and a large group of near copies would be compared
in nodes of every tree and level.  So the members of the first large nodes are compared
once before the trees grow on, in parts that have some members in common.  Large nodes
with the same largest component are put together, and where that moves fewer rows than
another level, their members outside it are compared with all of theirs at once.  Then
members of one component or of nodes put together need not meet again: nodes without
others are dropped, and pairs of them are no candidates.

What is compared: first signatures, to drop pairs far from similar (6 standard
deviations below the threshold), then the full sets.  Only connections within a
compared group leave it, never all its pairs; groups with very many shingles are
compared in parts.

Words and shingles stand in sets as 64-bit hashes of their bytes under a key that is
drawn for each run (``JoinSpec.key`` fixes it).  Two sets of m and n shingles seem to
share one they do not share with a probability of about m * n / 2^64, which no text
written beforehand can raise.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .pretokens import U64, scrambled, span_hashes, trimmed

PLACES = 128
ROWS = 256  # texts hashed at once


@dataclass(frozen=True)
class JoinSpec:
    """Parameters of the join; a link needs 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 85
    trees: int = 6
    picks: tuple[int, ...] = (3, 2, 1)  # of a node by its level, the last for all below; see ``wide``
    tokens: int = 3  # of a pick
    small: int = 1000  # members of a node that is compared exhaustively
    common: int = 8  # members that the parts of a large node have in common
    depth: int = 10
    seed: int = 11
    key: int | None = None  # of the hashes of words; None: drawn for each run
    shingles: int = 1 << 21  # of a group that is compared whole

    @property
    def wide(self) -> int:
        """Picks of a node that shrinks as texts below the threshold do: 1.5 common children of a pair at it."""
        return math.ceil(1.5 / self.met)

    @property
    def met(self) -> float:
        """Probability that a pick takes both texts of a pair at the threshold to one child."""
        return (self.percent / 100) ** self.tokens

    @property
    def least_matches(self) -> int:
        """Equal places of two signatures below which a pair is no candidate."""
        j = self.percent / 100
        return max(1, int(PLACES * j - 6.1 * (PLACES * j * (1 - j)) ** 0.5))


def with_key(spec):
    """``spec`` with a key, which all tasks of a run share."""
    return spec if spec.key is not None else replace(spec, key=secrets.randbits(63))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    mixed = scrambled(base)
    return mixed[:n] | U64(1), mixed[n:]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column laid end to end, and where each value starts (and the last ends)."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (under ``key``) of the lower-cased words of texts laid end to end, and where each text's begin (and the last end)."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    text = _LOWER[raw]
    inside = ~_SPACE[text]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return span_hashes(text.tobytes(), starts, ends, key), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, repeated ones too, and where each text's begin.

    A text with fewer words has the run of all of them; one without words has none.
    """
    count = np.diff(edges)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(number))
    first = np.repeat(edges[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(count, size), number)
    out = scrambled(length.astype(U64))
    padded = np.append(words, np.zeros(size, U64))
    for k in range(size):
        step = scrambled(out + padded[first + k])
        out = np.where(k < length, step, out)
    return out, bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """The minwise tokens of each text that has shingles, one row a text."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(some), PLACES), np.uint32)
    if len(some):
        multiply, add = _multipliers(PLACES, seed)
        for k in range(PLACES):
            out[:, k] = np.minimum.reduceat(((hashes ^ add[k]) * multiply[k]) >> U64(32), bounds[some])
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )


def _sets(batch: pa.RecordBatch, spec: JoinSpec) -> Iterator[tuple]:
    """(first row, hashes, bounds, distinct sorted sets) for parts of a batch with a column text."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.column("text").slice(at, ROWS)
        hashes, bounds = shingle_hashes(*word_hashes(*bytes_of(part), spec.key), spec.words)
        edges = bounds.tolist()
        yield at, hashes, bounds, [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _key(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.astype("<u8").tobytes(), digest_size=16).digest() if len(members) else None


def shingle_rows(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, bounds, sets in _sets(batch, spec):
                tokens = iter(signatures(hashes, bounds, spec.seed))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_key(s) for s in sets], pa.binary()),
                        pa.array([next(tokens).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "key", "signature"],
                )
        trimmed()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, key binary, signature binary")


def _tokens(column: pa.Array) -> np.ndarray:
    raw, _ = bytes_of(column)
    return raw.view("<u4").reshape(-1, PLACES)


def _children(nodes: np.ndarray, tokens: np.ndarray, picks: int, together: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, names) of the children that members of ``nodes`` go to: ``picks`` for each, by ``together`` tokens."""
    rows, names = np.arange(len(nodes)), []
    for pick in range(picks):
        name = scrambled(nodes + U64(2 * pick + 1) * U64(0x2545F4914F6CDD1D))
        at = name
        for _ in range(together):
            at = scrambled(at ^ U64(0xA5A5A5A5A5A5A5A5))
            name = scrambled(name ^ tokens[rows, (at % U64(PLACES)).astype(np.int64)].astype(U64))
        names.append(name)
    return np.tile(rows, picks), np.concatenate(names)


def _branched(members: DataFrame, spec: JoinSpec, level: int) -> DataFrame:
    """Members of the next level's nodes.  At the root: node, cid; deeper: node, parent_size, covered, c, cid, signature."""
    picks = spec.picks[min(level, len(spec.picks) - 1)]
    most = max(picks, spec.wide)
    roots = scrambled(np.arange(spec.trees, dtype=U64) + U64(spec.seed << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column("signature"))
            if not level:
                cid = batch.column("cid").to_numpy()
                for root in roots:
                    rows, names = _children(np.full(len(cid), root), tokens, most, spec.tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(cid[rows])], ["node", "cid"])
            else:
                wide = batch.column("wide").to_numpy(zero_copy_only=False)
                nodes, found = batch.column("node").to_numpy().view(U64), []
                for some, number in ((np.flatnonzero(wide), most), (np.flatnonzero(~wide), picks)):
                    rows, names = _children(nodes[some], tokens[some], number, spec.tokens)
                    found.append((some[rows], names))
                rows, names = (np.concatenate(x) for x in zip(*found, strict=True))
                rest = batch.select(["n", "covered", "c", "cid", "signature"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), *rest.columns], ["node", "parent_size", "covered", "c", "cid", "signature"]
                )

    if not level:
        return members.select("cid", "signature").mapInArrow(run, "node long, cid long")
    source = members.select("node", "n", "wide", "covered", "c", "cid", "signature")
    return source.mapInArrow(run, "node long, parent_size long, covered boolean, c long, cid long, signature binary")


def _grouped(rows: DataFrame, group: str) -> DataFrame:
    """The rows of each (bounded) group one after the other."""
    return rows.repartition(group).sortWithinPartitions(group, "cid")


def _groups(batches: Iterator[pa.RecordBatch], column: str, most: int = 4000) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches in which the rows of a group follow each other."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            names = batch.column(column).to_numpy()
            changes = np.flatnonzero(names[1:] != names[:-1])
            last = int(changes[-1]) + 1 if len(changes) else 0
            if held and names[0] != held[-1].column(column)[-1].as_py():
                yield pa.Table.from_batches(held)
                held = []
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _joined(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _each(table: pa.Table, column: str) -> Iterator[tuple[int, int]]:
    names = table.column(column).to_numpy()
    edges = np.flatnonzero(np.append(True, np.append(names[1:] != names[:-1], True)))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def parted(cid: np.ndarray, size: np.ndarray, spec: JoinSpec) -> list[np.ndarray]:
    """Groups that hold together all pairs of a group whose sizes allow a link.

    A group of up to ``spec.shingles`` shingles stays whole.  Others are dealt by
    ascending size to blocks of half of that (or one larger member), and each two
    blocks that may have a link are a group.
    """
    if size.sum() <= spec.shingles:
        return [np.sort(cid)]
    order = np.lexsort((cid, size))
    cid, size = cid[order], size[order]
    blocks, at = [], 0
    while at < len(cid):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), spec.shingles // 2, "right")))
        blocks.append(slice(at, at + n))
        at += n
    pairs = [(x, y) for k, x in enumerate(blocks) for y in blocks[k + 1 :] if 100 * size[x][-1] >= spec.percent * size[y][0]]
    alone = [x for x in blocks if len(cid[x]) > 1 and not any(x in pair for pair in pairs)]
    return [np.sort(np.concatenate([cid[x], cid[y]])) for x, y in pairs] + [np.sort(cid[x]) for x in alone]


def _candidates(lists: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Groups (arrays of cid) that signatures connect, of members that differ in c, out of groups ``members``."""
    rows = lists.select(F.xxhash64("members").alias("g"), F.explode("members").alias("cid"))
    rows = rows.join(classes.select("cid", "n_shingles", "c", "signature"), "cid")
    least, percent = spec.least_matches, spec.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "g"):
            cid, size = table.column("cid").to_numpy(), table.column("n_shingles").to_numpy()
            known = table.column("c").to_numpy()
            tokens = _tokens(table.column("signature").combine_chunks())
            found = []
            for a, b in _each(table, "g"):
                own, n, c = tokens[a:b], size[a:b], known[a:b]
                linked = np.zeros((b - a, b - a), bool)
                for k in range(b - a):
                    linked[k] = (own == own[k]).sum(1) >= least
                linked &= c[:, None] != c
                linked &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
                label = _joined(linked)
                for name in np.flatnonzero(np.bincount(label, minlength=b - a) > 1):
                    some = label == name
                    found += parted(cid[a:b][some], n[some], spec)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])
        trimmed()

    return _grouped(rows.select("g", "cid", "n_shingles", "c", "signature"), "g").mapInArrow(run, "members array<long>").distinct()


def _links(groups: DataFrame, classes: DataFrame, docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """Edges (u, v) that connect the members of ``groups`` as links on the full sets do."""
    rows = groups.select(F.xxhash64("members").alias("g"), F.explode("members").alias("cid"))
    wanted = rows.join(classes.select("cid", "key", "rep"), "cid")
    ids = wanted.select(F.col("rep").alias("__id")).distinct()
    texts = _texts(docs, id_col, text_col)
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["__id"]), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, sets in _sets(batch, spec):
                once = {_key(s): s for s in sets if len(s)}  # rows with the same id may have the same text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(once), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in once.values()], pa.binary())],
                    ["key", "shingles"],
                )
        trimmed()

    sets = texts.select("text").mapInArrow(sets_of, "key binary, shingles binary")
    # both sides grow with the input, so they are joined in the same way at every size
    rows = sets.join(wanted.select("g", "cid", "key").hint("merge"), "key")
    percent = spec.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "g", 256):
            cid, column = table.column("cid").to_numpy(), table.column("shingles")
            us, vs = [], []
            for a, b in _each(table, "g"):
                members = [np.frombuffer(x.as_buffer(), "<u8") for x in column[a:b]]
                label = _joined(linked_sets(members, percent))
                us.append(cid[a:b][label != np.arange(b - a)])
                vs.append(cid[a:b][label[label != np.arange(b - a)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
        trimmed()

    return _grouped(rows.select("g", "cid", "shingles"), "g").mapInArrow(run, "u long, v long").distinct()


def linked_sets(members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets of hashes (sorted, distinct) are linked, exactly."""
    n = len(members)
    size = np.array([len(m) for m in members])
    owner = np.repeat(np.arange(n), size)
    names, code, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = often[code] > 1  # others add nothing to an intersection
    owner, code = owner[shared], (np.cumsum(often > 1) - 1)[code[shared]]
    common = np.zeros((n, n), np.int64)
    width = int((often > 1).sum())
    step = max(1, (1 << 22) // n)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(code, [low, low + step])
        block = np.zeros((n, min(step, width - low)), np.float32)
        block[owner[a:b], code[a:b] - low] = 1
        common += (block @ block.T).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    return 100 * common >= percent * union


def _node_lists(rows: DataFrame, apart: bool = False) -> DataFrame:
    """The members of (small) nodes as sorted arrays, each array once; ``apart``: only of nodes whose members differ in c."""
    members = F.sort_array(F.collect_set("cid")).alias("members")
    if apart:
        lists = rows.groupBy("node").agg(members, F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    else:
        lists = rows.groupBy("node").agg(members)
    return lists.select("members").distinct()


def _labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` and c: members (cid) with the same c need not meet."""
    if known is None:
        return rows.withColumn("c", F.col("cid"))
    rows = rows.join(known.select(F.col("u").alias("cid"), F.col("v").alias("c")), "cid", "left")
    return rows.withColumn("c", F.coalesce("c", "cid"))


def _mixed(rows: DataFrame) -> DataFrame:
    """n (members) of the nodes of ``rows`` whose members differ in c."""
    each = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    return each.filter("low < high").select("node", "n")


def _first_groups(large: DataFrame, spec: JoinSpec) -> DataFrame:
    """Groups that hold each member of ``large`` nodes once, in the largest of its nodes, by parts of half a small node.

    All parts of a node have the same few members of it too, which connect what links connect with them.
    """
    parts = F.ceil(F.col("n") / (spec.small // 2)).cast("int")
    home = large.groupBy("cid").agg(F.max_by("node", F.struct("n", "node")).alias("node"), F.max("n").alias("n"))
    home = home.select("node", "cid", F.pmod(F.xxhash64("cid", F.lit(3)), parts).cast("int").alias("part"))
    common = [F.min_by("cid", F.xxhash64("cid", F.lit(10 + k))) for k in range(spec.common)]
    common = large.groupBy("node").agg(F.max("n").alias("n"), F.array(*common).alias("some"))
    common = common.select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "some")
    common = common.select("node", F.explode("some").alias("cid"), "part")
    return _node_lists(home.unionByName(common).select(F.xxhash64("node", "part").alias("node"), "cid"))


def _moved(n: str, apart: str, spec: JoinSpec) -> Column:
    """Rows of the groups that ``_blocks`` makes of a node of n members."""
    blocks = lambda k: F.ceil(F.col(k) / (spec.small // 2))
    return F.col(n) * blocks(apart) + F.col(apart) * blocks(n)


def _together(large: DataFrame, found: DataFrame, spec: JoinSpec, otherwise: Column | None = None) -> DataFrame:
    """Nodes with the same largest component put together, named by it, where their blocks have fewer rows: node, n, cid.

    Fewer than those nodes' ``otherwise``, and the others are left out; without it, than
    the blocks of each alone, and the others stay as they are.
    """
    label = scratch.written(_labelled(large.select("node", "n", "cid"), found), "together")
    each = label.groupBy("node", "c").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    top = each.groupBy("node").agg(
        F.max_by("c", F.struct("k", "c")).alias("top"), F.max("n").alias("n"), (F.sum("k") - F.max("k")).alias("apart")
    )
    top = scratch.written(top, "tops")  # a row a node of more than ``small`` members
    rows = label.join(top.select("node", "top"), "node").select("top", "cid", "c").distinct()
    size = rows.groupBy("top").agg(F.count("*").alias("n"), F.count_if(F.col("c") != F.col("top")).alias("apart"))
    alone = top.groupBy("top").agg(F.sum(_moved("n", "apart", spec) if otherwise is None else otherwise).alias("alone"))
    size = scratch.written(size.join(alone, "top").filter(_moved("n", "apart", spec) <= F.col("alone")).select("top", "n"), "put-together")
    out = rows.join(size, "top").select(F.col("top").alias("node"), "n", "cid")
    if otherwise is None:
        stay = top.select("node", "top").join(size.select("top"), "top", "left_anti")
        out = out.unionByName(label.select("node", "n", "cid").join(stay.select("node"), "node", "left_semi"))
    return scratch.written(out, "whole")


def _met_early(large: DataFrame, active: DataFrame, spec: JoinSpec, compared: Callable) -> tuple[DataFrame, DataFrame]:
    """Links of members of the first large nodes, and which of them (u) need not meet again: those with the same v."""
    links = scratch.written(compared(_first_groups(large, spec), active), "first-links")
    found = components(links)
    whole = _together(large, found, spec, spec.wide * F.col("n"))
    lists = _blocks(whole, found, spec)
    if lists is not None:
        links = links.unionByName(scratch.written(compared(lists, active, found), "whole-links"))
    # members of nodes put together have names below zero, since others of their component did not meet all of them
    named = whole.groupBy("cid").agg(F.max(-1 - F.col("node")).alias("name"))
    known = found.join(named, found["u"] == named["cid"], "full").select(F.coalesce("cid", "u").alias("u"), F.coalesce("name", "v").alias("v"))
    return links, scratch.written(known, "known")


def _trees(classes: DataFrame, spec: JoinSpec, compared: Callable) -> tuple[DataFrame, DataFrame, DataFrame | None, tuple]:
    """Classes that share a node with another, groups to compare, members of nodes that shrink slowly or are too deep, and ``_met_early``.

    ``compared`` gives the links of groups.
    """
    small, large = [], []
    members, active, first, known, level = classes, classes, None, None, 0
    while True:
        rows = _branched(members, spec, level)  # made twice, which is cheaper than to write them
        counts = _mixed(rows) if level else rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        shared = scratch.written(rows.join(counts.hint("merge"), "node"), f"shared-{level}")
        rest = shared.filter(F.col("n") > spec.small)
        if not level:
            some = shared.select("cid").distinct()
            active = scratch.written(classes.join(some.hint("merge"), "cid", "left_semi"), "active")
            rest = scratch.written(rest.join(active.select("cid", "signature"), "cid"), "large-0")
            if not rest.isEmpty():
                first, known = _met_early(rest, active, spec, compared)
            shared, rest = _labelled(shared, known), _labelled(rest, known)
            if known is not None:
                rest = scratch.written(rest.join(_mixed(rest).select("node"), "node", "left_semi"), "mixed-0")
        small.append(_node_lists(shared.filter(F.col("n") <= spec.small), apart=True))
        level += 1
        stuck, covered = F.lit(level > spec.depth), F.lit(False)
        # of the first nodes nothing is known, as their parents hold all texts
        wide = F.lit(True)
        if level > 1:
            stuck = stuck | (F.lit(level > 3) & (F.col("n") > 0.9 * F.col("parent_size")))
            wide = F.col("n") < spec.met * F.col("parent_size")
            covered = F.col("covered") | ~wide | stuck
            # parts of a node that is on the list need not be on it again
            large.append(rest.filter(covered & ~F.col("covered")).select("node", "n", "cid"))
        members = rest.filter(~stuck).select("node", "n", wide.alias("wide"), covered.alias("covered"), "c", "cid", "signature")
        if members.isEmpty():
            break
    lists = small[0]
    for part in small[1:]:
        lists = lists.unionByName(part)
    nodes = large[0] if large else None
    for part in large[1:]:
        nodes = nodes.unionByName(part)
    return active, lists.distinct(), nodes, (first, known)


def _blocks(large: DataFrame, found: DataFrame, spec: JoinSpec) -> DataFrame | None:
    """Groups that compare the members of large nodes that are not in the node's largest component with all of its members.

    Both are dealt to blocks of half a small node; each block of the former and each
    of the latter are a group.  None where all nodes are connected.
    """
    label = large.join(found.withColumnRenamed("u", "cid"), "cid", "left").select("node", "n", "cid", F.coalesce("v", "cid").alias("c"))
    label = scratch.written(label, "large-labels")
    each = label.groupBy("node", "c").agg(F.count("*").alias("k"))
    most = each.groupBy("node").agg(F.max_by("c", F.struct("k", "c")).alias("top"), (F.sum("k") - F.max("k")).alias("apart"))
    most = scratch.written(most.filter("apart > 0"), "large-apart")  # a row a node of more than ``small`` members
    if most.isEmpty():
        return None
    rows = label.join(most, "node")
    half = spec.small // 2
    deal = lambda salt, n: F.pmod(F.xxhash64("cid", F.lit(salt)), F.ceil(F.col(n) / half)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / half).cast("int") - 1))
    inside = rows.select("node", "cid", deal(1, "n").alias("b"), every("apart").alias("a"))
    apart = rows.filter("c <> top").select("node", "cid", deal(2, "apart").alias("a"), every("n").alias("b"))
    pairs = inside.unionByName(apart)
    return _node_lists(pairs.select(F.xxhash64("node", "a", "b").alias("node"), "cid"))


def _further(links: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``links`` added: components of components, which are few, where links join any."""
    name = lambda side: found.select(F.col("u").alias(side), F.col("v").alias(f"{side}_in"))
    rows = links.join(name("u"), "u", "left").join(name("v"), "v", "left")
    rows = rows.select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")).filter("u <> v")
    rows = scratch.written(rows.distinct(), "joined-components")
    if rows.isEmpty():
        return found
    merged = components(rows)
    after = merged.select(F.col("u").alias("v"), F.col("v").alias("low"))
    moved = found.join(after, "v", "left").select("u", F.coalesce("low", "v").alias("v"))
    # what was the smallest of its component, or in none, is named by another now
    return scratch.written(moved.unionByName(merged), "components")


def near_duplicates(docs: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_key.

    component_id is the smallest doc_id that links lead to, its own included; kept
    is doc_id = component_id; class_key names the set of shingles.

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows
    with the same set are linked.  A null id is larger than all others: it never is
    a component_id unless the whole component has none, and such rows are not kept.
    An empty table gives an empty result; other columns are ignored.
    """
    return _named(docs, spec, id_col, text_col).drop("c")


def _named(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates``, and c, which names the component also where components share a smallest doc_id."""
    spec, point = with_key(spec), scratch.mark()
    rows = scratch.written(shingle_rows(docs, spec, id_col, text_col), "shingle-rows")
    classes = (
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = scratch.written(classes, "classes")

    def compared(lists: DataFrame, active: DataFrame, known: DataFrame | None = None) -> DataFrame:
        groups = scratch.written(_candidates(lists, _labelled(active, known), spec), "groups")
        return _links(groups, active, docs, spec, id_col, text_col)

    active, lists, stuck, (first, known) = _trees(classes, spec, compared)
    links = scratch.written(compared(lists, active, known), "links")
    found = components(links if first is None else links.unionByName(first))
    lists = None if stuck is None or stuck.isEmpty() else _blocks(_together(stuck, found, spec), found, spec)
    if lists is not None:
        found = _further(compared(lists, active, found), found)
    label = classes.select("cid", "key", "rep").join(found.withColumnRenamed("u", "cid"), "cid", "left")
    label = label.select("key", "rep", F.coalesce("v", "cid").alias("c"))
    least = scratch.written(label.groupBy("c").agg(F.min("rep").alias("component_id")), "component-ids")
    named = scratch.written(label.join(least, "c").select("key", "component_id", "c"), "named")
    scratch.remove_since(point, rows, named)
    out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
        F.col("key").alias("class_key"),
        "c",
    )


def keep_one(docs: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names their component; rows without shingles or id all stay.

    Where rows with one id have several texts, each goes or stays by its own set of
    shingles; of several sets with the id that names their component one stays.
    """
    spec, point = with_key(spec), scratch.mark()
    found = _named(docs, spec, id_col, text_col).filter("doc_id is not null")
    key = F.col("class_key")
    marks = found.groupBy("doc_id", "c").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min(F.when(F.col("kept"), key)).alias("stay"))
    marks = scratch.written(marks, "marks")
    goes = F.col("low").isNotNull() & (F.col("stay").isNull() | (F.col("low") != F.col("stay")) | (F.col("high") != F.col("stay")))
    stays = F.col("low").isNull() | F.col("stay").isNotNull()
    ids = marks.groupBy("doc_id").agg(F.max(goes).alias("goes"), F.max(stays).alias("some"))
    gone = scratch.written(ids.filter("goes").select(F.col("doc_id").alias("gone"), "some"), "gone")
    scratch.remove_since(point, marks, gone)
    # the caller's columns in one struct, so that their names clash with none
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = F.col("row")[id_col].cast("long") == F.col("gone")
    whole = rows.join(gone, same, "left_anti")
    # ids of which some rows stay and some go: these rows' own sets decide
    text = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    mixed = rows.join(gone.filter("some"), same).select("row", "gone", text.alias("text"), F.lit(None).cast("binary").alias("key"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(m) for _, _, _, sets in _sets(batch, spec) for m in sets]
            yield batch.set_column(3, "key", pa.array(keys, pa.binary()))

    kept = marks.filter("stay is not null").select(F.col("doc_id").alias("own"), "stay").distinct()
    mixed = mixed.mapInArrow(keyed, mixed.schema)
    mixed = mixed.join(kept, (F.col("gone") == F.col("own")) & (F.col("key") == F.col("stay")), "left")
    mixed = mixed.filter("key is null or stay is not null")
    return whole.select("row.*").unionByName(mixed.select("row.*"))


_SPACES = "[^\\x20\\x09-\\x0D]+"
_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}')"""

#: All pairs that share a shingle, compared; then the smallest id that links lead to.
ORACLE = f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 5 THEN [w]
  ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT DISTINCT u, u AS v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON u = d.doc_id"""


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
