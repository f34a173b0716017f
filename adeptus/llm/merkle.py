"""Merkle dataset manifest: eight-ary trees in aligned blocks of van Emde Boas layout.

A document's leaf is the SHA-256 of its columns.  The leaves of a group (a language),
in order of their ids, are combined eight by eight, level by level, to the
group's subroot; the subroots, in order of the groups, likewise to the root.

A tree is stored as blocks: aligned subtrees of up to ``HEIGHT`` levels of edges, each an
array of 32-byte digests.  Within a block the levels are split at half height, the
upper part is stored first and every lower part is one run after it, and so on
within the parts; ``addresses`` gives a node's place by arithmetic on its level and
number, for any size of cache.  A block is built from its leaves and read for its leaves'
siblings by these places.  The roots of blocks are the leaves of the blocks above:
``build`` and ``prove`` recurse over them, so a tree of n leaves takes log(n) / log(8 ** HEIGHT)
rounds, and no task holds more than a block of 4,096 leaves, however large a group is.

``prove`` gives each leaf its path: per level, the digests of its run before and after it,
as hex text.  ``folded`` recomputes the root from any leaf and a path.

Order in a group is by id, nulls first, then by leaf; repeated rows are leaves each.
A null group is a group of its own, before all others; groups are ordered by
their UTF-8 bytes.  Null, empty and very long texts are hashed as they are.
Other columns are carried if named, under names of their own.  No rows: no rows.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adeptus.llm.shared import written
from adeptus.operators.ingest import numbered

FANOUT, HEIGHT = 8, 4
SIZE = FANOUT ** HEIGHT

BLOCK = "gid bigint, block bigint, n bigint, height int, nodes binary, root string"
PATH = "array<struct<before: string, after: string>>"


# -------------------------------------------------------------------- blocks
def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


@cache
def addresses(levels: int) -> list[np.ndarray]:
    """Places of the nodes of each level, from the root down, in a block of van Emde Boas layout."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    below = addresses(levels - upper)
    out = list(addresses(upper))
    for depth, place in enumerate(below):
        part = np.arange(FANOUT ** (upper + depth))
        width = FANOUT ** depth                        # nodes of this level in one lower part
        out.append(nodes_of(upper) + part // width * nodes_of(levels - upper) + place[part % width])
    return out


def height_of(n: int) -> int:
    """Levels of edges above ``n`` leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


class Block:
    """An aligned subtree: ``nodes`` holds the digests in van Emde Boas layout, zeros where there is none."""

    def __init__(self, height: int, nodes: np.ndarray):
        self.height, self.nodes, self.at = height, nodes, addresses(height + 1)

    @classmethod
    def of(cls, leaves: list[str], height: int) -> Block:
        block = cls(height, np.zeros((nodes_of(height + 1), 32), np.uint8))
        level = leaves
        for depth in range(height, -1, -1):
            raw = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
            block.nodes[block.at[depth][:len(level)]] = raw
            if depth:
                level = [sha256("".join(level[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
        return block

    def run(self, depth: int, first: int) -> str:
        """Hex digests of the run of siblings of a level that begins with node ``first``."""
        own = self.nodes[self.at[depth][first:first + FANOUT]]
        return own[own.any(axis=1)].tobytes().hex()

    def root(self) -> str:
        return self.nodes[0].tobytes().hex()

    def paths(self, leaves: list[int]) -> list[list[tuple[str, str]]]:
        """(before, after) of every leaf's siblings, level by level upwards."""
        runs: dict[tuple[int, int], str] = {}
        out = []
        for leaf in leaves:
            path, i = [], leaf
            for depth in range(self.height, 0, -1):
                first = i - i % FANOUT
                if (depth, first) not in runs:
                    runs[depth, first] = self.run(depth, first)
                own = 64 * (i % FANOUT)
                path.append((runs[depth, first][:own], runs[depth, first][own + 64:]))
                i //= FANOUT
            out.append(path)
        return out


# --------------------------------------------------------------------- trees
def build(leaves: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up.

    ``leaves`` has (gid, pos, n, digest): group, place in it from 0, leaves of the group.
    A block holds (gid, block, n, height, nodes, root), ``n`` the leaves of its
    group on its own level; it is the group's last where ``n`` is at most ``SIZE``.
    """
    def construct(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        block = Block.of(table.column("digest").to_pylist(), HEIGHT if n > SIZE else height_of(n))
        return pa.table({"gid": table.column("gid").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "n": table.column("n").slice(0, 1), "height": pa.array([block.height], pa.int32()),
                         "nodes": [block.nodes.tobytes()], "root": [block.root()]})

    levels = []
    while True:
        dealt = leaves.select("gid", "pos", "n", "digest", F.floor(F.col("pos") / SIZE).alias("block"))
        levels.append(written(dealt.groupBy("gid", "block").applyInArrow(construct, BLOCK), "merkle"))
        more = levels[-1].filter(F.col("n") > SIZE)
        if more.isEmpty():
            return levels
        leaves = more.select("gid", F.col("block").alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"),
                             F.col("root").alias("digest"))


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(gid, subroot) of every group."""
    last = [x.filter(F.col("n") <= SIZE).select("gid", F.col("root").alias("subroot")) for x in levels]
    out = last[0]
    for x in last[1:]:
        out = out.unionAll(x)
    return out


def prove(levels: list[DataFrame], leaves: DataFrame, above: DataFrame) -> DataFrame:
    """``leaves`` (gid, pos, others) with ``path``, and with the other columns of ``above``.

    ``above`` has each group's (gid, path), the path from the group's root up, and other strings.
    """
    carried = [c for c in above.columns if c not in ("gid", "path")]
    path = None
    for level in reversed(range(len(levels))):
        blocks = levels[level].drop("root")
        ready = blocks.filter(F.col("n") <= SIZE).join(above, "gid").select("gid", "block", "height", "nodes", "path", *carried)
        if path is not None:
            ready = ready.unionByName(blocks.join(path.withColumnRenamed("pos", "block"), ["gid", "block"]).select(
                "gid", "block", "height", "nodes", "path", *carried))
        wanted = leaves if not level else levels[level - 1].filter(F.col("n") > SIZE).select("gid", F.col("block").alias("pos"))
        path = _siblings(ready, wanted, carried)
        if level:
            path = written(path, "merkle-paths")
    return path


def _siblings(blocks: DataFrame, wanted: DataFrame, carried: list[str]) -> DataFrame:
    """``wanted`` with the path of its leaf in its block, and on from there."""
    names = wanted.columns
    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in names)

    def read(rows: pa.Table, block: pa.Table) -> pa.Table:
        own = block.to_pylist()[:1]
        if not rows.num_rows or not own:
            rows = rows.slice(0, 0)
            own = [dict.fromkeys(["path", *carried])]
        own = own[0]
        found = []
        if rows.num_rows:
            tree = Block(own["height"], np.frombuffer(own["nodes"], np.uint8).reshape(-1, 32))
            found = [[{"before": a, "after": b} for a, b in path] + own["path"]
                     for path in tree.paths([p % SIZE for p in rows.column("pos").to_pylist()])]
        out = {c: rows.column(c) for c in names}
        out["path"] = pa.array(found, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table(out | {c: pa.array([own[c]] * rows.num_rows, pa.string()) for c in carried})

    dealt = wanted.withColumn("block", F.floor(F.col("pos") / SIZE))
    return dealt.groupBy("gid", "block").cogroup(blocks.groupBy("gid", "block")).applyInArrow(
        read, ", ".join([kinds, f"path {PATH}", *(f"{c} string" for c in carried)]))


# ------------------------------------------------------------------ manifest
def field(column: Column) -> Column:
    """``-`` for a null, else the UTF-8 bytes' number, ``:``, and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, columns)), "UTF-8"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.encode(F.concat(s["before"], own, s["after"]), "UTF-8"), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.encode(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), "UTF-8"), 256)


def manifest(docs: DataFrame, digest: Column, group_col: str = "lang", id_col: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path) of every row, and the columns ``carry``.

    ``digest`` is a row's leaf.  Leaves are numbered by ranges of (group, id, leaf), so
    neither a large group nor the whole table is sorted by one task.
    """
    carry = carry or {}
    rows = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), digest.alias("digest"),
                       *(c.alias(name) for name, c in carry.items()))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc()]
    rows = written(numbered(rows, order, "number"), "leaves")
    groups = rows.groupBy("grp").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    groups = written(numbered(groups, [F.col("grp").asc_nulls_first()], "gid"), "groups").withColumnRenamed("grp", "g")
    placed = rows.join(groups, F.col("grp").eqNullSafe(F.col("g"))).select(
        "gid", (F.col("number") - F.col("first")).alias("pos"), "n", "digest", "id", *carry)
    trees = build(placed)
    tops = subroots(trees)
    total = groups.count()
    crown = build(tops.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(total).cast("long").alias("n"),
                              F.col("subroot").alias("digest")))
    whole = subroots(crown).select("gid", F.array().cast(PATH).alias("path"), F.col("subroot").alias("root"))
    above = prove(crown, tops.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), "subroot"), whole)
    above = written(above.select(F.col("pos").alias("gid"), "path", "subroot", "root"), "merkle-top")
    return prove(trees, placed.drop("n"), above).select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *carry)
