"""A Merkle manifest of a table: ternary hash trees per group, stored in blocks of van Emde Boas layout."""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.llm.common import checkpointed, fresh
from tidemark.plans.ordered import row_index

ARITY = 3
#: Levels of a block: its tree has at most 3^7 = 2,187 leaves and 3,280 nodes of 32 bytes.
LEVELS = 7
PROOF = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def proof_hash(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def nodes_of(height: int) -> int:
    """Nodes of a complete tree with `height` levels below its root."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` (from 0, left to right) at `depth` in the van Emde Boas layout.

    The levels are split at half height: the upper tree lies first, the lower trees follow from left to right, and each
    of them is laid out the same way. Whatever the size of a cache line, a path crosses few of them.
    """
    if height == 0:
        return np.zeros(len(index), np.int64)
    above = (height + 1) // 2  # levels of the upper tree
    if depth < above:
        return address(above - 1, depth, index)
    width = ARITY ** (depth - above)
    lower = height - above
    return nodes_of(above - 1) + (index // width) * nodes_of(lower) + address(lower, depth - above, index % width)


@functools.lru_cache(maxsize=32)
def layout(height: int) -> tuple[np.ndarray, ...]:
    return tuple(address(height, d, np.arange(ARITY ** d)) for d in range(height + 1))


def height_of(n: int) -> int:
    """Levels until one node is left of `n`, three becoming one."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def build(leaves: list[str], height: int) -> bytes:
    """Hex leaves -> digests of their tree of `height` levels, in van Emde Boas layout; places without a node are zero."""
    at, tree = layout(height), bytearray(32 * nodes_of(height))
    level = leaves
    for depth in range(height, -1, -1):
        for place, node in zip(at[depth].tolist(), level):
            tree[32 * place:32 * place + 32] = bytes.fromhex(node)
        if depth:
            level = [hashlib.sha256("".join(level[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(level), ARITY)]
    return bytes(tree)


def siblings(tree: bytes, height: int, n: int) -> tuple[list[str], list[str], np.ndarray]:
    """Siblings on the left and on the right of each node below the root, and for each of `n` leaves its path in them.

    All siblings are read at their computed addresses, level by level from the leaves up.
    """
    before, after, path = [], [], np.zeros((n, height), np.int64)
    leaf, count = np.arange(n), n
    for up, depth in enumerate(range(height, 0, -1)):
        places = layout(height)[depth][:count]
        level = [tree[32 * p:32 * p + 32].hex() for p in places.tolist()]
        path[:, up] = len(before) + leaf // ARITY ** up
        for i in range(count):
            run = i - i % ARITY
            before.append("".join(level[run:i]))
            after.append("".join(level[i + 1:run + ARITY]))
        count = -(-count // ARITY)
    return before, after, path


def _height(levels: int, block: int, nodes: int) -> int:
    """Only the first block of a group can be lower than the others: if it is the only one and not full."""
    return levels if block else min(levels, height_of(nodes))


def _plant(levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The nodes of one block -> its tree."""
        nodes, block = table.sort_by("pos")["node"].to_pylist(), key[1].as_py()
        tree = build(nodes, _height(levels, block, len(nodes)))
        return pa.table({"g": [key[0].as_py()], "block": [block], "tree": [tree], "root": [tree[:32].hex()]}, schema=pa.schema([("g", pa.string()), ("block", pa.int64()), ("tree", pa.binary()), ("root", pa.string())]))

    return run


def _read(levels: int, names: Sequence[str], more: Sequence[str]):
    def run(key: tuple, nodes: pa.Table, block: pa.Table) -> pa.Table:
        """The nodes of one block, each with its siblings in the block and those of the block's root above it."""
        nodes = nodes.sort_by("pos")
        n = nodes.num_rows
        before, after, path = siblings(block["tree"][0].as_py(), _height(levels, key[1].as_py(), n), n)
        upper = block["proof"][0].as_py()
        path = np.hstack((path, np.broadcast_to(len(before) + np.arange(len(upper)), (n, len(upper)))))
        before += [s["before"] for s in upper]
        after += [s["after"] for s in upper]
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"]).take(pa.array(path.ravel()))
        out = nodes.select(names).append_column("proof", pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * path.shape[1]), steps))
        for name in more:
            out = out.append_column(name, pa.array([block[name][0].as_py()] * n, pa.string()))
        return out

    return run


class Forest:
    """Trees of all groups of `nodes` (g, pos from 0 on, node), in tiers of blocks.

    A tier cuts the nodes of each group into aligned blocks of 3^levels; the roots of its blocks are the nodes of the
    next tier, until each group has one root. `nodes` is read once here and once by `proofs`. Rows are always dealt
    by group and block, so a hot group is spread over all tasks.
    """

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.levels, self.tiers = levels, []
        while True:
            blocks = checkpointed(self._dealt(nodes).select("g", "block", "pos", "node").groupBy("g", "block").applyInArrow(_plant(levels), "g string, block long, tree binary, root string"))
            slim = blocks.select("g", "block", "root").join(blocks.groupBy("g").agg(F.max("block").alias("last")), "g")  # trees stay where they are
            self.tiers.append((blocks.select("g", "block", "tree"), slim))
            if not blocks.agg(F.max("block")).first()[0]:
                break
            nodes = slim.where("last > 0").select("g", F.col("block").alias("pos"), F.col("root").alias("node"))  # a group of one block has its root

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("pos") / ARITY ** self.levels).cast("long")).repartition("g", "block")

    def roots(self) -> DataFrame:
        """(g, root) of all groups."""
        return functools.reduce(DataFrame.unionByName, [slim.where("last = 0").select("g", "root") for _, slim in self.tiers])

    def proofs(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """`nodes` with `proof`, its siblings up to the group's root and from there on those of `above` (g, proof), and
        with the further text columns of `above`."""
        more = [c for c in above.columns if c not in ("g", "proof")]
        upper = None
        for k in range(len(self.tiers) - 1, -1, -1):
            trees, slim = self.tiers[k]
            tops = slim.where("last = 0").select("g", "block").join(above, "g").select("g", "block", "proof", *more)
            tops = trees.join(tops if upper is None else tops.unionByName(upper), ["g", "block"])
            if k:  # the nodes of a tier are the blocks of the one below
                own = self.tiers[k - 1][1].where("last > 0").select("g", F.col("block").alias("pos"))
                upper = checkpointed(self._joined(own, tops, more).select("g", F.col("pos").alias("block"), "proof", *more))
        return self._joined(nodes, tops, more)

    def _joined(self, nodes: DataFrame, tops: DataFrame, more: Sequence[str]) -> DataFrame:
        schema = StructType([*nodes.schema.fields, StructField("proof", PROOF), *[StructField(c, StringType()) for c in more]])
        left = self._dealt(nodes).groupBy("g", "block")
        return left.cogroup(tops.repartition("g", "block").groupBy("g", "block")).applyInArrow(_read(self.levels, nodes.columns, more), schema)


def manifest(leaves: DataFrame, leaf: str = "leaf", group: str = "source", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """All columns of `leaves` and subroot, root, proof (array of before, after: the siblings on both sides, level by level).

    Every row is a leaf, repeated rows too. Per group (null is one, and the first; names by their UTF-8 bytes) leaves
    ascend by `order` (null first), then by their hash. While several nodes are left, every three become the SHA-256 of
    their hex digests; the last run may hold fewer, even one. The groups' roots, in order, likewise lead to the root; a
    lone leaf or root stays itself. An empty table has an empty manifest. Names that are taken are lengthened by `_`.

    Leaves get exact positions by a range sort, so a hot group is spread over all tasks; a task holds one block.
    """
    names = []
    for name in ("subroot", "root", "proof"):
        names.append(fresh(leaves, name))
    own = [f"c{i}" for i in range(len(leaves.columns))]
    plain = leaves.toDF(*own)
    of = dict(zip(leaves.columns, own))
    g = F.coalesce(F.concat(F.lit("1"), F.col(of[group]).cast("string")), F.lit("0"))
    nodes = row_index(plain.withColumn("g", g), ["g"], [of[order], of[leaf]], "pos", split=True).withColumn("node", F.col(of[leaf]))
    forest = Forest(nodes, levels)
    subroots = checkpointed(forest.roots())
    top = row_index(subroots.withColumn("all", F.lit("0")), ["all"], ["g"], "pos", split=True).select(F.lit("0").alias("g"), "pos", F.col("root").alias("node"), F.col("g").alias("name"))
    crown = Forest(top, levels)
    root = crown.roots().select("g", F.from_json(F.lit("[]"), PROOF).alias("proof"), "root")  # one row
    ends = checkpointed(crown.proofs(top, root).select(F.col("name").alias("g"), "proof", F.col("node").alias("subroot"), "root"))
    return forest.proofs(nodes.select("g", "pos", *own), ends).select(*own, "subroot", "root", "proof").toDF(*leaves.columns, *names)
