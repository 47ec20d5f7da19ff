"""SimHash fingerprints and their near-duplicate groups by a self-join of binary tries."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import buffers, checkpointed, fresh
from tidemark.llm.components import components

BUDGET = 4
SHINGLE = 4
SEED = 42
#: 64 bits in six blocks: four differing bits leave two whole blocks equal, so 15 pairs of blocks meet every link.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
HOT = 2000
_FRONTIER = 400_000


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set where more than half of the shingles' XXH64 values have it; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    if n == 1:
        return h(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[width - 1:] - 1).tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        part = hashes[lo:lo + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint_bits", width: int = SHINGLE) -> DataFrame:
    """All columns of `docs` plus the fingerprint as a signed long under `name`."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(text))
            raw = memoryview(data)
            bits = np.fromiter((fingerprint(bytes(raw[a:b]), width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(key: np.ndarray, side: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) with equal `key` and at most `budget` differing bits.

    Rows of one key are the leaves of one binary trie, held as a sorted array: a node is a range of rows with a common
    prefix. Pairs of nodes go down together, one bit a step; a pair of unequal branches costs one error and a pair past
    the budget is dropped. Two single rows are compared at once. `side` says who meets whom: 0 with 0 and 0 with 1
    where a key has 1s, then never 1 with 1 (the two halves of a split group).
    """
    order = np.lexsort((bits, side, key))
    key, side, bits = key[order], side[order], bits[order]
    n = len(bits)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (side[1:] != side[:-1]))))
    stop = np.append(node[1:], n)
    cross = np.flatnonzero((key[node][:-1] == key[node][1:])) if len(node) > 1 else np.zeros(0, np.int64)
    split = np.zeros(len(node), bool)
    split[cross] = split[cross + 1] = True
    own = np.flatnonzero(~split & (stop - node > 1))
    stack = [(np.concatenate((node[own], node[cross])), np.concatenate((stop[own], stop[cross])),
              np.concatenate((node[own], node[cross + 1])), np.concatenate((stop[own], stop[cross + 1])),
              np.zeros(len(own) + len(cross), np.int64), 0)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        alo, ahi, blo, bhi, errs, depth = stack.pop()
        if len(alo) > _FRONTIER:
            for lo in range(0, len(alo), _FRONTIER):
                cut = slice(lo, lo + _FRONTIER)
                stack.append((alo[cut], ahi[cut], blo[cut], bhi[cut], errs[cut], depth))
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (a != b) & (_popcount(bits[a] ^ bits[b]) <= budget)
            found.append((a[near], b[near]))
            alo, ahi, blo, bhi, errs = (x[~leaf] for x in (alo, ahi, blo, bhi, errs))
        if not len(alo):
            continue
        if depth == 64:  # equal rows met as whole nodes: each is joined to the first of the other side
            size = np.maximum(ahi - alo, bhi - blo)
            which = np.repeat(np.arange(len(alo)), size)
            step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            a, b = np.minimum(alo[which] + step, ahi[which] - 1), blo[which]
            a2, b2 = alo[which], np.minimum(blo[which] + step, bhi[which] - 1)
            found.append((np.concatenate((a, a2)), np.concatenate((b, b2))))
            continue
        amid, bmid = _middle(bits, alo, ahi, depth), _middle(bits, blo, bhi, depth)
        same = alo == blo
        kids = [(alo, amid, blo, bmid, errs, None), (amid, ahi, bmid, bhi, errs, None), (alo, amid, bmid, bhi, errs + 1, None), (amid, ahi, blo, bmid, errs + 1, ~same)]
        parts = []
        for a0, a1, b0, b1, e, keep in kids:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget) & ((a0 != b0) | (a1 - a0 > 1))
            if keep is not None:
                ok &= keep
            parts.append(tuple(x[ok] for x in (a0, a1, b0, b1, e)))
        stack.append((*(np.concatenate([p[i] for p in parts]) for i in range(5)), depth + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([f[i] for f in found]) for i in range(2))
    return order[a], order[b]


def _middle(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First row of each range whose bit number `depth` from the top is 1, by bisection."""
    mask = np.uint64(1) << np.uint64(63 - depth)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (bits[np.minimum(mid, len(bits) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of index pairs by union-find: no other pairs need leave the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]


def _join_tries(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            key, side = table["key"].to_numpy(), table["side"].to_numpy()
            bits = table["fp"].to_numpy().view(np.uint64)
            a, b = _forest(*trie_pairs(key, side, bits, budget))
            return pa.RecordBatch.from_arrays([pa.array(bits[a].view(np.int64)), pa.array(bits[b].view(np.int64))], names=["u", "v"])

        rest = None  # rows arrive sorted by key: the last key of a batch waits for the next one
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = table.slice(cut)
            if cut:
                yield solve(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def links(points: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints `fp` (long) -> edges (u, v) that connect all pairs within `budget` <= 4 differing bits.

    Each fingerprint goes to 15 tries, one per pair of 10- or 11-bit blocks that a link must share. Groups of more
    than `hot` fingerprints are dealt out as pairs of parts, each part meeting every other once, so that no task holds
    a group whole. A task sends on a spanning forest of the links it finds, not the links.
    """
    if not 0 <= budget <= 4:
        raise ValueError("two clean blocks of six are sure for budgets up to 4 only")
    fp = F.col("fp")

    def block(i: int):
        at, width = BLOCKS[i]
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*[F.lit(k << 22) + F.shiftleft(block(i), 11) + block(j) for k, (i, j) in enumerate(PAIRS)])
    rows = points.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").count().where(F.col("count") > 1)
    rows = rows.join(sizes, "key")
    parts = F.ceil(F.col("count") / hot).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts)
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = rows.select("key", "fp", mine.alias("mine"), other.alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    cell = F.when((low == 0) & (high == 0), F.col("key")).otherwise(F.xxhash64("key", low, high))
    dealt = dealt.select(cell.alias("key"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_join_tries(budget), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Texts that are null or hold no word have fingerprint zero and link like any other. Repeated rows and equal
    fingerprints collapse before any join. Rows with a null id keep it; they link others but are no smallest id, and a
    component of null ids only has a null component_id. Columns other than the two named are not looked at.
    """
    prints = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp").select("doc_id", "fp")
    prints = checkpointed(prints)  # one pass over the texts, whatever reads the fingerprints
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select("fp"), budget))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """One row of each group of near-equal fingerprints, with all its columns.

    The row with the smallest id stays (null ids come last); of rows that share it, texts equal or not, the one with the
    least hash of all columns, so that reruns agree. An empty table stays empty.
    """
    one, two = fresh(docs, "one"), fresh(docs, "two")
    cells = [F.col(f"`{c}`") for c in docs.columns]
    parts = [*cells, *[c.isNull() for c in cells]]
    named = docs.withColumns({one: F.xxhash64(F.lit(1), *parts), two: F.xxhash64(F.lit(2), *parts)})
    rows = named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(one).alias("one"), F.col(two).alias("two"))
    prints = checkpointed(with_fingerprints(rows, "text", "fp", width).select("doc_id", "one", "two", "fp"))
    roots = components(links(prints.select("fp").distinct(), budget))
    chosen = prints.join(roots, prints.fp == roots.node, "left").groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "one", "two")).alias("least"))
    chosen = chosen.select(F.col("least.one").alias(one), F.col("least.two").alias(two))
    return named.join(chosen, [one, two], "left_semi").dropDuplicates([one, two]).drop(one, two)
