"""Near-duplicate vectors by an inverted multi-index: two codebooks, a grid of cells, nearest cells first."""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import checkpointed, unit_hash
from tidemark.llm.components import components

COSINE = 0.95
SAMPLE = 8192
SAMPLE_BYTES = 16 << 20
QUERIES = 256
STEPS = 256
#: Vectors of a cell, and of a part of a larger cell: a vector is sent once per cell that it visits.
PART = 16_384
#: Vectors on a side of one product of cosines.
TILE = 1024
#: A reach below the sure bound is fitted only if so many of the sampled vectors have a link to another vector.
LEAST_LINKED = 64
#: Rows that a task sends on at once.
SENT = 20_000


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves by dimension, and how far (squared) beyond its own cell a vector must look."""
    books: dict[int, tuple[np.ndarray, np.ndarray]]
    reach: float


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = ((centers ** 2).sum(1)[None] - 2 * x @ centers.T).argmin(1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return np.unique(centers, axis=0)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension as rows of length 1, in double precision (scaled first, so that squares stay finite)."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bounds(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and the squared distance from the row to the border of each other code's region.

    Whatever lies in the region of code c is at least that far away, so the bounds of the two halves add up.
    """
    d = ((half[:, None, :] - book[None]) ** 2).sum(-1) if len(book) * half.size < 4e6 else np.maximum(0, (half ** 2).sum(1)[:, None] + (book ** 2).sum(1)[None] - 2 * half @ book.T)
    near = d.argmin(1)
    gap = np.sqrt(((book[:, None] - book[None]) ** 2).sum(-1))[near]
    gap[np.arange(len(half)), near] = 1.0
    border = np.maximum(0, d - d[np.arange(len(half)), near][:, None]) / (2 * gap)
    return near, border ** 2


def multi_sequence(one: np.ndarray, two: np.ndarray, reach: float) -> Iterator[tuple[int, int, float]]:
    """Cells (i, j) in the order of one[i] + two[j], from the nearest on, as far as `reach`."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap = [(float(one[a[0]] + two[b[0]]), 0, 0)]
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > reach:
            return
        yield int(a[i]), int(b[j]), far
        if j + 1 < len(b):
            heapq.heappush(heap, (float(one[a[i]] + two[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(one[a[i + 1]] + two[b[0]]), i + 1, 0))


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    column = batch.column(at)
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, unit_rows(column.take(pa.array(rows)), dim), dim


def _homes(index: Index, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row and the two tables of border bounds; a dimension without codebooks is one cell."""
    if dim not in index.books:
        return np.zeros(len(x), np.int64), np.zeros((len(x), 1)), np.zeros((len(x), 1))
    one, two = index.books[dim]
    a, first = _bounds(x[:, :dim // 2], one)
    b, second = _bounds(x[:, dim // 2:], two)
    return a * len(two) + b, first, second


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, total: int, target: float = 1.0, cosine: float = COSINE) -> Index:
    """Codebooks from about `SAMPLE` vectors, and how far the traversal goes to find the share `target` of the links.

    All links (target 1) need the bound that is sure to find them, the squared chord of the threshold; a sample cannot
    vouch for that. Cells then hold about `PART` vectors, since most cells near the home cell are visited. For a smaller
    target, `QUERIES` sampled vectors meet all others by brute force, in blocks. For each link between different
    vectors, the border bound at which the traversal finds it is counted in steps; the reach is the step at which the
    target is met, one step further, and never beyond the sure bound. It is the sure bound where fewer than
    `LEAST_LINKED` of the sampled vectors have a link.
    """
    sure = 2 - 2 * cosine + 1e-9
    widest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * widest)) / max(total, 1))
    sample = classes.where(unit_hash(F.col("cid"), 5) < share).select("cid", "embedding").toArrow().sort_by("cid")
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    k = int(min(256, max(4, round((total / PART) ** 0.5) if target >= 1 else 2 ** int(np.log2(max(total, 1) ** 0.5 / 4 + 1)))))
    for batch in sample.combine_chunks().to_batches():
        for _, x, dim in _by_dim(batch, 1):
            if dim > 1 and len(x) >= k:
                books[dim] = (_kmeans(x[:, :dim // 2], k), _kmeans(x[:, dim // 2:], k))
    index = Index(books, sure)
    if target >= 1:
        return index
    picked = classes.where(unit_hash(F.col("cid"), 9) < min(1.0, QUERIES / max(total, 1))).select("cid", "embedding").toArrow().sort_by("cid")
    asked = {dim: (batch.column(0).to_numpy()[rows], x) for batch in picked.combine_chunks().to_batches() for rows, x, dim in _by_dim(batch, 1)}

    def found_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids = batch.column(0).to_numpy()
            for rows, x, dim in _by_dim(batch, 1):
                if dim in asked and dim in books:
                    q_cid, q = asked[dim]
                    cell, one, two = _homes(index, x, dim)
                    q_cell, q_one, q_two = _homes(index, q, dim)
                    i, j = np.nonzero((x @ q.T >= cosine) & (cids[rows][:, None] != q_cid[None]))
                    width = two.shape[1]
                    ours = cell[i] < q_cell[j]  # the vector of the smaller cell visits
                    bound = np.where(ours, one[i, q_cell[j] // width] + two[i, q_cell[j] % width], q_one[j, cell[i] // width] + q_two[j, cell[i] % width])
                    step = np.minimum(STEPS, np.ceil(bound / sure * STEPS)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(q_cid[j]), pa.array(step)], names=["cid", "step"])

    got = classes.select("cid", "embedding").mapInArrow(found_at, "cid long, step long").groupBy("cid", "step").count().collect()
    if len({r["cid"] for r in got}) < LEAST_LINKED:
        return index
    n = np.bincount([r["step"] for r in got], weights=[r["count"] for r in got], minlength=STEPS + 1)
    need = int(np.searchsorted(np.cumsum(n), target * n.sum()))
    return Index(books, sure * min(STEPS, need + 1) / STEPS)


def _visits(index: Index):
    names = ["cell", "guest", "cid", "n", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x, dim in _by_dim(batch, 2):
                cell, one, two = _homes(index, x, dim)
                width = two.shape[1]
                row, to, guest = [], [], []

                def sent() -> pa.RecordBatch:
                    picked = pa.array(rows[row])
                    out = pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(guest, pa.int32()), *(batch.column(c).take(picked) for c in range(3))], names=names)
                    for x in (row, to, guest):
                        x.clear()
                    return out

                for r, home in enumerate(cell.tolist()):
                    row.append(r)
                    to.append((dim << 20) + home)
                    guest.append(0)
                    for i, j, _ in multi_sequence(one[r], two[r], index.reach):
                        if i * width + j > home:
                            row.append(r)
                            to.append((dim << 20) + i * width + j)
                            guest.append(1)
                    if len(row) >= SENT:
                        yield sent()
                if row:
                    yield sent()

    return run


def _meet(cosine: float):
    """Rows sorted by unit -> links counted per class, and one class that stands for its linked ones in the unit."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        side, cid, n = (table[c].to_numpy() for c in ("side", "cid", "n"))
        column = table["embedding"].combine_chunks()
        x = unit_rows(column, len(column[0]))
        a, b = np.flatnonzero(side % 2 == 0), np.flatnonzero(side % 2 == 1)
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        near = []

        def linked(rows: np.ndarray, cols: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
            return rows[r], cols[c], mask[np.ix_(r, c)]

        if len(a) > 1 and (side == 0).any():  # among themselves
            mask = x[a] @ x[a].T >= cosine
            np.fill_diagonal(mask, False)
            rows, cols, mask = linked(a, a, mask)
            links[rows] += mask @ n[cols]
            near.append((rows, cols, mask))
        if len(a) and len(b):
            mask = x[a] @ x[b].T >= cosine
            rows, cols, mask = linked(a, b, mask)
            links[rows] += mask @ n[cols]
            links[cols] += mask.T @ n[rows]
            near.append((rows, cols, mask))
        near = [x for x in near if x[2].size]
        while True:
            before = label.copy()
            for rows, cols, mask in near:
                least = np.where(mask, label[cols][None], len(x)).min(axis=1)
                label[rows] = np.minimum(label[rows], least)
                label[cols] = np.minimum(label[cols], np.where(mask, label[rows][:, None], len(x)).min(axis=0))
            if (label == before).all():
                break
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(cid[keep]), pa.array(links[keep]), pa.array(cid[label[keep]])], names=["cid", "links", "to"])

    def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """A unit's sides meet tile by tile, so that neither cosines nor links of a whole unit are held."""
        side = table["side"].to_numpy()
        a, b = ([table.take(pa.array(rows[lo:lo + TILE])) for lo in range(0, len(rows), TILE)] for rows in (np.flatnonzero(side % 2 == 0), np.flatnonzero(side % 2 == 1)))
        if len(a) <= 1 and len(b) <= 1:
            yield solve(table)
            return

        def as_side(part: pa.Table, k: int) -> pa.Table:
            return part.set_column(part.column_names.index("side"), "side", pa.array(np.full(part.num_rows, k, np.int32)))

        for i, one in enumerate(a):
            if (side == 0).any():
                yield solve(as_side(one, 0))
                for two in a[i + 1:]:
                    yield solve(pa.concat_tables([as_side(one, 2), as_side(two, 3)]))
            for two in b:
                yield solve(pa.concat_tables([as_side(one, 2), as_side(two, 3)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            unit = rest["unit"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    yield from tiles(rest.slice(lo, hi - lo))
            rest = rest.slice(int(cuts[-1]))
        if rest is not None and rest.num_rows > 1:
            yield from tiles(rest)

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, target: float = 1.0, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; neither do vectors of unequal
    dimension. Equal vectors are one class, linked with each other and counted, not paired. Classes live in the cell of
    their two nearest codes; a class visits cells beyond its own, nearest first, up to the index's reach, and every
    cell that two classes share computes their cosine in double precision, in tiles of `TILE`. Of two cells only the smaller one's classes
    visit, so no pair meets twice. Cells of more than `part` classes are dealt out as pairs of parts. Tasks send on
    link counts and a representative, never pairs. Null ids stay null and are no smallest id; repeated ids are rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    ok = valid(F.col("embedding"))
    keys = {"k1": F.when(ok, F.xxhash64("embedding")), "k2": F.when(ok, F.xxhash64(F.lit(1), "embedding"))}
    classes = rows.where(ok).withColumns(keys).groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    index = fit(classes, classes.count(), target, cosine)
    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("cid", "n", "embedding").mapInArrow(_visits(index), f"cell long, guest int, cid long, n long, embedding {kind}")
    counts = placed.groupBy("cell").agg(F.sum(1 - F.col("guest")).alias("homes"), F.sum("guest").alias("guests")).where("homes + guests > 1 and homes > 0")
    dealt = placed.join(counts, "cell")
    h, g = F.greatest(F.lit(1), F.ceil(F.col("homes") / part)).cast("int"), F.ceil(F.col("guests") / part).cast("int")
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("guest") == 0, h).otherwise(F.greatest(g, F.lit(1)))).cast("int")
    small = (h == 1) & (g <= 1)

    def unit(p: Column, q: Column, kind: int, side: Column) -> Column:
        return F.struct(F.when(small, F.col("cell")).otherwise(F.xxhash64("cell", p, q, F.lit(kind))).alias("unit"), side.cast("int").alias("side"))

    among = F.transform(F.sequence(F.lit(0), h - 1), lambda o: unit(F.least(F.col("mine"), o), F.greatest(F.col("mine"), o), 0, F.when(F.col("mine") > o, 3).when(F.col("mine") < o, 2).otherwise(0)))
    hosts = F.when(small | (g == 0), F.array().cast("array<struct<unit:bigint,side:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(g, F.lit(1)) - 1), lambda o: unit(F.col("mine"), o, 1, F.lit(2))))
    guests = F.transform(F.sequence(F.lit(0), h - 1), lambda o: unit(o, F.col("mine"), 1, F.lit(3)))
    units = F.explode(F.when(F.col("guest") == 0, F.concat(among, hosts)).otherwise(guests))
    dealt = dealt.withColumn("mine", mine).select(units.alias("u"), "cid", "n", "embedding").select("u.unit", "u.side", "cid", "n", "embedding")
    met = checkpointed(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(_meet(cosine), "cid long, links long, to long"))
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(met.select("cid", "to"))
    named = classes.select("cid", "k1", "k2", "least", "n").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.withColumns(keys).select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
