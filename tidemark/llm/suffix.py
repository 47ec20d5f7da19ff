"""Removal of byte strings that repeat, by hash-compared sorts of suffixes."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import buffers, checkpointed, fresh, pieces
from tidemark.llm.hashing import BASE, INVERSE, gram_hash, mixed, powers, prefix_hash, span_hash

LENGTH = 400
GRAM = 64
#: Anchors with more different regions than the first are split by the bytes that blocks of their windows share, and
#: with more than the second by window.
HOT, HUGE = 256, 65_536
BLOCK = 64
#: A round of sorting ends at this many window starts or bytes of regions, whichever comes first.
_CHUNK, _CHUNK_BYTES = 150_000, 1_000_000
_PIECE = 300_000


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256: copies of a text share one key, in every run and on every executor."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Each window of `length` bytes is owned by the leftmost least hash of its `gram`-byte strings.

    The owner depends on the window's bytes alone, so equal windows have equal owners at equal offsets. Returns, per
    run of windows with one owner inside one text: text, first and last start, owner's place, owner's hash.
    """
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    long = np.flatnonzero(np.diff(at) >= length)
    if n < length or not len(long):
        return none
    h = mixed(gram_hash(prefix_hash(data), gram))
    low = np.uint64((1 << max(20, int(n).bit_length())) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    rows = -(-len(ranked) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[:len(ranked)] = ranked
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(ranked) - w + 1
    owner = (np.minimum(behind[:starts], ahead[w - 1:w - 1 + starts]) & low).astype(np.int64)
    first, past = at[long], at[long + 1] - length + 1
    cut = np.unique(np.concatenate((np.flatnonzero(owner[1:] != owner[:-1]) + 1, first, past[past < starts])))
    which = np.searchsorted(first, cut, side="right") - 1
    ok = (which >= 0) & (cut < past[np.maximum(which, 0)])
    end = np.append(cut[1:], starts)
    cut, end, which = cut[ok], end[ok], which[ok]
    place = owner[cut]
    return long[which], cut, end - 1, place, h[place]


def _anchor_rows(length: int):
    names = ["anchor", "f1", "key", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            for lo, hi in pieces(at, _PIECE):
                part, sub = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                text, first, last, place, h = anchors(part, sub, length)
                if not len(text):
                    continue
                raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                same = np.fromiter((digest(raw[a:b], s) for a, b, s in zip(first.tolist(), (last + length).tolist(), (place - first).tolist())), np.uint64, len(first))
                span = (place - sub[text]) << 20 | (place - last) << 10 | (place - first)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(same.view(np.int64)), batch.column(0).take(pa.array(text + lo)), pa.array(span)], names=names)

    return run


class Suffixes:
    """Suffixes of a buffer, compared by prefix hashes: equal hashes mean equal bytes until a check says otherwise.

    Exponents start anew where a region does (`base`), so that the tables of powers stay as short as a region."""

    def __init__(self, data: np.ndarray, length: int = LENGTH, base: np.ndarray | None = None):
        self.data, self.length = data, length
        base = np.zeros(1, np.int64) if base is None else base
        size = np.diff(np.append(base, len(data)))
        self.local = np.arange(len(data), dtype=np.int32) - np.repeat(base, size).astype(np.int32)
        longest = int(size.max()) if len(size) else 0
        self.inverse = powers(INVERSE, longest + 1)
        terms = powers(BASE, longest + 1)[self.local]
        terms *= data.astype(np.uint64) + np.uint64(1)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, out=terms)))

    def equal(self, i: np.ndarray, j: np.ndarray, size) -> np.ndarray:
        p = self.prefix
        return (p[i + size] - p[i]) * self.inverse[self.local[i]] == (p[j + size] - p[j]) * self.inverse[self.local[j]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to `length`, by binary search on the prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.length, np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.equal(i, j, mid)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def below(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix i stands before suffix j; equal ones as `ties` says."""
        out = ties.copy()
        differ = np.flatnonzero(~self.equal(i, j, self.length))
        if len(differ):
            a, b = i[differ], j[differ]
            n = self.common(a, b)
            out[differ] = self.data[a + n] < self.data[b + n]
        return out

    def sort(self, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes `place` inside each run of equal `group` (already side by side): a bottom-up mergesort.

        In a round, each suffix finds its rank in the neighbouring run by binary search; all runs of all groups do so
        at once.
        """
        n = len(place)
        order = np.arange(n)
        head = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        stop = np.append(np.flatnonzero(head)[1:], n)[np.cumsum(head) - 1]
        q, width = np.arange(n) - start, 1
        while n and width < int((stop - start).max()):
            run = q // width
            lo = np.minimum(start + (run ^ 1) * width, stop)
            hi = np.minimum(lo + width, stop)
            base, right = lo.copy(), (run & 1) == 1
            mine = place[order]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                up = self.below(mine[mid], mine[open_], right[open_])  # a tie counts for the right run only
                lo[open_] = np.where(up, mid + 1, lo[open_])
                hi[open_] = np.where(up, hi[open_], mid)
            target = start + (run >> 1) * 2 * width + (q - run * width) + (lo - base)
            moved = np.empty(n, np.int64)
            moved[target] = order
            order, width = moved, width * 2
        return order


def repeated_starts(regions: list[bytes], group: np.ndarray, before: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(region, first, last) runs of window starts in a region whose windows also stand in another region of its group.

    Region r has `count[r]` starts, its anchor `before[r]` bytes after the first. Windows can only be equal at equal
    distances from the anchor, so suffixes are bucketed by (group, distance), sorted by hash-compared mergesort, and
    neighbours with a common extension of `length` repeat. The bytes of each run of such neighbours are then compared;
    where a hash has lied, the group is done over with the bytes themselves.
    """
    data = np.frombuffer(b"".join(regions), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(r) for r in regions])[:-1])).astype(np.int64)
    region = np.repeat(np.arange(len(regions)), count)
    step = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
    bucket = group[region] << 10 | (before[region] - step)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    same = np.concatenate(([False], bucket[1:] == bucket[:-1], [False]))
    order = order[same[1:] | same[:-1]]
    if not len(order):
        return []
    region, step = region[order], step[order]
    bucket, place = group[region] << 10 | (before[region] - step), base[region] + step
    suffixes = Suffixes(data, length, base)
    sorted_ = suffixes.sort(place, bucket)
    region, step, place, bucket = region[sorted_], step[sorted_], place[sorted_], bucket[sorted_]
    pair = np.flatnonzero((bucket[1:] == bucket[:-1]) & suffixes.equal(place[:-1], place[1:], length))
    a, b, at = region[pair], region[pair + 1], step[pair]
    by = np.lexsort((at, b, a))
    a, b, at, other, pair = a[by], b[by], at[by], step[pair + 1][by], pair[by]
    cuts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (at[1:] != at[:-1] + 1)))) if len(a) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(a)) - 1 if len(a) else cuts
    wrong = set()
    for i, j in zip(cuts.tolist(), ends.tolist()):
        x, y, size = at[i], other[i], at[j] - at[i] + length
        if regions[a[i]][x:x + size] != regions[b[i]][y:y + size]:
            wrong.add(int(group[a[i]]))
    found = np.unique(np.concatenate((region[pair] << 32 | step[pair], region[pair + 1] << 32 | step[pair + 1])))
    if wrong:
        found = found[~np.isin(group[found >> 32], list(wrong))]
        found = np.unique(np.concatenate((found, _by_bytes(regions, group, before, count, wrong, length))))
    if not len(found):
        return []
    cut = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1] + 1)))
    end = np.append(cut[1:], len(found)) - 1
    mask = (1 << 32) - 1
    return list(zip((found[cut] >> 32).tolist(), (found[cut] & mask).tolist(), (found[end] & mask).tolist()))


def _by_bytes(regions, group, before, count, wrong: set[int], length: int) -> np.ndarray:
    seen: dict[tuple, list[int]] = {}
    for r in np.flatnonzero(np.isin(group, list(wrong))).tolist():
        for s in range(int(count[r])):
            seen.setdefault((int(group[r]), int(before[r]) - s, regions[r][s:s + length]), []).append(r << 32 | s)
    return np.array([x for v in seen.values() if len(v) > 1 for x in v], np.int64)


def _blocks(raw: bytes, anchor: int, off: int, a0: int, a1: int, length: int) -> Iterator[tuple[int, int, int]]:
    """A region's windows by blocks of distance from the anchor: (group, first and last distance). All windows of a
    block hold the bytes between its outermost ones, so equal windows have equal groups."""
    for b in range(a0 // BLOCK, a1 // BLOCK + 1):
        core = raw[off - b * BLOCK:off - (b + 1) * BLOCK + 1 + length]
        group = xxhash.xxh3_64_intdigest(core, (anchor + b) & 0xFFFFFFFFFFFFFFFF)
        yield group - (1 << 64) if group >> 63 else group, max(a0, b * BLOCK), min(a1, (b + 1) * BLOCK - 1)


def _regions(at_text: int, at_list: int, length: int):
    """Texts with the spans asked of them -> the regions of bytes that hold the spans' windows, once per text."""
    names = ["anchor", "f1", "key", "span", "region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            key = batch.schema.get_field_index("text_key_")
            for i in range(batch.num_rows):
                k = batch.column(key)[i].as_py()
                if k == last:  # copies of a text are side by side
                    continue
                last = k
                raw = (batch.column(at_text)[i].as_py() or "").encode()
                for x in batch.column(at_list)[i].as_py():
                    off, a0, a1 = x["span"] >> 20, x["span"] >> 10 & 1023, x["span"] & 1023
                    for group, lo, hi in _blocks(raw, x["anchor"], off, a0, a1, length) if x["split"] else [(x["anchor"], a0, a1)]:
                        for c, v in zip(out, (group, x["f1"], k, off << 20 | lo << 10 | hi, raw[off - hi:off - lo + length])):
                            c.append(v)
                if len(out[0]) >= 2000:
                    yield _region_batch(out, names)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _region_batch(out, names)

    return run


def _region_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


def _sort_regions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor -> repeated starts; whole anchors are gathered until there is work for a round."""
        held: list[tuple] = []
        starts, size, seen = 0, 0, None

        def solve() -> pa.RecordBatch:
            group = np.cumsum([0] + [int(x[0] != y[0]) for x, y in zip(held[1:], held)]).astype(np.int64)
            span = np.array([x[3] for x in held], np.int64)
            before = span & 1023
            found = repeated_starts([x[4] for x in held], group, before, before - (span >> 10 & 1023) + 1, length)
            zero = (span >> 20) - before
            return pa.RecordBatch.from_arrays([pa.array([held[r][2] for r, _, _ in found], pa.binary()), pa.array([int(zero[r]) + a for r, a, _ in found], pa.int64()),
                                               pa.array([int(zero[r]) + b for r, _, b in found], pa.int64())], names=["key", "lo", "hi"])

        for batch in batches:
            for row in (r for lo in range(0, batch.num_rows, 1024) for r in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns))):
                if held and row[0] != held[-1][0] and (starts >= _CHUNK or size >= _CHUNK_BYTES):
                    yield solve()
                    held, starts, size = [], 0, 0
                if (row[0], row[1]) == seen:  # a region sent twice
                    continue
                seen = (row[0], row[1])
                held.append(row)
                starts += (row[3] & 1023) - (row[3] >> 10 & 1023) + 1
                size += len(row[4])
        if held:
            yield solve()

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions of huge anchors -> two hashes of each window, with its start in the text."""
        rng = np.random.default_rng(17)
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(4)[i].as_py(), np.uint8)
                span = batch.column(3)[i].as_py()
                n = len(raw) - length + 1
                second = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[raw] * powers(BASE, len(raw)))))
                one, two = (gram_hash(s, length)[:n] if n <= len(s) - length - 1 else span_hash(s, np.arange(n), np.arange(n) + length) for s in (prefix_hash(raw), second))
                yield pa.RecordBatch.from_arrays([pa.array(mixed(one).view(np.int64)), pa.array(mixed(two).view(np.int64)), pa.array([batch.column(2)[i].as_py()] * n, pa.binary()),
                                                  pa.array((span >> 20) - (span & 1023) + np.arange(n))], names=["w1", "w2", "key", "lo"])

    return run


def repeated_windows(docs: DataFrame, text: str, key: str, hot: int = HOT, huge: int = HUGE, length: int = LENGTH) -> DataFrame:
    """(key, spans): for each text with one, the runs (lo, hi) of starts of windows that also start elsewhere.

    `key` is a column of `docs` made by `text_key`. Windows owned by one anchor form a region of under twice their length.
    Only anchors that stand twice go on; regions with the same anchor and bytes (two 64-bit hashes) repeat whole. Anchors with different
    regions send one of each to one place, where their suffixes are sorted. Anchors with more than `hot` of them (near
    copies by the hundred) are split into groups of windows that share some 340 bytes, and sorted there; anchors with
    more than `huge` send their windows' 128-bit hashes, which are counted map-side.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_anchor_rows(length), "anchor long, f1 long, key binary, span long")
    met = rows.groupBy("anchor").count().where("count > 1").select("anchor")
    rows = checkpointed(rows.join(met, "anchor"))
    kinds = rows.groupBy("anchor", "f1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "span")).alias("one"))
    twice = kinds.where("n > 1").select("anchor", "f1")
    whole = rows.join(twice, ["anchor", "f1"], "left_semi").select("key", (F.shiftright("span", 20) - F.col("span").bitwiseAND(1023)).alias("lo"),
                                                                  (F.shiftright("span", 20) - F.shiftright("span", 10).bitwiseAND(1023)).alias("hi"))
    various = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = kinds.join(various, "anchor").select("one.key", F.struct("anchor", "f1", "one.span", (F.col("kinds") > hot).alias("split")).alias("ask"), (F.col("kinds") > huge).alias("huge"))

    def regions(want: Column) -> DataFrame:
        lists = asked.where(want).groupBy("key").agg(F.collect_list("ask").alias("asks_")).withColumnRenamed("key", "text_key_")
        joined = docs.join(lists, docs[key] == F.col("text_key_"))
        return joined.mapInArrow(_regions(joined.columns.index(text), joined.columns.index("asks_"), length), "anchor long, f1 long, key binary, span long, region binary")

    sorted_ = regions(~F.col("huge")).repartition("anchor").sortWithinPartitions("anchor", "f1").mapInArrow(_sort_regions(length), "key binary, lo long, hi long")
    windows = regions(F.col("huge")).mapInArrow(_windows(length), "w1 long, w2 long, key binary, lo long")
    again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    single = windows.join(again, ["w1", "w2"], "left_semi").select("key", "lo", F.col("lo").alias("hi"))
    return whole.union(sorted_).union(single).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def covered(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Runs of window starts -> maximal runs [lo, hi) of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, text: str = "text", hot: int = HOT, huge: int = HUGE, length: int = LENGTH) -> DataFrame:
    """All columns of `docs` and the struct `cut`: n_bytes, n_removed, n_spans, kept_sha256, kept (the text that is left).

    Texts are UTF-8 bytes (null: none). Each byte covered by a string of `length` bytes (65 to 1,023) that starts anywhere
    else as well, in the same or another text, goes; strings are judged on the input, so copies of a text that long go
    with all their bytes. Where a cut splits a character, `kept` leaves its remaining bytes out; the digest covers all bytes kept.
    Matches never cross texts; shorter texts stay whole. Repeated rows are copies of each other.
    """
    name, key = fresh(docs, "cut"), "key_of_text_"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    own = f"c{docs.columns.index(text)}"
    keyed = plain.withColumn(key, text_key(F.col(own))).where(F.col(key).isNotNull())  # never null; said here so that all joins below share one exchange of the texts
    spans = repeated_windows(keyed, own, key, hot, huge, length).withColumnRenamed("key", "span_key_")
    joined = keyed.join(spans, keyed[key] == F.col("span_key_"), "left")
    at_text, at_spans = joined.columns.index(own), joined.columns.index("spans")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    schema = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(fields))])
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for value, runs in zip(part.column(at_text), part.column(at_spans).to_pylist()):
                    raw = (value.as_py() or "").encode()
                    gone = covered([(x["lo"], x["hi"]) for x in runs or []], length)
                    kept, done = [], 0
                    for lo, hi in gone:
                        kept.append(raw[done:lo])
                        done = hi
                    left = b"".join([*kept, raw[done:]])
                    rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(gone), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode("utf-8", "ignore")})
                kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(rows, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)
