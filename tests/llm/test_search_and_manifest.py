"""Top-k search, hard negatives and the Merkle manifest against brute force, with nulls, ties, repeats, empty and hot input."""
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, maxscore, merkle, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_of(n=260, dim=6, seed=1, sparse=False):
    """Clustered vectors; a third of them equal, ids with gaps, negative components, zeros and hostile rows."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        x = centers[0] if i % 3 == 0 else centers[i % 4] + rng.normal(size=dim) * 0.3
        if sparse:
            x = np.where(rng.random(dim) < 0.7, 0, x)
        rows.append((i * 10, np.float32(x).tolist(), int(i % 3)))
    return rows + [(5, [0.0] * dim, 1), (-100, np.float32(centers[1]).tolist(), 1), (7, None, 1), (11, [1.0, None] + [0.0] * (dim - 2), 1), (13, [math.nan] + [0.0] * (dim - 1), 1),
                   (17, [math.inf] + [0.0] * (dim - 1), 1), (19, np.float32(centers[2]).tolist(), None), (None, np.float32(centers[2]).tolist(), 1), (3100, [1.0] * (dim - 1), 2), (3103, [2.0] * (dim - 1), 1),
                   (21, [1e30] * dim, 1), (23, [], 0), (200, rows[20][1], rows[20][2])]


def usable(row, labelled):
    i, v, label = row
    return i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 4000 for x in v) and (label is not None or not labelled)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def distinct(rows, scale, labelled=False):
    best = {}
    for r in rows:
        if usable(r, labelled):
            key = (r[2] if labelled else 0, whole(r[1], scale))
            best[r[0]] = min(best.get(r[0], key), key)
    return best


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k):
    at = distinct(rows, 1024)
    out = set()
    for q, (_, v) in at.items():
        if q % 100 == 0:
            found = sorted((-dot(v, x), i) for i, (_, x) in at.items() if i != q and len(x) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def brute_negatives(rows, label=lambda i, l: l):
    at = {i: (label(i, l), v) for i, (l, v) in distinct(rows, 256, True).items()}
    out = set()
    for a, (own, v) in at.items():
        if a % 100:
            continue
        scored = sorted((-dot(v, x), i, l) for i, (l, x) in at.items() if i != a and len(x) == len(v))
        for s, p, _ in [x for x in scored if x[2] == own][:5]:
            near = [(n, i) for n, i, l in scored if l != own and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(near)}
    return out


def got(df, columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


TOP = ["query_id", "rank", "vec_id", "score"]
HARD = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sparse,sample,shard,block", [(False, 16, 40, 7), (True, 16, 1000, 1000), (False, 64, 100, 3)])
def test_top_k(spark, sparse, sample, shard, block):
    rows = vectors_of(sparse=sparse)
    df = spark.createDataFrame(rows, VECTORS)
    found = got(maxscore.top_k(df, F.col("vec_id") % 100 == 0, sample=sample, shard=shard, block=block), TOP)
    assert len(found) == len(set(found)) and set(found) == brute_top(rows, 10)


def test_top_k_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, -2.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (100, [-1.0, -1.0], 1)], VECTORS).select("*", F.lit(1).alias("floor"), F.lit(2).alias("v"), F.lit(3).alias("score"))
    assert set(got(maxscore.top_k(few, F.col("vec_id") % 100 == 0), TOP)) == brute_top([(0, [1.0, -2.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (100, [-1.0, -1.0], 1)], 10)
    assert maxscore.top_k(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert maxscore.top_k(few.where("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_maxscore_skips_rows(monkeypatch):
    """With a threshold, rows without an essential posting are never scored."""
    rng = np.random.default_rng(0)
    x = np.where(rng.random((4000, 30)) < 0.05, rng.integers(1, 100, (4000, 30)), 0).astype(float)
    index = maxscore.Postings(np.arange(4000), x)
    q = np.zeros(30)
    q[:6] = [50, 40, 3, 2, 1, 1]
    floor = np.sort(x @ q)[-10]
    touched = []
    real = np.ix_
    monkeypatch.setattr(maxscore.np, "ix_", lambda t, r: touched.append(len(r)) or real(t, r))
    place, score = index.search(-1, q, 10, floor)
    assert score.tolist() == sorted((x @ q).tolist())[::-1][:10] and max(touched) < 600


@pytest.mark.parametrize("refs,shard,block", [(4, 60, 5), (1, 1000, 1000), (16, 37, 9)])
def test_hard_negatives(spark, refs, shard, block):
    rows = vectors_of(seed=3)
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("positives"), F.lit(2).alias("angles"), F.lit(0).alias("norm"))
    found = got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, references=refs, shard=shard, block=block, sample=50), HARD)
    want = brute_negatives(rows)
    assert len(want) > 200 and len(found) == len(set(found)) and set(found) == want


def test_hard_negatives_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.0], 2), (3, [-1.0, 0.0], 2)], VECTORS)
    assert set(got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0), HARD)) == {(0, 1, 1, 2, 65536, 32768)}
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(df.where("vec_id > 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_angles_bound_every_score():
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.integers(-300, 300, (300, 8)), np.zeros((2, 8), int), np.tile(rng.integers(-300, 300, (1, 8)), (5, 1)), rng.integers(-300, 300, (40, 8)) * 40_000))
    refs = negatives.directions(x, 5)
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    angles = np.where(norm[:, None] > 0, np.arccos(np.clip(x @ refs.T / np.maximum(norm, 1e-9)[:, None], -1, 1)), np.pi / 2)
    table = pa.table({"vec_id": np.arange(len(x)), "label": np.zeros(len(x), np.int64), "v": x.tolist(), "norm": norm, "angles": angles.tolist()})
    rows = negatives.Rows(table, 8)
    for a in range(len(x)):
        low, high = rows.bounds(rows, a, slice(None))
        score = x @ x[a]  # rows keep their order: one label, ids ascend
        assert (low <= score).all() and (score <= high).all()


def test_exact_scores_beyond_doubles():
    big = np.full((2, 4), (1 << 24) - 1, np.int64)
    a, b = blocks.exact(big, big[0])
    assert int((a @ b)[0]) == 4 * ((1 << 24) - 1) ** 2
    wide = np.array([[2 ** 26 - 1, 2 ** 26 - 3]], np.int64)
    a, b = blocks.exact(wide, wide[0])
    assert int((a @ b)[0]) == (2 ** 26 - 1) ** 2 + (2 ** 26 - 3) ** 2


def test_registered_vector_queries(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert set(got(queries.op13_top_k(spark, root), TOP)) == brute_top(rows, 10)
    assert set(got(queries.op11_hard_negatives(spark, root), HARD)) == brute_negatives(rows, lambda i, l: (l + 1) % 10 if i % 7 == 0 else l)


# manifest ------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root and, per node, the (before, after) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = i - i % 3
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], {}
    for s in names:
        groups[s].sort(key=lambda x: x[:2])
        root, paths = climb([x[1] for x in groups[s]])
        subs.append(root)
        inner[s] = paths
    root, tops = climb(subs)
    out = []
    for n, s in enumerate(names):
        for (_, leaf, r), path in zip(groups[s], inner[s]):
            steps = path + tops[n]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf_of((*r[:4], r[4].replace("\n", "") if bad and r[4] is not None else r[4]))
            for b, a in steps:
                node = H(b, node, a)
            out.append((r[0], leaf, subs[n], root, H(*(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture(scope="module")
def papers():
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(15)}", rng.choice(["en", None]), i, rng.choice(["a\nb", "plain", "", None, "ä\n\n€" * 5])) for i in range(500)]
    return rows + [(7, "hot", "en", 7, "again"), (7, "hot", "en", 7, "again"), (7, "hot", None, None, None), (None, None, None, None, "no id\n"), (None, "hot", "de", 1, "x"), (3, "", "", 0, ""),
                   (4, "é", "fr", 2, "long\n" * 50_000), (-12, "Z", "en", 1, "-")]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, papers, tmp_path, levels, monkeypatch):
    spark.createDataFrame(papers, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    real = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda leaves: real(leaves, levels=levels))
    found = sorted(got(queries.op12_merkle_manifest(spark, str(tmp_path)), COLUMNS), key=str)
    want = brute_manifest(papers)
    assert found == want and {x[-1] for x in want} == {True, False}


def test_manifest_of_one_and_no_rows_and_clashing_names(spark, papers):
    docs = spark.createDataFrame(papers, DOCS).select("*", merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"), *[F.lit(i).alias(n) for i, n in enumerate(("g", "pos", "n", "node", "proof", "root", "block", "c0"))])
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("source = 'Z'")).collect()[0]
    assert one.subroot == one.leaf == one["root_"] and one["proof_"] == [] and one.root == 5 and one.c0 == 7
    assert merkle.manifest(docs).columns == [*docs.columns, "subroot", "root_", "proof_"]


def test_layout_is_a_permutation_split_at_half_height():
    for h in range(8):
        places = np.concatenate(merkle.layout(h))
        assert sorted(places.tolist()) == list(range(merkle.nodes_of(h))) and places[0] == 0
    assert merkle.layout(3)[2].tolist() == [4 + 4 * i for i in range(9)]  # the lower trees lie side by side behind the upper one
    assert merkle.layout(3)[3][:6].tolist() == [5, 6, 7, 9, 10, 11]


def test_proofs_are_read_from_the_layout():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 9, 10, 26, 28, 80):
        leaves = [H(str(rng.random())) for _ in range(n)]
        h = merkle.height_of(n)
        before, after, path = merkle.siblings(merkle.build(leaves, h), h, n)
        _, want = climb(leaves)
        assert [[(before[k], after[k]) for k in p] for p in path.tolist()] == want
