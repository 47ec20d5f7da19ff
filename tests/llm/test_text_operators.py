"""Each text operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, htmltext, langid, mixing, multiindex, outliers, rollups, simhash, suffix, toxicity
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog and runs into a deep dark wood where nobody has been before it "
LONG = BASE * 2000
EDGE = [(1, BASE, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", None, 4), (5, "!!! ---", "en", "b", 7), (6, LONG, "en", "b", len(LONG)),
        (7, BASE, "en", "a", 1), (7, BASE, "en", "a", 1), (None, "Ähnlich große Bäume im Wald", "de", "c", 3), (9, "x", "fr", "c", 1), (10, BASE.upper(), "en", "a", 1),
        (11, "one line\nsame line here\nsame line here\n\n\n" + BASE, "en", "a", 1), (12, "é" * 500, "fr", "d", 500), (13, "zé" * 450 + "q", "fr", "d", 901)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """Extra columns with names that operators might use themselves."""
    names = ["score", "cut", "mix", "row", "key", "fp", "lines", "_t", "spans", "size", "words", "held_out", "label", "at", "times", "offset", "source_size", "c0", "kept", "n"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id):
    import zlib
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


# languages -----------------------------------------------------------------

def test_codewords_separate_languages():
    for k in (2, 3, 4, 7, 12):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k and not (abs(code.sum(axis=0)) == k).any()


def test_language_id(spark, docs, odd, none):
    import random
    rng = random.Random(1)
    sounds = {"aa": "la mi so re do".split(), "bb": "krr gnt zzk pft".split(), "cc": "oui eau ille tion".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[l]) for _ in range(3)) for _ in range(30)), l, "s", 1) for i in range(300) for l in [list(sounds)[i % 3]]]
    table = spark.createDataFrame(rows, SCHEMA)
    codes = langid.train(table)
    got = langid.identify(table, codes).collect()
    assert all(r.held_out == fold(r.doc_id) for r in got)
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    edge = langid.identify(odd, codes).collect()
    assert len(edge) == len(EDGE)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 5)) for r in edge)
    assert langid.identify(none, codes).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_loss_weighted_decoding_is_nearest_codeword():
    code = langid.codewords(4)
    codes = langid.Codes(list("abcd"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for i in range(4):
        f = code[i] * 3
        f[1] *= -1  # one wrong bit is corrected
        best, score, lead = langid.decode(codes, f[None])
        assert best[0] == i and score[0] > 0.5 and lead[0] > 0


# vectors -------------------------------------------------------------------

def brute_links(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    degree[i] += 1
                    degree[j] += 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 10**9), k)
    return sorted((k, degree[i], least[root(i)], k == least[root(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("part", [1024, 3])
def test_multi_index_equals_brute_force(spark, part):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + rng.normal(size=8) * 0.12).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [0.0] * 8), (203, None), (204, [float("nan")] * 8), (205, [1.0, None]), (206, [1.0, 2.0]), (207, [1.0, 2.0]), (208, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in multiindex.near_vectors(table.withColumn("cid", F.lit(1)), part=part).collect())
    assert got == brute_links(rows)


@pytest.mark.parametrize("crowd", [0, 600])
def test_sparse_links_near_the_threshold_are_all_found(spark, crowd):
    """Far more vectors than are sampled, few of them linked; a crowd of close vectors says nothing about the others."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 24))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(60):
        side = rng.normal(size=24)
        side -= side @ x[i] * x[i]
        cos = rng.uniform(0.9501, 0.955)
        x[4000 + i] = cos * x[i] + np.sqrt(1 - cos * cos) * side / np.sqrt(side @ side)
    x[7000:7000 + crowd] = x[7000] + rng.normal(size=(crowd, 24)) * 1e-3
    want = (x @ x.T / np.outer(*[np.sqrt((x * x).sum(axis=1))] * 2) >= 0.95).sum(axis=1) - 1
    assert (want > 0).sum() >= 120
    got = multiindex.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in sorted(got)] == want.tolist()


def test_fitted_reach_needs_links_between_different_vectors(spark):
    rng = np.random.default_rng(12)
    lone = rng.normal(size=(3000, 24))
    paired = np.repeat(rng.normal(size=(1500, 24)), 2, axis=0) + rng.normal(size=(3000, 24)) * 0.05
    fitted = []
    for x in (lone, paired):
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "cid long, embedding array<double>")
        fitted.append(multiindex.fit(table, 3000, target=0.9).reach)
    assert fitted[1] < 0.1 <= fitted[0] < 0.1001


@pytest.mark.parametrize("sides", [(0, 3), (0, 0), (2, 3)])
def test_units_of_a_cell_meet_in_tiles(monkeypatch, sides):
    """A unit of more vectors than a tile: links and groups equal a plain product, and no tile is larger than allowed."""
    import pyarrow as pa
    monkeypatch.setattr(multiindex, "TILE", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 8))[rng.integers(0, 9, 60)] + rng.normal(size=(60, 8)) * 0.1
    side, n = np.where(np.arange(60) < 40, *sides).astype(np.int32), rng.integers(1, 4, 60)
    table = pa.table({"unit": np.zeros(60, np.int64), "side": side, "cid": np.arange(60) + 100, "n": n, "embedding": pa.array(x.tolist())})
    batches = list(multiindex._meet(0.95)(iter(table.to_batches(max_chunksize=13))))
    assert max(b.num_rows for b in batches) <= 14
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    a, b = side % 2 == 0, side % 2 == 1
    linked = (u @ u.T >= 0.95) & ~np.eye(60, dtype=bool) & ((a[:, None] & b[None]) | (b[:, None] & a[None]) | ((side == 0)[:, None] & (side == 0)[None]))
    links, group = np.zeros(60, int), np.arange(60)
    for batch in batches:
        for cid, k, to in zip(*(batch.column(c).to_numpy() for c in range(3))):
            links[cid - 100] += k
            one, two = group[cid - 100], group[to - 100]
            group[group == max(one, two)] = min(one, two)
    want = np.arange(60)
    for i, j in zip(*np.nonzero(linked)):
        want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert links.tolist() == (linked @ n).tolist() and linked.any()
    assert [group[i] == group[j] for i in range(60) for j in range(i)] == [want[i] == want[j] for i in range(60) for j in range(i)]


def test_vectors_go_to_few_cells(spark):
    """Cells hold many vectors, so that a vector is sent to few of them: 40,000 spread ones have 16 cells, not 36."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    classes = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "cid long, embedding array<double>")
    one, two = multiindex.fit(classes, 40_000).books.get(16) or multiindex.fit(classes, 600).books[16]
    assert len(one) * len(two) <= 16


def test_multi_index_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    got = multiindex.near_vectors(table).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (None, 0, None, False)}
    assert multiindex.near_vectors(table.limit(0)).count() == 0


def test_multi_sequence_goes_nearest_first():
    one, two = np.array([0.0, 3.0, 1.0]), np.array([0.5, 0.0, 2.0])
    got = list(multiindex.multi_sequence(one, two, 3.0))
    assert [x[2] for x in got] == sorted(x[2] for x in got)
    assert {x[:2] for x in got} == {(i, j) for i in range(3) for j in range(3) if one[i] + two[j] <= 3.0}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 7), (3, 10)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (10, 1), (4, 4), (5, 4), (7, 7), (8, 7)}
    assert components(edges.limit(0)).count() == 0
    path = spark.range(300).selectExpr("id u", "id + 1 v")
    assert {r.root for r in components(path).collect()} == {0}


# rollups -------------------------------------------------------------------

def test_rollups_are_additive_and_idempotent(spark, docs):
    books = rollups.TokenRollup.temporary(spark)
    assert books.totals().count() == 0
    rows = docs.select("doc_id", "source", "lang", F.lit("w").alias("version"), rollups.count_words().alias("tokens"))
    assert not books.delete("early", docs)  # nothing is known yet
    assert books.insert("one", rows) and not books.insert("one", rows)
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in books.totals().collect()}
    want = defaultdict(lambda: [0, 0])
    for i, t, l, s, _ in EDGE:
        want[(s, l)][0] += 1
        want[(s, l)][1] += len(words_of(t))
    assert total() == {k: tuple(v) for k, v in want.items()}
    assert books.delete("two", spark.createDataFrame([(6,), (6,), (None,), (99,)], "doc_id long"))
    want[("b", "en")] = [want[("b", "en")][0] - 1, want[("b", "en")][1] - len(words_of(LONG))]
    assert books.revise("three", spark.createDataFrame([(1, "w", 5), (1, "w", 4), (98, "w", 7)], "doc_id long, version string, tokens long"))
    want[("a", "en")][1] += 5 - len(words_of(BASE))
    assert total() == {k: tuple(v) for k, v in want.items()}
    assert not books.revise("three", docs) and books.batches() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        books.insert("../x", rows)


# toxicity ------------------------------------------------------------------

def test_toxicity_learns_from_positives_and_unlabelled(spark, docs, odd, none):
    import random
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = [rng.choice(vocabulary) for _ in range(40)]
        if toxic:
            text[5], text[20] = rng.choice(["Grob!", "fies,"]), rng.choice(["grob", "übel"])
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 3:
            marks.append((i, 1, int(toxic)))
    table, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predict(table, labels).collect()}
    assert len(got) == 1500 and all(r.held_out == fold(k) for k, r in got.items())
    assert np.mean([r.predicted == int(k % 8 == 0) for k, r in got.items() if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    model = toxicity.train(table, labels)
    scored = toxicity.score(odd, model, name="score2")
    assert scored.columns == [*odd.columns, "score2"] and scored.count() == len(EDGE)
    assert toxicity.predict(none, labels).count() == 0 and toxicity.predict(docs, labels.limit(0)).count() == len(EDGE)


def test_word_buckets_do_not_cross_rows():
    texts = [b"ab cd", b"ef", b"", b"ab ", b"AB"]
    at = np.cumsum([0, *map(len, texts)])
    row, bucket = toxicity.word_buckets(np.frombuffer(b"".join(texts), np.uint8), at)
    assert row.tolist() == [0, 0, 1, 3, 4] and bucket[0] == bucket[3] == bucket[4] and len(set(bucket.tolist())) == 3
    row, bucket = toxicity.word_buckets(np.frombuffer(b"stems stemmed", np.uint8), np.array([0, 13]))
    assert len(row) == 2 + 2 + 1 + 1 and len(set(bucket.tolist())) == 5  # `stem` is shared


def test_negative_risk_is_walked_back():
    rows = [np.array([1]), np.array([1]), np.array([1]), np.array([2]), np.array([2]), np.array([2])] * 20
    positive = np.array([True, True, True, False, False, False] * 20)
    model = toxicity.fit_nnpu(rows, positive, 0.3)
    weight = dict(zip(model.buckets.tolist(), model.weights))
    assert weight[1] > 0 and np.isfinite(model.weights).all()


@pytest.mark.parametrize("positives", [0, 5, 11, 50])
def test_few_positives_accuse_few(positives):
    """Clean texts stay below the threshold however few toxic ones are known; with 50, most toxic ones are found."""
    rng = np.random.default_rng(positives)
    clean = lambda: np.unique(rng.integers(0, 3000, 60))
    toxic = lambda: np.unique(np.concatenate((rng.integers(0, 3000, 50), rng.choice(np.arange(5000, 5030), 6))))
    known = [toxic() for _ in range(positives)]
    unlabelled = [toxic() if i % 10 == 0 else clean() for i in range(400)]
    model = toxicity.fit_nnpu(known + unlabelled, np.arange(positives + 400) < positives, 0.1)
    table = np.zeros(1 << toxicity.BITS)
    table[model.buckets] = model.weights
    score = lambda rows: np.array([1 / (1 + np.exp(-table[r].sum() - model.bias)) for r in rows])
    assert (score([clean() for _ in range(300)]) >= toxicity.THRESHOLD).mean() < 0.1
    assert positives < 50 or (score([toxic() for _ in range(300)]) >= toxicity.THRESHOLD).mean() > 0.8
    assert model.bias < np.log(0.3 / 0.7)


# outliers ------------------------------------------------------------------

def brute_statistics(text):
    w = words_of(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics(spark, odd):
    extra = spark.createDataFrame([(20, "a b c d e f g h " * 3, "x", "y", 1), (21, "p " + "a b c d e f g h i j " * 2 + "q", "x", "y", 1), (22, "  #|# \x0b\x0c \x1c a\r\n a\n a\n", "x", "y", 1)], SCHEMA)
    for table in (odd, extra):
        texts = sorted([(r.doc_id or 0, brute_statistics(r.text)) for r in table.collect()])
        got = sorted([(r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in outliers.text_statistics(table.select("doc_id", "text")).collect()])
        assert got == texts


def brute_mcd(x):
    med = [sorted(c)[(len(c) + 1) // 2 - 1] for c in x.T.tolist()]
    mad = [sorted(abs(v - m) for v in c)[(len(c) + 1) // 2 - 1] for c, m in zip(x.T.tolist(), med)]
    d2 = (((x - med) ** 2) / ((1.4826 * np.array(mad)) ** 2 + outliers.FLOOR)).sum(axis=1)
    seen = []
    while True:
        level = np.floor(np.log1p(d2) * 100)
        cut = np.sort(level)[int(np.ceil(0.75 * len(x))) - 1]
        inner = x[level <= cut]
        key = inner.sum(axis=0).tolist(), (inner.T @ inner).tolist(), len(inner)
        mean = inner.mean(axis=0)
        cov = outliers.CONSISTENCY * (inner.T @ inner / len(inner) - np.outer(mean, mean)) + outliers.FLOOR * np.eye(5)
        d2 = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
        if key in seen:
            return d2
        seen.append(key)


def test_outliers_equal_brute_force(spark):
    import random
    rng = random.Random(5)
    rows = []
    for i in range(400):
        n = int(np.exp(rng.gauss(5, 0.6))) + 20
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
        if i % 40 == 0:
            text = text.replace(" ", " ### ")
        rows.append((i, text, "en" if i % 3 else None, "s", 1))
    got = {r.doc_id: r for r in outliers.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    for lang in ("en", None):
        ids = [r[0] for r in rows if r[2] == lang]
        x = []
        for i in ids:
            n, c, s, d, p = brute_statistics(rows[i][1])
            x.append([round(np.log1p(n) * 100), round(np.log(c / n) * 400), round(np.log1p(100 * s / c) * 100), round(np.log1p(d) * 50), round(np.log1p(100 * p / n) * 50)])
        d2 = brute_mcd(np.array(x, float))
        assert np.allclose([got[i].distance for i in ids], d2, rtol=1e-6, atol=1e-9)
        assert [got[i].kept for i in ids] == (d2 <= outliers.CUTOFF).tolist()
    assert all(got[i].kept == (i % 40 != 0) for i in range(400))


def plain_text(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.mark.parametrize("copies", [True, False])
def test_a_third_of_one_extreme_template_is_rejected(spark, copies):
    import random
    rng = random.Random(9)
    rows = [(i, plain_text(rng, int(np.exp(rng.gauss(5, 0.4))) + 20), "en", "s", 1) for i in range(200)]
    template = plain_text(rng, 150).replace(" ", " ### ")
    rows += [(1000 + i, template if copies else template + " " + plain_text(rng, rng.randint(1, 30)), "en", "s", 1) for i in range(100)]
    rows.append((2000, plain_text(rng, 150).replace(" ", " ##### "), "en", "s", 1))
    got = {r.doc_id: r.kept for r in outliers.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, kept in got.items() if kept] == [i for i in got if i < 1000]


def test_small_groups_are_judged_by_their_language_or_all_rows(spark):
    import random
    rng = random.Random(10)
    rows = [(i, plain_text(rng, int(np.exp(rng.gauss(5, 0.4))) + 20), "de" if i < 5 else "en", f"s{i % 9}", 1) for i in range(200)]
    rows += [(1000 + i, plain_text(rng, 150).replace(" ", " ### "), lang, f"s{i}", 1) for i, lang in enumerate(("en", "de", "fr"))]
    got = {r.doc_id: r for r in outliers.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.distance is not None and r.kept == (i < 1000) for i, r in got.items())


def test_small_groups_and_base_rule(odd, none):
    got = {r.doc_id: r for r in outliers.quality(odd).collect()}
    assert got[6].base_failed and not got[6].kept and got[2].base_failed and got[9].base_failed
    assert not got[1].base_failed and got[1].kept and got[1].distance is None
    assert outliers.quality(none).count() == 0


# suffixes ------------------------------------------------------------------

def brute_cuts(texts, length=400):
    seen = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for t, r in enumerate(raw):
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]].append((t, i))
    gone = [np.zeros(len(r), bool) for r in raw]
    for v in seen.values():
        if len(v) > 1:
            for t, i in v:
                gone[t][i:i + length] = True
    out = []
    for r, g in zip(raw, gone):
        kept = np.frombuffer(r, np.uint8)[~g].tobytes()
        out.append((len(r), int(g.sum()), int((np.diff(np.concatenate(([0], g.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [(256, 65536), (2, 65536), (2, 3)])
def test_suffix_cuts_equal_brute_force(spark, limits):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh é"), 2500))
    texts = []
    for k in range(25):
        t = list(base)
        for p in rng.integers(0, 2500, rng.integers(1, 6)):
            t[p] = f"{'XYZ'[k % 3]}{k}"
        texts.append("".join(t))
    texts += [base[:700], base[100:499], base[100:500], "a" * 1000, "a" * 399, "ab" * 600, "x" + base[500:1500] + "y" + base[500:1500], None, "", "é" * 300, base[2000:] + base[:2000]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256) for r in suffix.dedup(table, hot=limits[0], huge=limits[1]).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cuts(texts)


def test_suffix_cuts_on_edges(odd, none):
    cut = suffix.dedup(odd)
    assert cut.columns == [*odd.columns, "cut_"] and suffix.dedup(none).count() == 0
    assert sorted((r.doc_id or 0, r.cut_.n_removed) for r in cut.collect()) == sorted((e[0] or 0, c[1]) for e, c in zip(EDGE, brute_cuts([e[1] for e in EDGE])))
    assert all(r.cut_.kept is not None for r in cut.collect())


def test_suffix_sort_orders_and_survives_lying_hashes():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    s = suffix.Suffixes(data, 50)
    place = np.arange(800)
    order = s.sort(place, np.zeros(800, np.int64))
    got = [data[i:i + 50].tobytes() for i in place[order]]
    assert got == sorted(got)

    class Lying(suffix.Suffixes):
        def equal(self, i, j, size):
            return np.ones(len(i), bool)

    regions = [b"a" * 400 + b"xy", b"a" * 400 + b"xz", b"b" * 402]
    args = (regions, np.zeros(3, np.int64), np.array([2, 2, 2]), np.array([3, 3, 3]))
    honest = suffix.repeated_starts(*args)
    kept, suffix.Suffixes = suffix.Suffixes, Lying
    try:
        assert suffix.repeated_starts(*args) == honest == [(0, 0, 1), (1, 0, 1)]
    finally:
        suffix.Suffixes = kept


# pages ---------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body class="no-sidebar"><nav><a>Menu</a></nav><!-- c --><div class="ad">buy</div>
<article><h1>Head &amp; more</h1><p>One  <b>bold</b>&nbsp;x<br>y<p>Two</p><aside>side</aside><div class="comments"><p>reader</p></div></article><footer>&copy; f</footer></body></html>"""


def test_page_structure():
    assert htmltext.page_lines(PAGE) == [("Head & more", True), ("One bold x y", True), ("Two", True)]
    assert htmltext.page_lines("") == [] and htmltext.page_lines("plain &lt;text") == [("plain <text", False)]
    assert htmltext.page_lines("<p>a<script>b") == [("a", False)]
    assert htmltext.page_lines("<div id='sidebar'><p>x</div><ul><li>1<li>2</ul><form>f</form>z") == [("1", False), ("2", False), ("z", False)]


@pytest.mark.parametrize("page", [
    "<article class='post comments-open'><p>a</p></article>", "<main class='has-sidebar'><p>a</p></main>", "<main class='sidebar'><p>a</p></main>", "<article id='search-results-article'><p>a</p></article>",
    "<div class='layout-with-sidebar'><article><p>a</p></article></div>", "<div class='sidebar'><div>m</div><article><p>a</p></article></div>", "<article class='comments'><div class='article-header'><h1>a</h1></div></article>",
    "<article title='the hidden truth'><p>a</p><p hidden>b</p><p data-x='1' hidden=''>c</p></article>", "<article><p>a</p><div class='comment-list'><article class='comment'>r</article></div></article>",
    "<article><p>a</p></article><div id='comments'><article>r</article></div><div class='site-footer'>f</div>", "<article><p>a</p><div class='share social'>s</div><div class='cookie_banner'>c</div></article>"])
def test_class_words_do_not_drop_the_article(page):
    assert [line for line, sure in htmltext.page_lines(page) if sure] == ["a"]


def test_longest_common_lines():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 9)).tolist() for _ in range(2))
        taken = [x for x, t in zip(a, htmltext.common_lines(a, b)) if t]
        size = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
        assert len(taken) == size[-1, -1]
        rest = iter(b)
        assert all(x in rest for x in taken)


def test_pages_are_paired_by_nearest_url(spark):
    frame = lambda host, body: f"<body><div>Welcome to {host}</div><p>{body}</p><div>All rights</div></body>"
    rows = [(1, "http://h.example/a/1", frame("h", "first")), (2, "http://h.example/a/2", frame("h", "second")), (3, "http://h.example/b/9", frame("h", "third")),
            (4, "http://alone.example/", frame("alone", "only")), (5, None, None), (6, "http://h.example/a/2", ""), (7, "http://h.example/a/1", PAGE), (4, "http://alone.example/", frame("alone", "only"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect())
    want = {1: "first", 2: "second", 3: "third", 5: "", 6: "", 7: "Head & more\nOne bold x y\nTwo"}
    assert {k: t for k, t, _ in got if k != 4} == want and all(n == len(t) for _, t, n in got)
    assert [t for k, t, _ in got if k == 4] == ["Welcome to alone\nonly\nAll rights"] * 2
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_pages_with_an_article_are_aligned_too(spark):
    page = "<body><div>Welcome</div><article><h1>{0}</h1><p>Said again.</p><p>{0} text</p></article><div>{0} outside</div></body>"
    rows = [(i, f"http://h.example/a/{i}", page.format(name)) for i, name in ((1, "one"), (2, "two"))]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "one\nSaid again.\none text", 2: "two\nSaid again.\ntwo text"}
    assert {(r.n_shared, r.n_restored) for r in got.values()} == {(2, 1)}  # "Welcome" goes, the sentence inside the article is put back


def test_nearest_pages_meet_across_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"http://h{i % 3}.example/{'abc'[i % 2]}/{i:03d}", "".join(f"<p>{w}</p>" for w in rng.integers(0, 6, rng.integers(1, 12)))) for i in range(150)]
    want = {}
    for h in range(3):
        pages = sorted((u.split("example", 1)[1], i, [t for t, _ in htmltext.page_lines(x)]) for i, u, x in rows if i % 3 == h)
        for k, (path, i, lines) in enumerate(pages):
            near = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages)]
            alike = [next((n for n, (c, d) in enumerate(zip(path, other[0])) if c != d), 0) for other in near]
            shared = htmltext.common_lines(lines, near[alike.index(max(alike))][2])
            want[i] = "\n".join(t for t, s in zip(lines, shared) if not s)
    pages = spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string").repartition(7)
    got = htmltext.extract(pages).collect()
    assert len(got) == 170 and {r.page_id: r.text for r in got} == want


def test_long_pages_align_in_little_memory():
    import tracemalloc
    a = list(range(12_000))
    b = np.random.default_rng(2).permutation(a).tolist()
    tracemalloc.start()
    taken = htmltext.common_lines(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 150 < sum(taken) and most < 30e6


# mixing --------------------------------------------------------------------

def test_mix_meets_targets(spark, docs, odd, none):
    rows = [(i, "w " * (1 + i % 7), "en", None if i % 10 == 9 else "abc"[i % 3] if i % 30 else "d", 1) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    name = mixing.mix(table, mixing.word_count()).select("doc_id", "source", "mix.*").collect()
    again = mixing.mix(table.repartition(5), mixing.word_count()).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(str, name)) == sorted(map(str, again))
    total = sum(r.size for r in name)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in name:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(x for x in by if x) + [None])}
    open_, target, rest = set(by), {}, total
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * by[s][0] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * by[s][0] for s in full}
        rest -= sum(3 * by[s][0] for s in full)
        open_ -= full
    for s, (size, taken, t) in by.items():
        assert abs(t - target[s]) < 1e-6 and abs(taken - t) <= 1
    assert mixing.curriculum(none).count() == 0 and mixing.mix(none, mixing.word_count()).count() == 0
    stream = mixing.curriculum(odd)
    assert stream.columns == odd.columns
    stream = mixing.curriculum(table).collect()
    assert Counter(r.source for r in stream for _ in words_of(r.text)) == {s: v[1] for s, v in by.items() if v[1]}


def test_schedule_is_inverted(spark):
    rows = [(u / 10, a, b) for u in range(11) for a, b in mixing.SCHEDULES]
    got = spark.createDataFrame(rows, "u double, a double, b double").withColumn("t", mixing.position_at(F.col("u"), F.lit(1.0), F.col("a"), F.col("b"))).collect()
    for r in got:
        p, q = 2 * r.a / (r.a + r.b), 2 * r.b / (r.a + r.b)
        assert abs(p * r.t + (q - p) * r.t ** 2 / 2 - r.u) < 1e-9


# tokens --------------------------------------------------------------------

def test_bpe_equals_the_library(spark, odd, none):
    import random
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = ["a", "b", "t", "h", "e", "in", " ", "the", "an", "é", "日", "\n", "1", ".", "_", "🎉", "'s", " ", " ", "<|endoftext|>", "\x00"]
    texts = ["", "a" * 50, "ab" * 300, "<|endoftext|>a<|endoftext|> b", "  \n\n  x", "don't we'll I'VE ''s", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(500))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_decode(table, path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert got[-1].n_tokens == 0 and got[-1].decoded == ""
    assert bpe.encode_decode(odd, path).count() == len(EDGE) and bpe.encode_decode(none, path).count() == 0


def test_automaton_forgets_safely():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = bpe.Tokenizer(open(path, encoding="utf-8").read())
    full = [tokenizer.encode(t[1] or "") for t in EDGE]
    words = bpe.WORDS_KEPT
    bpe.WORDS_KEPT = 2
    try:
        assert [bpe.Tokenizer(open(path, encoding="utf-8").read()).encode(t[1] or "") for t in EDGE] == full
    finally:
        bpe.WORDS_KEPT = words


def merged(word, rules, labels):
    """Merges the pair of least rank, leftmost first, until none is left."""
    rank = {(x, y): (r, z) for r, (x, y, z) in enumerate(rules)}
    ids = [labels.index(bytes([b])) for b in word]
    while found := [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
        i = min(found)[1]
        ids[i:i + 2] = [rank[ids[i], ids[i + 1]][1]]
    return ids


def test_compiled_automaton_equals_merging_on_made_up_merges():
    refused = struck = 0
    for seed in range(400):
        rnd = random.Random(seed)
        labels, rules = [b"a", b"b", b"c"][:1 + seed % 3], []
        letters = bytes(b[0] for b in labels)
        for _ in range(rnd.randrange(12)):
            x, y = rnd.randrange(len(labels)), rnd.randrange(len(labels))
            z = labels[x] + labels[y]
            if len(z) <= 12 and (x, y) not in [r[:2] for r in rules]:
                labels += [z] if z not in labels else []
                rules.append((x, y, labels.index(z)))
        try:
            automaton = bpe.Automaton(labels, rules)
        except ValueError:
            refused += 1
            continue
        struck += any(map(any, automaton.rows.values()))
        for _ in range(20):
            word = bytes(rnd.choices(letters, k=rnd.randrange(15)))
            assert automaton.walk(word) == merged(word, rules, labels), (labels, rules, word)
    assert refused < 20 and struck > 300
    with pytest.raises(ValueError):
        bpe.Automaton([b"a", b"aa", b"aaa", b"aaaaa"], [(0, 0, 1), (0, 1, 2), (1, 2, 3), (1, 0, 2)])


# fingerprints --------------------------------------------------------------

def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(odd, none):
    got = sorted((r.doc_id or 0, r.fingerprint) for r in simhash.simhash_groups(odd).collect())
    assert got == sorted((i or 0, f"{brute_print(t):016x}") for i, t, *_ in EDGE)
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()]
    lone = {f for _, f, c in rows if c is None}  # groups of null ids only
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([*{c for _, _, c in rows if c is not None}, *(0 for _ in lone)])
    assert simhash.simhash_groups(none).count() == 0 and simhash.simhash_dedup(none).count() == 0


def test_one_row_stays_of_each_group(spark):
    """One id on two texts of different groups, copies under null ids, and rows that only differ in another column."""
    rows = [(1, BASE, "en", "a", 1), (1, "other words of another kind altogether in this one", "en", "a", 1), (None, BASE, "en", "a", 1), (1, BASE, "en", "b", 2), (2, BASE, "en", "a", 1),
            (None, "nobody has this text but two rows without an id", "en", "a", 1), (None, "nobody has this text but two rows without an id", "en", "z", 1), (3, "other words of another kind altogether in this one", "en", "a", 1)]
    kept = [simhash.simhash_dedup(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 5)]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in kept[0]) == sorted([(1, BASE), (1, rows[1][1]), (0, rows[5][1])])


@pytest.mark.parametrize("hot", [2000, 5])
def test_trie_join_links_as_brute_force(spark, hot):
    rng = np.random.default_rng(9)
    centers = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    points = {0, (1 << 64) - 1}
    for c in centers.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << b
            points.add(x)
    values = np.array(sorted(points), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    parent = {int(x): int(x) for x in values.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = (root(int(values.view(np.int64)[k])) for k in (i, j))
            parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for x in parent}
    got = {tuple(r) for r in components(simhash.links(table, hot=hot)).collect()}
    assert got | {(x, x) for x in parent if x not in {g[0] for g in got}} == want


def test_a_round_of_suffix_sorting_is_bounded_in_bytes(monkeypatch):
    """Regions of one window each have few starts and many bytes; they must not pile up in a task."""
    import pyarrow as pa
    rounds, solve = [], suffix.repeated_starts
    monkeypatch.setattr(suffix, "repeated_starts", lambda regions, *rest: rounds.append(sum(map(len, regions))) or solve(regions, *rest))
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 400, np.uint8).tobytes() for _ in range(6000)]
    rows = [(a, k, bytes([k]) * 16, 5 << 20 | 5 << 10 | 5, t) for a, t in enumerate(texts) for k in (1, 2)]
    names, kinds = ["anchor", "f1", "key", "span", "region"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 3000]), kinds)], names=names) for i in range(0, len(rows), 3000)]
    got = [tuple(r.values()) for b in suffix._sort_regions(400)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == 12000 and {(lo, hi) for _, lo, hi in got} == {(0, 0)}
    assert len(rounds) >= 4 and max(rounds) < 1_100_000
