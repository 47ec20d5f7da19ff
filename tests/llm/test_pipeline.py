"""The pipeline's stages in turn, and the registered queries."""
import hashlib

import pytest
import public_tokenizers
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = read(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_every_stage_has_rows_and_takes_effect(stages):
    counts = [(before.count(), after.count()) for before, after in stages]
    assert all(b > 500 and a > 500 for b, a in counts)
    assert counts[0][0] > counts[0][1] and counts[1][0] > counts[1][1]  # toxic documents and near copies go
    before, after = stages[2]
    cut = after.join(before.select("doc_id", before.text.alias("old")), "doc_id").where("text <> old").count()
    assert cut > 0 and counts[2][0] == counts[2][1]
    assert {r["count"] for r in stages[3][1].groupBy("doc_id").count().collect()} != {1}  # the mix repeats documents


def test_clean_documents_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in stages[0])
    clean = [i for i in before if labels.get(i) == 0]
    toxic = [i for i in before if labels.get(i) == 1]
    assert len([i for i in clean if i in after]) > 0.95 * len(clean) and len([i for i in toxic if i in after]) < 0.4 * len(toxic)


def test_run_is_the_stages_and_takes_empty_and_odd_tables(spark, tmp_path):
    docs, labels = read(spark, SF, "documents").orderBy("doc_id").limit(60), read(spark, SF, "labels")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "one word " * 30_000, None, "b", 1)], docs.schema)
    for name, table in (("empty", docs.limit(0)), ("odd", odd), ("some", docs.unionByName(odd))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(0 if name == "empty" else 1000).write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (got.count() > 0) == (name == "some")  # of `odd`, near copies and repeats go, and the rest has no word


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = read(spark, SF, "documents").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "mixing", "bpe"]
    assert all(after.columns == columns for _, after in stages[:-1])


def test_near_dedup_keeps_the_least_id(stages):
    import xxhash
    before, after = stages[1]

    def print_of(text):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = sorted((r.doc_id, print_of(r.text)) for r in before.collect())
    group = {i: i for i, _ in prints}
    for n, (i, x) in enumerate(prints):  # brute force: all pairs
        for j, y in prints[n + 1:]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()} if a != b else group
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))


def test_passages_are_cut(stages):
    before, after = stages[2]
    raw = {r.doc_id: r.text.encode() for r in before.collect()}
    seen: dict[int, int] = {}
    L = corpus_pipeline.PASSAGE
    for t in raw.values():
        for i in range(len(t) - L + 1):
            h = hash(t[i:i + L])
            seen[h] = seen.get(h, 0) + 1
    for r in after.collect():
        t, gone = raw[r.doc_id], set()
        for i in range(len(t) - L + 1):
            if seen[hash(t[i:i + L])] > 1:
                gone.update(range(i, i + L))
        assert r.text == bytes(c for i, c in enumerate(t) if i not in gone).decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_tokens_of_the_mix(stages):
    before, after = stages[-1]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.collect()) == want


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
