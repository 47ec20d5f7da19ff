"""Registered queries of this package: thin digests of the operators over whole tables, and SQL where SQL can say it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, htmltext, langid, maxscore, merkle, mixing, multiindex, negatives, outliers, rollups, simhash, suffix, toxicity
from tidemark.llm.common import SPACE, read

TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_multi_index(spark: SparkSession, root: str) -> DataFrame:
    return multiindex.near_vectors(read(spark, root, "embeddings"))


def op3_token_rollups(spark: SparkSession, root: str) -> DataFrame:
    """All documents enter under two tokenizer versions, toxic ones leave, poor ones count their distinct words only.

    Two batches are delivered twice.
    """
    docs, labels = read(spark, root, "documents"), read(spark, root, "labels")
    books = rollups.TokenRollup.temporary(spark)
    words = docs.select("doc_id", "source", "lang", F.lit("words-1").alias("version"), rollups.count_words().alias("tokens"))
    pieces = docs.select("doc_id", "source", "lang", F.lit("pieces-1").alias("version"), rollups.count_pieces().alias("tokens"))
    toxic = labels.where("toxic = 1").select("doc_id")
    unique = F.size(F.array_distinct(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")))
    counts = docs.select("doc_id", F.lit("words-1").alias("version"), unique.alias("tokens"))  # counted where they are read: texts stay put
    poor = counts.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    books.insert("words", words)
    books.insert("pieces", pieces)
    books.insert("words", words)
    books.delete("toxic", toxic)
    books.revise("poor", poor)
    books.delete("toxic", toxic)
    return books.totals()


def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.predict(read(spark, root, "documents"), read(spark, root, "labels"))


def op5_outliers(spark: SparkSession, root: str) -> DataFrame:
    return outliers.quality(read(spark, root, "documents"))


def op6_suffix_array(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents").select("doc_id", "text")
    return suffix.dedup(docs).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")


def op7_html_text(spark: SparkSession, root: str) -> DataFrame:
    return htmltext.extract(read(spark, root, "pages"))


def op8_mixing(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mix(docs.withColumnRenamed("size", "words"), F.col("words")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.position")
    return mixing.in_order(mixed, F.col("position"))


def op9_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_decode(read(spark, root, "documents"), public_tokenizers.path(TOKENIZER))


def op10_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, root, "documents"))


def op11_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, root, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(changed, merkle.leaf_hash(*fields[:-1], F.regexp_replace("text", "\n", "")))
    leaves = docs.select("doc_id", "source", merkle.leaf_hash(*fields).alias("leaf"), tampered.alias("tampered"))
    proven = merkle.manifest(leaves).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_top_k(spark: SparkSession, root: str) -> DataFrame:
    return maxscore.top_k(read(spark, root, "embeddings"), F.col("vec_id") % 100 == 0)


_OP8 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, [5, 2, 1][rk % 3 + 1] AS weight, [1.0, 0.5, 1.5][rk % 3 + 1]::DOUBLE AS w0, [1.0, 1.5, 0.5][rk % 3 + 1]::DOUBLE AS w1 FROM r),
m AS (SELECT *, (source_size * 3)::DOUBLE / weight AS room FROM w),
l AS (SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM m),
c AS (SELECT *, (total - used)::DOUBLE / free::DOUBLE AS lev FROM l),
v AS (SELECT arg_min(lev, (room, source)) AS level FROM c WHERE lev <= room),
t AS (SELECT source, source_size, w0, w1, least((source_size * 3)::DOUBLE, level * weight) AS target FROM c, v),
q AS (SELECT doc_id, size, source_size, w0, w1, target, floor(target + 0.5)::BIGINT AS words,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS times FROM q),
g AS (SELECT *, (times * size + greatest(0, least(size, words - times * source_size - ahead)))::BIGINT AS taken,
  ahead::DOUBLE / words AS u, 2 * w0 / (w0 + w1) AS p, 2 * w1 / (w0 + w1) AS z FROM e)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN 2 * u / (p + sqrt(p * p + 2 * (z - p) * u)) END AS position FROM g"""

_OP3 = r"""
WITH d AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
c AS (SELECT source, lang, 'words-1' AS version, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN len(list_distinct(w)) ELSE len(w) END AS t FROM d
  UNION ALL SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]')), 0) FROM d)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(t)::BIGINT AS n_tokens FROM c GROUP BY ALL"""
_OP6 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, x, unnest(range(greatest(n - 399, 0))) AS i FROM d),
k AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM w),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
p AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY r, run),
q AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS done FROM p),
a AS (SELECT q.r, count(*) AS spans, sum(hi - lo) AS gone, string_agg(substr(x, 2 * done + 1, 2 * (lo - done)), '' ORDER BY lo) AS head, max(hi) AS last FROM q JOIN d USING (r) GROUP BY q.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""
_SCORED = """
WITH v AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND {known} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""
_OP11 = _SCORED.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256, known="label IS NOT NULL") + """,
p AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""
_OP13 = _SCORED.format(label="label", scale=1024, known="true") + """
SELECT a AS query_id, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS rank, b AS vec_id, score FROM s QUALIFY rank <= 10"""
#: Levels that the SQL of the manifest unrolls: groups and sources up to 3^12.
_DEPTH = 12


def _manifest_sql() -> str:
    def tree(name: str, start: str) -> list[str]:
        """Levels of the trees in `start` (g, i, h), each as (g, i, h, m nodes in the level); lone nodes go on as they are."""
        out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM ({start}))"]
        for k in range(1, _DEPTH + 1):
            out.append(f"{name}{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM (SELECT g, i // 3 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY g, i // 3))")
        return out

    def pairs(name: str) -> str:
        """before and after of every node of every level that has several nodes."""
        return " UNION ALL ".join(f"SELECT {k} AS lev, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y "
                                  f"FROM {name}{k} a LEFT JOIN {name}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 AND a.i <> b.i WHERE a.m > 1 GROUP BY a.g, a.i" for k in range(_DEPTH))

    field = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
    plain, text = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars")), field.format("text")
    cut = field.format("replace(text, chr(10), '')")
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT)), lambda a, b: "
           "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))")
    ctes = [f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS g, sha256({plain} || {text}) AS leaf, CASE WHEN xor({crc}, 4294967295::BIGINT) % 2 = 0 THEN sha256({plain} || {cut}) END AS bad FROM documents)",
            "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
            *tree("t", "SELECT g, i, leaf AS h FROM l"),
            f"subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM t{_DEPTH})",
            *tree("u", "SELECT 0 AS g, i, h FROM subroots"),
            f"steps AS (SELECT lev, g, i, x, y FROM ({pairs('t')}))",
            f"tops AS (SELECT lev + {_DEPTH} AS lev, i, x, y FROM ({pairs('u')}))",
            "path AS (SELECT l.r, s.lev, s.x, s.y FROM l JOIN steps s ON s.g = l.g AND s.i = l.i // (3 ** s.lev)::BIGINT"
            f" UNION ALL SELECT l.r, s.lev, s.x, s.y FROM l JOIN subroots q USING (g) JOIN tops s ON s.i = q.i // (3 ** (s.lev - {_DEPTH}))::BIGINT)",
            "proof AS (SELECT r, list([x, y] ORDER BY lev) AS p, sha256(string_agg(x || y, '' ORDER BY lev)) AS proof_sha256 FROM path GROUP BY r)",
            f"f AS (SELECT l.doc_id, l.leaf, q.h AS subroot, (SELECT h FROM u{_DEPTH}) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,"
            " list_reduce(list_prepend([coalesce(l.bad, l.leaf), ''], coalesce(p, [])), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] AS folded_root FROM l JOIN subroots q USING (g) LEFT JOIN proof USING (r))"]
    return "WITH " + ",\n".join(ctes) + "\nSELECT *, folded_root = root AS verified FROM f"


QUERIES = {f.__name__: f for f in (op1_language_id, op2_multi_index, op3_token_rollups, op4_toxicity, op5_outliers, op6_suffix_array, op7_html_text, op8_mixing, op9_bpe, op10_simhash,
                                  op11_hard_negatives, op12_merkle_manifest, op13_top_k)}
#: The others have no SQL: learned models, iterated estimates, seeded XXH64, HTML and tokenizer automata.
ORACLES = {"op3_token_rollups": _OP3, "op6_suffix_array": _OP6, "op8_mixing": _OP8, "op11_hard_negatives": _OP11, "op12_merkle_manifest": _manifest_sql(), "op13_top_k": _OP13}
