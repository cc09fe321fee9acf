"""The pN_ queries of the problems on training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.knn import mutual_pairs, similar_vectors, topk_by_hash, vector_classes
from plumbline.llm.leakage import contained_items, leak_shares, leaked_items
from plumbline.llm.mixing import Mix, mix_sources
from plumbline.llm.textquality import COUNTS, SHARES, text_counts, text_quality


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lists = similar_vectors(table(spark, d, "payloads"), "chunk_id", "vector", "upsert_no", 0.95)
    return mutual_pairs(lists).toDF("chunk_id_a", "chunk_id_b")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every chunk with a usable vector: exact copies have that of their least id."""
    return vector_classes(table(spark, d, "payloads"), "chunk_id", "vector", "upsert_no").withColumnsRenamed({"id": "chunk_id"})


def p4_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks, however far, of every chunk that has an upsert_no divisible by 100."""
    p = table(spark, d, "payloads")
    return topk_by_hash(p, p.where("upsert_no % 100 = 0").select("chunk_id"), "chunk_id", "vector", "upsert_no")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each item leaked into each document."""
    return leak_shares(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_contained(spark: SparkSession, d: str) -> DataFrame:
    """Items that a document holds nearly whole: four of five of their shingles in one stretch."""
    return contained_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_ascii(spark: SparkSession, d: str) -> DataFrame:
    """p6_found of the texts whose words SQL can tell, those without any but ASCII characters."""
    plain = F.col("text").rlike(r"^[\x00-\x7F]*$")
    return leaked_items(table(spark, d, "documents").where(plain), table(spark, d, "eval_items").where(plain))


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: how often each text is taken."""
    return _mix(spark, d).texts


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _mix(spark, d).report


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, divergences and the nearest structure of every text."""
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The basic counts of every text."""
    rows = text_counts(table(spark, d, "documents"), table(spark, d, "common_words"))
    return rows.select("doc_id", *COUNTS, *(F.round(c, 9).alias(c) for c in SHARES), F.col("flags").cast("long").alias("flags"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that break two limits of natural prose, out of the rows of the whole operator."""
    return p8_stats(spark, d).where("flags >= 2 and doc_id is not null").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_classes, p4_topk, p6_found, p6_by_item, p6_shares, p6_contained, p6_ascii, p7_mix, p7_report, p8_found, p8_counts, p8_stats)}

SQL = {
    # Of the pairs at 0.95 or more the first ten of a chunk are those of all its pairs.
    "p4_found": """@VECTORS,
pairs AS MATERIALIZED (SELECT a.chunk_id AS a, b.chunk_id AS b, least(1.0, round(array_cosine_similarity(a.v, b.v), 12)) AS s FROM v a JOIN v b ON a.chunk_id < b.chunk_id
  WHERE array_cosine_similarity(a.v, b.v) > 0.9499),
near AS (SELECT a, b FROM (SELECT a, b, s FROM pairs WHERE s >= 0.95 UNION ALL SELECT b, a, s FROM pairs WHERE s >= 0.95) QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b
""",
    "p4_classes": "@VECTORS SELECT chunk_id, min(chunk_id) OVER (PARTITION BY v) AS class_id, count(*) OVER (PARTITION BY v) AS copies FROM v",
    "p8_found": r"""@COUNTED
SELECT DISTINCT doc_id FROM s WHERE flags >= 2
""",
    "p8_counts": "@COUNTED SELECT * FROM s",
    "p6_ascii": r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(lower(@JOIN(@JOIN(text))), '[a-z0-9]+') AS w FROM t WHERE regexp_full_match(text, '[\x00-\x7F]*')),
r AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT kind, id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM w))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM r d JOIN r i USING (run) WHERE d.kind = 'd' AND i.kind = 'i'
""",
}
# A word divided by a hyphen at a line end is one.
_JOINED = r"regexp_replace(@, '([a-zA-Z0-9])-[ \t\v\f]*(\r\n|[\r\n\v\f])[\s\v]*([a-zA-Z0-9])', '\1\3', 'g')"
SQL["p6_ascii"] = SQL["p6_ascii"].replace("@JOIN(@JOIN(text))", _JOINED.replace("@", _JOINED.replace("@", "text")))
_COUNTED = r"""
WITH t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS letters,
    length(regexp_replace(text, '[\s\v\x{85}\p{Z}]+', '', 'g')) AS visible,
    list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
      lambda x: regexp_replace(x, '^[\s\v\x{85}\p{Z}]+|[\s\v\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, count(*) AS common FROM (SELECT doc_id, lower(unnest(w)) AS word FROM t) WHERE word IN (SELECT word FROM common_words) GROUP BY ALL),
n AS (SELECT doc_id, len(w) AS n_words, letters, visible, len(lines) AS lines, len(list_filter(lines, lambda x: right(x, 1) IN ('.', '!', '?', '…'))) AS stopped,
  coalesce(common, 0) AS common FROM t LEFT JOIN c USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE letters / n_words END AS a, CASE WHEN visible = 0 THEN 0 ELSE (visible - letters) / visible END AS b,
  CASE WHEN lines = 0 THEN 0 ELSE stopped / lines END AS c, CASE WHEN n_words = 0 THEN 0 ELSE common / n_words END AS d FROM n),
s AS (SELECT doc_id, n_words, letters, visible, lines, stopped, common, round(a, 9) AS mean_word_length, round(b, 9) AS symbol_ratio, round(c, 9) AS stop_line_share, round(d, 9) AS common_word_share,
  ((n_words < 25)::INT + (a NOT BETWEEN 3 AND 8)::INT + (b > 0.15)::INT + (c < 0.3)::INT + (d < 0.15)::INT)::BIGINT AS flags FROM q)
"""
_VECTORS = """
WITH newest AS (SELECT chunk_id, vector FROM payloads WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
v AS MATERIALIZED (SELECT chunk_id, CASE WHEN len(vector) = 64 THEN list_transform(vector, lambda x: x::DOUBLE + 0.0)::DOUBLE[64] END AS v FROM newest
  WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
"""
SQL = {k: v.replace("@COUNTED", _COUNTED).replace("@VECTORS", _VECTORS) for k, v in SQL.items()}
