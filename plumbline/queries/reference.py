"""Queries of the audit operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import canonical as C
from plumbline.functions import text as T
from plumbline.functions import units as U
from plumbline.functions import vectors as V
from plumbline.operators import baseline as B
from plumbline.operators import chunks as K
from plumbline.operators import cost, export_audit, ingestion, orphans, reconcile, reports, runs, vectors
from plumbline.plans.ledger import deletion_summaries, last_commits
from plumbline.plans.planning import chunk_actions, removal_counts
from plumbline.queries.problems import table
from plumbline.sources.records import comparable_hash
from plumbline.streaming.audit_stream import windowed_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: SQL for the character class of white space, and for a text's normal form.
_WS = T.WS


class _Sql(str):
    """SQL with a place for a column, marked @."""

    def of(self, column: str) -> str:
        return self.replace("@", column)


_NORM = _Sql(f"trim(regexp_replace(@, '{_WS}+', ' ', 'g'), ' ')")
_STRIP = _Sql(f"regexp_replace(@, '^{_WS}+|{_WS}+$', '', 'g')")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as chunks."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_index"), "text", "document_id", "source_version", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata"))


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def numbered_findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").dropDuplicates(["finding_id"])


_DUP = f"""
WITH t AS (SELECT doc_id, {_NORM.of('text')} AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id AS chunk_index, min(doc_id) OVER (PARTITION BY n) AS first FROM t WHERE n <> '')
"""


@query(_DUP + "SELECT chunk_index, first FROM f WHERE chunk_index <> first")
def duplicate_text(spark, d):
    return K.duplicate_texts(K.chunk_table(document_chunks(spark, d))).select("chunk_index", F.col("related")[0].alias("first"))


@query(f"""
WITH t AS (SELECT doc_id, source, lang, text, length({_STRIP.of('text')}) AS n FROM documents)
SELECT doc_id AS chunk_index, 'invalid_text' AS code FROM t WHERE text IS NULL
UNION ALL SELECT doc_id, 'empty_text' FROM t WHERE n = 0
UNION ALL SELECT doc_id, 'short_chunk' FROM t WHERE n > 0 AND n < 80
UNION ALL SELECT doc_id, 'token_limit' FROM t WHERE n > 0 AND len(string_split_regex({_STRIP.of('text')}, '{_WS}+')) > 300
UNION ALL SELECT doc_id, 'missing_metadata' FROM t WHERE source IS NULL OR {_STRIP.of('source')} = ''
UNION ALL SELECT doc_id, 'missing_metadata' FROM t WHERE lang IS NULL OR {_STRIP.of('lang')} = ''
""")
def chunk_row_findings(spark, d):
    policy = K.ChunkPolicy(required_metadata=("source", "lang"), min_chars=80, max_tokens=300, token_counter=lambda c: F.size(T.words(c)))
    return K.row_findings(K.chunk_table(document_chunks(spark, d)), policy).select("chunk_index", "code")


@query(f"""
WITH t AS (SELECT length({_STRIP.of('text')}) AS n FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS count, coalesce(min(n), 0)::BIGINT AS min, coalesce(median(n), 0)::DOUBLE AS median, coalesce(quantile_disc(n, 0.95), 0)::BIGINT AS p95, coalesce(max(n), 0)::BIGINT AS max FROM t WHERE n > 0
""")
def length_statistics(spark, d):
    return K.length_statistics(K.chunk_table(document_chunks(spark, d)))


_LINES = f"""
WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{T.LINE}'), lambda x: {_NORM.of('x')}), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL AND {_STRIP.of('text')} <> ''),
b AS (SELECT doc_id, unnest(list_distinct([l[1], l[-1]])) AS line FROM t WHERE len(l) >= 2),
c AS (SELECT * FROM b WHERE length(line) >= 12)
"""


@query(_LINES + """
SELECT doc_id AS chunk_index, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY line) AS n FROM c)
WHERE n >= greatest(3, ceil(0.005 * (SELECT count(*) FROM t)))
""")
def repeated_boilerplate(spark, d):
    policy = K.ChunkPolicy(boilerplate_ratio=0.005)
    found = K.repeated_boilerplate(K.chunk_table(document_chunks(spark, d)), policy)
    return found.select("chunk_index", F.regexp_extract("message", r"(\d+)", 1).cast("bigint").alias("n"))


@query(_LINES + "SELECT line, count(*) AS chunks FROM c GROUP BY line")
def boundary_line_counts(spark, d):
    return K.boundary_line_counts(K.chunk_table(document_chunks(spark, d)))


_TERMS = r"""
WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM documents
  WHERE text IS NOT NULL AND @FILLED),
df AS (SELECT term, count(*) AS n FROM e GROUP BY term)
""".replace("@FILLED", f"{_STRIP.of('text')} <> ''")


@query(_TERMS + f"""
, n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND {_STRIP.of('text')} <> '')
SELECT doc_id AS chunk_index FROM e JOIN df USING (term) GROUP BY doc_id HAVING count(*) >= 3 AND min(df.n) / (SELECT n FROM n) >= 0.01
""")
def low_distinctiveness(spark, d):
    return K.low_distinctiveness(K.chunk_table(document_chunks(spark, d)), K.ChunkPolicy(distinctive_term_fraction=0.01)).select("chunk_index")


@query(_TERMS + "SELECT term, n AS chunks FROM df")
def term_frequencies(spark, d):
    return K.term_frequencies(K.chunk_table(document_chunks(spark, d))).where("term <> ''")


@query(_DUP + """
, i AS (
  SELECT 'duplicate_text' AS code, 'warning' AS severity, chunk_index, [first] AS related FROM f WHERE chunk_index <> first
  UNION ALL SELECT 'invalid_text', 'error', doc_id, [] FROM documents WHERE text IS NULL
  UNION ALL SELECT 'empty_text', 'error', doc_id, [] FROM t WHERE n = ''),
a AS (SELECT code, severity, unnest(list_distinct(list_append(related, chunk_index))) AS c FROM i),
k AS (SELECT code, severity, count(DISTINCT c) AS affected_chunks, list_sort(list(DISTINCT c))[1:5] AS chunk_indices FROM a GROUP BY ALL)
SELECT code, severity, count(*) AS occurrences, any_value(affected_chunks) AS affected_chunks, any_value(chunk_indices) AS chunk_indices FROM i JOIN k USING (code, severity) GROUP BY code, severity
""")
def chunk_audit_by_code(spark, d):
    t = K.chunk_table(document_chunks(spark, d))
    found = K.row_findings(t, K.ChunkPolicy(required_metadata=())).unionByName(K.duplicate_texts(t))
    return reports.by_code(found)


@query("""
WITH f AS (SELECT DISTINCT ON (finding_id) * FROM findings),
a AS (SELECT DISTINCT code, severity, unnest(list_append(coalesce(related, []), chunk_index)) AS c FROM f),
k AS (SELECT code, severity, count(c) AS affected_chunks, coalesce(list_sort(list(c) FILTER (c IS NOT NULL))[1:5], []) AS chunk_indices FROM a GROUP BY ALL)
SELECT code, severity, n AS occurrences, coalesce(affected_chunks, 0) AS affected_chunks, coalesce(chunk_indices, []) AS chunk_indices
FROM (SELECT code, severity, count(*) AS n FROM f GROUP BY ALL) LEFT JOIN k USING (code, severity)
""")
def findings_by_code(spark, d):
    return reports.by_code(numbered_findings(spark, d))


@query("SELECT code, severity, count(DISTINCT finding_id) AS occurrences FROM findings GROUP BY ALL")
def findings_metrics(spark, d):
    return reports.metrics(numbered_findings(spark, d))


@query("""
SELECT document_id, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
FROM (SELECT DISTINCT ON (finding_id) * FROM findings) GROUP BY ALL
""")
def findings_by_document(spark, d):
    return reports.by_document(numbered_findings(spark, d))


@query("""
WITH f AS (SELECT DISTINCT ON (finding_id) * FROM findings)
SELECT code, severity, count(*) AS occurrences, list(message ORDER BY finding_id)[1:3] AS examples FROM f GROUP BY ALL
""")
def finding_examples(spark, d):
    return reports.examples(numbered_findings(spark, d), F.col("finding_id"), F.col("message"), 3)


@query("""
SELECT date_trunc('day', found_at) AS window_start, code, count(*) AS occurrences FROM (SELECT DISTINCT ON (finding_id) * FROM findings) WHERE found_at IS NOT NULL GROUP BY ALL
""")
def findings_per_day(spark, d):
    return windowed_codes(numbered_findings(spark, d), "found_at")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey::VARCHAR AS document_id, l_linenumber::VARCHAR AS chunk_key, count(*) - 1 AS repeats FROM l GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_chunk_keys(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("string").alias("chunk_key"), F.monotonically_increasing_id().alias("chunk_index"), F.lit("").alias("text"))
    found = ingestion.duplicate_keys(K.chunk_table(rows))
    return found.groupBy("document_id", "chunk_key").agg(F.count("*").alias("repeats"))


@query(f"""
WITH u AS (SELECT source AS document_id, doc_id AS unit, length({_STRIP.of('text')}) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT document_id, count(*) AS units, median(n) AS mid FROM u GROUP BY ALL)
SELECT u.document_id, unit::VARCHAR AS unit FROM u JOIN m ON u.document_id = m.document_id WHERE units >= 5 AND mid >= 200 AND n < mid * 0.1
""")
def unit_yield(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("unit"), "text", F.col("doc_id").alias("chunk_index"))
    return ingestion.unit_yield(rows.where("document_id is not null")).select("document_id", F.regexp_extract("message", r"^Unit (\S+)", 1).alias("unit"))


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An ingestion batch from the tables: the newest inventories, what the store's entries claim, the payloads."""
    own = lambda c: F.concat_ws("/", F.col("namespace"), c).alias("document_id")
    unit = lambda c: F.regexp_extract(c, "^([^#]*)", 1)
    states, chunks = table(spark, d, "document_states"), table(spark, d, "chunk_states")
    last = states.groupBy("namespace").agg(F.max("snapshot_no").alias("snapshot_no"))
    docs = newest(states.join(last, ["namespace", "snapshot_no"]), ["namespace", "document_id"], "loaded_at").select("namespace", own(F.col("document_id")), "source_version")
    units = chunks.join(last, ["namespace", "snapshot_no"]).where("chunk_key is not null").groupBy(own(F.col("document_id"))).agg(F.collect_set(unit(F.col("chunk_key"))).alias("expected_units"))
    legacy = F.coalesce(F.exists("expected_units", lambda u: u.startswith("page:")), F.lit(False))
    documents = docs.join(units, "document_id", "left").select("document_id", "source_version", "expected_units", legacy.alias("legacy"))
    ids = table(spark, d, "ids")
    seen = newest(ids.where("observed > 0"), ["namespace", "id"], "entry_no").where("source_id is not null")
    parts = seen.select(own(F.col("source_id")), "source_version", "text_hash", "vector_norm", "enumerated_at", F.explode_outer("units").alias("unit"))
    # A unit of a chunk without text hash was empty, one of a chunk without vector failed.
    receipts = parts.groupBy("document_id").agg(
        F.max("source_version").alias("source_version"), F.collect_set("unit").alias("processed_units"), F.collect_set(F.when(F.col("text_hash").isNull(), F.col("unit"))).alias("empty_units"),
        F.collect_set(F.when(F.col("vector_norm").isNull(), F.col("unit"))).alias("failed_units"), F.bool_and(F.col("enumerated_at").isNotNull()).alias("completed"),
    )
    version = newest(ids.where("expected > 0"), ["namespace", "id"], "entry_no").select(F.col("id").alias("chunk_id"), "source_version")
    stored = newest(table(spark, d, "payloads"), ["chunk_id"], "upsert_no").join(version, "chunk_id", "left")
    md = lambda k: F.try_element_at("metadata", F.lit(k))
    stored = stored.select(
        F.col("upsert_no").alias("chunk_index"), "text", md("chunk_key").alias("chunk_key"), own(md("source_id")), "source_version", "namespace",
        F.when(md("chunk_key").isNotNull(), F.array(unit(md("chunk_key")))).alias("units"), F.create_map(F.lit("source"), md("source_id")).alias("metadata"),
    )
    return documents, receipts, stored


_BATCH = f"""
WITH last AS (SELECT namespace, max(snapshot_no) AS snapshot_no FROM document_states GROUP BY ALL),
docs AS (
  SELECT concat_ws('/', namespace, document_id) AS document_id, source_version FROM document_states JOIN last USING (namespace, snapshot_no)
  QUALIFY row_number() OVER (PARTITION BY namespace, document_id ORDER BY loaded_at DESC) = 1),
unit AS (SELECT concat_ws('/', namespace, document_id) AS document_id, list(DISTINCT split_part(chunk_key, '#', 1)) AS units FROM chunk_states JOIN last USING (namespace, snapshot_no) WHERE chunk_key IS NOT NULL GROUP BY ALL),
inv AS (SELECT docs.document_id, source_version, units, coalesce(len(list_filter(units, lambda x: starts_with(x, 'page:'))) > 0, FALSE) AS legacy FROM docs LEFT JOIN unit ON docs.document_id = unit.document_id),
seen AS (SELECT * FROM ids WHERE observed > 0 QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY entry_no DESC) = 1),
rec AS (SELECT concat_ws('/', namespace, source_id) AS document_id, max(source_version) AS version, list_distinct(flatten(list(coalesce(units, [])))) AS processed,
    list_distinct(flatten(list(CASE WHEN text_hash IS NULL THEN coalesce(units, []) ELSE [] END))) AS empty, list_distinct(flatten(list(CASE WHEN vector_norm IS NULL THEN coalesce(units, []) ELSE [] END))) AS failed,
    bool_and(enumerated_at IS NOT NULL) AS completed FROM seen WHERE source_id IS NOT NULL GROUP BY ALL),
ver AS (SELECT id AS chunk_id, source_version FROM ids WHERE expected > 0 QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY entry_no DESC) = 1),
pay AS (SELECT * FROM payloads QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
c AS (
  SELECT upsert_no, text, namespace, metadata['chunk_key'] AS key, concat_ws('/', namespace, metadata['source_id']) AS document_id, metadata['source_id'] AS source, source_version AS version,
    split_part(metadata['chunk_key'], '#', 1) AS unit, text IS NOT NULL AND {_STRIP.of('text')} <> '' AS filled
  FROM pay LEFT JOIN ver USING (chunk_id)),
j AS (SELECT c.*, i.document_id IS NOT NULL AS known, i.source_version AS want, i.units AS expected, i.legacy FROM c LEFT JOIN inv i ON c.document_id = i.document_id),
good AS (SELECT * FROM j WHERE known AND filled AND key IS NOT NULL AND {_STRIP.of('coalesce(unit, $$$$)')} <> ''),
cov AS (SELECT document_id, list(DISTINCT unit) AS covered, count(*) AS chunks FROM good GROUP BY ALL),
e AS (SELECT i.*, r.document_id IS NOT NULL AS has, version, completed, coalesce(processed, []) AS processed, coalesce(empty, []) AS empty, coalesce(failed, []) AS failed, coalesce(covered, []) AS covered, coalesce(chunks, 0) AS chunks,
    CASE WHEN legacy THEN 'pages' ELSE 'units' END AS many, CASE WHEN legacy THEN 'page' ELSE 'unit' END AS one,
    list_filter(units, lambda x: NOT list_contains(coalesce(empty, []), x) AND NOT list_contains(coalesce(covered, []), x)) AS lost
  FROM inv i LEFT JOIN rec r ON i.document_id = r.document_id LEFT JOIN cov ON i.document_id = cov.document_id)
""".replace("$$$$", "''")


@query(_BATCH + f"""
, lines AS (
  SELECT upsert_no, document_id, unnest(list_distinct([l[1], l[-1]])) AS line FROM (
    SELECT upsert_no, document_id, list_filter(list_transform(string_split_regex(text, '{T.LINE}'), lambda x: {_NORM.of('x')}), lambda x: x <> '') AS l FROM c WHERE filled) WHERE len(l) >= 2),
often AS (SELECT line FROM lines WHERE length(line) >= 12 GROUP BY line HAVING count(*) >= greatest(3, ceil(0.5 * (SELECT count(*) FROM c WHERE filled)))),
-- Documents with any chunk that doesn't name just one nonblank unit or lacks text are ambiguous.
part AS (SELECT document_id, unit, text, upsert_no, filled FROM c WHERE document_id NOT IN (SELECT document_id FROM c WHERE text IS NULL OR key IS NULL OR {_STRIP.of('coalesce(unit, $$$$)')} = '')),
size AS (SELECT document_id, unit, coalesce(length({_STRIP.of("string_agg(text, '' ORDER BY upsert_no) FILTER (filled)")}), 0) AS n FROM part GROUP BY ALL),
mid AS (SELECT document_id, count(*) AS units, median(n) AS mid FROM size GROUP BY ALL),
f AS (
  SELECT 'unexpected_receipt' AS code, document_id FROM rec WHERE document_id NOT IN (SELECT document_id FROM inv)
  UNION ALL SELECT 'invalid_text', document_id FROM c WHERE text IS NULL
  UNION ALL SELECT 'empty_text', document_id FROM c WHERE text IS NOT NULL AND NOT filled
  UNION ALL SELECT 'missing_metadata', document_id FROM c WHERE source IS NULL OR {_STRIP.of('source')} = ''
  UNION ALL SELECT 'duplicate_text', document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY {_NORM.of('text')} ORDER BY upsert_no) AS rn FROM c WHERE filled) WHERE rn > 1
  UNION ALL SELECT 'repeated_boilerplate', document_id FROM lines WHERE line IN (SELECT line FROM often)
  UNION ALL SELECT 'low_unit_text_yield', size.document_id FROM size JOIN mid ON size.document_id = mid.document_id WHERE units >= 5 AND mid >= 200 AND n < mid * 0.1
  UNION ALL SELECT 'unexpected_chunk_document', NULL FROM j WHERE NOT known
  UNION ALL SELECT 'chunk_version_mismatch', document_id FROM j WHERE known AND version IS DISTINCT FROM want
  UNION ALL SELECT 'invalid_chunk_key', document_id FROM j WHERE known AND (key IS NULL OR {_STRIP.of('key')} = '')
  UNION ALL SELECT 'unexpected_chunk_' || CASE WHEN legacy THEN 'page' ELSE 'unit' END, document_id FROM j WHERE known AND key IS NOT NULL AND expected IS NOT NULL AND NOT list_contains(expected, unit)
  UNION ALL SELECT 'duplicate_chunk_key', document_id FROM (SELECT document_id, key, row_number() OVER (PARTITION BY document_id, key ORDER BY upsert_no) AS rn FROM j WHERE known AND {_STRIP.of('key')} <> '') WHERE rn > 1
  UNION ALL SELECT 'missing_receipt', document_id FROM e WHERE NOT has
  UNION ALL SELECT 'receipt_version_mismatch', document_id FROM e WHERE has AND version IS DISTINCT FROM source_version
  UNION ALL SELECT 'extraction_incomplete', document_id FROM e WHERE has AND NOT completed
  UNION ALL SELECT 'failed_' || many, document_id FROM e WHERE has AND len(failed) > 0
  UNION ALL SELECT 'processed_' || many || '_mismatch', document_id FROM e WHERE has AND units IS NOT NULL AND list_sort(processed) <> list_sort(units)
  UNION ALL SELECT 'invalid_receipt_' || many, document_id FROM e WHERE has AND (NOT list_has_all(processed, empty) OR (units IS NOT NULL AND NOT list_has_all(units, failed)) OR list_has_any(failed, processed))
  UNION ALL SELECT 'unapproved_empty_' || many, document_id FROM e WHERE has AND len(empty) > 0
  UNION ALL SELECT 'empty_' || one || '_has_chunks', document_id FROM e WHERE has AND list_has_any(empty, covered)
  UNION ALL SELECT 'completeness_unverified', document_id FROM e WHERE units IS NULL
  UNION ALL SELECT 'missing_chunk_' || many, document_id FROM e WHERE units IS NOT NULL AND len(lost) > 0
  UNION ALL SELECT 'insufficient_chunks', document_id FROM e WHERE chunks < 1)
SELECT code, document_id, count(*) AS n FROM f GROUP BY ALL
""".replace("$$$$", "''"))
def ingestion_audit(spark, d):
    return ingestion.audit_ingestion(*batch(spark, d)).findings.groupBy("code", "document_id").agg(F.count("*").alias("n"))


@query(_BATCH + "SELECT count(DISTINCT document_id) AS documents_audited, coalesce(sum(len(lost)), 0)::BIGINT AS missing_units, (SELECT count(*) FROM c) AS chunks_audited FROM e")
def ingestion_measurements(spark, d):
    return ingestion.audit_ingestion(*batch(spark, d)).measurements


@query(_BATCH + """
SELECT 'namespace_mismatch' AS code, upsert_no AS chunk_index FROM c WHERE namespace <> (SELECT max(namespace) FROM payloads)
UNION ALL SELECT 'namespace_missing', upsert_no FROM c WHERE namespace IS NULL
""")
def namespace_audit(spark, d):
    """The batch of all namespaces, audited as that of the last one."""
    one = table(spark, d, "payloads").agg(F.max("namespace")).first()[0]
    found = ingestion.audit_ingestion(*batch(spark, d), ingestion.AcceptancePolicy(require_namespace=True), one).findings
    return found.where(F.col("code").startswith("namespace_")).select("code", "chunk_index")


@query("SELECT document_id FROM document_states GROUP BY document_id HAVING count(*) > 1")
def repeated_documents(spark, d):
    return ingestion.repeated(table(spark, d, "document_states"), "duplicate_document", "").where("document_id is not null").select("document_id")


_COUNTS = """
WITH c AS (SELECT id, count(*) FILTER (expected > 0) AS e, count(*) FILTER (observed > 0) AS o FROM ids GROUP BY id)
"""


@query(_COUNTS + """
SELECT count(*) FILTER (e > 0) AS expected_count, count(*) FILTER (o > 0) AS observed_count, count(*) FILTER (e > 0 AND o = 0) AS missing_count,
  count(*) FILTER (o > 0 AND e = 0) AS orphan_count, sum(greatest(e - 1, 0))::BIGINT AS duplicate_expected_count, sum(greatest(o - 1, 0))::BIGINT AS duplicate_observed_count FROM c
""")
def reconcile_counts(spark, d):
    ids = table(spark, d, "ids")
    return reconcile.reconcile_counts(reconcile.id_counts(ids.where("expected > 0").select("id"), ids.where("observed > 0").select("id")))


@query(_COUNTS + "SELECT id FROM c WHERE e > 0 AND o = 0 ORDER BY id LIMIT 100")
def reconcile_missing_sample(spark, d):
    ids = table(spark, d, "ids")
    return reconcile.sample_ids(reconcile.id_counts(ids.where("expected > 0").select("id"), ids.where("observed > 0").select("id")), "observed = 0", 100)


@query("""
WITH c AS (SELECT namespace, id, count(*) FILTER (expected > 0) AS e, count(*) FILTER (observed > 0) AS o FROM ids WHERE id IS NOT NULL AND namespace IS NOT NULL GROUP BY ALL),
n AS (SELECT namespace, count(*) FILTER (e > 0) AS expected_count, count(*) FILTER (o > 0) AS observed_count, count(*) FILTER (e > 0 AND o = 0) AS missing_count, count(*) FILTER (o > 0 AND e = 0) AS orphan_count,
    sum(greatest(e - 1, 0))::BIGINT AS duplicate_expected_count, sum(greatest(o - 1, 0))::BIGINT AS duplicate_observed_count,
    coalesce(list_sort(list(id) FILTER (e > 0 AND o = 0))[1:3], []) AS missing_ids, coalesce(list_sort(list(id) FILTER (o > 0 AND e = 0))[1:3], []) AS orphan_ids FROM c WHERE e + o > 0 GROUP BY ALL),
a AS (SELECT namespace, bool_and(coalesce(inventory_complete, FALSE)) AS inventory_complete FROM reconciliation_reports WHERE namespace IS NOT NULL GROUP BY ALL)
SELECT a.namespace, inventory_complete, coalesce(expected_count, 0) AS expected_count, coalesce(observed_count, 0) AS observed_count, coalesce(missing_count, 0) AS missing_count, coalesce(orphan_count, 0) AS orphan_count,
  coalesce(duplicate_expected_count, 0) AS duplicate_expected_count, coalesce(duplicate_observed_count, 0) AS duplicate_observed_count, coalesce(missing_ids, []) AS missing_ids, coalesce(orphan_ids, []) AS orphan_ids,
  inventory_complete AND coalesce(missing_count + orphan_count + duplicate_expected_count + duplicate_observed_count, 0) = 0 AS passed FROM a LEFT JOIN n USING (namespace)
""")
def reconciled_inventories(spark, d):
    ids = table(spark, d, "ids").where("namespace is not null")
    said = table(spark, d, "reconciliation_reports").where("namespace is not null").groupBy("namespace").agg(F.bool_and(F.coalesce("inventory_complete", F.lit(False))).alias("inventory_complete"))
    return reconcile.reconcile(ids.where("expected > 0").select("namespace", "id"), ids.where("observed > 0").select("namespace", "id"), said, max_examples=3)


_STREAMS = """
WITH s AS (SELECT 'enumerated' AS stream, chunk_id AS id FROM chunk_states UNION ALL SELECT 'processed', chunk_id FROM payloads
  UNION ALL SELECT 'failed', chunk_id FROM payloads WHERE vector IS NULL OR text IS NULL),
c AS (SELECT id, count(*) FILTER (stream = 'enumerated') AS e, count(*) FILTER (stream = 'processed') AS p, count(*) FILTER (stream = 'failed') AS f FROM s GROUP BY id)
"""


def streams(spark: SparkSession, d: str) -> DataFrame:
    """A run's streams: chunks enumerated from the snapshots, stored, and stored without text or vector."""
    p = table(spark, d, "payloads")
    tag = lambda df, s: df.select(F.lit(s).alias("stream"), F.col("chunk_id").alias("id"))
    return tag(table(spark, d, "chunk_states"), "enumerated").unionByName(tag(p, "processed")).unionByName(tag(p.where("vector is null or text is null"), "failed"))


@query(_STREAMS + """
, x AS (
  SELECT id, [CASE WHEN e > 1 THEN 'duplicate_run_id' END, CASE WHEN p > 1 THEN 'duplicate_run_id' END, CASE WHEN f > 1 THEN 'duplicate_run_id' END,
    CASE WHEN e = 0 THEN 'unexpected_run_record' END, CASE WHEN f > 0 THEN 'run_processing_failed' END,
    CASE WHEN p > 0 AND f > 0 THEN 'conflicting_run_outcome' END, CASE WHEN e > 0 AND p + f = 0 THEN 'run_processing_missing' END] AS codes FROM c)
SELECT id, code, count(*) AS n FROM (SELECT id, unnest(codes) AS code FROM x) WHERE code IS NOT NULL GROUP BY ALL
""")
def run_findings(spark, d):
    return runs.run_findings(streams(spark, d)).groupBy(F.col("document_id").alias("id"), "code").agg(F.count("*").alias("n"))


_RUNS = """
WITH one AS (SELECT DISTINCT ON (report_no) * FROM reconciliation_reports),
runs AS (SELECT report_no::VARCHAR AS run_id, coalesce(inventory_complete, FALSE) AS listed, orphan_count <> missing_count AS moved, expected_count = observed_count AS steady FROM one),
s AS (
  SELECT run_id, 'processed' AS stream, document_id AS id FROM findings WHERE severity = 'error' UNION ALL SELECT run_id, 'enumerated', document_id FROM findings
  UNION ALL SELECT report_no::VARCHAR, 'enumerated', unnest(missing_ids) FROM one UNION ALL SELECT report_no::VARCHAR, 'failed', unnest(orphan_ids) FROM one),
c AS (SELECT run_id, id, count(*) FILTER (stream = 'enumerated') AS e, count(*) FILTER (stream = 'processed') AS p, count(*) FILTER (stream = 'failed') AS f FROM s WHERE id IS NOT NULL AND run_id IN (SELECT run_id FROM runs) GROUP BY ALL),
x AS (
  SELECT run_id, [CASE WHEN e > 1 THEN 'duplicate_run_id' END, CASE WHEN p > 1 THEN 'duplicate_run_id' END, CASE WHEN f > 1 THEN 'duplicate_run_id' END,
    CASE WHEN e = 0 THEN 'unexpected_run_record' END, CASE WHEN f > 0 THEN 'run_processing_failed' END,
    CASE WHEN p > 0 AND f > 0 THEN 'conflicting_run_outcome' END, CASE WHEN e > 0 AND p + f = 0 THEN 'run_processing_missing' END] AS codes FROM c),
f AS (
  SELECT run_id, code FROM (SELECT run_id, unnest(codes) AS code FROM x) WHERE code IS NOT NULL
  UNION ALL SELECT run_id, 'run_enumeration_incomplete' FROM runs WHERE NOT listed
  UNION ALL SELECT run_id, 'source_changed_during_run' FROM runs WHERE moved)
"""


def many_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each reconciliation report as a run: its missing ids were enumerated, its orphans failed."""
    r = table(spark, d, "reconciliation_reports").dropDuplicates(["report_no"])
    f = table(spark, d, "findings")
    run = F.col("report_no").cast("string").alias("run_id")
    listed = F.col("inventory_complete")
    runs_ = r.select(
        run, listed.alias("enumeration_completed"), listed.alias("pagination_completed"), F.lit("complete").alias("scope"),
        F.col("missing_count").cast("string").alias("start_watermark"), F.col("orphan_count").cast("string").alias("end_watermark"), (F.col("expected_count") == F.col("observed_count")).alias("consistent_snapshot"),
    )
    row = lambda df, stream, id, who=run: df.select(who, F.lit(stream).alias("stream"), id.alias("id"))
    parts = [
        row(r, "enumerated", F.explode("missing_ids")), row(r, "failed", F.explode("orphan_ids")), row(f, "enumerated", F.col("document_id"), F.col("run_id")),
        row(f.where("severity = 'error'"), "processed", F.col("document_id"), F.col("run_id")),
    ]
    streams_ = parts[0]
    for p in parts[1:]:
        streams_ = streams_.unionByName(p)
    return runs_, streams_


@query(_RUNS + "SELECT run_id, code, count(*) AS n FROM f GROUP BY ALL")
def audited_runs(spark, d):
    return runs.audit_runs(*many_runs(spark, d)).groupBy("run_id", "code").agg(F.count("*").alias("n"))


@query(_RUNS + """
, n AS (SELECT run_id, count(*) AS n FROM f GROUP BY ALL)
SELECT run_id, coalesce(n, 0) AS findings, NOT coalesce(steady, FALSE) AS moving, coalesce(n, 0) = 0 AND listed AND coalesce(steady, FALSE) AND NOT coalesce(moved, FALSE) AS deletion_eligible FROM runs LEFT JOIN n USING (run_id)
""")
def run_verdicts(spark, d):
    out = runs.run_verdicts(*many_runs(spark, d))
    return out.select("run_id", "findings", F.array_contains("unverified", "source_snapshot_consistency").alias("moving"), "deletion_eligible")


@query(_STREAMS + """
SELECT count(*) FILTER (e > 0) AS records_enumerated, count(*) FILTER (p > 0) AS records_processed, count(*) FILTER (f > 0) AS records_failed, count(*) FILTER (e > 0 AND p + f = 0) AS records_missing FROM c
""")
def run_measurements(spark, d):
    return runs.run_measurements(streams(spark, d))


def export(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index export, and as sources every document of the snapshots with a digest of its latest version."""
    comparable = comparable_hash(F.col("source_fingerprint"))
    r = table(spark, d, "records").dropDuplicates(["record_no"])
    records = r.select(
        F.col("record_no").alias("line"), "id", "source", "source_version", F.array_sort("units").alias("units"), "text", F.col("text").isNotNull().alias("has_text"), comparable.alias("fingerprint"),
        F.to_json(F.struct("id", "source", "source_version", "units", "text", "source_fingerprint")).alias("payload"), F.lit(None).cast("string").alias("error"),
    )
    s = table(spark, d, "document_states").groupBy(F.col("document_id").alias("source")).agg(F.sha2(F.max("source_version"), 256).alias("hash"))
    return records, s.withColumn("units", F.array(F.lit("file"), F.lit("page:1")))


_SRC = """
WITH r AS (SELECT DISTINCT ON (record_no) *, CASE WHEN source_fingerprint.algorithm = 'sha256' AND source_fingerprint.basis = 'file_bytes' THEN source_fingerprint.value END AS fp FROM records),
s AS (SELECT document_id AS source, sha256(max(source_version)) AS hash FROM document_states GROUP BY ALL)
"""


@query(_SRC + f"""
, first AS (SELECT id, min(record_no) AS n FROM r GROUP BY id),
p AS (SELECT record_no, id, struct_pack(a := source, b := source_version, c := units, d := text, e := source_fingerprint) AS v FROM r)
SELECT record_no AS line, 'empty_indexed_text' AS code FROM r WHERE text IS NOT NULL AND {_STRIP.of('text')} = ''
UNION ALL SELECT record_no, 'source_hash_mismatch' FROM r JOIN s USING (source) WHERE fp <> hash
UNION ALL SELECT p.record_no, CASE WHEN p.v IS NOT DISTINCT FROM q.v THEN 'duplicate_index_record' ELSE 'conflicting_index_record' END
  FROM p JOIN first f ON p.id = f.id AND p.record_no <> f.n JOIN p q ON q.record_no = f.n
""")
def index_record_findings(spark, d):
    records, sources = export(spark, d)
    found = export_audit.line_findings(records, sources).unionByName(export_audit.repeated_records(records))
    return found.select(F.col("chunk_index").alias("line"), "code")


@query(_SRC + f"""
, v AS (SELECT source FROM r WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT fp) > 1 UNION SELECT source FROM r WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT source_version) > 1),
cov AS (SELECT DISTINCT source, unnest(units) AS unit FROM r WHERE NOT (text IS NOT NULL AND {_STRIP.of('text')} = ''))
SELECT 'conflicting_source_versions' AS code, source AS document_id, '' AS message FROM v
UNION ALL SELECT 'source_not_indexed', source, '' FROM s WHERE source NOT IN (SELECT source FROM r WHERE source IS NOT NULL)
UNION ALL SELECT 'indexed_source_orphan', source, '' FROM (SELECT DISTINCT source FROM r) WHERE source NOT IN (SELECT source FROM s) AND lower(regexp_extract(source, '[^./][^/]*(\\.[^./]+)$', 1)) IN ('.txt', '.md', '.rst', '.pdf')
UNION ALL SELECT 'missing_indexed_unit', source, unit FROM (SELECT source, unnest(['file', 'page:1']) AS unit FROM s) w WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.source = w.source AND cov.unit = w.unit)
""")
def index_source_findings(spark, d):
    records, sources = export(spark, d)
    parts = [export_audit.conflicting_versions(records), *(f(records, sources) for f in (export_audit.sources_not_indexed, export_audit.orphan_sources, export_audit.missing_units))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select("code", "document_id", "message")


@query("""
WITH x AS (SELECT DISTINCT id FROM ids WHERE expected > 0),
e AS (SELECT DISTINCT ON (upsert_no) upsert_no AS i, chunk_id, vector::DOUBLE[] AS v FROM payloads),
k AS (SELECT e.*, x.id IS NOT NULL AS known, coalesce(len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0, FALSE) AS finite FROM e LEFT JOIN x ON e.chunk_id = x.id),
first AS (SELECT *, min(i) OVER (PARTITION BY chunk_id) AS f FROM k WHERE known),
twin AS (SELECT i, min(i) OVER (PARTITION BY list_transform(v, lambda c: c + 0.0)) AS f FROM first WHERE i = f AND finite AND len(v) = 64)
SELECT i AS chunk_index, 'unexpected_embedding' AS code FROM k WHERE NOT known
UNION ALL SELECT i, 'invalid_vector' FROM k WHERE v IS NULL
UNION ALL SELECT i, 'embedding_dimensions' FROM k WHERE len(v) <> 64
UNION ALL SELECT i, 'nonfinite_embedding' FROM k WHERE v IS NOT NULL AND NOT finite
UNION ALL SELECT i, 'zero_embedding' FROM k WHERE finite AND len(v) > 0 AND len(list_filter(v, lambda c: c <> 0)) = 0
UNION ALL SELECT i, 'embedding_norm_outlier' FROM k WHERE finite AND NOT sqrt(list_sum(list_transform(v, lambda c: c * c))) BETWEEN 0.5 AND 2.0
UNION ALL SELECT i, 'duplicate_embedding' FROM first WHERE i <> f
UNION ALL SELECT NULL, 'missing_embedding' FROM x WHERE id NOT IN (SELECT chunk_id FROM k)
UNION ALL SELECT i, 'duplicate_vector' FROM twin WHERE i <> f
""")
def embedding_audit(spark, d):
    ids = table(spark, d, "ids").where("expected > 0").select(F.col("id").alias("chunk_id"))
    e = table(spark, d, "payloads").dropDuplicates(["upsert_no"]).select(F.col("upsert_no").alias("embedding_index"), "chunk_id", "vector")
    return vectors.audit_embeddings(ids, e, 64, norm_range=(0.5, 2.0)).select("chunk_index", "code")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm FROM embeddings")
def embedding_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 9).alias("norm"))


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(q.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.vec_id) AS place
FROM q, b QUALIFY place <= 5
""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = vectors.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5)
    return top.select("query_id", "id", F.round("distance", 9).alias("distance"), F.col("place").cast("bigint").alias("place"))


@query("""
WITH p AS (SELECT DISTINCT ON (upsert_no) * FROM payloads),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no) = 1),
j AS (SELECT chunk_id, a.text AS ta, b.text AS tb, a.vector::DOUBLE[] AS av, b.vector::DOUBLE[] AS bv, map_entries(a.metadata) AS am, map_entries(b.metadata) AS bm FROM a JOIN b USING (chunk_id))
SELECT chunk_id, 'text_mismatch' AS label FROM j WHERE ta IS DISTINCT FROM tb
UNION ALL SELECT chunk_id, 'metadata_mismatch' FROM j WHERE list_sort(am) IS DISTINCT FROM list_sort(bm)
UNION ALL SELECT chunk_id, 'vector_mismatch' FROM j WHERE coalesce(len(av) <> len(bv) OR len(list_filter(list_zip(av, bv), lambda x: x[1] IS NULL OR x[2] IS NULL OR NOT isfinite(x[1]) OR NOT isfinite(x[2]) OR abs(x[1] - x[2]) > 2e-5)) > 0, TRUE)
""")
def payload_verification(spark, d):
    p = table(spark, d, "payloads").dropDuplicates(["upsert_no"])
    old = p.withColumn("_rn", F.row_number().over(W.partitionBy("chunk_id").orderBy("upsert_no"))).where("_rn = 1").drop("_rn")
    return vectors.payload_mismatches(newest(p, ["chunk_id"], "upsert_no"), old)


def two_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the last snapshot but one and of the last one of every namespace, and the last one's documents."""
    states, chunks = table(spark, d, "document_states"), table(spark, d, "chunk_states")
    line = states.select("namespace", "snapshot_no").distinct()
    line = line.withColumn("back", F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("snapshot_no")))).where("back <= 2")
    rows = newest(chunks.join(line, ["namespace", "snapshot_no"]), ["namespace", "snapshot_no", "chunk_id"], "loaded_at")
    own = F.concat_ws("/", "namespace", "document_id").alias("document_id")
    hashes = [F.lower(F.btrim(c, F.lit(T.WHITE))).alias(c) for c in ("text_hash", "metadata_hash", "embedding_hash")]
    pick = lambda n: rows.where(F.col("back") == n).select("chunk_id", own, F.coalesce("chunk_key", F.lit("")).alias("chunk_key"), *hashes)
    return pick(2), pick(1), states.join(line.where("back = 1"), ["namespace", "snapshot_no"]).select(own).distinct()


_TRIM = _Sql("lower(trim(@, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))")
_ACTIONS = f"""
WITH line AS (SELECT namespace, snapshot_no, row_number() OVER (PARTITION BY namespace ORDER BY snapshot_no DESC) AS back FROM (SELECT DISTINCT namespace, snapshot_no FROM document_states)),
rows AS (SELECT chunk_id, concat_ws('/', namespace, document_id) AS document_id, coalesce(chunk_key, '') AS k, {_TRIM.of('text_hash')} AS t, {_TRIM.of('metadata_hash')} AS m, {_TRIM.of('embedding_hash')} AS e, back
  FROM chunk_states JOIN line USING (namespace, snapshot_no) WHERE back <= 2 QUALIFY row_number() OVER (PARTITION BY namespace, snapshot_no, chunk_id ORDER BY loaded_at DESC) = 1),
o AS (SELECT * FROM rows WHERE back = 2), n AS (SELECT * FROM rows WHERE back = 1),
docs AS (SELECT DISTINCT concat_ws('/', namespace, document_id) AS document_id FROM document_states JOIN line USING (namespace, snapshot_no) WHERE back = 1),
a AS (SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, o.document_id AS old_document, n.document_id AS new_document,
    CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN CASE WHEN o.document_id IN (SELECT document_id FROM docs) THEN 'removed' ELSE 'unchanged' END
      WHEN (o.document_id, o.k, o.t, o.m, o.e) = (n.document_id, n.k, n.t, n.m, n.e) THEN 'unchanged' ELSE 'changed' END AS action, o.e AS oe, n.e AS ne
  FROM o FULL JOIN n ON o.chunk_id = n.chunk_id)
"""


@query(_ACTIONS + "SELECT chunk_id, CASE WHEN action = 'removed' THEN old_document ELSE coalesce(new_document, old_document) END AS document_id, action, action = 'added' OR (action = 'changed' AND oe <> ne) AS needs_embedding FROM a")
def update_actions(spark, d):
    old, new, docs = two_snapshots(spark, d)
    none = spark.createDataFrame([], "document_id string")
    return chunk_actions(old, new, docs, none).select("chunk_id", "document_id", "action", "needs_embedding")


@query(_ACTIONS + "SELECT old_document AS document_id, count(*) AS old_chunks, count(*) FILTER (action = 'removed') AS removed_chunks FROM a WHERE old_document IS NOT NULL GROUP BY ALL")
def deletion_guard_counts(spark, d):
    old, new, docs = two_snapshots(spark, d)
    return removal_counts(chunk_actions(old, new, docs, spark.createDataFrame([], "document_id string"))).drop("retired")


@query("""
WITH h AS (SELECT DISTINCT namespace, sequence, before_chunks, after_chunks, added_chunks, removed_chunks, ordinary_removed_chunks AS x, allowance_removed_chunks AS y, retirement_removed_chunks AS z FROM commits),
w AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY sequence DESC) AS rn FROM h QUALIFY rn <= 10),
p AS (SELECT namespace, arg_min(before_chunks, sequence) AS before, min(sequence) AS first FROM h WHERE after_chunks > 0 GROUP BY ALL),
b AS (SELECT namespace, arg_min(before_chunks, sequence) AS before, min(sequence) AS oldest, max(sequence) AS newest FROM w GROUP BY ALL),
g AS (SELECT b.namespace, CASE WHEN b.before = 0 AND p.before = 0 AND oldest <= first AND first < newest THEN first ELSE -1 END AS edge FROM b LEFT JOIN p ON b.namespace = p.namespace),
k AS (SELECT w.*, sequence > edge AS kept FROM w JOIN g USING (namespace)),
s AS (SELECT namespace, count(*) FILTER (kept) AS commits_considered, count(*) FILTER (NOT kept) AS initial_commits_excluded, arg_min(before_chunks, sequence) FILTER (kept) AS start_chunks, arg_max(after_chunks, sequence) FILTER (kept) AS end_chunks,
    coalesce(sum(added_chunks) FILTER (kept), 0)::BIGINT AS chunks_added, coalesce(sum(removed_chunks) FILTER (kept), 0)::BIGINT AS chunks_removed,
    CASE WHEN count(*) FILTER (kept AND x IS NULL) = 0 THEN coalesce(sum(x) FILTER (kept), 0)::BIGINT END AS ordinary_removed_chunks,
    CASE WHEN count(*) FILTER (kept AND y IS NULL) = 0 THEN coalesce(sum(y) FILTER (kept), 0)::BIGINT END AS allowance_removed_chunks,
    CASE WHEN count(*) FILTER (kept AND z IS NULL) = 0 THEN coalesce(sum(z) FILTER (kept), 0)::BIGINT END AS retirement_removed_chunks FROM k GROUP BY ALL)
SELECT namespace, 10::BIGINT AS requested_commits, commits_considered, initial_commits_excluded > 0 AS window_adjusted, initial_commits_excluded,
  CASE WHEN initial_commits_excluded > 0 THEN 'after_initial_population' WHEN commits_considered > 0 THEN 'before_oldest_commit' ELSE 'current_inventory_no_commits' END AS baseline_basis,
  start_chunks, end_chunks, chunks_added, chunks_removed, ordinary_removed_chunks, allowance_removed_chunks, retirement_removed_chunks, end_chunks - start_chunks AS net_chunk_change,
  greatest(start_chunks - end_chunks, 0) AS net_shrink_chunks, CASE WHEN start_chunks > 0 THEN greatest(start_chunks - end_chunks, 0) / start_chunks END AS net_shrink_fraction,
  CASE WHEN start_chunks > 0 THEN chunks_removed / start_chunks END AS gross_removed_fraction,
  ordinary_removed_chunks IS NULL OR allowance_removed_chunks IS NULL OR retirement_removed_chunks IS NULL AS removal_unclassified FROM s
""")
def deletion_summary(spark, d):
    return deletion_summaries(table(spark, d, "commits"))


@query("""
SELECT namespace, sequence, revision, removed_chunks FROM (SELECT DISTINCT namespace, sequence, revision, removed_chunks FROM commits)
QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY sequence DESC) <= 3
""")
def recent_commits(spark, d):
    return last_commits(table(spark, d, "commits").select("namespace", "sequence", "revision", "removed_chunks"), 3)


@query("""
WITH f AS (SELECT DISTINCT ON (finding_id) *, code || '/' || severity || '/' || coalesce(document_id, '-') AS fp FROM findings),
now AS (SELECT code, severity, fp, count(*) AS n FROM f WHERE found_at >= TIMESTAMP '2025-05-01' GROUP BY ALL),
had AS (SELECT fp, count(*) AS cnt FROM f WHERE severity = 'warning' AND found_at < TIMESTAMP '2025-05-01' GROUP BY ALL)
SELECT code, severity, fp AS fingerprint, coalesce(n, 0) AS n, coalesce(cnt, 0) AS cnt, CASE WHEN severity = 'warning' THEN least(coalesce(n, 0), coalesce(cnt, 0)) ELSE 0 END AS accepted FROM now FULL JOIN had USING (fp)
""")
def baseline_match(spark, d):
    f = numbered_findings(spark, d).withColumn("fingerprint", F.concat_ws("/", "code", "severity", F.coalesce("document_id", F.lit("-"))))
    split = F.lit("2025-05-01").cast("timestamp_ntz")
    had = f.where((F.col("severity") == "warning") & (F.col("found_at") < split)).groupBy("fingerprint").agg(F.count("*").alias("cnt"))
    out = B.match_counts(f.where(F.col("found_at") >= split), had)
    return out.withColumn("accepted", F.col("accepted").cast("bigint"))


@query(f"""
WITH want AS (SELECT DISTINCT unnest(embed_ids) AS id FROM update_plans),
n AS (SELECT chunk_id AS id, max(CASE WHEN text IS NULL OR {_STRIP.of('text')} = '' THEN 0 ELSE len(string_split_regex({_STRIP.of('text')}, '{_WS}+')) END)::BIGINT AS tokens FROM payloads GROUP BY ALL),
x AS (SELECT DISTINCT chunk_id AS id FROM chunk_states),
j AS (SELECT coalesce(want.id, x.id) AS id, want.id IS NOT NULL AS embed, x.id IS NOT NULL AS compared FROM want FULL JOIN x ON want.id = x.id)
SELECT sum(tokens) FILTER (embed)::BIGINT AS tokens, sum(tokens) FILTER (compared)::BIGINT AS baseline_tokens, count(*) FILTER (tokens IS NULL) AS missing, count(*) FILTER (embed AND NOT compared) AS outside,
  round((sum(tokens) FILTER (embed) * 0.02 / 1000000)::DOUBLE, 9) AS cost, round(((sum(tokens) FILTER (compared) - sum(tokens) FILTER (embed)) * 0.02 / 1000000)::DOUBLE, 9) AS avoided FROM j LEFT JOIN n USING (id)
""")
def embedding_cost(spark, d):
    want = table(spark, d, "update_plans").select(F.explode("embed_ids").alias("chunk_id"))
    n = table(spark, d, "payloads").select("chunk_id", F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).cast("bigint").alias("tokens"))
    sums = cost.token_sums(want.where("chunk_id is not null"), n, table(spark, d, "chunk_states").select("chunk_id"))
    return cost.priced(sums, "0.02").withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("cost", "avoided")})


@query(f"""
WITH want AS (SELECT DISTINCT chunk_id FROM payloads WHERE text IS NOT NULL),
n AS (SELECT chunk_id, max(CASE WHEN text IS NULL OR {_STRIP.of('text')} = '' THEN 0 ELSE len(string_split_regex({_STRIP.of('text')}, '{_WS}+')) END)::BIGINT AS tokens FROM payloads GROUP BY ALL)
SELECT coalesce(sum(tokens) FILTER (chunk_id IN (SELECT chunk_id FROM want)), 0)::BIGINT AS tokens, coalesce(sum(tokens), 0)::BIGINT AS baseline_tokens,
  round((coalesce(sum(tokens) FILTER (chunk_id IN (SELECT chunk_id FROM want)), 0) * 0.02 / 1000000)::DOUBLE, 9) AS cost FROM n WHERE chunk_id IS NOT NULL
""")
def cost_estimate(spark, d):
    """What embedding all chunks with text costs, against embedding every chunk."""
    p = table(spark, d, "payloads").where("chunk_id is not null")
    n = p.select("chunk_id", F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).cast("bigint").alias("tokens"))
    e = cost.estimate_cost(p.where("text is not null").select("chunk_id"), n, "0.02", "USD", p.select("chunk_id"))
    return spark.createDataFrame([(e.tokens, e.baseline_tokens, round(float(e.cost), 9))], "tokens bigint, baseline_tokens bigint, cost double")


@query("""
SELECT DISTINCT namespace, document_id, chunk_key, sha256('["plumbline.chunk.v1","' || namespace || '","' || document_id || '","' || chunk_key || '"]') AS chunk_id FROM chunk_states WHERE chunk_key IS NOT NULL
""")
def chunk_ids(spark, d):
    rows = table(spark, d, "chunk_states").select("namespace", "document_id", "chunk_key").where("chunk_key is not null").distinct()
    return rows.withColumn("chunk_id", C.chunk_id(*(F.col(c) for c in rows.columns)))


@query("""SELECT item_id, sha256(to_json(text)::VARCHAR) AS text_hash, sha256('["' || sha256(to_json(text)::VARCHAR) || '","model-a","pipe-1"]') AS embedding_hash FROM eval_items""")
def content_hashes(spark, d):
    h = C.text_hash(F.col("text"))
    return table(spark, d, "eval_items").select("item_id", h.alias("text_hash"), C.embedding_hash(h, "model-a", "pipe-1").alias("embedding_hash"))


@query()
def document_hashes(spark, d):
    """Content hashes of all document texts. SQL has no ASCII-only JSON; a test compares with Python."""
    h = C.text_hash(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", h.alias("text_hash"), C.embedding_hash(h, "model-a", "pipe-1").alias("embedding_hash"))


@query("""
SELECT upsert_no, sha256('{"chunk_key":' || to_json(metadata['chunk_key'])::VARCHAR || ',"source_id":' || to_json(metadata['source_id'])::VARCHAR || '}') AS metadata_hash
FROM (SELECT DISTINCT ON (upsert_no) * FROM payloads WHERE metadata['chunk_key'] IS NOT NULL AND metadata['source_id'] IS NOT NULL)
""")
def metadata_hashes(spark, d):
    md = lambda k: F.try_element_at("metadata", F.lit(k))
    p = table(spark, d, "payloads").dropDuplicates(["upsert_no"]).where(md("chunk_key").isNotNull() & md("source_id").isNotNull())
    return p.select("upsert_no", C.metadata_hash(F.create_map(F.lit("source_id"), md("source_id"), F.lit("chunk_key"), md("chunk_key"))).alias("metadata_hash"))


@query(r"""
SELECT text_hash, regexp_full_match(text_hash, '[0-9a-f]{64}') AS canonical, count(*) AS rows FROM chunk_states WHERE text_hash IS NOT NULL GROUP BY ALL
""")
def hash_spelling(spark, d):
    rows = table(spark, d, "chunk_states").where("text_hash is not null").select("text_hash", C.is_hash(F.col("text_hash")).alias("canonical"))
    return rows.groupBy("text_hash", "canonical").agg(F.count("*").alias("rows"))


@query(r"""
SELECT item_id, len(list_filter(regexp_extract_all(said, '\[(\d+)\]', 1), lambda x: x::BIGINT > 5)) > 0 OR (len(regexp_extract_all(said, '\[(\d+)\]')) = 0 AND NOT contains(lower(said), 'cannot answer')) AS wrong
FROM (SELECT item_id, coalesce(answer || CASE WHEN item_id % 3 = 0 THEN '' ELSE ' [' || item_id % 7 + 1 || ']' END, 'Cannot answer.') AS said FROM eval_items)
""")
def citation_errors(spark, d):
    """Answers that cite the passages 1 to 7, or none, where 1 to 5 were given."""
    cited = F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit(" ["), (F.col("item_id") % 7 + 1).cast("string"), F.lit("]")))
    said = F.coalesce(F.concat("answer", cited), F.lit("Cannot answer."))
    return table(spark, d, "eval_items").select("item_id", T.citation_errors(said, F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>")).alias("wrong"))


@query("""
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AND count(*) FILTER (severity = 'warning') <= 100 AS passed
FROM (SELECT DISTINCT ON (finding_id) * FROM findings)
""")
def findings_verdict(spark, d):
    v = reports.verdict(numbered_findings(spark, d), 100)
    return spark.createDataFrame([(v.errors, v.warnings, v.passed)], "errors bigint, warnings bigint, passed boolean")


@query(f"""
WITH w AS (SELECT doc_id, string_split_regex({_STRIP.of('text')}, '{_WS}+') AS w FROM documents WHERE text IS NOT NULL AND {_STRIP.of('text')} <> ''),
i AS (SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 400 THEN 0 ELSE ceil((len(w) - 400) / 360)::BIGINT END)) AS part FROM w)
SELECT doc_id, part, md5(array_to_string(w[part * 360 + 1 : part * 360 + 400], ' ')) AS digest FROM i
""")
def word_chunks(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("part", "chunk"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), F.md5("chunk").alias("digest"))


@query(f"""
SELECT record_no, units IS NOT NULL AND len(list_filter(units, lambda x: x IS NULL OR {_STRIP.of('x')} = '')) = 0 AND len(list_distinct(units)) = len(units) AS valid, list_sort(units) AS canonical
FROM (SELECT DISTINCT ON (record_no) * FROM records)
""")
def unit_lists(spark, d):
    r = table(spark, d, "records").dropDuplicates(["record_no"])
    return r.select("record_no", U.valid_units(F.col("units")).alias("valid"), U.canonical_units(F.col("units")).alias("canonical"))


@query(r"""
SELECT coalesce(source <> '' AND NOT contains(source, '\') AND NOT starts_with(source, '/') AND len(list_filter(string_split(source, '/'), lambda x: x IN ('', '.', '..'))) = 0, FALSE) AS ok,
  lower(regexp_extract(source, '[^./][^/]*(\.[^./]+)$', 1)) AS suffix, count(*) AS records FROM records GROUP BY ALL
""")
def source_paths(spark, d):
    r = table(spark, d, "records").select(U.source_path_ok(F.col("source")).alias("ok"), U.suffix(F.col("source")).alias("suffix"))
    return r.groupBy("ok", "suffix").agg(F.count("*").alias("records"))


@query("""
WITH r AS (SELECT DISTINCT ON (record_no) * FROM records WHERE source IS NOT NULL AND trim(source) <> '' AND len(units) > 0 AND len(list_distinct(units)) = len(units))
SELECT record_no, '[' || to_json(source)::VARCHAR || ',' || CASE WHEN len(units) = 1 THEN to_json(units[1])::VARCHAR ELSE to_json(list_sort(units))::VARCHAR END || ',' ||
  (row_number() OVER (PARTITION BY source, list_sort(units) ORDER BY record_no) - 1) || ']' AS chunk_key FROM r
""")
def positional_chunk_keys(spark, d):
    r = table(spark, d, "records").dropDuplicates(["record_no"]).select(F.col("record_no").alias("chunk_index"), F.col("source").alias("document_id"), "units", "text")
    return K.assign_chunk_keys(r).where("chunk_key is not null").select(F.col("chunk_index").alias("record_no"), "chunk_key")


@query("SELECT DISTINCT namespace, id FROM records WHERE namespace IS NOT NULL AND id IS NOT NULL AND (namespace, id) NOT IN (SELECT (namespace, chunk_id) FROM payloads WHERE namespace IS NOT NULL AND chunk_id IS NOT NULL)")
def orphan_keys_simple(spark, d):
    refs, targets = table(spark, d, "records").select("namespace", "id"), table(spark, d, "payloads").select("namespace", F.col("chunk_id").alias("id"))
    return orphans.orphan_keys(refs, targets, ["namespace", "id"]).drop("null_mask")


_REFS = """
WITH r AS (SELECT DISTINCT id, source, source_version, (CASE WHEN id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN source IS NULL THEN 2 ELSE 0 END) + (CASE WHEN source_version IS NULL THEN 4 ELSE 0 END) AS null_mask FROM records),
t AS (SELECT DISTINCT id, source_id AS source, source_version FROM ids)
"""


@query(_REFS + """
SELECT * FROM r WHERE null_mask < 7 AND NOT EXISTS (SELECT 1 FROM t WHERE (r.id IS NULL OR t.id = r.id) AND (r.source IS NULL OR t.source = r.source) AND (r.source_version IS NULL OR t.source_version = r.source_version)
  AND (null_mask > 0 OR (t.id IS NOT NULL AND t.source IS NOT NULL AND t.source_version IS NOT NULL)))
""")
def orphan_keys_partial(spark, d):
    keys = ["id", "source", "source_version"]
    return orphans.orphan_keys(table(spark, d, "records"), table(spark, d, "ids").select("id", F.col("source_id").alias("source"), "source_version"), keys, "partial")


@query(_REFS + "SELECT * FROM r WHERE null_mask BETWEEN 1 AND 6 OR (null_mask = 0 AND (id, source, source_version) NOT IN (SELECT (id, source, source_version) FROM t WHERE id IS NOT NULL AND source IS NOT NULL AND source_version IS NOT NULL))")
def orphan_keys_full(spark, d):
    keys = ["id", "source", "source_version"]
    return orphans.orphan_keys(table(spark, d, "records"), table(spark, d, "ids").select("id", F.col("source_id").alias("source"), "source_version"), keys, "full")


@query("""
WITH c AS (SELECT suite AS scenario, CASE WHEN answer IS NULL THEN 'not_applicable' WHEN contains(text, answer) THEN 'reviewed' ELSE 'unreviewed' END AS state FROM eval_items),
n AS (SELECT scenario, state FROM c WHERE scenario IS NOT NULL UNION ALL SELECT NULL, state FROM c)
SELECT scenario, CASE WHEN count(*) FILTER (state <> 'not_applicable') = 0 THEN 'not_applicable' WHEN count(*) FILTER (state = 'unreviewed') = 0 THEN 'reviewed' WHEN count(*) FILTER (state = 'reviewed') = 0 THEN 'unreviewed' ELSE 'partial' END AS status,
  count(*) FILTER (state = 'reviewed') AS reviewed_checks, count(*) FILTER (state = 'unreviewed') AS unreviewed_checks, count(*) FILTER (state = 'not_applicable') AS not_applicable_checks FROM n GROUP BY scenario
""")
def review_summary(spark, d):
    state = F.when(F.col("answer").isNull(), "not_applicable").when(F.contains("text", "answer"), "reviewed").otherwise("unreviewed")
    return reports.review_summary(table(spark, d, "eval_items").select(F.col("suite").alias("scenario"), state.alias("state")))
