"""The pN_ queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import canonical_hash, digest
from plumbline.operators.copydiff import Field, diff_copies
from plumbline.operators.incremental import EmbeddingIncrement
from plumbline.operators.orphans import delivered, orphans_in_time
from plumbline.operators.snapshots import entity_rows, snapshot_changes, snapshot_index
from plumbline.session import broadcast_if_small, cut, fresh_path

COPY_FIELDS = (
    Field("source_id"),
    Field("source_version"),
    Field("chunk_key"),
    Field("units", "set"),
    Field("text_hash", "hash"),
    Field("embedding_model"),
    Field("vector_norm", "tolerance", 2e-5),
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "ids").where("expected > 0 or observed > 0")
    sides = F.array_compact(F.array(F.when(F.col("expected") > 0, 1), F.when(F.col("observed") > 0, -1)))
    entries = ids.withColumn("side", F.explode(sides))
    return diff_copies(entries, ["namespace", "id"], COPY_FIELDS, "entry_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    work = EmbeddingIncrement(spark, fresh_path(spark, "embedding-increment"))
    work.run(*(table(spark, d, t) for t in ("commits", "update_plans", "chunk_states", "document_states")))
    return work.work()


def p2_in_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same by two runs over one store. The first sees the earlier half of each namespace's
    commits, and in about every second namespace only the chunk rows loaded by the last of these; the
    second sees all. So some namespaces are carried on from their state, others are replayed."""
    commits, plans, chunks, docs = (table(spark, d, t) for t in ("commits", "update_plans", "chunk_states", "document_states"))
    ends = commits.groupBy("namespace").agg(F.floor(F.avg("sequence")).alias("_upto"))
    early = cut(commits.join(ends, "namespace").where("sequence <= _upto"))
    times = early.groupBy("namespace").agg(F.max("committed_at").alias("_at"))
    loaded = chunks.join(broadcast_if_small(cut(times)), "namespace").where("loaded_at <= _at or crc32(namespace) % 2 = 0").drop("_at")
    work = EmbeddingIncrement(spark, fresh_path(spark, "embedding-increment"))
    work.run(early.drop("_upto"), plans, loaded, docs)
    work.run(commits, plans, chunks, docs)
    return work.work()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "document_states"), table(spark, d, "chunk_states")
    value = digest(*(canonical_hash(F.col(c)) for c in ("text_hash", "metadata_hash", "embedding_hash")))
    rows = entity_rows(docs, "document", "document_id", digest(F.col("source_version")))
    rows = rows.unionByName(entity_rows(chunks, "chunk", "chunk_id", value))
    return snapshot_changes(rows, cut(snapshot_index(docs, chunks)))


def references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References to documents and to chunks, as (ref_table, ref_row, namespace, ref_value, ref_time)."""

    def refs(name: str, row: str, value, time: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("ref_table"), F.col(row).alias("ref_row"), "namespace", value.alias("ref_value"), F.col(time).alias("ref_time"))

    documents = refs("findings", "finding_id", F.col("document_id"), "found_at").unionByName(refs("records", "record_no", F.col("source"), "exported_at"))
    return documents, refs("reconciliation_reports", "report_no", F.explode("orphan_ids"), "created_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "document_states"), table(spark, d, "chunk_states")
    snapshots = cut(delivered(docs))
    to_documents, to_chunks = references(spark, d)
    found = orphans_in_time(to_documents, docs.select("namespace", "snapshot_no", F.col("document_id").alias("value")), snapshots)
    found = found.unionByName(orphans_in_time(to_chunks, chunks.select("namespace", "snapshot_no", F.col("chunk_id").alias("value")), snapshots))
    month = F.substring(F.col("ref_time").cast("string"), 1, 7)
    return found.select("ref_table", "ref_row", "ref_value", "ref_status", month.alias("ref_month")).distinct()


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    """The report: orphan references per table, month and status."""
    return p5_found(spark, d).groupBy("ref_table", "ref_month", "ref_status").agg(F.count("*").alias("orphans"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_in_two_runs, p3_found, p5_found, p5_by_month)}

#: SQL for the white space that may surround a value.
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_P5 = """
WITH snaps AS (SELECT namespace, snapshot_no, max(delivered_at) AS delivered_at FROM document_states GROUP BY ALL),
refs AS (
  SELECT 'findings' AS ref_table, finding_id AS ref_row, namespace, document_id AS ref_value, found_at AS ref_time, 'd' AS kind FROM findings
  UNION ALL SELECT 'records', record_no, namespace, source, exported_at, 'd' FROM records
  UNION ALL SELECT 'reconciliation_reports', report_no, namespace, unnest(orphan_ids), created_at, 'c' FROM reconciliation_reports),
used AS (SELECT * FROM refs WHERE ref_time IS NOT NULL AND ref_value IS NOT NULL AND trim(ref_value, @WS) <> ''),
held AS (
  SELECT DISTINCT 'd' AS kind, namespace, snapshot_no, document_id AS value FROM document_states
  UNION ALL SELECT DISTINCT 'c', namespace, snapshot_no, chunk_id FROM chunk_states),
timed AS (SELECT held.*, delivered_at FROM held JOIN snaps USING (namespace, snapshot_no)),
last AS (
  SELECT u.*, (SELECT max(s.delivered_at) FROM snaps s WHERE s.namespace = u.namespace AND s.delivered_at <= u.ref_time) AS last_at FROM used u),
judged AS (
  SELECT a.ref_table, a.ref_row, a.ref_value, a.ref_time, a.last_at, count(t.value) AS n,
    count(*) FILTER (t.delivered_at = a.last_at) AS now, count(*) FILTER (t.delivered_at < a.last_at) AS before
  FROM last a LEFT JOIN timed t ON t.kind = a.kind AND t.namespace = a.namespace AND t.value = a.ref_value GROUP BY ALL),
found AS (
  SELECT DISTINCT ref_table, ref_row, ref_value,
    CASE WHEN n = 0 THEN 'missing' WHEN before > 0 THEN 'deleted' ELSE 'late' END AS ref_status, strftime(ref_time, '%Y-%m') AS ref_month
  FROM judged WHERE now = 0)
"""

SQL = {
    "p1_found": """
WITH e AS (SELECT * FROM ids WHERE expected > 0 QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY entry_no DESC) = 1),
o AS (SELECT * FROM ids WHERE observed > 0 QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY entry_no DESC) = 1),
j AS (SELECT coalesce(e.namespace, o.namespace) AS namespace, coalesce(e.id, o.id) AS id, e, o, e.id IS NOT NULL AS in_e, o.id IS NOT NULL AS in_o
  FROM e FULL JOIN o ON e.namespace = o.namespace AND e.id = o.id),
f AS (
  SELECT namespace, id, CASE WHEN NOT in_o THEN ['missing_observed'] WHEN NOT in_e THEN ['missing_expected'] ELSE [
    CASE WHEN e.source_id IS DISTINCT FROM o.source_id THEN 'source_id' END,
    CASE WHEN e.source_version IS DISTINCT FROM o.source_version THEN 'source_version' END,
    CASE WHEN e.chunk_key IS DISTINCT FROM o.chunk_key THEN 'chunk_key' END,
    CASE WHEN list_sort(list_distinct(e.units)) IS DISTINCT FROM list_sort(list_distinct(o.units)) THEN 'units' END,
    CASE WHEN lower(trim(e.text_hash, @WS)) IS DISTINCT FROM lower(trim(o.text_hash, @WS)) THEN 'text_hash' END,
    CASE WHEN e.embedding_model IS DISTINCT FROM o.embedding_model THEN 'embedding_model' END,
    CASE WHEN (e.vector_norm IS NULL) <> (o.vector_norm IS NULL) OR abs(e.vector_norm - o.vector_norm) > 2e-5 THEN 'vector_norm' END] END AS names FROM j)
SELECT namespace, id, field_name FROM (SELECT namespace, id, unnest(names) AS field_name FROM f) WHERE field_name IS NOT NULL
""",
    "p2_found": """
WITH RECURSIVE snaps AS (SELECT DISTINCT namespace, snapshot_no, revision FROM document_states),
chunks AS (
  SELECT c.namespace, s.revision, c.snapshot_no, chunk_id, lower(trim(embedding_hash, @WS)) AS h FROM chunk_states c JOIN snaps s USING (namespace, snapshot_no)
  QUALIFY row_number() OVER (PARTITION BY c.namespace, c.snapshot_no, chunk_id ORDER BY loaded_at DESC) = 1),
steps AS (
  SELECT namespace, revision, snapshot_no, plan_id, row_number() OVER (PARTITION BY namespace ORDER BY sequence, created_at, plan_id) AS step FROM (
    SELECT DISTINCT p.namespace, p.revision, s.snapshot_no, p.plan_id, p.created_at, k.sequence
    FROM update_plans p JOIN (SELECT namespace, base_revision, revision, min(sequence) AS sequence FROM commits GROUP BY ALL) k USING (namespace, base_revision, revision)
    JOIN snaps s USING (namespace, revision))),
embeds AS (SELECT DISTINCT namespace, step, chunk_id FROM (SELECT s.namespace, s.step, unnest(p.embed_ids) AS chunk_id FROM update_plans p JOIN steps s USING (namespace, plan_id, revision))),
state AS (
  SELECT DISTINCT namespace, 0 AS step, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS h, FALSE AS has, FALSE AS repeated FROM snaps
  UNION ALL
  SELECT c.namespace, s.step, c.chunk_id,
    CASE WHEN e.chunk_id IS NOT NULL THEN c.h ELSE p.h END,
    e.chunk_id IS NOT NULL OR coalesce(p.has, FALSE),
    e.chunk_id IS NOT NULL AND coalesce(p.has, FALSE) AND p.h IS NOT DISTINCT FROM c.h
  FROM (SELECT DISTINCT namespace, step FROM state) r
  JOIN steps s ON s.namespace = r.namespace AND s.step = r.step + 1
  JOIN chunks c ON c.namespace = s.namespace AND c.revision = s.revision
  LEFT JOIN state p ON p.namespace = c.namespace AND p.chunk_id = c.chunk_id
  LEFT JOIN embeds e ON e.namespace = c.namespace AND e.step = s.step AND e.chunk_id = c.chunk_id),
lasts AS (SELECT namespace, max(step) AS step FROM steps GROUP BY ALL),
newest AS (SELECT namespace, max(snapshot_no) AS snapshot_no FROM snaps GROUP BY ALL)
SELECT DISTINCT t.namespace, s.revision, t.chunk_id, 'repeated' AS work_kind FROM state t JOIN steps s USING (namespace, step) WHERE t.repeated
UNION ALL
SELECT c.namespace, c.revision, c.chunk_id, 'pending' FROM chunks c JOIN newest n USING (namespace, snapshot_no)
LEFT JOIN lasts l ON l.namespace = c.namespace
LEFT JOIN state t ON t.namespace = c.namespace AND t.step = l.step AND t.chunk_id = c.chunk_id
WHERE NOT coalesce(t.has AND t.h IS NOT DISTINCT FROM c.h, FALSE)
""",
    "p3_found": """
WITH docs AS (SELECT namespace, snapshot_no, 'document' AS entity, document_id AS entity_id, source_version AS v FROM document_states
  QUALIFY row_number() OVER (PARTITION BY namespace, snapshot_no, document_id ORDER BY loaded_at DESC) = 1),
chunks AS (SELECT namespace, snapshot_no, 'chunk' AS entity, chunk_id AS entity_id,
    coalesce(lower(trim(text_hash, @WS)), '-') || '/' || coalesce(lower(trim(metadata_hash, @WS)), '-') || '/' || coalesce(lower(trim(embedding_hash, @WS)), '-') AS v FROM chunk_states
  QUALIFY row_number() OVER (PARTITION BY namespace, snapshot_no, chunk_id ORDER BY loaded_at DESC) = 1),
rows AS (SELECT * FROM docs UNION ALL SELECT * FROM chunks),
snaps AS (SELECT namespace, snapshot_no, lead(snapshot_no) OVER (PARTITION BY namespace ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT namespace, snapshot_no FROM rows)),
old AS (SELECT r.*, next_no FROM rows r JOIN snaps USING (namespace, snapshot_no) WHERE next_no IS NOT NULL),
new AS (SELECT r.* FROM rows r JOIN snaps s ON s.namespace = r.namespace AND s.next_no = r.snapshot_no),
j AS (SELECT coalesce(n.namespace, o.namespace) AS namespace, coalesce(n.snapshot_no, o.next_no) AS snapshot_no, coalesce(n.entity, o.entity) AS entity,
    coalesce(n.entity_id, o.entity_id) AS entity_id,
    CASE WHEN o.namespace IS NULL THEN 'added' WHEN n.namespace IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'changed' END AS change_type
  FROM old o FULL JOIN new n ON o.namespace = n.namespace AND o.next_no = n.snapshot_no AND o.entity = n.entity AND o.entity_id = n.entity_id)
SELECT * FROM j WHERE change_type IS NOT NULL
""",
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_by_month": _P5 + "SELECT ref_table, ref_month, ref_status, count(*) AS orphans FROM found GROUP BY ALL",
}
SQL["p2_in_two_runs"] = SQL["p2_found"]
SQL = {k: v.replace("@WS", _WS) for k, v in SQL.items()}
