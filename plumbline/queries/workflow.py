"""Queries that run snapshots, plans, ledgers, stores, files and exports end to end, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canonical as C
from plumbline.functions import text as T
from plumbline.functions import units as U
from plumbline.operators import vectors
from plumbline.plans.index_store import PayloadStore, project_metadata
from plumbline.plans.ledger import Ledger
from plumbline.plans.planning import Guards, UpdatePlan, audit_plan_embeddings, plan_update
from plumbline.plans.snapshot import Snapshot, UnsafePlanError, build_snapshot, load_snapshot, save_snapshot, verify_snapshot
from plumbline.queries.problems import table
from plumbline.queries.reference import _ACTIONS, _STRIP, _WS, newest, two_snapshots
from plumbline.session import cut, fresh_path
from plumbline.sources import files, records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- snapshots


def extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' texts as a batch of sources of one unit each: inventory, receipts, chunks."""
    rows = table(spark, d, "documents").where(~T.blank(F.col("text"))).select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("source"), F.coalesce("source_version", F.lit("none")).alias("source_version"), F.lit("file").alias("unit"), F.lit(0).alias("unit_no"), "text"
    )
    docs = rows.select(F.col("source").alias("document_id"), "source_version", F.array("unit").alias("expected_units"))
    receipts = rows.select(F.col("source").alias("document_id"), "source_version", F.array("unit").alias("processed_units"), U.empty_units().alias("empty_units"), U.empty_units().alias("failed_units"), F.lit(True).alias("completed"))
    return docs, receipts, files.unit_chunks(rows)


_CHUNKED = f"""
WITH w AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS document_id, doc_id, string_split_regex({_STRIP.of('text')}, '{_WS}+') AS w FROM documents WHERE text IS NOT NULL AND {_STRIP.of('text')} <> ''),
c AS (SELECT document_id, unnest(generate_series(0, CASE WHEN len(w) <= 400 THEN 0 ELSE ceil((len(w) - 400) / 360)::BIGINT END)) AS part FROM w),
k AS (SELECT document_id, part, '["' || document_id || '","file",' || part || ']' AS chunk_key FROM c)
"""


@query(_CHUNKED + """SELECT sha256('["plumbline.chunk.v1","ns","' || document_id || '",' || to_json(chunk_key)::VARCHAR || ']') AS chunk_id, document_id, chunk_key FROM k""")
def snapshot_chunks(spark, d):
    """A batch extracted, audited, made a snapshot, saved, and loaded and verified again."""
    path = fresh_path(spark, "snapshot")
    save_snapshot(build_snapshot(*extracted(spark, d), "ns", "pipe", "model"), path)
    return load_snapshot(spark, path).chunks.select("chunk_id", "document_id", "chunk_key")


@query(_CHUNKED + ", f AS (SELECT document_id, count(*) - 1 AS later FROM k GROUP BY ALL) SELECT count(*) AS documents, sum(later)::BIGINT AS later_chunks, 0::BIGINT AS problems FROM f")
def snapshot_soundness(spark, d):
    """A snapshot that was built has no structural defect."""
    s = build_snapshot(*extracted(spark, d), "ns", "pipe", "model")
    s = Snapshot(s.namespace, s.pipeline_id, s.embedding_model, s.documents, cut(s.chunks))
    n = s.chunks.agg((F.count("*") - F.count_distinct("document_id")).alias("later_chunks"))
    return s.documents.agg(F.count("*").alias("documents")).crossJoin(n).crossJoin(verify_snapshot(s).agg(F.count("*").alias("problems")))  # one row each


def inventories(spark: SparkSession, d: str) -> tuple[Snapshot, Snapshot]:
    """The last snapshot but one and the last one of all namespaces, as two snapshots of one namespace."""
    old, new, docs = two_snapshots(spark, d)
    old, new = cut(old), cut(new)
    versions = lambda ids: ids.distinct().withColumn("source_version", F.lit("v"))
    return Snapshot("all", "pipe", "model", versions(old.select("document_id")), old), Snapshot("all", "pipe", "model", versions(docs), new)


@query(_ACTIONS + """
, p AS (
  SELECT 'blank_document' AS problem, document_id AS id FROM docs WHERE trim(document_id) = ''
  UNION ALL SELECT 'duplicate_chunk', chunk_id FROM n GROUP BY chunk_id HAVING count(*) > 1
  UNION ALL SELECT 'unknown_document', chunk_id FROM n WHERE document_id NOT IN (SELECT document_id FROM docs)
  UNION ALL SELECT 'wrong_chunk_id', chunk_id FROM n WHERE chunk_id IS DISTINCT FROM sha256('["plumbline.chunk.v1","all",' || to_json(document_id)::VARCHAR || ',' || to_json(k)::VARCHAR || ']')
  UNION ALL SELECT 'invalid_hash', chunk_id FROM n WHERE NOT coalesce(regexp_full_match(t, '[0-9a-f]{64}') AND regexp_full_match(m, '[0-9a-f]{64}') AND regexp_full_match(e, '[0-9a-f]{64}'), FALSE)
  UNION ALL SELECT 'wrong_embedding_hash', chunk_id FROM n WHERE e IS DISTINCT FROM sha256('["' || t || '","model","pipe"]'))
SELECT problem, count(*) AS n FROM p GROUP BY ALL
""")
def snapshot_problems(spark, d):
    """The structural defects of the newest inventory, whose ids and hashes were made otherwise."""
    return verify_snapshot(inventories(spark, d)[1]).groupBy("problem").agg(F.count("*").alias("n"))


# --- plans

_FREE = Guards(1.0, 1.0)
#: A document that is only in the old inventory is retired in the second query of plans.
_POLICY = """
, byd AS (SELECT old_document, count(*) AS old, count(*) FILTER (action = 'removed') AS gone FROM a WHERE old_document IS NOT NULL GROUP BY ALL),
s AS (SELECT coalesce(sum(old), 0)::BIGINT AS old, coalesce(sum(gone), 0)::BIGINT AS gone, count(*) FILTER (gone > 0) AS shrinking, coalesce(max(gone / old), 0) AS worst FROM byd)
"""


def free_plan(spark: SparkSession, d: str) -> UpdatePlan:
    return plan_update(*inventories(spark, d), _FREE)


@query(_ACTIONS + _POLICY + """
, m AS (SELECT count(*) FILTER (action = 'added' OR (action = 'changed' AND oe <> ne)) AS embeds, count(*) FILTER (action IN ('added', 'changed')) AS upserts FROM a)
SELECT old AS committed_chunks, old AS ordinary_committed_chunks, gone AS ordinary_removed_chunks, shrinking AS shrinking_documents, gone AS proposed_deletions, embeds AS planned_embeddings, upserts AS proposed_upserts FROM s, m
""")
def plan_policy(spark, d):
    m = free_plan(spark, d).metrics()
    names = ("committed_chunks", "ordinary_committed_chunks", "ordinary_removed_chunks", "shrinking_documents", "proposed_deletions")
    row = {**{k: m["deletion_policy"][k] for k in names}, "planned_embeddings": m["planned_embeddings"], "proposed_upserts": m["proposed_upserts"]}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


@query(_ACTIONS + """
SELECT action, chunk_id FROM a WHERE action <> 'unchanged' UNION ALL SELECT 'embed', chunk_id FROM a WHERE action = 'added' OR (action = 'changed' AND oe <> ne)
""")
def plan_lists(spark, d):
    return free_plan(spark, d).sorted_ids()


@query(_ACTIONS + "SELECT chunk_id, coalesce(new_document, old_document) AS document_id FROM a WHERE action <> 'removed'")
def plan_target(spark, d):
    """The merged inventory: documents that the new side lacks are preserved."""
    return free_plan(spark, d).target.chunks.select("chunk_id", "document_id")


@query(_ACTIONS + _POLICY + """
, g(guard, bound) AS (VALUES ('document', 0.0), ('document', 0.5), ('document', 1.0), ('corpus', 0.0), ('corpus', 1.0), ('chunks', 0.0), ('chunks', 1e9), ('documents', 0.0), ('documents', 1e9))
SELECT guard, bound::DOUBLE AS bound, CASE guard WHEN 'document' THEN worst > bound WHEN 'corpus' THEN old > 0 AND gone / old > bound WHEN 'chunks' THEN gone > bound ELSE shrinking > bound END AS refused FROM g, s
""")
def plan_guards(spark, d):
    """Whether a plan is refused with each guard at each bound and the others out of the way."""
    sides, rows = inventories(spark, d), []
    for guard, bounds in {"document": (0.0, 0.5, 1.0), "corpus": (0.0, 1.0), "chunks": (0, 10**9), "documents": (0, 10**9)}.items():
        for b in bounds:
            name = {"document": "max_delete_fraction", "corpus": "max_corpus_delete_fraction", "chunks": "max_removed_chunks", "documents": "max_shrinking_documents"}[guard]
            try:
                plan_update(*sides, replace(_FREE, **{name: b}))
                rows.append((guard, float(b), False))
            except UnsafePlanError:
                rows.append((guard, float(b), True))
    return spark.createDataFrame(rows, "guard string, bound double, refused boolean")


@query(_ACTIONS + """
, lone AS (SELECT document_id FROM (SELECT DISTINCT document_id FROM o) WHERE document_id NOT IN (SELECT document_id FROM docs)),
r AS (SELECT min(document_id) AS id FROM lone)
SELECT count(*) FILTER (document_id = r.id) AS retirement_removed_chunks, count(*) FILTER (document_id <> r.id OR r.id IS NULL) AS ordinary_committed_chunks FROM o, r
""")
def plan_retirement(spark, d):
    """One document of the old side only is retired: its chunks go, and count in neither share."""
    old, new = inventories(spark, d)
    one = old.documents.join(new.documents, "document_id", "left_anti").agg(F.min("document_id")).first()[0]
    p = plan_update(old, new, Guards(1.0, 1.0, retire_documents=() if one is None else (one,))).policy
    return spark.createDataFrame([(p["retirement_removed_chunks"], p["ordinary_committed_chunks"])], "retirement_removed_chunks bigint, ordinary_committed_chunks bigint")


@query(_ACTIONS + """
, x AS (SELECT chunk_id FROM a WHERE action IN ('added', 'changed')),
last AS (SELECT * FROM (SELECT DISTINCT ON (upsert_no) * FROM payloads) WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
said AS (SELECT id, max(embedding_model) AS model, max(lower(trim(text_hash))) AS h FROM ids GROUP BY id),
v AS (SELECT upsert_no AS i, chunk_id, vector::DOUBLE[] AS v, model, h FROM last LEFT JOIN said ON id = chunk_id),
t AS (SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.t, o.t) AS t FROM o FULL JOIN n ON o.chunk_id = n.chunk_id JOIN a ON a.chunk_id = coalesce(n.chunk_id, o.chunk_id) WHERE action <> 'removed'),
k AS (SELECT v.*, chunk_id IN (SELECT chunk_id FROM x) AS known, coalesce(len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0, FALSE) AS finite FROM v),
twin AS (SELECT i, min(i) OVER (PARTITION BY list_transform(v, lambda c: c + 0.0)) AS f FROM k WHERE known AND finite AND len(v) = 64),
f AS (
  SELECT i, 'unexpected_embedding' AS code FROM k WHERE NOT known
  UNION ALL SELECT i, 'invalid_vector' FROM k WHERE v IS NULL
  UNION ALL SELECT i, 'embedding_dimensions' FROM k WHERE len(v) <> 64
  UNION ALL SELECT i, 'nonfinite_embedding' FROM k WHERE v IS NOT NULL AND NOT finite
  UNION ALL SELECT i, 'zero_embedding' FROM k WHERE finite AND len(v) > 0 AND len(list_filter(v, lambda c: c <> 0)) = 0
  UNION ALL SELECT NULL, 'missing_embedding' FROM x WHERE chunk_id NOT IN (SELECT chunk_id FROM k)
  UNION ALL SELECT i, 'duplicate_vector' FROM twin WHERE i <> f
  UNION ALL SELECT i, 'embedding_provenance_mismatch' FROM k JOIN t USING (chunk_id) WHERE model IS DISTINCT FROM 'model'
  UNION ALL SELECT i, 'embedding_provenance_mismatch' FROM k JOIN t USING (chunk_id) WHERE h IS DISTINCT FROM t.t)
SELECT code, i AS embedding_index, count(*) AS n FROM f GROUP BY ALL
""")
def plan_embeddings(spark, d):
    """The stored vectors, with the model and text hash that the inventory declares, as those made for a plan."""
    plan = free_plan(spark, d)
    last = newest(table(spark, d, "payloads").where("chunk_id is not null").dropDuplicates(["upsert_no"]), ["chunk_id"], "upsert_no")
    said = table(spark, d, "ids").groupBy(F.col("id").alias("chunk_id")).agg(F.max("embedding_model").alias("embedding_model"), F.max(F.lower(F.trim("text_hash"))).alias("input_hash"))
    made = last.join(said, "chunk_id", "left").select(F.col("upsert_no").alias("embedding_index"), "chunk_id", "vector", "embedding_model", F.lit("pipe").alias("pipeline_id"), "input_hash")
    found = audit_plan_embeddings(plan, made, 64, "upsert")
    return found.groupBy("code", F.col("chunk_index").alias("embedding_index")).agg(F.count("*").alias("n"))


# --- ledger


def two_commits(spark: SparkSession, d: str) -> Ledger:
    """A ledger in which the older inventory was committed, then the plan to the newer one."""
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    for s in inventories(spark, d):
        ledger.commit(ledger.plan(s, _FREE), "2025-01-01T00:00:00+00:00")
    return ledger


@query(_ACTIONS + """
, s AS (SELECT (SELECT count(*) FROM o) AS old, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'removed') AS gone FROM a)
SELECT 1 AS sequence, 0::BIGINT AS before_chunks, old AS after_chunks, old AS added_chunks, 0::BIGINT AS removed_chunks FROM s
UNION ALL SELECT 2, old, old + added - gone, added, gone FROM s
""")
def ledger_history(spark, d):
    return two_commits(spark, d).history().select("sequence", "before_chunks", "after_chunks", "added_chunks", "removed_chunks")


@query(_ACTIONS + "SELECT chunk_id FROM a WHERE action <> 'removed'")
def ledger_ids(spark, d):
    return two_commits(spark, d).chunk_ids()


@query(_ACTIONS + """
, now AS (SELECT DISTINCT document_id FROM o UNION SELECT document_id FROM docs), asked AS (SELECT DISTINCT concat_ws('/', namespace, document_id) AS document_id FROM findings)
SELECT a.chunk_id FROM a WHERE action <> 'removed' AND coalesce(new_document, old_document) IN (SELECT document_id FROM asked)
""")
def ledger_lookup(spark, d):
    """The chunks of the documents that findings name, and no others."""
    asked = table(spark, d, "findings").select(F.concat_ws("/", "namespace", "document_id").alias("document_id"))
    return two_commits(spark, d).load_documents(asked).chunks.select("chunk_id")


@query(_ACTIONS + """
, now AS (SELECT document_id FROM o UNION SELECT document_id FROM docs)
SELECT (SELECT count(*) FROM now) AS documents, (SELECT count(*) FROM a WHERE action <> 'removed') AS chunks
""")
def ledger_counts(spark, d):
    c = two_commits(spark, d).counts()
    return spark.createDataFrame([(c["documents"], c["chunks"])], "documents bigint, chunks bigint")


@query(_ACTIONS + """
, s AS (SELECT (SELECT count(*) FROM o) AS old, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'removed') AS gone FROM a)
SELECT 1::BIGINT AS commits_considered, 1::BIGINT AS initial_commits_excluded, old AS start_chunks, old + added - gone AS end_chunks, added AS chunks_added, gone AS chunks_removed, TRUE AS history_complete FROM s
""")
def ledger_summary(spark, d):
    """The first commit fills the ledger, so the window starts after it."""
    return two_commits(spark, d).deletion_summary().select("commits_considered", "initial_commits_excluded", "start_chunks", "end_chunks", "chunks_added", "chunks_removed", "history_complete")


@query(_ACTIONS + "SELECT DISTINCT 'ledger_document_corrupt' AS code, coalesce(new_document, old_document) AS document_id FROM a WHERE action <> 'removed'")
def ledger_findings(spark, d):
    """Ids and hashes of the tables were made under another recipe, so every document fails its verification."""
    return two_commits(spark, d).verify().select("code", "document_id")


# --- store and export


@query("""
WITH p AS (SELECT DISTINCT ON (upsert_no) * FROM payloads WHERE chunk_id IS NOT NULL),
last AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1)
SELECT chunk_id, md5(text) AS digest FROM last WHERE text IS NOT NULL
""")
def payload_store(spark, d):
    """First rows upserted, newest rows upserted over them, those without text deleted."""
    p = table(spark, d, "payloads").where("chunk_id is not null").dropDuplicates(["upsert_no"])
    store, rows = PayloadStore(spark, fresh_path(spark, "payloads")), newest(p, ["chunk_id"], "upsert_no")
    first = p.withColumn("_back", -F.col("upsert_no"))
    store.upsert(newest(first, ["chunk_id"], "_back"))
    store.upsert(rows)
    store.delete(rows.where("text is null").select("chunk_id"))
    return store.rows().select("chunk_id", F.md5("text").alias("digest"))


@query("""
WITH p AS (SELECT DISTINCT ON (upsert_no) * FROM payloads WHERE chunk_id IS NOT NULL),
last AS (SELECT chunk_id, text FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
want AS (SELECT DISTINCT id AS chunk_id FROM ids WHERE expected > 0), have AS (SELECT chunk_id FROM last WHERE text IS NOT NULL)
SELECT chunk_id, 'missing_id' AS label FROM want WHERE chunk_id NOT IN (SELECT chunk_id FROM have) UNION ALL SELECT chunk_id, 'orphan_id' FROM have WHERE chunk_id NOT IN (SELECT chunk_id FROM want)
""")
def inventory_against_store(spark, d):
    """Ids that only the expected inventory or only the store has."""
    want = table(spark, d, "ids").where("expected > 0").select(F.col("id").alias("chunk_id")).distinct()
    have = newest(table(spark, d, "payloads").where("chunk_id is not null").dropDuplicates(["upsert_no"]), ["chunk_id"], "upsert_no").where("text is not null").select("chunk_id")
    return vectors.lone_ids(want, have)


@query("""
WITH p AS (SELECT DISTINCT ON (upsert_no) * FROM payloads WHERE chunk_id IS NOT NULL),
b AS (SELECT * FROM p WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no DESC) = 1),
a AS (SELECT * FROM p WHERE vector IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upsert_no) = 1),
j AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.chunk_id IS NOT NULL AS ha, b.chunk_id IS NOT NULL AS hb, a.text AS ta, b.text AS tb, map_entries(a.metadata) AS am, map_entries(b.metadata) AS bm, a.vector::DOUBLE[] AS av, b.vector::DOUBLE[] AS bv FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)
SELECT chunk_id, 'missing_record' AS label FROM j WHERE NOT hb UNION ALL SELECT chunk_id, 'orphan_id' FROM j WHERE NOT ha
UNION ALL SELECT chunk_id, 'text_mismatch' FROM j WHERE ha AND hb AND ta IS DISTINCT FROM tb
UNION ALL SELECT chunk_id, 'metadata_mismatch' FROM j WHERE ha AND hb AND list_sort(am) IS DISTINCT FROM list_sort(bm)
UNION ALL SELECT chunk_id, 'vector_mismatch' FROM j WHERE ha AND hb AND coalesce(len(av) <> len(bv) OR len(list_filter(list_zip(av, bv), lambda x: x[1] IS NULL OR x[2] IS NULL OR NOT isfinite(x[1]) OR NOT isfinite(x[2]) OR abs(x[1] - x[2]) > 2e-5)) > 0, TRUE)
""")
def payload_labels(spark, d):
    """First rows with a vector as planned payloads, newest rows with a text as stored ones."""
    p = table(spark, d, "payloads").where("chunk_id is not null").dropDuplicates(["upsert_no"])
    planned = newest(p.where("vector is not null").withColumn("_back", -F.col("upsert_no")), ["chunk_id"], "_back")
    return vectors.payload_mismatches(planned, newest(p.where("text is not null"), ["chunk_id"], "upsert_no"))


@query("""
WITH r AS (SELECT DISTINCT ON (record_no) * FROM records WHERE id IS NOT NULL AND trim(id) <> '' AND source IS NOT NULL AND len(units) > 0 AND len(list_distinct(units)) = len(units)
  AND NOT contains(source, '\\') AND NOT starts_with(source, '/') AND len(list_filter(string_split(source, '/'), lambda x: x IN ('', '.', '..'))) = 0)
SELECT id, source, md5(text) AS digest, list_sort(units) AS units, source_version, CASE WHEN regexp_full_match(source_version, '[0-9a-f]{64}') THEN source_version END AS fingerprint FROM r
""")
def export_round_trip(spark, d):
    """The records as payloads with the store's metadata, exported, and read back by the strict parser."""
    r = table(spark, d, "records").dropDuplicates(["record_no"])
    r = r.where(~T.blank(F.col("id")) & U.source_path_ok(F.col("source")) & U.valid_units(F.col("units")) & (F.size("units") > 0))
    rows = project_metadata(r.withColumn("document_id", F.col("source")), "model", "pipe").withColumn("chunk_id", F.col("id"))
    path = fresh_path(spark, "export")
    records.write_export(rows, path)
    return records.read_export(spark, path).where("error is null").select("id", "source", F.md5("text").alias("digest"), "units", "source_version", "fingerprint")


@query("""
SELECT 0::BIGINT AS first_line, count(*) AS lines, count(*) FILTER (text IS NULL) AS without_text, count(*) FILTER (text IS NOT NULL AND lang IS NOT NULL) AS with_lang, sum(length(text))::BIGINT AS chars FROM documents
""")
def jsonl_chunk_scan(spark, d):
    """The documents as JSON Lines of chunks, read back."""
    path = fresh_path(spark, "chunks")
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), F.coalesce(C.quoted(v), F.lit("null")))
    line = F.concat(F.lit("{"), pair("text", F.col("text")), F.lit(',"metadata":{'), pair("lang", F.col("lang")), F.lit("}}"))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    c = records.read_chunks_jsonl(spark, path)
    lang = F.try_element_at("metadata", F.lit("lang"))
    return c.agg(
        F.min("chunk_index").alias("first_line"), F.count_distinct("chunk_index").alias("lines"), F.count_if(~F.col("is_text")).alias("without_text"),
        F.count_if(F.col("is_text") & lang.isNotNull()).alias("with_lang"), F.sum(F.length("text")).alias("chars"),
    )


@query("""
SELECT item_id - (SELECT min(item_id) FROM eval_items) AS chunk_index, md5(text) AS digest, TRUE AS is_record FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 + (SELECT min(item_id) FROM eval_items) AS item_id, text FROM eval_items)
UNION ALL SELECT count(*), NULL, FALSE FROM eval_items
""")
def json_array_scan(spark, d):
    """The evaluation items as one JSON array that ends with a number, which is no record."""
    path = fresh_path(spark, "array")
    items = table(spark, d, "eval_items").select("item_id", F.concat(F.lit('{"text":'), C.quoted(F.col("text")), F.lit("},")).alias("value"))
    ends = spark.createDataFrame([(None, "[", 0), (None, "17]", 2)], "item_id bigint, value string, part int")
    # An array is one value, so one task writes it.
    items.withColumn("part", F.lit(1)).unionByName(ends).coalesce(1).sortWithinPartitions("part", "item_id").select("value").write.text(path)
    return records.read_chunks_json(spark, path).select("chunk_index", F.md5("text").alias("digest"), "is_record")


# --- files


def item_files(spark: SparkSession, d: str) -> str:
    """A folder with a text file per evaluation item, by suite. The shared folder must be one that tasks can open."""
    import os

    root = fresh_path(spark, "files").removeprefix("file:")
    root = "/" + root.lstrip("/")

    def write(rows) -> None:
        for suite, item, text in rows:
            folder = os.path.join(root, suite)
            os.makedirs(folder, exist_ok=True)
            for name, content in ((f"{item}.txt", text), (f"{item}.html", f"<html><style>hidden</style><p>{item}<p>shown</html>"), (f"{item}.bin", "")):
                with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                    f.write(content)

    table(spark, d, "eval_items").select("suite", "item_id", "text").where("suite is not null and text is not null").foreachPartition(write)
    return root


@query("""
SELECT suite || '/' || item_id || '.txt' AS source, sha256(text) AS source_version, 'file' AS unit, md5(text) AS digest FROM eval_items WHERE suite IS NOT NULL AND text IS NOT NULL
UNION ALL SELECT suite || '/' || item_id || '.html', sha256('<html><style>hidden</style><p>' || item_id || '<p>shown</html>'), 'file', md5(item_id || ' shown') FROM eval_items WHERE suite IS NOT NULL AND text IS NOT NULL
""")
def folder_units(spark, d):
    units = files.read_units(files.list_tree(spark, item_files(spark, d)).files())
    return units.select("source", "source_version", "unit", F.md5("text").alias("digest"))


@query("""
WITH n AS (SELECT count(*) AS n FROM eval_items WHERE suite IS NOT NULL AND text IS NOT NULL)
SELECT 'passed' AS outcome, 2 * n AS files_discovered, 2 * n AS files_audited, 2 * n AS units_enumerated, n AS unsupported_files, 0::BIGINT AS missing_expected_files FROM n
""")
def folder_check(spark, d):
    c = files.check_folder(spark, item_files(spark, d))
    names = ("files_discovered", "files_audited", "units_enumerated", "unsupported_files", "missing_expected_files")
    return spark.createDataFrame([(c.outcome, *(c.counts[n] for n in names))], "outcome string, " + ", ".join(f"{n} bigint" for n in names))


@query("""
WITH i AS (SELECT suite || '/' || item_id || '.txt' AS source, item_id FROM eval_items WHERE suite IS NOT NULL AND text IS NOT NULL)
SELECT source, CASE item_id % 5 WHEN 0 THEN 'unlisted_file' WHEN 1 THEN 'wrong_hash' ELSE 'wrong_page_count' END AS problem FROM i WHERE item_id % 5 < 3
UNION ALL SELECT source || 'x', 'missing_file' FROM i WHERE item_id % 5 = 3
""")
def manifest_problems(spark, d):
    """A manifest of the files in which some aren't listed and others have a wrong digest, page count or name."""
    units = files.read_units(files.list_tree(spark, item_files(spark, d), (".txt",)).files())
    have = cut(units.groupBy("source").agg(F.max("source_version").alias("sha256"), F.count("*").cast("int").alias("pages")))
    n = F.regexp_extract("source", r"(\d+)\.txt$", 1).cast("bigint") % 5
    want = have.where(n != 0).withColumns({"sha256": F.when(n == 1, F.reverse("sha256")).otherwise(F.col("sha256")), "pages": F.when(n == 2, 7).otherwise(F.col("pages"))})
    extra = have.where(n == 3).withColumn("source", F.concat("source", F.lit("x")))
    return files.check_manifest(want.unionByName(extra), have)
