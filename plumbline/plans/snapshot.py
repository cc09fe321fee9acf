"""Snapshots: hash-only inventories of a validated batch."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import canonical as C
from plumbline.operators.ingestion import AcceptancePolicy, audit_ingestion

CHUNK_COLUMNS = ("chunk_id", "document_id", "chunk_key", "text_hash", "metadata_hash", "embedding_hash")


class UnsafePlanError(ValueError):
    """An update would break a scope, deletion or concurrency guard."""


class InvalidBatchError(ValueError):
    """The batch has errors, so it can't become a snapshot; codes: those of its errors."""

    def __init__(self, message: str, codes: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.codes = codes


def _named(**values: str) -> None:
    for k, v in values.items():
        if not isinstance(v, str) or not v.strip():
            raise ValueError(f"{k} must be nonblank text")


@dataclass(frozen=True)
class Snapshot:
    """documents: document_id, source_version. chunks: CHUNK_COLUMNS."""

    namespace: str
    pipeline_id: str
    embedding_model: str
    documents: DataFrame
    chunks: DataFrame

    def __post_init__(self) -> None:
        _named(namespace=self.namespace, pipeline_id=self.pipeline_id, embedding_model=self.embedding_model)

    def revision(self) -> str:
        """A digest of the whole inventory that depends on neither order nor partitioning.

        Rows are added up as 128-bit hashes, so nothing is sorted or collected.
        """
        parts = [self.namespace, self.pipeline_id, self.embedding_model]
        for df, cols in ((self.documents, ("document_id", "source_version")), (self.chunks, CHUNK_COLUMNS)):
            row = df.agg(F.count("*"), *row_sums([F.col(c) for c in cols])).first()
            parts += [str(x or 0) for x in row]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def row_sums(cols: list[Column]) -> list[Column]:
    """Order-independent sums of two 64-bit hashes of each row, in 32-bit lanes."""
    out = []
    for salt in (29, 3001):
        h = F.xxhash64(F.lit(salt), *[x for c in cols for x in (c.isNull(), c)])
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return out


def chunk_states(chunks: DataFrame, namespace: str, model: str, pipeline: str) -> DataFrame:
    """Chunks as hashes. Metadata is the map ``metadata`` with the promoted columns in it."""
    promoted = [c for c in ("document_id", "source_version", "source", "namespace") if c in chunks.columns]
    own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in promoted]), F.array(*[F.col(c) for c in promoted])), lambda _, v: v.isNotNull())
    if "metadata" in chunks.columns:
        own = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*promoted)), own)
    if "units" in chunks.columns:
        units = F.create_map(F.lit("units"), F.to_json(F.array_sort("units")))
        own = F.when(F.col("units").isNotNull(), F.map_concat(F.map_filter(own, lambda k, _: k != "units"), units)).otherwise(own)
    t = C.text_hash(F.col("text"))
    return chunks.select(
        C.chunk_id(F.lit(namespace), F.col("document_id"), F.col("chunk_key")).alias("chunk_id"), "document_id", "chunk_key",
        t.alias("text_hash"), C.metadata_hash(own).alias("metadata_hash"), C.embedding_hash(t, model, pipeline).alias("embedding_hash"),
    )


def build_snapshot(
    documents: DataFrame, receipts: DataFrame, chunks: DataFrame, namespace: str, pipeline_id: str, embedding_model: str,
    policy: AcceptancePolicy | None = None,
) -> Snapshot:
    """A snapshot of a batch that passes its audit and whose units are all known."""
    _named(namespace=namespace, pipeline_id=pipeline_id, embedding_model=embedding_model)
    audit = audit_ingestion(documents, receipts, chunks, policy, namespace)
    v = audit.verdict()
    if not v.passed:
        codes = audit.findings.where("severity = 'error'").select("code").distinct().orderBy("code").collect()  # a row per code
        raise InvalidBatchError(f"{v.errors} errors and {v.warnings} warnings", tuple(r[0] for r in codes))
    if not documents.where("expected_units is null").isEmpty():
        raise InvalidBatchError("the units of every document must be known")
    return Snapshot(namespace, pipeline_id, embedding_model, documents.select("document_id", "source_version"), chunk_states(chunks, namespace, embedding_model, pipeline_id))


def verify_snapshot(s: Snapshot) -> DataFrame:
    """(problem, id) of each structural defect; empty if the snapshot is sound."""
    c = s.chunks
    label = lambda df, name, col: df.select(F.lit(name).alias("problem"), F.col(col).alias("id"))
    blank = lambda name: F.coalesce(F.trim(name) == "", F.lit(True))
    parts = [
        label(s.documents.where(blank("document_id") | blank("source_version")), "blank_document", "document_id"),
        label(s.documents.groupBy("document_id").count().where("count > 1"), "duplicate_document", "document_id"),
        label(c.groupBy("chunk_id").count().where("count > 1"), "duplicate_chunk", "chunk_id"),
        label(c.join(s.documents.select("document_id").distinct(), "document_id", "left_anti"), "unknown_document", "chunk_id"),
        label(c.where(~C.chunk_id(F.lit(s.namespace), F.col("document_id"), F.col("chunk_key")).eqNullSafe(F.col("chunk_id"))), "wrong_chunk_id", "chunk_id"),
        label(c.where(~(C.is_hash(F.col("text_hash")) & C.is_hash(F.col("metadata_hash")) & C.is_hash(F.col("embedding_hash")))), "invalid_hash", "chunk_id"),
        label(c.where(~C.embedding_hash(F.col("text_hash"), s.embedding_model, s.pipeline_id).eqNullSafe(F.col("embedding_hash"))), "wrong_embedding_hash", "chunk_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_snapshot(s: Snapshot, path: str) -> None:
    """A folder with both tables and, last, the manifest that makes it valid; an existing one is refused."""
    from plumbline.operators.incremental import GenerationStore

    store = GenerationStore(s.documents.sparkSession, path)
    if store.commits():
        raise ValueError("the folder holds a snapshot already")
    folder = store.new_folder()
    s.documents.select("document_id", "source_version").write.parquet(f"{folder}/documents")
    s.chunks.select(*CHUNK_COLUMNS).write.parquet(f"{folder}/chunks")
    kept = Snapshot(s.namespace, s.pipeline_id, s.embedding_model, *(s.documents.sparkSession.read.parquet(f"{folder}/{t}") for t in ("documents", "chunks")))
    store.publish(1, {"schema_version": 1, "namespace": s.namespace, "pipeline_id": s.pipeline_id, "embedding_model": s.embedding_model, "folder": folder, "revision": kept.revision()})


def load_snapshot(spark, path: str) -> Snapshot:
    """The saved snapshot, verified against its manifest."""
    from plumbline.operators.incremental import GenerationStore

    commits = GenerationStore(spark, path).commits()
    if len(commits) != 1:
        raise ValueError("no snapshot here")
    m = commits[0][1]
    fields = {"schema_version", "namespace", "pipeline_id", "embedding_model", "folder", "revision"}
    if type(m.get("schema_version")) is not int or m["schema_version"] != 1 or set(m) != fields:
        raise ValueError("unsupported snapshot format")
    s = Snapshot(m["namespace"], m["pipeline_id"], m["embedding_model"], *(spark.read.parquet(f"{m['folder']}/{t}") for t in ("documents", "chunks")))
    if s.revision() != m["revision"]:
        raise ValueError("the snapshot's revision doesn't match its content")
    return s
