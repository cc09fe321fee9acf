"""The findings relation and the catalogue of codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code string, severity string, document_id string, chunk_index bigint, chunk_key string, related array<bigint>, message string"
COLUMNS = ("code", "severity", "document_id", "chunk_index", "chunk_key", "related", "message")

# The finding codes of the domain. All are errors but those in WARNINGS.
WARNINGS = (
    "short_chunk", "duplicate_text", "repeated_boilerplate", "low_distinctiveness", "completeness_unverified",
    "low_unit_text_yield", "embedding_norm_outlier", "duplicate_vector", "likely_image_only_page",
)
ERRORS = (
    "invalid_record", "invalid_metadata", "missing_metadata", "invalid_text", "empty_text", "token_limit",
    "empty_inventory", "duplicate_document", "duplicate_receipt", "unexpected_receipt", "invalid_json_metadata",
    "namespace_mismatch", "namespace_missing", "unexpected_chunk_document", "chunk_version_mismatch",
    "invalid_chunk_key", "duplicate_chunk_key", "invalid_chunk_pages", "invalid_chunk_units",
    "unexpected_chunk_page", "unexpected_chunk_unit", "missing_receipt", "receipt_version_mismatch",
    "extraction_incomplete", "failed_pages", "failed_units", "processed_pages_mismatch", "processed_units_mismatch",
    "invalid_receipt_pages", "invalid_receipt_units", "unapproved_empty_pages", "unapproved_empty_units",
    "empty_page_has_chunks", "empty_unit_has_chunks", "missing_chunk_pages", "missing_chunk_units",
    "insufficient_chunks", "invalid_embedding", "unexpected_embedding", "duplicate_embedding", "invalid_vector",
    "nonfinite_embedding", "embedding_dimensions", "zero_embedding", "missing_embedding",
    "embedding_provenance_mismatch", "ledger_integrity", "ledger_state", "ledger_document_corrupt",
    "duplicate_run_id", "unexpected_run_record", "run_processing_failed", "conflicting_run_outcome",
    "run_processing_missing", "run_enumeration_incomplete", "source_changed_during_run",
    "source_enumeration_failed", "source_path_excluded", "source_extraction_failed", "source_read_failed",
    "duplicate_index_record", "conflicting_index_record", "empty_indexed_text", "source_hash_mismatch",
    "malformed_index_record", "index_export_read_failed", "conflicting_source_versions", "source_not_indexed",
    "indexed_source_orphan", "missing_indexed_unit", "missing_expected_source",
)
SEVERITY = {**dict.fromkeys(ERRORS, "error"), **dict.fromkeys(WARNINGS, "warning")}


def finding(
    code: str | Column, *, message: str | Column = "", document_id: Column | None = None, chunk_index: Column | None = None,
    chunk_key: Column | None = None, related: Column | None = None, severity: str | None = None,
) -> Column:
    """A finding as a struct; a code given as text must be in the catalogue."""
    if isinstance(code, str):
        severity = severity or SEVERITY[code]
    none = F.lit(None)
    return F.struct(
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        F.lit(severity or "error").alias("severity"),
        (none if document_id is None else document_id).cast("string").alias("document_id"),
        (none if chunk_index is None else chunk_index).cast("bigint").alias("chunk_index"),
        (none if chunk_key is None else chunk_key).cast("string").alias("chunk_key"),
        (F.array() if related is None else related).cast("array<bigint>").alias("related"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def emit(df: DataFrame, found: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """The findings of a row, each column a finding struct or null, after the columns to keep."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keep, "_f.*")


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in report order: by chunk, those of none first, then code, document and message."""
    return findings.orderBy(F.col("chunk_index").asc_nulls_first(), "code", "document_id", "message")


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
