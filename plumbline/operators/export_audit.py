"""Audit of an existing index: its export against the sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.findings import emit, finding, union
from plumbline.functions import text as T
from plumbline.functions.units import suffix
from plumbline.session import small

# The source types of an index audit.
SUPPORTED = (".txt", ".md", ".rst", ".pdf")


@dataclass(frozen=True)
class IndexAudit:
    findings: DataFrame
    measurements: dict[str, int]
    unverified: tuple[str, ...]


def repeated_records(records: DataFrame) -> DataFrame:
    """Findings for records whose id an earlier line has: duplicate if the payload is the first one's, else conflicting."""
    r = records.where("error is null").select("line", "id", F.sha2("payload", 256).alias("d"))
    first = r.groupBy("id").agg(F.min(F.struct("line", "d")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    hit = r.join(small(first), "id").where("line <> f.line")
    code = F.when(F.col("d") == F.col("f.d"), "duplicate_index_record").otherwise("conflicting_index_record")
    return emit(hit, [finding(code, chunk_index=F.col("line"))])


def conflicting_versions(records: DataFrame) -> DataFrame:
    """Sources with more than one comparable hash, or more than one declared version."""
    r = records.where("error is null and source is not null")
    parts = [r.where(f"{c} is not null").select("source", c).distinct().groupBy("source").count().where("count > 1").select("source") for c in ("fingerprint", "source_version")]
    return emit(parts[0].union(parts[1]).distinct(), [finding("conflicting_source_versions", document_id=F.col("source"))])


def line_findings(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings of single records. sources: source, hash."""
    known = sources.select("source", F.col("hash").alias("own"))
    r = records.join(small(known), "source", "left")
    at = dict(chunk_index=F.col("line"))
    return emit(
        r,
        [
            F.when(F.col("error").isNotNull(), finding("malformed_index_record", message=F.col("error"), **at)),
            F.when(F.col("has_text") & T.blank(F.col("text")), finding("empty_indexed_text", **at)),
            F.when(F.col("fingerprint") != F.col("own"), finding("source_hash_mismatch", **at)),
        ],
    )


def sources_not_indexed(records: DataFrame, sources: DataFrame) -> DataFrame:
    return emit(sources.join(records.where("error is null").select("source"), "source", "left_anti"), [finding("source_not_indexed", document_id=F.col("source"))])


def orphan_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    named = records.where(F.col("error").isNull() & suffix(F.col("source")).isin(*SUPPORTED)).select("source").distinct()
    return emit(named.join(sources, "source", "left_anti"), [finding("indexed_source_orphan", document_id=F.col("source"))])


def missing_units(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Units of sources that no record with text covers. sources: source, units."""
    covered = records.where(F.col("error").isNull() & ~(F.col("has_text") & T.blank(F.col("text")))).select("source", F.explode("units").alias("unit")).distinct()
    want = sources.select("source", F.explode("units").alias("unit"))
    return emit(want.join(covered, ["source", "unit"], "left_anti"), [finding("missing_indexed_unit", message=F.col("unit"), document_id=F.col("source"))])


def audit_index(
    records: DataFrame, sources: DataFrame, sources_ok: bool = True, export_complete: bool = False, source_scope_complete: bool = False,
    unit_metadata_complete: bool = False,
) -> IndexAudit:
    """records: EXPORT rows. sources: source, hash, units. The flags are the caller's attestations.

    Claims of absence are made only where the evidence allows them; one aggregate decides which
    anti joins are planned at all. Of records with one id all count for coverage and versions.
    """
    r, ok = records, F.col("error").isNull()
    twice = repeated_records(r)
    n = r.agg(
        F.count("*").alias("records"), F.count_if(~ok).alias("malformed"), F.count_if(ok & F.col("source").isNull()).alias("no_source"),
        F.count_if(ok & F.col("units").isNull()).alias("no_units"), F.count_if(ok & F.col("fingerprint").isNull()).alias("no_hash"),
        F.count_if(ok & ~F.col("has_text")).alias("no_text"), F.count_if(ok & F.col("source").isNotNull() & ~suffix(F.col("source")).isin(*SUPPORTED)).alias("outside"),
    ).first()
    export_ok = not n.malformed and twice.where("code = 'conflicting_index_record'").isEmpty()
    absence = export_complete and sources_ok and export_ok and not n.no_source
    orphan = source_scope_complete and sources_ok and export_ok
    coverage = absence and unit_metadata_complete and not n.no_units
    parts = [line_findings(r, sources), twice, conflicting_versions(r)]
    parts += [sources_not_indexed(r, sources)] if absence else []
    parts += [orphan_sources(r, sources)] if orphan else []
    parts += [missing_units(r, sources)] if coverage else []
    claims = {
        "source_absence": not absence, "index_orphans": not orphan, "unit_representation": not coverage, "source_mapping": n.no_source, "source_version_comparison": n.no_hash,
        "indexed_text_nonempty": n.no_text, "records_outside_supported_source_scope": n.outside, "historical_ingestion_success": True, "full_unit_content_searchability": True,
    }
    measured = {"exported_records": n.records, "records_without_source": n.no_source, "records_without_units": n.no_units, "records_without_comparable_fingerprint": n.no_hash, "records_without_text": n.no_text}
    return IndexAudit(union(parts), measured, tuple(sorted(k for k, v in claims.items() if v)))
