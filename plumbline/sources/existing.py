"""Audit of an existing index from files: a folder of sources against an export."""

from __future__ import annotations

from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.findings import emit, finding, union
from plumbline.operators.export_audit import SUPPORTED, IndexAudit, audit_index
from plumbline.session import cut
from plumbline.sources.files import Tree, list_tree, read_units
from plumbline.sources.records import EXPORT, read_export


def source_findings(tree: Tree, units: DataFrame) -> DataFrame:
    """What keeps the sources from being whole evidence: links, folders and files that can't be read, and
    units that can't be extracted."""
    who = dict(document_id=F.col("source"))
    read = [
        F.when(F.col("reason").isNotNull(), finding("source_read_failed", message=F.concat_ws(": ", "reason", "error"), **who)),
        F.when(F.col("reason").isNull() & F.col("failed"), finding("source_extraction_failed", message=F.col("unit"), **who)),
    ]
    return union([tree.problems(), emit(units, read)])


def audit_existing_index(
    spark: SparkSession, folder: str, export: str, export_complete: bool = False, source_scope_complete: bool = False, unit_metadata_complete: bool = False,
) -> IndexAudit:
    """audit_index of a folder's text and PDF files and a JSON Lines export.

    A source that can't be read is a finding and takes away all claims of absence; a unit that can't be
    extracted is one, too, but stays in the inventory. An export that can't be read is a finding and
    counts as an incomplete one.
    """
    tree = list_tree(spark, folder, SUPPORTED)
    units = cut(read_units(tree.files()))
    own = units.where("reason is null").groupBy("source").agg(F.max("source_version").alias("hash"), F.array_sort(F.collect_set("unit")).alias("units"))
    ok = tree.problems().isEmpty() and units.where("reason is not null").isEmpty()
    broken = None
    try:
        records = cut(read_export(spark, export))
        if not spark.read.text(export).where(~F.is_valid_utf8("value")).isEmpty():
            broken = "invalid_utf8"
    except (PySparkException, Py4JJavaError) as e:
        records, broken = spark.createDataFrame([], EXPORT), type(e).__name__
    a = audit_index(records, own, ok, export_complete and broken is None, source_scope_complete and broken is None, unit_metadata_complete)
    found = [a.findings, source_findings(tree, units)]
    if broken is not None:
        found.append(emit(spark.range(1), [finding("index_export_read_failed", message=broken)]))
    return replace(a, findings=union(found))
