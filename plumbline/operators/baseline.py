"""Accepted warnings: a multiset of fingerprints under a scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.canonical import canonical_map, is_hash

MODES = ("strict", "text")


def _identity(chunks: DataFrame, mode: str) -> DataFrame:
    """(chunk_index, identity): a digest of the chunk's content; its position has no part in it."""
    cols = [c for c in ("text", "chunk_key", "document_id", "source_version", "namespace") if c in chunks.columns]
    if mode == "text":
        cols = [c for c in cols if c not in ("source_version", "namespace")]
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in cols]
    if "units" in chunks.columns:
        parts.append(F.coalesce(F.to_json(F.array_sort("units")), F.lit("-")))
    if "metadata" in chunks.columns:
        md = F.col("metadata") if mode == "strict" else F.map_filter("metadata", lambda k, _: k.isin("source", "document_id", "chunk_key", "units", "pages"))
        parts.append(F.coalesce(canonical_map(md), F.lit("-")))
    return chunks.select("chunk_index", F.sha2(F.to_json(F.array(*parts)), 256).alias("identity"))


def fingerprints(findings: DataFrame, chunks: DataFrame, mode: str = "strict") -> DataFrame:
    """The findings with a column ``fingerprint``: code, severity and the content of the chunks concerned."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    who = _identity(chunks, mode)
    first = who.select(F.col("chunk_index").alias("_other"), F.col("identity").alias("_related"))
    f = findings.join(who, "chunk_index", "left").withColumn("_other", F.get("related", F.lit(0))).join(first, "_other", "left").drop("_other")
    said = F.when(F.col("code") != "duplicate_text", F.col("message")) if mode == "text" else F.lit(None)
    value = F.array("code", "severity", *[F.coalesce(c, F.lit("-")) for c in (F.col("identity"), F.col("_related"), said.cast("string"))])
    return f.withColumn("fingerprint", F.sha2(F.to_json(value), 256)).drop("identity", "_related")


def capture(findings: DataFrame, chunks: DataFrame, scope: str, mode: str = "strict") -> DataFrame:
    """(scope, mode, fingerprint, cnt) of the warnings; errors are never accepted."""
    if not isinstance(scope, str) or not scope.strip():
        raise ValueError("the scope must name corpus and policy")
    f = fingerprints(findings.where("severity = 'warning'"), chunks, mode)
    return f.groupBy("fingerprint").agg(F.count("*").alias("cnt")).select(F.lit(scope).alias("scope"), F.lit(mode).alias("mode"), "fingerprint", "cnt")


@dataclass(frozen=True)
class Comparison:
    """counts: code, severity, occurrences, accepted, new. Passed if nothing is new."""

    counts: DataFrame
    accepted: int
    new: int
    resolved: int

    @property
    def passed(self) -> bool:
        return self.new == 0


def match_counts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(code, severity, fingerprint, n, accepted): multisets meet as counts, so no occurrence is numbered.

    current: findings with fingerprint. A fingerprint holds its code and severity, so it has one of each.
    """
    now = current.groupBy("code", "severity", "fingerprint").agg(F.count("*").alias("n"))
    had = baseline.groupBy("fingerprint").agg(F.sum("cnt").alias("cnt"))
    j = now.join(had, "fingerprint", "full")
    accepted = F.when(F.col("severity") == "warning", F.least(F.coalesce("n", F.lit(0)), F.coalesce("cnt", F.lit(0)))).otherwise(0)
    return j.select("code", "severity", "fingerprint", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cnt", F.lit(0)).alias("cnt"), accepted.alias("accepted"))


def compare(findings: DataFrame, chunks: DataFrame, baseline: DataFrame, scope: str, mode: str = "strict") -> Comparison:
    named = baseline.select("scope", "mode").distinct().limit(2).collect()
    if any(tuple(r) != (scope, mode) for r in named):
        raise ValueError("the baseline is of another scope or mode")
    m = match_counts(fingerprints(findings, chunks, mode), baseline)
    row = m.agg(F.sum("accepted"), F.sum(F.col("n") - F.col("accepted")), F.sum(F.col("cnt") - F.col("accepted"))).first()
    counts = m.where("n > 0").groupBy("code", "severity").agg(F.sum("n").alias("occurrences"), F.sum("accepted").alias("accepted"), F.sum(F.col("n") - F.col("accepted")).alias("new"))
    return Comparison(counts, *(int(x or 0) for x in row))


def save(baseline: DataFrame, path: str) -> None:
    """Write a baseline; an existing one is refused."""
    baseline.select("scope", "mode", "fingerprint", "cnt").write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved baseline: one scope, one known mode, well-formed fingerprints; anything else raises.

    Baselines of the first format have no mode; they are strict."""
    b = spark.read.parquet(path)
    if set(b.columns) == {"scope", "fingerprint", "cnt"}:
        b = b.withColumn("mode", F.lit("strict"))
    if set(b.columns) != {"scope", "mode", "fingerprint", "cnt"}:
        raise ValueError("not a baseline")
    bad = ~is_hash(F.col("fingerprint")) | ~F.col("mode").isin(*MODES) | (F.trim("scope") == "") | (F.col("cnt") < 1)
    row = b.agg(F.count_if(F.coalesce(bad, F.lit(True))), F.count_distinct(F.struct("scope", "mode"))).first()
    if row[0] or row[1] > 1:
        raise ValueError("invalid baseline")
    return b
