"""Summaries of findings: grouped counts, bounded examples, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_code(findings: DataFrame, max_examples: int = 5) -> DataFrame:
    """(code, severity, occurrences, affected_chunks, chunk_indices): exact counts, bounded examples.

    affected chunks are those of a finding and those related to it. The first indices are taken by a
    ranked window over distinct indices, whose partial limit runs before the shuffle.
    """
    _check(max_examples)
    n = findings.groupBy("code", "severity").agg(F.count("*").alias("occurrences"))
    each = findings.select("code", "severity", F.explode(F.array_compact(F.array_union(F.array("chunk_index"), F.coalesce("related", F.array().cast("array<bigint>"))))).alias("i")).distinct()
    affected = each.groupBy("code", "severity").agg(F.count("*").alias("affected_chunks"))
    first = each.withColumn("rn", F.row_number().over(W.partitionBy("code", "severity").orderBy("i"))).where(F.col("rn") <= max_examples)
    first = first.groupBy("code", "severity").agg(F.array_sort(F.collect_list("i")).alias("chunk_indices"))
    out = n.join(affected, ["code", "severity"], "left").join(first, ["code", "severity"], "left")
    return out.select("code", "severity", "occurrences", F.coalesce("affected_chunks", F.lit(0)).alias("affected_chunks"), F.coalesce("chunk_indices", F.array().cast("array<bigint>")).alias("chunk_indices"))


def metrics(findings: DataFrame) -> DataFrame:
    """(code, severity, occurrences); no ids and no text."""
    return findings.groupBy("code", "severity").agg(F.count("*").alias("occurrences"))


def by_document(findings: DataFrame) -> DataFrame:
    return findings.groupBy("document_id").agg(
        F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )


def examples(findings: DataFrame, order: Column, example: Column, max_examples: int = 5) -> DataFrame:
    """(code, severity, occurrences, examples): per code the first examples in the given order."""
    _check(max_examples)
    ranked = findings.select("code", "severity", order.alias("o"), example.alias("e"))
    n = ranked.groupBy("code", "severity").agg(F.count("*").alias("occurrences"))
    top = ranked.withColumn("rn", F.row_number().over(W.partitionBy("code", "severity").orderBy("o", "e"))).where(F.col("rn") <= max_examples)
    top = top.groupBy("code", "severity").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "e"))), lambda x: x.e).alias("examples"))
    return n.join(top, ["code", "severity"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


# The states of a reviewed claim.
REVIEW_STATES = ("reviewed", "unreviewed", "not_applicable")


def review_summary(claims: DataFrame) -> DataFrame:
    """(scenario, status, reviewed_checks, unreviewed_checks, not_applicable_checks) of claims (scenario,
    state), a row per scenario and one with a null scenario for all. A state that isn't one of
    REVIEW_STATES makes the status ``unknown``; claims without scenario count in the total only."""
    n = {s: F.count_if(F.col("state") == s) for s in REVIEW_STATES}
    odd = F.count_if(~F.coalesce(F.col("state").isin(*REVIEW_STATES), F.lit(False)))
    status = (
        F.when(odd > 0, "unknown").when(n["reviewed"] + n["unreviewed"] == 0, "not_applicable")
        .when(n["unreviewed"] == 0, "reviewed").when(n["reviewed"] == 0, "unreviewed").otherwise("partial")
    )
    cols = [status.alias("status"), *[n[s].alias(f"{s}_checks") for s in REVIEW_STATES]]
    of_all = claims.agg(*cols).select(F.lit(None).cast("string").alias("scenario"), "status", *[f"{s}_checks" for s in REVIEW_STATES])
    return claims.where("scenario is not null").groupBy("scenario").agg(*cols).unionByName(of_all)


@dataclass(frozen=True)
class Verdict:
    """errors, warnings and whether they pass: no error, and no more warnings than allowed."""

    errors: int
    warnings: int
    max_warnings: int | None = None

    @property
    def passed(self) -> bool:
        return not self.errors and (self.max_warnings is None or self.warnings <= self.max_warnings)


def verdict(findings: DataFrame, max_warnings: int | None = None) -> Verdict:
    if max_warnings is not None and (type(max_warnings) is not int or max_warnings < 0):
        raise ValueError("max_warnings must be a nonnegative integer or None")
    row = findings.agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")).first()
    return Verdict(row[0], row[1], max_warnings)


def render(groups: DataFrame, title: str, passed: bool) -> str:
    """A small table as text; groups has at most one row per code."""
    lines = [f"{'PASS' if passed else 'FAIL'}: {title}", "CODE  SEVERITY  OCCURRENCES"]
    rows = groups.select("code", "severity", "occurrences").orderBy("code", "severity").collect()
    return "\n".join(lines + [f"{r.code}  {r.severity}  {r.occurrences}" for r in rows])


def _check(max_examples: int) -> None:
    if type(max_examples) is not int or max_examples < 0:
        raise ValueError("max_examples must be a nonnegative integer")
