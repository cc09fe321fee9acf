"""Two-sided comparison of ids, for one inventory or for many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.checks import check, whole

SIDES = ("expected", "observed")


def id_counts(expected: DataFrame, observed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., id, expected, observed): how often each id occurs on each side. One aggregation, no join.

    The id is the first column that isn't in ``scope``; rows without one don't count.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        id = next(c for c in df.columns if c not in scope)
        return df.select(*scope, F.col(id).alias("id"), *[F.lit(int(s == name)).alias(s) for s in SIDES])

    both = side(expected, "expected").unionByName(side(observed, "observed")).where("id is not null")
    return both.groupBy(*scope, "id").agg(*[F.sum(s).alias(s) for s in SIDES])


def _measures() -> dict[str, Column]:
    """The names of a report's counts."""
    e, o = F.col("expected"), F.col("observed")
    beyond = lambda c: F.coalesce(F.sum(F.greatest(c - 1, F.lit(0))), F.lit(0))
    return {
        "expected_count": F.count_if(e > 0), "observed_count": F.count_if(o > 0), "missing_count": F.count_if((e > 0) & (o == 0)),
        "orphan_count": F.count_if((o > 0) & (e == 0)), "duplicate_expected_count": beyond(e), "duplicate_observed_count": beyond(o),
    }


def reconcile_counts(counts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The counts of id_counts: one row, or one per scope."""
    return counts.groupBy(*scope).agg(*[c.alias(n) for n, c in _measures().items()])


def sample_ids(counts: DataFrame, condition: str, max_examples: int) -> DataFrame:
    return counts.where(condition).select("id").orderBy("id").limit(max_examples)


def reconcile(expected: DataFrame, observed: DataFrame, complete: DataFrame, scope: str = "namespace", max_examples: int = 100) -> DataFrame:
    """A report per inventory: (scope, inventory_complete, counts, missing_ids, orphan_ids, passed).

    complete: (scope, inventory_complete), the caller's attestations; only the inventories it names are
    reported, one that isn't attested to be complete never passes. The samples are the first ids in
    order, found by a ranked window whose partial limit runs before the shuffle. Empty sides give zeros.
    """
    check({"max_examples": max_examples}, max_examples=whole(0))
    counts = id_counts(expected, observed, [scope])
    lone = counts.where("expected = 0 or observed = 0").select(scope, "id", F.when(F.col("observed") == 0, "missing_ids").otherwise("orphan_ids").alias("kind"))
    first = lone.withColumn("rank", F.row_number().over(W.partitionBy(scope, "kind").orderBy("id"))).where(F.col("rank") <= max_examples)
    samples = first.groupBy(scope).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(k) for k in ("missing_ids", "orphan_ids")])
    out = complete.select(scope, F.coalesce("inventory_complete", F.lit(False)).alias("inventory_complete"))
    out = out.join(reconcile_counts(counts, [scope]), scope, "left").join(samples, scope, "left")
    names = list(_measures())
    found = [F.coalesce(n, F.lit(0)) for n in names]
    none = F.array().cast("array<string>")
    passed = F.col("inventory_complete") & (sum(found[2:], F.lit(0)) == 0)
    return out.select(scope, "inventory_complete", *[c.alias(n) for n, c in zip(names, found)], *[F.coalesce(k, none).alias(k) for k in ("missing_ids", "orphan_ids")], passed.alias("passed"))
