"""Numbering rows in order without one task for all of them, nor one for a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, cut


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the place, from 0, of each row among those with its keys (null equals null), by order.

    Rows are range partitioned by keys and order, so a group larger than a task lies in consecutive
    partitions. Each partition numbers its own part of a group; of a group that spans several, each part
    starts after the rows of the parts before. Only such parts, at most two a partition and one more for
    each partition between, meet in the small table of offsets. Among rows of equal order the places are
    arbitrary. An empty table gives no rows.
    """
    part, start = "_numbered_part", "_numbered_start"
    rows = df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()) if keys or order else df.withColumn(part, F.spark_partition_id())
    rows = cut(rows)  # a partition's number must stay its own
    sizes = rows.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn(start, before).where(F.col(start).isNotNull()).drop("_n")
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), start)
    same = F.col(part) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(W.partitionBy(part, *keys).orderBy(*order)) - 1
    numbered = rows.withColumn(name, own).join(broadcast_if_small(cut(starts)), same, "left")
    return numbered.withColumn(name, F.col(name) + F.coalesce(F.col(start), F.lit(0))).select(*df.columns, name)
