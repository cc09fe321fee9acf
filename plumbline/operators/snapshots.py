"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small


def snapshot_index(*tables: DataFrame) -> DataFrame:
    """(namespace, snapshot_no, idx, next_no): the snapshots of each namespace in order.

    One row per snapshot, so its windows stay small however many rows the snapshots have.
    """
    no = None
    for t in tables:
        part = t.select("namespace", "snapshot_no").where(F.col("snapshot_no").isNotNull()).distinct()
        no = part if no is None else no.unionByName(part).distinct()
    w = W.partitionBy("namespace").orderBy("snapshot_no")
    return no.select(
        "namespace", "snapshot_no", F.row_number().over(w).alias("idx"), F.lead("snapshot_no").over(w).alias("next_no")
    )


def entity_rows(table: DataFrame, entity: str, entity_id: str, value: Column) -> DataFrame:
    """One row layout for every kind of entity; ``value`` is a digest or value compared as a whole."""
    return table.select("namespace", "snapshot_no", F.lit(entity).alias("entity"), F.col(entity_id).alias("entity_id"), "loaded_at", value.alias("value"))


def snapshot_changes(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(namespace, snapshot_no, entity, entity_id, change_type) for every two consecutive snapshots.

    ``rows`` come from entity_rows. Per key and snapshot the row with the greatest loaded_at counts
    (a null loaded_at is older than any; among equals the greatest value). Then each key is windowed
    by snapshot index: a lagging index that isn't the preceding one means added, an unequal lagging
    value changed, a leading index that isn't the following one removed from the next snapshot.
    Repeated and replaced rows are folded before the shuffle, so a key with a third of all rows
    leaves at most one row per snapshot and task; a key's window holds one row per snapshot. Rows
    without snapshot_no are ignored, null keys are keys of their own, empty tables give no rows.
    """
    key = ["namespace", "entity", "entity_id"]
    newest = rows.groupBy(*key, "snapshot_no").agg(F.max(F.struct("loaded_at", "value")).alias("r"))
    small = broadcast_if_small(index.withColumnRenamed("namespace", "_ns"))
    placed = newest.join(small.withColumnRenamed("snapshot_no", "_no"), F.col("namespace").eqNullSafe(F.col("_ns")) & (F.col("snapshot_no") == F.col("_no")))
    w = W.partitionBy(*key).orderBy("idx")
    seen = placed.select(
        *key, "snapshot_no", "idx", "next_no", F.col("r.value").alias("value"),
        F.lag("idx").over(w).alias("before"), F.lag("r.value").over(w).alias("old"), F.lead("idx").over(w).alias("after"),
    )
    kept = F.col("before").eqNullSafe(F.col("idx") - 1)
    events = F.array_compact(
        F.array(
            F.when((F.col("idx") > 1) & ~kept, F.struct("snapshot_no", F.lit("added").alias("change_type"))),
            F.when(kept & ~F.col("old").eqNullSafe(F.col("value")), F.struct("snapshot_no", F.lit("changed").alias("change_type"))),
            F.when(F.col("next_no").isNotNull() & ~F.col("after").eqNullSafe(F.col("idx") + 1), F.struct(F.col("next_no").alias("snapshot_no"), F.lit("removed").alias("change_type"))),
        )
    )
    return seen.select(*key, F.explode(events).alias("e")).select("namespace", "e.snapshot_no", "entity", "entity_id", "e.change_type")
