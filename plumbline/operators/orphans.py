"""References to records that don't exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import WHITE
from plumbline.session import broadcast_if_small, cut, small

MATCH = ("simple", "full", "partial")


def orphan_keys(refs: DataFrame, targets: DataFrame, keys: Sequence[str], match: str = "simple", nullable: Sequence[str] | None = None) -> DataFrame:
    """The distinct reference keys without a target, as (keys..., null_mask).

    References are grouped by their null mask (bit i: key column i is null); each mask that can hold
    an orphan is anti-joined on its non-null columns. The declared semantics decide about nulls:

    - simple: a key with any null refers to nothing and is no orphan;
    - full: a key of nulls only is no orphan, one with some nulls always is;
    - partial: the non-null columns must occur together in some target; nulls only: no orphan.

    Both sides are made distinct first, with map-side aggregation, so neither a hot reference nor a
    repeated target reaches the join more than once. Empty targets make every checked key an orphan.
    ``nullable`` names the columns that can be null, where not all can; other masks aren't looked for.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    if not keys or len(keys) > 8:
        raise ValueError("1 to 8 key columns are needed")
    mask = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)])
    refs = refs.select(*keys).distinct().withColumn("null_mask", mask)
    every = (1 << len(keys)) - 1
    whole = targets.select(*keys).dropna().distinct()
    parts = [refs.where("null_mask = 0").join(whole, list(keys), "left_anti")]
    if match == "full":
        parts.append(refs.where((F.col("null_mask") > 0) & (F.col("null_mask") < every)))
    if match == "partial":
        may = sum(1 << i for i, k in enumerate(keys) if nullable is None or k in nullable)
        for m in (m for m in range(1, every) if m & ~may == 0):
            on = [k for i, k in enumerate(keys) if not m >> i & 1]
            parts.append(refs.where(F.col("null_mask") == m).join(targets.select(*on).dropna().distinct(), on, "left_anti"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def delivered(snapshots: DataFrame) -> DataFrame:
    """(namespace, snapshot_no, delivered_at), one row per snapshot; snapshots without time are left out."""
    return snapshots.groupBy("namespace", "snapshot_no").agg(F.max("delivered_at").alias("delivered_at")).where("delivered_at is not null")


def as_of(refs: DataFrame, snapshots: DataFrame, time: str, unit: str = "week") -> DataFrame:
    """Adds (snapshot_no, at): the last snapshot of the row's namespace delivered at or before its time.

    For each namespace and week of a reference (or another unit of date_trunc) one small window carries
    the last snapshot before that week; a row then meets it and the week's own snapshots by an equality
    join. So nothing grows with both references and snapshots, and a namespace with a third of all
    references is no single task's.
    """
    day = F.date_trunc(unit, F.col(time)).cast("date")
    days = refs.select("namespace", day.alias("day")).distinct()
    s = snapshots.select("namespace", F.struct("delivered_at", "snapshot_no").alias("s"))
    line = days.select("namespace", "day", F.col("day").cast("timestamp_ntz").alias("t"), F.lit(None).cast(dict(s.dtypes)["s"]).alias("s"))
    line = line.unionByName(s.select("namespace", F.lit(None).cast("date").alias("day"), F.col("s.delivered_at").cast("timestamp_ntz").alias("t"), "s"))
    before = F.last("s", ignorenulls=True).over(W.partitionBy("namespace").orderBy("t", F.col("day").isNull()).rowsBetween(W.unboundedPreceding, 0))
    carried = line.withColumn("before", before).where("day is not null").select("namespace", "day", "before")
    own = s.groupBy("namespace", F.date_trunc(unit, "s.delivered_at").cast("date").alias("day")).agg(F.collect_list("s").alias("own"))
    known = carried.join(own, ["namespace", "day"], "left").select(
        "namespace", F.col("day").alias("_day"), F.concat(F.array_compact(F.array("before")), F.coalesce("own", F.array().cast(dict(own.dtypes)["own"]))).alias("_line")
    )
    last = F.array_max(F.filter("_line", lambda x: x.delivered_at <= F.col(time)))
    rows = refs.withColumn("_day", day).join(small(known), ["namespace", "_day"], "left").withColumn("_last", last)
    return rows.withColumns({"snapshot_no": F.col("_last.snapshot_no"), "at": F.col("_last.delivered_at")}).drop("_day", "_line", "_last")


def orphans_in_time(refs: DataFrame, inventory: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds ref_status to those of ``refs`` whose value the inventory did not hold at their time.

    refs: namespace, ref_value, ref_time and any other columns; rows with a null or blank value, no
    time or no namespace are ignored. inventory: namespace, snapshot_no, value. snapshots: see delivered().
    The key is (namespace, value, the last snapshot delivered at or before the time); where none was
    delivered its last column is null. Under partial match a full key is an orphan if that snapshot lacks
    the value, and a key without snapshot if all snapshots lack it. Status: ``missing`` if the value is
    in no snapshot, ``deleted`` if in one delivered before that last one, else ``late``; a value of a
    later snapshot is late where nothing was delivered yet. Repeated references give repeated rows.
    """
    used = (
        refs.drop("ref_status").select("namespace", "ref_value", "ref_time", F.struct("*").alias("ref"))
        .where(F.col("namespace").isNotNull() & F.col("ref_time").isNotNull() & (F.btrim("ref_value", F.lit(WHITE)) != ""))
    )
    timed = as_of(used, snapshots, "ref_time")
    keys = ["namespace", "ref_value", "snapshot_no"]
    held = inventory.select("namespace", F.col("value").alias("ref_value"), "snapshot_no")
    known = broadcast_if_small(snapshots.select("namespace", "snapshot_no", "delivered_at"))
    held = held.join(known, ["namespace", "snapshot_no"])
    gone = cut(orphan_keys(timed, held, keys, "partial", nullable=["snapshot_no"]))
    dated = gone.where("null_mask = 0")
    values = dated.select("namespace", "ref_value").distinct()
    first = held.join(broadcast_if_small(values), ["namespace", "ref_value"], "left_semi").groupBy("namespace", "ref_value").agg(F.min("delivered_at").alias("first"))
    dated = small(dated.join(first, ["namespace", "ref_value"], "left").select(*keys, "first"))
    status = F.when(F.col("first").isNull(), "missing").when(F.col("first") < F.col("at"), "deleted").otherwise("late")
    dated = timed.where("snapshot_no is not null").join(dated, keys).select("ref.*", status.alias("ref_status"))
    nowhere = broadcast_if_small(gone.where("null_mask <> 0").select("namespace", "ref_value", F.lit("missing").alias("found")))
    early = timed.where("snapshot_no is null").join(nowhere, ["namespace", "ref_value"], "left")
    return dated.unionByName(early.select("ref.*", F.coalesce("found", F.lit("late")).alias("ref_status")))
