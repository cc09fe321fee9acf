"""Session-level helpers: shared folders, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: A side is broadcast only after it was measured and found to hold at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset (local tests) is a
    temporary folder of this machine used and set as checkpoint directory.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        sc.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint.

    What was shuffled for it is of no use afterwards and is removed at once, not when the driver happens
    to collect its garbage, which may be after the disk is full.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting counts for DataFrames made under it
    finally:
        spark.conf.set(CLEANUP, before)


def _bytes(field: StructField) -> Column:
    """About how many bytes a value of the column takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def _width(df: DataFrame) -> Column:
    return sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it was measured to hold at most ``rows`` rows and about ``size`` bytes,
    else df as it is.

    Measuring stops after ``rows + 1`` rows. Beyond the bounds the planner shuffles both sides and
    adaptive execution splits skewed partitions. Callers pass a df that is cut or cheap to compute.
    """
    n, total = df.select(_width(df).alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def small(df: DataFrame) -> DataFrame:
    """A side that is expected to be small: computed once and measured on the way, then broadcast if it is
    (see broadcast_if_small)."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("size")))
    got = seen.get
    return F.broadcast(out) if got.get("rows", 0) <= BROADCAST_ROWS and (got.get("size") or 0) <= BROADCAST_BYTES else out
