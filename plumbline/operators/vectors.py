"""Audit of embeddings, and exact nearest-neighbour search for a stated query set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.findings import emit, finding, union
from plumbline.functions import vectors as V
from plumbline.session import cut, small


#: Queries that are sent out at once.
QUERY_BLOCK = 10_000


def audit_embeddings(
    expected: DataFrame, embeddings: DataFrame, dimensions: int, detect_duplicates: bool = True,
    norm_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Findings about embeddings (embedding_index, chunk_id, vector) against the expected chunk_id's.

    embedding_index orders them: of several with one id, or several equal vectors, the first is the
    original. A record that isn't a mapping has is_record false, where there is such a column, and no
    other finding. Null vectors are invalid. A zero vector can also be a duplicate, one of another length
    can't. Vectors meet by their digest, with map-side combination, never as arrays in a shuffle.
    """
    if type(dimensions) is not int or dimensions < 1:
        raise ValueError("dimensions must be a positive integer")
    if norm_range is not None and not 0 <= norm_range[0] <= norm_range[1] < float("inf"):
        raise ValueError("norm_range must be finite bounds 0 <= min <= max")
    ids = expected.select("chunk_id").where("chunk_id is not null").distinct().withColumn("known", F.lit(True))
    parts = []
    if "is_record" in embeddings.columns:
        bad = F.when(~F.coalesce("is_record", F.lit(True)), finding("invalid_embedding", message="Embedding record is not a mapping.", chunk_index=F.col("embedding_index")))
        parts, embeddings = [emit(embeddings, [bad])], embeddings.where(F.coalesce("is_record", F.lit(True)))
    raw = embeddings.select(F.col("embedding_index").cast("bigint").alias("chunk_index"), "chunk_id", V.doubles(F.col("vector")).alias("v"))
    v = F.col("v")
    fine = F.coalesce(V.finite(v), F.lit(False))
    # One pass over the vectors; the checks need numbers about them only.
    facts = raw.select(
        "chunk_index", "chunk_id", v.isNull().alias("absent"), F.size(v).alias("n"), fine.alias("fine"), (fine & V.all_zero(v)).alias("zero"),
        (V.norm(v) if norm_range is not None else F.lit(None).cast("double")).alias("size"), F.xxhash64(F.lit(3), "v").alias("d1"), F.xxhash64(F.lit(5), "v").alias("d2"),
    )
    e = cut(facts.join(ids, "chunk_id", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    at = dict(chunk_index=F.col("chunk_index"))
    n, here = F.col("n"), ~F.col("absent")
    found = [
        F.when(~F.col("known"), finding("unexpected_embedding", message="Embedding has an unexpected chunk_id.", **at)),
        F.when(F.col("absent"), finding("invalid_vector", message="Vector must be a list of numbers.", **at)),
        F.when(here & (n != dimensions), finding("embedding_dimensions", message=F.concat(F.lit(f"Expected {dimensions} dimensions; got "), n.cast("string")), **at)),
        F.when(here & ~F.col("fine"), finding("nonfinite_embedding", message="Vector holds values that are not finite numbers.", **at)),
        F.when(F.col("zero"), finding("zero_embedding", message="Vector holds only zeros.", **at)),
    ]
    if norm_range is not None:
        off = F.col("fine") & ~F.col("size").between(*map(float, norm_range))
        found.append(F.when(off, finding("embedding_norm_outlier", message=F.concat(F.lit("Norm out of range: "), F.round("size", 6).cast("string")), **at)))
    parts.append(emit(e, found))

    known = e.where("known")
    first = known.groupBy("chunk_id").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n"))
    again = known.select("chunk_index", "chunk_id").join(small(first.where("n > 1").drop("n")), "chunk_id").where("chunk_index <> first")
    parts.append(emit(again, [finding("duplicate_embedding", message="More than one embedding for a chunk id.", **at)]))
    missing = ids.join(known.select("chunk_id"), "chunk_id", "left_anti")
    parts.append(emit(missing, [finding("missing_embedding", message=F.concat(F.lit("No vector for chunk id "), F.col("chunk_id")))]))

    if detect_duplicates:
        d = known.where(F.col("fine") & (n == dimensions)).join(again.select("chunk_index"), "chunk_index", "left_anti").select("chunk_index", "chunk_id", "d1", "d2")
        head = d.groupBy("d1", "d2").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("h"), F.count("*").alias("n")).where("n > 1").drop("n")
        twin = d.join(small(head), ["d1", "d2"]).where("chunk_index <> h.chunk_index")
        text = F.concat(F.lit("Vector matches that of chunk id "), F.col("h.chunk_id"))
        parts.append(emit(twin, [finding("duplicate_vector", message=text, **at)]))
    return union(parts)


def audit_provenance(targets: DataFrame, embeddings: DataFrame, model: str, pipeline: str) -> DataFrame:
    """A finding per recorded field that isn't the planned one. targets: chunk_id, document_id, chunk_key, text_hash."""
    j = embeddings.select("embedding_index", "chunk_id", "embedding_model", "pipeline_id", "input_hash").join(targets.select("chunk_id", "document_id", "chunk_key", "text_hash"), "chunk_id")
    want = {"embedding_model": F.lit(model), "pipeline_id": F.lit(pipeline), "input_hash": F.col("text_hash")}
    at = dict(document_id=F.col("document_id"), chunk_index=F.col("embedding_index"), chunk_key=F.col("chunk_key"))
    return emit(j, [F.when(~F.col(k).eqNullSafe(v), finding("embedding_provenance_mismatch", message=f"{k} is not that of the planned input.", **at)) for k, v in want.items()])


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, place): the k nearest of base (id, vector) by squared L2, ties by id.

    Exact: a stated query set against all rows. The queries (query_id, vector) are sent out in blocks of
    a bounded number, each a pass over base; every task ranks its own rows before the shuffle (a
    partial limit), which moves k rows per query and task. Vectors of unequal length aren't compared,
    nor are null ones.
    """
    if type(k) is not int or k < 1:
        raise ValueError("k must be a positive integer")
    q = queries.select("query_id", V.doubles(F.col("vector")).alias("q"))
    b = base.select("id", V.doubles(F.col("vector")).alias("v"))
    blocks = 1 + q.count() // QUERY_BLOCK
    parts = []
    for i in range(blocks):
        block = F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
        parts.append(b.join(block, F.size("q") == F.size("v")).select("query_id", "id", V.squared_l2(F.col("q"), F.col("v")).alias("distance")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    ranked = [p.withColumn("place", place).where(F.col("place") <= k) for p in parts]
    return reduce(lambda x, y: x.unionByName(y), ranked)


def payload_mismatches(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, label) of stored payloads (chunk_id, text, metadata, vector) against the planned ones."""
    a = expected.select("chunk_id", F.struct("text", F.array_sort(F.map_entries("metadata")).alias("metadata"), V.doubles(F.col("vector")).alias("vector")).alias("a"))
    b = stored.select("chunk_id", F.struct("text", F.array_sort(F.map_entries("metadata")).alias("metadata"), V.doubles(F.col("vector")).alias("vector")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    labels = F.array(
        F.when(F.col("b").isNull(), "missing_record"),
        F.when(F.col("a").isNull(), "orphan_id"),
        F.when(both & ~F.col("a.text").eqNullSafe(F.col("b.text")), "text_mismatch"),
        F.when(both & ~F.col("a.metadata").eqNullSafe(F.col("b.metadata")), "metadata_mismatch"),
        F.when(both & V.beyond_tolerance(F.col("a.vector"), F.col("b.vector")), "vector_mismatch"),
    )
    return a.join(b, "chunk_id", "full").select("chunk_id", F.explode(F.array_compact(labels)).alias("label"))


def lone_ids(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, label) of ids that only one side has: missing_id or orphan_id."""
    a, b = expected.select("chunk_id").distinct(), stored.select("chunk_id").distinct()
    both = a.withColumn("e", F.lit(True)).join(b.withColumn("s", F.lit(True)), "chunk_id", "full")
    return both.where("e is null or s is null").select("chunk_id", F.when(F.col("e").isNull(), "orphan_id").otherwise("missing_id").alias("label"))
