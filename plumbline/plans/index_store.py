"""A payload table (chunk_id, text, metadata, vector) in generations, and the contract it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.incremental import GenerationStore
from plumbline.operators.vectors import nearest

PAYLOAD = "chunk_id string, text string, metadata map<string,string>, vector array<double>"


class PayloadStore:
    """Every change writes a new generation and publishes it; readers see the last one.

    Upserts and deletes are an anti join of the old rows and a union: cost grows with the table, as it
    does for any table format without row-level deletes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, GenerationStore(spark, path)

    def rows(self) -> DataFrame:
        c = self.store.last()
        return self.spark.read.schema(PAYLOAD).parquet(c[1]["folder"]) if c else self.spark.createDataFrame([], PAYLOAD)

    def ids(self) -> DataFrame:
        return self.rows().select("chunk_id")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def upsert(self, payloads: DataFrame) -> None:
        names = [x.split()[0] for x in PAYLOAD.split(", ")]
        new = payloads.select(*[F.col(c) for c in names])
        self._replace(self.rows().join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> None:
        self._replace(self.rows().join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti"))

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest payloads of each query (query_id, vector), exactly."""
        return nearest(queries, self.rows().select(F.col("chunk_id").alias("id"), "vector"), k)

    def _replace(self, rows: DataFrame) -> None:
        c = self.store.last()
        folder = self.store.new_folder()
        rows.write.parquet(folder)
        self.store.publish(c[0] + 1 if c else 1, {"folder": folder})


def project_metadata(chunks: DataFrame, embedding_model: str | None = None, pipeline_id: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Adds the metadata that goes into the store. Its keys.

    chunks: document_id and any of namespace, chunk_key, source_version, units. Null values have no key.
    """
    have = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    units = F.to_json("units") if "units" in chunks.columns else F.lit(None).cast("string")
    values = {
        "source_id": have("document_id"), "source_version": have("source_version"), "units_json": units, "chunk_key": have("chunk_key"),
        "namespace": have("namespace"), "embedding_model": F.lit(embedding_model), "pipeline_id": F.lit(pipeline_id),
    }
    values |= {k: F.lit(v) for k, v in sorted((extra or {}).items())}
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return chunks.withColumn("metadata", F.map_filter(pairs, lambda _, v: v.isNotNull()))
