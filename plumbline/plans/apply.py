"""Guarded application of an update: plan, embed, verify, write, verify, commit; and recovery.

The ledger is committed last. Whatever fails before leaves a pending operation whose vectors are
kept, so that recovery embeds only what is missing; whatever is written twice is written alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.findings import emit, finding
from plumbline.functions import canonical as C
from plumbline.operators.cost import estimate_cost
from plumbline.operators.incremental import GenerationStore
from plumbline.operators.vectors import lone_ids, payload_mismatches
from plumbline.plans.index_store import PayloadStore
from plumbline.plans.ledger import Ledger
from plumbline.plans.planning import Guards, UpdatePlan, audit_plan_embeddings
from plumbline.plans.snapshot import InvalidBatchError, Snapshot, UnsafePlanError, build_snapshot


@dataclass(frozen=True)
class Embedder:
    """What makes vectors of texts, and how it calls itself. Its labels are declarations of the producer."""

    embed: Callable[[list[str]], list[list[float]]]
    model: str
    pipeline: str


def fake_embedder(dimensions: int = 8, model: str = "fake-model", pipeline: str = "fake-pipeline") -> Embedder:
    """Unit vectors made from a hash of each text; for tests and dry runs."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = hashlib.shake_256(t.encode("utf-8", "surrogatepass")).digest(2 * dimensions)
            v = [int.from_bytes(raw[i : i + 2], "big") / 32768 - 1 for i in range(0, len(raw), 2)]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return Embedder(embed, model, pipeline)


VECTORS = "chunk_id string, vector array<double>, input_hash string, embedding_model string, pipeline_id string"


def embed_inputs(inputs: DataFrame, embedder: Embedder, batch: int = 16) -> DataFrame:
    """VECTORS of inputs (chunk_id, text), in requests of a bounded number of texts. input_hash is that of
    the text that was sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                vectors = embedder.embed(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the embedder returned another number of vectors")
                yield pd.DataFrame({"chunk_id": part["chunk_id"].tolist(), "vector": vectors, "input_hash": part["input_hash"].tolist()})

    sent = inputs.select("chunk_id", "text", C.text_hash(F.col("text")).alias("input_hash"))
    made = sent.mapInPandas(run, ", ".join(VECTORS.split(", ")[:3]))
    return made.withColumns({"embedding_model": F.lit(embedder.model), "pipeline_id": F.lit(embedder.pipeline)})


@dataclass(frozen=True)
class Budget:
    price_per_million: object
    currency: str
    limit: object


class GuardedIndex:
    """A ledger, a payload store and the pending operations between them, under one folder."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int) -> None:
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions
        self.ledger, self.payloads = Ledger(spark, f"{self.path}/ledger"), PayloadStore(spark, f"{self.path}/payloads")
        self.journal = GenerationStore(spark, f"{self.path}/journal")

    def pending(self) -> dict | None:
        """The operation that was begun and not finished, if any."""
        c = self.journal.last()
        return c[1] if c and c[1]["status"] == "begun" else None

    def _log(self, content: dict) -> None:
        c = self.journal.last()
        self.journal.publish(c[0] + 1 if c else 1, content)

    def check(self) -> DataFrame:
        """Ids that only the ledger or only the store has."""
        return lone_ids(self.ledger.chunk_ids(), self.payloads.ids())

    def plan(self, candidate: Snapshot, guards: Guards | None = None) -> UpdatePlan:
        if self.pending() is not None:
            raise UnsafePlanError("an operation is pending; recover it first")
        if not self.check().isEmpty():
            raise UnsafePlanError("ledger and store disagree")
        return self.ledger.plan(candidate, guards)

    def apply(
        self, candidate: Snapshot, chunks: DataFrame, embedder: Embedder, guards: Guards | None = None,
        budget: Budget | None = None, token_counts: DataFrame | None = None,
    ) -> str:
        """Apply a candidate. chunks: chunk_id, text, metadata of all its chunks. Returns the revision."""
        plan = self.plan(candidate, guards)
        if budget is not None:
            cost = estimate_cost(plan.embed_ids(), token_counts, budget.price_per_million, budget.currency).cost
            if cost > type(cost)(str(budget.limit)):
                raise UnsafePlanError(f"the cost of {cost} {budget.currency} exceeds the budget")
        folder = self.journal.new_folder()
        chunks.select("chunk_id", "text", "metadata").join(plan.upsert_ids(), "chunk_id", "left_semi").write.parquet(f"{folder}/inputs")
        self._log({"status": "begun", "folder": folder, "base": plan.base_revision, "target": plan.target.revision()})
        return self._finish(plan, folder, embedder)

    def recover(self, candidate: Snapshot, embedder: Embedder, guards: Guards | None = None) -> str:
        """Finish the pending operation of this candidate; nothing is embedded twice."""
        op = self.pending()
        if op is None:
            raise UnsafePlanError("nothing is pending")
        plan = self.ledger.plan(candidate, guards)
        if plan.base_revision != op["base"]:
            if not plan.actions.where("action <> 'unchanged'").isEmpty():
                raise UnsafePlanError("the ledger has moved on; rebuild the plan")
            self._log({**op, "status": "done"})
            return plan.base_revision
        if plan.target.revision() != op["target"]:
            raise UnsafePlanError("the candidate isn't that of the pending operation")
        return self._finish(plan, op["folder"], embedder)

    def _vectors(self, folder: str) -> DataFrame:
        path = self.journal._Path(f"{folder}/vectors")
        return self.spark.read.schema(VECTORS).parquet(f"{folder}/vectors") if self.journal._fs.exists(path) else self.spark.createDataFrame([], VECTORS)

    def _finish(self, plan: UpdatePlan, folder: str, embedder: Embedder) -> str:
        inputs = self.spark.read.parquet(f"{folder}/inputs")
        todo = inputs.join(plan.embed_ids(), "chunk_id", "left_semi").join(self._vectors(folder), "chunk_id", "left_anti")
        embed_inputs(todo, embedder).write.mode("append").parquet(f"{folder}/vectors")
        new = self._vectors(folder)
        bad = audit_plan_embeddings(plan, new.withColumn("embedding_index", F.xxhash64("chunk_id")), self.dimensions)
        # Payloads that keep their vectors bring their texts along; these must be the planned ones, too.
        other = inputs.join(plan.target.chunks, "chunk_id").where(~C.text_hash(F.col("text")).eqNullSafe(F.col("text_hash")))
        bad = bad.unionByName(emit(other, [finding("embedding_provenance_mismatch", message="The payload's text is not the planned one.", document_id=F.col("document_id"), chunk_key=F.col("chunk_key"))]))
        row = bad.where("severity = 'error'").select("code").first()
        if row is not None:
            raise UnsafePlanError(f"the vectors fail their audit: {row[0]}")
        # A chunk whose metadata alone changed keeps its vector.
        prior = self.payloads.rows().select("chunk_id", F.col("vector").alias("old"))
        upserts = inputs.join(new.select("chunk_id", "vector"), "chunk_id", "left").join(prior, "chunk_id", "left").select("chunk_id", "text", "metadata", F.coalesce("vector", "old").alias("vector"))
        upserts.write.mode("overwrite").parquet(f"{folder}/upserts")
        upserts = self.spark.read.parquet(f"{folder}/upserts")
        self.payloads.upsert(upserts)
        wrong = payload_mismatches(upserts, self.payloads.get(upserts)).first()
        if wrong is not None:
            raise UnsafePlanError(f"the store doesn't return what was written: {wrong.label}")
        self.payloads.delete(plan.removed_ids())
        op = self.pending()
        revision = self.ledger.commit(plan)
        wrong = self.check().first()
        if wrong is not None:
            raise UnsafePlanError(f"ledger and store disagree: {wrong.label}")
        self._log({**op, "status": "done", "revision": revision})
        return revision


def compare_omission(index: GuardedIndex, documents: DataFrame, receipts: DataFrame, chunks: DataFrame, document_id: str, unit: str, clone_path: str) -> dict:
    """What the loss of one unit of one document does to an index, without guards and with them.

    On a copy of the store the ids that a re-extraction without the unit no longer names are deleted, as
    a naive replacement would. The guarded way is given the same batch with the unit's failure in its
    receipt; it must refuse it and leave the index as it is. The result counts both.
    """
    spark, ledger = index.spark, index.ledger
    if index.pending() is not None or not index.check().isEmpty() or ledger.revision() is None:
        raise UnsafePlanError("the index must be complete and nothing pending")
    now, lost = ledger.current(), F.array_contains("units", unit)
    rest = chunks.where(~((F.col("document_id") == document_id) & F.coalesce(lost, F.lit(False))))
    named = rest.where(F.col("document_id") == document_id).select(C.chunk_id(F.lit(now.namespace), F.col("document_id"), F.col("chunk_key")).alias("chunk_id"))
    gone = now.chunks.where(F.col("document_id") == document_id).select("chunk_id").join(named, "chunk_id", "left_anti")
    removed = gone.count()
    if not removed:
        raise ValueError("the unit holds nothing that the index has")
    clone = PayloadStore(spark, clone_path)
    clone.upsert(index.payloads.rows())
    clone.delete(gone)

    hit = (F.col("document_id") == document_id) & F.array_contains("processed_units", unit)
    failed = receipts.withColumns({
        "processed_units": F.when(hit, F.array_remove("processed_units", unit)).otherwise(F.col("processed_units")),
        "failed_units": F.when(hit, F.array_union(F.coalesce("failed_units", F.array().cast("array<string>")), F.array(F.lit(unit)))).otherwise(F.col("failed_units")),
    })
    before = ledger.revision()
    try:
        build_snapshot(documents, failed, rest, now.namespace, now.pipeline_id, now.embedding_model)
    except InvalidBatchError as e:
        codes = e.codes
    else:
        raise UnsafePlanError("the guarded way accepted a batch with a failed unit")
    kept = ledger.revision() == before and index.check().isEmpty()
    return {"naive_candidate_ids": named.distinct().count(), "naive_removed_ids": removed, "naive_remaining_ids": clone.ids().count(), "guarded_codes": codes, "guarded_index_preserved": kept}
