"""A versioned inventory with compare-and-swap commits and a deletion history."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.checks import check, optional, whole
from plumbline.findings import emit, finding, none
from plumbline.operators.incremental import GenerationStore, StaleRunError
from plumbline.plans.planning import Guards, UpdatePlan, plan_update
from plumbline.plans.snapshot import CHUNK_COLUMNS, Snapshot, UnsafePlanError, verify_snapshot

FORMAT = 2
#: What a table that can't be read raises, when it is planned or when it is run.
UNREADABLE = (PySparkException, Py4JJavaError)
# The columns of the history and of its summary.
HISTORY = (
    "sequence int, committed_at string, base_revision string, revision string, before_chunks bigint, after_chunks bigint, added_chunks bigint,"
    " removed_chunks bigint, ordinary_removed_chunks bigint, allowance_removed_chunks bigint, retirement_removed_chunks bigint, policy string"
)
CATEGORIES = ("ordinary_removed_chunks", "allowance_removed_chunks", "retirement_removed_chunks")


def last_commits(history: DataFrame, n: int) -> DataFrame:
    """The last commits of each namespace; repeated rows count once, partial limits run before the shuffle."""
    check({"last_commits": n}, last_commits=whole(1))
    newest = F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("sequence")))
    return history.distinct().withColumn("_rank", newest).where(F.col("_rank") <= n).drop("_rank")


def deletion_summaries(history: DataFrame, commits: int = 10) -> DataFrame:
    """A row of measurements over the last commits of each namespace (columns of HISTORY).

    If the window starts with an empty inventory and holds the first population besides later commits,
    that prefix is left out. Fractions are null where the inventory starts empty, sums of a category
    where a commit lacks it. Repeated rows count once. The window's partial limit keeps the last
    commits of each namespace before the shuffle.
    """
    h = history.select("namespace", "sequence", "before_chunks", "after_chunks", "added_chunks", "removed_chunks", *CATEGORIES).distinct()
    first = h.where("after_chunks > 0").groupBy("namespace").agg(F.min(F.struct("sequence", "before_chunks")).alias("first"))
    last = last_commits(h, commits)
    ends = last.groupBy("namespace").agg(F.min(F.struct("sequence", "before_chunks")).alias("oldest"), F.max("sequence").alias("newest"))
    prefix = (
        (F.col("oldest.before_chunks") == 0) & (F.col("first.before_chunks") == 0)
        & (F.col("oldest.sequence") <= F.col("first.sequence")) & (F.col("first.sequence") < F.col("newest"))
    )
    edge = ends.join(first, "namespace", "left").select("namespace", F.when(F.coalesce(prefix, F.lit(False)), F.col("first.sequence")).otherwise(-1).alias("edge"))
    kept = F.col("sequence") > F.col("edge")
    total = lambda c: F.when(F.count_if(kept & F.col(c).isNull()) == 0, F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)))
    row = last.join(edge, "namespace").groupBy("namespace").agg(
        F.count_if(kept).alias("commits_considered"), F.count_if(~kept).alias("initial_commits_excluded"),
        F.min_by("before_chunks", F.when(kept, F.col("sequence"))).alias("start_chunks"), F.max_by("after_chunks", F.when(kept, F.col("sequence"))).alias("end_chunks"),
        F.coalesce(F.sum(F.when(kept, F.col("added_chunks"))), F.lit(0)).alias("chunks_added"),
        F.coalesce(F.sum(F.when(kept, F.col("removed_chunks"))), F.lit(0)).alias("chunks_removed"),
        *[total(c).alias(c) for c in CATEGORIES],
    )
    return _measured(row, commits)


def _measured(row: DataFrame, last_commits: int) -> DataFrame:
    shrink = F.greatest(F.col("start_chunks") - F.col("end_chunks"), F.lit(0))
    basis = F.when(F.col("initial_commits_excluded") > 0, "after_initial_population").when(F.col("commits_considered") > 0, "before_oldest_commit").otherwise("current_inventory_no_commits")
    share = lambda c: F.when(F.col("start_chunks") > 0, c / F.col("start_chunks"))
    unclassified = F.col(CATEGORIES[0]).isNull() | F.col(CATEGORIES[1]).isNull() | F.col(CATEGORIES[2]).isNull()
    return row.select(
        "namespace", F.lit(last_commits).cast("bigint").alias("requested_commits"), "commits_considered", (F.col("initial_commits_excluded") > 0).alias("window_adjusted"),
        "initial_commits_excluded", basis.alias("baseline_basis"), "start_chunks", "end_chunks", "chunks_added", "chunks_removed", *CATEGORIES,
        (F.col("end_chunks") - F.col("start_chunks")).alias("net_chunk_change"), shrink.alias("net_shrink_chunks"),
        share(shrink).alias("net_shrink_fraction"), share(F.col("chunks_removed")).alias("gross_removed_fraction"), unclassified.alias("removal_unclassified"),
    )


class Ledger:
    """Generations of (documents, chunks) under numbered commits; each commit holds its history row.

    Documents carry their chunk_count, so counting the corpus reads no chunk, and chunks are
    written in order of document_id, so a lookup of some documents prunes files and row groups.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.store, self.read_only = spark, GenerationStore(spark, path), read_only
        if not read_only:
            self._upgrade()

    def _state(self) -> tuple[int, dict] | None:
        found = self.store.last()
        if found is not None and found[1].get("format_version") != FORMAT:
            old = found[1].get("format_version") == FORMAT - 1
            raise ValueError("the ledger must be upgraded: open it for writing" if old else "unsupported ledger format")
        return found

    def _upgrade(self) -> None:
        """A ledger of the format before, which kept no history, gets a commit of this one: its inventory
        and revision stay, its history starts here and isn't complete."""
        found = self.store.last()
        if found is None or found[1].get("format_version") != FORMAT - 1:
            return
        number, state = found
        chunks = self.spark.read.parquet(f"{state['folder']}/documents").agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
        try:
            self.store.publish(number + 1, {**state, "format_version": FORMAT, "history": None, "history_complete": False, "baseline_chunks": chunks})
        except StaleRunError:
            pass  # another one upgraded it

    def revision(self) -> str | None:
        s = self._state()
        return None if s is None else s[1]["revision"]

    def current(self) -> Snapshot | None:
        s = self._state()
        if s is None:
            return None
        docs, chunks = (self.spark.read.parquet(f"{s[1]['folder']}/{t}") for t in ("documents", "chunks"))
        return Snapshot(s[1]["namespace"], s[1]["pipeline_id"], s[1]["embedding_model"], docs, chunks)

    def counts(self) -> dict[str, int]:
        now = self.current()
        if now is None:
            return {"documents": 0, "chunks": 0}
        row = now.documents.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
        return {"documents": row[0], "chunks": row[1]}

    def document_ids(self) -> DataFrame:
        now = self.current()
        return self.spark.createDataFrame([], "document_id string") if now is None else now.documents.select("document_id").orderBy("document_id")

    def chunk_ids(self) -> DataFrame:
        now = self.current()
        return self.spark.createDataFrame([], "chunk_id string") if now is None else now.chunks.select("chunk_id", "document_id").orderBy("document_id", "chunk_id").select("chunk_id")

    def load_documents(self, ids: DataFrame) -> Snapshot | None:
        """Only the named documents."""
        now = self.current()
        if now is None:
            return None
        ids = ids.select("document_id").distinct()
        return Snapshot(now.namespace, now.pipeline_id, now.embedding_model, *(df.join(ids, "document_id", "left_semi") for df in (now.documents, now.chunks)))

    def history(self, limit: int | None = None) -> DataFrame:
        """Newest first; one small row per commit, read from the commit files."""
        check({"limit": limit}, limit=optional(whole(1)))
        # At most two commits hold no history: the upgrade's and the one before it.
        rows = [c["history"] for _, c in reversed(self.store.commits(None if limit is None else limit + 2)) if c.get("history")]
        names = [x.split()[0] for x in HISTORY.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows[:limit]], HISTORY)

    def deletion_summary(self, last_commits: int = 10) -> DataFrame:
        """One row; without commits it is that of the current inventory."""
        s, chunks = self._state(), self.counts()["chunks"]
        name = s[1]["namespace"] if s else ""
        out = deletion_summaries(self.history().withColumn("namespace", F.lit(name)), last_commits)
        if out.isEmpty():
            zero = {c: F.lit(0).cast("bigint").alias(c) for c in ("commits_considered", "initial_commits_excluded", "chunks_added", "chunks_removed", *CATEGORIES)}
            now = {c: F.lit(chunks).cast("bigint").alias(c) for c in ("start_chunks", "end_chunks")}
            out = _measured(self.spark.range(1).select(F.lit(name).alias("namespace"), *zero.values(), *now.values()), last_commits)
        complete, base = (s[1]["history_complete"], s[1]["baseline_chunks"]) if s else (True, 0)
        return out.withColumns({"history_complete": F.lit(complete), "baseline_chunks_at_history_start": F.lit(base).cast("bigint")})

    def plan(self, candidate: Snapshot, guards: Guards | None = None) -> UpdatePlan:
        """A plan that loads only the documents concerned; the corpus is counted from the documents."""
        g, now, s = guards or Guards(), self.current(), self._state()
        if now is None:
            return plan_update(None, candidate, g, 0)
        ids = candidate.documents.select("document_id").unionByName(self.spark.createDataFrame([(i,) for i in g.retire_documents], "document_id string"))
        scope = self.load_documents(ids)
        if (candidate.pipeline_id, candidate.embedding_model) != (now.pipeline_id, now.embedding_model) and not now.documents.join(ids, "document_id", "left_anti").isEmpty():
            raise UnsafePlanError("a change of pipeline or model needs all retained documents in the batch")
        plan = plan_update(scope, candidate, g, self.counts()["chunks"])
        return UpdatePlan(s[1]["revision"], plan.actions, plan.target, plan.policy, g)

    def commit(self, plan: UpdatePlan, committed_at: str | None = None) -> str:
        """Publish the plan's target if the base is still current; a plan that changes nothing writes nothing."""
        if self.read_only:
            raise UnsafePlanError("the ledger is open for reading only")
        s, now = self._state(), self.current()
        if (s[1]["revision"] if s else None) != plan.base_revision:
            raise UnsafePlanError("stale plan: the ledger has changed")
        if now is not None and now.namespace != plan.target.namespace:
            raise UnsafePlanError("the namespaces differ")
        touched = plan.target.documents.select("document_id").unionByName(self.spark.createDataFrame([(i,) for i in plan.guards.retire_documents], "document_id string"))
        if now is not None and not plan.guards.retire_documents:
            scope = self.load_documents(touched)
            if scope.revision() == plan.target.revision():
                return plan.base_revision
        before, folder = self.counts()["chunks"], self.store.new_folder()
        docs, chunks = plan.target.documents.select("document_id", "source_version"), plan.target.chunks.select(*CHUNK_COLUMNS)
        if now is not None:
            docs = docs.unionByName(now.documents.join(touched, "document_id", "left_anti").select("document_id", "source_version"))
            chunks = chunks.unionByName(now.chunks.join(touched, "document_id", "left_anti").select(*CHUNK_COLUMNS))
        chunks.repartitionByRange("document_id", "chunk_id").sortWithinPartitions("document_id").write.parquet(f"{folder}/chunks")
        chunks = self.spark.read.parquet(f"{folder}/chunks")
        n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        docs.join(n, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).write.parquet(f"{folder}/documents")
        added = plan.actions.where("action = 'added'").count()
        removed = plan.policy["proposed_deletions"]
        revision = hashlib.sha256(json.dumps([plan.base_revision, plan.plan_id()]).encode()).hexdigest()
        number = s[0] + 1 if s else 1
        history = {
            "sequence": number, "committed_at": committed_at or datetime.now(timezone.utc).isoformat(), "base_revision": plan.base_revision, "revision": revision,
            "before_chunks": before, "after_chunks": before + added - removed, "added_chunks": added, "removed_chunks": removed,
            **{c: plan.policy[c] for c in CATEGORIES}, "policy": json.dumps(plan.policy, sort_keys=True),
        }
        content = {
            "format_version": FORMAT, "namespace": plan.target.namespace, "pipeline_id": plan.target.pipeline_id, "embedding_model": plan.target.embedding_model,
            "revision": revision, "folder": folder, "history": history,
            "history_complete": s[1]["history_complete"] if s else True, "baseline_chunks": s[1]["baseline_chunks"] if s else 0,
        }
        try:
            self.store.publish(number, content)
        except StaleRunError:
            raise UnsafePlanError("stale plan: another commit came first") from None
        return revision

    def verify(self) -> DataFrame:
        """Findings about the current generation; nothing is repaired."""
        s = self._state()
        if s is None:
            return none(self.spark)
        one = self.spark.range(1)
        try:
            now = self.current()
        except UNREADABLE as e:
            return emit(one, [finding("ledger_integrity", message=f"The stored tables can't be read: {type(e).__name__}.")])
        for rows in (now.documents, now.chunks):
            try:  # files that are gone or broken show when all their columns are read
                rows.agg(F.bit_xor(F.xxhash64(*rows.columns))).collect()
            except UNREADABLE as e:
                return emit(one, [finding("ledger_integrity", message=f"The stored tables can't be read: {type(e).__name__}.")])
        text = [s[1].get(k) for k in ("namespace", "pipeline_id", "embedding_model")]
        rev = s[1].get("revision")
        bad = any(not isinstance(v, str) or not v.strip() for v in text) or not isinstance(rev, str) or len(rev) != 64 or set(rev) - set("0123456789abcdef")
        out = emit(one, [F.when(F.lit(bool(bad)), finding("ledger_state", message="Invalid ledger identity or revision."))])
        by_chunk = verify_snapshot(now)
        owner = now.chunks.select(F.col("chunk_id").alias("id"), "document_id").distinct()
        hit = by_chunk.join(owner, "id", "left").select(F.coalesce("document_id", "id").alias("document_id"))
        n = now.chunks.groupBy("document_id").agg(F.count("*").alias("n"))
        wrong = now.documents.join(n, "document_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("chunk_count")).select("document_id")
        docs = hit.unionByName(wrong).distinct()
        return out.unionByName(emit(docs, [finding("ledger_document_corrupt", message="Stored document fails its verification.", document_id=F.col("document_id"))]))
