"""Processing only new or changed records, with a high watermark on a monotonic commit sequence.

A store is a folder of generations. A run fixes, before it reads anything else, the upper sequence
limit of every namespace; it processes the commits above the last watermark and up to that limit,
writes output, state and new watermarks into a folder of its own, and publishes all three at once by
creating the next numbered commit file, which fails if another run created it first. A run that dies
before leaves only an unreferenced folder; the next one starts from the same watermark. So no commit
is skipped or repeated.

Rows of commits below the watermark may still arrive: plans, snapshots, chunks, even the commit's own.
So a run keeps a digest of all that its processed commits were replayed from, per namespace. Of chunk rows
it takes their number and their load times, so finding out reads no id and no hash. Where the next run
finds another digest, it replays that namespace from its first commit and takes the place of all
generations before.

A run writes rows of the namespaces that it touches only: those with new commits, late rows or a new
newest snapshot. The marks name, for each namespace, the generation that holds its state (``home``). Live
generations are listed in the last commit; when there are COMPACT of them, a run copies what is valid
into its own, so neither readers nor runs open more folders than that.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import pack_hash
from plumbline.plans.snapshot import row_sums
from plumbline.session import broadcast_if_small, cut, small

STATE = "namespace string, chunk_id string, hash binary"
#: since: the generation from which on the namespace's ``repeated`` rows count. home: the generation of
#: its pending and state rows. newest: a digest of its newest snapshot.
MARKS = "namespace string, sequence int, digest array<bigint>, since int, home int, newest array<bigint>"
ROWS = "namespace string, revision string, chunk_id string, hash binary, generation int"
KINDS = ("repeated", "pending", "state")
#: Live generations at most; more are copied into one.
COMPACT = 16
#: So many touched namespaces are named in the filter of the chunk scan, which prunes files and row groups.
NAMED = 200


class StaleRunError(RuntimeError):
    """Another run committed first; nothing of this run became visible."""


class GenerationStore:
    """Numbered commits over any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.FileSystem.get(self._Path(self.path).toUri(), spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._Path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commits(self, last: int | None = None) -> list[tuple[int, dict]]:
        """(number, content) of each commit in order, or of the last ones: a small file each is read."""
        numbers = self._numbers()
        return [(n, self._read(f"{self.path}/commits/{n:010d}.json")) for n in (numbers if last is None else numbers[-last:])]

    def last(self) -> tuple[int, dict] | None:
        """The last commit; of the files only its own is read."""
        found = self.commits(1)
        return found[0] if found else None

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._Path(path))

    def new_folder(self) -> str:
        return f"{self.path}/runs/{uuid.uuid4().hex}"

    def publish(self, number: int, content: dict) -> None:
        """Atomic: the content is complete before it gets its name, and a name is given only once."""
        tmp, final = self._Path(f"{self.path}/tmp/{uuid.uuid4().hex}"), self._Path(f"{self.path}/commits/{number:010d}.json")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, final, options)
        except Exception as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise StaleRunError(f"commit {number} exists") from None
            raise

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._Path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()


class EmbeddingIncrement:
    """Replays embedding runs incrementally: what was embedded needlessly, what is still to embed.

    State per namespace and chunk: the embedding hash embedded last. Kinds of rows in a generation:
    ``repeated`` (namespace, revision, chunk_id: a run embedded what was already there; they add up
    over the generations since the namespace was last replayed from its first commit), ``pending`` (a chunk of the newest snapshot that is still to embed; only
    the last generation's count) and ``state``.

    Repeated input rows change nothing; of chunk_states the row with the greatest loaded_at counts.
    A plan succeeded if a commit has its namespace, base_revision and revision; successful plans are
    replayed by sequence, then created_at and plan_id. Null embed_ids embed nothing; plans whose
    revision is no delivered snapshot are left out, as are rows without namespace. A null hash is a
    value of its own; a null created_at or plan_id comes first.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, GenerationStore(spark, path)

    def run(self, commits: DataFrame, plans: DataFrame, chunk_states: DataFrame, document_states: DataFrame) -> int:
        """One run; returns its commit's number."""
        spark, done = self.spark, self.store.last()
        number, live = (done[0] + 1, done[1]["live"]) if done else (1, {})
        folder = self.store.new_folder()
        old = spark.read.schema(MARKS).parquet(f"{done[1]['folder']}/marks") if done else spark.createDataFrame([], MARKS)
        old = cut(old)  # a row per namespace

        # The upper limit is fixed first, by writing it: commits that arrive during the run wait.
        upper = commits.groupBy("namespace").agg(F.max("sequence").alias("sequence"))
        upper = cut(upper.unionByName(old.select("namespace", "sequence")).groupBy("namespace").agg(F.max("sequence").alias("sequence")))
        runs = (
            commits.select("namespace", "base_revision", "revision", "sequence")
            .join(upper.withColumnRenamed("sequence", "_to"), "namespace").where("sequence <= _to")
            .groupBy("namespace", "base_revision", "revision").agg(F.min("sequence").alias("sequence"))
        )
        # Runs and snapshots are few; each list is made once, however many chunks they have.
        runs, snapshots = cut(runs), cut(document_states.select("namespace", "snapshot_no", "revision").distinct())
        marks = cut(self._marks(upper, old, runs, plans, chunk_states, snapshots, number))
        touched = marks.where("touched").select("namespace")
        todo = runs.join(marks.where("touched").select("namespace", "_from"), "namespace").where("_from is null or sequence > _from").drop("_from")
        carried = marks.where("touched and _from is not null").select("namespace")
        state = self._valid(live, "state", old).join(broadcast_if_small(carried), "namespace", "left_semi").select("namespace", "chunk_id", "hash")
        names = [r[0] for r in touched.limit(NAMED + 1).collect()]
        chunks = chunk_states.where(F.col("namespace").isin(names)) if len(names) <= NAMED else chunk_states
        rows = self._replay(todo, plans, chunks, snapshots.join(touched, "namespace", "left_semi"), state)
        marks = marks.select("namespace", "sequence", "digest", "since", "home", "newest")
        if len(live) >= COMPACT:
            kept = {k: marks.where(F.col("home") != number) for k in KINDS} | {"repeated": marks.where(F.col("since") != number)}
            for k, of in kept.items():
                rows = rows.unionByName(self._valid(live, k, old).join(broadcast_if_small(of.select("namespace")), "namespace", "left_semi").withColumn("kind", F.lit(k)))
            live, marks = {}, marks.withColumns({"since": F.lit(number), "home": F.lit(number)})
        marks.write.parquet(f"{folder}/marks")
        rows.withColumn("generation", F.lit(number)).write.partitionBy("kind").parquet(f"{folder}/rows")
        self.store.publish(number, {"folder": folder, "base": number - 1, "live": {**live, str(number): folder}})
        return number

    def _marks(self, upper: DataFrame, old: DataFrame, runs: DataFrame, plans: DataFrame, chunk_states: DataFrame, snapshots: DataFrame, number: int) -> DataFrame:
        """The new marks, with the sequence _from which on to replay (null for all of the namespace) and
        whether the namespace is touched at all."""
        key = ["namespace", "base_revision", "revision"]
        asked = [F.xxhash64(F.lit(i), "embed_ids").alias(f"e{i}") for i in (1, 2)]
        steps = cut(plans.select(*key, "created_at", "plan_id", *asked).distinct().join(runs, key).join(snapshots, ["namespace", "revision"]))
        ends = snapshots.groupBy("namespace").agg(F.max(F.struct("snapshot_no", "revision")).alias("n")).select("namespace", "n.*")
        used = steps.select("namespace", "snapshot_no").union(ends.select("namespace", "snapshot_no")).distinct()
        held = chunk_states.select("namespace", "snapshot_no", "loaded_at").join(small(used), ["namespace", "snapshot_no"]).groupBy("namespace", "snapshot_no")
        held = cut(held.agg(F.array(F.count("*"), *row_sums([F.col("loaded_at")])).alias("held")))
        steps = cut(steps.join(held, ["namespace", "snapshot_no"], "left"))

        def digest(of: DataFrame, name: str) -> DataFrame:
            return of.groupBy("namespace").agg(F.array(*row_sums([F.col(c) for c in (*key[1:], "sequence", "created_at", "plan_id", "e1", "e2", "snapshot_no", "held")])).alias(name))

        old = old.select("namespace", *(F.col(c).alias(n) for c, n in (("sequence", "_from"), ("digest", "_digest"), ("since", "_since"), ("home", "_home"), ("newest", "_newest"))))
        before = steps.join(old.select("namespace", "_from"), "namespace").where("sequence <= _from")
        newest = ends.join(held, ["namespace", "snapshot_no"], "left").groupBy("namespace").agg(F.array(*row_sums([F.col("snapshot_no"), F.col("revision"), F.col("held")])).alias("newest"))
        every = upper.select("namespace").union(snapshots.select("namespace")).where("namespace is not null").distinct()
        marks = every.join(upper, "namespace", "left").join(old, "namespace", "left")
        for part in (digest(before, "_now"), digest(steps, "digest"), newest):
            marks = marks.join(part, "namespace", "left")
        none = F.array().cast("array<bigint>")
        same = F.coalesce("_now", none).eqNullSafe(F.col("_digest"))
        marks = marks.withColumn("_known", F.col("_home").isNotNull()).withColumn("_from", F.when(same, F.col("_from")))
        # A namespace without commits has no sequence; its look at the newest snapshot still counts.
        again = ~F.coalesce(same, F.lit(False)) | ~F.col("_known")
        now, was = F.coalesce("digest", none), F.coalesce("_digest", none)
        touched = again | ~now.eqNullSafe(was) | ~F.col("newest").eqNullSafe(F.col("_newest"))
        return marks.select(
            "namespace", "sequence", now.alias("digest"), F.when(again, number).otherwise(F.col("_since")).alias("since"),
            F.when(touched, number).otherwise(F.col("_home")).alias("home"), "newest", "_from", touched.alias("touched"),
        )

    def _replay(self, todo: DataFrame, plans: DataFrame, chunk_states: DataFrame, snapshots: DataFrame, state: DataFrame) -> DataFrame:
        key = ["namespace", "base_revision", "revision", "created_at", "plan_id"]
        ok = plans.select(*key).distinct().join(todo, key[:3]).join(snapshots, ["namespace", "revision"])
        line = W.partitionBy("namespace").orderBy("sequence", "created_at", "plan_id")
        steps = cut(ok.withColumn("step", F.row_number().over(line)))
        newest = snapshots.groupBy("namespace").agg(F.max(F.struct("snapshot_no", "revision")).alias("n"))
        count = steps.groupBy("namespace").agg(F.max("step").alias("steps"))
        ends = newest.join(count, "namespace", "left").select("namespace", F.col("n.revision").alias("revision"), F.col("n.snapshot_no").alias("snapshot_no"), (F.coalesce("steps", F.lit(0)) + 1).alias("step"))
        # Each snapshot that matters, with the step that looks at it; the step after the last one is
        # the look at the newest snapshot.
        looks = steps.select("namespace", "revision", "snapshot_no", "step", F.lit(False).alias("end")).unionByName(ends.withColumn("end", F.lit(True)))
        looks = cut(looks)

        held = chunk_states.select("namespace", "snapshot_no", "chunk_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), pack_hash(F.col("embedding_hash")).alias("hash"))
        held = held.join(broadcast_if_small(looks), ["namespace", "snapshot_no"])
        own, of = plans.select(*key, "embed_ids").alias("p"), broadcast_if_small(steps.select(*key, "step")).alias("s")
        asked = own.join(of, reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]))
        asked = asked.select("p.namespace", "step", F.explode("embed_ids").alias("chunk_id")).where("chunk_id is not null")
        nothing = F.lit(None)
        parts = (
            held.select("namespace", "chunk_id", "step", F.struct("loaded_at", "hash").alias("row"), F.lit(False).alias("embeds"), "revision", "end")
            .unionByName(asked.select("namespace", "chunk_id", "step", nothing.cast("struct<loaded_at:timestamp_ntz,hash:binary>").alias("row"), F.lit(True).alias("embeds"), nothing.cast("string").alias("revision"), nothing.cast("boolean").alias("end")))
            .unionByName(state.select("namespace", "chunk_id", F.lit(0).alias("step"), F.struct(nothing.cast("timestamp_ntz").alias("loaded_at"), "hash").alias("row"), F.lit(True).alias("embeds"), nothing.cast("string").alias("revision"), F.lit(False).alias("end")))
        )
        # Newest row, presence and embedding in one aggregation, combined on the map side.
        seen = (
            parts.groupBy("namespace", "chunk_id", "step")
            .agg(F.max("row").alias("row"), F.max("embeds").alias("embeds"), F.max("revision").alias("revision"), F.max("end").alias("end"))
            .where("row is not null")
            .select("namespace", "chunk_id", "step", F.col("row.hash").alias("hash"), "embeds", "revision", "end")
        )
        # A gap in the steps means that the chunk was forgotten in between.
        w = W.partitionBy("namespace", "chunk_id").orderBy("step")
        seen = seen.withColumn("island", F.col("step") - F.row_number().over(w))
        island = W.partitionBy("namespace", "chunk_id", "island").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
        own = F.when(F.col("embeds"), F.struct("hash"))
        seen = seen.withColumns({"had": F.last(own, ignorenulls=True).over(island), "own": own})
        same = F.col("had").isNotNull() & F.col("had.hash").eqNullSafe(F.col("hash"))
        after = F.coalesce("own", "had")
        steps_of = broadcast_if_small(looks.where("end").select("namespace", (F.col("step") - 1).alias("last_step")))
        rows = seen.join(steps_of, "namespace")
        kinds = F.array_compact(
            F.array(
                F.when((F.col("step") > 0) & ~F.col("end") & F.col("embeds") & same, F.lit("repeated")),
                F.when(F.col("end") & ~same, F.lit("pending")),
                F.when((F.col("step") == F.col("last_step")) & after.isNotNull(), F.lit("state")),
            )
        )
        return rows.select("namespace", "revision", "chunk_id", after["hash"].alias("hash"), F.explode(kinds).alias("kind"))

    def _rows(self, live: dict[str, str], kind: str) -> DataFrame:
        paths = [p for f in live.values() if self.store.exists(p := f"{f}/rows/kind={kind}")]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def _valid(self, live: dict[str, str], kind: str, marks: DataFrame) -> DataFrame:
        """The rows of a kind that count under these marks; without their generation."""
        counts = F.col("generation") >= F.col("since") if kind == "repeated" else F.col("generation") == F.col("home")
        return self._rows(live, kind).join(broadcast_if_small(marks.select("namespace", "since", "home")), "namespace").where(counts).select("namespace", "revision", "chunk_id", "hash")

    def work(self) -> DataFrame:
        """(namespace, revision, chunk_id, work_kind) over all committed runs; needs one at least."""
        done = self.store.last()
        if done is None:
            raise ValueError("no run was committed yet")
        marks = self.spark.read.schema(MARKS).parquet(f"{done[1]['folder']}/marks")
        both = [self._valid(done[1]["live"], k, marks).select("namespace", "revision", "chunk_id", F.lit(k).alias("work_kind")) for k in ("pending", "repeated")]
        return both[0].unionByName(both[1]).distinct()
