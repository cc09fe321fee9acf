import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.incremental import GenerationStore
from plumbline.operators.numbering import number_rows
from plumbline.plans.ledger import Ledger, deletion_summaries
from plumbline.plans.planning import Guards, plan_update
from plumbline.plans.snapshot import InvalidBatchError, Snapshot, UnsafePlanError, build_snapshot, chunk_states, load_snapshot, save_snapshot, verify_snapshot

CHUNK = "document_id string, chunk_key string, text string, source_version string, metadata map<string,string>"


def snapshot(spark, docs, model="m", pipe="p", ns="n", tag=""):
    """docs: id -> list of texts, or dict of key -> text."""
    rows = []
    for d, texts in docs.items():
        items = texts.items() if isinstance(texts, dict) else ((str(i), t) for i, t in enumerate(texts))
        rows += [(d, k, t, "v", {"tag": tag}) for k, t in items]
    c = chunk_states(spark.createDataFrame(rows, CHUNK), ns, model, pipe)
    return Snapshot(ns, pipe, model, spark.createDataFrame([(d, "v") for d in docs], "document_id string, source_version string"), c)


def many(n, k):
    return {f"d{i:03d}": [f"text {i} {j}" for j in range(k)] for i in range(n)}


def counts(plan):
    got = {r.action: r["count"] for r in plan.actions.groupBy("action").count().collect()}
    return got.get("added", 0), got.get("changed", 0), got.get("unchanged", 0), got.get("removed", 0), plan.embed_ids().count()


def test_differences(spark):
    a = {"d": ["one", "two", "three", "four", "five"]}
    old = snapshot(spark, a)
    assert counts(plan_update(None, old)) == (5, 0, 0, 0, 5)
    assert counts(plan_update(old, snapshot(spark, {"d": ["one", "TWO", "three", "four", "five"]}))) == (0, 1, 4, 0, 1)
    assert counts(plan_update(old, snapshot(spark, {"d": ["one", "two ", "three", "four", "five"]}))) == (0, 1, 4, 0, 1)
    assert counts(plan_update(old, snapshot(spark, a, tag="new"))) == (0, 5, 0, 0, 0)
    assert counts(plan_update(old, snapshot(spark, {"e": ["x"]}))) == (1, 0, 5, 0, 1)
    assert counts(plan_update(old, snapshot(spark, a, model="m2"))) == (0, 5, 0, 0, 5)
    with pytest.raises(UnsafePlanError, match="pipeline or model"):
        plan_update(old, snapshot(spark, {"e": ["x"]}, model="m2"))
    with pytest.raises(UnsafePlanError, match="namespaces"):
        plan_update(old, snapshot(spark, a, ns="other"))


def test_guards(spark):
    old = snapshot(spark, many(20, 4))
    cut = {"d000": ["text 0 0", "text 0 1", "text 0 2"]}
    assert counts(plan_update(old, snapshot(spark, cut), Guards(max_corpus_delete_fraction=1 / 80)))[3] == 1  # limits are inclusive
    with pytest.raises(UnsafePlanError, match="for d000"):
        plan_update(old, snapshot(spark, {"d001": ["a"], "d000": ["a", "b"]}), Guards(max_delete_fraction=0.25))
    with pytest.raises(UnsafePlanError, match="1/80"):
        plan_update(old, snapshot(spark, cut), Guards(max_corpus_delete_fraction=0.01))
    with pytest.raises(UnsafePlanError, match="removed chunks: 1"):
        plan_update(old, snapshot(spark, cut), Guards(max_removed_chunks=0))
    with pytest.raises(UnsafePlanError, match="shrinking documents: 1"):
        plan_update(old, snapshot(spark, cut), Guards(max_shrinking_documents=0))
    p = plan_update(old, snapshot(spark, {"d000": ["text 0 0"]}), Guards(retire_documents=("d001",), allow_shrink={"d000": 0.75}, max_corpus_delete_fraction=0))
    assert {k: p.policy[k] for k in ("ordinary_removed_chunks", "allowance_removed_chunks", "retirement_removed_chunks", "exempt_chunks", "ordinary_committed_chunks")} == {
        "ordinary_removed_chunks": 0, "allowance_removed_chunks": 3, "retirement_removed_chunks": 4, "exempt_chunks": 8, "ordinary_committed_chunks": 72,
    }
    assert p.target.documents.count() == 19
    for bad in (Guards(retire_documents=("zz",)), Guards(retire_documents=("d000",)), Guards(allow_shrink={"d005": 0.5})):
        with pytest.raises(UnsafePlanError):
            plan_update(old, snapshot(spark, cut), bad)
    for kw in ({"max_delete_fraction": 2}, {"max_removed_chunks": -1}, {"retire_documents": "d"}, {"retire_documents": ("a", "a")}, {"max_corpus_delete_fraction": True}):
        with pytest.raises(ValueError):
            Guards(**kw)


def test_revision_ignores_order(spark):
    s = snapshot(spark, many(5, 3))
    t = Snapshot("n", "p", "m", s.documents.repartition(5), s.chunks.orderBy(F.desc("chunk_id")))
    assert s.revision() == t.revision() != snapshot(spark, many(5, 3), tag="x").revision()


def test_verify_and_save(spark, rows, tmp_path):
    s = snapshot(spark, many(3, 2))
    assert rows(verify_snapshot(s)) == []
    bad = Snapshot("n", "p", "m", s.documents.where("document_id <> 'd000'"), s.chunks.unionByName(s.chunks.limit(1)).withColumn("text_hash", F.lit("x")))
    assert {r.problem for r in verify_snapshot(bad).collect()} == {"unknown_document", "duplicate_chunk", "invalid_hash", "wrong_embedding_hash"}
    save_snapshot(s, f"file://{tmp_path}/s")
    assert load_snapshot(spark, f"file://{tmp_path}/s").revision() == s.revision()
    with pytest.raises(ValueError):
        save_snapshot(s, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        load_snapshot(spark, f"file://{tmp_path}/none")
    GenerationStore(spark, f"file://{tmp_path}/t").publish(1, {"schema_version": 2})
    with pytest.raises(ValueError):
        load_snapshot(spark, f"file://{tmp_path}/t")


def test_build_refuses_bad_batches(spark):
    docs = spark.createDataFrame([("d", "v", ["u"])], "document_id string, source_version string, expected_units array<string>")
    receipts = spark.createDataFrame([("d", "v", ["u"], [], [], True)], "document_id string, source_version string, processed_units array<string>, empty_units array<string>, failed_units array<string>, completed boolean")
    chunks = spark.createDataFrame([(0, "t", "k", "d", "v", ["u"], {"source": "s"})], "chunk_index bigint, text string, chunk_key string, document_id string, source_version string, units array<string>, metadata map<string,string>")
    s = build_snapshot(docs, receipts, chunks, "n", "p", "m")
    assert verify_snapshot(s).isEmpty() and s.chunks.count() == 1
    with pytest.raises(InvalidBatchError):
        build_snapshot(docs, receipts, chunks.limit(0), "n", "p", "m")
    with pytest.raises(InvalidBatchError):
        build_snapshot(docs.withColumn("expected_units", F.lit(None).cast("array<string>")), receipts, chunks, "n", "p", "m")


def test_ledger(spark, rows, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.revision() is None and ledger.verify().isEmpty() and ledger.counts() == {"documents": 0, "chunks": 0}
    assert ledger.deletion_summary().first().baseline_basis == "current_inventory_no_commits"
    first = ledger.plan(snapshot(spark, many(20, 20)))
    r1 = ledger.commit(first)
    with pytest.raises(UnsafePlanError):
        ledger.commit(first)
    assert ledger.commit(ledger.plan(snapshot(spark, {"d003": [f"text 3 {j}" for j in range(20)]}))) == r1  # nothing new, nothing written
    for k in (18, 16):
        ledger.commit(ledger.plan(snapshot(spark, many(20, k))))
    assert ledger.counts() == {"documents": 20, "chunks": 320}
    s = ledger.deletion_summary().first()
    assert (s.start_chunks, s.end_chunks, s.chunks_removed, s.window_adjusted, s.initial_commits_excluded) == (400, 320, 80, True, 1)
    assert s.net_shrink_fraction == pytest.approx(0.2) and s.history_complete
    assert [r.sequence for r in ledger.history(2).collect()] == [3, 2]
    ledger.commit(ledger.plan(snapshot(spark, {"new": ["x"]}), Guards(retire_documents=("d001",))))
    assert rows(ledger.document_ids().where("document_id in ('new', 'd001')")) == [("new",)]
    assert ledger.verify().isEmpty()
    folder = ledger.store.commits()[-1][1]["folder"]
    bad = spark.read.parquet(f"{folder}/documents").withColumn("chunk_count", F.when(F.col("document_id") == "d002", 3).otherwise(F.col("chunk_count"))).collect()
    spark.createDataFrame(bad).write.mode("overwrite").parquet(f"{folder}/documents")
    assert rows(ledger.verify(), "code", "document_id") == [("ledger_document_corrupt", "d002")]


def test_summaries(spark):
    schema = "namespace string, sequence int, before_chunks bigint, after_chunks bigint, added_chunks bigint, removed_chunks bigint, ordinary_removed_chunks bigint, allowance_removed_chunks bigint, retirement_removed_chunks bigint"
    data = [("a", 1, 0, 400, 400, 0, 0, 0, 0), ("a", 2, 400, 360, 0, 40, 40, 0, 0), ("a", 3, 360, 320, 0, 40, None, 0, 0)]
    data += [("b", 1, 0, 0, 0, 0, 0, 0, 0), ("c", 5, 20, 20, 2, 2, 2, 0, 0)]
    got = {r.namespace: r for r in deletion_summaries(spark.createDataFrame(data + data, schema)).collect()}
    assert (got["a"].start_chunks, got["a"].end_chunks, got["a"].ordinary_removed_chunks, got["a"].removal_unclassified) == (400, 320, None, True)
    assert got["b"].net_shrink_fraction is None and got["b"].window_adjusted is False
    assert (got["c"].gross_removed_fraction, got["c"].net_shrink_fraction) == (0.1, 0.0)
    two = {r.namespace: r for r in deletion_summaries(spark.createDataFrame(data, schema), 1).collect()}
    assert (two["a"].start_chunks, two["a"].window_adjusted) == (360, False)
    with pytest.raises(ValueError):
        deletion_summaries(spark.createDataFrame(data, schema), 0)


def test_order_of_rows_changes_nothing(spark, rows):
    docs = {k: v for k, v in many(6, 5).items()}
    old, items = snapshot(spark, docs), list(docs.items())
    random.Random(2).shuffle(items)
    plan = plan_update(old, snapshot(spark, dict(items[:4])))
    assert counts(plan) == (0, 0, 30, 0, 0)


def test_ledger_of_the_format_before(spark, rows, tmp_path):
    path = f"file://{tmp_path}/l"
    ledger = Ledger(spark, path)
    ledger.commit(ledger.plan(snapshot(spark, many(3, 4))))
    number, state = ledger.store.last()
    old = {k: state[k] for k in ("namespace", "pipeline_id", "embedding_model", "revision", "folder")}
    ledger.store.publish(number + 1, {**old, "format_version": 1})
    with pytest.raises(ValueError, match="upgraded"):
        Ledger(spark, path, read_only=True).revision()
    ledger = Ledger(spark, path)
    assert ledger.revision() == state["revision"] and ledger.counts() == {"documents": 3, "chunks": 12}
    s = ledger.deletion_summary().first()
    assert (s.history_complete, s.baseline_chunks_at_history_start) == (False, 12)
    ledger.commit(ledger.plan(snapshot(spark, many(3, 3)), Guards(1.0, 1.0)))
    assert [r.removed_chunks for r in ledger.history(1).collect()] == [3]
    with pytest.raises(UnsafePlanError):
        Ledger(spark, path, read_only=True).commit(ledger.plan(snapshot(spark, many(3, 2)), Guards(1.0, 1.0)))
    ledger.store.publish(9, {"format_version": 7})
    with pytest.raises(ValueError, match="unsupported"):
        ledger.revision()


def test_broken_ledger_tables_are_a_finding(spark, rows, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    ledger.commit(ledger.plan(snapshot(spark, many(2, 2))))
    folder = ledger.store.last()[1]["folder"].removeprefix("file:")
    for f in glob.glob(f"{folder}/chunks/*.parquet"):
        with open(f, "r+b") as file:
            file.write(b"broken" * 20)
    for f in glob.glob(f"{folder}/chunks/.*.crc"):
        os.remove(f)
    assert rows(ledger.verify(), "code") == [("ledger_integrity",)]


def test_numbers_follow_the_order_in_any_partitioning(spark):
    r = random.Random(3)
    data = [(r.choice(("hot", "hot", "hot", "cold", None)), i) for i in range(500)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "k string, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many partitions as asked for
    try:
        got = number_rows(df, ["k"], ["n"], "at").collect()
        one = number_rows(df, [], ["n"], "at").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for k in ("hot", "cold", None):
        want |= {(k, n): at for at, n in enumerate(sorted(n for x, n in data if x == k))}
    assert {(x.k, x.n): x["at"] for x in got} == want and len(got) == 500
    assert all(x["at"] == x.n for x in one)
    assert number_rows(df.limit(0), ["k"], ["n"], "at").count() == 0
