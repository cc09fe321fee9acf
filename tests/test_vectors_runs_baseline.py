from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import baseline, cost, reconcile, runs, vectors
from plumbline.operators.chunks import ChunkPolicy, audit_chunks
from plumbline.operators.reports import by_document, examples, render, review_summary, verdict
from plumbline.sources.records import embeddings_from_records

E = "embedding_index bigint, chunk_id string, vector array<double>"


def audit(spark, ids, rows_, **kw):
    e = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows_)], E)
    f = vectors.audit_embeddings(spark.createDataFrame([(i,) for i in ids], "chunk_id string"), e, kw.pop("dimensions", 2), **kw)
    return Counter(r.code for r in f.collect())


def test_ids(spark):
    assert audit(spark, "ab", [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("c", [1.0, 1.0])]) == {"duplicate_embedding": 1, "unexpected_embedding": 1, "missing_embedding": 1}


def test_negative_zero_is_zero(spark):
    assert audit(spark, "ab", [("a", [1.0, -0.0]), ("b", [1.0, 0.0])]) == {"duplicate_vector": 1}


def test_norms_warn(spark):
    assert audit(spark, "ab", [("a", [1.0, 0.0]), ("b", [1.0, 0.0])], norm_range=(2, 3)) == {"embedding_norm_outlier": 2, "duplicate_vector": 1}


def test_values(spark):
    nan, inf = float("nan"), float("inf")
    got = audit(spark, "abcdef", [("a", [0.0, 0.0]), ("b", [1.0]), ("c", [nan, 1.0]), ("d", [inf, 1.0]), ("e", None), ("f", [None, 1.0])])
    assert got == {"zero_embedding": 1, "embedding_dimensions": 1, "nonfinite_embedding": 3, "invalid_vector": 1}
    assert audit(spark, "", []) == {}


def test_norm_does_not_overflow(spark):
    df = spark.createDataFrame([([3e200, 4e200],), ([0.0],), ([],), ([3e-200, 4e-200],)], "v array<double>")
    assert [r[0] for r in df.select(V.norm(df.v)).collect()] == pytest.approx([5e200, 0, 0, 5e-200])


def test_provenance(spark, rows):
    t = spark.createDataFrame([("a", "d", "k", "h")], "chunk_id string, document_id string, chunk_key string, text_hash string")
    e = spark.createDataFrame([(0, "a", "m", "p", "x"), (1, "b", "m", "p", "h")], "embedding_index bigint, chunk_id string, embedding_model string, pipeline_id string, input_hash string")
    got = rows(vectors.audit_provenance(t, e, "m", None or "q"), "chunk_index", "message")
    assert [m.split()[0] for _, m in got] == ["input_hash", "pipeline_id"]


def test_nearest_in_blocks(spark, rows, monkeypatch):
    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)] + [(90, None), (91, [1.0])], "id bigint, vector array<double>")
    q = spark.createDataFrame([(i, [i + 0.5, 0.0]) for i in range(5)], "query_id bigint, vector array<double>")
    want = sorted([(i, j, 0.25, p) for i in range(5) for p, j in ((1, i), (2, i + 1))], key=repr)
    cols = ("query_id", "id", "distance", "place")
    assert rows(vectors.nearest(q, base, 2), *cols) == want
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert rows(vectors.nearest(q, base, 2), *cols) == want


def test_payload_verification(spark, rows):
    s = "chunk_id string, text string, metadata map<string,string>, vector array<double>"
    a = spark.createDataFrame([("same", "t", {"a": "1", "b": "2"}, [1.0]), ("gone", "t", {}, [1.0]), ("all", "t", {"a": "1"}, [1.0])], s)
    b = spark.createDataFrame([("same", "t", {"b": "2", "a": "1"}, [1.00001]), ("new", "t", {}, [1.0]), ("all", "u", {"a": "2"}, [1.1])], s)
    assert rows(vectors.payload_mismatches(a, b)) == [("all", "metadata_mismatch"), ("all", "text_mismatch"), ("all", "vector_mismatch"), ("gone", "missing_record"), ("new", "orphan_id")]


def test_reconcile(spark):
    side = lambda *x: spark.createDataFrame([tuple(i) for i in x], "namespace string, id string")
    said = spark.createDataFrame([("n", True), ("m", True), ("o", None), ("none", False)], "namespace string, inventory_complete boolean")
    e = side("na", "na", "nb", "nc", "ma", "oa", "xx")
    o = side("nb", "nd", "nd", "nd", ("n", None), "ma", "oa")
    got = {r.namespace: r for r in reconcile.reconcile(e, o, said, max_examples=1).collect()}
    names = ("expected_count", "observed_count", "missing_count", "orphan_count", "duplicate_expected_count", "duplicate_observed_count")
    assert [got["n"][k] for k in names] == [3, 2, 2, 1, 1, 2]
    assert (got["n"].missing_ids, got["n"].orphan_ids, got["n"].passed) == (["a"], ["d"], False)
    assert got["m"].passed and not got["o"].passed and set(got) == {"n", "m", "o", "none"}
    assert [got["none"][k] for k in names] == [0] * 6 and got["none"].missing_ids == []
    assert reconcile.reconcile(e.limit(0), o.limit(0), said.limit(0)).count() == 0
    with pytest.raises(ValueError):
        reconcile.reconcile(e, o, said, max_examples=-1)


def test_runs(spark):
    def streams(**runs_):
        return spark.createDataFrame([(r, n, i) for r, three in runs_.items() for n, ids in zip(runs.STREAMS, three) for i in ids], "run_id string, stream string, id string")

    about = "run_id string, enumeration_completed boolean, pagination_completed boolean, scope string, start_watermark string, end_watermark string, consistent_snapshot boolean"
    table = spark.createDataFrame(
        [("bad", True, False, "complete", "1", "2", True), ("good", True, True, "complete", None, None, True), ("short", True, True, "complete", "1", "1", True), ("part", True, True, "incremental", None, "2", True), ("vague", None, None, None, None, None, None)], about
    )
    s = streams(bad=("aabc", "bxb", "bc"), good=("ab", "ab", ""), short=("ab", "a", ""), part=("a", "a", ""), other=("zz", "", "z"))
    codes = Counter((r.run_id, r.code) for r in runs.audit_runs(table, s).collect())
    assert codes == {
        ("bad", "duplicate_run_id"): 2, ("bad", "unexpected_run_record"): 1, ("bad", "run_processing_failed"): 2, ("bad", "conflicting_run_outcome"): 1, ("bad", "run_processing_missing"): 1,
        ("bad", "run_enumeration_incomplete"): 1, ("bad", "source_changed_during_run"): 1, ("short", "run_processing_missing"): 1, ("vague", "run_enumeration_incomplete"): 1,
    }
    got = {r.run_id: (r.findings, r.unverified, r.deletion_eligible) for r in runs.run_verdicts(table, s).collect()}
    both = ["source_snapshot_consistency", "whole_corpus_completeness"]
    assert got == {"bad": (9, both[1:], False), "good": (0, [], True), "short": (1, [], False), "part": (0, both[1:], False), "vague": (1, both, False)}
    one = s.where("run_id = 'bad'").drop("run_id")
    assert runs.run_findings(one).count() == 7 and tuple(runs.run_measurements(one).first()) == (3, 2, 2, 1)


def test_baseline(spark):
    def batch(n):
        return spark.createDataFrame([(i, "tiny", {"source": "s"}) for i in range(n)], "chunk_index bigint, text string, metadata map<string,string>")

    policy = ChunkPolicy(min_chars=20)
    three, four = batch(3), batch(4)
    accepted = baseline.capture(audit_chunks(three, policy).findings, three, "corpus/1")
    c = baseline.compare(audit_chunks(four, policy).findings, four, accepted, "corpus/1")
    assert (c.accepted, c.new, c.resolved, c.passed) == (5, 2, 0, False)
    assert baseline.compare(audit_chunks(three, policy).findings, three, accepted, "corpus/1").passed
    with pytest.raises(ValueError):
        baseline.compare(audit_chunks(four, policy).findings, four, accepted, "corpus/2")
    with pytest.raises(ValueError):
        baseline.capture(audit_chunks(three, policy).findings, three, "corpus/1", "loose")


def test_cost(spark):
    ids = spark.createDataFrame([(f"c{i}",) for i in range(4)], "chunk_id string")
    n = ids.withColumn("tokens", F.lit(10))
    assert cost.estimate_cost(ids, n, 2, "USD").cost == Decimal("0.00008")
    c = cost.estimate_cost(ids.limit(1), n, "2", "USD", ids)
    assert (c.tokens, c.baseline_tokens, c.avoided) == (10, 40, Decimal("0.00006"))
    for bad in (dict(price_per_million=-1, currency="USD"), dict(price_per_million="nan", currency="USD"), dict(price_per_million=1, currency=" ")):
        with pytest.raises(ValueError):
            cost.estimate_cost(ids, n, **bad)
    with pytest.raises(ValueError):
        cost.estimate_cost(ids, n.limit(2), 1, "USD")
    with pytest.raises(ValueError):
        cost.estimate_cost(ids, n, 1, "USD", ids.limit(1))
    row = cost.priced(cost.token_sums(ids.limit(1), n, ids), "0.02").first()
    assert (row.cost, row.avoided) == (Decimal("0.0000002"), Decimal("0.0000006"))


def test_review_summary(spark, rows):
    claims = [("a", "reviewed"), ("a", "unreviewed"), ("b", "not_applicable"), ("c", "reviewed"), ("c", "not_applicable"), (None, "unreviewed"), ("d", "odd"), ("d", None)]
    got = rows(review_summary(spark.createDataFrame(claims, "scenario string, state string")))
    assert got == [("a", "partial", 1, 1, 0), ("b", "not_applicable", 0, 0, 1), ("c", "reviewed", 1, 0, 1), ("d", "unknown", 0, 0, 0), (None, "unknown", 2, 2, 2)]
    assert rows(review_summary(spark.createDataFrame([], "scenario string, state string"))) == [(None, "not_applicable", 0, 0, 0)]


def test_records_that_are_no_embeddings(spark, rows):
    e = embeddings_from_records(spark, [17, {"chunk_id": "a", "vector": [1, 2.0]}, {"chunk_id": 3, "vector": [1, True]}, {"chunk_id": "b", "vector": "x"}, {"chunk_id": "b", "vector": [[1]]}])
    found = rows(vectors.audit_embeddings(spark.createDataFrame([("a",), ("b",)], "chunk_id string"), e, 2), "chunk_index", "code")
    assert found == [(0, "invalid_embedding"), (2, "nonfinite_embedding"), (2, "unexpected_embedding"), (3, "invalid_vector"), (4, "duplicate_embedding"), (4, "invalid_vector")]


def test_reports(spark, rows):
    f = spark.createDataFrame([("a", "error", "d", 1, None, [], "m1"), ("a", "error", "d", None, None, None, "m2"), ("b", "warning", None, 2, None, [1], "m3")], "code string, severity string, document_id string, chunk_index bigint, chunk_key string, related array<bigint>, message string")
    assert rows(by_document(f)) == [("d", 2, 2, 0), (None, 1, 0, 1)]
    assert rows(examples(f, F.col("message"), F.col("message"), 1)) == [("a", "error", 2, ["m1"]), ("b", "warning", 1, ["m3"])]
    assert rows(examples(f, F.col("message"), F.col("message"), 0)) == [("a", "error", 2, []), ("b", "warning", 1, [])]
    assert verdict(f.where("code = 'b'"), 1).passed and not verdict(f.where("code = 'b'"), 0).passed
    assert render(f.groupBy("code", "severity").agg(F.count("*").alias("occurrences")), "t", False).splitlines()[0] == "FAIL: t"
