import pytest
from pyspark.sql import functions as F

from plumbline.plans.apply import Budget, Embedder, GuardedIndex, compare_omission, embed_inputs, fake_embedder
from plumbline.plans.planning import Guards
from plumbline.plans.index_store import PayloadStore
from plumbline.plans.planning import audit_plan_embeddings, plan_update
from plumbline.plans.snapshot import UnsafePlanError, build_snapshot
from tests.test_plans import many, snapshot


def maker(model="m", pipeline="p", **kw):
    return fake_embedder(model=model, pipeline=pipeline, **kw)


def payloads(spark, s, docs):
    texts = spark.createDataFrame([(d, str(j), t) for d, ts in docs.items() for j, t in enumerate(ts)], "document_id string, chunk_key string, text string")
    return s.chunks.join(texts, ["document_id", "chunk_key"]).select("chunk_id", "text", F.create_map(F.lit("d"), "document_id").alias("metadata"))


def test_apply_update_and_recover(spark, tmp_path):
    index = GuardedIndex(spark, f"file://{tmp_path}/i", 8)
    docs = many(4, 5)
    s = snapshot(spark, docs)
    index.apply(s, payloads(spark, s, docs), maker())
    assert index.payloads.ids().count() == 20 and index.check().isEmpty() and index.pending() is None

    docs["d000"][1] = "another text"
    s = snapshot(spark, docs)
    n = s.chunks.select("chunk_id").withColumn("tokens", F.lit(1_000_000))
    with pytest.raises(UnsafePlanError, match="budget"):
        index.apply(s, payloads(spark, s, docs), maker(), budget=Budget(2, "USD", 1), token_counts=n)

    def broken(texts):
        raise OSError("no provider")

    with pytest.raises(Exception, match="no provider"):
        index.apply(s, payloads(spark, s, docs), Embedder(broken, "m", "p"))
    assert index.pending() is not None and index.ledger.counts()["chunks"] == 20
    with pytest.raises(UnsafePlanError, match="pending"):
        index.plan(s)
    with pytest.raises(UnsafePlanError):
        index.recover(snapshot(spark, many(4, 5), tag="other"), maker())
    index.recover(s, maker())
    assert index.pending() is None
    vector = maker().embed(["another text"])[0]
    assert index.payloads.rows().where("text = 'another text'").first().vector == vector
    q = spark.createDataFrame([(1, vector)], "query_id int, vector array<double>")
    assert index.payloads.query(q, 1).first().distance == 0

    naive = {k: v[:4] if k == "d000" else v for k, v in docs.items()}
    t = snapshot(spark, naive)
    with pytest.raises(UnsafePlanError, match="deletion fraction"):
        index.apply(t, payloads(spark, t, naive), maker(), Guards(max_delete_fraction=0.1))
    index.apply(t, payloads(spark, t, naive), maker())
    assert index.payloads.ids().count() == 19 and index.ledger.verify().isEmpty()


def test_requests_are_bounded(spark, tmp_path):
    seen = tmp_path / "sizes"
    seen.write_text("")

    def embedder(texts):
        with seen.open("a") as f:
            f.write(f"{len(texts)}\n")
        return [[1.0]] * len(texts)

    df = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text")).coalesce(1)
    assert embed_inputs(df, Embedder(embedder, "m", "p")).count() == 50
    assert max(map(int, seen.read_text().split())) <= 16


def test_other_texts_and_other_models_are_refused(spark, tmp_path):
    docs = many(2, 3)
    s = snapshot(spark, docs)
    texts = payloads(spark, s, docs)
    for wrong, embedder in ((texts.withColumn("text", F.lit("other")), maker()), (texts, maker(model="another")), (texts, maker(pipeline="another"))):
        index = GuardedIndex(spark, f"file://{tmp_path}/{embedder.model}-{embedder.pipeline}", 8)
        with pytest.raises(UnsafePlanError, match="embedding_provenance_mismatch"):
            index.apply(s, wrong, embedder)
        assert index.ledger.revision() is None and index.payloads.ids().isEmpty() and index.pending() is not None


def test_plan_embeddings_in_both_modes(spark, rows):
    old = snapshot(spark, {"d": ["one", "two"]})
    new = snapshot(spark, {"d": ["one", "TWO", "three"]}, tag="new")  # one changes its metadata only
    plan = plan_update(old, new)
    made = new.chunks.select(F.xxhash64("chunk_id").alias("embedding_index"), "chunk_id", F.array(F.lit(1.0), F.hash("chunk_id").cast("double")).alias("vector"), F.lit("m").alias("embedding_model"), F.lit("p").alias("pipeline_id"), F.col("text_hash").alias("input_hash"))
    todo = made.join(plan.embed_ids(), "chunk_id", "left_semi")
    assert rows(audit_plan_embeddings(plan, todo, 2)) == [] == rows(audit_plan_embeddings(plan, made, 2, "upsert"))
    assert rows(audit_plan_embeddings(plan, todo, 2, "upsert"), "code") == [("missing_embedding",)]
    assert rows(audit_plan_embeddings(plan, made, 2), "code") == [("unexpected_embedding",)]
    wrong = todo.withColumns({"pipeline_id": F.lit(None).cast("string"), "input_hash": F.lit("x")})
    assert rows(audit_plan_embeddings(plan, wrong, 2), "code") == [("embedding_provenance_mismatch",)] * 4
    with pytest.raises(ValueError):
        audit_plan_embeddings(plan, made, 2, "all")


def test_a_lost_unit_is_deleted_naively_and_refused_with_guards(spark, tmp_path):
    docs = spark.createDataFrame([("d", "v", ["page:1", "page:2"]), ("e", "v", ["file"])], "document_id string, source_version string, expected_units array<string>")
    receipts = docs.select("document_id", "source_version", F.col("expected_units").alias("processed_units"), F.array().cast("array<string>").alias("empty_units"), F.array().cast("array<string>").alias("failed_units"), F.lit(True).alias("completed"))
    chunks = spark.createDataFrame(
        [(i, f"text {i}", f"k{i}", d, "v", [u], {"source": d}) for i, (d, u) in enumerate([("d", "page:1"), ("d", "page:2"), ("d", "page:2"), ("e", "file")])],
        "chunk_index bigint, text string, chunk_key string, document_id string, source_version string, units array<string>, metadata map<string,string>",
    )
    index = GuardedIndex(spark, f"file://{tmp_path}/i", 8)
    s = build_snapshot(docs, receipts, chunks, "n", "p", "m")
    index.apply(s, s.chunks.join(chunks, ["document_id", "chunk_key"]).select("chunk_id", "text", "metadata"), maker())
    got = compare_omission(index, docs, receipts, chunks, "d", "page:2", f"file://{tmp_path}/clone")
    assert got == {
        "naive_candidate_ids": 1, "naive_removed_ids": 2, "naive_remaining_ids": 2, "guarded_index_preserved": True,
        "guarded_codes": ("failed_units", "missing_chunk_units", "processed_units_mismatch"),
    }
    assert index.payloads.ids().count() == 4 and PayloadStore(spark, f"file://{tmp_path}/clone").ids().count() == 2
    with pytest.raises(ValueError):
        compare_omission(index, docs, receipts, chunks, "d", "page:9", f"file://{tmp_path}/other")
