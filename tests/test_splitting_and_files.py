import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.splitting import split_tokens, token_runs
from plumbline.operators import baseline
from plumbline.operators.chunks import ChunkPolicy, audit_chunks
from plumbline.plans.index_store import PayloadStore, project_metadata
from plumbline.sources.records import append_events, read_export, write_export


def count(t):
    return (len(t) + 3) // 4


def test_runs_cover_the_text_within_the_limit(spark):
    r = random.Random(0)
    for n in (0, 1, 7, 300):
        words = ["w" * r.randrange(1, 12) + str(i) for i in range(n)]
        runs = token_runs(" \n".join(words), count, 30, 3, 5)
        assert all(count(x) <= 30 for x in runs)
        at = 0
        for x in runs:
            part = x.split()
            s = words.index(part[0])
            assert s <= at and words[s : s + len(part)] == part
            at = s + len(part)
        assert at == n
    assert token_runs("short " + "x" * 500, count, 30, 3, 5)[-1] == "x" * 500
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert [x[0] for x in df.select(split_tokens(df.t, lambda: count)).collect()] == [["a b c"], [], []]
    with pytest.raises(ValueError):
        split_tokens(df.t, lambda: count, 0)


def test_baseline_file(spark, tmp_path):
    df = spark.createDataFrame([(i, "tiny") for i in range(3)], "chunk_index bigint, text string")
    b = baseline.capture(audit_chunks(df, ChunkPolicy(required_metadata=(), min_chars=9)).findings, df, "s")
    baseline.save(b, f"{tmp_path}/b")
    assert baseline.load(spark, f"{tmp_path}/b").count() == b.count()
    baseline.save(b.withColumn("fingerprint", F.lit("x")), f"{tmp_path}/c")
    with pytest.raises(ValueError):
        baseline.load(spark, f"{tmp_path}/c")
    b.drop("mode").write.parquet(f"{tmp_path}/first-format")
    assert baseline.load(spark, f"{tmp_path}/first-format").select("mode").distinct().collect() == [("strict",)]


def test_store_contract(spark, rows, tmp_path):
    store = PayloadStore(spark, f"file://{tmp_path}/p")
    schema = "chunk_id string, text string, metadata map<string,string>, vector array<double>"
    new = lambda *x: spark.createDataFrame([(i, t, {"source_id": f"{i}.txt"}, [float(n), 0.0]) for n, (i, t) in enumerate(x)], schema)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    assert rows(store.ids()) == []
    store.upsert(new(("a", "1"), ("b", "2")))
    store.upsert(new(("b", "3"), ("c", "4")))
    assert rows(store.rows(), "chunk_id", "text") == [("a", "1"), ("b", "3"), ("c", "4")]
    store.delete(ids("a", "zz"))
    assert rows(store.get(ids("a", "b", "b")), "chunk_id") == [("b",)]
    q = spark.createDataFrame([(1, [0.9, 0.0])], "query_id int, vector array<double>")
    assert rows(store.query(q, 5), "id", "place") == [("b", 2), ("c", 1)]
    write_export(store.rows(), f"{tmp_path}/export")
    assert rows(read_export(spark, f"{tmp_path}/export"), "id", "source", "text", "error") == [("b", "b.txt", "3", None), ("c", "c.txt", "4", None)]


def test_projection_and_events(spark, tmp_path):
    df = spark.createDataFrame([("n", "d", None, ["page:2"], "k")], "namespace string, document_id string, source_version string, units array<string>, chunk_key string")
    assert project_metadata(df, "m", "p", {"review_tag": "x"}).first().metadata == {
        "namespace": "n", "source_id": "d", "units_json": '["page:2"]', "chunk_key": "k", "embedding_model": "m", "pipeline_id": "p", "review_tag": "x",
    }
    append_events(spark, f"{tmp_path}/e", [{"a": 1}])
    append_events(spark, f"{tmp_path}/e", [{"b": 2}])
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/e").collect()) == ['{"a": 1}', '{"b": 2}']
