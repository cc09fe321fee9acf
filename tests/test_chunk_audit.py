from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunks as K
from plumbline.operators.reports import by_code, verdict
from plumbline.sources.records import chunks_from_records


def found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_index bigint, text string")
    return K.audit_chunks(df, K.ChunkPolicy(required_metadata=(), **kw)).findings


def codes(df):
    return Counter(r.code for r in df.collect())


def test_duplicates_ignore_white_space_not_case(spark, rows):
    f = found(spark, ["A B", " A\n B ", "a b"])
    assert [(r.chunk_index, r.related) for r in f.where("code = 'duplicate_text'").collect()] == [(1, [0])]


def test_required_metadata(spark, rows):
    md = [{"page": 0}, {"page": False}, {"page": " "}, {"page": []}, {}]
    df = chunks_from_records(spark, [{"text": f"t{i}", "metadata": m} for i, m in enumerate(md)])
    f = K.audit_chunks(df, K.ChunkPolicy(required_metadata=("page", "page"))).findings
    assert rows(f.where("code = 'missing_metadata'"), "chunk_index") == [(2,), (3,), (4,)]


def test_broken_records(spark):
    df = chunks_from_records(spark, [None, {"text": 42, "metadata": {"source": "s"}}, {"text": " ", "metadata": {"source": "s"}}, {"text": "x", "metadata": []}, {"text": "y"}])
    f = K.audit_chunks(df).findings
    assert codes(f) == {"invalid_record": 1, "invalid_text": 1, "empty_text": 1, "invalid_metadata": 1, "missing_metadata": 1}
    assert not verdict(f).passed


def test_token_limit(spark, rows):
    f = found(spark, ["two words", "three short words"], max_tokens=2, token_counter=lambda c: F.size(T.words(c)))
    assert rows(f, "code", "chunk_index") == [("token_limit", 1)]


def test_boilerplate(spark):
    texts = [f"Common header line\nbody {i}\nCommon footer line" for i in range(3)]
    assert codes(found(spark, texts)) == {"repeated_boilerplate": 6}
    assert codes(found(spark, ["Common header line\nCommon header line\nbody of a text"])) == {}
    assert codes(found(spark, ["Only one long line"] * 3)) == {"duplicate_text": 2}


def test_many_short_copies(spark):
    f = found(spark, ["tiny"] * 10_000, min_chars=20)
    got = {r.code: r for r in by_code(f, 3).collect()}
    assert (got["short_chunk"].occurrences, got["duplicate_text"].occurrences, got["duplicate_text"].affected_chunks) == (10_000, 9_999, 10_000)
    assert got["duplicate_text"].chunk_indices == [0, 1, 2]


def test_low_distinctiveness(spark, rows):
    texts = ["alpha beta gamma", "gamma beta alpha!", "alpha beta gamma delta", "alpha beta gamma", "alpha beta"]
    f = found(spark, texts, distinctive_term_fraction=0.8)
    assert rows(f.where("code = 'low_distinctiveness'"), "chunk_index") == [(0,), (1,), (3,)]
    assert "low_distinctiveness" not in codes(found(spark, texts[:4], distinctive_term_fraction=0.5))


def test_lengths(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(range(1, 41))] + [(90, " "), (91, None)], "chunk_index bigint, text string")
    assert tuple(K.audit_chunks(df).lengths.first()) == (40, 1, 20.5, 38, 40)
    assert tuple(K.audit_chunks(df.limit(0)).lengths.first()) == (0, 0, 0.0, 0, 0)


def test_repartition_changes_nothing(spark, rows):
    texts = ["a b c d header line\nx\ny footer line"] * 3 + ["b", None, " ", "unique"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_index bigint, text string")
    want = rows(K.audit_chunks(df).findings, "code", "chunk_index", "related", "message")
    assert all(rows(K.audit_chunks(df.repartition(n)).findings, "code", "chunk_index", "related", "message") == want for n in (1, 7))
    assert rows(K.audit_chunks(df.limit(0)).findings) == []


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(0, "a", 1, "q", "z"), (1, "a", 1, "q", "z")], "chunk_index bigint, text string, first int, d string, line string")
    assert codes(K.audit_chunks(df, K.ChunkPolicy(required_metadata=())).findings) == {"duplicate_text": 1}


@pytest.mark.parametrize(
    "kw",
    [
        {"max_tokens": 1}, {"min_chars": 0}, {"boilerplate_ratio": 0}, {"boilerplate_min_chunks": 1}, {"required_metadata": "source"}, {"required_metadata": (" ",)},
        {"distinctive_term_fraction": 2}, {"lexical_min_chunks": True}, {"max_tokens": 0, "token_counter": F.length},
    ],
)
def test_configuration(kw):
    with pytest.raises((ValueError, TypeError)):
        K.ChunkPolicy(**kw)


def test_keys(spark, rows):
    df = spark.createDataFrame([(0, "d", ["b", "a"]), (1, "d", ["a", "b"]), (2, "d", ["page:1"]), (3, "d", ["page:1"]), (4, "d", []), (5, None, ["x"])], "chunk_index bigint, document_id string, units array<string>")
    got = rows(K.assign_chunk_keys(df), "chunk_index", "chunk_key")
    assert got == [(0, '["d",["a","b"],0]'), (1, '["d",["a","b"],1]'), (2, '["d","page:1",0]'), (3, '["d","page:1",1]'), (4, None), (5, None)]
    with pytest.raises(ValueError):
        K.assign_chunk_keys(df.withColumn("chunk_key", F.lit("k")))


def test_text_functions(spark):
    white = ["\u0085", " ", "\u001c", " ", "　", " ", "\t"]
    df = spark.createDataFrame([(w + "a" + w + w + "b" + w,) for w in white], "t string")
    assert {tuple(r) for r in df.select(T.normalized(df.t), T.stripped_length(df.t) - F.length(F.regexp_replace(df.t, "[ab]", "")) / 2).collect()} == {("a b", 2.0)} or all(
        r[0] == "a b" for r in df.select(T.normalized(df.t)).collect()
    )
    one = spark.createDataFrame([("x\r\ny\x0bz\x85w v",)], "t string")
    assert one.select(T.text_lines(one.t)).first()[0] == list("xyzwv")
    words = spark.createDataFrame([(" ".join(str(i) for i in range(n)), n) for n in (0, 1, 400, 401, 760, 761, 1000)], "t string, n int")
    for r in words.select("n", T.split_words(F.col("t")).alias("c")).collect():
        w, want, s = [str(i) for i in range(r.n)], [], 0
        while s < len(w):
            want.append(" ".join(w[s : s + 400]))
            if s + 400 >= len(w):
                break
            s += 360
        assert r.c == want
    said = spark.createDataFrame([("see [1] and [2]", [1, 2]), ("see [3]", [1]), ("I cannot answer this", [1]), ("no", [1])], "a string, p array<bigint>")
    assert [r[0] for r in said.select(T.citation_errors(said.a, said.p)).collect()] == [False, True, False, True]


def test_hashes_are_those_of_ascii_json(spark):
    import hashlib
    import json

    from plumbline.functions import canonical

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = ["plain", 'quote " and \\ slash', "tab\tline\n\r\x00\x1f\x7f", "größe 東京 😀 \u2028\x85", "", " "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: (r.h, r.e) for r in df.select("t", canonical.text_hash(df.t).alias("h"), canonical.embedding_hash(canonical.text_hash(df.t), "m", "p").alias("e")).collect()}
    assert got.pop(None) is not None
    assert got == {t: (sha(json.dumps(t)), sha(json.dumps([sha(json.dumps(t)), "m", "p"], separators=(",", ":")))) for t in texts}
