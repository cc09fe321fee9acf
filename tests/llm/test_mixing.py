import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.mixing import TOKENIZER, Target, count_tokens, mix_sources, water_fill

DOC = "doc_id bigint, text string, source string, tokens string, draw string, copies string"
GOAL = "source string, target_share double, max_repeats int, tokens string"
needs = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the public vocabulary isn't here")
target = st.tuples(st.floats(0, 1), st.integers(0, 10_000), st.integers(0, 8))


@settings(max_examples=200, deadline=None)
@given(st.lists(target, max_size=12), st.one_of(st.none(), st.floats(0, 1e6)))
def test_water_filling(spec, total):
    ts = [Target(str(i), *s) for i, s in enumerate(spec)]
    got = water_fill(ts, total)
    total = sum(t.tokens for t in ts) if total is None else total
    caps = {t.source: t.cap * t.tokens for t in ts}
    assert all(-1e-6 <= got[t.source] <= caps[t.source] + 1e-6 * (1 + caps[t.source]) for t in ts)
    room = sum(caps[t.source] for t in ts if t.share > 0)
    assert sum(got.values()) == pytest.approx(min(total, room), rel=1e-6, abs=1e-6)
    free = [t for t in ts if t.share > 1e-9 and got[t.source] < caps[t.source] * (1 - 1e-9)]
    for a, b in zip(free, free[1:]):  # sources that aren't clamped keep their proportions
        assert got[a.source] * b.share == pytest.approx(got[b.source] * a.share, rel=1e-6, abs=1e-9)


@needs
def test_shares_caps_and_copies(spark):
    docs = [(i, f"alpha text number {i} with some words in it", " Alpha " if i % 2 else "ALPHA", "", "", "") for i in range(2000)]
    docs += [(5000 + i, f"beta text number {i} with some words in it", "beta", "", "", "") for i in range(100)]
    docs += [(6000 + i, "one and the same text of beta", "beta", "", "", "") for i in range(500)]
    docs += [(7000, None, "beta", "", "", ""), (7001, " \n", "beta", "", "", ""), (7002, "no source", None, "", "", ""), (7003, "other", "gamma", "", "", ""), (None, "no id", "beta", "", "", "")]
    goals = [("alpha", 0.5, 2, ""), ("Beta", 0.5, 3, ""), ("absent", 0.3, 4, ""), (None, 0.1, 1, "")]
    mix = mix_sources(spark.createDataFrame(docs, DOC), spark.createDataFrame(goals, GOAL), total_tokens=10_000)
    texts = {r.doc_id: r for r in mix.texts.collect()}
    report = {r.source: r for r in mix.report.collect()}
    assert set(report) == {"alpha", "beta", "absent"}
    assert not texts.keys() & {7000, 7001, 7002, 7003, None}
    assert report["beta"].texts == 101 and sum(6000 <= i < 6500 for i in texts) == 1  # copies are one text
    assert report["beta"].most_copies == 3 and all(r.copies == 3 for r in texts.values() if r.source == "beta")
    assert report["absent"].mixed_tokens == 0
    want = 10_000 - report["beta"].mixed_tokens
    assert report["alpha"].mixed_tokens == pytest.approx(want, abs=40)
    assert sum(r.mixed_share for r in report.values()) == pytest.approx(1)
    for s in ("alpha", "beta"):
        assert report[s].mixed_tokens == sum(r.tokens * r.copies for r in texts.values() if r.source == s)
    again = mix_sources(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(goals, GOAL), total_tokens=10_000)
    assert {(r.doc_id, r.copies) for r in again.texts.collect()} == {(r.doc_id, r.copies) for r in texts.values()}
    other = mix_sources(spark.createDataFrame(docs, DOC), spark.createDataFrame(goals, GOAL), total_tokens=10_000, seed=12)
    assert {r.doc_id for r in other.texts.collect()} != set(texts)


@needs
def test_empty(spark):
    mix = mix_sources(spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 2, "")], GOAL))
    assert mix.texts.count() == 0
    assert [tuple(r)[:1] + (r.mixed_tokens, r.mixed_share) for r in mix.report.collect()] == [("a", 0, 0.0)]
    mix = mix_sources(spark.createDataFrame([(1, "x", "a", "", "", "")], DOC), spark.createDataFrame([], GOAL))
    assert mix.texts.count() == 0 and mix.report.count() == 0


@needs
def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("a" * 200_000,)], "t string")
    assert [r[0] for r in df.select(count_tokens(df.t)).collect()] == [2, 0, None, 25_000 * 2]
