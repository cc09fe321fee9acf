import random
import unicodedata

import numpy as np
import pytest

from plumbline.llm.queries import p8_found, p8_stats
from plumbline.llm.textquality import COUNTS, STATS, divergence, sparse_divergence, text_counts, text_quality

DOC = "doc_id bigint, text string, flags string, structure string"
WORDS = "lang string, word string"
COMMON = [("en", w) for w in "the of and to a in is it was for".split()] + [("de", w) for w in "der die und in zu das".split()] + [("en", None)]
PROSE = "The cat sat in the house and it was happy to be in a place for the night. It is a story of the old town and the people in it. "
TABLE = "id,qty,rate\n" + "".join(f"A{i},{i * 37},{i * 1.5}\n" for i in range(20))
LIST = "".join(f"blue kettle wooden spoon {w}\n" for w in ("iron", "brass", "tin", "oak", "pine", "elm", "ash", "fir"))


def table(spark, texts):
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in enumerate(texts)], DOC)
    return {r.doc_id: r for r in text_quality(df, spark.createDataFrame(COMMON, WORDS)).collect()}


WHITE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
DIRTY = [
    "The cat.\r\n\r\n A-b!\rx_1", "", " \n\t", "a…\n　\nb", "no end", "ends.\u3000\u00a0\n.\n..\r?", "x\x0b.\x0c\u2028y!\x85", "\x1c.\x1d\n\x1e",
    "Größe 12½ Ⅷ 東京。", "e\u0301t\u0301", "𝒳 𝟙😀.", "THE The tHe of\u200bof", "\r\r\n\n\r", "der-die-\ndas_und.", "." * 5, "\u00a0", "a.\u00a0\u00a0b. ",
]


def brute_counts(text, common):
    kind = lambda c: unicodedata.category(c)[0]
    runs = "".join(c if kind(c) in "LN" else "\n" for c in text).split("\n")
    words = [w for w in runs if w]
    lines = [x.strip(WHITE) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    lines = [x for x in lines if x]
    return (
        len(words), sum(map(len, words)), sum(c not in WHITE for c in text), len(lines), sum(x[-1] in ".!?…" for x in lines), sum(w.lower() in common for w in words),
    )


def test_counts_against_brute_force(spark):
    r = random.Random(2)
    pieces = ["The", "of", "x1", "Ä", "é", "Σ", "İn", "\r\n", "\n", "\r", " ", "\u2003", ".", "!", "…", "-", "_", "\x1f", "１２", "東", "\x85", "  "]
    texts = DIRTY + ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in enumerate(texts)] + [(-1, None, "", "")], DOC)
    common = {w for _, w in COMMON if w}
    got = {x.doc_id: tuple(x[c] for c in COUNTS) for x in text_counts(df, spark.createDataFrame(COMMON, WORDS)).collect()}
    assert got == {i: brute_counts(t, common) for i, t in enumerate(texts)}


def test_sparse_divergence_is_that_of_the_whole_distributions():
    g = np.random.default_rng(1)
    whole = g.random((50, 30)) * (g.random((50, 30)) < 0.3)
    whole[3] = 0
    whole /= np.maximum(whole.sum(axis=1, keepdims=True), 1e-300)
    q = g.random(30) * (g.random(30) < 0.7)
    q /= q.sum()
    doc, at = np.nonzero(whole)
    assert sparse_divergence(doc, at, whole[doc, at], 50, q) == pytest.approx(divergence(whole, q))


def test_statistics_and_flags(spark):
    got = table(spark, [PROSE, "", " \n\t", None, "!!!! ???? ****", "x " * 30])
    assert set(got) == {0, 1, 2, 4, 5}
    assert got[0].flags == 0 and got[0].n_words == 31
    assert got[0].stop_line_share == 1 and got[0].symbol_ratio == pytest.approx(2 / 95)
    for i in (1, 2):
        assert tuple(got[i][c] for c in STATS[:6]) == (0, 0, 0, 0, 0, 4)
        assert got[i].structure == "junk"
    assert got[4].symbol_ratio == 1 and got[4].stop_line_share == 0 and got[4].flags == 5
    assert got[5].mean_word_length == 1 and got[5].flags == 3


def test_structures(spark):
    got = table(spark, [PROSE * 3] * 5 + [TABLE] * 5 + [LIST] * 5 + ["zG7Q+kk/9Px0aB" * 40, ". . . . . . " * 30])
    assert [got[i].structure for i in (0, 5, 10, 15, 16)] == ["prose", "table", "list", "junk", "junk"]
    assert got[0].prose_divergence < 0.1 < got[5].prose_divergence
    assert all(0 <= r.divergence <= r.prose_divergence <= 1 for r in got.values())


def test_repartition_changes_nothing(spark):
    texts = [PROSE, TABLE, LIST, "a b"] * 10
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in enumerate(texts)], DOC)
    words = spark.createDataFrame(COMMON, WORDS)
    a, b = ({tuple(r) for r in text_quality(x, words).collect()} for x in (df, df.repartition(7)))
    assert a == b


def test_empty_tables_and_long_text(spark):
    none = spark.createDataFrame([], DOC)
    words = spark.createDataFrame(COMMON, WORDS)
    assert text_quality(none, words).count() == 0
    one = spark.createDataFrame([(1, PROSE * 20_000, "", "")], DOC)
    assert text_quality(one, spark.createDataFrame([], WORDS)).collect()[0].n_words == 31 * 20_000


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 0.0]])
    assert divergence(p, np.array([0.0, 1.0])).tolist()[::2] == [1.0, 1.0]
    assert divergence(p, np.array([0.5, 0.5]))[1] == 0


def test_rows_without_id_are_kept(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, PROSE, "", ""), (big, PROSE, "", ""), (big, PROSE, "", "")], DOC)
    got = text_quality(df, spark.createDataFrame(COMMON, WORDS))
    assert sorted((r.doc_id for r in got.collect()), key=repr) == [big, big, None]
    assert dict(got.dtypes)["doc_id"] == "bigint"


def test_found_rows_come_from_the_whole_method(spark, tmp_path):
    texts = [*DIRTY, PROSE * 3, TABLE, LIST, "zG7Q+kk/9Px0aB" * 40, "!!!! ???? ****", None]
    rows = [*enumerate(texts), (None, "a b"), (2**60 + 1, "a b"), (2**60 + 1, "a b")]
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in rows], DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(COMMON, WORDS).write.parquet(f"{tmp_path}/common_words.parquet")
    found = p8_found(spark, str(tmp_path))
    # What the optimizer leaves in: the structure and divergence of every text are computed.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "prose_divergence" in plan and "structure" in plan
    got = sorted(r.doc_id for r in found.collect())
    stats = {r.doc_id: r for r in p8_stats(spark, str(tmp_path)).collect()}
    counts = {r.doc_id: r.flags for r in text_counts(df, spark.createDataFrame(COMMON, WORDS)).collect()}
    assert got == sorted(i for i, n in counts.items() if n >= 2 and i is not None)
    assert {i: r.flags for i, r in stats.items()} == counts
    assert len(DIRTY) not in got and {len(DIRTY) + 3, 2**60 + 1} <= set(got)
    assert all(stats[i].structure in ("prose", "list", "table", "junk") and 0 <= stats[i].divergence <= 1 for i in got)
