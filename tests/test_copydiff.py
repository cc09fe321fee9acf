import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.copydiff import Field, diff_copies, tag_copies

SCHEMA = "side int, k string, entry_no bigint, a string, h string, u array<string>, x double, mask int, bucket string"
FIELDS = (Field("a"), Field("h", "hash"), Field("u", "set"), Field("x", "tolerance", 2e-5))


def brute(entries):
    last = {}
    for side, k, n, a, h, u, x, *_ in entries:
        if (side, k) not in last or n > last[side, k][0]:
            last[side, k] = (n, a, h, u, x)
    norm = lambda h: None if h is None else h.strip().lower()
    group = lambda u: None if u is None else frozenset(u)
    out = set()
    for k in {k for _, k in last}:
        e, o = last.get((1, k)), last.get((-1, k))
        if o is None or e is None:
            out.add((k, "missing_observed" if o is None else "missing_expected"))
            continue
        if e[1] != o[1]:
            out.add((k, "a"))
        if norm(e[2]) != norm(o[2]):
            out.add((k, "h"))
        if group(e[3]) != group(o[3]):
            out.add((k, "u"))
        if (e[4] is None) != (o[4] is None) or e[4] is not None and abs(e[4] - o[4]) > 2e-5:
            out.add((k, "x"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_random_copies(spark, rows, bucket_rows):
    r = random.Random(bucket_rows)
    entries = []
    for i in range(300):
        for side in (1, -1):
            if r.random() < 0.05:
                continue
            for n in range(r.choice((1, 1, 1, 2, 3))):
                pick = lambda same, *other: r.choice(other) if r.random() < 0.04 else same
                h = f"AB{i}"
                units = [f"u{i}", "v"]
                r.shuffle(units)
                x = None if i % 50 == 0 else i + r.uniform(-4e-6, 4e-6)
                entries.append(
                    (side, None if i == 7 else f"k{i}", len(entries), pick(f"a{i}", None, "z"), pick(r.choice((h, h.lower(), f" {h}\n")), None, "q"), pick(units, None, [], ["v"]), pick(x, None, i + 1.0), r.randint(0, 9), "noise")
                )
    df = spark.createDataFrame(entries, SCHEMA)
    got = rows(diff_copies(df, ["k"], FIELDS, "entry_no", bucket_rows))
    assert got == brute(entries)
    assert rows(diff_copies(df.repartition(7).unionByName(df), ["k"], FIELDS, "entry_no", bucket_rows)) == got


def test_hot_key_and_ties(spark, rows):
    entries = [(1, "hot", 5, "a", None, None, None, 0, "")] * 500 + [(-1, "hot", i, "b" if i < 499 else "a", None, None, None, 0, "") for i in range(500)]
    entries += [(1, "tie", 1, "a", None, None, None, 0, ""), (1, "tie", 1, "b", None, None, None, 0, ""), (-1, "tie", 1, "b", None, None, None, 0, ""), (-1, "tie", 1, "a", None, None, None, 0, "")]
    df = spark.createDataFrame(entries, SCHEMA)
    assert rows(diff_copies(df, ["k"], FIELDS, "entry_no")) == []


def test_empty_and_one_sided(spark, rows):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(diff_copies(df, ["k"], FIELDS, "entry_no")) == []
    one = spark.createDataFrame([(1, "k", 1, None, None, None, None, 0, "")], SCHEMA)
    assert rows(diff_copies(one, ["k"], FIELDS, "entry_no")) == [("k", "missing_observed")]


def test_key_names_may_clash(spark, rows):
    a = spark.createDataFrame([("1", "x", 1, "v")], "bucket string, mask string, o int, e0 string")
    b = spark.createDataFrame([("1", "x", 1, "w" * 1_000_000)], "bucket string, mask string, o int, e0 string")
    both = tag_copies(a, b, a.columns)
    assert rows(diff_copies(both, ["bucket", "mask"], [Field("e0")], "o")) == [("1", "x", "e0")]


def test_only_unequal_columns_are_read(spark):
    df = spark.createDataFrame([(s, f"k{i}", 1, f"{i if i else s}", "h", ["u"], 1.0, 0, "") for i in range(50) for s in (1, -1)], SCHEMA)
    diff = diff_copies(df, ["k"], FIELDS, "entry_no")
    assert [r.field_name for r in diff.collect()] == ["a"]


def test_configuration():
    with pytest.raises(ValueError):
        Field("a", "fuzzy")
    with pytest.raises(ValueError):
        Field("a", "tolerance", 0)


def test_nan_equals_nan_only(spark, rows):
    nan = float("nan")
    data = [(1, "a", 1, None, None, None, nan, 0, ""), (-1, "a", 1, None, None, None, nan, 0, ""), (1, "b", 1, None, None, None, nan, 0, ""), (-1, "b", 1, None, None, None, 1.0, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(diff_copies(df, ["k"], FIELDS, "entry_no")) == [("b", "x")]
    assert df.where(F.col("x") > 0).count() == 4
