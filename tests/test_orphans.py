import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from plumbline.operators.orphans import as_of, delivered, orphan_keys, orphans_in_time
from plumbline.session import broadcast_if_small, small

KEYS = "a string, b string, c int, null_mask string"


def brute(refs, targets, match):
    out = set()
    for r in {x[:3] for x in refs}:
        mask = sum(1 << i for i, v in enumerate(r) if v is None)
        if mask == 7 or mask and match == "simple":
            continue
        if mask and match == "full":
            out.add((*r, mask))
            continue
        hit = any(all(v is None or v == t for v, t in zip(r, x)) for x in targets if mask or None not in x[:3])
        if not hit:
            out.add((*r, mask))
    return sorted(out, key=repr)


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_match_semantics(spark, rows, match):
    r = random.Random(3)
    pick = lambda: (r.choice((None, "x", "y", "z")), r.choice((None, "1", "2")), r.choice((None, 1, 2, 3)), "")
    refs, targets = [pick() for _ in range(150)], [pick() for _ in range(12)]
    a, b = spark.createDataFrame(refs, KEYS), spark.createDataFrame(targets, KEYS)
    assert rows(orphan_keys(a, b.drop("null_mask"), ["a", "b", "c"], match)) == brute(refs, targets, match)
    none = b.limit(0)
    assert rows(orphan_keys(a, none, ["a", "b", "c"], match)) == brute(refs, [], match)
    assert rows(orphan_keys(a.limit(0), b, ["a", "b", "c"], match)) == []


def test_configuration(spark):
    df = spark.createDataFrame([], KEYS)
    with pytest.raises(ValueError):
        orphan_keys(df, df, ["a"], "some")
    with pytest.raises(ValueError):
        orphan_keys(df, df, [], "full")


T0 = datetime(2025, 1, 1)
REFS = "namespace string, ref_value string, ref_time timestamp_ntz, ref_row bigint, at string, snapshot_no string, first string, line string"
SNAPS = "namespace string, snapshot_no int, delivered_at timestamp_ntz, value string"


def test_status_in_time(spark, rows):
    r = random.Random(4)
    day = lambda n: T0 + timedelta(days=n)
    snaps = [(ns, no, day(10 * no), v) for ns in ("n", "m") for no in (1, 2, 5) for v in "abcdef" if r.random() < 0.6]
    refs = [(r.choice(("n", "m", "o")), r.choice([*"abcdefg", None, " ", "a "]), r.choice((None, *(day(n) for n in (0, 10, 15, 20, 49, 50, 60)))), i, "q", "q", "q", "q") for i in range(300)]
    refs += [("n", "zz", day(30), 1000 + i, "q", "q", "q", "q") for i in range(300)]
    s = spark.createDataFrame(snaps + snaps, SNAPS)
    got = rows(orphans_in_time(spark.createDataFrame(refs, REFS), s.select("namespace", "snapshot_no", "value"), delivered(s)), "ref_row", "ref_status", "at")
    want = []
    for ns, v, t, i, *_ in refs:
        if v is None or not v.strip() or t is None:
            continue
        line = sorted({(at, no) for n, no, at, _ in snaps if n == ns})
        before = [x for x in line if x[0] <= t]
        held = {(at, no) for n, no, at, x in snaps if n == ns and x == v}
        if before and before[-1] in held:
            continue
        want.append((i, "missing" if not held else "deleted" if before and any(h < before[-1] for h in held) else "late", "q"))
    assert got == sorted(want, key=repr)


def test_empty(spark, rows):
    s = spark.createDataFrame([], SNAPS)
    refs = spark.createDataFrame([("n", "a", T0, 1, "", "", "", "")], REFS)
    assert rows(orphans_in_time(refs, s.select("namespace", "snapshot_no", "value"), delivered(s)), "ref_row", "ref_status") == [(1, "missing")]
    assert rows(orphans_in_time(refs.limit(0), s.select("namespace", "snapshot_no", "value"), delivered(s)), "ref_row") == []


@pytest.mark.parametrize("unit", ["day", "week", "year"])
def test_as_of_against_brute_force(spark, unit):
    r, start = random.Random(5), datetime(2024, 12, 20)
    at = lambda: start + timedelta(hours=r.randrange(24 * 40))
    snaps = [(ns, no, at()) for ns in ("a", "b") for no in range(12)]
    refs = [(r.choice(("a", "a", "b", "none")), i, at()) for i in range(300)] + [("a", 300, snaps[3][2]), ("b", 301, start - timedelta(days=400))]
    s = spark.createDataFrame(snaps, "namespace string, snapshot_no int, delivered_at timestamp_ntz")
    got = as_of(spark.createDataFrame(refs, "namespace string, n int, t timestamp_ntz"), s, "t", unit).collect()
    want = {}
    for ns, n, t in refs:
        line = [(d, no) for x, no, d in snaps if x == ns and d <= t]
        want[n] = max(line, default=(None, None))
    assert {x.n: (x["at"], x.snapshot_no) for x in got} == want and len(got) == len(refs)


def test_sides_are_broadcast_by_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert hinted(broadcast_if_small(few)) and hinted(small(few)) and hinted(small(few.limit(0)))
    assert not hinted(broadcast_if_small(few, rows=9)) and not hinted(broadcast_if_small(few, size=9_000))
