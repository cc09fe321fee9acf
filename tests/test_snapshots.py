import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.functions.hashing import digest
from plumbline.operators.snapshots import entity_rows, snapshot_changes, snapshot_index

SCHEMA = "namespace string, snapshot_no int, id string, v string, loaded_at timestamp_ntz, idx int, value string"
T0 = datetime(2025, 1, 1)


def brute(data):
    newest = {}
    for ns, no, i, v, at, *_ in data:
        if no is None:
            continue
        key = (ns, no, i)
        if key not in newest or at > newest[key][0]:
            newest[key] = (at, v)
    out = set()
    for ns in {k[0] for k in newest}:
        nos = sorted({k[1] for k in newest if k[0] == ns})
        for a, b in zip(nos, nos[1:]):
            old = {k[2]: v for k, (_, v) in newest.items() if k[:2] == (ns, a)}
            new = {k[2]: v for k, (_, v) in newest.items() if k[:2] == (ns, b)}
            out |= {(ns, b, "doc", i, "added") for i in new.keys() - old.keys()}
            out |= {(ns, b, "doc", i, "removed") for i in old.keys() - new.keys()}
            out |= {(ns, b, "doc", i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return sorted(out, key=repr)


def changes(df):
    return snapshot_changes(entity_rows(df, "doc", "id", digest(F.col("v"))), snapshot_index(df))


def test_random_snapshots(spark, rows):
    r = random.Random(1)
    data = []
    for ns in ("a", "b", None):
        for no in (1, 2, 4, 5, 9):
            for i in range(60):
                if r.random() < 0.8:
                    for _ in range(r.choice((1, 1, 2))):
                        data.append((ns, no, None if i == 3 else f"d{i}", r.choice((None, "1", "2")), T0 + timedelta(seconds=len(data)), 1, "x"))
    data += [("a", None, "d1", "1", T0, 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(changes(df)) == brute(data)
    assert rows(changes(df.unionByName(df).repartition(7))) == brute(data)


def test_hot_key(spark, rows):
    data = [("a", no, "hot", str(n), T0 + timedelta(seconds=n), 0, "") for no in (1, 2) for n in range(300)] + [("a", 2, "other", None, T0, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(changes(df)) == [("a", 2, "doc", "other", "added")]


def test_empty_and_single(spark, rows):
    assert rows(changes(spark.createDataFrame([], SCHEMA))) == []
    assert rows(changes(spark.createDataFrame([("a", 1, "x", "1", None, 0, "")], SCHEMA))) == []


def test_null_load_time_is_oldest(spark, rows):
    data = [("a", 1, "x", "1", T0, 0, ""), ("a", 2, "x", "2", None, 0, ""), ("a", 2, "x", "1", T0, 0, "")]
    assert rows(changes(spark.createDataFrame(data, SCHEMA))) == []
