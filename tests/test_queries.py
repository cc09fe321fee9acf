"""Queries against their SQL, over the smallest tables, with code generation on.

A choice that reaches most operators; with ALL_QUERIES set, all of them.
"""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES = {k: q for m in (__spark_entry__.problems, __spark_entry__.reference, __spark_entry__.workflow) for k, q in m.QUERIES.items()}
SQL = {k: s for m in (__spark_entry__.problems, __spark_entry__.reference, __spark_entry__.workflow) for k, s in m.SQL.items()}

SOME = (
    "baseline_match", "chunk_row_findings", "deletion_summary", "embedding_audit", "export_round_trip", "findings_by_code", "folder_units", "ingestion_audit", "ledger_history", "low_distinctiveness",
    "orphan_keys_partial", "p1_found", "p2_found", "p3_found", "p5_found", "payload_labels", "plan_embeddings", "positional_chunk_keys", "reconciled_inventories", "run_verdicts", "snapshot_chunks", "update_actions",
)


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture
def generated(spark):
    """Whole-stage code generation, as in production."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query(generated, db, name):
    df = QUERIES[name](generated, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(value(r[c]) for c in names)) for r in df.collect())
    if name in SQL:
        r = db.execute(SQL[name])
        at = [x[0] for x in r.description]
        assert sorted(at) == names
        assert got == sorted(repr(tuple(value(row[at.index(c)]) for c in names)) for row in r.fetchall())
