import random
from datetime import datetime, timedelta

import pytest

from plumbline.operators import incremental
from plumbline.operators.incremental import EmbeddingIncrement, GenerationStore, StaleRunError
from plumbline.queries import problems

T0 = datetime(2025, 1, 1)
COMMITS = "namespace string, sequence int, base_revision string, revision string, _to int"
PLANS = "plan_id string, namespace string, base_revision string, revision string, created_at timestamp_ntz, embed_ids array<string>"
CHUNKS = "namespace string, snapshot_no int, chunk_id string, embedding_hash string, loaded_at timestamp_ntz, step int"
DOCS = "namespace string, snapshot_no int, revision string, document_id string"


def make(seed):
    r = random.Random(seed)
    commits, plans, chunks, docs = [], [], [], []
    for ns in ("a", "b", "c"):
        for no in range(1, 7):
            docs += [(ns, no, f"{ns}{no}", "d")] * 2
            for i in range(20):
                if r.random() < 0.8:
                    h = r.choice(("H1", "h1 ", "h2", None))
                    chunks += [(ns, no, f"{ns}-{i}", h, T0 + timedelta(seconds=len(chunks)), 0)] * r.choice((1, 2))
            ids = r.choice((None, [f"{ns}-{r.randrange(25)}" for _ in range(15)] + [None]))
            plans += [(f"p{ns}{no}", ns, f"{ns}{no - 1}", f"{ns}{no}", T0, ids)] * r.choice((1, 2))
            plans.append((f"x{ns}{no}", ns, "other", f"{ns}{no}", T0, [f"{ns}-1"]))
            if ns != "c" and r.random() < 0.8:
                commits += [(ns, no, f"{ns}{no - 1}", f"{ns}{no}", 0)] * r.choice((1, 2))
    return commits, plans, chunks, docs


def brute(commits, plans, chunks, docs):
    done = {c[:4] for c in commits}
    newest = {}
    for ns, no, i, h, at, _ in chunks:
        if (ns, no, i) not in newest or at > newest[ns, no, i][0]:
            newest[ns, no, i] = (at, None if h is None else h.strip().lower())
    revision = {(ns, rev): no for ns, no, rev, _ in docs}
    out = set()
    for ns in {d[0] for d in docs}:
        snap = lambda no: {i: h for (n, s, i), (_, h) in newest.items() if (n, s) == (ns, no)}
        state = {}
        steps = sorted({(seq, p[4], p[0], p[3], tuple(p[5] or ())) for n, seq, base, rev in done if n == ns for p in plans if p[1:4] == (ns, base, rev)}, key=lambda s: s[:3])
        for *_, rev, ids in steps:
            now = snap(revision[ns, rev])
            state = {i: h for i, h in state.items() if i in now}
            for i in set(ids) & now.keys():
                if i in state and state[i] == now[i]:
                    out.add((ns, rev, i, "repeated"))
                state[i] = now[i]
        last = max(no for n, no, *_ in docs if n == ns)
        for i, h in snap(last).items():
            if i not in state or state[i] != h:
                out.add((ns, f"{ns}{last}", i, "pending"))
    return sorted(out, key=repr)


def frames(spark, data):
    return [spark.createDataFrame(x, s) for x, s in zip(data, (COMMITS, PLANS, CHUNKS, DOCS))]


@pytest.mark.parametrize("seed", range(2))
def test_one_run_and_many_give_the_same(spark, rows, tmp_path, seed):
    data = make(seed)
    want = brute(*data)
    once = EmbeddingIncrement(spark, f"file://{tmp_path}/once")
    once.run(*frames(spark, data))
    assert rows(once.work()) == want
    many = EmbeddingIncrement(spark, f"file://{tmp_path}/many")
    for limit in (3, 3, 6):
        part = [c for c in data[0] if c[1] <= limit]
        many.run(*frames(spark, (part, *data[1:])))
        assert rows(many.work()) == brute(part, *data[1:])


@pytest.mark.parametrize("late", ["commits", "plans", "chunks", "docs", "all"])
def test_rows_that_arrive_after_the_run_count(spark, rows, tmp_path, late):
    """Commits below the watermark are replayed with what has come since; every run is right for what it sees."""
    data, r = make(3), random.Random(4)
    part = [[x for x in t if late not in (n, "all") or r.random() < 0.6] for n, t in zip(("commits", "plans", "chunks", "docs"), data)]
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/late")
    for seen in (part, data, data):
        work.run(*frames(spark, seen))
        held = {(d[0], d[2]) for d in seen[3]}
        assert rows(work.work()) == brute(seen[0], [p for p in seen[1] if (p[1], p[3]) in held], *seen[2:])
    since = spark.read.parquet(f"{work.store.commits()[-1][1]['folder']}/marks").select("since").collect()
    assert since and all(r.since < 3 for r in since)  # where nothing came, nothing is replayed


def test_the_query_in_two_runs_gives_what_one_run_gives(spark, rows, monkeypatch):
    numbers, run = [], EmbeddingIncrement.run
    monkeypatch.setattr(EmbeddingIncrement, "run", lambda *a: numbers.append(run(*a)))
    two = rows(problems.QUERIES["p2_in_two_runs"](spark, "/root/testdata/sf0.001"))
    assert numbers == [1, 2]
    assert two and two == rows(problems.p2_found(spark, "/root/testdata/sf0.001"))


def test_failure_before_the_commit_leaves_nothing(spark, rows, tmp_path, monkeypatch):
    data = make(5)
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/s")
    work.run(*frames(spark, ([c for c in data[0] if c[1] <= 3], *data[1:])))
    before = rows(work.work())
    with monkeypatch.context() as m:
        m.setattr(work.store, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            work.run(*frames(spark, data))
    assert rows(work.work()) == before
    work.run(*frames(spark, data))
    assert rows(work.work()) == brute(*data)


def test_only_touched_namespaces_are_written_and_generations_stay_few(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    data = make(7)
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/c")
    for run, (ns, limit) in enumerate((("a", 2), ("a", 4), ("b", 3), ("b", 6), ("a", 6)), 1):
        seen = {**(seen if run > 1 else {}), ns: limit}
        part = [c for c in data[0] if c[1] <= seen.get(c[0], 0)]
        work.run(*frames(spark, (part, *data[1:])))
        assert rows(work.work()) == brute(part, *data[1:])
        number, last = work.store.last()
        assert number == run and len(last["live"]) <= 2
        if run == 2:  # nothing was copied yet
            written = {r[0] for r in spark.read.parquet(f"{last['folder']}/rows").select("namespace").distinct().collect()}
            assert written == {"a"}


def test_second_writer_loses(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/g")
    store.publish(1, {"a": 1})
    with pytest.raises(StaleRunError):
        store.publish(1, {"a": 2})
    assert store.commits() == [(1, {"a": 1})]


def test_empty_tables(spark, rows, tmp_path):
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        work.work()
    work.run(*frames(spark, ([], [], [], [])))
    assert rows(work.work()) == []


def test_no_successful_plan_leaves_all_pending(spark, rows, tmp_path):
    data = ([], [], [("a", 1, "c1", "h", T0, 0), ("a", 1, "c1", "h", T0, 0)], [("a", 1, "r", "d")])
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/n")
    work.run(*frames(spark, data))
    assert rows(work.work()) == [("a", "r", "c1", "pending")]


def test_nulls_in_plans(spark, rows, tmp_path):
    commits = [("a", 1, "r0", "r1", 0), ("a", None, "r0", "r9", 0), (None, 1, "r0", "r1", 0)]
    plans = [(None, "a", "r0", "r1", None, ["c1", "c2"]), ("p", None, "r0", "r1", T0, ["c3"])]
    chunks = [("a", 1, "c1", "h", None, 0), ("a", 1, "c3", None, T0, 0), (None, 1, "c9", "h", T0, 0)]
    work = EmbeddingIncrement(spark, f"file://{tmp_path}/q")
    work.run(*frames(spark, (commits, plans, chunks, [("a", 1, "r1", "d"), (None, 1, "r1", "d")])))
    assert rows(work.work()) == [("a", "r1", "c3", "pending")]
