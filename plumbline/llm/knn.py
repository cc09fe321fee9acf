"""The most similar vectors of every vector, by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``m`` functions floor((a.v + b) / w) with Gaussian a over the unit
vectors; a bucket is the tuple of m cells. A vector lies in one bucket per table and visits, besides,
``probes`` perturbed buckets in the order in which they are expected to hold its neighbours: a
perturbation moves some coordinates to the nearer cells, its score is the sum of the expected squared
distances to the crossed borders (Lv et al., 2007), and the best-scored sets are taken. Candidates of
all tables are merged, thinned by the Hamming distance of 128 random-hyperplane bits, and ranked by
exact cosine in double precision. m grows with the logarithm of the number of vectors, so that the
expected number of unrelated vectors in a bucket doesn't grow with it. A greater m parts neighbours
too; so ``tables`` follows from m and the share of pairs at the least similarity that must meet.
Tables are hashed and joined in groups of GROUP, so that only one group's buckets need disk at a time.

Vectors never take part in the bucket shuffle, only 16-byte rows (bucket, row number). Exact copies
are folded into classes first. A bucket with more than BLOCK members is compared exactly and in
full, in tasks of BLOCK x BLOCK members that pass on only each member's k best and all that tie with
the k-th; none is cut off.

similar_vectors() does this for all pairs at a stated least similarity. Lists of the k most similar
without such a bound are topk_by_hash()'s, for a stated query set: there the family is fitted, on bounded
samples, to the similarities that the k-th neighbours really have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, cut

BLOCK = 2048
BITS = 128
GROUP = 2
LEAST_TABLES = 4
MOST_TABLES = 256
#: Cosines in single precision differ by less from those in double.
TIE = 2e-6
#: Bounds of what topk_by_hash() is fitted on, and of the queries that are sent out at once.
FIT_QUERIES, FIT_ROWS, QUERY_BLOCK = 200, 2000, 2000


def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """The best perturbation sets, as ranks among the 2m sorted border distances."""
    j = np.arange(1, 2 * m + 1)
    r = 2 * m + 1 - j
    score = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - r / (m + 1) + r * (r + 1) / (4 * (m + 1) * (m + 2)))
    heap, out = [(score[0], (0,))], []
    while heap and len(out) < probes:
        _, s = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):  # never both borders of one coordinate
            out.append(s)
        if s[-1] + 1 < 2 * m:
            for t in (s[:-1] + (s[-1] + 1,), s + (s[-1] + 1,)):
                heapq.heappush(heap, (float(score[list(t)].sum()), t))
    return out


class Hasher:
    """The hash family, drawn anew from its seed wherever it is needed."""

    def __init__(self, dims: int, tables: int, m: int, width: float, probes: int, seed: int) -> None:
        self.dims, self.tables, self.m, self.width, self.seed = dims, tables, m, width, seed
        self.sets = probe_sets(m, probes)

    def _draw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        g = np.random.default_rng(self.seed)
        planes = g.normal(size=(self.dims, BITS))
        a = g.normal(size=(self.tables, self.dims, self.m))
        b = g.uniform(0, self.width, size=(self.tables, self.m))
        mix = g.integers(1, 2**63, size=(self.tables, self.m + 1), dtype=np.uint64) | np.uint64(1)
        return planes, a, b, mix

    def buckets(self, unit: np.ndarray, visits: bool, part: range | None = None) -> np.ndarray:
        """(rows, tables) own buckets, or (rows, tables * (1 + probes)) own and visited ones; of the
        tables in ``part`` only, if given."""
        _, a, b, mix = self._draw()
        out, rows = [], np.arange(len(unit))
        for t in part or range(self.tables):
            x = (unit @ a[t] + b[t]) / self.width
            cell = np.floor(x)
            key = cell.astype(np.int64).astype(np.uint64) * mix[t, :-1]
            own = key.sum(axis=1, dtype=np.uint64) + mix[t, -1]
            out.append(own)
            if visits:
                low = x - cell
                order = np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1, kind="stable")
                # Moving a coordinate one cell up or down changes the key by its multiplier.
                step = np.concatenate([np.uint64(0) - mix[t, :-1], mix[t, :-1]])[order]
                for s in self.sets:
                    out.append(own + step[rows[:, None], list(s)].sum(axis=1, dtype=np.uint64))
        keys = np.stack(out, axis=1)
        keys ^= keys >> np.uint64(31)
        return (keys * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        bits = np.packbits(unit @ self._draw()[0] > 0, axis=1)
        return bits.view(np.int64)


def tables_for(recall: float, similarity: float, dims: int, m: int, width: float, probes: int, seed: int) -> int:
    """The number of tables in which the share ``recall`` of pairs at this cosine meets at least once.

    The share that meets in one table is measured on random pairs: the family is Gaussian, so it
    depends on nothing but the cosine. Tables are independent. Never fewer than LEAST_TABLES.
    """
    g, trials = np.random.default_rng(seed + 1), 8
    a, o = g.normal(size=(2, 2000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    h = Hasher(dims, trials, m, width, probes, seed + 1)
    x, y = (h.buckets(v, True).reshape(len(v), trials, -1) for v in (a, similarity * a + (1 - similarity**2) ** 0.5 * o))
    share = float(((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=2).mean())
    if share == 1:
        return LEAST_TABLES
    tables = np.ceil(np.log1p(-recall) / np.log1p(-share)) if share else np.inf
    if tables > MOST_TABLES:
        raise ValueError(f"a recall of {recall} at a cosine of {similarity} takes more than {MOST_TABLES} tables; give tables to have less")
    return max(LEAST_TABLES, int(tables))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column, dims: int) -> Column:
    """Not null, of the right length, all finite, not all zero."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def newest_vectors(df: DataFrame, id: str, vector: str, order: str, dims: int) -> DataFrame:
    """(vid, id, v, norm) of the usable newest vector per id, cut. vid numbers the rows.

    Only ids with several rows are shuffled with their vectors; their number is what counts, so an
    id with a third of all rows is one of them. Among rows of equal order the greatest vector counts.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{order}`").alias("o"), F.col(f"`{vector}`").alias("v")).where("id is not null")
    several = cut(rows.groupBy("id").count().where("count > 1").select("id"))
    hint = broadcast_if_small(several)
    last = rows.join(hint, "id", "left_semi").groupBy("id").agg(F.max(F.struct("o", "v")).alias("r")).select("id", F.col("r.v").alias("v"))
    rows = rows.join(hint, "id", "left_anti").select("id", "v").unionByName(last).where(usable(F.col("v"), dims))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return cut(rows.select(F.monotonically_increasing_id().alias("vid"), "id", F.transform("v", lambda x: x.cast("float") + F.lit(0).cast("float")).alias("v"), norm.alias("norm")))


def _candidates(reps: DataFrame, h: Hasher, part: range, k: int) -> DataFrame:
    """Distinct pairs (lo, hi) of row numbers that met in a bucket of these tables."""

    def hashed(visits: bool):
        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"vid": b["vid"], "keys": list(h.buckets(_unit(b["v"]), visits, part))})

        return reps.select("vid", "v").mapInPandas(f, "vid long, keys array<long>").select(F.explode("keys").alias("key"), "vid")

    base, visits = hashed(False), hashed(True)
    crowded = cut(base.groupBy("key").count().where(F.col("count") > BLOCK))
    if crowded.isEmpty():
        return _pairs(visits.join(base.withColumnRenamed("vid", "other"), "key"))
    hot = broadcast_if_small(crowded.select("key"))
    light = visits.join(hot, "key", "left_anti").join(base.join(hot, "key", "left_anti").withColumnRenamed("vid", "other"), "key")
    return _pairs(light.select("vid", "other").unionByName(_crowded(reps, base, visits, crowded, k)))


def _pairs(met: DataFrame) -> DataFrame:
    met = met.where("vid <> other").select(F.least("vid", "other").alias("lo"), F.greatest("vid", "other").alias("hi"))
    return met.distinct()


def _crowded(reps: DataFrame, base: DataFrame, visits: DataFrame, crowded: DataFrame, k: int) -> DataFrame:
    """(vid, other): each visitor's k best of every block of the crowded buckets."""
    visitors = visits.join(broadcast_if_small(crowded.select("key")), "key", "left_semi").distinct()
    count = visitors.groupBy("key").agg(F.count("*").alias("visitors"))
    sizes = cut(crowded.join(count, "key").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("nv")))
    sizes = broadcast_if_small(sizes)

    def blocks(rows: DataFrame, own: str, across: str, mine: str, others: str, side: int) -> DataFrame:
        rows = rows.join(sizes, "key").withColumn(mine, F.pmod(F.xxhash64("vid"), F.col(own)))
        last = F.col(across).cast("long") - 1
        return rows.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), last))).select("key", "bi", "bj", "vid", F.lit(side).alias("side"))

    members = base.join(broadcast_if_small(crowded.select("key")), "key", "left_semi")
    both = blocks(members, "nb", "nv", "bi", "bj", 0).unionByName(blocks(visitors, "nv", "nb", "bj", "bi", 1))
    both = both.join(reps.select("vid", "v"), "vid")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        m, q = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(m) or not len(q):
            return pd.DataFrame({"vid": [], "other": []}, dtype="int64")
        x, mid, out = _unit(m["v"]).astype(np.float32), m["vid"].to_numpy(), []
        for s in range(0, len(q), 512):
            part = q.iloc[s : s + 512]
            sim, qid = _unit(part["v"]).astype(np.float32) @ x.T, part["vid"].to_numpy()
            sim[qid[:, None] == mid[None, :]] = -2
            kth = -np.partition(-sim, min(k, len(mid)) - 1, axis=1)[:, min(k, len(mid)) - 1]
            a, b = np.nonzero((sim >= kth[:, None] - TIE) & (sim > -2))  # single precision decides nothing near the k-th
            out.append(pd.DataFrame({"vid": qid[a], "other": mid[b]}))
        return pd.concat(out)

    return both.groupBy("key", "bi", "bj").applyInPandas(best, "vid long, other long")


def _cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(f"{a}.v", f"{b}.v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.round(dot / (F.col(f"{a}.norm") * F.col(f"{b}.norm")), 12))


def _classes(all_: DataFrame) -> DataFrame:
    """(vid, id, rep, c) of the vectors that have copies: rep is the least vid of the c equal ones; cut."""
    same = all_.select("vid", "id", F.xxhash64(F.lit(1), "v").alias("d1"), F.xxhash64(F.lit(2), "v").alias("d2"))
    several = same.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min("vid").alias("rep")).where("c > 1")
    return cut(same.join(broadcast_if_small(cut(several)), ["d1", "d2"]).select("vid", "id", "rep", "c"))


def vector_classes(df: DataFrame, id: str, vector: str, order: str, dims: int = 64) -> DataFrame:
    """(id, class_id, copies) of every id with a usable newest vector: exact copies have the class of
    their least id. With the lists of similar_vectors() it tells all about ids that these don't list."""
    all_ = newest_vectors(df, id, vector, order, dims)
    copies = _classes(all_)
    first = copies.groupBy("rep").agg(F.min("id").alias("class_id"))
    named = copies.join(broadcast_if_small(first), "rep").select("id", "class_id", F.col("c").alias("copies"))
    alone = all_.join(broadcast_if_small(copies.select("vid")), "vid", "left_anti")
    return alone.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies")).unionByName(named)


def similar_vectors(
    df: DataFrame,
    id: str,
    vector: str,
    order: str,
    min_similarity: float,
    dims: int = 64,
    k: int = 10,
    tables: int | None = None,
    probes: int = 12,
    width: float = 1.25,
    seed: int = 7,
    recall: float = 0.99,
) -> DataFrame:
    """(id_a, id_b, similarity, place): the up to k vectors most similar to each one, by cosine (to twelve
    digits), of those with at least ``min_similarity``; ties go to the smaller id.

    Per id only the row with the greatest ``order`` counts, and only if its vector is usable (see
    usable()). An empty table gives no rows. Without ``tables`` there are as many as it takes to find
    the share ``recall`` of the pairs at a cosine of min_similarity, and more of closer ones. Of more than
    k + 1 exact copies, those beyond the first k + 1 ids aren't listed as queries: they all have the same
    answer, the first k ids; vector_classes() names the class of every id.
    """
    if not 1 <= k <= 1000 or not 0 < min_similarity <= 1 or dims < 2 or (tables is not None and tables < 1) or probes < 0 or width <= 0 or not 0 < recall < 1:
        raise ValueError("k, min_similarity, dims, tables, probes, width or recall out of range")
    all_ = newest_vectors(df, id, vector, order, dims)
    n = all_.count()
    m = max(8, round(1.04 * log(n + 2)))
    h = Hasher(dims, tables or tables_for(recall, min_similarity, dims, m, width, probes, seed), m, width, probes, seed)

    # Classes of equal vectors: narrow rows only, and of each class the first k + 1 ids.
    copies = _classes(all_).drop("c")
    first = W.partitionBy("rep").orderBy("id")
    members = copies.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).select("rep", "id", "rn")
    members = cut(members)
    others = broadcast_if_small(copies.where("vid <> rep").select("vid"))
    reps = all_.join(others, "vid", "left_anti")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = h.signs(_unit(b["v"]))
                yield pd.DataFrame({"vid": b["vid"], "s1": s[:, 0], "s2": s[:, 1]})

    signs = cut(reps.select("vid", "v").mapInPandas(signed, "vid long, s1 long, s2 long"))
    # Of n bits those of a pair at angle t differ with probability t / pi; six deviations are allowed.
    p = float(np.arccos(min_similarity) / np.pi)
    most = int(BITS * p + 6 * (BITS * p * (1 - p)) ** 0.5) + 1
    apart = F.bit_count(F.expr("x.s1 ^ y.s1")) + F.bit_count(F.expr("x.s2 ^ y.s2"))

    def near_in(part: range) -> DataFrame:
        near = _candidates(reps, h, part, k).join(signs.alias("x"), F.col("lo") == F.col("x.vid")).join(signs.alias("y"), F.col("hi") == F.col("y.vid"))
        return cut(near.where(apart <= most).select("lo", "hi"))

    found = []
    for s in range(0, h.tables, GROUP):
        found.append(near_in(range(s, min(s + GROUP, h.tables))))
    near = cut(reduce(DataFrame.unionByName, found).distinct())
    wanted = near.select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    few = reps.join(broadcast_if_small(wanted), "vid", "left_semi").select("vid", "v", "norm")
    scored = near.join(few.alias("a"), F.col("lo") == F.col("a.vid")).join(few.alias("b"), F.col("hi") == F.col("b.vid"))
    scored = cut(scored.select("lo", "hi", _cosine("a", "b").alias("similarity")).where(F.col("similarity") >= min_similarity))

    # From classes to ids. A class has one vector, so k classes are as many as can matter.
    both = scored.unionByName(scored.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), "similarity"))
    involved = both.select(F.col("lo").alias("vid")).distinct()
    single = reps.join(broadcast_if_small(involved), "vid", "left_semi").join(broadcast_if_small(members.select(F.col("rep").alias("vid")).distinct()), "vid", "left_anti")
    members = members.unionByName(single.select(F.col("vid").alias("rep"), "id", F.lit(1).alias("rn")))
    firsts = members.where("rn = 1").select(F.col("rep").alias("hi"), F.col("id").alias("first_id"))
    best = W.partitionBy("lo").orderBy(F.desc("similarity"), "first_id")
    both = both.join(firsts, "hi").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    x, y = members.alias("x"), members.alias("y")
    across = both.join(x, F.col("lo") == F.col("x.rep")).join(y, (F.col("hi") == F.col("y.rep")) & (F.col("y.rn") <= k))
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.rn") != F.col("y.rn")))
    cols = [F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")]
    lists = across.select(*cols, "similarity").unionByName(within.select(*cols, F.lit(1.0).alias("similarity")))
    place = F.row_number().over(W.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b"))
    return lists.withColumn("place", place).where(F.col("place") <= k)


def mutual_pairs(lists: DataFrame) -> DataFrame:
    """(id_a, id_b), a < b, of the pairs in which each is in the other's list."""
    pair = lists.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return pair.groupBy("a", "b").count().where("count = 2").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@dataclass(frozen=True)
class Family:
    """A fitted hash family, and what is expected of it: the share of neighbours found, and of all rows looked at."""

    m: int
    width: float
    tables: int
    recall: float
    looked_at: float


def meeting_shares(cosines: np.ndarray, m: int, width: float, probes: int, dims: int, seed: int, pairs: int = 400, trials: int = 8) -> np.ndarray:
    """For each cosine, the share of pairs of which the one visits the other's bucket in one table."""
    g = np.random.default_rng(seed)
    a, o = g.normal(size=(2, pairs, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    h = Hasher(dims, trials, m, width, probes, seed)
    x = h.buckets(a, True).reshape(pairs, trials, -1)
    return np.array([(x == h.buckets(c * a + (1 - c * c) ** 0.5 * o, False)[:, :, None]).any(axis=2).mean() for c in cosines])


def fit_family(near: np.ndarray, far: np.ndarray, dims: int, rows: int, probes: int, recall: float, seed: int) -> Family:
    """The family that finds the share ``recall`` of neighbours at the cosines ``near`` with the least work.

    far: cosines of arbitrary pairs; rows: how many vectors there are. Work per row is its hashing and
    the pairs it is looked at in. What is found follows from the cosines alone, as the family is Gaussian.
    """
    grid, best = np.linspace(-0.3, 1, 27), None
    for m in range(4, max(7, round(1.5 * log(rows + 2))) + 1, 2):
        for width in (0.7, 1.0, 1.4, 2.0):
            share = meeting_shares(grid, m, width, probes, dims, seed)
            hit, miss = np.interp(near, grid, share), np.interp(far, grid, share)
            tables = 1
            while tables < MOST_TABLES and (1 - (1 - hit) ** tables).mean() < recall:
                tables += 1
            got, seen = float((1 - (1 - hit) ** tables).mean()), float((1 - (1 - miss) ** tables).mean())
            work = tables * (m * dims * 0.02 + 60) + seen * QUERY_BLOCK * 90
            if got >= recall and (best is None or work < best[0]):
                best = (work, Family(m, width, tables, got, seen))
    if best is None:
        raise ValueError(f"a recall of {recall} takes more than {MOST_TABLES} tables; use the exact search")
    return best[1]


def _best(q: np.ndarray, id: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((id, -sim, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return order[rank < k]


def topk_by_hash(
    df: DataFrame,
    queries: DataFrame,
    id: str,
    vector: str,
    order: str,
    k: int = 10,
    dims: int = 64,
    recall: float = 0.95,
    probes: int = 32,
    seed: int = 7,
    family: Family | None = None,
) -> DataFrame:
    """(id_a, id_b, similarity, place): for each id of ``queries`` (first column) the k vectors most
    similar to its own, however far, found by multiprobe hashing with the expected ``recall``.

    The family is fitted to the cosines of the k nearest of FIT_QUERIES queries, found exactly, and to
    those of FIT_ROWS rows; it is then applied to every row. Queries are sent out in blocks of
    QUERY_BLOCK with the buckets that they visit, each block one pass over all rows; a task looks at its rows
    that lie in such a bucket and passes on each query's k best. Nothing else is shuffled. Copies are
    vectors like others, ties (to twelve digits) go to the smaller id. Which rows count is as in
    similar_vectors(); queries without a usable vector have no list.
    """
    if not 1 <= k <= 1000 or dims < 2 or probes < 0 or not 0 < recall < 1:
        raise ValueError("k, dims, probes or recall out of range")
    all_ = newest_vectors(df, id, vector, order, dims)
    asked = all_.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi").select("id", "v")
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 + asked.count() // QUERY_BLOCK))))
    blocks = [r[0] for r in asked.select("block").distinct().collect()]  # one in QUERY_BLOCK queries
    n, kind = all_.count(), dict(all_.dtypes)["id"]
    schema = f"id_a {kind}, id_b {kind}, similarity double"
    base = all_.select("id", "v")
    if not blocks:
        return df.sparkSession.createDataFrame([], schema + ", place int")

    def some(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        r = rows.select("id", "v").orderBy(F.xxhash64("id")).limit(most).toPandas()  # a bounded sample
        return r["id"].to_numpy(), _unit(r["v"])

    def ranked(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b"))
        return rows.withColumn("place", place).where(F.col("place") <= k)

    if family is None:
        ids, unit = some(asked, FIT_QUERIES)

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                own = b["id"].to_numpy()
                sim = unit @ _unit(b["v"]).T
                sim[ids[:, None] == own[None, :]] = -2
                q, at = np.nonzero(sim >= -np.partition(-sim, min(k, len(b)) - 1, axis=1)[:, [min(k, len(b)) - 1]])
                keep = _best(q, own[at], sim[q, at], k)
                yield pd.DataFrame({"id_a": ids[q[keep]], "id_b": own[at[keep]], "similarity": sim[q[keep], at[keep]]})

        near = ranked(base.mapInPandas(exact, schema).where("similarity > -2")).select("similarity").toPandas()["similarity"].to_numpy()
        far = (unit @ some(base, FIT_ROWS)[1].T).ravel()
        family = fit_family(near if len(near) else np.ones(1), far, dims, n, probes, recall, seed)
    h = Hasher(dims, family.tables, family.m, family.width, probes, seed)

    def search(block: int) -> DataFrame:
        ids, unit = some(asked.where(F.col("block") == block), n + 1)  # QUERY_BLOCK or so
        visits = h.buckets(unit, True).reshape(len(ids), h.tables, -1)
        tables = []
        for t in range(h.tables):
            keys = visits[:, t].ravel()
            at = np.argsort(keys, kind="stable")
            tables.append((keys[at], (at // visits.shape[2]).astype(np.int32)))
        sent = df.sparkSession.sparkContext.broadcast((ids, unit, tables))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit, tables = sent.value
            for b in batches:
                if not len(b):
                    continue
                own, x = b["id"].to_numpy(), _unit(b["v"])
                buckets, met = h.buckets(x, False), []
                for t, (keys, who) in enumerate(tables):
                    low, high = (np.searchsorted(keys, buckets[:, t], side=s) for s in ("left", "right"))
                    c = high - low
                    at = np.repeat(low - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
                    met.append(who[at].astype(np.int64) * len(b) + np.repeat(np.arange(len(b)), c))
                q, row = np.divmod(np.unique(np.concatenate(met)), len(b))
                sim = np.empty(len(q))
                for s in range(0, len(q), 50_000):
                    part = slice(s, s + 50_000)
                    sim[part] = np.einsum("ij,ij->i", unit[q[part]], x[row[part]])
                sim = np.minimum(1.0, np.round(sim, 12))
                other = ids[q] != own[row]
                q, row, sim = q[other], row[other], sim[other]
                keep = _best(q, own[row], sim, k)
                yield pd.DataFrame({"id_a": ids[q[keep]], "id_b": own[row[keep]], "similarity": sim[keep]})

        return base.mapInPandas(look, schema)

    return ranked(reduce(DataFrame.unionByName, [search(b) for b in blocks]))
