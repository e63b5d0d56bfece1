"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to ``floor((A x + b) / w)`` for M Gaussian directions. A query visits, in each
table, its own bucket and then buckets whose slots differ by one in some directions, in the order of estimated success: the
sum of squared distances from the query's projections to the borders crossed, least first, made by a heap that shifts and
expands sets of crossings. Every bucket is met by the queries that visit it as one matrix product; a query keeps its k
best there, the tables' candidates are merged, and the k best by exact double-precision distance are the answer.

Fitting: w comes from the spread of projections, M from the number of rows (about ``BUCKET`` rows a bucket), and the
number of probes from a bounded sample of at most ``SAMPLE`` rows and ``ASKED`` queries: it is the least number that finds
``TARGET`` of the sample's true neighbours. Where ``MOST_PROBES`` buckets do not find them, M is lowered, so that a bucket holds
more rows, until they do or all 3^M buckets are visited; what is missed even then is left to the second step.
In the whole table neighbours are nearer than in the sample, so recall is not less.

Second step: a query that met fewer than k candidates, or whose visits would miss a neighbour at the distance of its k-th with
a chance above 1 - ``SURE`` (worked out from its own place in its slots), is compared with all candidates, exactly, in tiles.
So rows much longer than most, whose neighbours lie many slots away, and outliers get their k neighbours too.

Skew: of equal vectors only the k + 1 with the least ids are candidates, for the others can never be among k nearest; equal query
vectors are searched once. A bucket of more than ``CHUNK`` rows is dealt to several tasks.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
numbers take no part, as queries or candidates; fewer than k candidates are all returned; a row without
an id takes no part; a repeated row is one candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm.common import stable_sample
from newsloom.session import cut_lineage

TABLES, WIDTH, BUCKET, CHUNK, SAMPLE, ASKED, TARGET = 4, 2.0, 512, 8192, 10_000, 100, 0.97
MOST_PROBES = 2000
#: Least chance of a query to meet a row at its k-th distance, and rows of a tile of the exact scan.
SURE, TILE = 0.9, 2048
_erf = np.vectorize(math.erf, otypes=[float])


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def probes(x: np.ndarray, most: int):
    """Yields sets of crossings ``[(direction, -1 or 1)]`` by rising score, the empty set first.

    ``x[m]`` is the distance, in slots, from the projection to the lower border of its slot.
    """
    yield []
    cost = sorted([(float(d * d), m, -1) for m, d in enumerate(x)] + [(float((1 - d) ** 2), m, 1) for m, d in enumerate(x)])
    heap = [(cost[0][0], (0,))]
    given = 1
    while heap and given < most:
        score, at = heapq.heappop(heap)
        last = at[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (score - cost[last][0] + cost[last + 1][0], (*at[:-1], last + 1)))
            if len(at) < len(x):
                heapq.heappush(heap, (score + cost[last + 1][0], (*at, last + 1)))
        if len({cost[k][1] for k in at}) == len(at):  # a direction cannot be crossed both ways
            given += 1
            yield [(cost[k][1], cost[k][2]) for k in at]


@dataclass
class Index:
    a: np.ndarray  # tables x directions x dimensions, already divided by w
    b: np.ndarray  # tables x directions
    n_probes: int = 1

    def project(self, v: np.ndarray) -> np.ndarray:
        """rows x tables x directions, in slots."""
        return np.einsum("nd,tmd->ntm", v, self.a) + self.b

    @staticmethod
    def keys(slots: np.ndarray) -> np.ndarray:
        """One long per bucket, from its slots."""
        h = np.full(slots.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        for m in range(slots.shape[-1]):
            h = (h ^ slots[..., m].astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        return h.view(np.int64)

    def visits(self, v: np.ndarray):
        """``(row, table, keys)`` of the buckets that each query visits, in order."""
        p = self.project(v)
        home = np.floor(p)
        for n in range(len(v)):
            for t in range(len(self.a)):
                sets = list(probes(p[n, t] - home[n, t], self.n_probes))
                slots = np.repeat(home[n, t][None], len(sets), axis=0)
                for k, crossed in enumerate(sets):
                    for m, way in crossed:
                        slots[k, m] += way
                yield n, t, self.keys(slots)

    def chance(self, v: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Per row, how likely its visits meet another row at distance ``far``, in whatever direction that lies."""
        p = self.project(v)
        x = p - np.floor(p)
        s = np.maximum(far[:, None, None] * np.sqrt((self.a**2).mean(axis=2)), 1e-12)
        below = [(1 + _erf((edge - x) / (s * math.sqrt(2)))) / 2 for edge in (-1, 0, 1, 2)]
        down, stay, up = (b - a for a, b in zip(below, below[1:], strict=False))
        missed = np.ones(len(v))
        for n in range(len(v)):
            for t in range(len(self.a)):
                if self.n_probes >= 3 ** x.shape[2]:
                    met = float(np.prod(down[n, t] + stay[n, t] + up[n, t]))
                else:
                    met = 0.0
                    for crossed in probes(x[n, t], self.n_probes):
                        each = stay[n, t].copy()
                        for m, way in crossed:
                            each[m] = (down if way < 0 else up)[n, t, m]
                        met += float(np.prod(each))
                missed[n] *= 1 - min(1.0, met)
        return 1 - missed


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def nearest_in(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """``(query row, ids, exact distances)`` of the k nearest per query; the product only picks who is measured exactly."""
    size = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None]
    rough, error = size - 2 * (q @ x.T), 1e-15 * (8 + q.shape[1]) * size
    for n in range(len(q)):
        at = np.arange(len(x))
        if len(x) > k:
            cut = np.partition(rough[n] + error[n], k - 1)[k - 1]
            at = np.flatnonzero(rough[n] - error[n] <= cut)
        d = distances(q[n], x[at])
        best = np.lexsort((ids[at], d))[:k]
        yield n, ids[at][best], d[best]


def fit(rows: DataFrame, n: int, dims: int, k: int, seed: int = 3) -> Index:
    """An index for ``n`` rows ``(i, v)``, from a sample of bounded size."""
    got = stable_sample(rows, F.col("i"), SAMPLE, n, 41).collect()
    got.sort(key=lambda r: r["i"])
    v = np.array([r["v"] for r in got], np.float64)
    most = max(1, min(24, int(math.log(max(1.0, n / BUCKET), 3))))
    for m in range(most, 0, -1):
        index, share = _fit(v, m, dims, k, seed)
        if share >= TARGET or 3**m <= MOST_PROBES:
            return index


def _fit(v: np.ndarray, m: int, dims: int, k: int, seed: int) -> tuple[Index, float]:
    """An index of ``m`` directions a table, and the share of the sample's true neighbours that it finds."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((TABLES, m, dims))
    spread = float(np.std(np.einsum("nd,tmd->ntm", v, a))) or 1.0
    index = Index(a / (WIDTH * spread), rng.uniform(0, 1, (TABLES, m)))
    index.n_probes = most = min(MOST_PROBES, 3**m)
    home = index.keys(np.floor(index.project(v)))
    asked = np.linspace(0, len(v) - 1, min(len(v), ASKED)).astype(int)
    ids = np.arange(len(v))
    true = {q: [int(x) for x in near if x != asked[q]][:k] for q, near, _ in nearest_in(v[asked], v, ids, k + 1)}
    ranks = {q: np.full(len(near), index.n_probes, np.int64) for q, near in true.items()}
    for q, t, keys in index.visits(v[asked]):
        place = {key: r for r, key in reversed(list(enumerate(keys.tolist())))}
        ranks[q] = np.minimum(ranks[q], [place.get(int(home[x, t]), index.n_probes) for x in true[q]])
    found = np.sort(np.concatenate([*ranks.values(), np.zeros(0, np.int64)]))
    if len(found):
        index.n_probes = int(min(most, found[min(len(found) - 1, math.ceil(TARGET * len(found)) - 1)] + 1))
    return index, float(np.mean(found < most)) if len(found) else 1.0


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest per query vector, which may itself be one."""
    best = W.partitionBy("k1", "k2").orderBy("score", "i")
    once = found.groupBy("k1", "k2", "i").agg(F.min("score").alias("score"))
    return once.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")


def doubtful(index: Index, cand: DataFrame, once: DataFrame, merged: DataFrame, k: int) -> DataFrame:
    """``(k1, k2, v)``: query vectors that met too few candidates, or whose visits are not likely to have met the k nearest."""
    need = min(k + 1, cand.select("i").distinct().count())
    met = merged.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("score").alias("far"))

    def unsure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                again = part["n"].to_numpy(zero_copy_only=False) < need
                rest = np.flatnonzero(~again)
                v = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                again[rest] = index.chance(v[rest], part["far"].to_numpy(zero_copy_only=False)[rest]) < SURE
                yield part.filter(pa.array(again)).select(["k1", "k2", "v"])

    rows = once.select("k1", "k2", "v").join(met, ["k1", "k2"], "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("far", F.coalesce("far", F.lit(0.0)))
    return rows.mapInArrow(unsure, "k1 long, k2 long, v array<double>")


def _scan_doubtful(index: Index, cand: DataFrame, once: DataFrame, merged: DataFrame, meet, k: int) -> DataFrame:
    """``merged`` with the answers of doubtful queries taken from all candidates, in tiles of bounded size."""
    again = cut_lineage(doubtful(index, cand, once, merged, k))
    asked = again.count()
    if not asked:
        return merged
    parts, lots = max(16, math.ceil(cand.count() / TILE)), math.ceil(asked / TILE)
    rows = cand.select("i", "v", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(parts)).cast("int").alias("part"),
                       F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    asks = again.select("k1", "k2", "v", F.pmod(F.xxhash64("k1", F.lit(5)), F.lit(lots)).cast("int").alias("lot"),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    by = ["part", "lot"]
    exact = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(meet, "k1 long, k2 long, i long, score double")
    return cut_lineage(merged.join(again.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(_best(exact, k)))


def search(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v")).filter(
        F.col("i").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dims = sizes[0][0]
    rows = rows.filter(F.size("v") == dims).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1)))
    same = W.partitionBy("k1", "k2").orderBy("i")
    cand = cut_lineage(rows.dropDuplicates(["i", "k1", "k2"]).withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1))
    index = fit(cand.filter("copy = 1").select("i", "v"), cand.filter("copy = 1").count(), dims, k)
    asks = rows.filter(F.col("i") % every == 0)
    once = asks.groupBy("k1", "k2").agg(F.first("v").alias("v"))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def placed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = index.keys(np.floor(index.project(matrix(part["v"]))))
                for t in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), part["i"], part["v"]],
                                                     names=["t", "key", "i", "v"])

    def visiting(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                for n, t, keys in index.visits(matrix(part["v"])):
                    times = pa.array(np.full(len(keys), n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), *[part[c].take(times) for c in ("k1", "k2", "v")]],
                                                     names=["t", "key", "k1", "k2", "v"])

    hashed = cand.select("i", "v").mapInArrow(placed, "t int, key long, i long, v array<double>")
    visits = once.select("k1", "k2", "v").mapInArrow(visiting, "t int, key long, k1 long, k2 long, v array<double>")
    crowded = hashed.groupBy("t", "key").count().filter(F.col("count") > CHUNK).select("t", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    crowded = cut_lineage(crowded)
    hashed = hashed.join(crowded, ["t", "key"], "left").withColumn("part", F.pmod(F.xxhash64("i"), F.coalesce("parts", F.lit(1)))).drop("parts")
    visits = visits.join(crowded, ["t", "key"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty or q.empty:
            return pd.DataFrame({"k1": [], "k2": [], "i": [], "score": []})
        v, ids = np.stack(x["v"].to_numpy()), x["i"].to_numpy()
        k1, k2 = q["k1"].to_numpy(), q["k2"].to_numpy()
        out = []
        for at in range(0, len(q), 256):
            block = np.stack(q["v"].iloc[at : at + 256].to_numpy())
            out += [(k1[at + n], k2[at + n], near, d) for n, near, d in nearest_in(block, v, ids, k + 1)]
        times = [len(d) for *_, d in out]
        return pd.DataFrame({"k1": np.repeat([o[0] for o in out], times), "k2": np.repeat([o[1] for o in out], times),
                             "i": np.concatenate([o[2] for o in out]), "score": np.concatenate([o[3] for o in out])})

    by = ["t", "key", "part"]
    found = hashed.groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(meet, "k1 long, k2 long, i long, score double")
    merged = cut_lineage(_best(found, k))
    merged = _scan_doubtful(index, cand, once, merged, meet, k)
    answers = asks.select(F.col("i").alias("query_id"), "k1", "k2").distinct().join(merged, ["k1", "k2"]).filter(F.col("query_id") != F.col("i"))
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "i"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("i").alias("vec_id"), "score")
