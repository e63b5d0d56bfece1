"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it. A pivot's rows, sorted by distance, are ``RINGS`` annuli of
about equally many rows. A query at distance d from a pivot has no row of the annulus [lo, hi] nearer than
``max(0, d - hi, lo - d)``; it visits annuli by that bound, of all pivots at once, in growing steps, and stops when the bound of
the next one says that it cannot reach the k-th score. (Scores are turned into distances as ``cells`` describes.)

Pivots come from a sample of at most about ``SAMPLE`` rows, one per ``RINGS * RING`` rows of the table, ``PIVOTS`` at most. All
rows are indexed, and answers are exact whatever the pivots are.

Defined results: vectors that are null, empty, of another length than most, or that hold null or non-finite components take
no part, nor do those of an integer length of 2^31 and more, or rows without an id; zero vectors do. Rows are told apart by their
id: rows under the query's id are never its candidates, a repeated row is one, different vectors under one id are a query
each. Fewer than k candidates are all returned. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import cells
from newsloom.llm.cells import Space

PIVOTS, RINGS, RING = 512, 4, 1024


class Annuli:
    def __init__(self, pivots: np.ndarray, edges: np.ndarray | None = None):
        self.pivots = pivots
        self.edges = np.full((len(pivots), RINGS - 1), np.inf) if edges is None else edges
        self.cells = len(pivots) * RINGS
        self.lo, self.hi = np.full(self.cells, np.inf), np.full(self.cells, -np.inf)

    def nearest(self, space: Space, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = cells.distances(space.lifted(v), self.pivots)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(d)), at]

    def place(self, space: Space, v: np.ndarray) -> np.ndarray:
        at, d = self.nearest(space, v)
        return at * RINGS + (d[:, None] > self.edges[at]).sum(axis=1)

    def spread(self, space: Space, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.sqrt(((space.lifted(v) - self.pivots[cell // RINGS]) ** 2).sum(axis=1))
        order = np.argsort(cell, kind="stable")
        bound, first = np.unique(cell[order], return_index=True)
        return bound, np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first)

    def reach(self, space: Space, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        far = space.far(v)[:, None]
        d = np.repeat(np.sqrt(np.maximum(0, far - 2 * (v.astype(np.float64) @ self.pivots[:, :-1].T))), RINGS, axis=1)
        near = np.maximum(0, np.maximum(d - self.hi, self.lo - d) - space.slack(v)[:, None])
        most = (far - near * near) / 2 * (1 + 1e-9 * np.sign(far - near * near)) + 1
        return np.where(most < low[:, None], -np.inf, np.minimum(most, high[:, None]))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """n points of the sample, each drawn by its squared distance from those before it, with a fixed seed."""
    rng = np.random.default_rng(12)
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.searchsorted(np.cumsum(gap), rng.uniform(0, gap.sum()), side="right").clip(0, len(points) - 1)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def fit(rows: DataFrame, space: Space) -> Annuli:
    """Pivots from the sample, edges of the annuli from all rows: what is collected are RINGS - 1 numbers per pivot."""
    index = Annuli(choose_pivots(cells.sample(rows, space), min(PIVOTS, max(1, math.ceil(space.n / (RINGS * RING))))))

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                at, d = index.nearest(space, space.matrix(batch["v"]))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(d)], names=["pivot", "d"])

    shares = [k / RINGS for k in range(1, RINGS)]
    for p, edges in rows.mapInArrow(keyed, "pivot int, d double").groupBy("pivot").agg(F.percentile_approx("d", shares, 1000)).collect():
        index.edges[p] = edges
    return index


def search(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: queries are the rows whose id is divisible by ``every``."""
    rows, dims = cells.integers(vectors, vec_id, vec)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cand, space = cells.packed_rows(rows, dims, k + 1)
    index = fit(cand, space)
    asks = rows.filter(F.col("i") % every == 0).select("i", "v").distinct()
    units = cells.numbered(asks.select("v"))
    questions = cells.pack(units.select("u", F.lit(0).cast("long").alias("g"), F.lit(cells.LOWEST).alias("low"), F.lit(cells.HIGHEST).alias("high"), "v"),
                           space, ["u", "g", "low", "high"], cells.ASKS)
    best = cells.highest(cells.placed(cand, space, index), cells.cut_lineage(questions), space, index, k + 1)
    found = cells.per_row(cells.per_row(asks, units, ["v"]).select("i", "u"), cells.lists(best), ["u"])
    others = F.slice(F.filter("all", lambda x: x["i"] != F.col("i")), 1, k)
    ranked = found.select(F.col("i").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.s").alias("score"))
