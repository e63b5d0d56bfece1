"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

A node of the tree has up to ``FAN`` split points; a row goes below the nearest of them. For every pair of split points (i, j) the node
keeps the range of distances from point i to all rows below point j. A window of scores around an anchor is an annulus
[inner, outer] of distances; subtree j can hold rows of it only if, for every i, its range meets
``[max(0, d_i - outer, inner - d_i), d_i + outer]``. Bounds are handed down, so a leaf knows how near and how far its rows can be. Leaves are
compared exactly. (Scores are turned into distances as ``cells`` describes.)

The tree is grown on a sample of about ``SAMPLE`` rows until a leaf stands for ``LEAF`` rows of the table or has too few rows of
the sample, at most ``DEEP`` nodes down; all rows are put into it, and its ranges are taken over all of them. Answers are exact whatever the tree is.

First an anchor's positives are searched among its own label, the window being all scores; then, for every different score of
a positive, the negatives among other labels, within 30 to 90 % of that score.

Defined results: rows with a null label, vectors that are null, empty, of another length than most, or that hold null or non-finite
components take no part, nor do those of an integer length of 2^31 and more, or rows without an id. Rows are told apart by
their id: rows under the anchor's id are not its positives; a repeated row is one; different vectors or labels under one id
are an anchor each. A positive of a negative score has no negatives, as its window is empty. Equal scores go to
the smaller id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import cells
from newsloom.llm.cells import Space

FAN, LEAF, LEAST, DEEP = 8, 1024, 16, 24


class Tree:
    """Nodes in the order parents first; ``child`` holds nodes, or leaves as -1 - leaf. Leaves below a node are numbered in a row."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves: list[list[tuple[int, int]]] = []
        self.cells = 0
        self.root = self._grow(points, leaf, DEEP)
        #: Range of (i, j) in node k: ``first[k] + i * size + j``.
        self.first = np.cumsum([0] + [len(p) ** 2 for p in self.points])
        self.lo, self.hi = np.full(self.first[-1], np.inf), np.full(self.first[-1], -np.inf)

    def _grow(self, points: np.ndarray, leaf: int, deep: int) -> int:
        split = split_points(points) if len(points) > leaf and deep else points[:0]
        if len(split) < 2:
            self.cells += 1
            return -self.cells
        below = cells.distances(points, split).argmin(axis=1)
        node = len(self.points)
        self.points.append(split)
        self.child.append([])
        self.leaves.append([])
        for j in range(len(split)):
            begin = self.cells
            self.child[node].append(self._grow(points[below == j], leaf, deep - 1))
            self.leaves[node].append((begin, self.cells))
        return node

    def place(self, space: Space, v: np.ndarray) -> np.ndarray:
        x = space.lifted(v)
        cell = np.zeros(len(x), np.int64)
        open_ = [(self.root, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                cell[rows] = -1 - node
            elif len(rows):
                below = cells.distances(x[rows], self.points[node]).argmin(axis=1)
                open_ += [(c, rows[below == j]) for j, c in enumerate(self.child[node])]
        return cell

    def spread(self, space: Space, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(cell, kind="stable")
        x, cell = space.lifted(v[order]), cell[order]
        bound, lo, hi = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for node, points in enumerate(self.points):
            for j, leaves in enumerate(self.leaves[node]):
                begin, end = np.searchsorted(cell, leaves)
                if begin < end:
                    d = cells.distances(points, x[begin:end])
                    bound.append(self.first[node] + np.arange(len(points)) * len(points) + j)
                    lo.append(d.min(axis=1))
                    hi.append(d.max(axis=1))
        return np.concatenate(bound), np.concatenate(lo), np.concatenate(hi)

    def reach(self, space: Space, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        far2, slack = space.far(v), space.slack(v)
        inner = np.sqrt(np.maximum(0, far2 - 2.0 * high)) - slack
        outer = np.sqrt(np.maximum(0, far2 - 2.0 * low)) + slack
        near = {self.root: np.zeros(len(v))}
        most = np.full((len(v), self.cells), -np.inf)
        for node, points in enumerate(self.points):
            n = len(points)
            lo, hi = (a[self.first[node] : self.first[node + 1]].reshape(n, n) for a in (self.lo, self.hi))
            d = np.sqrt(np.maximum(0, far2[:, None] - 2 * (v.astype(np.float64) @ points[:, :-1].T)))[:, :, None]
            gap = np.maximum(lo - d, d - hi).max(axis=1)
            # The range of point i and the annulus as seen from it have to meet, for every i.
            meet = ((lo <= d + outer[:, None, None]) & (hi >= np.maximum(d - outer[:, None, None], inner[:, None, None] - d))).all(axis=1)
            for j, c in enumerate(self.child[node]):
                near[c] = np.where(meet[:, j], np.maximum(near[node], gap[:, j]), np.inf)
        for c, d in near.items():
            if c < 0:
                d = np.maximum(0, d - slack)
                s = far2 - d * d
                s = s / 2 * (1 + 1e-9 * np.sign(s)) + 1
                most[:, -1 - c] = np.where(s < low, -np.inf, np.minimum(s, high))
        return most


def split_points(points: np.ndarray) -> np.ndarray:
    """Up to FAN points of the sample that lie far apart: each is, of a few drawn ones, the farthest from those before it."""
    rng = np.random.default_rng(len(points))
    drawn = points[np.sort(rng.choice(len(points), min(len(points), 3 * FAN), replace=False))]
    chosen, gap = [0], cells.distances(drawn, drawn[:1])[:, 0]
    while len(chosen) < FAN and gap.max() > 1e-3 * (1 + np.abs(drawn).max()):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, cells.distances(drawn, drawn[chosen[-1:]])[:, 0])
    return drawn[chosen]


def fit(rows: DataFrame, space: Space) -> Tree:
    points = cells.sample(rows, space)
    return Tree(points, max(LEAST, LEAF * len(points) // max(1, space.n)))


#: Least and greatest integer within 30 % and 90 % of ``score``, without a product that could pass a long.
_TENS, _ONES = "(score - pmod(score, 10)) div 10", "pmod(score, 10)"
LOW, HIGH = f"3 * ({_TENS}) + (3 * {_ONES} + 9) div 10", f"9 * ({_TENS}) + (9 * {_ONES}) div 10"


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, vec_id: str = "vec_id", vec: str = "embedding",
         label: Column | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: anchors are the rows whose id is divisible by ``every``."""
    rows, dims = cells.integers(vectors, vec_id, vec, F.col("label") if label is None else label)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cand, space = cells.packed_rows(rows, dims, max(n_positives + 1, n_negatives))
    tree = fit(cand, space)
    placed = cells.placed(cand, space, tree)
    keep = ["u", "g", "low", "high"]

    anchors = rows.filter(F.col("i") % every == 0).select("i", "g", "v").distinct()
    units = cells.numbered(anchors.select("g", "v"))
    asks = units.select("u", "g", F.lit(cells.LOWEST).alias("low"), F.lit(cells.HIGHEST).alias("high"), "v")
    asks = cells.cut_lineage(cells.pack(asks, space, keep, cells.ASKS))
    near = cells.lists(cells.highest(placed, asks, space, tree, n_positives + 1, "same"))
    found = cells.per_row(cells.per_row(anchors, units, ["g", "v"]).select("i", "u"), near, ["u"])
    others = F.slice(F.filter("all", lambda x: x["i"] != F.col("i")), 1, n_positives)
    pairs = found.select(F.col("i").alias("anchor_id"), "u", F.explode(others).alias("p"))
    pairs = cells.cut_lineage(pairs.select("anchor_id", "u", F.col("p.i").alias("positive_id"), F.col("p.s").alias("score")))

    # Positives of one score open one window: it is searched once.
    windows = pairs.select("u", "score").withColumn("low", F.expr(LOW)).withColumn("high", F.expr(HIGH)).filter("low <= high")
    windows = cells.numbered(windows.withColumnRenamed("u", "anchor"))
    asked = windows.select("u", "anchor", "low", "high").join(asks.select(F.col("u").alias("anchor"), "g", "v"), "anchor").select("u", "g", "low", "high", "v")
    far = cells.lists(cells.highest(placed, cells.cut_lineage(asked), space, tree, n_negatives, "other"))
    found = cells.per_row(pairs.withColumnRenamed("u", "anchor"), windows.select("anchor", "score", "u"), ["anchor", "score"])
    found = cells.per_row(found, far, ["u"]).select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode("all").alias("at", "x"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("negative_id"), "positive_score",
                        F.col("x.s").alias("negative_score"))
