"""Exact search for the highest integer inner products in a table cut into cells, shared by two indexes.

An index puts every row into one of a bounded number of cells and can say, for a query, the most a cell's rows can score
(``reach``). A query visits cells by falling reach, four times as many in every round, and ends when no cell
that is left can reach its k-th score. Answers do not depend on the cells.

Inner products become distances by one more coordinate: with M the greatest length, a row x gets ``sqrt(M^2 - |x|^2)`` and a
query 0, so that ``d^2 = |q|^2 + M^2 - 2 q.x``. Bounds from the triangle inequality are loosened by more than the rounding of
distances; scores themselves are exact integers.

Work is dealt by (cell, part, lot): a cell is cut into parts of about ``PART`` rows, queries into lots of ``LOT`` with neighbours
together, so that what a task holds is bounded whatever the table's size or the crowding of a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm.common import salted_join, stable_sample, with_position
from newsloom.session import cut_lineage

PART, LOT, FIRST, GROW, SAMPLE = 8192, 8192, 4, 4, 8192
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
ROWS = "i long, g long, v binary"
ASKS = "u long, g long, low long, high long, v binary"


def integers(vectors: DataFrame, vec_id: str, vec: str, group: Column | None = None) -> tuple[DataFrame, int]:
    """``(i, g, v)`` with ``v = floor(256 * x)`` as longs, written out, and the length of the vectors.

    Left out are rows without id or group, vectors that are null, empty, of another length than most (the longer of two such) or with
    null or non-finite components, and those whose integer length is 2^31 or more: their products do not fit a long.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("i"), (F.lit(0) if group is None else group).cast("long").alias("g"),
                          F.col(vec).cast("array<double>").alias("x"))
    small = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**30))
    rows = rows.filter(F.col("i").isNotNull() & F.col("g").isNotNull() & F.coalesce((F.size("x") > 0) & small, F.lit(False)))
    rows = rows.select("i", "g", F.transform("x", lambda c: F.floor(256.0 * c)).alias("v"))
    rows = cut_lineage(rows.filter(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < 2.0**62))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = sizes[0][0] if sizes else 0
    return rows.filter(F.size("v") == dims), dims


@dataclass
class Space:
    """What all rows have in common: their number, length, storage type and greatest squared length."""

    n: int
    dims: int
    kind: str
    most: int

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.dims)

    def packed(self, column: pa.Array) -> pa.Array:
        rows = column.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(-1, self.dims)
        return pa.array([r.tobytes() for r in rows], pa.binary())

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes them equally long."""
        v = v.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1)))])

    def far(self, v: np.ndarray) -> np.ndarray:
        """``|q|^2 + M^2`` of queries."""
        v = v.astype(np.float64)
        return (v * v).sum(axis=1) + self.most

    def slack(self, v: np.ndarray) -> np.ndarray:
        return 1e-9 + 2e-6 * np.sqrt(self.far(v))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where all sums stay below 2^53, else in longs."""
        kind = np.float64 if self.most < 1 << 53 else np.int64
        return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))


class Index(Protocol):
    """``lo``, ``hi``: bounds of distances. ``place``: a cell per row. ``spread``: ``(bound, least, most)`` of the distances of rows in
    their cells. ``reach``: queries x cells, the most a row of the cell can score within the window, -inf for none."""

    cells: int
    lo: np.ndarray
    hi: np.ndarray

    def place(self, space: Space, v: np.ndarray) -> np.ndarray: ...
    def spread(self, space: Space, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...
    def reach(self, space: Space, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray: ...


def packed_rows(rows: DataFrame, dims: int, most_copies: int) -> tuple[DataFrame, Space]:
    """Candidates as ``ROWS``, written out: of rows equal in group and vector the ``most_copies`` least ids, which are all that can be an answer."""
    same = W.partitionBy("g", "v").orderBy("i")
    cand = rows.distinct().withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= most_copies).drop("copy")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    n, most, top = cand.agg(F.count("*"), F.max(square), F.max(largest)).first()
    space = Space(n, dims, "<i4" if (top or 0) < 1 << 31 else "<i8", most or 0)
    return cut_lineage(pack(cand, space, ["i", "g"], ROWS)), space


def pack(rows: DataFrame, space: Space, keep: list[str], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], space.packed(batch["v"])], names=[*keep, "v"])

    return rows.select(*keep, "v").mapInArrow(run, schema)


def sample(rows: DataFrame, space: Space) -> np.ndarray:
    """About ``SAMPLE`` lifted rows (the origin, where the hash chose none), the same in every run."""
    got = stable_sample(rows, F.col("i"), SAMPLE, space.n, 43).select("i", "v").toArrow().sort_by([("i", "ascending"), ("v", "ascending")])
    return space.lifted(space.matrix(got["v"]) if len(got) else np.zeros((1, space.dims)))


def placed(rows: DataFrame, space: Space, index: Index) -> DataFrame:
    """``ROWS`` with ``cell`` and ``part``, written out; the index gets the bounds of all its cells, a few numbers for each."""

    def run(batches):
        for batch in batches:
            cell = index.place(space, space.matrix(batch["v"])) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("i", "g", "v")], pa.array(cell.astype(np.int32))], names=["i", "g", "v", "cell"])

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                bound, lo, hi = index.spread(space, space.matrix(batch["v"]), batch["cell"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(bound.astype(np.int32)), pa.array(lo), pa.array(hi)], names=["bound", "lo", "hi"])

    rows = cut_lineage(rows.mapInArrow(run, ROWS + ", cell int"))
    # Measured in the cells where rows now are: a second search for the nearest point might break a tie the other way.
    for bound, lo, hi in rows.mapInArrow(measure, "bound int, lo double, hi double").groupBy("bound").agg(F.min("lo"), F.max("hi")).collect():
        index.lo[bound], index.hi[bound] = lo, hi
    # As many rows as the index has cells, a number bounded by its parameters.
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("i", "v", F.lit(5)), F.col("parts")).cast("int")
    return cut_lineage(rows.join(F.broadcast(parts), "cell").withColumn("part", part))


def in_lots(asks: DataFrame, space: Space, index: Index) -> DataFrame:
    """Queries with a ``lot``; queries nearest to the same cell stand together."""
    lots = math.ceil(asks.count() / LOT)
    if lots <= 1:
        return asks.withColumn("lot", F.lit(0).cast("long"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                low, high = (part[c].to_numpy() for c in ("low", "high"))
                home = index.reach(space, space.matrix(part["v"]), low, high).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32))], names=[*part.schema.names, "home"])

    homed = with_position(asks.mapInArrow(run, ASKS + ", home int"), [F.asc("home"), F.asc("u")], "at")
    return cut_lineage(homed.withColumn("lot", F.floor(F.col("at") / LOT)).drop("home", "at"))


def _choose(space: Space, index: Index, done: int, step: int):
    """The cells of this round per query: those at ``done`` and after in its order that can reach what it has."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                low, high = (part[c].to_numpy() for c in ("low", "high"))
                reach = index.reach(space, space.matrix(part["v"]), low, high)
                order = np.argsort(-reach, axis=1, kind="stable")[:, done : done + step]
                want = np.take_along_axis(reach, order, 1) >= np.maximum(low, part["least"].to_numpy())[:, None]
                row, k = np.nonzero(want)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part["u"].take(take), part["lot"].take(take), pa.array(order[row, k].astype(np.int32))], names=["u", "lot", "cell"])

    return run


def _meet(space: Space, k: int, groups: str):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asks.num_rows:
            x, ids, g = space.matrix(rows["v"]), rows["i"].to_numpy(), rows["g"].to_numpy()
            q = space.matrix(asks["v"])
            u, own, low, high = (asks[c].to_numpy() for c in ("u", "g", "low", "high"))
            low = np.maximum(low, asks["least"].to_numpy())
            for at in range(0, len(q), 256):
                cut = slice(at, at + 256)
                s = space.scores(q[cut], x)
                yes = (s >= low[cut, None]) & (s <= high[cut, None])
                if groups == "same":
                    yes &= g[None] == own[cut, None]
                elif groups == "other":
                    yes &= g[None] != own[cut, None]
                for n in np.flatnonzero(yes.any(axis=1)):
                    found = np.flatnonzero(yes[n])
                    score = s[n, found]
                    if len(found) > k:
                        found = found[score >= np.partition(score, len(score) - k)[len(score) - k]]
                        score = s[n, found]
                    best = np.lexsort((ids[found], -score))[:k]
                    out.append((np.full(len(best), u[at + n]), ids[found[best]], score[best]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 3)]
        return pa.table({"u": pa.array(cols[0], pa.int64()), "i": pa.array(cols[1], pa.int64()), "s": pa.array(cols[2], pa.int64())})

    return run


def highest(rows: DataFrame, asks: DataFrame, space: Space, index: Index, k: int, groups: str = "any") -> DataFrame:
    """``(u, i, s)``: the k highest scores of each query ``ASKS`` within its window [low, high], ties to the smaller id.

    ``rows`` come from ``placed``. ``groups``: candidates of the query's group only (``same``), of others only (``other``) or ``any``.
    """
    asks = in_lots(asks, space, index)
    order = W.partitionBy("u").orderBy(F.desc("s"), F.asc("i"))
    best, done, step = None, 0, FIRST
    by = ["cell", "part", "lot"]
    parts = rows.groupBy("cell", "part").count().select("cell", "part").toDF("cell", "part")
    while done < index.cells:
        least = F.lit(LOWEST).alias("least")
        if best is None:
            now = asks.select("*", least)
        else:
            kth = best.groupBy("u").agg(F.min("s").alias("_s"), F.count("*").alias("_n")).filter(F.col("_n") == k).select("u", "_s")
            now = asks.join(kth, "u", "left").withColumn("least", F.coalesce("_s", F.lit(LOWEST))).drop("_s")
        now = cut_lineage(now)
        visits = cut_lineage(now.mapInArrow(_choose(space, index, done, step), "u long, lot long, cell int"))
        if visits.isEmpty():
            break
        wanted = visits.groupBy("cell").agg(F.collect_set("lot").alias("lots")).join(parts, "cell")
        left = rows.join(wanted, ["cell", "part"]).select("cell", "part", F.explode("lots").alias("lot"), "i", "g", "v")
        right = visits.join(parts, "cell").join(now.drop("lot"), "u")
        found = left.groupBy(*by).cogroup(right.select(*by, "u", "g", "low", "high", "least", "v").groupBy(*by)).applyInArrow(_meet(space, k, groups), "u long, i long, s long")
        found = found if best is None else found.unionByName(best)
        best = cut_lineage(found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r"))
        done, step = done + step, step * GROW
    return best if best is not None else rows.sparkSession.createDataFrame([], "u long, i long, s long")


def numbered(rows: DataFrame) -> DataFrame:
    """Different rows with a number ``u`` each, written out, so that the numbers stay."""
    return cut_lineage(rows.distinct().withColumn("u", F.monotonically_increasing_id()))


def lists(best: DataFrame) -> DataFrame:
    """``(u, all)``: each query's answers in order, at most k structs (s, i)."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "i")))
    return best.groupBy("u").agg(F.transform(each, lambda x: F.struct((-x["s"]).alias("s"), x["i"].alias("i"))).alias("all"))


def per_row(asks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Joins rows, many of which may ask the same, with the one row of their question."""
    return salted_join(asks, units, keys, F.col(asks.columns[0]))
