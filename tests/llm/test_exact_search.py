"""The two exact indexes against brute force: whatever the data, the cells, parts, lots and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import cells, gnat_negatives, pivot_distance

SCHEMA = "vec_id long, label int, embedding array<float>"


def ints(x):
    return [int(np.floor(256.0 * float(np.float32(c)))) for c in x]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, every, k):
    v = {i: ints(x) for i, _, x in rows}
    return sorted((q, r, i, s) for q in v if q % every == 0
                  for r, (s, i) in enumerate(sorted(((dot(v[q], x), i) for i, x in v.items() if i != q), key=lambda p: (-p[0], p[1]))[:k], 1))


def brute_negatives(rows, every):
    v, label = {i: ints(x) for i, _, x in rows}, {i: g for i, g, _ in rows}
    out = []
    for a in v:
        if a % every == 0:
            scored = sorted(((-dot(v[a], x), i) for i, x in v.items()))
            for ps, p in [(-s, i) for s, i in scored if i != a and label[i] == label[a]][:5]:
                found = [(-s, i) for s, i in scored if label[i] != label[a] and 30 * ps <= -100 * s <= 90 * ps][:10]
                out += [(a, p, r, i, ps, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def clustered(n, dims, seed, norms=True):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims)) * 3
    x = centres[rng.integers(0, 8, n)] + 0.2 * rng.standard_normal((n, dims))
    if norms:
        x *= rng.choice([0.1, 1, 1, 10], n)[:, None]
    x[n // 2 : n // 2 + n // 8] = x[0]  # a hot vector
    x[3] = 0
    return [(k, int(rng.integers(0, 4)), [float(c) for c in np.float32(x[k])]) for k in range(n)]


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[{}, {"PART": 7, "LOT": 3, "FIRST": 1, "GROW": 2}])
def sizes(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(cells, name, value)
    if request.param:
        monkeypatch.setattr(pivot_distance, "RING", 5)
        monkeypatch.setattr(gnat_negatives, "LEAF", 10)
        monkeypatch.setattr(gnat_negatives, "LEAST", 2)


def test_top_k_is_exact(spark, sizes):
    rows = clustered(240, 6, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pivot_distance.search(df, every=5, k=4)) == brute_top(rows, 5, 4)


def test_negatives_are_exact(spark, sizes):
    rows = clustered(160, 5, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_negatives(rows, 8)
    assert len(want) > 100 and got(gnat_negatives.mine(df, every=8)) == want


def test_products_past_a_double(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, [float(c) for c in np.float32(rng.uniform(-6e5, 6e5, 3))]) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert max(abs(s) for *_, s in brute_top(rows, 4, 3)) > 1 << 53
    assert got(pivot_distance.search(df, every=4, k=3)) == brute_top(rows, 4, 3)
    assert got(gnat_negatives.mine(df, every=4)) == brute_negatives(rows, 4)


@pytest.mark.parametrize("make", [lambda s, x: pivot_distance.Annuli(pivot_distance.choose_pivots(x, 12)), lambda s, x: gnat_negatives.Tree(x, 20)])
@pytest.mark.parametrize("norms", [False, True])
def test_bounds_hold_and_leave_cells_out(make, norms):
    v = np.array([ints(x) for *_, x in clustered(600, 6, 3, norms)])
    space = cells.Space(len(v), 6, "<i8", int((v * v).sum(axis=1).max()))
    index = make(space, space.lifted(v))
    if isinstance(index, pivot_distance.Annuli):
        at, d = index.nearest(space, v)
        for p in set(at):
            index.edges[p] = np.quantile(d[at == p], [0.25, 0.5, 0.75])
    cell = index.place(space, v)
    bound, lo, hi = index.spread(space, v, cell)
    index.lo[bound], index.hi[bound] = lo, hi
    q = v[::10]
    s = space.scores(q, v)
    low, high = np.full(len(q), cells.LOWEST), np.full(len(q), cells.HIGHEST)
    reach = index.reach(space, q, low, high)
    for c in range(index.cells):
        if (cell == c).any():
            assert (s[:, cell == c].max(axis=1) <= reach[:, c]).all()
        else:
            assert np.isinf(reach[:, c]).all()
    tenth = np.sort(s, axis=1)[:, -10]
    skipped = (reach < tenth[:, None]).mean()
    assert norms or skipped > 0.5
    # A window leaves out whatever lies wholly below or above it.
    low, high = tenth // 2, tenth * 9 // 10
    inside = index.reach(space, q, low, high)
    for n in range(len(q)):
        assert set(cell[(s[n] >= low[n]) & (s[n] <= high[n])]) <= set(np.flatnonzero(np.isfinite(inside[n])))
    assert norms or np.isinf(inside).mean() > 0.3


def test_a_tree_of_hopelessly_uneven_rows_stays_shallow():
    x = np.column_stack([2.0 ** np.arange(0, 200) / 2.0**100, np.zeros(200)])
    tree = gnat_negatives.Tree(np.repeat(x, 8, axis=0), 16)
    assert tree.cells <= 1600


def test_windows_without_overflow(spark):
    scores = [-21, -10, -1, 0, 1, 7, 10, 99, 1234567, (1 << 62) - 3]
    found = spark.createDataFrame([(s,) for s in scores], "score long").select(F.expr(gnat_negatives.LOW), F.expr(gnat_negatives.HIGH)).collect()
    assert [tuple(r) for r in found] == [(-(-3 * s // 10), 9 * s // 10) for s in scores]


@pytest.mark.parametrize("run", [lambda df: pivot_distance.search(df, every=2), lambda df: gnat_negatives.mine(df, every=2)])
def test_odd_vectors(spark, run):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 1, [0.0, 0.0]), (4, None, [1.5, 2.0]), (5, 2, None), (6, 2, []), (7, 2, [1.0]),
            (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (None, 1, [1.0, 1.0]), (11, 2, [0.6, 0.9]), (12, 2, [3e38, 1.0]), (13, 3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("i", "g", "u", "v", "s", "cell", "part", "lot", "rank", "score", "all", "low", "high"):
        df = df.withColumn(c, F.lit("mine"))
    clean = [r for r in rows if r[0] in (0, 2, 3, 4, 11, 13)]
    if "rank" in (names := run(df).columns) and "anchor_id" in names:
        assert got(run(df)) == brute_negatives([r for r in clean if r[1] is not None], 2)
    else:
        assert got(run(df)) == brute_top(clean, 2, 5)
    assert run(df.limit(0)).collect() == [] and run(df.filter("vec_id = 5")).collect() == []
