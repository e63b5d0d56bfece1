"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are runs of letters and digits in lower case, shingles are five words in a row (all words of a shorter text). Equal
texts are one node. The forest has ``TREES`` tries; in each a node's label is ``DEPTH`` MinHash values, and nodes whose labels begin
alike stand below one trie node, a run of the labels' order, which a grouping by prefix finds.

Prefixes start at full length and are shortened, one tree after the other and round after round (``depths``), until two demands are
met: two texts at the least similarity meet in some tree with probability ``RECALL`` by formula, and of pairs drawn
independently of the forest that share ``RECALL`` do meet. These pairs are all partners of about ``DRAWN`` texts, chosen by a hash and
compared exactly with every text in the pass that makes the signatures; a pair says at which step of the shortening it is first met.

A trie node's members are linked to its least member only. Trees are linked in growing groups (``GROUPS``); after each, linked
nodes are one, so that later trees bring only links between what is still apart. The components of these
links hold every pair that met. All texts of a component are compared exactly, on their shingle sets: small components are
packed together, large ones cut into tiles of which each pair is one task, and what leaves a task is one row per text (its
number of links, the least text it is connected with), never the pairs. Work in a component grows with the square of its
different texts, as an exact count of links must; copies cost nothing. Shingles are made and shuffled for texts that have met another
only: a bit table of bounded size tells the rest apart before the shuffle.

Defined results: null text is empty; texts without a word are linked with equal texts only; a null id is never a class's id,
and rows that have no id but equal text share a null class; an id that stands for several texts gives a row for each;
repeated rows are copies; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bits import Bits
from newsloom.llm.common import components, per_batch, salted_join, stable_sample
from newsloom.session import cut_lineage

WORDS, LEAST, TREES, DEPTH, RECALL, DRAWN = 5, 0.8, 32, 8, 0.999, 64
#: Trees are linked in these groups, with contraction after each.
GROUPS = ((0, 2), (2, 8), (8, 32))
#: Texts and shingles of a tile, and shingles of one pack of small components.
TILE, TILE_SHINGLES = 512, 1_000_000
WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20)
ODD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
MIX = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingles of a text, ascending."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = min(WORDS, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ (h[k : len(h) - n + 1 + k] * MIX[k])) * np.uint64(0xFF51AFD7ED558CCD)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    """``TREES * DEPTH`` MinHash values, 16 bits each; longer sets are reduced in blocks."""
    if not len(s):
        return b""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, ((x[None, at : at + 2048] ^ XOR[:, None]) * ODD[:, None]).min(axis=1))
    # The least values are small, their upper bits alike: the lower half tells them apart.
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def depths(step: int) -> list[int]:
    """Length of the prefixes of each tree after so many steps: a step takes one value off one tree, in turn."""
    return [max(1, DEPTH - step // TREES - (t < step % TREES)) for t in range(TREES)]


def chance(similarity: float, step: int) -> float:
    """Of two texts to share a prefix in one tree or more."""
    return 1 - math.prod(1 - similarity**d for d in depths(step))


def formula_step(least: float = LEAST, recall: float = RECALL) -> int:
    return next(k for k in range(TREES * DEPTH) if chance(least, k) >= recall or k == TREES * (DEPTH - 1))


def first_met(a: np.ndarray, b: np.ndarray) -> int:
    """The step from which two signatures share a prefix in some tree."""
    same = (a.reshape(TREES, DEPTH) == b.reshape(TREES, DEPTH)).cumprod(axis=1).sum(axis=1)
    need = np.where(same == DEPTH, 0, (DEPTH - np.maximum(same, 1) - 1) * TREES + np.arange(TREES) + 1)
    need[same == 0] = TREES * DEPTH
    return int(need.min())


def measured_step(met: dict[int, int], recall: float = RECALL) -> int:
    """The first step at which this share of the drawn pairs has met; ``met`` counts pairs by their own first step."""
    total, done = sum(met.values()), 0
    for step in sorted(met):
        done += met[step]
        if done >= recall * total:
            return min(step, TREES * (DEPTH - 1))
    return 0


class Drawn:
    """Texts whose partners are found without the forest."""

    def __init__(self, texts: list[str]):
        sets = [s for s in map(shingles, texts) if len(s)]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.sig = [np.frombuffer(signature(s), "<u2") for s in sets]
        every, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def steps(self, s: np.ndarray, sig: bytes, least: float) -> list[int]:
        """For each drawn text of similarity ``least`` or more, but other shingles: the step from which they meet."""
        first, last = np.searchsorted(self.every, s), np.searchsorted(self.every, s, side="right")
        hit = np.flatnonzero(first < last)
        if not len(hit):
            return []
        at = np.concatenate([self.owner[i:j] for i, j in zip(first[hit].tolist(), last[hit].tolist(), strict=True)])
        both = np.bincount(at, minlength=len(self.size))
        union = self.size + len(s) - both
        near = np.flatnonzero((both >= least * union - 1e-9) & (both < union))
        mine = np.frombuffer(sig, "<u2")
        return [first_met(mine, self.sig[k]) for k in near]


def _draw(docs: DataFrame, total: int) -> Drawn:
    """About ``DRAWN`` different texts, the same in every run."""
    rows = stable_sample(_keyed(docs), F.col("node"), DRAWN, total, 29)
    return Drawn([r[0] for r in rows.dropDuplicates(["node"]).orderBy("node").select("text").collect()])


def _nodes(docs: DataFrame, drawn: Drawn, least: float) -> DataFrame:
    """``(node, doc_id, copies, n, sig, steps)``: one row per different text."""

    def make():
        def work(rows: dict) -> dict:
            made = [shingles(t) for t in rows["text"]]
            sigs = [signature(s) for s in made]
            return {"doc_id": rows["doc_id"], "node": rows["node"], "n": [len(s) for s in made], "sig": sigs,
                    "steps": [drawn.steps(s, sig, least) if len(s) else [] for s, sig in zip(made, sigs, strict=True)]}

        return work

    marked = per_batch(_keyed(docs), make, "doc_id long, node binary, n long, sig binary, steps array<int>")
    return cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"),
                                                  F.first("sig").alias("sig"), F.first("steps").alias("steps")))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def drawn_pairs(nodes: DataFrame) -> dict[int, int]:
    """Drawn pairs by the step at which they are first met: at most as many numbers as there are steps."""
    return {r[0]: r[1] for r in nodes.select(F.explode("steps").alias("step")).groupBy("step").count().collect()}


def _met(rows: DataFrame, deep: list[int], trees: range) -> DataFrame:
    """``(a, b)``: roots of ``rows(node, root, sig)`` linked to the least root below the same trie node."""
    prefix = [F.xxhash64(F.lit(t), F.substring("sig", t * 2 * DEPTH + 1, 2 * deep[t])) for t in trees]
    keys = rows.select("root", F.explode(F.array(*prefix)).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("root").alias("hub"), F.max("root").alias("_last")).filter(F.col("hub") != F.col("_last")).drop("_last")
    return salted_join(keys, hubs, ["key"], F.col("root"), salts=4).filter(F.col("hub") != F.col("root")).select(
        F.col("hub").alias("a"), F.col("root").alias("b")).distinct()


def met_groups(nodes: DataFrame, deep: list[int]) -> DataFrame:
    """``(node, root)`` of all nodes that have met another, over all trees."""
    some = nodes.filter("n > 0").select("node", "sig")
    moved = None
    for first, last in GROUPS:
        rows = some.withColumn("root", F.col("node")) if moved is None else some.join(moved, "node", "left").withColumn("root", F.coalesce("root", "node"))
        edges = cut_lineage(_met(rows, deep, range(first, last)))
        if edges.isEmpty():
            continue
        joined = components(edges, "a", "b").withColumnRenamed("root", "_to").withColumnRenamed("id", "root")
        rows = salted_join(rows.select("node", "root"), joined, ["root"], F.col("node"), "left").select("node", F.coalesce("_to", "root").alias("root"))
        moved = cut_lineage(rows.filter(F.col("node") != F.col("root")))
    if moved is None:
        return some.select("node", F.col("node").alias("root")).limit(0)
    return moved.unionByName(moved.select(F.col("root").alias("node"), "root").distinct())


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections among sets, as products of incidence matrices over the shingles that two or more share."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    owner, which = owner[shared], np.unique(which[shared], return_inverse=True)[1]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    edges = np.searchsorted(which, np.arange(0, (which[-1] if len(which) else -1) + 1 + width, width))
    for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], which[i:j] - k * width] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _links(sets: list[np.ndarray], side: np.ndarray, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of links, and the first text it is connected with."""
    size = np.array([len(s) for s in sets])
    both = _common(sets)
    union = size[:, None] + size[None] - both
    yes = both >= least * union - 1e-9
    np.fill_diagonal(yes, False)
    if cross:
        yes &= side[:, None] != side[None]
    root = np.arange(len(sets))
    while True:  # labels fall along links, and along their own labels, until they rest
        low = np.where(yes, root[None], len(sets)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return yes.sum(axis=1), root
        root = new


def _shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, sh)``: the shingles of the members' texts, made before anything is shuffled, once per task and text."""
    known = docs.sparkSession.sparkContext.broadcast(Bits(members.select(F.xxhash64("node").alias("fp"))))

    def make():
        def work(rows: dict) -> dict:
            hit = np.flatnonzero(known.value.holds(np.array(rows["fp"], np.int64).view(np.uint64))).tolist()
            return {"node": [rows["node"][k] for k in hit], "sh": [shingles(rows["text"][k]).tobytes() for k in hit]}

        return work

    rows = _keyed(docs).select("node", "text", F.xxhash64("node").alias("fp"))
    return per_batch(rows, make, "node binary, sh binary").groupBy("node").agg(F.first("sh").alias("sh"))


def _verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """``(node, links, root, split)`` per text and task in which it has links."""
    members = cut_lineage(nodes.select("node", "n").join(groups, "node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("sum_n"))
    tiles = F.ceil(F.greatest(F.col("m") / TILE, F.col("sum_n") / TILE_SHINGLES)).cast("int")
    sizes = cut_lineage(sizes.withColumn("tiles", tiles))
    packs = max(1, math.ceil((sizes.agg(F.sum("sum_n")).first()[0] or 0) / TILE_SHINGLES))
    members = salted_join(members, sizes.select("root", "tiles"), ["root"], F.col("node"))
    sets = _shingled(docs, members).join(members.select("node", "root", "tiles"), "node")
    tile = F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(
        F.least(k, F.col("tile")).alias("lo"), F.greatest(k, F.col("tile")).alias("hi"))))
    spread = sets.withColumn("tile", tile).withColumn("meet", meet)
    alone = F.col("tiles") == 1
    spread = spread.select("node", "sh", "root", "tile", (~alone).alias("split"), F.col("meet.lo").alias("lo"), F.col("meet.hi").alias("hi"),
                           F.when(alone, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.xxhash64("root", "meet.lo", "meet.hi")).alias("task"))

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [], "links": [], "root": [], "split": []}
        for (_, lo, hi), part in task.groupby(["root", "lo", "hi"], sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("node")
            node, split = part["node"].tolist(), bool(part["split"].iat[0])
            n, root = _links([np.frombuffer(s, np.uint64) for s in part["sh"]], part["tile"].to_numpy(), lo != hi, least)
            at = np.flatnonzero(n)
            out["node"] += [node[k] for k in at]
            out["links"] += n[at].tolist()
            out["root"] += [node[root[k]] for k in at]
            out["split"] += [split] * len(at)
        return pd.DataFrame(out)

    spread = spread.withColumn("task", F.struct("split", "task"))
    return spread.groupBy("task").applyInPandas(compare, "node binary, links long, root binary, split boolean")


def near_duplicates(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``(doc_id, node, class_id, n_links, copies)``: one row per document.

    ``class_id`` is the least id of all documents connected by links or equal text, ``n_links`` the number of different
    texts with similarity ``least`` or more, ``copies`` the number of rows with this very text.
    """
    return classes(docs, least, recall).drop("root")


def classes(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``near_duplicates`` and ``root``, the least node of the class: it tells classes apart where ids repeat or are null."""
    nodes = _nodes(docs, _draw(docs, docs.count()), least)
    step = max(formula_step(least, recall), measured_step(drawn_pairs(nodes), recall))
    found = cut_lineage(_verify(docs, nodes, met_groups(nodes, depths(step)), least))
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    # Only components that were cut into tiles have to be put together again.
    torn = found.filter("split")
    if torn.isEmpty():
        classed = per_node.select("node", "links", "root")
    else:
        whole = components(torn.select(F.col("node").alias("a"), F.col("root").alias("b")), "a", "b").withColumnRenamed("root", "_r")
        classed = per_node.join(whole.withColumnRenamed("id", "node"), "node", "left").select("node", "links", F.coalesce("_r", "root").alias("root"))
    few = nodes.select("node", "doc_id", "copies").join(classed, "node", "left").filter("links is not null or copies > 1")
    few = cut_lineage(few.withColumn("root", F.coalesce("root", "node")))
    first = few.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    few = salted_join(few, first, ["root"], F.col("node")).select("node", "root", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "copies")
    rows = _keyed(docs).select("doc_id", "node")
    out = salted_join(rows, few, ["node"], F.coalesce("doc_id", F.lit(0)), "left")
    return out.select("doc_id", "node", F.coalesce("root", "node").alias("root"), F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
