"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise sum is computed in linear time as half of
``(sum v_i x_i)^2 - sum (v_i x_i)^2`` per factor. Words are hashed with their lower case form; statistics of structure
(length, repeats, symbols, capitals, lines) and the stated length are cut into bins, one input per bin.

The model is fitted on the driver from a bounded sample: about ``SAMPLE`` labelled documents, chosen by a hash of the id,
whose inputs (at most ``2^BITS`` numbers each) are made by Spark. Every text is scored whole, in one pass without a shuffle.

Defined results: null text is scored as empty, null n_chars has its own bin; labels that contradict each other are averaged; a
null label is left out; without any label every score is 0.5. Equal rows get equal scores; other columns are not returned.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import as_row, held_out, per_batch, stable_sample

SAMPLE, BITS, FACTORS, EPOCHS, RATE, SHRINK = 4000, 17, 8, 6, 0.1, 1e-5
BINS = 24
SYMBOLS = "#*$%&|<>{}[]\\^~@=_+!"


def _level(x: float) -> int:
    """Logarithmic bins of a count."""
    return min(BINS - 1, int(2 * math.log2(1 + x)))


def _share(x: float, of: float) -> int:
    """Even bins of a share's square root, so that small shares are told apart."""
    return min(BINS - 1, int(BINS * math.sqrt(x / of))) if of > 0 else 0


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[int]:
    """Bins of the statistics; the place in the list says which."""
    n, size = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    top = max(counts.values(), default=0)
    marks = sum(map(text.count, SYMBOLS))
    return [
        _level(n), _level(size / n if n else 0), _share(len(counts), n), _share(top, n), _share(sum(map(operator.eq, words, words[1:])), n),
        _share(marks, size), _share(sum(map(str.isupper, words)), n), _share(sum(map(str.istitle, words)), n), _share(sum(map(str.isalpha, words)), n),
        _share(sum(map(text.count, "0123456789")), size), _share(sum(map(text.count, ".,;:?")), n), _level(size / len(lines) if lines else 0), _level(len(lines)),
        _share(len(lines) - len(set(lines)), len(lines)), _level(len(max(counts, key=len)) if counts else 0), _share(size - len(text.encode("ascii", "ignore")), size),
        BINS - 1 if n_chars is None or n_chars < 0 else _level(math.sqrt(n_chars)), 0 if n_chars is None else 1 + (n_chars == size),
    ]


def inputs(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places and values; words and statistics have length one each."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = structure(text, words, counts, n_chars)
    mask = (1 << BITS) - 1
    low: Counter = Counter()
    for w, c in counts.items():
        low[crc32(w.lower().encode("utf-8", "replace")) & mask] += c
    word_at = np.fromiter(low.keys(), np.int64, len(low))
    tf = 1 + np.log(np.fromiter(low.values(), np.float64, len(low)))
    at = np.concatenate([word_at, (1 << BITS) + np.arange(len(stats)) * BINS + np.array(stats)])
    x = np.concatenate([tf / max(1e-12, np.linalg.norm(tf)), np.full(len(stats), 1 / math.sqrt(len(stats)))])
    order = np.argsort(at)
    return at[order].astype(np.int32), x[order].astype(np.float32)


class Machine:
    """Weights of a factorisation machine; AdaGrad on the log loss."""

    def __init__(self, seed: int = 7):
        n = (1 << BITS) + 32 * BINS
        self.w0, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, FACTORS)).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return self.w0 + float(self.w[at] @ x) + 0.5 * float((total * total).sum() - (vx * vx).sum()), vx, total

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(at, x)[0]))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int = 7) -> Machine:
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                at, x, y = rows[k]
                z, vx, total = self.raw(at, x)
                e = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
                dw = e * x + SHRINK * self.w[at]
                dv = e * x[:, None] * (total - vx) + SHRINK * self.v[at]
                g0 += e * e
                gw[at] += dw * dw
                gv[at] += dv * dv
                self.w0 -= RATE * e / math.sqrt(g0)
                self.w[at] -= RATE * dw / np.sqrt(gw[at])
                self.v[at] -= RATE * dv / np.sqrt(gv[at])
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fits on labelled documents that are not held out: about ``sample`` of them, one row per id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", label)
    chosen = stable_sample(known, F.col("doc_id"), sample, known.count(), 23)
    chosen = chosen.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))

    def make():
        def work(rows: dict) -> dict:
            made = [inputs(t, n) for t, n in zip(rows["text"], rows["n_chars"], strict=True)]
            return {"doc_id": rows["doc_id"], "y": rows["y"], "at": [a.tobytes() for a, _ in made], "x": [x.tobytes() for _, x in made]}

        return work

    # The chosen labels are at most about SAMPLE rows of two numbers, so every executor can hold them.
    rows = docs.select("doc_id", "text", stated_length(docs)).join(F.broadcast(chosen), "doc_id")
    made = per_batch(rows, make, "doc_id long, y double, at binary, x binary")
    made = made.groupBy("doc_id").agg(F.min(F.struct("at", "x", "y")).alias("r")).select("doc_id", "r.*")
    got = sorted(made.collect(), key=lambda r: r["doc_id"])
    machine = Machine()
    if not got:
        machine.v[:] = 0
        return machine
    return machine.fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), r["y"]) for r in got])


def stated_length(docs: DataFrame) -> Column:
    known = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return known.alias("n_chars")


def score_rows(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """``(row, score)``: the ``keep`` columns of a document (all by default) as a struct, and its score."""
    weights = (machine.w0, machine.w, machine.v)

    def make():
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = weights

        def work(rows: dict) -> dict:
            return {"score": [m.score(*inputs(t, n)) for t, n in zip(rows["text"], rows["n_chars"], strict=True)]}

        return work

    return per_batch(docs.select(as_row(docs, keep), "text", stated_length(docs)), make, "score double", keep="row")
