"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lowered, everything but letters becomes one blank, and all windows of one to four characters are hashed into
``2^BITS`` counts, a million characters at a time. Document frequencies are counted over all documents that may be
learned from. The regression is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample, about
``SAMPLE`` documents shared evenly by the languages; a fifth of it is kept back to find the temperature that
calibrates the probabilities. Every text is judged whole, in one pass without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0; a null language is never learned from; without
anything to learn from every text is ``und``; ties go to the first language by code point. Equal rows get equal answers.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import as_row, held_out, per_batch

SAMPLE, BITS, BLOCK, EPOCHS = 2000, 16, 1 << 20, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Odd multipliers of the n-gram hash, one per place.
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)


@functools.cache
def letters() -> np.ndarray:
    """Is a code point a letter, for all code points."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def counts(text: str) -> np.ndarray | None:
    """n-gram counts of a text, or None if it has no letter."""
    out, tail, seen = np.zeros(1 << BITS, np.int64), np.zeros(0, np.uint64), False
    shift = np.uint64(64 - BITS)
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), np.uint32)
        yes = letters()[c]
        seen = seen or bool(yes.any())
        c = np.where(yes, c, 32).astype(np.uint64)
        last = tail[-1] if len(tail) else np.uint64(32)
        c = c[yes | (np.concatenate([[last], c[:-1]]) != 32)]  # runs of other characters count as one blank
        h, old = np.concatenate([tail, c]), len(tail)
        key = np.zeros(len(h), np.uint64)
        for n in range(1, 5):
            m = len(h) - n + 1
            if m <= 0:
                break
            key = (key[:m] + h[n - 1 :] * MIX[n - 1]) * np.uint64(0xD6E8FEB86659FD93)
            new = key[max(0, old - n + 1) :]  # windows inside the tail were counted with the last block
            out += np.bincount((new >> shift).astype(np.int64), minlength=1 << BITS)
        tail = h[-3:]
    return out if seen else None


def sparse(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the n-grams a text has."""
    at = np.flatnonzero(n).astype(np.int32)
    return at, n[at].astype(np.int32)


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(n)) * idf[at]
    size = np.linalg.norm(x)
    return at, (x / size if size else x)


class Regression:
    def __init__(self, names: list[str], idf: np.ndarray):
        self.names, self.idf, self.heat = names, idf, 1.0
        self.w = np.zeros((1 << BITS, len(names)), np.float32)
        self.b = np.zeros(len(names))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.b + x @ self.w[at]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Regression:
        """Rows are places, counts and label; they are weighed when they are met, so that little is held."""
        k = len(self.names)
        z, s = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
        zb, sb = np.zeros(k), np.zeros(k)

        def lead(z: np.ndarray, s: np.ndarray, l1: float) -> np.ndarray:
            return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(s)) / ALPHA + L2), 0.0)

        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for r in rng.permutation(len(rows)):
                at, x = weigh(*rows[r][:2], self.idf)
                y = rows[r][2]
                zi, si = z[at], s[at]
                w, b = lead(zi, si, L1), lead(zb, sb, 0.0)
                p = softmax(b + x @ w)
                p[y] -= 1
                for grad, weight, zz, ss, back in ((x[:, None] * p, w, zi, si, at), (p, b, zb, sb, None)):
                    more = ss + grad * grad
                    zz = zz + grad - (np.sqrt(more) - np.sqrt(ss)) / ALPHA * weight
                    if back is None:
                        zb, sb = zz, more
                    else:
                        z[back], s[back] = zz, more
        self.w, self.b = lead(z, s, L1).astype(np.float32), lead(zb, sb, 0.0)
        return self

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Regression:
        """The temperature with the least log loss, by golden section over its logarithm."""
        made = [(self.logits(*weigh(at, n, self.idf)), y) for at, n, y in rows]

        def loss(t: float) -> float:
            return -sum(math.log(max(1e-12, softmax(l / math.exp(t))[y])) for l, y in made) + 1e-3 * t * t

        lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
        for _ in range(30 if made else 0):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.heat = math.exp((lo + hi) / 2) if made else 1.0
        return self

    def judge(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if text and self.names else None
        if n is None:
            return "und", 0.0
        p = softmax(self.logits(*weigh(*sparse(n), self.idf)) / self.heat)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram is, and how many texts: one partial count per task and place, summed by Spark."""

    def run(batches):
        import pyarrow as pa

        seen, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                n = counts(text.as_py())
                if n is not None:
                    seen += n > 0
                    total += 1
        at = np.flatnonzero(seen)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], total], pa.int64())], names=["at", "n"])

    got = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS, np.int64)
    total = 0
    for at, n in got:  # at most one row per hashed place
        if at < 0:
            total = n
        else:
            out[at] = n
    return out, total


def train(docs: DataFrame, sample: int = SAMPLE) -> Regression:
    """Learns from text and lang of rows that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = dict(known.groupBy("lang").count().collect())  # as many rows as there are languages
    names = sorted(found)
    seen, total = document_frequencies(known)
    model = Regression(names, np.log((1 + total) / (1 + seen)) + 1)
    if not names:
        return model
    share = max(1, sample // len(names))
    part = F.lit(0)
    for name, n in found.items():
        part = F.when(F.col("lang") == name, int((1 << 30) * min(1.0, share / n))).otherwise(part)
    # By a hash of id and text, so that no repeated id can enlarge the sample.
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 30))
    chosen = known.filter(draw < part)

    def make():
        def work(rows: dict) -> dict:
            none = np.zeros(1 << BITS, np.int64)
            made = [sparse(n if (n := counts(t)) is not None else none) for t in rows["text"]]
            return {"lang": rows["lang"], "draw": rows["draw"], "at": [a.tobytes() for a, _ in made], "n": [n.tobytes() for _, n in made]}

        return work

    got = per_batch(chosen.select("lang", "text", draw.alias("draw")).distinct(), make, "lang string, draw long, at binary, n binary").collect()
    code = {n: k for k, n in enumerate(names)}
    rows, back = [], []
    for r in sorted(got, key=lambda r: (r["draw"], r["lang"], r["at"])):
        if r["at"]:
            (back if r["draw"] % 5 == 0 else rows).append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), code[r["lang"]]))
    return model.fit(rows).calibrate(back)


def judge_rows(docs: DataFrame, model: Regression, keep: list[str] | None = None) -> DataFrame:
    """``(row, lang_pred, score)``: the ``keep`` columns of a document (all by default) as a struct, and its language."""

    def make():
        def work(rows: dict) -> dict:
            out = [model.judge(t) for t in rows["text"]]
            return {"lang_pred": [a for a, _ in out], "score": [p for _, p in out]}

        return work

    return per_batch(docs.select(as_row(docs, keep), "text"), make, "lang_pred string, score double", keep="row")
