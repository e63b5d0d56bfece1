"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each line with a word is described by binned shares (symbols, capitals, digits, separators, repeated words, ...). The field has
weights for inputs per label and for pairs of neighbouring labels; Viterbi decoding labels all lines of a text at once.
A document is kept if it passes the base rules and content lines hold at least ``KEEP`` of its characters.

Nothing says which lines are boilerplate, only ``labels.quality`` says which documents are poor. So the field is trained
in rounds: in good documents every line counts as content, in poor ones at first every line as boilerplate, then what the
field itself decodes there, but at least its worst line. The sample is bounded: about ``SAMPLE`` labelled documents that
are not held out, chosen by a hash of the id; their inputs are made by Spark and fitted on the driver. A text of more than
``MOST_LINES`` lines gives the fit stretches of ``STRETCH`` lines, evenly spaced over all of it, ``MOST_LINES`` in all, and the fit reads every text in
stretches of that length, so that neither its memory nor its steps grow with the longest text. All documents are judged whole, in
one pass without a shuffle.

Defined results: null text has no words and fails the base rules; lines without a word have no label; equal rows get equal
verdicts; without labels every line is content; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import held_out, per_batch, stable_sample

SAMPLE, KEEP, ROUNDS, STEPS, RATE, SHRINK = 2500, 0.5, 3, 60, 0.15, 1e-3
STRETCH, MOST_LINES = 256, 2048
BINS, STATS = 8, 11
CONTENT, BOILER = 0, 1
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 0.5


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 lower letter, 2 capital, 3 digit, 4 symbol, 5 separator or mark, 6 stop, 7 blank."""
    out = np.zeros(sys.maxunicode + 1, np.int8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        out[c] = 2 if k == "Lu" else 1 if k[0] == "L" else 3 if k[0] == "N" else 4 if k[0] == "S" or chr(c) in SYMBOLS else 0
    for c in "|/\\_-=~<>{}[]":
        out[ord(c)] = 5
    for c in ".,;:":
        out[ord(c)] = 6
    for c in BLANK:
        out[ord(c)] = 7
    out[ord("!")] = 4
    return out


def words_of(text: str) -> list[bytes]:
    """Words of the contract: bytes.split knows exactly the blanks 0x20 and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def base_rules(text: str) -> dict:
    words = words_of(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), repeated_words(words)
    return {"n_words": n, "word_chars": len(text) - sum(map(text.count, BLANK)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": rep, "base_failed": n < MIN_WORDS or rep > MOST_REPEATED * n}


def line_inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of every line with a word, ``lines x STATS``, and the lines' sizes in characters."""
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    if not lines:
        return np.zeros((0, STATS), np.int16), np.zeros(0, np.int64)
    c = classes()[np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32)]
    size = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(size + 1) - size - 1
    n = np.stack([np.add.reduceat((c == k).astype(np.int32), start) for k in range(8)])
    split = [x.split() for x in lines]
    words = np.array([max(1, len(w)) for w in split])
    letters = np.maximum(1, n[1] + n[2])
    distinct = np.array([len(set(w)) for w in split])
    same = np.array([sum(map(str.__eq__, w, w[1:])) for w in split])
    capital = np.array([sum(map(str.isupper, w)) for w in split])
    first: dict[str, int] = {}
    again = np.array([first.setdefault(x, k) != k for k, x in enumerate(lines)])
    ends = np.array([x.rstrip(BLANK)[-1] in ".!?:;,\"'" for x in lines])

    def share(x, of):
        return np.minimum(BINS - 1, (BINS * np.sqrt(np.clip(x / of, 0, 1))).astype(np.int16))

    bins = [share(n[4], size), share(n[5], words), share(n[2], letters), share(n[3], size), share(n[6], words * 2), share(same, words),
            share(words - distinct, words), share(capital, words), np.minimum(BINS - 1, np.log2(words)).astype(np.int16), again * 1, ends * 1]
    return np.stack(bins, axis=1).astype(np.int16), size


class Field:
    """Weights of the chain: ``unary[stat, bin, label]``, ``pair[label, label]``, ``first[label]``."""

    def __init__(self):
        self.unary, self.pair, self.first = np.zeros((STATS, BINS, 2)), np.zeros((2, 2)), np.array([0.0, -1e-6])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.unary[np.arange(STATS), bins].sum(axis=1)

    def viterbi(self, bins: np.ndarray) -> np.ndarray:
        """The likeliest labels of a text's lines; content wins ties."""
        s = self.scores(bins)
        if not len(s):
            return np.zeros(0, np.int8)
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = (self.first + s[0]).tolist()
        back: list[tuple[int, int]] = []
        for x, y in s[1:].tolist():
            to0, to1 = (a + p00 >= b + p10), (a + p01 >= b + p11)
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = (a + p00 if to0 else b + p10) + x, (a + p01 if to1 else b + p11) + y
        k = 0 if a >= b else 1
        out = [k]
        for step in reversed(back):
            k = step[k]
            out.append(k)
        return np.array(out[::-1], np.int8)

    def fit(self, texts: list[np.ndarray], labels: list[np.ndarray], weights: list[float]) -> Field:
        """Adam on the log likelihood; all stretches of texts advance line by line together, the longest first."""
        cut = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), STRETCH)]
        texts, labels, weights = [texts[k][at : at + STRETCH] for k, at in cut], [labels[k][at : at + STRETCH] for k, at in cut], [weights[k] for k, _ in cut]
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        texts, labels = [texts[k] for k in order], [labels[k] for k in order]
        w = np.array([weights[k] for k in order])
        long = np.array([len(t) for t in texts])
        depth = int(long.max(initial=0))
        alive = [int((long > t).sum()) for t in range(depth)]
        bins = np.concatenate(texts)
        at = np.cumsum(long) - long
        gold = np.concatenate(labels)
        row_w = np.repeat(w, long)
        params = [self.unary, self.pair, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            s = self.scores(bins)
            up = np.zeros_like(s)
            up[at] = self.first + s[at]
            for t in range(1, depth):
                i = at[: alive[t]] + t
                up[i] = s[i] + np.logaddexp(up[i - 1, 0, None] + self.pair[0], up[i - 1, 1, None] + self.pair[1])
            down = np.zeros_like(s)
            for t in range(depth - 2, -1, -1):
                i = at[: alive[t + 1]] + t
                x = s[i + 1] + down[i + 1]
                down[i] = np.logaddexp(self.pair[:, 0] + x[:, 0, None], self.pair[:, 1] + x[:, 1, None])
            z = np.repeat(np.logaddexp(up[at + long - 1, 0], up[at + long - 1, 1]), long)
            node = np.exp(up + down - z[:, None])
            grad_row = (np.eye(2)[gold] - node) * row_w[:, None]
            gu, gp = np.zeros_like(self.unary), np.zeros((2, 2))
            for j in range(STATS):
                for y in (0, 1):
                    gu[j, :, y] = np.bincount(bins[:, j], weights=grad_row[:, y], minlength=BINS)
            follow = np.ones(len(bins), bool)
            follow[at] = False
            i = np.flatnonzero(follow)
            for x in (0, 1):
                for y in (0, 1):
                    chance = np.exp(up[i - 1, x] + self.pair[x, y] + s[i, y] + down[i, y] - z[i])
                    gp[x, y] = (row_w[i] * (((gold[i - 1] == x) & (gold[i] == y)) - chance)).sum()
            grads = [gu, gp, grad_row[at].sum(axis=0)]
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                g = g / max(1.0, row_w.sum()) - SHRINK * p
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p += RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        return self


def stretches(bins: np.ndarray) -> np.ndarray:
    """All lines of a text, or of a long one stretches over all of it."""
    if len(bins) <= MOST_LINES:
        return bins
    first = np.linspace(0, len(bins) - STRETCH, MOST_LINES // STRETCH).astype(int)
    return np.concatenate([bins[k : k + STRETCH] for k in first])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = stable_sample(known, F.col("doc_id"), sample, known.count(), 31).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))

    def make():
        def work(rows: dict) -> dict:
            return {"doc_id": rows["doc_id"], "y": rows["y"], "bins": [stretches(line_inputs(t or "")[0]).tobytes() for t in rows["text"]]}

        return work

    # The chosen labels are at most about SAMPLE rows of two numbers.
    made = per_batch(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), make, "doc_id long, y int, bins binary")
    made = made.groupBy("doc_id").agg(F.min(F.struct("bins", "y")).alias("r")).select("doc_id", "r.*")
    got = [(np.frombuffer(r["bins"], np.int16).reshape(-1, STATS), r["y"]) for r in sorted(made.collect(), key=lambda r: r["doc_id"]) if r["bins"]]
    texts = [b for b, _ in got]
    field = Field()
    if not got:
        return field
    marks = [np.full(len(b), CONTENT if y else BOILER, np.int64) for b, y in got]
    poor = sum(1 for _, y in got if not y)
    weights = [1.0 if y else max(1.0, (len(got) - poor) / max(1, poor)) for _, y in got]
    for k in range(ROUNDS):
        field = Field().fit(texts, marks, weights)
        if k + 1 < ROUNDS:
            for j, (b, y) in enumerate(got):
                if not y:
                    marks[j] = field.viterbi(b).astype(np.int64)
                    s = field.scores(b)
                    marks[j][int((s[:, BOILER] - s[:, CONTENT]).argmax())] = BOILER
    return field


def judge_documents(docs: DataFrame, field: Field, keep_share: float = KEEP) -> DataFrame:
    """``(doc_id, base statistics, content_share, labels, kept)``; ``labels`` has one 0 (content) or 1 per line with a word."""
    weights = (field.unary, field.pair, field.first)

    def make():
        f = Field()
        f.unary, f.pair, f.first = weights

        def work(rows: dict) -> dict:
            out: dict[str, list] = {}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                text = text or ""
                bins, size = line_inputs(text)
                marks = f.viterbi(bins)
                share = float(size[marks == CONTENT].sum() / size.sum()) if len(size) else 0.0
                base = base_rules(text)
                row = {"doc_id": doc_id, **base, "content_share": share, "labels": marks.tolist(), "kept": not base["base_failed"] and share >= keep_share}
                for k, x in row.items():
                    out.setdefault(k, []).append(x)
            return out

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "content_share double, labels array<tinyint>, kept boolean"))
