"""Collocations: frequent phrases of two to five words, counted by the numbers of their words.

Three passes over the texts, each a numpy job over segments of about ``SEGMENT`` bytes.

1. Words are counted by their text: told apart in a segment, summed in the task and again after the shuffle. The frequent ones are numbered.
2. Pairs of frequent words are counted. A key is the numbers of a phrase's words, four bytes each, so it is the phrase and no hash
   of it: what is summed needs no second look at the text.
3. A longer phrase is counted only where all its pairs are frequent.

A frequent phrase is spelled out once, after it has been counted, from the numbered words; no task gives out texts of phrases while it reads.

A word finds its number through a Rabin-Karp fingerprint (prefix polynomials of the bytes, a difference of two prefix sums, so the work
is linear in the text) and is then held against the numbered word byte by byte: a collision of fingerprints costs a look into
a dictionary, it can never change a count. Tasks hold the frequent words (their bytes and 36 more for each) and the frequent pairs, these as a bit table
of at most ``bits.MOST_BITS`` bits, of which each sets two. Where it fills up, more phrases than necessary are counted in pass 3; none is lost.

Counts are per language: ``n`` all words, ``f`` all occurrences inside pieces. A phrase that lies in a longer one with the same
count (a longer one is never more frequent) is dropped; as counts fall along chains of extensions, longer by one word is enough.

Defined results: null text is empty, null language is ``und``; only A-Z are lower-cased; repeated rows count as often as they are
there; ties of score and count go to the phrase that is first in UTF-8; an empty table gives no rows; other columns are
ignored. A segment is cut between pieces only, so a task holds at least the longest piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm.bits import Bits, mixed
from newsloom.llm.common import salted_join
from newsloom.session import cut_lineage

LEAST, TOP, LONGEST = 100, 2000, 5
SEGMENT, FLUSH, PHRASES, ROWS = 1 << 20, 1_500_000, 250_000, 128
#: Bytes that end a piece, and bytes between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_U = np.uint64
BASE, STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_rng = np.random.default_rng(13)
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(ENDS)] = 1, 2
COUNTED = "key binary, n long"


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers 0 to n - 1, modulo 2^64; the base is odd."""
    size = max(SEGMENT + 1, 1 << max(1, n - 1).bit_length())
    return _powers(int(base), size)[:n], _powers(pow(int(base), -1, 1 << 64), size)[:n]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Rabin-Karp fingerprints of ``values[start:end]``, wherever they stand."""
    up, down = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mixed((prefix[end] - prefix[start]) * down[start])


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start``, ``start + 1``, ... of every run, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Segment:
    """Words and pieces of some bytes of one language."""

    def __init__(self, raw: bytes, lang: str, bits: int = 64):
        self.bytes = LOWER[np.frombuffer(raw, np.uint8)]
        kind = KIND[self.bytes]
        edge = np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = spans(VALUE[self.bytes], self.start, self.end, BASE) if len(self.start) else np.zeros(0, np.uint64)
        self.piece = np.cumsum(kind == 2)[self.start]
        self.lang, self.bits = _U(xxhash.xxh64_intdigest(lang.encode())), bits

    def prints(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(at, fingerprint)`` of the phrases of n words, all or those that begin at the words ``at``."""
        last = len(self.words) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if at is None:
            at = np.flatnonzero(self.piece[:last] == self.piece[n - 1 :])
        g = spans(self.words, at, at + n, STEP)
        return at, mixed(g ^ self.lang ^ _U(n)) >> _U(64 - self.bits)

    def longer(self, pairs: np.ndarray):
        """``(n, at)`` for n of 3 and more, all of whose pairs are frequent; ``pairs`` are the words where such a pair begins."""
        here = np.zeros(len(self.words) + 1, bool)
        here[pairs] = True
        ok = here.copy()
        for n in range(3, LONGEST + 1):
            last = max(0, len(here) - n + 2)
            ok[:last] &= here[n - 2 :]
            ok[last:] = False
            yield n, np.flatnonzero(ok)

    def ids(self) -> np.ndarray:
        """A number per word, equal for equal bytes only: fingerprints held against the text."""
        _, first, ids = np.unique(self.words, return_index=True, return_inverse=True)
        size, model = self.end - self.start, first[ids]
        same = size == size[model]
        at = np.flatnonzero(same & (model != np.arange(len(size))))
        length = size[at]
        unlike = self.bytes[places(self.start[at], length)] != self.bytes[places(self.start[model[at]], length)]
        same[np.repeat(at, length)[unlike]] = False
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same):
            ids[k] = known.setdefault(self.bytes[self.start[k] : self.end[k]].tobytes(), len(first) + len(known))
        return ids

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.bytes[self.start[k] : self.end[k]].tobytes() for k in range(at, at + n)).decode()

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """``(word, count)``, each word once."""
        ids = self.ids()
        count = np.bincount(ids)
        first = np.empty(len(count), np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
        size = self.end[first] - self.start[first]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(self.bytes[places(self.start[first], size)])), count


class Numbers:
    """Numbers of words, from 1, by ``(lang, phrase)``; 0 is any other word."""

    def __init__(self, words: pa.Table, bits: int):
        words = words.sort_by([("lang", "ascending"), ("phrase", "ascending")])
        self.bits, raw = bits, [w.encode() for w in words["phrase"].to_pylist()]
        self.size = np.array([0, *map(len, raw)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.of_lang: dict[str, tuple] = {}
        self.lang = pa.array([None, *words["lang"].to_pylist()], pa.string()).dictionary_encode()
        begins = np.flatnonzero(np.diff(self.lang.indices[1:].to_numpy(), prepend=-1))
        for begin, end in zip(begins, [*begins[1:], len(raw)], strict=False):
            self._add(self.lang[int(begin) + 1].as_py(), raw[begin:end], int(begin) + 1)

    def _add(self, lang: str, raw: list[bytes], number: int) -> None:
        """Words of one language, numbered from ``number``: by fingerprint, and by their bytes where one before them has the same."""
        prints = np.concatenate([Segment(part, lang, self.bits).prints(1)[1] for part in cut(b"\n".join(raw))])
        fp, first = np.unique(prints, return_index=True)
        more = np.setdiff1d(np.arange(len(raw)), first).tolist()
        self.of_lang[lang] = fp, first + number, {raw[k]: k + number for k in more}

    def of(self, lang: str, seg: Segment) -> np.ndarray:
        """The number of every word of a segment of one language."""
        out = np.zeros(len(seg.words), np.uint64)
        if lang not in self.of_lang:
            return out
        fp, number, more = self.of_lang[lang]
        prints = seg.prints(1)[1]
        at = np.minimum(np.searchsorted(fp, prints), len(fp) - 1)
        hit = np.flatnonzero(fp[at] == prints)
        found = number[at[hit]]
        size = self.size[found]
        same = seg.end[hit] - seg.start[hit] == size
        alike, length = np.flatnonzero(same), size[same]
        unlike = seg.bytes[places(seg.start[hit[alike]], length)] != self.bytes[places(self.start[found[alike]], length)]
        same[np.repeat(alike, length)[unlike]] = False
        out[hit[same]] = found[same]
        for k in hit[~same].tolist():
            out[k] = more.get(seg.bytes[seg.start[k] : seg.end[k]].tobytes(), 0)
        return out

    def spelled(self, keys: list[bytes]) -> tuple[pa.Array, list[str]]:
        """Language and text of phrases by their keys."""
        numbers = [np.frombuffer(k, ">u4").tolist() for k in keys]
        word = lambda k: self.bytes[self.start[k] : self.start[k] + self.size[k]].tobytes()
        texts = [b" ".join(map(word, ks)).decode() for ks in numbers]
        return self.lang.take(pa.array([ks[0] for ks in numbers], pa.int64())).cast(pa.string()), texts


def cut(raw: bytes):
    """A text as byte strings of about ``SEGMENT`` bytes, cut between pieces."""
    while len(raw) > SEGMENT:
        at = max(raw.rfind(bytes([c]), 0, SEGMENT) for c in ENDS) + 1
        if not at:
            at = min([p for c in ENDS if (p := raw.find(bytes([c]), SEGMENT)) >= 0], default=len(raw) - 1) + 1
        yield raw[:at]
        raw = raw[at:]
    yield raw


def _by_language(batches, bits: int):
    """``(language, segment)`` over a task's Arrow batches of text and lang; four segments at most are gathered at a time."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def full(lang: str) -> tuple[str, Segment]:
        del size[lang]
        return lang, Segment(b"\n".join(held.pop(lang)), lang, bits)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist(), strict=True):
                for raw in cut((text or "").encode("utf-8", "replace")):
                    held.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw) + 1
                    if size[lang] >= SEGMENT:
                        yield full(lang)
                if sum(size.values()) >= 4 * SEGMENT:
                    yield full(max(size, key=size.get))
    while held:
        yield full(next(iter(held)))


def count_words(rows: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, f)`` of words with ``f >= least``; ``phrase`` is null for all words of the language."""

    def summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
        out = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return out.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"]).combine_chunks().to_batches()

    def run(batches):
        held, size = [], 0
        for lang, seg in _by_language(batches, 64):
            if not len(seg.words):
                continue
            word, count = seg.distinct()
            word, count = pa.concat_arrays([word, pa.nulls(1, pa.string())]), np.append(count, len(seg.words))
            held.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(word)), "phrase": word, "f": count}))
            size += len(word)
            if size >= PHRASES:
                yield from summed(held)
                held, size = [], 0
        if held:
            yield from summed(held)

    found = rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return cut_lineage(found.filter(F.col("phrase").isNull() | (F.col("f") >= least)))


def _packed(numbers: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The numbers of phrases of n words that begin at the words ``at``, two to a column."""
    return [numbers[at + k] << _U(32) | (numbers[at + k + 1] if k + 1 < n else _U(0)) for k in range(0, n, 2)]


def _summed(n: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Keys of phrases of n words, sorted, and how often each is there."""
    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
    if len(cols) == 1:
        cols[0], count = np.unique(cols[0], return_counts=True)
    else:
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.any([np.diff(c, prepend=~c[:1]) != 0 for c in cols], axis=0))
        count = np.diff(first, append=len(order))
        cols = [c[first] for c in cols]
    raw = np.ascontiguousarray(np.stack(cols, 1).astype(">u8").view(np.uint8)[:, : 4 * n])
    ends = np.arange(len(count) + 1, dtype=np.int32) * np.int32(4 * n)
    keys = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([keys, pa.array(count, pa.int64())], names=["key", "n"])


def count_keys(rows: DataFrame, least: int, numbers, frequent: Bits | None) -> DataFrame:
    """``(key, n)`` with ``n >= least``: pairs of numbered words, or, given the frequent ones, what is longer."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        words, known = numbers.value, shared.value
        held: dict[int, list] = {}
        size = 0
        for lang, seg in _by_language(batches, words.bits):
            number = words.of(lang, seg)
            at = np.flatnonzero((seg.piece[:-1] == seg.piece[1:]) & (number[:-1] > 0) & (number[1:] > 0))
            pairs = _packed(number, at, 2)
            made = [(2, pairs)] if known is None else [(n, _packed(number, at, n)) for n, at in seg.longer(at[known.holds(pairs[0])])]
            for n, cols in made:
                if len(cols[0]):
                    held.setdefault(n, []).append(cols)
                    size += len(cols[0])
            if size >= FLUSH:
                yield from (_summed(n, held.pop(n)) for n in sorted(held))
                size = 0
        yield from (_summed(n, held.pop(n)) for n in sorted(held))

    found = rows.mapInArrow(run, COUNTED).groupBy("key").agg(F.sum("n").alias("n"))
    return cut_lineage(found.filter(F.col("n") >= least))


def spell(keys: DataFrame, numbers) -> DataFrame:
    """``(lang, phrase, f)`` of counted keys, each once."""

    def run(batches):
        for batch in batches:
            lang, phrase = numbers.value.spelled(batch["key"].to_pylist())
            yield pa.RecordBatch.from_arrays([lang, pa.array(phrase, pa.string()), batch["n"]], names=["lang", "phrase", "f"])

    return cut_lineage(keys.select("key", "n").mapInArrow(run, "lang string, phrase string, f long"))


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, bits: int = 64) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``; ``bits`` is the length of the words' fingerprints."""
    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counts = count_words(rows, least)
    words = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    known = counts.filter("phrase is not null").filter(F.col("f") >= least)
    numbers = rows.sparkSession.sparkContext.broadcast(Numbers(known.select("lang", "phrase").toArrow(), bits))
    pairs = count_keys(rows, least, numbers, None)
    longer = count_keys(rows, least, numbers, Bits(pairs.select(F.conv(F.hex("key"), 16, 10).cast("long").alias("fp"))))

    phrases = spell(pairs.unionByName(longer), numbers)
    known = known.unionByName(phrases)
    phrases = phrases.withColumn("w", F.split("phrase", " "))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    inner = phrases.filter(F.size("w") > 2).select("lang", "f", F.explode(F.array(part(1, F.size("w") - 1), part(2, F.size("w") - 1))).alias("phrase"))
    phrases = phrases.join(inner.distinct(), ["lang", "phrase", "f"], "left_anti")

    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.size("w") - F.col("k"))).drop("w")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = salted_join(cuts, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], F.col("phrase"))
    cuts = salted_join(cuts, words, ["lang"], F.col("phrase"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    cuts = cuts.withColumn("over", (wide["a"] * wide["n"] * 1000).cast("decimal(38,0)")).withColumn("under", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("rank", F.row_number().over(order).cast("long"))
    best = best if top is None else best.filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
