"""Collocations against plain counting, with fingerprints short enough to collide, and on odd rows."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import phrase_mining


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        longer = ((x, b) for (o, x), b in f.items() if o == lang and len(x) > len(w) and 100 * b >= 100 * a)
        if len(w) < 2 or any(x[i : i + len(w)] == w for x, _ in longer for i in range(len(x) - len(w) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items()
                  for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def mine(df, **how):
    return sorted(map(tuple, phrase_mining.collocations(df, **how).collect()))


@pytest.fixture
def rows():
    said = ["the quick brown fox", "The QUICK brown dog.", "new york city, new york state!", "ÉCOLE École école", "a\tb  c\x0bd e\rf\x00g", "one two three four five six"]
    return [(lang, " ".join(said[(i * 7 + j) % 6] for j in range(i % 5)) + ("\n" if i % 2 else ". ") * (i % 3)) for i in range(300) for lang in ("en", None, "und", "de")]


@pytest.mark.parametrize("bits", [64, 9, 3])
def test_counts_do_not_depend_on_fingerprints(spark, rows, bits):
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 20, 40)
    assert len(want) > 30 and mine(df, least=20, top=40, bits=bits) == want


@pytest.mark.parametrize("segment, flush, phrases", [(64, 50, 20), (1000, 5000, 5)])
def test_counts_do_not_depend_on_segments(spark, rows, monkeypatch, segment, flush, phrases):
    for name, value in (("SEGMENT", segment), ("FLUSH", flush), ("PHRASES", phrases)):
        monkeypatch.setattr(phrase_mining, name, value)
    assert b"".join(phrase_mining.cut(b"ab cd, " * 40)) == b"ab cd, " * 40
    rows = [*rows, ("en", "the quick brown fox, " * 300), ("en", "no end " * 200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mine(df, least=20, top=None) == brute(rows, 20, None)


def test_equal_words_have_equal_fingerprints_wherever_they_stand():
    seg = phrase_mining.Segment("Some words, some MORE words and some more words".encode(), "en")
    at, fp = seg.prints(2)
    assert [seg.phrase(k, 2) for k in at] == ["some words", "some more", "more words", "words and", "and some", "some more", "more words"]
    assert fp[1] == fp[5] and fp[2] == fp[6] and len(set(fp.tolist())) == 5
    assert len(set(seg.ids().tolist())) == 4


def test_phrases_on_odd_rows(spark, odd, none):
    got = mine(odd, least=3, top=None)
    assert got == brute([(r.lang, r.text) for r in odd.collect()], 3, None) and got
    assert phrase_mining.collocations(none).collect() == []
    assert mine(odd.withColumn("text", F.lit(None).cast("string"))) == []


def test_phrases_are_spelled_once_however_many_tasks_read(spark, rows, monkeypatch):
    made = []
    df = spark.createDataFrame(rows, "lang string, text string")
    real = type(df).mapInArrow

    def spied(self, run, schema, *more):
        out = real(self, run, schema, *more)
        made.append((schema, out))
        return out

    monkeypatch.setattr(type(df), "mapInArrow", spied)
    seen = {}
    for tasks in (1, 6):
        made.clear()
        assert mine(df.repartition(tasks), least=20, top=None) == brute(rows, 20, None)
        spelled = [out.filter("phrase like '% %'") for schema, out in made if "phrase" in schema]
        seen[tasks] = sum(out.count() for out in spelled), sum(out.distinct().count() for out in spelled)
    assert seen[1] == seen[6] and seen[1][0] == seen[1][1] > 30


@pytest.mark.parametrize("bits, segment", [(64, 1 << 20), (2, 1 << 20), (64, 7)])
def test_words_have_one_number_whatever_their_fingerprints(monkeypatch, bits, segment):
    monkeypatch.setattr(phrase_mining, "SEGMENT", segment)
    known = [("de", "same"), ("en", "same"), ("en", "word"), ("en", "words"), ("en", "école")]
    numbers = phrase_mining.Numbers(pa.table({"lang": [k[0] for k in known], "phrase": [k[1] for k in known]}), bits)
    text = "Same WORD, wordy words word sam école"
    seen = {lang: numbers.of(lang, phrase_mining.Segment(text.encode(), lang, bits)).tolist() for lang in ("en", "de", "fr")}
    assert seen == {"en": [2, 3, 0, 4, 3, 0, 5], "de": [1, 0, 0, 0, 0, 0, 0], "fr": [0] * 7}
    langs, texts = numbers.spelled([b"\0\0\0\2\0\0\0\3", b"\0\0\0\1\0\0\0\1\0\0\0\1"])
    assert (langs.to_pylist(), texts) == (["en", "de"], ["same word", "same same same"])
