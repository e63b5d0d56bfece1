"""Dealt operators against SQL, libraries, brute force and held-out accuracy, and on odd rows."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import (
    chat_format, crf_lines, forced_bpe, label_shards, lang_ftrl, lsh_forest, multiprobe_lsh, pareto_mix, quality_fm, queries, url_automaton,
)
from newsloom.llm.common import components, held_out
from newsloom.sources.tables import BASE

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cur = duck.execute(queries.ORACLES[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([c[0] for c in cur.description], cur.fetchall())


# 1 and 3: learned models


def test_quality_is_learned_and_held_out(spark):
    got = queries.QUERIES["op1_quality_fm"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_machine_pairs_match_the_double_sum():
    m = quality_fm.Machine()
    at, x = quality_fm.inputs("Some words, some more words.", 10)
    m.w[at] = np.linspace(-1, 1, len(at))
    slow = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.raw(at, x)[0] == pytest.approx(m.w0 + float(m.w[at] @ x) + slow, abs=1e-5)


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1), (101, 1), (103, 1)], "doc_id long, quality int")
    machine = quality_fm.train(odd, labels)
    got = quality_fm.score_rows(odd, machine).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and got[0]["row"]["score"] == "mine"
    same = [r["score"] for r in got if r["row"]["text"] == "same text of seven words in all"]
    assert len(set(same)) == 1
    blank = quality_fm.train(none, labels)
    assert quality_fm.score_rows(none, blank).count() == 0
    assert {r["score"] for r in quality_fm.score_rows(odd, blank).collect()} == {0.5}


def test_language_is_learned_and_held_out(spark):
    got = queries.QUERIES["op3_lang_ftrl"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_ngram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ärger über  die 12 Straße, und so weiter; " * 9
    whole = lang_ftrl.counts(text)
    monkeypatch.setattr(lang_ftrl, "BLOCK", 7)
    assert (lang_ftrl.counts(text) == whole).all() and lang_ftrl.counts("12 !!") is None


def test_language_on_odd_rows(odd, none):
    model = lang_ftrl.train(odd)
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["lang_pred"], r["score"]) for r in lang_ftrl.judge_rows(odd, model).collect()}
    for key in ((1, None), (2, ""), (3, " \n\t "), (8, "12 34 !! $$ --")):
        assert got[key] == ("und", 0.0)
    assert all(0 <= p <= 1 for _, p in got.values()) and got[(4, odd.filter("doc_id = 4").first().text)][0] == "en"
    assert lang_ftrl.judge_rows(odd, lang_ftrl.train(none)).filter("lang_pred != 'und'").count() == 0
    assert lang_ftrl.judge_rows(none, model).count() == 0


# 2: mixing


def test_mix_meets_targets_and_repeats_itself(spark):
    got = pareto_mix.pareto_mix(spark.read.parquet(f"{MIDDLE}/documents.parquet")).collect()
    assert sorted(got) == sorted(pareto_mix.pareto_mix(spark.read.parquet(f"{MIDDLE}/documents.parquet").repartition(7)).collect())
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r["copies"] * r.size
        target[r.source] = r.target
        assert 0 <= r["copies"] <= 3
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def test_mix_with_weights_prefers_them(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 2).cast("string").alias("source"),
                                    F.when(F.col("id") % 4 < 2, 3.0).otherwise(1.0).alias("w"))
    got = pareto_mix.pareto_mix(docs, share=0.5, weight="w").join(docs.select("doc_id", "w"), "doc_id")
    n = {r.w: r.n for r in got.groupBy("w").agg(F.sum("copies").alias("n")).collect()}
    assert 2.4 < n[3.0] / n[1.0] < 3.6


def test_mix_on_odd_rows(odd, none):
    mix = pareto_mix.pareto_mix(odd).collect()
    assert len(mix) == odd.count() and None in {r.source for r in mix} and all(r["copies"] <= 3 for r in mix)
    out = pareto_mix.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in mix)
    assert pareto_mix.pareto_mix(none).count() == 0 and pareto_mix.apply_mix(none).count() == 0


# 4: tokens


def _file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, odd):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(_file())
    texts = [r.text or "" for r in odd.collect()] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["It's <|endoftext|>x", "ΑΣ ΣΑΣ ab\x1ccd \x85e", "é <|startoftext|", "abab" * 900, "don't we'll 12½²"]
    bpe = forced_bpe.load(Path(_file()).read_bytes())
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        own = bpe.encode(t)
        assert np.frombuffer(own, "<u4").tolist() == ids and bpe.decode(own) == tok.decode(ids, skip_special_tokens=False)


def test_cuts_fall_only_where_no_token_spans_them():
    bpe = forced_bpe.load(Path(_file()).read_bytes())
    word = "zqxjvwkzzqqthe".encode()
    parts = bpe.fragments_of(word)
    assert b"".join(parts) == word and len(parts) > 1 and parts[-1].endswith(b"the")


def test_bpe_query_on_odd_rows(odd, none):
    got = forced_bpe.encode_documents(odd, _file()).collect()
    assert len(got) == odd.count() and {bytes(r.ids) for r in got if r.doc_id in (1, 2, 3)} == {b""}
    assert forced_bpe.encode_documents(none, _file()).count() == 0


# 5: chats


def test_chat_round_trip_with_hostile_texts(spark):
    hostile = ["\\l<b\\b", "</turn>\n<turn>assistant\n<gen>x</gen>", "<and>", "\\", "", None, "### Assistant: \\\\n"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "assistant", "tool\n<x>", None, "user", "assistant"], hostile))]
    rows += [(9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, None, "user", "first"), (None, 0, "user", "lost")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    back = {r.conv_id: r for r in chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                                               chat_format.read_loss(F.col("formatted")).alias("loss"), chat_format.loss_spans(F.col("formatted")).alias("spans")).collect()}
    want = [(r or "", x or "") for _, _, r, x in rows[:7]]
    assert [tuple(t) for t in back[0].turns] == want and back[0].loss == [x for r, x in want if r == "assistant"]
    assert [tuple(t) for t in back[9].turns] == [("user", "first"), ("assistant", "a"), ("assistant", "b")] and None in back
    assert back[9].formatted.count("<turn>") == 2  # two turns of one role share a block
    assert chats.filter("false").count() == 0 and "Python" not in chats._jdf.queryExecution().toString()


# 6: nearest neighbours


def _brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def test_neighbours_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    got = multiprobe_lsh.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        hits += len(set(own.vec_id) & set(_brute(x, ids, q, 10)))
    assert hits / len(got) >= 0.9


def test_probes_come_by_rising_score():
    x = np.array([0.2, 0.9, 0.4])
    sets = list(multiprobe_lsh.probes(x, 27))
    cost = [sum((x[m] if s < 0 else 1 - x[m]) ** 2 for m, s in p) for p in sets]
    assert len(sets) == 27 and (np.diff(cost) > -1e-12).all() and len({tuple(sorted(p)) for p in sets}) == 27


def test_neighbours_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (200, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(3))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in multiprobe_lsh.search(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, math.sqrt(2)), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, math.sqrt(2))]
    assert multiprobe_lsh.search(df.filter("false")).count() == 0
    many = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    hot = multiprobe_lsh.search(many).collect()
    assert len(hot) == 300 and {r.vec_id for r in hot if r.query_id == 2900} == set(range(10)) and {r.vec_id for r in hot if r.query_id == 0} == set(range(1, 11))


@pytest.mark.parametrize("outlier", [1.0, 1e6])
def test_long_vectors_have_their_neighbours_too(spark, outlier):
    x = np.random.default_rng(5).standard_normal((6000, 16))
    x[::100] *= 10  # every query is a long row, far from all slots of its neighbours
    x[300] *= outlier
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multiprobe_lsh.search(df).toPandas()
    assert len(got) == 600
    found = {q: set(own.vec_id) for q, own in got.groupby("query_id")}
    hits = [len(found[q] & set(_brute(x, np.arange(6000), q, 10))) for q in range(0, 6000, 100)]
    assert np.mean(hits) >= 9 and min(hits) >= 5


def test_fewer_directions_where_the_most_probes_miss_the_target(spark, monkeypatch):
    monkeypatch.setattr(multiprobe_lsh, "MOST_PROBES", 4)
    x = np.random.default_rng(6).standard_normal((2000, 16))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i long, v array<double>")
    index = multiprobe_lsh.fit(rows, 512 * 3**6, 16, 10)  # a sample of so large a table
    assert 3 ** index.a.shape[1] <= 4 or multiprobe_lsh._fit(x, index.a.shape[1], 16, 10, 3)[1] >= multiprobe_lsh.TARGET
    assert index.a.shape[1] < 6 and index.n_probes <= 4


# 7: URLs


def test_urls_on_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://com/", "http://a.com", "http://x.net/es/1",
            "http://x.net/ES/1", "http://spam.org/", "http://s.org/x.com/", "https://a.org/b.EXE", "ftp://h.net\n/fr/x", "http://y.com/" + "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    got = [(r.host, r.rule, r.verdict) for r in url_automaton.judge_urls(df).orderBy("page_id").collect()]
    assert got[:4] == [("", None, "allow")] * 4
    assert got[4:10] == [("example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"), ("com", "com/", "allow"),
                         ("a.com", None, "allow"), ("x.net", "net/es/", "block"), ("x.net", None, "allow")]
    assert [v for _, _, v in got[10:13]] == ["block", "allow", "block"] and got[14][1] == "com/"


def test_automaton_equals_regular_expressions():
    rng = np.random.default_rng(1)
    globs = [("".join(rng.choice(list("ab*?"), 5)), "/" + "".join(rng.choice(list("ab*?"), 6)), bool(k % 2)) for k in range(40)]
    urls = [("".join(rng.choice(list("abAB"), rng.integers(0, 9))), "/" + "".join(rng.choice(list("abAB"), rng.integers(0, 9)))) for _ in range(400)]
    hits = url_automaton.Globs(globs).matches([f"{h}\n{p}".encode() for h, p in urls])
    turn = lambda g: g.replace("*", ".*").replace("?", ".")
    for j, (h, p, any_case) in enumerate(globs):
        both = re.compile(f"{turn(h)}\n{turn(p)}", re.I if any_case else 0)
        assert [bool(both.fullmatch(f"{a}\n{b}")) for a, b in urls] == hits[:, j].tolist()


# 8: shards


def _check_shards(df, n):
    rows = df.collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == n and max(count.values(), default=0) - min([count.get(s, 0) for s in range(16)]) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    return rows


def test_shards_are_even_and_keep_groups(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = _check_shards(label_shards.balanced_shards(docs), docs.count())
    homes: dict = {}
    for r in rows:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_with_a_hot_text_and_odd_rows(spark, odd, none):
    _check_shards(label_shards.balanced_shards(odd), odd.count())
    _check_shards(label_shards.balanced_shards(none), 0)
    hot = spark.range(1600).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 6))).alias("text"))
    df = label_shards.balanced_shards(hot.withColumnRenamed("id", "doc_id"))
    rows = _check_shards(df, 1600)
    homes: dict = {}
    for r in rows:
        homes.setdefault((r.size, r.text_crc32), []).append(r.shard)
    kept = [Counter(h).most_common(1)[0][1] / len(h) for h in homes.values() if 1 < len(h) < 20]
    assert np.mean(kept) > 0.95 and "Python" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("groups, size", [(30, 2), (50, 6), (7, 40), (16, 20), (5, 1)])
def test_groups_that_fit_a_shard_are_kept_whole(spark, groups, size):
    rows = [(g * size + k, f"text {g}") for g in range(groups) for k in range(size)]
    got = _check_shards(label_shards.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")), groups * size)
    home = {r.doc_id: r.shard for r in got}
    whole = sum(len({home[g * size + k] for k in range(size)}) == 1 for g in range(groups))
    total = groups * size
    room = [total // 16 + (s < total % 16) for s in range(16)]
    assert whole == min(groups, sum(x // size for x in room))


def test_few_links_are_cut_on_mixed_groups(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for g, n in enumerate([*rng.integers(1, 30, 60).tolist(), 90]):
        rows += [(k + j, f"text {g}") for j in range(n)]
        k += n
    got = {r.doc_id: r.shard for r in _check_shards(label_shards.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")), k)}
    homes: dict = {}
    for i, t in rows:
        homes.setdefault(t, Counter())[got[i]] += 1
    cut = {t: sum(h.values()) - max(h.values()) for t, h in homes.items()}
    # Largest first into the emptiest shard, as one machine would do it: no more rows away from their group than a tenth above that.
    room, lost = [k // 16 + (s < k % 16) for s in range(16)], 0
    for n in sorted((sum(h.values()) for h in homes.values()), reverse=True):
        s = max(range(16), key=lambda x: room[x])
        lost += max(0, n - room[s])
        room[s] -= min(n, room[s])
    assert sum(cut.values()) <= lost + k // 10


# 9: line labels


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_lines_against_labels_and_counts(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries.QUERIES["op9_crf_lines"](spark, MIDDLE).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(text[r.doc_id])
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    good = [r.kept for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r.kept for r in got if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    f = crf_lines.Field()
    f.unary, f.pair, f.first = rng.normal(size=f.unary.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    bins = rng.integers(0, crf_lines.BINS, (7, crf_lines.STATS))
    s = f.scores(bins)
    paths = [[k >> j & 1 for j in range(7)] for k in range(128)]
    value = lambda p: f.first[p[0]] + sum(s[j, y] for j, y in enumerate(p)) + sum(f.pair[a, b] for a, b in zip(p, p[1:], strict=False))
    assert f.viterbi(bins).tolist() == max(paths, key=value)


def test_lines_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, 0), (101, 1), (None, 0)], "doc_id long, quality int")
    field = crf_lines.train(odd, labels)
    got = crf_lines.judge_documents(odd, field).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert crf_lines.judge_documents(none, crf_lines.train(none, labels)).count() == 0


# 10: near duplicates


def test_near_duplicates_on_odd_rows(odd, none):
    got = lsh_forest.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].class_id == by[7][0].class_id == 6 and by[7][0]["copies"] == 3 and by[4][0].class_id == 4
    assert by[1][0].class_id == by[2][0].class_id == 1 and by[3][0].class_id == 3  # null and empty are equal texts
    assert lsh_forest.near_duplicates(none).count() == 0


def test_near_duplicates_in_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "TILE", 20)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(150):
        w = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 8)):
            w[at] = f"x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{k}" for k in rng.integers(0, 5000, 60)) for _ in range(50)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    different = list(dict.fromkeys(texts))
    at = [texts.index(t) for t in different]
    want = [sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in at if texts[j] != t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(df).collect()}
    found = [got[k].n_links for k in range(len(texts))]
    assert sum(found) >= 0.99 * sum(want) and all(f <= w for f, w in zip(found, want, strict=True)) and sum(want) > 2000
    assert all(got[k].class_id == k for k in range(150, 200)) and len({got[k].class_id for k in range(150) if want[k]}) == 1


def test_prefixes_are_shortened_until_both_demands_are_met():
    assert lsh_forest.depths(0) == [8] * 32 and lsh_forest.depths(20) == [7] * 20 + [8] * 12 and lsh_forest.depths(33) == [6] + [7] * 31
    step = lsh_forest.formula_step()
    assert lsh_forest.chance(0.8, step) >= 0.999 > lsh_forest.chance(0.8, step - 1)
    rng = np.random.default_rng(8)
    for _ in range(50):
        a = rng.integers(0, 3, 256).astype("<u2")
        b = np.where(rng.random(256) < 0.6, a, 9).astype("<u2")
        first = lsh_forest.first_met(a, b)
        meets = [any((a[t * 8 : t * 8 + d] == b[t * 8 : t * 8 + d]).all() for t, d in enumerate(lsh_forest.depths(k))) for k in range(224)]
        assert meets.index(True) == first if any(meets) else first == 256
    assert lsh_forest.measured_step({}) == 0 and lsh_forest.measured_step({0: 999, 40: 1}) == 0 and lsh_forest.measured_step({0: 99, 3: 800, 40: 100, 250: 1}) == 40


def _near_texts(n, seed, words=120):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, 3)):
            w[at] = f"x{k}"
        texts.append(" ".join(w) + f" end{k}")
    return texts


def test_links_between_trees_stay_few(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(_near_texts(600, 9))), "doc_id long, text string")
    nodes = lsh_forest._nodes(df, lsh_forest._draw(df, 600), 0.8)
    edges = []
    monkeypatch.setattr(lsh_forest, "components", lambda e, a, b: (edges.append(e.count()), components(e, a, b))[1])
    found = lsh_forest.met_groups(nodes, lsh_forest.depths(20)).collect()
    assert len({r.root for r in found}) == 1 and len(found) == len({r.node for r in found}) == 600
    assert edges[0] <= 2 * 600 and sum(edges[1:]) < 600


def test_drawn_pairs_are_all_partners_of_the_drawn_texts(spark, monkeypatch):
    texts = _near_texts(60, 10) + [" ".join(f"y{k}{j}" for j in range(50)) for k in range(20)]
    monkeypatch.setattr(lsh_forest, "DRAWN", 1000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = lsh_forest._draw(df, 80)
    sets = [set(lsh_forest.shingles(t).tolist()) for t in texts]
    want = sum(len(a & b) >= 0.8 * len(a | b) and a != b for a in sets for b in sets)
    nodes = lsh_forest._nodes(df, drawn, 0.8)
    assert len(drawn.sig) == 80 and sum(lsh_forest.drawn_pairs(nodes).values()) == want > 1000
    # Prefixes that find too few of them are shortened.
    monkeypatch.setattr(lsh_forest, "formula_step", lambda *a: 0)
    assert lsh_forest.measured_step({k: n for k, n in lsh_forest.drawn_pairs(nodes).items()}, 1.0) >= 0


# the pipeline


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 50
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(_file())
    for r in out.limit(20).collect():
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows_keep_columns(spark, odd, none, k, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1), (8, 0), (101, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    assert stage(spark, odd, str(tmp_path)).count() <= 3 * odd.count()
    assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("score, stay", [(0.4, False), (0.5, True), (0.6, True)])
def test_quality_stage_follows_the_classifier(spark, odd, tmp_path, monkeypatch, score, stay):
    machine = quality_fm.Machine()
    machine.v[:] = 0
    machine.w0 = math.log(score / (1 - score))
    monkeypatch.setattr(quality_fm, "train", lambda docs, labels: machine)
    spark.createDataFrame([(4, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, odd, str(tmp_path)).count() == (odd.count() if stay else 0)


def test_one_document_of_each_class_stays(spark, odd):
    kept = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    texts = [r.text or "" for r in kept]
    assert len(texts) == len(set(texts)) and {r.text for r in kept} >= {"no id but words", "A"}


def test_one_document_stays_where_ids_repeat_or_are_null(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(100)) for c in "xy"]
    rows = [(1, a), (1, a + " more"), (2, a + " still more"), (None, b), (None, b + " more"), (None, b), (1, "another text under the same id")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "y"), (1, "a"), (1, "x")]


# edges named in review


def test_ftrl_steps_equal_the_plain_rule():
    from newsloom.llm.lang_ftrl import ALPHA, BETA, EPOCHS, L1, L2, Regression

    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(12, 4, replace=False)).astype(np.int32), rng.integers(1, 5, 4).astype(np.int32), int(rng.integers(0, 3))) for _ in range(15)]
    idf = np.ones(1 << lang_ftrl.BITS)
    idf[:12] = rng.uniform(1, 3, 12)
    model = Regression(["a", "b", "c"], idf).fit(rows)
    z, n = {}, {}

    def weight(key, l1):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((BETA + math.sqrt(ni)) / ALPHA + L2)

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, count, y = rows[r]
            x = [(1 + math.log(c)) * idf[i] for i, c in zip(at, count)]
            size = math.sqrt(sum(v * v for v in x))
            inputs = [*((int(i), v / size, L1) for i, v in zip(at, x)), (-1, 1.0, 0.0)]
            score = [sum(weight((i, k), l1) * v for i, v, l1 in inputs) for k in range(3)]
            top = [math.exp(s - max(score)) for s in score]
            for k in range(3):
                error = top[k] / sum(top) - (k == y)
                for i, v, l1 in inputs:
                    g, w, old = error * v, weight((i, k), l1), n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / ALPHA * w
                    n[i, k] = old + g * g
    for i in range(12):
        assert model.w[i] == pytest.approx([weight((i, k), L1) for k in range(3)], abs=1e-5)
    assert model.b == pytest.approx([weight((-1, k), 0.0) for k in range(3)], abs=1e-9)


def test_temperature_is_the_best_of_a_grid():
    model = lang_ftrl.Regression(["a", "b"], np.ones(1 << lang_ftrl.BITS))
    model.w[0], model.w[1] = [8.0, -8.0], [-8.0, 8.0]
    rows = [(np.array([k % 2], np.int32), np.array([1], np.int32), k % 2 if k % 5 else 1 - k % 2) for k in range(50)]
    heat = model.calibrate(rows).heat
    loss = lambda t: -sum(math.log(lang_ftrl.softmax(np.array([16.0, 0.0]) / t)[0 if k % 5 else 1]) for k in range(50)) + 1e-3 * math.log(t) ** 2
    grid = np.exp(np.linspace(math.log(0.05), math.log(20), 4000))
    assert heat > 1 and loss(heat) <= min(map(loss, grid)) + 1e-3


def test_one_very_long_text_does_not_stall_the_fit(spark):
    import time

    text = "\n".join(f"line {k} of a text that goes on | | | 123" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "A short text.\nOf two lines."), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    known = [r.doc_id for r in labels.filter(~held_out(F.col("doc_id"))).collect()]
    assert 1 in known
    began = time.time()
    field = crf_lines.train(docs, labels)
    assert time.time() - began < 120
    judged = {r.doc_id: r for r in crf_lines.judge_documents(docs, field).collect()}
    assert len(judged[1].labels) == 100_000 and judged[1].n_words > 1_000_000
    bins = np.arange(5000 * crf_lines.STATS, dtype=np.int16).reshape(5000, -1)
    cut = crf_lines.stretches(bins)
    assert len(cut) == crf_lines.MOST_LINES and (cut[0] == bins[0]).all() and (cut[-1] == bins[-1]).all() and crf_lines.stretches(bins[:9]) is not cut


def test_url_columns_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/es/1"), (2, "http://x.net/es/1"), (2, "http://x.net/es/1")], "page_id long, url string")
    for c in ("row", "judged", "_v", "rule", "verdict", "path"):
        df = df.withColumn(c, F.lit("mine"))
    out = url_automaton.judge_urls(df)
    assert sorted(out.columns) == sorted(["page_id", "url", "row", "judged", "_v", "host", "path", "rule", "verdict"])
    assert [(r.row, r.judged, r._v, r.path, r.rule, r.verdict) for r in out.collect()] == [("mine", "mine", "mine", "/es/1", "net/es/", "block")] * 3
    assert url_automaton.judge_urls(df.limit(0)).collect() == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(none).collect() == []


def test_a_hot_source_and_equal_rows_are_mixed_whole(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("source"),
        F.concat(F.lit("some words "), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("text"))
    rows = pareto_mix.pareto_mix(docs).collect()
    for s in ("hot", "cold", None):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0].target) <= 9 and max(r["copies"] for r in mine) <= 3
    same = docs.select(F.lit(1).alias("doc_id"), F.lit("a").alias("source"), F.lit("two words").alias("text"), F.col("doc_id").alias("other")).limit(300)
    other = docs.filter("doc_id < 40").select((F.col("doc_id") + 10).alias("doc_id"), F.lit("b").alias("source"), F.lit("three short words").alias("text"), F.lit(-1).alias("other"))
    mixed = pareto_mix.apply_mix(same.unionByName(other))
    per = Counter(r.other for r in mixed.filter("source = 'a'").collect())
    want = sum(r["copies"] for r in pareto_mix.pareto_mix(same.unionByName(other)).filter("source = 'a'").collect())
    assert sum(per.values()) == want and max(per.values()) - min([per.get(k, 0) for k in range(300)]) <= 1
