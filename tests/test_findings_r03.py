"""What the findings of round 3 name, on small rows."""

import functools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions import replies
from newsloom.operators import digest, events, graph, pages, quality, stories, vectors
from newsloom.plans import registry


def test_a_comma_after_the_last_item_may_stand(spark):
    rows = [('[1,]', "valid", '[1,]'), ('{"a": [1, ] , }', "valid", '{"a": [1, ] , }'), ('{"a": "x,]', "repaired", '{"a": "x,]"}'), ('{"f":["x.",', "repaired", '{"f":["x.",]}'),
            ('{"a":"b\\",}","c":[2,', "repaired", '{"a":"b\\",}","c":[2,]}'), ("[,]", "broken", ""), ("[1,,]", "broken", ""), ("{,}", "broken", ""), ('{"a":,}', "broken", "")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i long, s string").select("i", replies.repair_json("s").alias("r")).select("i", "r.*")
    got = {r["i"]: (r["state"], r["text"]) for r in df.collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]


def test_sentences_keep_digits_that_equal_their_place(spark):
    said = "One alpha. Two beta. 2381 gamma. Four delta. 4652 alpha. Six 4652 beta. 169 gamma."
    df = spark.createDataFrame([(1, said), (2, said.replace("2381", "x2381").replace(" 4652 alpha", " x4652 alpha").replace("Six 4652", "Six x4652"))], "id long, t string")
    got = pages.sentence_rank(df, "id", "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sentence", "score"))).alias("s"))
    one, two = [[(x["sentence"], x["score"]) for x in r["s"]] for r in got.orderBy("id").collect()]
    assert one == two


@pytest.mark.parametrize("name", ["built_clean", "built_containers", "page_complexity", "built_blocks", "page_clean"])
def test_pages_are_parsed_once_and_their_nodes_never_joined(spark, name):
    registry.load_all()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan ==")[-1]
    assert initial.count("MapInPandas walk") == 1
    # an exchange of nodes by page, and at most the pages' own beside it; no text of a page goes through either, but for blocks
    assert initial.count("Exchange hashpartitioning(page_id") <= 2 and "hashpartitioning(page_id#" in initial


def test_words_are_counted_a_bounded_number_at_once():
    rnd = random.Random(5)
    rows = [([f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(900))], [f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(900))]) for _ in range(1500)]
    rows[7] = (["x", "y"] * quality.WORDS_AT_ONCE, ["x"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), *[pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)]], names=["id", "a", "b"])
    out = list(quality._shared([batch.slice(3)]))
    assert max(sum(o["na"].to_pylist()) + sum(o["nb"].to_pylist()) for o in out if o.num_rows > 1) <= quality.WORDS_AT_ONCE
    got = [tuple(r.values()) for o in out for r in o.to_pylist()]
    assert got == [(i, (Counter(a) & Counter(b)).total(), len(a), len(b)) for i, (a, b) in enumerate(rows) if i >= 3]


@pytest.mark.parametrize("name", ["block_scores", "block_budget"])
def test_blocks_are_read_and_dealt_by_page_once(spark, name):
    registry.load_all()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_components_run_what_made_the_edges_once(spark):
    """F5, F8, F18: the edges were made for the nodes and again for the rounds."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a long, b long").coalesce(1).mapInArrow(seen, "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    assert made.value == 4


def test_terms_of_a_single_text_count_in_the_length_and_are_not_joined(spark):
    """F5, F8, F16: they were most of the heads, and no pair can share them; copies count as texts."""
    df = spark.createDataFrame([(1, "alpha beta gamma", 1), (2, "alpha beta delta", 1), (3, "omega sigma", 2)], "id long, body string, n long")
    copied = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "omega sigma"), (4, "omega sigma")], "id long, body string")
    vocab = stories.fit_vocabulary(df, "id", "body", copies="n")
    known = {(r["term"], r["idf"]) for r in stories.fit_vocabulary(copied, "id", "body").collect()}
    assert {(r["term"], r["idf"]) for r in vocab.collect()} == known
    every = {(r["id"], r["term"]): r["weight"] for r in stories.tfidf(df, "id", "body", vocab).collect()}
    shared = {(r["id"], r["term"]): r["weight"] for r in stories.tfidf(df, "id", "body", vocab, shared=True).collect()}
    alone = {(1, "gamma"), (1, "beta gamma"), (2, "delta"), (2, "beta delta")}
    assert set(every) - set(shared) == alone
    assert all(abs(every[k] - w) < 1e-12 for k, w in shared.items())


@pytest.fixture(scope="module")
def met(spark):
    """Events of two entities each, articles of theirs, and the pairs of events above 0.3."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(70, 4))
    m[66] = 0
    ents = {i: {i % 3, 10 + i % 4} for i in range(70)}
    links = sorted({(int(e), int(a)) for a in range(60) for e in rng.integers(0, 70, 3)})
    value = {x: (7 * x[0] + 3 * x[1]) % 5 / 5 for x in links}
    u = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
    near = {i: {j for j in range(70) if j != i and ents[i] & ents[j] and round(float(u[i] @ u[j]), 6) >= 0.3} for i in range(70)}
    evt = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(70)], "event_id long, embedding array<double>")
    entity = spark.createDataFrame([(i, e) for i in ents for e in ents[i]], "event_id long, entity_id long")
    art = spark.createDataFrame([(*x, value[x]) for x in links], "event_id long, article_id long, relevance double")
    return events.by_entity(evt, entity).cache(), events.event_pairs(evt, entity, 0.7), art, value, near


@pytest.mark.parametrize("tile", [7, 2048])
def test_counts_and_links_need_no_pairs(spark, met, monkeypatch, tile):
    """a pair of two shared entities counts once, links hold the same components together."""
    rows, pairs, _, _, near = met
    for f in ("similar_counts", "similar_links"):
        monkeypatch.setattr(vectors, f, functools.partial(getattr(vectors, f), tile=tile))
    assert {r["event_id"]: r["n"] for r in events.pair_counts(rows, 0.7).collect()} == {i: len(x) for i, x in near.items() if x}
    links = events.pair_links(rows, 0.7)
    assert {tuple(r) for r in graph.components(links).collect()} == {tuple(r) for r in graph.components(pairs).collect()}
    assert tile == 7 or links.count() < pairs.count()


@pytest.mark.parametrize("tile", [7, 2048])
def test_related_articles_need_no_pairs(spark, met, monkeypatch, tile):
    """own articles are not given, an article is given once, from its best event."""
    rows, _, art, value, near = met
    monkeypatch.setattr(vectors, "best_of_similar", functools.partial(vectors.best_of_similar, tile=tile))
    heads = {e: sorted((-v, a) for (x, a), v in value.items() if x == e)[:2] for e in range(70)}
    want = set()
    for e in range(70):
        best: dict = {}
        for o in sorted(near[e]):
            for v, a in heads[o]:
                if (e, a) not in value:
                    best[a] = min(best.get(a, (1, 0)), (v, o))
        want |= {(e, a, best[a][1], k + 1) for k, (_, a) in enumerate(sorted((v, a) for a, (v, _) in best.items())[:3])}
    got = digest.related_articles(art, rows, 0.7).select("event_id", "article_id", "from_event", "position").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_the_nearest_are_cut_before_they_are_sorted(spark):
    """equal values at the cut go to the smaller id, with more columns than runs."""
    rng = np.random.default_rng(9)
    m = rng.integers(-1, 2, size=(300, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(300)], "id long, v array<double>")
    u = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
    sim = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(300) for _, j in sorted((-sim[i, j], j) for j in range(300) if j != i and sim[i, j] >= 0.2)[:5]}
    for tile in (90, 8192):
        assert {(r["id"], r["neighbour"]) for r in vectors.nearest(df, "id", "v", k=5, min_sim=0.2, tile=tile).collect()} == want


def greedy(near):
    weight = {i: (len(x), i) for i, x in near.items() if x}
    kept = set()
    for i in sorted(weight, key=weight.get, reverse=True):
        if not near[i] & kept:
            kept.add(i)
    return {(i, i if i in kept else max(near[i] & kept, key=weight.get)) for i in weight}


@pytest.mark.parametrize("tile, least", [(7, 0), (2048, 0), (7, 40), (2048, 1 << 20)])
def test_representatives_need_no_pairs_while_these_are_many(spark, met, monkeypatch, tile, least):
    """all pairs were made and joined in every round."""
    rows, _, _, _, near = met
    made = []
    plain = vectors.similar_pairs
    monkeypatch.setattr(vectors, "heaviest", functools.partial(vectors.heaviest, tile=tile))
    monkeypatch.setattr(vectors, "similar_pairs", lambda df, *how: made.append(df.select("event_id").distinct().count()) or plain(df, *how))
    got = [tuple(r) for r in events.representatives(rows, 0.7, links_each=0, least=least).collect()]
    assert set(got) == greedy(near) and len(got) == len(set(got))
    assert len(made) == 1 and (made[0] == 0 if least == 0 else made[0] < len(near) or least > 40)


def test_representatives_of_edges_are_the_sequential_ones(spark):
    rng = np.random.default_rng(4)
    near = {i: set() for i in range(60)}
    for a, b in rng.integers(0, 60, (150, 2)).tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    edges = spark.createDataFrame([(a, b) for a in near for b in near[a] if a < b], "a long, b long")
    nodes = spark.createDataFrame([(i, len(x)) for i, x in near.items() if x], "id long, n long")
    assert {tuple(r) for r in graph.representatives(nodes, edges, "n").collect()} == greedy(near)
