"""What the findings of round 4 name, on small rows."""

import functools
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import replies
from newsloom.operators import digest, vectors
from newsloom.plans import registry
from newsloom.sources.tables import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Runs a query and its SQL on tables of which some are given, the others those of sf0.001."""

    def run(name: str, **given):
        registry.load_all()
        con = duckdb.connect()
        for t in BASE:
            if t in given:
                given[t].coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
                con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
                con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(registry.ORACLES[name])
        cols = [c[0] for c in cur.description]
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr), sorted(cur.fetchall(), key=repr)

    return run


def test_json_is_repaired_as_by_its_sql(spark, both):
    """every quote counts in a text cut short, nothing may follow a value, and titles are trimmed of all spaces."""
    texts = ['Call. Then "token" = "abc" and on, "x" or y.', '☺",b \ta\t{. /', " First . Second.", 'a\\"b\\\\". "c"', "", None]
    rows = [(i, texts[i % 6], "en", "src1", len(texts[i % 6] or "")) for i in range(1260)]
    got, want = both("json_repair", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want and len({r[1] for r in got}) == 3


def test_what_follows_a_value_is_seen(spark):
    """the parser stopped after the first value."""
    rows = [('{"a":1}', True), ('{"a":1}}', False), ('{"a":1} x', False), ("[1],[2]", False), ("[1]]", False), ("1 2", False), (' {"a":[1,]} \n', True), ("", False), ("1,", False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i long, s string")
    assert [r[0] for r in df.orderBy("i").select(replies.parses(F.col("s"))).collect()] == [r[1] for r in rows]


def vectors_with_copies(n: int = 60) -> list[tuple]:
    """Events of one entity each that few others share, 5 and 30 copies of each other, one without a length."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(n, 6)).astype(np.float32)
    m[30] = m[5]
    m[41] = 0
    return [(i, [float(x) for x in m[i]], 5 if i == 30 else i) for i in range(n)]


def related_by_hand(vecs: dict, links: dict) -> dict:
    """``{(event, article): (from_event, position)}`` from all pairs of events; ``links`` are (event, article) to relevance."""
    u = {i: np.array(v) / n for i, v in vecs.items() if (n := np.linalg.norm(v)) > 0}
    heads = {e: sorted((-r, a) for (x, a), r in links.items() if x == e)[:2] for e in vecs}
    want = {}
    for e in u:
        best: dict = {}
        for o in sorted(u):
            if o != e and round(float(u[e] @ u[o]), 6) >= 0.25:
                for r, a in heads[o]:
                    if (e, a) not in links:
                        best[a] = min(best.get(a, (1, 0)), (r, o))
        want |= {(e, a): (best[a][1], k + 1) for k, (_, a) in enumerate(sorted((r, a) for a, (r, _) in best.items())[:3])}
    return want


@pytest.mark.parametrize("first, tile", [(1000, None), (40, 7), (40, None), (1, 7)])
def test_related_articles_come_from_all_similar_events(spark, monkeypatch, first, tile):
    """copies were left out, and so were events that share no entity; what is not found among the first items is found among the rest."""
    monkeypatch.setattr(vectors, "best_of_similar", functools.partial(vectors.best_of_similar, first=first, tile=tile))
    vecs = vectors_with_copies()
    links = {(e, a): (7 * e + 3 * a) % 11 / 11 for e in range(60) for a in range(90) if (e * 5 + a * 7) % 23 == 0}
    art = spark.createDataFrame([(*x, r) for x, r in links.items()], "event_id long, article_id long, relevance double")
    evt = spark.createDataFrame([v[:2] for v in vecs] + [(None, vecs[0][1]), (77, None)], "event_id long, embedding array<float>")
    got = digest.related_articles(art, evt, 0.75).select("event_id", "article_id", "from_event", "position").collect()
    want = related_by_hand({v[0]: v[1] for v in vecs}, links)
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want and len(got) == len(want) > 150


def small(spark, both_of, name):
    """A query over the vectors above and 200 events, with its SQL; the links as a dict, and what is related by hand."""
    vecs = [v for v in vectors_with_copies() if any(v[1])]
    emb = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_id < 200")
    got, want = both_of(name, embeddings=emb, events=events)
    links: dict = {}
    for a in [r[0] for r in events.select("event_id").collect()]:
        for k, e in ((1, a * 7 % 59), (2, (a * 11 + 3) % 59)):
            old = links.get((e, a), (0, 2))
            links[e, a] = max(old[0], a * k % 97 / 97), min(old[1], 1 if k == 1 and a % 3 != 2 else 2)
    rel = related_by_hand({v[0]: v[1] for v in vecs}, {k: v[0] for k, v in links.items()})
    return got, want, links, rel


def test_related_articles_is_whole(spark, both):
    """F4"""
    got, want, _, rel = small(spark, both, "related_articles")
    assert got == want == sorted(((e, a, o, k) for (e, a), (o, k) in rel.items()), key=repr)
    assert {30, 5} <= {r[0] for r in got}


def tiers(links: dict, rel: dict) -> list[tuple]:
    own = [(e, a, "PRIMARY" if tier == 1 else "SECONDARY") for (e, a), (_, tier) in links.items()]
    return own + [(e, a, "RELATED") for e, a in rel]


def test_evidence_set_is_whole(spark, both):
    """of three related articles the third was left out, too."""
    got, want, links, rel = small(spark, both, "evidence_set")
    assert got == want == sorted(tiers(links, rel), key=repr)
    assert max(sum(e == x for x, _ in rel) for e, _ in rel) == 3


def test_evidence_facts_is_whole(spark, both):
    """facts of related articles, of copies and of the third one, too."""
    got, want, links, rel = small(spark, both, "evidence_facts")
    said: dict = {}
    for doc, text in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        lines = text.split("\n")
        said[doc] = [x for x in lines if len(x.strip(" ")) >= 40][:6], [x for x in lines if 1 <= len(x.strip(" ")) <= 39][:4]
    hand = []
    for e in {e for e, _, _ in tiers(links, rel)}:
        mine = sorted((["PRIMARY", "SECONDARY", "RELATED"].index(t), a) for x, a, t in tiers(links, rel) if x == e and a in said)
        for k, kind, most in ((0, "fact", 2), (1, "opinion", 1)):
            first: dict = {}
            for tier, a in mine:
                for body in said[a][k][: most if tier == 2 else None]:
                    first.setdefault(body, tier)
            hand += [(e, kind, n + 1, ["PRIMARY", "SECONDARY", "RELATED"][t], hashlib.md5(b.encode()).hexdigest()) for n, (b, t) in enumerate(first.items())]
    assert got == want == sorted(hand, key=repr)
    assert {30, 5} <= {r[0] for r in got if r[3] == "RELATED"}
