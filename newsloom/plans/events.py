"""Vector, entity and event queries. The test vectors lie far apart, so similarity queries use distance 0.75."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import events, graph, vectors
from newsloom.operators.ranking import first_rows, top_k
from newsloom.plans.registry import query
from newsloom.session import cut_lineage
from newsloom.sources.tables import as_of

DIST = 0.75
COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"

REPS = """reps AS (SELECT min(event_id) AS event_id, count(*) AS copies, embedding, entity_ids FROM (SELECT event_id, embedding FROM evt)
   JOIN (SELECT event_id, list_sort(list(entity_id)) AS entity_ids FROM evt_entity GROUP BY event_id) USING (event_id) GROUP BY embedding, entity_ids)"""
PAIRS = f"""{REPS}, pairs AS (SELECT a.event_id AS a, b.event_id AS b, {COS} AS similarity, len(list_intersect(a.entity_ids, b.entity_ids)) AS shared
   FROM reps a JOIN reps b ON a.event_id < b.event_id WHERE len(list_intersect(a.entity_ids, b.entity_ids)) >= 1 AND {COS} >= 25e-2)"""
REACH = """links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""


@query("event_pairs", uses="evt evt_entity", sql=f"WITH {PAIRS} SELECT a, b, similarity, shared FROM pairs")
def _(t):
    return events.event_pairs(t.evt, t.evt_entity, DIST)


@query("cosine_pairs", uses="evt", sql="""
WITH c AS (SELECT entity_id, list(m ORDER BY pos) AS centroid FROM (SELECT entity_id, pos, avg(v) AS m FROM (SELECT entity_id, generate_subscripts(embedding,1) AS pos,
   unnest(embedding)::DOUBLE AS v FROM evt) GROUP BY entity_id, pos) GROUP BY entity_id)
SELECT event_id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS similarity FROM evt JOIN c USING (entity_id)""")
def _(t):
    c = vectors.as_arrays(vectors.centroids(t.evt, "entity_id", "embedding"), "entity_id")
    return t.evt.join(c, "entity_id").select("event_id", F.round(vectors.cosine("embedding", "centroid"), 6).alias("similarity"))


@query("centroids", uses="evt", sql="""
SELECT entity_id, (pos-1)::BIGINT AS pos, round(avg(v), 9) AS mean FROM (SELECT entity_id, generate_subscripts(embedding,1) AS pos, unnest(embedding)::DOUBLE AS v FROM evt) GROUP BY entity_id, pos""")
def _(t):
    return vectors.centroids(t.evt, "entity_id", "embedding").select("entity_id", F.col("pos").cast("long").alias("pos"), F.round("mean", 9).alias("mean"))


@query("vector_topk", uses="evt", sql=f"""
SELECT a.event_id AS id, b.event_id AS neighbour, {COS} AS similarity, row_number() OVER (PARTITION BY a.event_id ORDER BY {COS} DESC, b.event_id) AS position
FROM evt a JOIN evt b ON a.event_id <> b.event_id WHERE {COS} >= 22e-2 QUALIFY position <= 5""")
def _(t):
    return vectors.nearest(t.evt, "event_id", "embedding", k=5, min_sim=0.22).withColumn("position", F.col("position").cast("long"))


@query("entity_nearest", uses="evt", sql=f"""
SELECT b.event_id AS entity, a.event_id AS nearest_earlier, {COS} AS similarity FROM evt a JOIN evt b ON a.entity_id%4 = b.entity_id%4 AND a.event_id < b.event_id
WHERE {COS} >= 25e-2 QUALIFY row_number() OVER (PARTITION BY b.event_id ORDER BY {COS} DESC, a.event_id) = 1""")
def _(t):
    typed = t.evt.select("event_id", "embedding", (F.col("entity_id") % 4).alias("type"))
    near = vectors.nearest(typed, "event_id", "embedding", k=1, min_sim=1 - DIST, block=("type",), earlier=True)
    return near.select(F.col("id").alias("entity"), F.col("neighbour").alias("nearest_earlier"), "similarity")


RELATED = f"""recent AS (SELECT * FROM evt WHERE age_h <= 48), together AS (SELECT DISTINCT x.event_id AS e, y.event_id AS o FROM art_evt x JOIN art_evt y USING (article_id) WHERE x.event_id <> y.event_id),
related AS (SELECT a.event_id, count(b.event_id) AS related FROM recent a LEFT JOIN recent b ON a.event_id <> b.event_id AND {COS} >= 25e-2
   AND NOT EXISTS (SELECT 1 FROM together WHERE e = a.event_id AND o = b.event_id) GROUP BY a.event_id)"""


@query("related_event_counts", uses="evt art_evt", sql=f"WITH {RELATED} SELECT event_id, related FROM related")
def _(t):
    return events.related_counts(t.evt, t.art_evt, as_of(), DIST)


@query("event_score_boosted", uses="evt art_evt", sql=f"""
WITH {RELATED} SELECT event_id, 2e0*count(*) FILTER (is_primary) + count(*) FILTER (NOT is_primary) + 5e-1*coalesce(max(related),0) AS score
FROM art_evt LEFT JOIN related USING (event_id) GROUP BY event_id""")
def _(t):
    return events.boosted(events.event_scores(t.art_evt), events.related_counts(t.evt, t.art_evt, as_of(), DIST)).select("event_id", "score")


@query("event_groups", uses="art_evt", sql="""
SELECT event_id, article_id, CASE WHEN is_primary THEN 'primary' ELSE 'secondary' END AS role FROM art_evt""")
def _(t):
    return events.event_groups(t.art_evt)


@query("trending_events", uses="art_evt", sql="""
SELECT event_id, count(*) FILTER (is_primary) AS primary_mentions, count(*) FILTER (NOT is_primary) AS secondary_mentions,
  2e0*count(*) FILTER (is_primary) + count(*) FILTER (NOT is_primary) AS score FROM art_evt GROUP BY event_id ORDER BY score DESC, event_id LIMIT 20""")
def _(t):
    return first_rows(events.event_scores(t.art_evt), [F.desc("score"), F.asc("event_id")], 20)


@query("event_mentions", uses="art_evt", sql="""
SELECT event_id, count(*) FILTER (is_primary) AS primary_articles, count(*) FILTER (NOT is_primary) AS secondary_articles,
  max(article_id) FILTER (is_primary) AS latest_primary FROM art_evt GROUP BY event_id HAVING count(*) FILTER (is_primary) > 0""")
def _(t):
    p = F.col("is_primary")
    return t.art_evt.groupBy("event_id").agg(F.count_if(p).alias("primary_articles"), F.count_if(~p).alias("secondary_articles"),
                                             F.max(F.when(p, F.col("article_id"))).alias("latest_primary")).filter("primary_articles > 0")


@query("single_primary_event", uses="art_evt", sql="""
SELECT article_id, event_id FROM art_evt QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY is_primary DESC, relevance DESC, event_id) = 1""")
def _(t):
    return events.single_primary(t.art_evt)


@query("event_article_hist", uses="art_evt", sql="""
SELECT n AS articles, count(*) AS events, sum(p)::BIGINT AS primary_links FROM (SELECT event_id, count(*) AS n, count(*) FILTER (is_primary) AS p FROM art_evt GROUP BY event_id) GROUP BY n""")
def _(t):
    per = t.art_evt.groupBy("event_id").agg(F.count("*").alias("articles"), F.count_if("is_primary").alias("p"))
    return per.groupBy("articles").agg(F.count("*").alias("events"), F.sum("p").alias("primary_links"))


@query("event_entity_hist", uses="evt evt_entity", sql="""
SELECT n AS entities, count(*) AS events, round(1e2*count(*)/sum(count(*)) OVER (), 6) AS percent
FROM (SELECT event_id, count(x.entity_id) AS n FROM evt LEFT JOIN evt_entity x USING (event_id) GROUP BY event_id) GROUP BY n""")
def _(t):
    per = t.evt.select("event_id").join(t.evt_entity, "event_id", "left").groupBy("event_id").agg(F.count("entity_id").alias("entities"))
    total = t.evt.agg(F.count("*")).scalar()
    return per.groupBy("entities").agg(F.count("*").alias("events")).withColumn("percent", F.round(F.col("events") * 100.0 / total, 6))


@query("clustering_potential", uses="evt evt_entity", sql=f"""
WITH {PAIRS}, deg AS (SELECT e AS event_id, count(*) AS n FROM (SELECT a AS e FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY e)
SELECT count(*) AS events, count(n) AS clusterable, count(*) - count(n) AS isolated, round(avg(n), 6) AS avg_similar, max(n) AS max_similar FROM reps LEFT JOIN deg USING (event_id)""")
def _(t):
    rows = events.by_entity(t.evt, t.evt_entity)
    return rows.select("event_id").distinct().join(events.pair_counts(rows, DIST), "event_id", "left").agg(
        F.count("*").alias("events"), F.count("n").alias("clusterable"), (F.count("*") - F.count("n")).alias("isolated"),
        F.round(F.avg("n"), 6).alias("avg_similar"), F.max("n").alias("max_similar"))


@query("similar_count_hist", uses="evt evt_entity", sql=f"""
WITH {PAIRS}, deg AS (SELECT e AS event_id, count(*) AS n FROM (SELECT a AS e FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY e)
SELECT coalesce(n, 0) AS similar, count(*) AS events FROM reps LEFT JOIN deg USING (event_id) GROUP BY 1""")
def _(t):
    rows = events.by_entity(t.evt, t.evt_entity)
    return rows.select("event_id").distinct().join(events.pair_counts(rows, DIST), "event_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("similar")).agg(F.count("*").alias("events"))


@query("cluster_sizes", uses="evt evt_entity", sql=f"""
WITH RECURSIVE {PAIRS}, {REACH} SELECT component AS cluster_id, count(*) AS size, count(*) OVER () AS clusters, round(avg(count(*)) OVER (), 6) AS avg_size FROM comp GROUP BY component""")
def _(t):
    links = events.pair_links(events.by_entity(t.evt, t.evt_entity), DIST)
    sizes = cut_lineage(graph.components(links).groupBy(F.col("component").alias("cluster_id")).agg(F.count("*").alias("size")))
    all_ = sizes.agg(F.count("*").alias("c"), F.round(F.avg("size"), 6).alias("a"))
    return sizes.withColumn("clusters", all_.select("c").scalar()).withColumn("avg_size", all_.select("a").scalar())


@query("cluster_reps", uses="evt evt_entity", sql=f"""
WITH RECURSIVE {PAIRS}, links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
deg AS (SELECT x AS id, count(*) AS w, list(y) AS nb FROM links GROUP BY x), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, id DESC) AS i FROM deg),
walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, false AS rep, []::BIGINT[] AS used
 UNION ALL SELECT o.i, o.id, NOT list_contains(used, o.id), CASE WHEN list_contains(used, o.id) THEN used ELSE list_concat(used, list_append(o.nb, o.id)) END
 FROM walk JOIN o ON o.i = walk.i + 1),
reps2 AS (SELECT o.id, o.i FROM walk JOIN o ON o.id = walk.id WHERE rep)
SELECT id, id AS representative FROM reps2 UNION ALL
SELECT l.x AS id, arg_min(r.id, r.i) AS representative FROM links l JOIN reps2 r ON r.id = l.y WHERE l.x NOT IN (SELECT id FROM reps2) GROUP BY l.x""")
def _(t):
    return events.representatives(events.by_entity(t.evt, t.evt_entity), DIST)


@query("event_merge", uses="evt evt_entity art_evt", sql=f"""
WITH RECURSIVE {PAIRS}, {REACH}, f AS (SELECT component, arg_min(event_id, (last_seen_at, event_id)) AS canonical FROM evt JOIN comp ON comp.id = event_id GROUP BY component),
target AS (SELECT event_id, age_h, coalesce(canonical, event_id) AS c FROM evt LEFT JOIN comp ON comp.id = event_id LEFT JOIN f USING (component)),
moved AS (SELECT article_id, c, max(relevance) AS r, bool_or(is_primary) AS p FROM art_evt JOIN target USING (event_id) GROUP BY article_id, c)
SELECT c AS event_id, count(*) AS members, min(age_h) AS youngest_h, coalesce(max(n),0) AS article_count, coalesce(max(round(r,6)),0e0) AS relevance,
  coalesce(max(p),0) AS primaries, coalesce(max(es),0) AS entities
FROM target LEFT JOIN (SELECT c, count(*) AS n, sum(r) AS r, count(*) FILTER (p) AS p FROM moved GROUP BY c) USING (c)
LEFT JOIN (SELECT c, count(DISTINCT entity_id) AS es FROM target JOIN evt_entity USING (event_id) GROUP BY c) USING (c) GROUP BY c""")
def _(t):
    pairs = events.event_pairs(t.evt, t.evt_entity, DIST)
    target = events.canonical_events(t.evt, pairs)
    merged, moved = events.merge(target, t.art_evt)
    rel = moved.groupBy("event_id").agg(F.round(F.sum("relevance"), 6).alias("relevance"), F.count_if("is_primary").alias("primaries"))
    ents = events.move_entities(t.evt_entity, target).groupBy("event_id").agg(F.count("*").alias("entities"))
    age = ((F.unix_seconds(as_of()) - F.unix_seconds("last_seen_at")) / 3600).cast("long")
    zero = F.lit(0)
    return merged.join(rel, "event_id", "left").join(ents, "event_id", "left").select(
        "event_id", "members", age.alias("youngest_h"), "article_count", F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        F.coalesce("primaries", zero).alias("primaries"), F.coalesce("entities", zero).alias("entities"))


_HASHED = "substring(sha256(lower(concat('Event ', event_id%150))),1,20)"


@query("event_resolve", uses="evt evt_entity", sql=f"""
WITH RECURSIVE h AS (SELECT e.*, {_HASHED} AS hash, es FROM evt e JOIN (SELECT event_id, list(entity_id) AS es FROM evt_entity GROUP BY event_id) USING (event_id)),
base AS (SELECT * FROM h WHERE age_h >= 24), inc AS (SELECT i.*, bh FROM (SELECT * FROM h WHERE age_h < 24) i LEFT JOIN (SELECT hash, min(event_id) AS bh FROM base GROUP BY hash) USING (hash)),
open AS (SELECT * FROM inc WHERE bh IS NULL),
near AS (SELECT a.event_id, b.event_id AS bv FROM open a JOIN base b ON len(list_intersect(a.es,b.es)) >= 1 AND {COS} >= 25e-2 AND b.age_h <= a.age_h + 48
   QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY {COS} DESC, b.event_id) = 1),
fresh AS (SELECT * FROM open WHERE event_id NOT IN (SELECT event_id FROM near)),
pairs AS (SELECT a.event_id AS a, b.event_id AS b FROM fresh a JOIN fresh b ON a.event_id < b.event_id AND len(list_intersect(a.es,b.es)) >= 1 AND {COS} >= 25e-2), {REACH}
SELECT event_id, coalesce(bh, bv, component, event_id) AS resolved_id, CASE WHEN bh IS NOT NULL THEN 'hash' WHEN bv IS NOT NULL THEN 'vector' ELSE 'new' END AS how
FROM inc LEFT JOIN near USING (event_id) LEFT JOIN comp ON comp.id = event_id""")
def _(t):
    h = t.evt.withColumn("event_hash", text.event_hash(F.concat(F.lit("Event "), (F.col("event_id") % 150).cast("string")), F.array().cast("array<string>")))
    return events.resolve_events(h.filter("age_h < 24"), h.filter("age_h >= 24"), t.evt_entity, DIST)


_MENTION = """SELECT vec_id AS mention_id, label%4 AS type, embedding, CASE WHEN vec_id%4 = 0 THEN concat('ENTITY  ', vec_id%60, '!') WHEN vec_id%4 = 1 THEN concat('aka ', vec_id%60)
   ELSE concat('Unseen ', vec_id%80) END AS name"""


@query("entity_resolve", sql=f"""
WITH known AS (SELECT min(vec_id) AS entity_id, concat('entity ', vec_id%60) AS canonical_name FROM embeddings WHERE label < 5 GROUP BY 2),
ents AS (SELECT entity_id, canonical_name, label%4 AS type, embedding FROM known JOIN embeddings ON vec_id = entity_id),
m AS (SELECT mention_id, type, embedding, trim(regexp_replace(regexp_replace(lower(name),'[^a-z0-9 ]','','g'),' +',' ','g')) AS c FROM ({_MENTION} FROM embeddings WHERE label >= 5)),
s AS (SELECT m.*, k.entity_id AS bn, l.entity_id AS ba FROM m LEFT JOIN known k ON k.canonical_name = c LEFT JOIN known l ON replace(l.canonical_name,'entity','aka') = c),
v AS (SELECT a.mention_id, b.entity_id AS bv FROM s a JOIN ents b ON a.type = b.type AND {COS} >= 25e-2 WHERE bn IS NULL AND ba IS NULL
   QUALIFY row_number() OVER (PARTITION BY a.mention_id ORDER BY {COS} DESC, b.entity_id) = 1),
z AS (SELECT s.*, bv FROM s LEFT JOIN v USING (mention_id))
SELECT mention_id, coalesce(bn, ba, bv, min(mention_id) FILTER (coalesce(bn,ba,bv) IS NULL) OVER (PARTITION BY c)) AS entity_id,
  CASE WHEN bn IS NOT NULL THEN 'name' WHEN ba IS NOT NULL THEN 'alias' WHEN bv IS NOT NULL THEN 'vector' ELSE 'new' END AS how FROM z""")
def _(t):
    e = t.embeddings
    known = e.filter("label < 5").groupBy(F.expr("concat('entity ', vec_id%60)").alias("canonical_name")).agg(F.min("vec_id").alias("entity_id"))
    ents = known.join(e.select(F.col("vec_id").alias("entity_id"), F.expr("label%4").alias("type"), "embedding"), "entity_id")
    aliases = known.select(F.replace("canonical_name", F.lit("entity"), F.lit("aka")).alias("alias"), "entity_id")
    mentions = e.filter("label >= 5").selectExpr(*[x.strip() for x in (
        "vec_id AS mention_id", "label%4 AS type", "embedding",
        "CASE WHEN vec_id%4 = 0 THEN concat('ENTITY  ', vec_id%60, '!') WHEN vec_id%4 = 1 THEN concat('aka ', vec_id%60) ELSE concat('Unseen ', vec_id%80) END AS name")])
    return events.resolve_entities(mentions, ents, aliases, DIST)


@query("intra_article_event_dups", uses="art_evt evt", sql="""
WITH x AS (SELECT article_id, event_id, is_primary, relevance, embedding, row_number() OVER (PARTITION BY article_id ORDER BY is_primary DESC, relevance DESC, event_id) AS r FROM art_evt JOIN evt USING (event_id))
SELECT article_id, event_id FROM x a WHERE r = 1 OR NOT EXISTS (SELECT 1 FROM x b WHERE b.article_id = a.article_id AND b.r < a.r
   AND round(1e0 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) < 95e-2)""")
def _(t):
    rows = t.art_evt.join(t.evt.select("event_id", "embedding"), "event_id").select(
        "article_id", "event_id", F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"), "embedding", "is_primary",
        "relevance", F.lit(2).alias("n_facts"), F.col("event_id").alias("ordinal"))
    return events.drop_repeats_in_article(rows, near=0.95, near_titled=0.95)


@query("entity_links", uses="evt evt_entity art_evt", sql="""
SELECT DISTINCT article_id, entity_id FROM art_evt JOIN evt_entity USING (event_id)""")
def _(t):
    # links of primary events are in place already; the rest is inserted where absent
    links = t.art_evt.join(t.evt_entity, "event_id")
    return links.filter("is_primary").select("article_id", "entity_id").unionByName(
        links.filter("not is_primary").select("article_id", "entity_id")).dropDuplicates(["article_id", "entity_id"])


@query("orphan_events", uses="evt art_evt", sql="""
SELECT event_id FROM evt WHERE event_id NOT IN (SELECT event_id FROM art_evt WHERE relevance > 975e-3)""")
def _(t):
    return t.evt.join(t.art_evt.filter("relevance > 0.975"), "event_id", "left_anti").select("event_id")


@query("orphans", sql="""
SELECT vec_id AS id, 'embedding without summary' AS kind FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'summary without embedding' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(t):
    emb, summ = t.embeddings.select(F.col("vec_id").alias("id")), t.labels.select(F.col("doc_id").alias("id"))
    return emb.join(summ, "id", "left_anti").withColumn("kind", F.lit("embedding without summary")).unionByName(
        summ.join(emb, "id", "left_anti").withColumn("kind", F.lit("summary without embedding")))


@query("entity_extract", sql=r"""
WITH d AS (SELECT doc_id, replace(replace(text, ', ', ' $ACME '), '. ', ' Holdings Inc. ') AS s FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(s,'[A-Z][a-zA-Z0-9\s]+\s+(?:Inc\.?|Corp\.?|Corporation|Company|Ltd\.?|Limited)')) AS name FROM d
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(s,'[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}')) FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(s,'\$[A-Z]{2,6}')) FROM d)
SELECT doc_id, trim(name) AS name, count(*) AS mentions FROM x GROUP BY doc_id, trim(name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, trim(name)) <= 15""")
def _(t):
    planted = t.documents.select("doc_id", F.replace(F.replace("text", F.lit(", "), F.lit(" $ACME ")), F.lit(". "), F.lit(" Holdings Inc. ")).alias("s"))
    return events.extract_entities(planted, "doc_id", "s").select("doc_id", "name", "mentions")


@query("daily_top_entities", uses="arrivals art_evt evt_entity", sql="""
SELECT day, entity_id, articles, position FROM (SELECT day, entity_id, articles, row_number() OVER (PARTITION BY day ORDER BY articles DESC, entity_id) AS position FROM (
  SELECT strftime(published_at,'%Y-%m-%d') AS day, entity_id, count(DISTINCT article_id) AS articles FROM arrivals JOIN art_evt USING (article_id) JOIN evt_entity USING (event_id) GROUP BY ALL)) WHERE position <= 20""")
def _(t):
    hit = t.arrivals.select("article_id", F.date_format("published_at", "yyyy-MM-dd").alias("day")).join(t.art_evt, "article_id").join(t.evt_entity, "event_id")
    n = hit.groupBy("day", "entity_id").agg(F.countDistinct("article_id").alias("articles"))
    return top_k(n, ["day"], [F.desc("articles"), F.asc("entity_id")], 20, rank="position").withColumn("position", F.col("position").cast("long"))
