"""Feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import feed
from newsloom.operators.ranking import first_rows, top_k
from newsloom.plans.registry import query
from newsloom.sources.tables import as_of

NEWEST = ("published_at DESC, article_id")
BASE_SQL = """base AS (SELECT * FROM art WHERE (triage_status IN ('accepted','promoted') OR is_top_headline)
   AND summary_status = 'completed')"""


def newest():
    return [F.desc("published_at"), F.asc("article_id")]


@query("feed_base", uses="art art_topic", sql=f"""
WITH {BASE_SQL} SELECT b.article_id, b.publication_id, array_to_string(list_sort(list(l.topic_id)), ',') AS topics
FROM base b JOIN art_topic l USING (article_id) GROUP BY ALL""")
def _(t):
    return feed.with_topics(feed.base(t.art), t.art_topic).select(
        "article_id", "publication_id", F.array_join(F.col("topic_ids").cast("array<string>"), ",").alias("topics"))


@query("feed_search", uses="art", sql="""
SELECT article_id FROM art WHERE contains(lower(title),'thetion') OR contains(lower(description),'thetion')
  OR contains(lower(content),'thetion') OR contains(lower(publication_id),'thetion') OR contains(lower(language),'thetion')""")
def _(t):
    return feed.search(t.art, "TheTION", ["title", "description", "content", "publication_id", "language"]).select("article_id")


@query("feed_since", uses="art", sql=f"""
WITH {BASE_SQL} SELECT article_id FROM base WHERE published_at > (SELECT published_at FROM base ORDER BY article_id LIMIT 1)""")
def _(t):
    shown = feed.base(t.art)
    ref = shown.agg(F.min_by("published_at", "article_id")).scalar()
    return feed.published_after(shown, ref).select("article_id")


@query("feed_since_count", uses="art", sql=f"""
WITH {BASE_SQL} SELECT count(*) AS new_count FROM base WHERE published_at > TIMESTAMP '2024-01-30 00:00:00'""")
def _(t):
    return feed.published_after(feed.base(t.art), F.lit("2024-01-30 00:00:00").cast("timestamp")).agg(F.count("*").alias("new_count"))


@query("public_feed", uses="art pub_region", sql=f"""
WITH {BASE_SQL} SELECT article_id, row_number() OVER (ORDER BY {NEWEST}) AS position FROM base
WHERE publication_id IN (SELECT publication_id FROM pub_region WHERE region_code = 'us') AND image_url IS NOT NULL AND image_url <> ''
ORDER BY {NEWEST} LIMIT 20""")
def _(t):
    shown = feed.with_region(feed.base(t.art), t.pub_region, ["us"]).filter("image_url is not null and image_url <> ''")
    return first_rows(shown.select("article_id", "published_at"), newest(), 20, rank="position").select(
        "article_id", F.col("position").cast("long").alias("position"))


@query("semi_topic", uses="art art_topic topic", sql="""
SELECT article_id FROM art WHERE article_id IN (SELECT article_id FROM art_topic JOIN topic USING (topic_id)
  WHERE slug IN ('nation_3','nation_5'))""")
def _(t):
    return feed.with_topic(t.art, t.art_topic, t.topic.filter(F.col("slug").isin("nation_3", "nation_5"))).select("article_id")


@query("semi_region", uses="art pub_region", sql="""
SELECT article_id FROM art WHERE publication_id IN (SELECT publication_id FROM pub_region WHERE region_code IN ('us','br'))""")
def _(t):
    return feed.with_region(t.art, t.pub_region, ["us", "br"]).select("article_id")


@query("date_region", uses="art pub_region", sql="""
SELECT article_id, published_at::DATE::VARCHAR AS day FROM art WHERE published_at::DATE BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'
  AND publication_id IN (SELECT publication_id FROM pub_region WHERE region_code = 'de')""")
def _(t):
    inside = t.art.filter("published_at >= timestamp'2024-01-29' AND published_at < timestamp'2024-01-31'")
    return feed.with_region(inside, t.pub_region, ["de"]).select("article_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("personal_feed", uses="art art_topic user_topic user_lang user_pub", sql=f"""
WITH {BASE_SQL}, hits AS (SELECT DISTINCT u.user_id, b.article_id, b.published_at FROM user_topic u
  JOIN art_topic l ON l.topic_id = u.topic_id JOIN base b ON b.article_id = l.article_id
  WHERE (NOT EXISTS (SELECT 1 FROM user_lang x WHERE x.user_id = u.user_id)
      OR EXISTS (SELECT 1 FROM user_lang x WHERE x.user_id = u.user_id AND x.language = b.language))
    AND (NOT EXISTS (SELECT 1 FROM user_pub x WHERE x.user_id = u.user_id)
      OR EXISTS (SELECT 1 FROM user_pub x WHERE x.user_id = u.user_id AND x.publication_id = b.publication_id)))
SELECT user_id, article_id, position FROM (SELECT user_id, article_id,
   row_number() OVER (PARTITION BY user_id ORDER BY {NEWEST}) AS position FROM hits) WHERE position <= 20""")
def _(t):
    return feed.personal_feeds(feed.base(t.art), t.art_topic, t.user_topic, t.user_lang, t.user_pub).select(
        "user_id", "article_id", F.col("position").cast("long").alias("position"))


RANK_SQL = """ranked AS (SELECT article_id, p.publication_id, cluster_id, published_at, language, round(
   (CASE WHEN headline_score > 0 THEN headline_score ELSE greatest(0e0, least(coalesce(authority,1e0),1e1))/1e1*7e-1 END) *
   (CASE WHEN age_s <= 21600 THEN 1e0 WHEN age_s <= 43200 THEN 9e-1 WHEN age_s <= 86400 THEN 75e-2 WHEN age_s <= 172800 THEN 5e-1 ELSE 25e-2 END), 9) AS rank_score
   FROM (POOL) p LEFT JOIN pub USING (publication_id))"""


def _fold_sql(part: str, pool: str, cap: int, pre: str) -> str:
    """The first-wins walk as a recursion over positions that carries the kept stories and sources."""
    return f"""WITH RECURSIVE {pre}{RANK_SQL.replace('POOL', pool)},
o AS (SELECT *, {part} AS g, row_number() OVER (PARTITION BY {part} ORDER BY rank_score DESC, published_at DESC, article_id) AS i FROM ranked),
w AS (SELECT g, 0::BIGINT AS i, NULL::BIGINT AS article_id, false AS keep, []::BIGINT[] AS stories, []::VARCHAR[] AS sources FROM (SELECT DISTINCT g FROM o)
 UNION ALL SELECT g, i, article_id, k, CASE WHEN k THEN list_append(stories, cluster_id) ELSE stories END,
   CASE WHEN k THEN list_append(sources, publication_id) ELSE sources END
 FROM (SELECT w.g, o.i, o.article_id, o.cluster_id, o.publication_id, w.stories, w.sources,
         NOT list_contains(w.stories, o.cluster_id) AND len(list_filter(w.sources, lambda s: s = o.publication_id)) < {cap} AS k
       FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1)),
kept AS (SELECT g, article_id, row_number() OVER (PARTITION BY g ORDER BY i) AS position FROM w WHERE keep)"""


@query("relevance_page", uses="art pub", sql=_fold_sql("1", "SELECT * FROM base", 5, BASE_SQL + ", ") + """
SELECT k.article_id, position, rank_score, (SELECT max(position) FROM kept) > 40 AS has_next FROM kept k JOIN ranked USING (article_id) WHERE position BETWEEN 21 AND 40""")
def _(t):
    return feed.relevance_page(feed.base(t.art), t.pub, as_of(), page=2).select("article_id", "position", "rank_score", "has_next")


@query("diversify_fold", uses="art pub", sql=_fold_sql(
    "language", "SELECT * FROM art", 2, "") + """
SELECT g AS language, article_id, position FROM kept WHERE position <= 30""")
def _(t):
    rows = t.art.select("article_id", "publication_id", "cluster_id", "published_at", "language", "headline_score")
    ranked = feed.relevance(rows, t.pub, as_of()).drop("headline_score")
    pool = feed.walk_pool(ranked, ["language"], feed.rank_order(), 30, 2)
    kept = feed.diversify_fold(pool, ["language"], ["rank_score", "published_at", "article_id"], [False, False, True], 2)
    return kept.filter("position <= 30").select("language", "article_id", "position")


@query("diversify_windows", uses="art pub", sql=f"""
WITH {RANK_SQL.replace('POOL', 'SELECT * FROM art')},
a AS (SELECT *, row_number() OVER (PARTITION BY language, cluster_id ORDER BY rank_score DESC, published_at DESC, article_id) AS c FROM ranked),
b AS (SELECT *, row_number() OVER (PARTITION BY language, publication_id ORDER BY rank_score DESC, published_at DESC, article_id) AS s FROM a WHERE c = 1)
SELECT language, article_id, rank_score FROM b WHERE s <= 2""")
def _(t):
    ranked = feed.relevance(t.art.select("article_id", "publication_id", "cluster_id", "published_at", "language", "headline_score"), t.pub, as_of())
    return feed.diversify_windows(ranked, ["language"], feed.rank_order(), 2).select("language", "article_id", "rank_score")


@query("diversified_page", uses="art", sql=f"""
WITH {BASE_SQL}, s AS (SELECT article_id, publication_id, cluster_id, row_number() OVER (ORDER BY {NEWEST}) AS scan FROM base
   QUALIFY scan > 20),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY scan) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY publication_id ORDER BY scan) <= 5),
p AS (SELECT article_id, row_number() OVER (ORDER BY scan) AS position, count(*) OVER () > 20 AS has_next FROM b)
SELECT * FROM p WHERE position <= 20""")
def _(t):
    return feed.diversified_page(feed.base(t.art), newest(), page=2, size=20).select(
        "article_id", F.col("position").cast("long").alias("position"), "has_next")


@query("page_slice", uses="art", sql=f"""
WITH {BASE_SQL}, n AS (SELECT greatest(ceil(count(*)/25)::BIGINT, 1) AS pages FROM base)
SELECT article_id, pages AS page, pages AS total_pages FROM (SELECT article_id, pages, row_number() OVER (ORDER BY {NEWEST}) AS rn FROM base, n)
WHERE rn > (pages-1)*25 AND rn <= pages*25""")
def _(t):
    return feed.page_slice(feed.base(t.art).select("article_id", "published_at"), newest(), page=10**6, size=25).drop("published_at")


@query("pub_recommended", uses="pub", sql="""
SELECT publication_id, authority FROM pub ORDER BY authority DESC, publication_id LIMIT 10""")
def _(t):
    return first_rows(t.pub.select("publication_id", "authority"), [F.desc("authority"), F.asc("publication_id")], 10)


@query("snapshot_diff", uses="art", sql="""
WITH old AS (SELECT article_id, title, headline_score FROM art WHERE publication_id <> 'src3'),
new AS (SELECT article_id, title, CASE WHEN topic_id = 2 THEN headline_score + 1e0 ELSE headline_score END AS headline_score FROM art WHERE topic_id <> 6)
SELECT n.article_id, CASE WHEN o.article_id IS NULL THEN 'new' WHEN n.headline_score = o.headline_score THEN 'same' ELSE 'updated' END AS change
FROM new n LEFT JOIN old o USING (article_id)""")
def _(t):
    a = t.art.select("article_id", "title", "headline_score", "publication_id", "topic_id")
    new = a.filter("topic_id <> 6").withColumn("headline_score", F.expr("headline_score + IF(topic_id = 2, 1e0, 0e0)"))
    return feed.snapshot_diff(a.filter("publication_id <> 'src3'"), new, "article_id", ["title", "headline_score"])


@query("prefs_replace", uses="user_topic topic", sql="""
WITH inc AS (SELECT DISTINCT c_custkey AS user_id, c_custkey%30 AS topic_id FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT user_id, topic_id::BIGINT AS topic_id FROM user_topic WHERE user_id NOT IN (SELECT user_id FROM inc)
UNION ALL SELECT user_id, topic_id FROM inc WHERE topic_id IN (SELECT topic_id FROM topic)""")
def _(t):
    incoming = t.customer.filter("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS user_id", "c_custkey%30 AS topic_id")
    return feed.replace_preferences(t.user_topic, incoming, t.topic.selectExpr("bigint(topic_id) AS topic_id"), "user_id", "topic_id")


@query("prefs_merge", uses="users", sql="""
SELECT user_id, max_topics, coalesce(strategy, 'articles') AS strategy,
  CASE WHEN user_id%3 = 0 THEN 24 ELSE 72 END::BIGINT AS window_h, digest_enabled FROM users""")
def _(t):
    # stored preferences are JSON text with any subset of keys; missing keys take the defaults
    stored = F.to_json(F.struct(F.col("max_topics"), F.col("strategy"), F.when(F.col("user_id") % 3 == 0, F.lit(24)).alias("window_h")))
    prefs = F.from_json(stored, "max_topics long, strategy string, window_h long")
    return t.users.select("user_id", "digest_enabled", prefs.alias("p")).select(
        "user_id", F.coalesce("p.max_topics", F.lit(5)).cast("long").alias("max_topics"),
        F.coalesce("p.strategy", F.lit("articles")).alias("strategy"), F.coalesce("p.window_h", F.lit(72)).cast("long").alias("window_h"), "digest_enabled")
