"""Digest queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import digest, events
from newsloom.operators.ranking import first_rows, top_k
from newsloom.plans.events import COS, DIST, RELATED
from newsloom.plans.registry import query
from newsloom.sources.tables import as_of

TARGET = "2024-01-30"
MODE = """CASE WHEN user_id%5 = 0 THEN 'full_previous_day' WHEN user_id%5 = 1 THEN 'full_previous_2_days' WHEN user_id%5 = 2 THEN '24h' WHEN user_id%5 = 3 THEN '72h' ELSE 'weekly' END"""


def _mid(d: str) -> str:
    return f"epoch(timezone(tz, TIMESTAMP '{d} 00:00:00'))::BIGINT"


WINDOW = f"""win AS (SELECT user_id, CASE m WHEN 'full_previous_day' THEN {_mid('2024-01-29')} WHEN 'full_previous_2_days' THEN {_mid('2024-01-28')}
    ELSE {_mid('2024-01-31')} - CASE m WHEN '24h' THEN 24 WHEN '72h' THEN 72 ELSE 48 END*3600 END AS start_s,
  CASE WHEN m IN ('full_previous_day','full_previous_2_days') THEN {_mid('2024-01-30')} ELSE {_mid('2024-01-31')} END AS end_s FROM (SELECT *, {MODE} AS m FROM users))"""


def _windows(t):
    return digest.windows(t.users.withColumn("window_mode", F.expr(MODE)), F.lit(TARGET).cast("date"))


@query("digest_window", uses="users", sql=f"WITH {WINDOW} SELECT * FROM win")
def _(t):
    return _windows(t).select("user_id", "start_s", "end_s")


ELIGIBLE = """hits AS (SELECT DISTINCT u.user_id, l.topic_id, a.article_id, a.t, a.topic_id AS own, w.start_s, w.end_s, (NOT EXISTS (SELECT 1 FROM user_lang x WHERE x.user_id = u.user_id)
    OR EXISTS (SELECT 1 FROM user_lang x WHERE x.user_id = u.user_id AND x.language = a.language)) AS lang_ok
  FROM user_topic u JOIN win w USING (user_id) JOIN art_topic l ON l.topic_id = u.topic_id JOIN (SELECT *, epoch(published_at)::BIGINT AS t FROM art WHERE SUMMARY) a ON a.article_id = l.article_id
  WHERE a.t >= w.start_s AND a.t < w.end_s)"""


@query("digest_articles", uses="users user_topic user_lang art art_topic", sql=f"""
WITH {WINDOW}, {ELIGIBLE.replace('SUMMARY', "analyzer_status = 'completed'")}
SELECT user_id, topic_id, count(*) AS n, arg_max(article_id, (t, article_id)) AS newest FROM hits WHERE lang_ok GROUP BY 1, 2""")
def _(t):
    done = digest.near_date(t.art, TARGET).filter("analyzer_status = 'completed'").select("article_id", "language", "published_at")
    return digest.article_counts(done, t.art_topic, digest.wishes(_windows(t), t.user_topic, t.user_lang))


@query("digest_fallback_articles", uses="users user_topic user_lang art art_topic", sql=f"""
WITH {WINDOW}, {ELIGIBLE.replace('SUMMARY', "summary_status = 'completed'")},
own AS (SELECT *, bool_or(own = topic_id) OVER (PARTITION BY user_id, topic_id) AS has_own FROM hits)
SELECT user_id, topic_id, article_id, row_number() OVER (PARTITION BY user_id, topic_id ORDER BY t DESC, article_id) AS position FROM own WHERE lang_ok AND (own = topic_id OR NOT has_own) QUALIFY position <= 30""")
def _(t):
    done = digest.near_date(t.art, TARGET).filter("summary_status = 'completed'").select("article_id", "language", "published_at", "topic_id")
    out = digest.fallback_articles(done, t.art_topic, digest.wishes(_windows(t), t.user_topic, t.user_lang))
    return out.select("user_id", "topic_id", "article_id", F.col("position").cast("long").alias("position"))


TOPIC_NO = "CASE topic WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"


@query("digest_top_events", uses="users user_topic arrivals art_evt evt", sql=f"""
WITH {WINDOW}, {RELATED}, a AS (SELECT article_id, {TOPIC_NO} AS topic_id, epoch_us(published_at)/1000000 AS t FROM arrivals),
cls AS (SELECT DISTINCT topic_id, start_s, end_s FROM user_topic JOIN win USING (user_id)),
s AS (SELECT topic_id, start_s, end_s, event_id, 2e0*count(*) FILTER (is_primary) + count(*) FILTER (NOT is_primary) AS score FROM cls JOIN a USING (topic_id) JOIN art_evt USING (article_id) WHERE t >= start_s AND t < end_s GROUP BY ALL),
b AS (SELECT s.topic_id, start_s, end_s, event_id, score + 5e-1*coalesce(related,0) AS score FROM s LEFT JOIN related USING (event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, start_s, end_s ORDER BY score DESC, event_id) AS position FROM b QUALIFY position <= 3)
SELECT user_id, topic_id, event_id, score, position FROM user_topic JOIN win USING (user_id) JOIN r USING (topic_id, start_s, end_s)""")
def _(t):
    a = digest.near_date(t.arrivals, TARGET).select("article_id", "published_at", F.expr(TOPIC_NO).cast("long").alias("topic_id"))
    related = events.related_counts(t.evt, t.art_evt, as_of(), DIST)
    out = digest.top_events(a, t.art_evt, digest.wishes(_windows(t), t.user_topic, t.user_lang), related)
    return out.withColumn("position", F.col("position").cast("long"))


GROUPS = """g AS (SELECT topic, event_id, count(*) FILTER (is_primary) AS primary_mentions, count(*) FILTER (NOT is_primary) AS secondary_mentions,
   2e0*count(*) FILTER (is_primary) + count(*) FILTER (NOT is_primary) AS score, count(*) AS total_articles FROM arrivals JOIN art_evt USING (article_id) GROUP BY topic, event_id)"""
SELECTED = f"""{GROUPS}, tp AS (SELECT topic, sum(score) AS topic_score, row_number() OVER (ORDER BY sum(score) DESC, topic) AS topic_position FROM g GROUP BY topic QUALIFY topic_position <= 4),
sel AS (SELECT topic, event_id, score, topic_score, topic_position, row_number() OVER (PARTITION BY topic ORDER BY score DESC, event_id) AS event_position FROM g JOIN tp USING (topic) QUALIFY event_position <= 3)"""


@query("topic_event_groups", uses="arrivals art_evt", sql=f"WITH {GROUPS} SELECT * FROM g")
def _(t):
    return digest.topic_event_groups(t.arrivals, t.art_evt)


def _selected(t):
    out = digest.select_content(digest.topic_event_groups(t.arrivals, t.art_evt))
    return out.select("topic", "event_id", "score", "topic_score", F.col("topic_position").cast("long").alias("topic_position"), F.col("event_position").cast("long").alias("event_position"))


@query("digest_select", uses="arrivals art_evt", sql=f"WITH {SELECTED} SELECT * FROM sel")
def _(t):
    return _selected(t)


@query("digest_nested", uses="arrivals art_evt", sql=f"""
WITH {SELECTED}, d AS (SELECT topic, event_id, strftime(min(published_at),'%Y-%m-%d') AS first_day, strftime(max(published_at),'%Y-%m-%d') AS last_day FROM arrivals JOIN art_evt USING (article_id) GROUP BY 1, 2),
s AS (SELECT topic, topic_score, topic_position, list({{'event_id': event_id, 'score': score::BIGINT, 'first_day': first_day, 'last_day': last_day}} ORDER BY event_position) AS stories FROM sel JOIN d USING (topic, event_id) GROUP BY ALL)
SELECT topic_position, to_json({{'topic': topic, 'score': topic_score::BIGINT, 'stories': stories}})::VARCHAR AS document FROM s""")
def _nested(t):
    # at most four topics of three stories: the lists are bounded by the selection
    sel = _selected(t)
    days = t.arrivals.join(t.art_evt, "article_id").join(sel.select("topic", "event_id"), ["topic", "event_id"], "left_semi").groupBy("topic", "event_id").agg(
        F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("last_day"))
    story = F.struct("event_position", "event_id", F.col("score").cast("long").alias("score"), "first_day", "last_day")
    nested = sel.join(days, ["topic", "event_id"]).groupBy("topic", "topic_score", "topic_position").agg(F.array_sort(F.collect_list(story)).alias("xs"))
    stories = F.transform("xs", lambda x: F.struct(x["event_id"].alias("event_id"), x["score"].alias("score"), x["first_day"].alias("first_day"), x["last_day"].alias("last_day")))
    return nested.select("topic_position", F.to_json(F.struct("topic", F.col("topic_score").cast("long").alias("score"), stories.alias("stories"))).alias("document"))


@query("digest_coverage", uses="arrivals art_evt", sql=f"""
WITH {SELECTED}, u AS (SELECT topic, count(DISTINCT article_id) AS used FROM sel JOIN art_evt USING (event_id) JOIN (SELECT article_id, topic FROM arrivals) a USING (article_id, topic) GROUP BY topic)
SELECT topic, count(*) AS available, coalesce(max(used), 0) AS used FROM arrivals LEFT JOIN u USING (topic) GROUP BY topic""")
def _(t):
    a = t.arrivals.select("article_id", "topic")
    used = _selected(t).select("topic", "event_id").join(t.art_evt.select("article_id", "event_id"), "event_id").join(a, ["article_id", "topic"]).groupBy("topic").agg(
        F.countDistinct("article_id").alias("used"))
    return a.groupBy("topic").agg(F.count("*").alias("available")).join(used, "topic", "left").fillna(0, ["used"])


@query("recommended_articles", uses="arrivals art_evt", sql="""
WITH r AS (SELECT event_id, article_id, publication_id AS source, published_at, accepted AS s, bool_or(accepted) OVER (PARTITION BY event_id) AS any_s FROM art_evt JOIN arrivals USING (article_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, source ORDER BY published_at DESC, article_id) AS n FROM r WHERE s OR NOT any_s)
SELECT event_id, article_id, row_number() OVER (PARTITION BY event_id ORDER BY n > 1, published_at DESC, article_id) AS position FROM f QUALIFY position <= 3""")
def _(t):
    rows = t.art_evt.join(t.arrivals, "article_id").select("event_id", "article_id", F.col("publication_id").alias("source"), "published_at", F.col("accepted").alias("has_summary"))
    return digest.recommended(rows).withColumn("position", F.col("position").cast("long"))


REL_ART = f"""nb AS (SELECT a.event_id AS x, b.event_id AS y FROM evt a JOIN evt b ON a.event_id <> b.event_id WHERE {COS} >= 25e-2), hd AS (SELECT * FROM art_evt QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY relevance DESC, article_id) <= 2),
ra AS (SELECT x AS event_id, h.article_id, y AS from_event, h.relevance FROM nb JOIN hd h ON h.event_id = y WHERE NOT EXISTS (SELECT 1 FROM art_evt o WHERE o.event_id = x AND o.article_id = h.article_id)),
r1 AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY event_id, article_id ORDER BY relevance DESC, from_event) = 1),
rel AS (SELECT event_id, article_id, from_event, row_number() OVER (PARTITION BY event_id ORDER BY relevance DESC, article_id) AS position FROM r1 QUALIFY position <= 3)"""


def _related(t):
    return digest.related_articles(t.art_evt, t.evt.select("event_id", "embedding"), DIST).select("event_id", "article_id", "from_event", F.col("position").cast("long").alias("position"))


@query("related_articles", uses="evt art_evt", sql=f"WITH {REL_ART} SELECT * FROM rel")
def _(t):
    return _related(t)


@query("evidence_set", uses="evt art_evt", sql=f"""
WITH {REL_ART} SELECT event_id, article_id, CASE WHEN is_primary THEN 'PRIMARY' ELSE 'SECONDARY' END AS tier FROM art_evt UNION ALL SELECT event_id, article_id, 'RELATED' FROM rel""")
def _(t):
    own = t.art_evt.select("event_id", "article_id", F.when(F.col("is_primary"), "PRIMARY").otherwise("SECONDARY").alias("tier"))
    return own.unionByName(_related(t).select("event_id", "article_id", F.lit("RELATED").alias("tier")))


_SAID = "list_filter(string_split(content, chr(10)), lambda x: length(trim(x)) {})"


@query("evidence_facts", uses="evt art_evt art", sql=f"""
WITH {REL_ART}, ev AS (SELECT event_id, article_id, CASE WHEN is_primary THEN 0 ELSE 1 END AS tier FROM art_evt UNION ALL SELECT event_id, article_id, 2 FROM rel),
fx AS (SELECT article_id, {_SAID.format(">= 40")}[1:6] AS facts, {_SAID.format("BETWEEN 1 AND 39")}[1:4] AS opinions FROM art),
xs AS (SELECT event_id, tier, article_id, 'fact' AS kind, CASE WHEN tier = 2 THEN facts[1:2] ELSE facts END AS x FROM ev JOIN fx USING (article_id)
 UNION ALL SELECT event_id, tier, article_id, 'opinion', CASE WHEN tier = 2 THEN opinions[1:1] ELSE opinions END FROM ev JOIN fx USING (article_id)),
it AS (SELECT event_id, tier, article_id, kind, unnest(x) AS body, generate_subscripts(x, 1) AS pos FROM xs),
one AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY event_id, kind, body ORDER BY tier, article_id, pos) = 1)
SELECT event_id, kind, (row_number() OVER (PARTITION BY event_id, kind ORDER BY tier, article_id, pos))::INT AS ordinal, ['PRIMARY','SECONDARY','RELATED'][tier + 1] AS tier, md5(body) AS body_md5 FROM one""")
def _(t):
    own = t.art_evt.select("event_id", "article_id", F.when(F.col("is_primary"), "PRIMARY").otherwise("SECONDARY").alias("tier"))
    links = own.unionByName(_related(t).select("event_id", "article_id", F.lit("RELATED").alias("tier")))
    lines = F.split("content", "\n")
    n = lambda x: F.length(F.trim(x))
    said = t.art.select("article_id", F.slice(F.filter(lines, lambda x: n(x) >= 40), 1, 6).alias("facts"), F.slice(F.filter(lines, lambda x: n(x).between(1, 39)), 1, 4).alias("opinions"))
    return digest.evidence(links, said).select("event_id", "kind", "ordinal", "tier", F.md5("body").alias("body_md5"))


@query("enhance_needed", uses="art_evt", sql="""
WITH st AS (SELECT event_id, article_id FROM art_evt WHERE relevance <= 9e-1 OR event_id < 300), d AS (SELECT event_id, count(*) FILTER (s.article_id IS NULL) AS changed FROM art_evt c LEFT JOIN st s USING (event_id, article_id) GROUP BY event_id)
SELECT event_id, NOT (changed = 0 AND (event_id%12) < 6) AS needed FROM d""")
def _(t):
    stored = t.art_evt.filter("relevance <= 0.9 OR event_id < 300")
    at = t.art_evt.select("event_id").distinct().withColumn("stored_s", F.unix_seconds(as_of()) - (F.col("event_id") % 12) * 3600)
    return digest.needs_enhancing(stored, t.art_evt, at, F.unix_seconds(as_of()))


@query("story_recommend_map", uses="arrivals art_evt", sql="""
WITH ids AS (SELECT event_id, unnest([(event_id*31)%5000, (event_id*7)%10000, event_id*5]) AS article_id, unnest([1,2,3]) AS i FROM (SELECT DISTINCT event_id FROM art_evt)),
hit AS (SELECT ids.event_id, ids.article_id FROM ids JOIN art_evt USING (event_id, article_id) QUALIFY row_number() OVER (PARTITION BY ids.event_id ORDER BY i) = 1),
rest AS (SELECT event_id, article_id FROM art_evt JOIN arrivals USING (article_id) WHERE event_id NOT IN (SELECT event_id FROM hit) AND article_id NOT IN (SELECT article_id FROM hit)
   QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC, article_id) = 1)
SELECT event_id, article_id, 'model' AS how FROM hit UNION ALL SELECT event_id, article_id, 'fallback' FROM rest""")
def _(t):
    # the model names article ids as a JSON list; the first that belongs to the event is taken
    ev = t.art_evt.select("event_id").distinct()
    reply = F.to_json(F.expr("array((event_id*31)%5000, (event_id*7)%10000, event_id*5)"))
    ids = ev.select("event_id", F.posexplode(F.from_json(reply, "array<long>")).alias("i", "article_id"))
    hit = top_k(ids.join(t.art_evt.select("event_id", "article_id"), ["event_id", "article_id"], "left_semi"), ["event_id"], [F.asc("i")], 1).select("event_id", "article_id")
    rest = t.art_evt.select("event_id", "article_id").join(hit.select("event_id"), "event_id", "left_anti").join(hit.select("article_id"), "article_id", "left_anti")
    first = top_k(rest.join(t.arrivals.select("article_id", "published_at"), "article_id"), ["event_id"], [F.desc("published_at"), F.asc("article_id")], 1)
    return hit.withColumn("how", F.lit("model")).unionByName(first.select("event_id", "article_id", F.lit("fallback").alias("how")))


# --- users -------------------------------------------------------------------------------


@query("digest_user_topics", uses="users user_topic", sql="""
SELECT user_id, topic_id, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic_id) AS position FROM user_topic JOIN users USING (user_id) QUALIFY position <= max(max_topics) OVER (PARTITION BY user_id)""")
def _(t):
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("weight"), F.asc("topic_id")))
    return t.user_topic.join(t.users.select("user_id", "max_topics"), "user_id").withColumn("position", place).filter("position <= max_topics").select(
        "user_id", "topic_id", F.col("position").cast("long").alias("position"))


DIGESTS = "dig AS (SELECT o_orderkey AS digest_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, o_orderdate AS day FROM orders)"


def _digests(t):
    return t.orders.select(F.col("o_orderkey").alias("digest_id"), F.col("o_custkey").alias("user_id"),
                           F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending").alias("status"),
                           F.col("o_orderdate").alias("day"))


REASON = """CASE WHEN NOT digest_enabled THEN 'disabled' WHEN user_id NOT IN (SELECT user_id FROM user_topic) THEN 'no_topics'
   WHEN user_id IN (SELECT user_id FROM dig WHERE status = 'completed' AND day >= DATE '1998-07-01' AND day < DATE '1998-09-01') THEN 'already_done' ELSE 'eligible' END"""


def _reasons(t):
    has = t.user_topic.select("user_id").distinct().withColumn("has_topics", F.lit(True))
    done = _digests(t).filter("status = 'completed' AND day >= '1998-07-01' AND day < '1998-09-01'").select("user_id").distinct().withColumn("done", F.lit(True))
    j = t.users.select("user_id", "digest_enabled").join(has, "user_id", "left").join(done, "user_id", "left")
    return j.select("user_id", F.when(~F.col("digest_enabled"), "disabled").when(F.col("has_topics").isNull(), "no_topics")
                    .when(F.col("done"), "already_done").otherwise("eligible").alias("reason"))


@query("digest_ineligible_reason", uses="users user_topic", sql=f"WITH {DIGESTS} SELECT user_id, {REASON} AS reason FROM users")
def _(t):
    return _reasons(t)


@query("digest_eligible_users", uses="users user_topic", sql=f"WITH {DIGESTS} SELECT reason, count(*) AS users FROM (SELECT {REASON} AS reason FROM users) GROUP BY reason")
def _(t):
    return _reasons(t).groupBy("reason").agg(F.count("*").alias("users"))


@query("latest_digest", sql=f"""
WITH {DIGESTS} SELECT user_id, digest_id, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, digest_id DESC) AS position FROM dig WHERE status = 'completed' QUALIFY position <= 7""")
def _(t):
    return top_k(_digests(t).filter("status = 'completed'"), ["user_id"], [F.desc("day"), F.desc("digest_id")], 7, rank="position").select(
        "user_id", "digest_id", F.col("position").cast("long").alias("position"))


@query("digest_strategy", uses="users user_topic arrivals art_evt", sql=f"""
WITH e AS (SELECT {TOPIC_NO} AS topic_id, count(*) AS n FROM arrivals JOIN art_evt USING (article_id) GROUP BY 1), u AS (SELECT user_id, max(n) AS n FROM user_topic LEFT JOIN e USING (topic_id) GROUP BY user_id)
SELECT user_id, coalesce(strategy, 'default') AS asked, CASE WHEN strategy = 'articles' THEN 'articles' WHEN n IS NULL THEN 'articles' ELSE 'events' END AS used FROM users LEFT JOIN u USING (user_id)""")
def _(t):
    n = t.arrivals.join(t.art_evt, "article_id").groupBy(F.expr(TOPIC_NO).cast("long").alias("topic_id")).agg(F.count("*").alias("n"))
    has = t.user_topic.join(n, "topic_id").select("user_id").distinct().withColumn("has_events", F.lit(True))
    s = F.col("strategy")
    return t.users.join(has, "user_id", "left").select(
        "user_id", F.coalesce(s, F.lit("default")).alias("asked"),
        F.when(s == "articles", "articles").when(F.col("has_events").isNull(), "articles").otherwise("events").alias("used"))


@query("reading_time", sql=r"""
SELECT conv_id, sum(n)::BIGINT AS words, greatest(1, round_even(sum(n)/2e2, 0))::BIGINT AS minutes FROM (SELECT conv_id, len(regexp_extract_all(text, '\S+')) AS n FROM conversations) GROUP BY conv_id""")
def _(t):
    n = F.sum(F.regexp_count("text", F.lit(r"\S+")))
    return t.conversations.groupBy("conv_id").agg(n.alias("words"), F.greatest(F.lit(1), F.bround(n / 200.0, 0)).cast("long").alias("minutes"))


@query("digest_metrics", uses="arrivals art_evt art", sql=f"""
WITH {SELECTED}, used AS (SELECT DISTINCT topic, event_id, article_id FROM sel JOIN art_evt USING (event_id) JOIN (SELECT article_id, topic FROM arrivals) a USING (article_id, topic)),
c AS (SELECT DISTINCT topic, article_id, process_cost FROM used JOIN (SELECT article_id, process_cost FROM art) p USING (article_id)),
k AS (SELECT coalesce(topic, 'all') AS topic, round(sum(process_cost), 6) AS cost FROM c GROUP BY GROUPING SETS ((topic), ())),
e AS (SELECT coalesce(topic, 'all') AS topic, count(*) AS stories, sum(score)::BIGINT AS score FROM sel GROUP BY GROUPING SETS ((topic), ())),
u AS (SELECT coalesce(topic, 'all') AS topic, count(DISTINCT article_id) AS articles FROM used GROUP BY GROUPING SETS ((topic), ()))
SELECT topic, stories, score, articles, cost FROM e JOIN u USING (topic) LEFT JOIN k USING (topic)""")
def _(t):
    # from the digest documents themselves
    shape = "topic string, score long, stories array<struct<event_id:long,score:long,first_day:string,last_day:string>>"
    doc = _nested(t).select(F.from_json("document", shape).alias("d")).select("d.topic", F.explode("d.stories").alias("s")).select("topic", "s.event_id", F.col("s.score").alias("score"))
    used = doc.join(t.art_evt.select("event_id", "article_id"), "event_id").join(t.arrivals.select("article_id", "topic"), ["article_id", "topic"])
    used = used.select("topic", "article_id").distinct().join(t.art.select("article_id", "process_cost"), "article_id", "left")
    total = F.coalesce("topic", F.lit("all")).alias("topic")
    stories = doc.rollup("topic").agg(F.count("*").alias("stories"), F.sum("score").alias("score")).select(total, "stories", "score")
    articles = used.rollup("topic").agg(F.countDistinct("article_id").alias("articles"), F.round(F.sum("process_cost"), 6).alias("cost")).select(total, "articles", "cost")
    return stories.join(articles, "topic")
