"""Triage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import triage
from newsloom.operators.ranking import rolling_count
from newsloom.plans.registry import ORACLES, query
from newsloom.plans import text_columns  # noqa: F401  (title rule text)

DAY = "TIMESTAMP '2024-01-30 00:00:00'"
NOW_S = 1706659200


def day_start():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def now():
    return F.timestamp_seconds(F.lit(NOW_S))


PUB = f"""pc AS (SELECT publication_id, count(*) AS accepted_24h FROM art WHERE triage_status = 'accepted' AND triaged_at >= {DAY}
   AND triage_method IS DISTINCT FROM 'legacy' GROUP BY publication_id)"""
TOP = f"""tc AS (SELECT l.topic_id, count(DISTINCT l.article_id) AS accepted_today FROM art_topic l JOIN art USING (article_id)
   WHERE triage_status = 'accepted' AND triaged_at >= {DAY} GROUP BY l.topic_id)"""
TADJ = """ta AS (SELECT article_id, max(CASE WHEN coalesce(accepted_today,0) < 5 THEN 1e-1 WHEN coalesce(accepted_today,0) > 30 THEN -5e-2 ELSE 0e0 END) AS topic_adj
   FROM art_topic LEFT JOIN tc USING (topic_id) GROUP BY article_id)"""
# the title rule, unrounded, as in the title_quality query
_TITLE = ORACLES["title_quality"].split("round(", 1)[1].rsplit(", 6) AS title_adjustment", 1)[0]
ADJ = f"""adj AS (SELECT *, (headline_score + title_adj) + topic_adj AS base_score FROM (SELECT a.*, {_TITLE} AS title_adj, coalesce(topic_adj, 0e0) AS topic_adj, accepted_24h,
   CASE WHEN coalesce(accepted_24h,0) >= 25 THEN -1e0 WHEN coalesce(accepted_24h,0) > 10 THEN -((accepted_24h-10)*2e-2) ELSE 0e0 END AS pub_adj
   FROM art a LEFT JOIN ta USING (article_id) LEFT JOIN pc USING (publication_id)))"""


def _adjusted(t):
    pubs = triage.accepted_by_publisher(t.art, day_start())
    topics = triage.accepted_by_topic(t.art, t.art_topic, day_start())
    a = t.art.select("article_id", "publication_id", "title", "headline_score", "triage_status")
    return triage.with_adjustments(a, t.art_topic, topics, pubs)


@query("topic_daily_counts", uses="art art_topic", sql=f"WITH {TOP} SELECT * FROM tc")
def _(t):
    return triage.accepted_by_topic(t.art, t.art_topic, day_start())


@query("topic_scarcity", uses="art art_topic", sql=f"WITH {TOP}, {TADJ} SELECT * FROM ta")
def _(t):
    return triage.topic_adjustments(t.art_topic, triage.accepted_by_topic(t.art, t.art_topic, day_start()))


ROLL = """SELECT article_id, publication_id, count(*) FILTER (accepted AND triage_method <> 'legacy') OVER (PARTITION BY publication_id
   ORDER BY published_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS accepted_24h FROM arrivals"""


def _rolling(t):
    counted = F.col("accepted") & (F.col("triage_method") != "legacy")
    return rolling_count(t.arrivals, "article_id", "publication_id", "published_at", counted, 24 * 3600, out="accepted_24h")


@query("publisher_rolling_24h", uses="arrivals", sql=ROLL)
def _(t):
    return _rolling(t)


@query("publisher_penalty", uses="arrivals", sql=f"""
SELECT article_id, round(CASE WHEN accepted_24h >= 4 THEN -1e0 WHEN accepted_24h > 1 THEN -((accepted_24h-1)*2e-2) ELSE 0e0 END, 6) AS penalty FROM ({ROLL})""")
def _(t):
    # caps scaled to the test stream, whose publishers send about two rows a day
    return _rolling(t).select("article_id", F.round(scoring.volume_penalty("accepted_24h", soft=1, hard=4), 6).alias("penalty"))


@query("model_daily_cap", uses="art", sql=f"""
SELECT count(*) AS calls_today, greatest(0, 1000 - count(*)) AS calls_left FROM art WHERE triage_method = 'llm' AND triaged_at >= {DAY}""")
def _(t):
    n = F.count_if((F.col("triage_method") == "llm") & (F.col("triaged_at") >= day_start()))
    return t.art.agg(n.alias("calls_today"), F.greatest(F.lit(0), F.lit(triage.MODEL_DAILY_CAP) - n).alias("calls_left"))


SC = "CASE WHEN pub_adj <= -1e0 THEN base_score ELSE base_score + pub_adj END"


@query("triage_tier1", uses="art art_topic", sql=f"""
WITH {PUB}, {TOP}, {TADJ}, {ADJ}, s AS (SELECT *, {SC} AS s FROM adj)
SELECT article_id, publication_id, round(s,6) + 0e0 AS triage_score,
  CASE WHEN pub_adj <= -1e0 THEN 'rejected' WHEN s >= 5e-1 THEN 'accepted' WHEN s < 25e-2 THEN 'rejected' ELSE 'pending_llm' END AS status,
  CASE WHEN pub_adj <= -1e0 THEN 'publisher_cap: 25 accepted/24h exceeded'
    WHEN s >= 5e-1 THEN printf('algorithmic_accept: score=%.3f (headline=%.3f, title=%+.3f, topic=%+.3f, pub=%+.3f)', s, headline_score, title_adj, topic_adj, pub_adj)
    WHEN s < 25e-2 THEN printf('algorithmic_reject: score=%.3f below floor 0.25', s) ELSE printf('ambiguous: score=%.3f in [0.25, 0.5)', s) END AS reason FROM s""")
def _(t):
    return triage.tier1(_adjusted(t)).withColumn("triage_score", F.round("triage_score", 6))


@query("triage_tier1_live", uses="art art_topic", sql=f"""
WITH {PUB}, {TOP}, {TADJ}, {ADJ}, r AS (SELECT *, coalesce(accepted_24h,0) AS n0, row_number() OVER (PARTITION BY publication_id ORDER BY base_score DESC, article_id) AS r FROM adj),
w AS (SELECT *, n0+r-1 < 25 AND base_score - greatest(n0+r-1-10,0)*2e-2 >= 5e-1 AS won FROM r),
n AS (SELECT *, n0 + count(*) FILTER (won) OVER (PARTITION BY publication_id) AS n FROM w)
SELECT article_id, publication_id, CASE WHEN won THEN 'accepted' WHEN n >= 25 THEN 'rejected' WHEN base_score - greatest(n-10,0)*2e-2 < 25e-2 THEN 'rejected' ELSE 'pending_llm' END AS status FROM n""")
def _(t):
    return triage.tier1_live(_adjusted(t))


PARSED = r"""parsed AS (SELECT article_id, reply, CASE WHEN json_valid(c) AND i BETWEEN 0 AND 10 AND n BETWEEN 0 AND 10 AND s BETWEEN 0 AND 10 THEN i+n+s END AS total
  FROM (SELECT *, try_cast(json_extract_string(CASE WHEN json_valid(c) THEN c END,'$.impact') AS DOUBLE) AS i, try_cast(json_extract_string(CASE WHEN json_valid(c) THEN c END,'$.novelty') AS DOUBLE) AS n,
     try_cast(json_extract_string(CASE WHEN json_valid(c) THEN c END,'$.significance') AS DOUBLE) AS s
   FROM (SELECT article_id, reply, regexp_replace(regexp_replace(regexp_replace(trim(reply),'^```[^\n]*\n?',''),'\s*```$',''),'^json\s*','') AS c FROM replies)))"""


@query("model_triage_parse", uses="replies", sql=f"""
WITH {PARSED} SELECT article_id, total IS NOT NULL AS valid, coalesce(round(total/3e1, 6), -1e0) AS composite FROM parsed""")
def _(t):
    s = F.col("s")
    return t.replies.withColumn("s", triage.parse_reply("reply")).select("article_id", s.isNotNull().alias("valid"), F.coalesce(
        F.round((s["impact"] + s["novelty"] + s["significance"]) / 30.0, 6), F.lit(-1.0)).alias("composite"))


@query("triage_tier2", uses="art replies", sql=f"""
WITH {PUB}, {PARSED}, calls AS (SELECT count(*) AS n FROM art WHERE triage_method = 'llm' AND triaged_at >= {DAY}),
p AS (SELECT a.article_id, headline_score, coalesce(accepted_24h,0) >= 25 AS capped FROM art a LEFT JOIN pc USING (publication_id) WHERE triage_status IN ('pending_llm','pending')),
q AS (SELECT *, CASE WHEN NOT capped THEN row_number() OVER (PARTITION BY capped ORDER BY headline_score DESC, article_id) END AS call_no FROM p),
z AS (SELECT q.*, coalesce(call_no <= 1000 - n, false) AS served, reply, total FROM q CROSS JOIN calls LEFT JOIN parsed USING (article_id))
SELECT article_id, CASE WHEN capped THEN 'rejected' WHEN NOT served OR total IS NULL OR total/3e1 >= 55e-2 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN capped THEN 'publisher_cap' WHEN NOT served THEN 'model_cap_reached' WHEN reply IS NULL THEN 'model_error' WHEN total IS NULL THEN 'model_parse_error' ELSE 'model_score' END AS cause,
  round(CASE WHEN NOT capped AND served AND total IS NOT NULL THEN total/3e1 ELSE headline_score END, 6) AS triage_score FROM z""")
def _(t):
    pending = t.art.filter(F.col("triage_status").isin("pending", "pending_llm")).select("article_id", "publication_id", "headline_score")
    calls = t.art.agg(F.count_if((F.col("triage_method") == "llm") & (F.col("triaged_at") >= day_start()))).scalar()
    out = triage.tier2(pending, t.replies, triage.accepted_by_publisher(t.art, day_start()), calls)
    return out.withColumn("triage_score", F.round("triage_score", 6))


@query("tier3_promote", uses="art", sql="""
WITH c AS (SELECT cluster_id, count(*) AS cluster_size FROM art GROUP BY cluster_id HAVING count(*) >= 3 AND
   count(*) FILTER (triage_status = 'accepted' AND analyzer_status = 'completed' AND publication_id <> 'src0') = 0)
SELECT cluster_id, article_id, cluster_size, 'promoted' AS status FROM (SELECT * FROM art WHERE triage_status = 'rejected' AND headline_score >= 45e-2) JOIN c USING (cluster_id)
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY headline_score DESC, article_id) = 1""")
def _(t):
    a = t.art.select("article_id", "cluster_id", "headline_score", "triage_status",
                     F.when(F.col("publication_id") == "src0", F.lit("pending")).otherwise(F.col("analyzer_status")).alias("analyzer_status"))
    return triage.tier3(a)


@query("triage_timeout", uses="art", sql=f"""
WITH {PUB} SELECT article_id, CASE WHEN coalesce(accepted_24h,0) >= 25 THEN 'rejected' ELSE 'accepted' END AS status FROM art LEFT JOIN pc USING (publication_id)
WHERE triage_status = 'pending_llm' AND triaged_at < TIMESTAMP '2024-01-30 23:00:00'""")
def _(t):
    return triage.resolve_timeouts(t.art.select("article_id", "publication_id", "triage_status", "triaged_at"),
                                   triage.accepted_by_publisher(t.art, day_start()), now())


@query("refresh_top", uses="art arrivals", sql="""
WITH s AS (SELECT article_id//10 AS article_id, max(headline_score) AS seen FROM arrivals WHERE topic = 'click' GROUP BY 1)
SELECT article_id, greatest(headline_score, seen) AS headline_score, true AS is_top_headline,
  CASE WHEN triage_status IN ('accepted','promoted') THEN triage_status ELSE 'pending' END AS triage_status FROM art JOIN s USING (article_id)""")
def _(t):
    sightings = t.arrivals.filter("topic = 'click'").select(F.expr("article_id div 10").alias("article_id"), "headline_score")
    return triage.refresh_top(t.art.select("article_id", "headline_score", "triage_status"), sightings)
