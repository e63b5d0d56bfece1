"""Streaming queries in four micro-batches and, for windows, sessions and waits, a closing one that moves the watermark past all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import stories, triage
from newsloom.operators.ranking import as_of_join
from newsloom.plans.registry import ORACLES, query
from newsloom.plans.stories import PAIRS
from newsloom.plans.triage import ADJ, PUB, SC, TADJ, TOP, day_start
from newsloom.session import cut_lineage
from newsloom.streaming import jobs

CLOSE = "5 days"


def _events(t):
    return jobs.replay(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts")


def _closed(rows, *closing):
    return jobs.replay(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", close=CLOSE, closing=closing or ({},))


def _accepted(t):
    return _closed(t.events.filter("event_id % 3 <> 2"))


def _seconds(df):
    return df.withColumn("start_s", F.unix_seconds("start")).withColumn("end_s", F.unix_seconds("end")).drop("start", "end")


@query("st_dedup", sql="SELECT DISTINCT user_id, event_type, props FROM events")
def _(t):
    return jobs.dedup(_events(t), "ts", ["user_id", "event_type", "props"]).select("user_id", "event_type", "props")


@query("st_publisher_counts", sql="""
WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS s FROM events, (SELECT unnest(range(24)) AS k) WHERE event_id%3 <> 2)
SELECT user_id, count(*) AS n, epoch(s)::BIGINT AS start_s, epoch(s)::BIGINT + 86400 AS end_s FROM w GROUP BY user_id, s""")
def _(t):
    return _seconds(jobs.run_to_table(jobs.sliding_counts(_accepted(t), "ts", "user_id")))


@query("st_topic_daily", sql="""
SELECT event_type, count(*) AS n, epoch(date_trunc('day', ts))::BIGINT AS start_s, epoch(date_trunc('day', ts))::BIGINT + 86400 AS end_s FROM events
WHERE event_id%3 <> 2 GROUP BY event_type, date_trunc('day', ts)""")
def _(t):
    return _seconds(jobs.run_to_table(jobs.tumbling_counts(_accepted(t), "ts", "event_type")))


@query("st_sessions", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts))//1000000 AS start_s, (epoch_us(max(ts)) + 1800000000)//1000000 AS end_s FROM s GROUP BY user_id, sid""")
def _(t):
    return _seconds(jobs.run_to_table(jobs.sessions(_closed(t.events), "ts", "user_id")))


@query("st_timeout", sql="""
SELECT user_id, event_id AS item_id FROM events p WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events r WHERE r.event_type <> 'view' AND r.user_id = p.user_id AND r.ts >= p.ts AND r.ts <= p.ts + INTERVAL 1 HOUR)""")
def _(t):
    # with a key: the join drops rows without one before it reads their time
    e = _closed(t.events, {"event_type": "view", "user_id": -1}, {"event_type": "end", "user_id": -1}).withColumn("item_id", F.col("event_id"))
    return jobs.run_to_table(jobs.timeouts(e.filter("event_type = 'view'"), e.filter("event_type <> 'view'"), "user_id", "ts")).select("user_id", "item_id")


@query("st_burst", sql="""
WITH r AS (SELECT event_id%200 AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_id%200 ORDER BY ts) AS rn FROM events)
SELECT k AS key, min(t) AS first_us, CASE WHEN max(t) FILTER (rn = 3) - min(t) < 3600000000 THEN 1e0 WHEN max(t) FILTER (rn = 3) - min(t) < 7200000000 THEN 8e-1 ELSE 0e0 END AS burst FROM r GROUP BY k""")
def _(t):
    e = _events(t).withColumn("k", F.col("event_id") % 200)
    spark, out = jobs.run_batches(jobs.bursts(e, "k", "ts"), jobs.save, mode="update")
    rows = spark.read.parquet(out)
    # the newest batch holds a key's latest answer
    return rows.groupBy("key").agg(F.max_by(F.struct("first_us", "burst"), "batch").alias("x")).select("key", "x.*")


def _doc_stream(t):
    docs = t.documents
    age = (F.col("doc_id") * 7919) % 259200
    rows = docs.select(
        F.col("doc_id").alias("article_id"), F.col("lang").alias("language"), F.col("source").alias("publication_id"),
        F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("title"), F.trim(F.regexp_extract("text", r"^[^\n]*", 0)).alias("description"),
        (((F.col("doc_id") * 31) % 100) / 100.0).alias("headline_score"), F.timestamp_seconds(F.lit(1706659200) - age).alias("published_at"))
    return jobs.replay(rows, "published_at")


@query("st_story_clusters", uses="art", sql=f"""
WITH RECURSIVE {PAIRS}, links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT variant AS x, variant AS y FROM variants UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y), comp AS (SELECT x AS variant, min(y) AS story_id FROM reach GROUP BY x)
SELECT variant, language, copies, story_id FROM variants JOIN comp USING (variant)""")
def _(t):
    bodies = t.art.select("article_id", F.concat("title", F.lit(" "), "description").alias("body"))
    texts = bodies.groupBy(stories.text_key("body").alias("h")).agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    vocab = stories.fit_vocabulary(cut_lineage(texts), "h", "body", copies="copies")
    s = _doc_stream(t).withColumn("body", F.concat("title", F.lit(" "), "description"))
    spark, out = jobs.story_updates(s, vocab, "article_id", "body", "language", "published_at")
    return jobs.stories_now(spark, out).select("variant", "language", "copies", "story_id")


# The same four slices in time, one after the other: what a slice accepts counts for the slices after it.
def _slices() -> str:
    parts = [f"""WITH {PUB}, {TOP}, s0 AS (SELECT *, 1706659200 - (article_id*7919)%259200 AS t FROM art), b AS (SELECT min(t)*1000000 AS lo, (max(t) - min(t))*1000000//4 + 1 AS width FROM s0),
s1 AS (SELECT s0.*, ((t*1000000 - lo)//width)::INT AS slot FROM s0, b), ats AS (SELECT slot, max(t) AS decided_at FROM s1 GROUP BY slot),
u0 AS (SELECT NULL::BIGINT AS article_id, NULL::VARCHAR AS publication_id, 0e0 AS s, 0e0 AS headline_score, 0e0 AS title_adj, 0e0 AS topic_adj, 0e0 AS pub_adj, '' AS status, 0::BIGINT AS decided_at WHERE false)"""]
    for k in range(1, 5):
        at = f"(SELECT decided_at FROM ats WHERE slot = {k - 1})"
        parts.append(f"""pc{k} AS (SELECT publication_id, sum(n) AS accepted_24h FROM (SELECT publication_id, accepted_24h AS n FROM pc
  UNION ALL SELECT publication_id, count(*) FROM u{k - 1} WHERE status = 'accepted' AND publication_id IS NOT NULL AND decided_at > {at} - 86400 GROUP BY publication_id) GROUP BY publication_id),
tc{k} AS (SELECT topic_id, sum(n) AS accepted_today FROM (SELECT topic_id, accepted_today AS n FROM tc
  UNION ALL SELECT topic_id, count(*) FROM u{k - 1} JOIN art_topic USING (article_id) WHERE status = 'accepted' AND decided_at//86400 = {at}//86400 GROUP BY topic_id) GROUP BY topic_id),
{TADJ.replace("ta AS (", f"ta{k} AS (", 1).replace("JOIN tc", f"JOIN tc{k}")},
{ADJ.replace("adj AS (", f"adj{k} AS (", 1).replace("FROM art a LEFT JOIN ta USING", f"FROM (SELECT * FROM s1 WHERE slot = {k - 1}) a LEFT JOIN ta{k} USING").replace("LEFT JOIN pc USING", f"LEFT JOIN pc{k} USING")},
d{k} AS (SELECT *, {SC} AS s FROM adj{k}),
u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT article_id, publication_id, s, headline_score, title_adj, topic_adj, pub_adj,
  CASE WHEN pub_adj <= -1e0 THEN 'rejected' WHEN s >= 5e-1 THEN 'accepted' WHEN s < 25e-2 THEN 'rejected' ELSE 'pending_llm' END, {at} FROM d{k})""")
    reason = ORACLES["triage_tier1"].split("END AS status,", 1)[1].rsplit("FROM s", 1)[0]
    return ",\n".join(parts) + f"\nSELECT article_id, publication_id, round(s,6) + 0e0 AS triage_score, status, {reason} FROM u4"


@query("st_triage", uses="art art_topic", sql=_slices())
def _(t):
    topics = triage.accepted_by_topic(t.art, t.art_topic, day_start())
    pubs = triage.accepted_by_publisher(t.art, day_start())
    rows = _doc_stream(t).select("article_id", "publication_id", "title", "headline_score", "published_at")
    spark, out = jobs.triage_updates(rows, t.art_topic, pubs, topics, "published_at")
    return spark.read.parquet(out).select("article_id", "publication_id", F.round("triage_score", 6).alias("triage_score"), "status", "reason")


@query("asof_rescore", sql="""
WITH s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, greatest(p.value, coalesce(s.value, 0e0)) AS score, s.value IS NOT NULL AS known
FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN s ON s.user_id = p.user_id AND s.ts <= p.ts""")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    late = e.filter("event_type = 'click'")
    state = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("valid_from"), F.col("value").alias("state_score"))
    found = as_of_join(late, state, "user_id", "ts", "valid_from", "state_score", "event_id")
    return late.select("event_id", "user_id", "value").join(found.select("event_id", "state_score"), "event_id").select(
        "event_id", "user_id", F.greatest("value", F.coalesce("state_score", F.lit(0.0))).alias("score"), F.col("state_score").isNotNull().alias("known"))
