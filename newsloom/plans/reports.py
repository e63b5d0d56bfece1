"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.operators import reports
from newsloom.operators.ranking import first_rows, top_k
from newsloom.plans.registry import query
from newsloom.sources.tables import as_of


@query("triage_by_status", uses="art", sql="""
SELECT triage_status, triage_method, count(*) AS n, round(1e2*count(*)/sum(count(*)) OVER (), 6) AS percent FROM art GROUP BY 1, 2""")
def _(t):
    return reports.share_by(t.art, ["triage_status", "triage_method"])


@query("triage_by_publisher", uses="art", sql="""
SELECT publication_id, count(*) AS total, count(*) FILTER (triage_status = 'accepted') AS accepted, count(*) FILTER (triage_status = 'rejected') AS rejected,
  count(*) FILTER (triage_status = 'promoted') AS promoted FROM art GROUP BY 1 ORDER BY accepted DESC, publication_id LIMIT 10""")
def _(t):
    n = t.art.groupBy("publication_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("triage_status") == s).alias(s) for s in ("accepted", "rejected", "promoted")])
    return first_rows(n, [F.desc("accepted"), F.asc("publication_id")], 10)


@query("triage_by_topic", uses="art art_topic", sql="""
SELECT topic_id, count(DISTINCT article_id) FILTER (triage_status = 'accepted') AS accepted, count(DISTINCT article_id) AS total FROM art_topic JOIN art USING (article_id) GROUP BY 1""".replace(
    "SELECT topic_id", "SELECT topic_id").replace("JOIN art USING (article_id)", "JOIN (SELECT article_id, triage_status FROM art) USING (article_id)"))
def _(t):
    j = t.art_topic.join(t.art.select("article_id", "triage_status"), "article_id")
    return j.groupBy("topic_id").agg(F.countDistinct(F.when(F.col("triage_status") == "accepted", F.col("article_id"))).alias("accepted"),
                                     F.countDistinct("article_id").alias("total"))


@query("triage_cost", uses="art", sql="""
SELECT count(triage_cost) AS calls, round(sum(triage_cost), 6) AS cost FROM art WHERE triage_cost IS NOT NULL""")
def _(t):
    c = F.col("triage_cost").cast("decimal(10,6)")
    return t.art.filter("triage_cost IS NOT NULL").agg(F.count("*").alias("calls"), F.round(F.sum(c).cast("double"), 6).alias("cost"))


@query("daily_distribution", uses="art pub", sql="""
SELECT strftime(published_at,'%Y-%m-%d') AS day, coalesce(region_code,'none') AS region_code, topic_id, count(*) AS n FROM art LEFT JOIN pub USING (publication_id) GROUP BY ALL""")
def _(t):
    return t.art.select("publication_id", "published_at", "topic_id").join(t.pub.select("publication_id", "region_code"), "publication_id", "left").groupBy(
        F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.coalesce("region_code", F.lit("none")).alias("region_code"), "topic_id").agg(F.count("*").alias("n"))


RECENT = "last_attempt_at >= TIMESTAMP '2024-01-30 00:00:00'"


def _recent(t):
    return t.art.filter(F.col("last_attempt_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query("fetch_stats", uses="art", sql=f"""
SELECT fetch_strategy, count(*) AS attempts, count(*) FILTER (fetch_status = 'completed') AS succeeded, count(*) FILTER (fetch_status = 'failed') AS failed,
  round(1e2*count(*) FILTER (fetch_status = 'completed')/count(*), 6) AS success_rate, round(avg(fetch_seconds), 6) AS avg_seconds, count(*) FILTER (paywall_detected) AS paywalled FROM art WHERE {RECENT} GROUP BY 1""")
def _(t):
    return reports.success_report(_recent(t), "fetch_status", ["fetch_strategy"], {"avg_seconds": "fetch_seconds"}, {"paywalled": "paywall_detected"})


@query("strategy_usage", uses="art", sql=f"""
SELECT fetch_strategy, count(*) AS used, round(1e2*count(*)/sum(count(*)) OVER (), 6) AS percent FROM art WHERE {RECENT} AND fetch_status = 'completed' GROUP BY 1""")
def _(t):
    done = _recent(t).filter("fetch_status = 'completed'")
    total = done.agg(F.count("*")).scalar()
    return done.groupBy("fetch_strategy").agg(F.count("*").alias("used")).withColumn("percent", F.round(F.col("used") * 100.0 / total, 6))


@query("process_stats", uses="art", sql=f"""
SELECT route, count(*) AS attempts, count(*) FILTER (process_status = 'completed') AS succeeded, count(*) FILTER (process_status = 'failed') AS failed,
  round(1e2*count(*) FILTER (process_status = 'completed')/count(*), 6) AS success_rate, round(avg(quality_score), 6) AS avg_quality, round(avg(process_cost), 6) AS avg_cost FROM art WHERE {RECENT} GROUP BY 1""")
def _(t):
    # the quality lives in a JSON column
    m = _recent(t).withColumn("metrics", F.to_json(F.struct(F.col("quality_score").alias("overall_score"))))
    m = m.withColumn("q", F.get_json_object("metrics", "$.overall_score").cast("double"))
    return reports.success_report(m, "process_status", ["route"], {"avg_quality": "q", "avg_cost": "process_cost"})


@query("route_optimize", uses="art", sql=f"""
WITH p AS (SELECT route, count(*) AS n, avg(quality_score) AS q, avg(process_cost) AS c FROM art WHERE {RECENT} AND process_status = 'completed' GROUP BY route)
SELECT route, n, round(q,6) AS avg_quality, round(c,9) AS avg_cost, round(sum(n*c) OVER ()/sum(n) OVER (), 9) AS overall_cost,
  CASE WHEN route = 'algorithmic' AND q > 8e-1 AND n > 10 THEN 'increase_llm_threshold' WHEN route = 'ai' AND q < 7e-1 AND n > 5 THEN 'decrease_llm_threshold' ELSE 'keep' END AS suggestion FROM p""")
def _(t):
    return reports.route_report(_recent(t).filter("process_status = 'completed'"), "quality_score", "process_cost")


@query("route_stats", uses="art", sql=f"""
SELECT count(*) AS total, count(*) FILTER (route = 'algorithmic') AS n_algorithmic, count(*) FILTER (route = 'ai') AS n_ai, count(*) FILTER (route = 'hybrid') AS n_hybrid,
  round(avg(quality_score) FILTER (route = 'algorithmic'),6) AS q_algorithmic, round(avg(quality_score) FILTER (route = 'ai'),6) AS q_ai, round(avg(quality_score) FILTER (route = 'hybrid'),6) AS q_hybrid FROM art WHERE {RECENT}""")
def _(t):
    is_ = lambda r: F.col("route") == r
    rs = ("algorithmic", "ai", "hybrid")
    return _recent(t).agg(F.count("*").alias("total"), *[F.count_if(is_(r)).alias(f"n_{r}") for r in rs],
                          *[F.round(F.avg(F.when(is_(r), F.col("quality_score"))), 6).alias(f"q_{r}") for r in rs])


_ST = []
_prev = None
for _s, _busy in (("fetch", "fetching"), ("process", "processing"), ("summary", "processing"), ("analyzer", "processing")):
    _w = f"{_s}_status = 'pending' AND {_s}_attempts < 3" + (f" AND {_prev}_status = 'completed'" if _prev else "")
    _ST.append((_s, _w, _busy))
    _prev = _s
_FULL = " AND ".join(f"{s}_status = 'completed'" for s, _, _ in _ST)


@query("stage_status", uses="art", sql="SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({w}) AS {s}_pending, count(*) FILTER ({s}_status = '{b}') AS {s}_processing, count(*) FILTER ({s}_status = 'completed') AS {s}_completed, count(*) FILTER ({s}_status = 'failed') AS {s}_failed"
    for s, w, b in _ST) + ", " + " + ".join(f"count(*) FILTER ({w})" for _, w, _ in _ST) + f" AS needing_work, count(*) FILTER ({_FULL}) AS fully_processed, round(1e2*count(*) FILTER ({_FULL})/count(*), 6) AS completion_rate FROM art")
def _(t):
    return reports.stage_status(t.art)


@query("summary_health", uses="art", sql="""
WITH r AS (SELECT process_cost FROM art WHERE summary_status = 'completed' ORDER BY published_at DESC, article_id LIMIT 100)
SELECT count(*) FILTER (summary_status = 'pending') AS pending, count(*) FILTER (summary_status = 'failed') AS failed,
  count(*) FILTER (summary_status = 'completed' AND published_at >= TIMESTAMP '2024-01-30 00:00:00') AS completed_24h, round((SELECT avg(process_cost) FROM r), 9) AS avg_cost,
  CASE WHEN count(*) FILTER (summary_status = 'failed') < count(*) FILTER (summary_status = 'pending')*1e-1 THEN 'good' ELSE 'degraded' END AS health FROM art""")
def _(t):
    return reports.summary_health(t.art, as_of())


@query("daily_metrics", uses="art", sql="""
SELECT strftime(published_at,'%Y-%m-%d') AS day, count(*) AS articles, count(*) FILTER (analyzer_status = 'completed') AS analysed, count(*) FILTER (fetch_status = 'failed') AS fetch_failures,
  count(*) FILTER (process_status = 'failed') AS process_failures, count(*) FILTER (summary_status = 'failed') AS summary_failures, count(*) FILTER (analyzer_status = 'failed') AS analyzer_failures,
  round(1e2*count(*) FILTER (analyzer_status = 'completed')/count(*), 6) AS success_rate, sum(ceil(n_chars/4)::BIGINT)::BIGINT AS tokens, round(coalesce(sum(triage_cost), 0e0), 6) AS triage_cost,
  round(sum(process_cost), 6) AS cost, round(avg(fetch_seconds), 6) AS avg_seconds FROM art GROUP BY 1""")
def _(t):
    return reports.daily_metrics(t.art, "published_at")


@query("usage_cost", uses="usage", sql="""
WITH c AS (SELECT operation, model, prompt_tokens, completion_tokens, CASE WHEN model = 'gpt-4.1-nano' THEN prompt_tokens*0.0000001 + completion_tokens*0.0000004
   WHEN model = 'gpt-4o-mini' THEN prompt_tokens*0.00000015 + completion_tokens*0.0000006 WHEN model = 'text-embedding-3-small' THEN prompt_tokens*0.00000002 ELSE 0 END::DECIMAL(20,10) AS cost FROM usage)
SELECT operation, model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(cost)::DOUBLE AS cost_usd FROM c GROUP BY 1, 2""")
def _(t):
    return reports.usage_cost(t.usage).groupBy("operation", "model").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost_usd").cast("double").alias("cost_usd"))


@query("feedback_counters", sql="""
WITH f AS (SELECT event_type, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events), n AS (SELECT event_type, k, count(*) AS n FROM f GROUP BY 1, 2)
SELECT event_type, k, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) AS position FROM n QUALIFY position <= 5""")
def _(t):
    k = F.from_json("props", "k int")["k"]
    n = t.events.select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))
    return top_k(n, ["event_type"], [F.desc("n"), F.asc("k")], 5, rank="position").withColumn("position", F.col("position").cast("long"))


@query("sync_log_agg", sql="""
SELECT strftime(ts,'%Y-%m-%d') AS day, user_id AS feed, count(*) AS found, count(*) FILTER (event_type = 'purchase') AS created, count(*) FILTER (event_type = 'error') AS failed,
  (epoch_us(max(ts)) - epoch_us(min(ts)))//1000000 AS seconds FROM events GROUP BY 1, 2 ORDER BY day DESC, feed LIMIT 10""")
def _(t):
    e = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    logs = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("feed")).agg(
        F.count("*").alias("found"), F.count_if(F.col("event_type") == "purchase").alias("created"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.floor((F.max("at") - F.min("at")) / 1000000).alias("seconds"))
    return first_rows(logs, [F.desc("day"), F.asc("feed")], 10)


@query("capture_counts", sql="""
SELECT key, value, count(*) AS n FROM (SELECT unnest(['lang', 'source', 'length']) AS key, unnest([lang, source, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END]) AS value FROM documents) GROUP BY ALL""")
def _(t):
    size = F.when(F.col("n_chars") < 1000, "short").otherwise("long")
    return reports.count_by(t.documents, {"lang": F.col("lang"), "source": F.col("source"), "length": size})


@query("block_status", sql=r"""
WITH b AS (SELECT page_id, len(regexp_extract_all(regexp_replace(html,'(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->',' ','g'),'(?is)<p(?:\s[^>]*)?>(.*?)</p>',1)) AS blocks FROM pages)
SELECT page_id, blocks, (SELECT count(*) FROM b WHERE blocks > 0) AS with_blocks, (SELECT count(*) FROM b) AS total FROM b ORDER BY page_id DESC LIMIT 10""")
def _(t):
    b = t.pages.select("page_id", F.size(F.regexp_extract_all(html.visible("html"), F.lit(html.PARAGRAPH), 1)).cast("long").alias("blocks"))
    latest = first_rows(b, [F.desc("page_id")], 10)
    return latest.withColumn("with_blocks", b.agg(F.count_if(F.col("blocks") > 0)).scalar()).withColumn("total", b.agg(F.count("*")).scalar())


@query("daily_top_events", uses="art_evt arrivals", sql="""
WITH s AS (SELECT strftime(published_at,'%Y-%m-%d') AS day, event_id, sum(CASE WHEN is_primary THEN 2 ELSE 1 END)::BIGINT AS score FROM art_evt JOIN arrivals USING (article_id) GROUP BY 1, 2)
SELECT day, event_id, score FROM s QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, event_id) <= 10""")
def _(t):
    links = t.art_evt.join(t.arrivals.select("article_id", "published_at"), "article_id")
    score = F.sum(F.when(F.col("is_primary"), 2).otherwise(1)).alias("score")
    per = links.groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day"), "event_id").agg(score)
    return top_k(per, ["day"], [F.desc("score"), F.asc("event_id")], 10)


@query("feedback_nested", sql="""
WITH f AS (SELECT n_chars, unnest(list_distinct([source, lang, CASE WHEN n_chars > 2000 THEN 'long' END])) AS issue FROM documents)
SELECT issue, count(*) AS n, round(avg(n_chars/1e3), 6) AS mean_score, count(*) = max(count(*)) OVER () AS most_common FROM f WHERE issue IS NOT NULL GROUP BY issue""")
def _(t):
    # feedback is JSON text with a list inside; counters, averages and the most common entries come out of it
    issues = F.array_compact(F.array_distinct(F.array("source", "lang", F.when(F.col("n_chars") > 2000, "long"))))
    stored = F.to_json(F.struct(F.struct(issues.alias("issues")).alias("review"), (F.col("n_chars") / 1e3).alias("score")))
    return reports.nested_counters(t.documents.select(stored.alias("feedback")), "feedback")
