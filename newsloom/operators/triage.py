"""Three-tier triage as set operations over counts, scores and parsed model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators.ranking import first_rows, top_k

ACCEPT, REJECT = 0.50, 0.25
SOFT_CAP, HARD_CAP, PENALTY_RATE = 10, 25, 0.02
MODEL_ACCEPT, MODEL_DAILY_CAP = 0.55, 1000
PROMOTE_SIZE, PROMOTE_SCORE = 3, 0.45


def accepted_by_publisher(articles: DataFrame, since: Column) -> DataFrame:
    """Accepted per publication since a moment; backfilled rows do not count."""
    return articles.filter(
        (F.col("triage_status") == "accepted") & (F.col("triaged_at") >= since)
        & ~F.col("triage_method").eqNullSafe("legacy") & F.col("publication_id").isNotNull()
    ).groupBy("publication_id").agg(F.count("*").alias("accepted_24h"))


def accepted_by_topic(articles: DataFrame, links: DataFrame, day_start: Column) -> DataFrame:
    """Accepted articles per topic since the start of the day; links are unique pairs, so no distinct is needed."""
    today = articles.filter((F.col("triage_status") == "accepted") & (F.col("triaged_at") >= day_start)).select("article_id")
    return links.join(today, "article_id").groupBy("topic_id").agg(F.count("*").alias("accepted_today"))


def topic_adjustments(links: DataFrame, topic_counts: DataFrame) -> DataFrame:
    """Best topic adjustment per article."""
    return links.join(topic_counts, "topic_id", "left").groupBy("article_id").agg(
        F.max(scoring.topic_adjustment("accepted_today")).alias("topic_adj"))


def with_adjustments(articles: DataFrame, links: DataFrame, topic_counts: DataFrame, pub_counts: DataFrame) -> DataFrame:
    rows = articles.join(topic_adjustments(links, topic_counts), "article_id", "left").join(pub_counts, "publication_id", "left")
    rows = rows.withColumn("title_adj", scoring.title_quality("title")).withColumn("topic_adj", F.coalesce("topic_adj", F.lit(0.0)))
    rows = rows.withColumn("pub_adj", scoring.volume_penalty("accepted_24h", SOFT_CAP, HARD_CAP, PENALTY_RATE))
    return rows.withColumn("base_score", F.col("headline_score") + F.col("title_adj") + F.col("topic_adj"))


def tier1(adjusted: DataFrame) -> DataFrame:
    """Accept, reject or leave to the model, from one snapshot of the counts."""
    capped = F.col("pub_adj") <= -1.0
    score = F.when(capped, F.col("base_score")).otherwise(F.col("base_score") + F.col("pub_adj"))
    rows = adjusted.withColumn("triage_score", score)
    status = (F.when(capped, "rejected").when(score >= ACCEPT, "accepted").when(score < REJECT, "rejected").otherwise("pending_llm"))
    reason = (
        F.when(capped, F.lit(f"publisher_cap: {HARD_CAP} accepted/24h exceeded"))
        .when(score >= ACCEPT, F.format_string(
            "algorithmic_accept: score=%.3f (headline=%.3f, title=%+.3f, topic=%+.3f, pub=%+.3f)",
            score, F.col("headline_score"), F.col("title_adj"), F.col("topic_adj"), F.col("pub_adj")))
        .when(score < REJECT, F.format_string(f"algorithmic_reject: score=%.3f below floor {REJECT}", score))
        .otherwise(F.format_string("ambiguous: score=%.3f in [0.25, 0.5)", score))
    )
    return rows.select("article_id", "publication_id", "triage_score", status.alias("status"), reason.alias("reason"))


def tier1_live(adjusted: DataFrame) -> DataFrame:
    """Tier 1 where each acceptance raises its publisher's count for the next decision, best score first.

    Going down a publisher's list the score only falls and the penalty only grows, so the accepted are a
    prefix: rank r is accepted exactly when fewer than the hard cap came before it and its own score clears
    the threshold after the penalty at count0 + r - 1. At most HARD_CAP ranks per publisher can matter.
    """
    n0 = F.coalesce("accepted_24h", F.lit(0))
    heads = top_k(adjusted, ["publication_id"], [F.desc("base_score"), F.asc("article_id")], HARD_CAP, rank="r")
    before = n0 + F.col("r") - 1
    over = F.greatest(before - SOFT_CAP, F.lit(0))
    ok = (before < HARD_CAP) & (F.col("base_score") - over * PENALTY_RATE >= ACCEPT)
    wins = heads.filter(ok).select("article_id", F.lit(True).alias("won"))
    totals = heads.filter(ok).groupBy("publication_id").agg(F.count("*").alias("added"))
    rows = adjusted.join(wins, "article_id", "left").join(totals, "publication_id", "left")
    n = n0 + F.coalesce("added", F.lit(0))
    final = F.col("base_score") - F.greatest(n - SOFT_CAP, F.lit(0)) * PENALTY_RATE
    status = (F.when(F.col("won"), "accepted").when(n >= HARD_CAP, "rejected").when(final < REJECT, "rejected").otherwise("pending_llm"))
    return rows.select("article_id", "publication_id", status.alias("status"))


def parse_reply(reply: str) -> Column:
    """Struct of three scores and a reason from a model's reply, or null when any score is missing or off scale."""
    c = F.regexp_replace(text.nz(reply), r"^\s+|\s+$", "")
    c = F.when(F.startswith(c, F.lit("```")), F.regexp_replace(F.regexp_replace(c, r"^```[^\n]*\n?", ""), r"\s*```$", "")).otherwise(c)
    c = F.regexp_replace(c, r"^json\s*", "")
    got = F.from_json(c, "impact double, novelty double, significance double, reason string")
    ok = F.lit(True)
    for k in ("impact", "novelty", "significance"):
        ok = ok & F.coalesce(got[k].between(0, 10), F.lit(False))
    return F.when(ok, got)


def tier2(pending: DataFrame, replies: DataFrame, pub_counts: DataFrame, calls_today: Column) -> DataFrame:
    """Decide pending articles from model replies, best first up to the day's call cap; errors accept."""
    order = [F.desc("headline_score"), F.asc("article_id")]
    rows = pending.join(pub_counts, "publication_id", "left")
    capped = F.coalesce("accepted_24h", F.lit(0)) >= HARD_CAP
    open_ = rows.filter(~capped).select("article_id", "headline_score")
    served = first_rows(open_, order, MODEL_DAILY_CAP, rank="call_no").filter(
        F.col("call_no") <= F.lit(MODEL_DAILY_CAP) - calls_today).select("article_id", F.lit(True).alias("served"))
    scored = rows.withColumn("capped", capped).join(served, "article_id", "left").join(replies, "article_id", "left").withColumn(
        "s", parse_reply("reply"))
    composite = (F.col("s.impact") + F.col("s.novelty") + F.col("s.significance")) / 30.0
    status = (F.when(F.col("capped"), "rejected").when(F.col("served").isNull(), "accepted").when(F.col("s").isNull(), "accepted")
              .when(composite >= MODEL_ACCEPT, "accepted").otherwise("rejected"))
    why = (F.when(F.col("capped"), "publisher_cap").when(F.col("served").isNull(), "model_cap_reached")
           .when(F.col("reply").isNull(), "model_error").when(F.col("s").isNull(), "model_parse_error").otherwise("model_score"))
    score = F.when(why == "model_score", composite).otherwise(F.col("headline_score"))
    return scored.select("article_id", status.alias("status"), why.alias("cause"), score.alias("triage_score"))


def tier3(articles: DataFrame) -> DataFrame:
    """Best rejected article of every cluster that grew to the size and has nothing accepted and analysed."""
    stats = articles.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.max((F.col("triage_status") == "accepted") & (F.col("analyzer_status") == "completed")).alias("covered"))
    ripe = stats.filter((F.col("cluster_size") >= PROMOTE_SIZE) & ~F.col("covered"))
    fit = articles.filter((F.col("triage_status") == "rejected") & (F.col("headline_score") >= PROMOTE_SCORE)).join(ripe, "cluster_id")
    return top_k(fit, ["cluster_id"], [F.desc("headline_score"), F.asc("article_id")], 1).select(
        "cluster_id", "article_id", "cluster_size", F.lit("promoted").alias("status"))


def resolve_timeouts(articles: DataFrame, pub_counts: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Pending for longer than the timeout: accept, or reject when the publisher is at its cap."""
    late = articles.filter((F.col("triage_status") == "pending_llm") & (F.col("triaged_at") < as_of - F.expr(f"INTERVAL {hours} HOURS")))
    full = F.coalesce("accepted_24h", F.lit(0)) >= HARD_CAP
    return late.join(pub_counts, "publication_id", "left").select(
        "article_id", F.when(full, "rejected").otherwise("accepted").alias("status"))


def refresh_top(articles: DataFrame, sightings: DataFrame) -> DataFrame:
    """Articles seen again as top headline keep the higher score and return to triage unless accepted."""
    best = sightings.groupBy("article_id").agg(F.max("headline_score").alias("seen_score"))
    new = F.greatest("headline_score", "seen_score")
    status = F.when(F.col("triage_status").isin("accepted", "promoted"), F.col("triage_status")).otherwise("pending")
    return articles.join(best, "article_id").select("article_id", new.alias("headline_score"), F.lit(True).alias("is_top_headline"),
                                                    status.alias("triage_status"))
