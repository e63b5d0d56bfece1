"""Operational reports as single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.lifecycle import MAX_ATTEMPTS, STAGES
from newsloom.operators.ranking import first_rows

# US dollars per token by model, (input, output); a longer name is tried first.
CHAT_PRICES = [
    ("gpt-4.1-nano", "0.0000001", "0.0000004"), ("gpt-4.1-mini", "0.0000004", "0.0000016"), ("gpt-4.1", "0.000002", "0.000008"),
    ("gpt-4o-mini", "0.00000015", "0.0000006"),
]
EMBEDDING_PRICES = [("text-embedding-3-small", "0.00000002"), ("text-embedding-3-large", "0.00000013"), ("text-embedding-ada-002", "0.0000001")]


def share_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and their share of the total; the total is taken over the few counted rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


def success_report(df: DataFrame, status: str, keys: list[str], averages: dict[str, str], flags: dict[str, str] | None = None) -> DataFrame:
    """Attempts, successes, failures, success rate, averages and counts of flags per key (or in all)."""
    done = F.col(status) == "completed"
    return df.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(done).alias("succeeded"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.round(F.count_if(done) * 100.0 / F.count("*"), 6).alias("success_rate"),
        *[F.round(F.avg(c), 6).alias(name) for name, c in averages.items()],
        *[F.count_if(F.col(c)).alias(name) for name, c in (flags or {}).items()])


def route_report(df: DataFrame, quality: str, cost: str) -> DataFrame:
    """Route performance with a suggestion to move the model threshold."""
    per = df.groupBy("route").agg(F.count("*").alias("n"), F.avg(quality).alias("avg_quality"), F.avg(cost).alias("avg_cost"))
    total = per.withColumn("overall_cost", F.sum(F.col("n") * F.col("avg_cost")).over(W.partitionBy()) / F.sum("n").over(W.partitionBy()))
    tip = (F.when((F.col("route") == "algorithmic") & (F.col("avg_quality") > 0.8) & (F.col("n") > 10), "increase_llm_threshold")
           .when((F.col("route") == "ai") & (F.col("avg_quality") < 0.7) & (F.col("n") > 5), "decrease_llm_threshold").otherwise("keep"))
    return total.select("route", "n", F.round("avg_quality", 6).alias("avg_quality"), F.round("avg_cost", 9).alias("avg_cost"),
                        F.round("overall_cost", 9).alias("overall_cost"), tip.alias("suggestion"))


def stage_status(df: DataFrame) -> DataFrame:
    """All stage counters, the items still needing work and the completion rate, in one pass."""
    busy = {"fetch": "fetching", "process": "processing", "summary": "processing", "analyzer": "processing"}
    out: list[Column] = [F.count("*").alias("total")]
    full, needed = F.lit(True), F.lit(0)
    for i, s in enumerate(STAGES):
        st = F.col(f"{s}_status")
        waiting = (st == "pending") & (F.col(f"{s}_attempts") < MAX_ATTEMPTS)
        if i:
            waiting = waiting & (F.col(f"{STAGES[i - 1]}_status") == "completed")
        out += [F.count_if(waiting).alias(f"{s}_pending"), F.count_if(st == busy[s]).alias(f"{s}_processing"),
                F.count_if(st == "completed").alias(f"{s}_completed"), F.count_if(st == "failed").alias(f"{s}_failed")]
        full, needed = full & (st == "completed"), needed + F.count_if(waiting)
    out += [needed.alias("needing_work"), F.count_if(full).alias("fully_processed"),
            F.round(F.count_if(full) * 100.0 / F.count("*"), 6).alias("completion_rate")]
    return df.agg(*out)


def summary_health(df: DataFrame, as_of: Column, last: int = 100) -> DataFrame:
    """Queue counters with the mean cost of the most recent completed rows."""
    done = F.col("summary_status") == "completed"
    recent = first_rows(df.filter(done & F.col("process_cost").isNotNull()).select("published_at", "article_id", "process_cost"),
                        [F.desc("published_at"), F.asc("article_id")], last)
    cost = recent.agg(F.avg("process_cost")).scalar()
    pending, failed = F.count_if(F.col("summary_status") == "pending"), F.count_if(F.col("summary_status") == "failed")
    return df.agg(pending.alias("pending"), failed.alias("failed"),
                  F.count_if(done & (F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS"))).alias("completed_24h"),
                  F.round(F.coalesce(cost, F.lit(0.0)), 9).alias("avg_cost"), F.when(failed < pending * 0.1, "good").otherwise("degraded").alias("health"))


def usage_cost(usage: DataFrame) -> DataFrame:
    """Cost of every call from the price table, in exact decimals; unknown models cost nothing."""
    name = F.lower(F.coalesce("model", F.lit("")))
    d = "decimal(20,10)"
    cost = F.lit(None).cast(d)
    for model, p_in, p_out in reversed(CHAT_PRICES):
        each = (F.col("prompt_tokens").cast("decimal(12,0)") * F.lit(p_in).cast("decimal(12,10)")
                + F.col("completion_tokens").cast("decimal(12,0)") * F.lit(p_out).cast("decimal(12,10)")).cast(d)
        cost = F.when(F.contains(name, F.lit(model)), each).otherwise(cost)
    for model, p_in in EMBEDDING_PRICES:
        each = (F.col("prompt_tokens").cast("decimal(12,0)") * F.lit(p_in).cast("decimal(12,10)")).cast(d)
        cost = F.when(F.contains(name, F.lit(model)), each).otherwise(cost)
    return usage.withColumn("cost_usd", F.coalesce(cost, F.lit(0).cast(d)))


def daily_metrics(df: DataFrame, ts: str) -> DataFrame:
    """One row per day: volume, success rate, tokens (four characters each), per-stage failures and costs, mean duration."""
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("articles"), F.count_if(F.col("analyzer_status") == "completed").alias("analysed"),
        *[F.count_if(F.col(f"{s}_status") == "failed").alias(f"{s}_failures") for s in STAGES],
        F.round(F.count_if(F.col("analyzer_status") == "completed") * 100.0 / F.count("*"), 6).alias("success_rate"),
        F.sum(F.ceil(F.col("n_chars") / 4)).alias("tokens"), F.round(F.coalesce(F.sum("triage_cost"), F.lit(0.0)), 6).alias("triage_cost"),
        F.round(F.sum("process_cost"), 6).alias("cost"), F.round(F.avg("fetch_seconds"), 6).alias("avg_seconds"))


def count_by(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``(key, value, n)``: rows per value of several keys, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in keys.items()]))
    return df.select(pairs.alias("x")).select("x.*").groupBy("key", "value").agg(F.count("*").alias("n"))


def nested_counters(df: DataFrame, json: str) -> DataFrame:
    """``(issue, n, mean_score, most_common)`` over feedback texts ``{"review": {"issues": [...]}, "score": x}``."""
    seen = df.select(F.from_json(json, "review struct<issues: array<string>>, score double").alias("f"))
    n = seen.select(F.explode("f.review.issues").alias("issue"), F.col("f.score").alias("score")).groupBy("issue").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return n.withColumn("most_common", F.col("n") == n.agg(F.max("n")).scalar())
