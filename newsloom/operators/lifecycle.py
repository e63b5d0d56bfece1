"""State tables: readiness, budgeted selection, retries, resets, retention, feed health.

A transition is a new column value in a derived table; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.ranking import first_rows, top_k

MAX_ATTEMPTS = 3
STAGES = ["fetch", "process", "summary", "analyzer"]


def candidate_order() -> list[Column]:
    return [F.desc("headline_score"), F.desc("published_at"), F.asc("article_id")]


def readiness(raw_html: str, basic: str, clean: str) -> dict[str, Column]:
    """Which stage an article may enter next; lengths and attempts decide."""

    def longer(c: str, n: int) -> Column:
        return F.coalesce(F.length(c) > n, F.lit(False))

    def waiting(stage: str) -> Column:
        return (F.col(f"{stage}_status") == "pending") & (F.col(f"{stage}_attempts") < MAX_ATTEMPTS)

    return {
        "needs_fetch": waiting("fetch"),
        "needs_processing": (F.col("fetch_status") == "completed") & longer(raw_html, 100) & waiting("process"),
        "needs_summary": (longer(clean, 200) | longer(basic, 200)) & waiting("summary"),
        "needs_analysis": F.col("triage_status").isin("accepted", "promoted") & (F.col("summary_status") == "completed")
        & (longer(clean, 100) | longer(basic, 100)) & waiting("analyzer"),
    }


def best_content(choices: list[tuple[str, int, str]]) -> Column:
    """First text longer than its minimum, as ``struct(value, source)``; null when none is."""
    out = F.lit(None).cast("struct<value:string,source:string>")
    for name, minimum, label in reversed(choices):
        out = F.when(F.coalesce(F.length(name) > minimum, F.lit(False)), F.struct(F.col(name).alias("value"), F.lit(label).alias("source"))).otherwise(out)
    return out


def hybrid_route(source: str, url: str, deny: list[str], allow: list[str], everywhere: bool) -> Column:
    """Deny list, then allow list where there is one, then the global switch."""
    hay = [F.lower(text.nz(source)), F.lower(text.nz(url))]
    denied = text.contains_any(hay[0], deny) | text.contains_any(hay[1], deny)
    allowed = (text.contains_any(hay[0], allow) | text.contains_any(hay[1], allow)) if allow else F.lit(everywhere)
    return ~denied & allowed


def eligible(articles: DataFrame, pub_region: DataFrame, regions: list[str], as_of: Column, hours: int = 72) -> DataFrame:
    rows = articles.filter(F.col("triage_status").isin("accepted", "promoted")
                           & (F.col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    return rows.join(pub_region.filter(F.col("region_code").isin(regions)), "publication_id", "left_semi")


def budgeted(rows: DataFrame, day_start: Column, budget: int = 200) -> DataFrame:
    """Everything already started, plus the best new rows that today's remaining budget allows."""
    started = F.greatest(*[F.col(f"{s}_attempts") for s in STAGES]) > 0
    used = rows.agg(F.count_if(F.col("process_status").isin("completed", "processing", "failed") & (F.col("last_attempt_at") >= day_start))).scalar()
    fresh = ~started
    for s in STAGES:
        fresh = fresh & (F.col(f"{s}_status") == "pending")
    # at most ``budget`` rows: the one side that is broadcast, and no row of the table is shuffled for it
    new = first_rows(rows.filter(fresh).select("article_id", "headline_score", "published_at"), candidate_order(), budget, rank="place")
    new = new.filter(F.col("place") <= F.greatest(F.lit(0), F.lit(budget) - used)).select("article_id", F.lit("new").alias("_new"))
    entry = F.when(started, "in_flight").otherwise(F.col("_new"))
    return rows.join(F.broadcast(new), "article_id", "left").withColumn("entry", entry).filter("entry IS NOT NULL").drop("_new")


#: Least length of the text for a stage.
STAGE_CHARS = [0, 50, 200, 200]


def stage_candidates(selected: DataFrame, chars: str, limit: int) -> DataFrame:
    """``(article_id, stage)``: for every stage the best rows waiting for it whose predecessor is done and whose text is long enough.

    One pass: a row names the stages it waits for, and each stage is cut to its limit before the shuffle.
    """
    waits = []
    for i, s in enumerate(STAGES):
        cond = (F.col(f"{s}_status") == "pending") & (F.col(f"{s}_attempts") < MAX_ATTEMPTS)
        if i > 0:
            cond = cond & (F.col(f"{STAGES[i - 1]}_status") == "completed") & (F.col(chars) >= STAGE_CHARS[i])
        waits.append(F.when(cond, s))
    rows = selected.select("article_id", "headline_score", "published_at", F.explode(F.array_compact(F.array(*waits))).alias("stage"))
    return top_k(rows, ["stage"], candidate_order(), limit).select("article_id", "stage")


def fail_exhausted(rows: DataFrame) -> DataFrame:
    """Pending at the attempt limit becomes failed, stage by stage."""
    for s in STAGES:
        spent = (F.col(f"{s}_status") == "pending") & (F.col(f"{s}_attempts") >= MAX_ATTEMPTS)
        rows = rows.withColumn(f"{s}_status", F.when(spent, "failed").otherwise(F.col(f"{s}_status")))
    return rows


def retry_candidates(rows: DataFrame, stage: str, limit: int) -> DataFrame:
    """Failed rows with attempts left that were not skipped on purpose; a missing message counts as not skipped."""
    skipped = F.coalesce(F.startswith("error_message", F.lit("Skipped")), F.lit(False))
    keep = (F.col(f"{stage}_status") == "failed") & (F.col(f"{stage}_attempts") < MAX_ATTEMPTS) & ~skipped
    return first_rows(rows.filter(keep), candidate_order(), limit)


def stuck(rows: DataFrame, as_of: Column, hours: dict[str, float]) -> DataFrame:
    """``(article_id, stage)`` in progress with no start time or one older than the stage's timeout."""
    busy = {"fetch": "fetching", "process": "processing", "summary": "processing", "analyzer": "processing"}
    age = as_of.cast("double") - F.col("last_attempt_at").cast("double")
    hits = [F.when((F.col(f"{s}_status") == busy[s]) & (F.col("last_attempt_at").isNull() | (age > hours[s] * 3600)), F.lit(s)) for s in STAGES]
    return rows.select("article_id", F.explode(F.array_compact(F.array(*hits))).alias("stage"))


def expired(rows: DataFrame, as_of: Column, keep_hours: float, unfetched_hours: float) -> DataFrame:
    """Rows to drop, with the reason; the unfetched are named first."""
    age = as_of.cast("double") - F.col("fetched_at").cast("double")
    why = F.when((F.col("fetch_status") == "pending") & (age > unfetched_hours * 3600), "unfetched").when(age > keep_hours * 3600, "old")
    return rows.withColumn("reason", why).filter("reason IS NOT NULL")


def feed_health(attempts: DataFrame, feed: str, ts: str, id_col: str, ok: Column, pause: int = 5, disable: int = 10) -> DataFrame:
    """Errors since each feed's last success and the status that follows.

    Two partial aggregates instead of a run-length window: the last success, then the errors after it.
    """
    when = F.struct(F.col(ts), F.col(id_col))
    rows = attempts.select(F.col(feed).alias("feed"), when.alias("at"), ok.alias("ok"))
    last = rows.groupBy("feed").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    n = rows.join(last, "feed").groupBy("feed").agg(
        F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).alias("errors"))
    return n.withColumn("status", F.when(F.col("errors") >= disable, "disabled").when(F.col("errors") >= pause, "error").otherwise("active"))


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """New values over old ones where given; says what happened to each row."""
    o = old.select(key, *[F.col(v).alias(f"o_{v}") for v in values], F.lit(True).alias("had"))
    n = new.select(key, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("came"))
    same = F.lit(True)
    for v in values:
        same = same & F.coalesce(f"n_{v}", f"o_{v}").eqNullSafe(F.col(f"o_{v}"))
    what = F.when(F.col("had").isNull(), "created").when(F.col("came").isNull() | same, "kept").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"n_{v}", f"o_{v}").alias(v) for v in values], what.alias("action"))


def unique_facts(articles: DataFrame, topic: str, content: str, k: int) -> DataFrame:
    """``(topic, facts)``: the first ``k`` different lines of a topic's articles, newest article first.

    A line's place is its least (age, article, line) anywhere in the topic, a partial minimum; no topic is collected.
    """
    lines = articles.select(topic, (-F.unix_micros("published_at")).alias("age"), "article_id", F.posexplode(F.split(content, "\n")).alias("i", "fact"))
    first = lines.groupBy(topic, "fact").agg(F.min(F.struct("age", "article_id", "i")).alias("place"))
    few = top_k(first, [topic], [F.asc("place")], k)
    pairs = F.array_sort(F.collect_list(F.struct("place", "fact")))
    return few.groupBy(topic).agg(F.transform(pairs, lambda x: x["fact"]).alias("facts"))


def new_publications(articles: DataFrame, publications: DataFrame, id_col: str) -> DataFrame:
    """``(publication_id, domain, first_doc, articles)``: one new dimension row per domain that neither id nor domain knows."""
    open_ = articles.join(publications.select("publication_id"), "publication_id", "left_anti").join(publications.select("domain"), "domain", "left_anti")
    new = open_.groupBy("domain").agg(F.min(id_col).alias("first_doc"), F.count("*").alias("articles"))
    return new.select(F.concat(F.lit("new:"), "domain").alias("publication_id"), "domain", "first_doc", "articles")


def spread_metadata(known: DataFrame, fed: DataFrame, kinds: list[str]) -> DataFrame:
    """``(publication_id, kind, value)``: what publications have, and what their feeds bring, each once and in one pass."""
    brought = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]))
    rows = fed.select("publication_id", *kinds).distinct().select("publication_id", brought.alias("x")).select("publication_id", "x.*")
    return known.unionByName(rows).distinct()
