"""Daily digests for all users in one job.

Users share few distinct questions: a (topic, window, language) class is answered once from hourly
pre-aggregates or pre-cut heads, and users are then joined to the classes they follow. The work on articles
does not grow with the number of users, and the join meets a bounded number of rows per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators import vectors
from newsloom.operators.events import event_scores
from newsloom.operators.ranking import first_rows, top_k
from newsloom.session import cut_lineage

# offsets of civil time are multiples of a quarter of an hour
SLOT_S = 900


def windows(users: DataFrame, target_date: Column, mode: str = "window_mode", tz: str = "tz") -> DataFrame:
    """Adds the half-open UTC window ``[start_s, end_s)`` of each user's digest in the user's own time zone.

    Whole-day windows run between local midnights, so they follow clock changes; the rolling ones are exact
    hours back from the end of the target day. Unknown modes mean 48 hours.
    """

    def midnight(days: int) -> Column:
        return F.unix_seconds(F.to_utc_timestamp(F.date_add(target_date, days).cast("timestamp"), F.col(tz)))

    hours = F.when(F.col(mode) == "24h", 24).when(F.col(mode) == "72h", 72).otherwise(48)
    start = (F.when(F.col(mode) == "full_previous_day", midnight(-1)).when(F.col(mode) == "full_previous_2_days", midnight(-2))
             .otherwise(midnight(1) - hours * 3600))
    end = F.when(F.col(mode).isin("full_previous_day", "full_previous_2_days"), midnight(0)).otherwise(midnight(1))
    return users.withColumn("start_s", start).withColumn("end_s", end)


def wishes(users: DataFrame, user_topic: DataFrame, user_lang: DataFrame) -> DataFrame:
    """``(user_id, topic_id, lang_key, start_s, end_s)``; ``*`` where the user chose no language."""
    langs = user_lang.select("user_id", F.col("language").alias("lang_key"))
    return users.select("user_id", "start_s", "end_s").join(user_topic.select("user_id", "topic_id"), "user_id").join(
        langs, "user_id", "left").fillna("*", ["lang_key"])


def near_date(articles: DataFrame, target_date: str, hours: int = 72) -> DataFrame:
    """Articles that any user's window for the date can hold, whatever the time zone (UTC-12 to UTC+14).

    The bounds are literals, so they reach the scan and its partitions, and history is left unread.
    """
    close = F.lit(target_date).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    t = F.col("published_at")
    return articles.filter((t >= close - F.expr(f"INTERVAL {hours + 14} HOURS")) & (t < close + F.expr("INTERVAL 12 HOURS")))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lang_key", F.explode(F.array(F.lit("*"), F.col("language"))))


def _inside(slot: str = "slot") -> Column:
    return (F.col(slot) * SLOT_S >= F.col("start_s")) & (F.col(slot) * SLOT_S < F.col("end_s"))


def article_counts(articles: DataFrame, links: DataFrame, wish: DataFrame) -> DataFrame:
    """``(user_id, topic_id, n, newest)``: what each user's topics offer in the user's window."""
    rows = articles.select("article_id", "language", F.unix_seconds("published_at").alias("t")).join(links, "article_id")
    slots = _keyed(rows).groupBy("topic_id", "lang_key", F.floor(F.col("t") / SLOT_S).alias("slot")).agg(
        F.count("*").alias("n"), F.max(F.struct("t", "article_id")).alias("newest"))
    asked = wish.select("topic_id", "lang_key", "start_s", "end_s").distinct()
    by_class = asked.join(slots, ["topic_id", "lang_key"]).filter(_inside()).groupBy("topic_id", "lang_key", "start_s", "end_s").agg(
        F.sum("n").alias("n"), F.max("newest").alias("newest"))
    mine = wish.join(by_class, ["topic_id", "lang_key", "start_s", "end_s"])
    return mine.groupBy("user_id", "topic_id").agg(F.sum("n").alias("n"), F.max("newest")["article_id"].alias("newest"))


def top_events(articles: DataFrame, links: DataFrame, wish: DataFrame, related: DataFrame | None = None, k: int = 3,
               weight: float = 0.5) -> DataFrame:
    """``(user_id, topic_id, event_id, score, position)``: best events of each followed topic in the window.

    ``articles(article_id, topic_id, published_at)``; the language plays no part in event scores.
    """
    rows = articles.select("article_id", "topic_id", F.floor(F.unix_seconds("published_at") / SLOT_S).alias("slot")).join(links, "article_id")
    slots = event_scores(rows, ["topic_id", "slot"])
    asked = wish.select("topic_id", "start_s", "end_s").distinct()
    sums = asked.join(slots, "topic_id").filter(_inside()).groupBy("topic_id", "start_s", "end_s", "event_id").agg(F.sum("score").alias("score"))
    if related is not None:
        sums = sums.join(related, "event_id", "left").withColumn("score", F.col("score") + F.coalesce("related", F.lit(0)) * weight).drop("related")
    best = top_k(sums, ["topic_id", "start_s", "end_s"], [F.desc("score"), F.asc("event_id")], k, rank="position")
    mine = wish.select("user_id", "topic_id", "start_s", "end_s").distinct()
    return mine.join(best, ["topic_id", "start_s", "end_s"]).select("user_id", "topic_id", "event_id", "score", "position")


def fallback_articles(articles: DataFrame, links: DataFrame, wish: DataFrame, k: int = 30) -> DataFrame:
    """``(user_id, topic_id, article_id, position)``: newest summarised articles when a topic has no events.

    Articles whose own topic it is, or any linked ones where there are none. Each (topic, language, kind, slot)
    is cut to its newest ``k`` before windows are matched, which cannot lose a row of any answer.
    """
    newest = [F.desc("t"), F.asc("article_id")]
    rows = articles.select("article_id", "language", F.col("topic_id").alias("own"), F.unix_seconds("published_at").alias("t")).join(links, "article_id")
    rows = _keyed(rows.withColumn("primary", F.col("own") == F.col("topic_id")).withColumn("slot", F.floor(F.col("t") / SLOT_S)))
    heads = top_k(rows, ["topic_id", "lang_key", "primary", "slot"], newest, k)
    # whether an own article exists is asked before the language filter, as the topic is chosen first
    own_slots = rows.filter(F.col("primary") & (F.col("lang_key") == "*")).select("topic_id", "slot").distinct()
    asked = wish.select("topic_id", "lang_key", "start_s", "end_s").distinct()
    has_own = asked.select("topic_id", "start_s", "end_s").distinct().join(own_slots, "topic_id").filter(_inside()).select(
        "topic_id", "start_s", "end_s", F.lit(True).alias("has_own")).distinct()
    fit = asked.join(heads, ["topic_id", "lang_key"]).filter(_inside()).join(has_own, ["topic_id", "start_s", "end_s"], "left")
    fit = fit.filter(F.col("primary") | F.col("has_own").isNull())
    best = top_k(fit.select("topic_id", "lang_key", "start_s", "end_s", "article_id", "t"), ["topic_id", "lang_key", "start_s", "end_s"], newest, k)
    mine = wish.join(best, ["topic_id", "lang_key", "start_s", "end_s"]).select("user_id", "topic_id", "article_id", "t").distinct()
    return top_k(mine, ["user_id", "topic_id"], newest, k, rank="position")


def topic_event_groups(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Mentions and score of every event inside every topic."""
    rows = articles.select("article_id", F.col("topic").alias("topic")).join(links, "article_id")
    out = event_scores(rows, ["topic"])
    return out.withColumn("total_articles", F.col("primary_mentions") + F.col("secondary_mentions"))


def select_content(groups: DataFrame, max_topics: int = 4, max_events: int = 3) -> DataFrame:
    """Best topics by summed score, best events inside each: ``topic_score, topic_position, event_position``."""
    live = groups.filter("score > 0")
    topics = first_rows(live.groupBy("topic").agg(F.sum("score").alias("topic_score")), [F.desc("topic_score"), F.asc("topic")], max_topics, rank="topic_position")
    return top_k(live.join(topics, "topic"), ["topic"], [F.desc("score"), F.asc("event_id")], max_events, rank="event_position")


def recommended(rows: DataFrame, count: int = 3) -> DataFrame:
    """``(event_id, article_id, position)``: newest articles of unseen sources first, then the newest left.

    Only summarised articles count where an event has any. ``rows(event_id, article_id, source, published_at, has_summary)``.
    """
    any_summary = rows.groupBy("event_id").agg(F.max("has_summary").alias("any_summary"))
    fit = rows.join(any_summary, "event_id").filter(F.col("has_summary") | ~F.col("any_summary"))
    newest = [F.desc("published_at"), F.asc("article_id")]
    heads = top_k(fit, ["event_id", "source"], newest, count, rank="of_source")
    return top_k(heads, ["event_id"], [F.asc(F.col("of_source") > 1), *newest], count, rank="position").select("event_id", "article_id", "position")


def related_articles(links: DataFrame, rows: DataFrame, max_dist: float, per_event: int = 2, overall: int = 3) -> DataFrame:
    """``(event_id, article_id, from_event, position)``: the most relevant articles of similar events, copies of one centroid among them.

    ``rows(event_id, embedding)`` are all events; with an ``entity_id``, as of ``events.by_entity``, only events that share one are compared.
    An event's row carries its best articles, and those of its own that are among some event's best (per_event times all events at most);
    the comparison gives out ``overall`` articles per event and meeting of tiles, never the pairs.
    """
    block = ["entity_id"] if "entity_id" in rows.columns else []
    heads = cut_lineage(top_k(links, ["event_id"], [F.desc("relevance"), F.asc("article_id")], per_event).select("event_id", "article_id", "relevance"))
    lists = heads.groupBy("event_id").agg(F.collect_list(F.struct("article_id", "relevance")).alias("h"))
    own = links.select("event_id", "article_id").join(heads.select("article_id").distinct(), "article_id", "left_semi").groupBy("event_id").agg(
        F.collect_set("article_id").alias("own"))
    given = rows.select("event_id", "embedding", *block).join(lists, "event_id", "left").join(own, "event_id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    given = given.select("event_id", "embedding", *block, none(F.col("h.article_id"), "array<long>").alias("items"),
                         none(F.col("h.relevance"), "array<double>").alias("values"), none(F.col("own"), "array<long>").alias("own"))
    found = vectors.best_of_similar(given, "event_id", "embedding", block, 1.0 - max_dist, "items", "values", "own", overall)
    found = found.select(F.col("id").alias("event_id"), F.col("item").alias("article_id"), F.col("value").alias("relevance"), F.col("neighbour").alias("from_event"))
    one = top_k(found, ["event_id", "article_id"], [F.desc("relevance"), F.asc("from_event")], 1)
    return top_k(one, ["event_id"], [F.desc("relevance"), F.asc("article_id")], overall, rank="position")


def needs_enhancing(stored: DataFrame, current: DataFrame, stored_at: DataFrame, as_of_s: Column, hours: int = 6) -> DataFrame:
    """Whether an event's article set changed or its enhanced text is too old.

    Sets are compared by a full join of their members, never as gathered lists.
    """
    s = stored.select("event_id", "article_id", F.lit(True).alias("was"))
    c = current.select("event_id", "article_id", F.lit(True).alias("now"))
    diff = s.join(c, ["event_id", "article_id"], "full_outer").groupBy("event_id").agg(
        F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("changed"))
    fresh = (F.col("changed") == 0) & (as_of_s - F.col("stored_s") < hours * 3600)
    return diff.join(stored_at, "event_id", "left").select("event_id", (~F.coalesce(fresh, F.lit(False))).alias("needed"))


#: Facts and opinions that an article of each tier may give; null for all.
EVIDENCE_LIMITS = {"PRIMARY": (None, None), "SECONDARY": (None, None), "RELATED": (2, 1)}


def evidence(links: DataFrame, summaries: DataFrame, limits: dict = EVIDENCE_LIMITS) -> DataFrame:
    """``(event_id, kind, ordinal, tier, body)``: facts and opinions of an event's articles, the first time each is said.

    Tiers follow each other, articles by id within a tier, and what an article says in its order. A partial minimum finds where
    something is said first, so neither an event's articles nor its repeats meet in one task before they are one row.
    ``links(event_id, article_id, tier)``, ``summaries(article_id, facts, opinions)``.
    """
    tiers = list(limits)
    rank = F.coalesce(*[F.when(F.col("tier") == x, F.lit(k)) for k, x in enumerate(tiers)])

    def cut(c: str, which: int):
        out = F.col(c)
        for x, most in limits.items():
            if most[which] is not None:
                out = F.when(F.col("tier") == x, F.slice(c, 1, most[which])).otherwise(out)
        return out

    rows = links.join(summaries, "article_id").withColumn("rank", rank)
    said = rows.select("event_id", "rank", "article_id", F.explode(F.array(
        F.struct(F.lit("fact").alias("kind"), cut("facts", 0).alias("xs")), F.struct(F.lit("opinion").alias("kind"), cut("opinions", 1).alias("xs")))).alias("s"))
    said = said.select("event_id", "rank", "article_id", F.col("s.kind").alias("kind"), F.posexplode("s.xs").alias("at", "body"))
    first = said.groupBy("event_id", "kind", F.md5("body").alias("h")).agg(F.min(F.struct("rank", "article_id", "at", "body")).alias("f"))
    ordinal = F.row_number().over(W.partitionBy("event_id", "kind").orderBy("f.rank", "f.article_id", "f.at"))
    return first.select("event_id", "kind", ordinal.alias("ordinal"), F.get(F.array(*[F.lit(x) for x in tiers]), F.col("f.rank")).alias("tier"), F.col("f.body").alias("body"))
