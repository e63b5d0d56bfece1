"""Feeds: base filter, semi-joins, relevance ranking, diversification, pages, all-user feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scoring
from newsloom.operators.ranking import first_rows, placed, rows_between, top_k

FEED_COLUMNS = ["article_id", "publication_id", "language", "title", "topic_id", "cluster_id",
                "published_at", "headline_score", "is_top_headline", "image_url"]


def base(articles: DataFrame) -> DataFrame:
    """Rows a feed may show: accepted, promoted or top headline, and summarised; heavy columns left out."""
    shown = F.col("triage_status").isin("accepted", "promoted") | F.col("is_top_headline")
    return articles.filter(shown & (F.col("summary_status") == "completed")).select(*FEED_COLUMNS)


def with_topics(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Topic ids of each article as a sorted list; an article has a handful of topics."""
    lists = links.groupBy("article_id").agg(F.sort_array(F.collect_set("topic_id")).alias("topic_ids"))
    return articles.join(lists, "article_id", "left")


def search(articles: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns, without pattern escapes."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    return articles.filter(hit)


def published_after(articles: DataFrame, moment: Column) -> DataFrame:
    return articles.filter(F.col("published_at") > moment)


def published_after_article(articles: DataFrame, article_id: int) -> DataFrame:
    """Newer than a reference article, looked up by a scalar subquery."""
    ref = articles.filter(F.col("article_id") == article_id).agg(F.max("published_at")).scalar()
    return articles.filter(F.col("published_at") > ref)


def with_topic(articles: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles linked to any of the topics (EXISTS)."""
    return articles.join(links.join(topics.select("topic_id"), "topic_id", "left_semi"), "article_id", "left_semi")


def with_region(articles: DataFrame, pub_region: DataFrame, codes: list[str]) -> DataFrame:
    """Articles whose publication covers one of the regions (EXISTS)."""
    return articles.join(pub_region.filter(F.col("region_code").isin(codes)), "publication_id", "left_semi")


def relevance(articles: DataFrame, publications: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``rank_score``: effective score times time decay."""
    pub = publications.select("publication_id", "authority")
    score = scoring.effective_score("headline_score", "authority") * scoring.time_decay("published_at", as_of)
    return articles.join(pub, "publication_id", "left").withColumn("rank_score", F.round(score, 9)).drop("authority")


def rank_order() -> list[Column]:
    return [F.desc("rank_score"), F.desc("published_at"), F.asc("article_id")]


def diversify_windows(df: DataFrame, keys: list[str], order: list[Column], per_source: int) -> DataFrame:
    """One article per cluster, then at most ``per_source`` per publication, as two top-k windows."""
    one = top_k(df, keys + ["cluster_id"], order, 1)
    return top_k(one, keys + ["publication_id"], order, per_source)


def diversify_fold(pool: DataFrame, keys: list[str], order_cols: list[str], ascending: list[bool],
                   per_source: int) -> DataFrame:
    """First-wins walk down each ranked pool: skip a story already kept and a source at its cap.

    A story counts as seen only when one of its articles was kept, which windows cannot say. The caller
    bounds every pool (``walk_pool``), so a group always fits a task.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_cols, ascending=ascending, kind="stable")
        taken: dict = {}
        stories: set = set()
        keep = []
        for source, story in zip(pdf["publication_id"], pdf["cluster_id"]):
            ok = story not in stories and taken.get(source, 0) < per_source
            keep.append(ok)
            if ok:
                taken[source] = taken.get(source, 0) + 1
                stories.add(story)
        out = pdf[keep].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    schema = T.StructType([*pool.schema.fields, T.StructField("position", T.LongType())])
    return pool.groupBy(*keys).applyInPandas(walk, schema=schema)


def walk_pool(ranked: DataFrame, keys: list[str], order: list[Column], wanted: int, per_source: int) -> DataFrame:
    """The rows that the first ``wanted`` positions of the first-wins walk can depend on, whatever the table's size.

    Of a story's articles from one source only the best counts: if it is passed over, so are the others. Before the
    walk has kept ``wanted`` articles it can pass over at most ``wanted`` rows of a source for their stories, and at most
    ``wanted / per_source`` rows of a story for their sources; so those many rows of each, and of the whole at most
    as many as all such sources and stories hold together, are enough.
    """
    full = wanted // per_source + 1
    one = top_k(ranked, [*keys, "publication_id", "cluster_id"], order, 1)
    few = top_k(one, [*keys, "publication_id"], order, wanted + per_source)
    few = top_k(few, [*keys, "cluster_id"], order, full + 1)
    return top_k(few, keys, order, full * (wanted + per_source) + wanted * (full + 1) + wanted)


def relevance_page(articles: DataFrame, publications: DataFrame, as_of: Column, page: int = 1, size: int = 20,
                   per_source: int = 5) -> DataFrame:
    """One page of the feed over all articles, ranked and diversified; ``has_next`` tells whether the walk goes on."""
    ranked = relevance(articles, publications, as_of).withColumn("page_no", F.lit(page)).select(
        "page_no", "article_id", "publication_id", "cluster_id", "published_at", "rank_score")
    pool = walk_pool(ranked, ["page_no"], rank_order(), page * size + 1, per_source)
    kept = diversify_fold(pool, ["page_no"], ["rank_score", "published_at", "article_id"], [False, False, True], per_source)
    kept = kept.filter(F.col("position") <= page * size + 1)
    kept = kept.withColumn("has_next", F.max("position").over(W.partitionBy("page_no")) > page * size)
    return kept.filter(F.col("position").between((page - 1) * size + 1, page * size))


def diversified_page(articles: DataFrame, order: list[Column], page: int, size: int, per_source: int = 5,
                     id_col: str = "article_id") -> DataFrame:
    """A diversified page of what comes after the pages before it, and whether more would follow.

    The rows of earlier pages are at most ``(page - 1) * size``; of the rest, only the first ``size + 1`` after
    diversification meet in one task.
    """
    earlier = first_rows(articles, order, (page - 1) * size).select(id_col) if page > 1 else None
    rest = articles.join(earlier, id_col, "left_anti") if earlier is not None else articles
    kept = first_rows(diversify_windows(rest, [], order, per_source), order, size + 1, rank="position")
    kept = kept.withColumn("has_next", F.max("position").over(W.partitionBy()) > size)
    return kept.filter(F.col("position") <= size)


#: Rows up to which a page is cut from the front of the order by every task; deeper ones are found by place.
SHALLOW = 1000


def page_slice(df: DataFrame, order: list[Column], page: int, size: int, shallow: int = SHALLOW) -> DataFrame:
    """A page with its number clamped to the pages there are, plus the page count.

    A deep page is found from the counts of a range-partitioned order, and only the partitions it lies in are read.
    """
    total = df.count()
    pages = max(-(-total // size), 1)
    number = min(max(page, 1), pages)
    if number * size <= shallow:
        rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    else:
        rows = rows_between(*placed(df, order), (number - 1) * size, number * size)
    return rows.select("*", F.lit(number).cast("long").alias("page"), F.lit(pages).cast("long").alias("total_pages"))


def personal_feeds(articles: DataFrame, links: DataFrame, user_topic: DataFrame, user_lang: DataFrame,
                   user_pub: DataFrame, size: int = 20) -> DataFrame:
    """The newest ``size`` articles of every user at once: followed topics, and languages and publications
    where the user has chosen any.

    A user's choices are exact keys with ``*`` for "any". The newest rows of each key are cut first, so the
    join meets at most ``size`` articles per key however many articles or followers a topic has.
    """
    any_ = F.lit("*")
    newest = [F.desc("published_at"), F.asc("article_id")]
    keyed = articles.join(links.select("article_id", F.col("topic_id").alias("followed")), "article_id").select(
        "article_id", "published_at", "followed",
        F.explode(F.array(*[F.struct(lang.alias("lang_key"), pub.alias("pub_key"))
                            for lang in (any_, F.col("language")) for pub in (any_, F.col("publication_id"))])).alias("k"),
    ).select("article_id", "published_at", "followed", "k.*")
    heads = top_k(keyed, ["followed", "lang_key", "pub_key"], newest, size)
    wants = (
        user_topic.select("user_id", F.col("topic_id").alias("followed"))
        .join(user_lang.withColumnRenamed("language", "lang_key"), "user_id", "left")
        .join(user_pub.withColumnRenamed("publication_id", "pub_key"), "user_id", "left")
        .fillna("*", ["lang_key", "pub_key"])
    )
    hits = wants.join(heads, ["followed", "lang_key", "pub_key"]).select("user_id", "article_id", "published_at").distinct()
    return top_k(hits, ["user_id"], newest, size, rank="position")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows of the new snapshot labelled new, updated or same against the old one."""
    before = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in compare], F.lit(True).alias("_seen"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_seen").isNull(), "new").when(same, "same").otherwise("updated")
    return new.join(before, key, "left").select(key, change.alias("change"))


def replace_preferences(current: DataFrame, incoming: DataFrame, valid: DataFrame, user: str, item: str) -> DataFrame:
    """Users in ``incoming`` lose their old rows and get the incoming ones that exist in the dimension."""
    kept = current.select(user, item).join(incoming.select(user).distinct(), user, "left_anti")
    added = incoming.select(user, item).distinct().join(valid.select(item).distinct(), item, "left_semi").select(user, item)
    return kept.unionByName(added)
