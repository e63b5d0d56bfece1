"""Story grouping: title TF-IDF, similar coverage, clusters, centrality, burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.functions.stopwords import TITLE_STOPWORDS
from newsloom.operators import graph
from newsloom.operators.ranking import top_k
from newsloom.session import cut_lineage


def title_words(c) -> Column:
    """Words of two or more characters that are no stop words, in order."""
    return F.filter(text.tokens(c), lambda w: (F.length(w) >= 2) & ~w.isin(TITLE_STOPWORDS))


def term_counts(df: DataFrame, id_col: str, c: str, *keep: str) -> DataFrame:
    """``(id, keep..., term, tf)`` over the words and their adjacent pairs; rows are dealt by id as texts, so their terms are counted in place."""
    dealt = df.select(id_col, *keep, F.col(c).alias("_text")).repartition(id_col)
    words = dealt.select(id_col, *keep, title_words("_text").alias("words"))  # computed once, then read by position
    shifted = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.zip_with("words", shifted, lambda x, y: F.concat(x, F.lit(" "), y))
    terms = words.select(id_col, *keep, F.explode(F.concat("words", F.filter(pairs, lambda p: p.isNotNull()))).alias("term"))
    return terms.groupBy(id_col, *keep, "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(titles: DataFrame, id_col: str, c: str, max_features: int | None = None, max_df: float = 0.95, copies: str | None = None) -> DataFrame:
    """``(term, idf, alone)``: all terms of the texts with smoothed inverse document frequency; ``alone`` are those of a single text.

    Fit on the texts that are compared: rare terms are what tells stories apart and what keeps the joins selective.
    ``max_features`` keeps the most frequent terms only, for callers who want a vectoriser of fixed size.
    ``copies`` names a column that says how many texts a row stands for.
    """
    rows = titles.select(id_col, c, (F.col(copies) if copies else F.lit(1)).cast("long").alias("_n"))
    n = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    stats = term_counts(rows, id_col, c, "_n").groupBy("term").agg(F.sum("_n").alias("df"), F.sum(F.col("tf") * F.col("_n")).alias("cf"))
    kept = stats.filter(F.col("df") <= n * F.lit(max_df))
    if max_features is not None:
        kept = kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return cut_lineage(kept.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1.0).alias("idf"), (F.col("df") == 1).alias("alone")))


def tfidf(df: DataFrame, id_col: str, c: str, vocabulary: DataFrame, shared: bool = False) -> DataFrame:
    """``(id, term, idf, weight)`` with sublinear counts and unit length per row; ``shared`` leaves out, after that, terms of a single text."""
    raw = term_counts(df, id_col, c).join(vocabulary, "term").withColumn("raw", (F.log("tf") + 1.0) * F.col("idf"))
    # one row's terms only, at most the vocabulary
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(id_col)))
    out = raw.withColumn("weight", F.col("raw") / norm)
    return (out.filter("NOT alone") if shared else out).select(id_col, "term", "idf", "weight")


def coverage_variants(df: DataFrame, id_col: str, c: str, language: str, ts: str, window_s: int = 6 * 3600) -> DataFrame:
    """Identical texts of a language inside one window span as a single row with its copies and first/last time; ``h`` is the text's hash."""
    t = F.unix_seconds(ts)
    return df.groupBy(F.col(language).alias("language"), F.floor(t / window_s).alias("span"), text_key(c).alias("h")).agg(
        F.first(c).alias("body"), F.min(id_col).alias("variant"), F.count("*").alias("copies"), F.min(t).alias("first_s"), F.max(t).alias("last_s"))


def text_key(c: str) -> Column:
    """What stands for a text in keys of groups and joins."""
    return F.md5(F.col(c))


def similar_coverage(variants: DataFrame, vocabulary: DataFrame, threshold: float = 0.45, window_s: int = 6 * 3600,
                     fresh: str | None = None) -> DataFrame:
    """``(a, b, similarity)`` for variants of one language with cosine at or above the threshold whose times
    come within the window.

    Exact prefix filter for unit vectors: with terms in one global order, rarest first, the rarest term two
    vectors share must sit, in both, where the squared weights from it onward still reach threshold squared.
    Only those terms are joined, keyed by (language, span, term) against the same and the next span. With ``fresh``, a
    boolean column of the variants, pairs of two rows that are not fresh are left out before the join. The vocabulary was fitted on
    texts that these are among, so no pair shares a term of a single text: such terms count in a row's length and go before anything is joined.
    """
    weights = cut_lineage(tfidf(variants, "variant", "body", vocabulary, shared=True))  # read four times below
    pairs = candidates(weights, variants, threshold, window_s, fresh).distinct()
    wa = weights.select(F.col("variant").alias("a"), "term", F.col("weight").alias("wa"))
    wb = weights.select(F.col("variant").alias("b"), "term", F.col("weight").alias("wb"))
    scored = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(
        F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def candidates(weights: DataFrame, variants: DataFrame, threshold: float, window_s: int, fresh: str | None = None, bound: bool = True) -> DataFrame:
    """``(a, b)``, once per shared term at which the pair can still reach the threshold.

    Were a term the rarest that two vectors share, their product could be at most this term's part and the product of the lengths of what
    comes after it in both. Below the threshold the row goes at once: a pair that reaches it has a row at its rarest shared term.
    """
    onward = W.partitionBy("variant").orderBy(F.asc("idf"), F.desc("term")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tail = F.sum(F.col("weight") * F.col("weight")).over(onward)
    heads = weights.withColumn("tail", tail).filter(F.col("tail") >= threshold * threshold - 1e-9)
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("tail") - F.col("weight") * F.col("weight")))
    heads = heads.select("variant", "term", "weight", rest.alias("rest"))
    new = F.col(fresh) if fresh else F.lit(True)
    heads = heads.join(variants.select("variant", "language", "span", "first_s", "last_s", new.alias("new")), "variant")
    left = heads.withColumn("meet", F.explode(F.array(F.col("span"), F.col("span") + 1)))
    right = heads.select("language", F.col("span").alias("meet"), "term", F.col("variant").alias("v2"), F.col("span").alias("span2"), F.col("weight").alias("weight2"),
                         F.col("rest").alias("rest2"), F.col("first_s").alias("first2"), F.col("last_s").alias("last2"), F.col("new").alias("new2"))
    later = (F.col("span2") > F.col("span")) | (F.col("variant") < F.col("v2"))
    close = F.greatest(F.col("first2") - F.col("last_s"), F.col("first_s") - F.col("last2")) <= window_s
    reach = F.col("weight") * F.col("weight2") + F.col("rest") * F.col("rest2") >= threshold - 1e-6 if bound else F.lit(True)
    met = left.filter("new").join(right, ["language", "meet", "term"])
    if fresh:
        met = met.unionByName(left.filter("NOT new").join(right.filter("new2"), ["language", "meet", "term"]))
    return met.filter(later & close & reach & (F.col("variant") != F.col("v2"))).select(
        F.least("variant", "v2").alias("a"), F.greatest("variant", "v2").alias("b"))


def story_clusters(df: DataFrame, variants: DataFrame, pairs: DataFrame, id_col: str, c: str, language: str, ts: str,
                   window_s: int = 6 * 3600) -> DataFrame:
    """``(id, story_id)``: components of similar coverage, named by their earliest id."""
    comp = graph.components(pairs).withColumnRenamed("id", "variant")
    named = variants.join(comp, "variant", "left").select(
        F.col("language").alias(language), "span", "h", F.coalesce("component", "variant").alias("story_id"))
    keyed = df.select(id_col, language, F.floor(F.unix_seconds(ts) / window_s).alias("span"), text_key(c).alias("h"))
    return keyed.join(named, [language, "span", "h"]).select(id_col, "story_id")


def burst_scores(df: DataFrame, cluster: str, ts: str) -> DataFrame:
    """``(cluster, article_count, first_s, last_s, burst)``: 1 or 0.8 when the third article came within one or
    two hours of the first, else a fifth per article inside two hours; 0 below two articles."""
    t = F.unix_micros(ts)
    rows = df.filter(F.col(ts).isNotNull()).select(cluster, t.alias("t"))
    heads = top_k(rows, [cluster], [F.asc("t")], 3, rank="rn").groupBy(cluster).agg(
        F.min("t").alias("first"), F.max(F.when(F.col("rn") == 3, F.col("t"))).alias("third"))
    h = 3600 * 1000000
    counts = rows.join(heads, cluster).groupBy(cluster, "first", "third").agg(
        F.count("*").alias("article_count"), F.max("t").alias("last"),
        F.count_if(F.col("t") - F.col("first") < 2 * h).alias("early"))
    third = F.col("third") - F.col("first")
    burst = (F.when(F.col("article_count") < 2, 0.0).when(third < h, 1.0).when(third < 2 * h, 0.8)
             .otherwise(F.least(F.col("early") / 5.0, F.lit(1.0))))
    return counts.select(cluster, "article_count", F.floor(F.col("first") / 1000000).alias("first_s"),
                         F.floor(F.col("last") / 1000000).alias("last_s"), burst.alias("burst"))


def expire(clusters: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    return clusters.withColumn("is_active", F.col("last_s") >= F.unix_seconds(as_of) - hours * 3600)


def market_feeds(feeds: DataFrame, languages: DataFrame, default: int = 15) -> DataFrame:
    """Active feeds per language, with a default for languages that have none."""
    n = feeds.groupBy("language").agg(F.count("*").alias("n"))
    return languages.select("language").distinct().join(n, "language", "left").select(
        "language", F.coalesce(F.expr("nullif(n, 0)"), F.lit(default)).cast("long").alias("active_feeds"))


def rescore_members(articles: DataFrame, clusters: DataFrame, publications: DataFrame, markets: DataFrame,
                    cluster: str = "cluster_id") -> DataFrame:
    """New headline score of every member from its cluster's present size and burst, with neutral feed signals; ``was`` is the old flag."""
    rows = (
        articles.join(clusters.select(cluster, "article_count", "burst"), cluster)
        .join(publications.select("publication_id", "authority"), "publication_id", "left")
        .join(markets, "language", "left")
    )
    new = scoring.headline_score(
        scoring.authority01("authority"), scoring.centrality("article_count"), F.lit(0.5), F.col("burst"),
        F.col("article_count"), F.coalesce("active_feeds", F.lit(15)))
    return rows.select("article_id", F.col("headline_score").alias("old_score"), F.col("is_top_headline").alias("was"), new.alias("new_score"),
                       (new >= scoring.HEADLINE_THRESHOLD).alias("is_top_headline"))
