"""Story grouping and headline score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.functions.stopwords import TITLE_STOPWORDS
from newsloom.operators import stories
from newsloom.plans.registry import query
from newsloom.session import cut_lineage
from newsloom.sources.tables import as_of

W = r"[\p{L}\p{N}_]+"
STOP = " ".join(TITLE_STOPWORDS)


def _terms_sql(src: str, key: str, c: str) -> str:
    return f"""(SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(w, list_filter(list_transform(w,
      lambda x, i: x || ' ' || w[i+1]), lambda x: x IS NOT NULL))) AS term FROM (SELECT {key}, list_filter(regexp_extract_all(lower({c}), '{W}'),
      lambda x: length(x) >= 2 AND NOT list_contains(string_split('{STOP}',' '), x)) AS w FROM {src})) GROUP BY {key}, term)"""


def _vocab(src: str, c: str) -> str:
    return f"""tt AS {_terms_sql(src, 'article_id', c)}, nn AS (SELECT count(*) AS n FROM {src}),
vocab AS (SELECT term, ln((n+1)/(df+1)) + 1e0 AS idf FROM (SELECT term, count(*) AS df FROM tt GROUP BY term), nn WHERE df <= n*95e-2)"""


@query("tfidf_weights", uses="art", sql=f"""
WITH {_vocab('art', 'title')}, r AS (SELECT article_id, term, (1e0+ln(tf))*idf AS w FROM tt JOIN vocab USING (term))
SELECT article_id, term, round(w/sqrt(sum(w*w) OVER (PARTITION BY article_id)), 6) AS weight FROM r""")
def _(t):
    titles = t.art.select("article_id", "title")
    vocab = stories.fit_vocabulary(titles, "article_id", "title")
    return stories.tfidf(titles, "article_id", "title", vocab).select("article_id", "term", F.round("weight", 6).alias("weight"))


def _body(t):
    return t.art.select("article_id", "language", "published_at", F.concat("title", F.lit(" "), "description").alias("body"))


def _fitted(b):
    """Coverage variants, and the vocabulary of all bodies: each is read as its variant, with its copies."""
    variants = cut_lineage(stories.coverage_variants(b, "article_id", "body", "language", "published_at"))
    return variants, stories.fit_vocabulary(variants, "variant", "body", copies="copies")


PAIRS = f"""body AS (SELECT article_id, language, epoch(published_at)::BIGINT AS t, concat(title,' ',description) AS body FROM art), {_vocab('body', 'body')},
variants AS (SELECT language, t//21600 AS span, body, min(article_id) AS variant, count(*) AS copies, min(t) AS first_s, max(t) AS last_s FROM body GROUP BY ALL),
vt AS {_terms_sql('variants', 'variant', 'body')}, vr AS (SELECT variant, term, (1e0+ln(tf))*idf AS w FROM vt JOIN vocab USING (term)),
vw AS (SELECT variant, term, w/sqrt(sum(w*w) OVER (PARTITION BY variant)) AS w FROM vr),
cand AS (SELECT a.variant AS a, b.variant AS b FROM variants a JOIN variants b ON a.language = b.language AND a.variant < b.variant
   AND abs(a.span-b.span) <= 1 AND greatest(b.first_s-a.last_s, a.first_s-b.last_s) <= 21600),
pairs AS (SELECT a, b, round(sum(x.w*y.w),6) AS similarity FROM cand JOIN vw x ON x.variant = a JOIN vw y ON y.variant = b AND y.term = x.term
   GROUP BY a, b HAVING round(sum(x.w*y.w),6) >= 45e-2)"""


@query("story_pairs", uses="art", sql=f"WITH {PAIRS} SELECT * FROM pairs")
def _(t):
    b = _body(t)
    variants, vocab = _fitted(b)
    return stories.similar_coverage(variants, vocab)


@query("story_clusters", uses="art", sql=f"""
WITH RECURSIVE {PAIRS}, links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT variant AS x, variant AS y FROM variants UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS variant, min(y) AS story_id FROM reach GROUP BY x)
SELECT b.article_id, c.story_id FROM body b JOIN variants v ON v.language = b.language AND v.span = b.t//21600 AND v.body = b.body JOIN comp c USING (variant)""")
def _(t):
    b = _body(t)
    variants, vocab = _fitted(b)
    pairs = stories.similar_coverage(variants, vocab)
    return stories.story_clusters(b, variants, pairs, "article_id", "body", "language", "published_at")


BURST = """burst AS (SELECT cluster_id, count(*) AS article_count, epoch_us(min(published_at))//1000000 AS first_s, epoch_us(max(published_at))//1000000 AS last_s,
  CASE WHEN count(*) < 2 THEN 0e0 WHEN max(published_at) FILTER (rn = 3) - min(published_at) < INTERVAL 1 HOUR THEN 1e0
   WHEN max(published_at) FILTER (rn = 3) - min(published_at) < INTERVAL 2 HOUR THEN 8e-1
   ELSE least(count(*) FILTER (published_at - f < INTERVAL 2 HOUR)/5e0, 1e0) END AS burst
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at) AS rn, min(published_at) OVER (PARTITION BY cluster_id) AS f FROM SRC) GROUP BY cluster_id)"""


@query("burst_score", uses="arrivals", sql=f"WITH {BURST.replace('SRC', 'arrivals')} SELECT * FROM burst")
def _(t):
    return stories.burst_scores(t.arrivals, "cluster_id", "published_at")


@query("centrality", uses="arrivals", sql="""
SELECT cluster_id, round(least(log2(count(*)+1)/3e0, 1e0), 6) AS centrality FROM arrivals GROUP BY cluster_id""")
def _(t):
    return t.arrivals.groupBy("cluster_id").agg(F.count("*").alias("n")).select(
        "cluster_id", F.round(scoring.centrality("n"), 6).alias("centrality"))


@query("cluster_expiry", uses="arrivals", sql=f"""
WITH {BURST.replace('SRC', 'arrivals')} SELECT cluster_id, last_s >= 1706590800 - 43200 AS is_active FROM burst""")
def _(t):
    now = F.timestamp_seconds(F.lit(1706590800))
    return stories.expire(stories.burst_scores(t.arrivals, "cluster_id", "published_at"), now).select("cluster_id", "is_active")


MARKETS = """markets AS (SELECT language, coalesce(nullif(n,0), 15) AS active_feeds FROM (SELECT DISTINCT language FROM art)
   LEFT JOIN (SELECT language, count(*) AS n FROM pub_lang GROUP BY language) USING (language))"""
SCORE = """least(CASE WHEN AU > 9e-1 AND CS = 1 AND FS > 6e-1 THEN greatest(RAW, 6e-1) ELSE RAW END, 1e0)"""
_RAW = "((AU*25e-2 + CE*4e-1) + FS*2e-1 + BU*15e-2)"


def _score_sql(au: str, ce: str, fs: str, bu: str, cs: str, mk: str) -> str:
    boosted = f"(CASE WHEN {mk} < 12 THEN least({ce}*(12e0/greatest({mk},3)), 1e0) ELSE {ce} END)"
    return SCORE.replace("RAW", _RAW).replace("AU", au).replace("CE", boosted).replace("FS", fs).replace("BU", bu).replace("CS", cs)


@query("market_feed_counts", uses="art pub_lang", sql=f"WITH {MARKETS} SELECT * FROM markets")
def _(t):
    return stories.market_feeds(t.pub_lang, t.art.select("language"))


_NEW = _score_sql("coalesce(least(authority,1e1)/1e1,0e0)", "least(log2(article_count+1)/3e0,1e0)", "5e-1", "burst", "article_count", "coalesce(active_feeds,15)")
RESCORED = f"""{BURST.replace('SRC', 'art')}, {MARKETS}, rescored AS (SELECT article_id, headline_score AS old_score, {_NEW} AS new_score, is_top_headline AS was
  FROM art JOIN burst USING (cluster_id) LEFT JOIN pub USING (publication_id) LEFT JOIN markets USING (language))"""


@query("cluster_rescore", uses="art pub pub_lang", sql=f"""
WITH {RESCORED} SELECT article_id, old_score, round(new_score,6) AS new_score, new_score >= 6e-1 AS is_top_headline FROM rescored""")
def _(t):
    clusters = stories.burst_scores(t.art, "cluster_id", "published_at")
    out = stories.rescore_members(t.art, clusters, t.pub, stories.market_feeds(t.pub_lang, t.art.select("language")))
    return out.drop("was").withColumn("new_score", F.round("new_score", 6))


@query("rescore_report", uses="art pub pub_lang", sql=f"""
WITH {RESCORED} SELECT count(*) AS total, count(*) FILTER (new_score >= 6e-1 AND NOT was) AS promoted, count(*) FILTER (new_score < 6e-1 AND was) AS demoted,
  count(*) FILTER ((new_score >= 6e-1) = was) AS unchanged, round(1e2*count(*) FILTER (new_score >= 6e-1)/count(*), 4) AS pass_rate FROM rescored""")
def _(t):
    clusters = stories.burst_scores(t.art, "cluster_id", "published_at")
    out = stories.rescore_members(t.art, clusters, t.pub, stories.market_feeds(t.pub_lang, t.art.select("language")))
    now = F.col("is_top_headline")
    return out.agg(
        F.count("*").alias("total"), F.count_if(now & ~F.col("was")).alias("promoted"), F.count_if(~now & F.col("was")).alias("demoted"),
        F.count_if(now == F.col("was")).alias("unchanged"), F.round(F.count_if(now) * 100.0 / F.count("*"), 4).alias("pass_rate"))


@query("feed_signals", uses="arrivals", sql="""
WITH e AS (SELECT article_id, article_id%30 AS i, article_id%4 = 0 AS curated, topic, (article_id*7)%90 AS comments, article_id%5 = 1 AS top FROM arrivals)
SELECT article_id, round((CASE WHEN curated THEN greatest(1e0-i*15e-2, 2e-1) ELSE greatest(1e0-i*5e-2, 3e-1) END)*5e-1
   + (CASE WHEN topic = 'click' THEN 1e0 ELSE 0e0 END)*35e-2 + least((CASE WHEN article_id%3 = 0 THEN 0 ELSE comments END)/5e1, 1e0)*15e-2, 6) AS feed_signals,
  round(CASE WHEN top THEN least(1e0, greatest(1e0 - i*3e-2, 7e-1)*85e-2 + 15e-2) ELSE 3e-1 END, 6) AS api_signals FROM e""")
def _(t):
    e = t.arrivals.select("article_id", (F.col("article_id") % 30).alias("i"), (F.col("article_id") % 4 == 0).alias("curated"), "topic",
                          F.expr("IF(article_id%3 = 0, 'many', string((article_id*7)%90))").alias("comments"), (F.col("article_id") % 5 == 1).alias("top"))
    tags = F.array(F.when(F.col("topic") == "click", F.lit(" Breaking-News ")).otherwise(F.col("topic")))
    e = e.withColumn("none", F.lit(None).cast("string"))
    return e.select("article_id", F.round(scoring.feed_signals("i", "curated", tags, "comments", "none"), 6).alias("feed_signals"),
                    F.round(scoring.api_signals("top", "i"), 6).alias("api_signals"))


@query("headline_score", uses="art pub pub_lang", sql=f"""
WITH {BURST.replace('SRC', 'art')}, {MARKETS}, x AS (SELECT *, coalesce(least(authority,1e1)/1e1,0e0) AS a_, least(log2(article_count+1)/3e0,1e0) AS c_,
   (article_id%10)/1e1 AS f_ FROM art JOIN burst USING (cluster_id) LEFT JOIN pub USING (publication_id) LEFT JOIN markets USING (language))
SELECT article_id, round({_score_sql('a_', 'c_', 'f_', 'burst', 'article_count', 'active_feeds')}, 6) AS score FROM x""")
def _(t):
    clusters = stories.burst_scores(t.art, "cluster_id", "published_at")
    x = (t.art.join(clusters, "cluster_id").join(t.pub.select("publication_id", "authority"), "publication_id", "left")
         .join(stories.market_feeds(t.pub_lang, t.art.select("language")), "language", "left"))
    s = scoring.headline_score(scoring.authority01("authority"), scoring.centrality("article_count"), (F.col("article_id") % 10) / 10.0,
                               "burst", "article_count", "active_feeds")
    return x.select("article_id", F.round(s, 6).alias("score"))
