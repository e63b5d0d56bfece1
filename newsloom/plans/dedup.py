"""Duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text, url
from newsloom.operators import dedup
from newsloom.operators.ranking import latest_by
from newsloom.plans.registry import query

W = r"[\p{L}\p{N}_]+"

NORM = r"""(SELECT page_id, url, concat('https://', regexp_replace(regexp_replace(lower(host),'^www\.',''),':(80|443)$',''),
   regexp_replace(path,'/+$',''), CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS url_norm FROM
  (SELECT page_id, url, regexp_extract(url,'^[a-z]+://([^/?#]*)',1) AS host, regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS path,
     array_to_string(list_sort(list_filter(string_split(regexp_extract(url,'\?([^#]*)',1),'&'),
       lambda p: regexp_matches(p,'^[^=]+=.+$') AND NOT list_contains(string_split('TRACK',' '), lower(split_part(p,'=',1))))),'&') AS q FROM pages))"""
NORM = NORM.replace("TRACK", " ".join(url.TRACKING))


@query("url_normalize", sql=f"SELECT page_id, url_norm FROM {NORM}")
def _(t):
    return t.pages.select("page_id", url.normalize_url("url").alias("url_norm"))


@query("url_normalize_fetch", sql=r"""
SELECT page_id, concat(regexp_extract(url,'^([a-z]+://[^?#]*)',1), CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS url_norm FROM
 (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url,'\?([^#]*)',1),'&'),
    lambda p: regexp_matches(p,'^[^=]+=.+$') AND NOT list_contains(string_split('TRACK',' '), lower(split_part(p,'=',1)))),'&') AS q FROM pages)
""".replace("TRACK", " ".join(url.FETCH_TRACKING)))
def _(t):
    return t.pages.select("page_id", url.normalize_fetch_url("url").alias("url_norm"))


_RAW_URL = "CASE WHEN page_id%4 = 0 THEN split_part(url, '://', 2) WHEN page_id%4 = 1 THEN concat('mailto:', page_id) ELSE url END"


@query("url_valid", sql=f"""
SELECT page_id, regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS valid FROM (SELECT page_id, {_RAW_URL} AS u FROM pages)""")
def _(t):
    return t.pages.selectExpr("page_id", f"{_RAW_URL} AS u").select("page_id", url.is_valid_url("u").alias("valid"))


@query("url_domain", sql=r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#]*)',1)),':\d+$',''),'^www\.','') AS domain,
  concat('https://logo.example.com/', regexp_replace(regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#]*)',1)),':\d+$',''),'^www\.','')) AS logo_url FROM pages""")
def _(t):
    d = url.domain_of(F.when(F.col("page_id") % 2 == 0, F.split_part("url", F.lit("://"), F.lit(2))).otherwise(F.col("url")))
    return t.pages.select("page_id", d.alias("domain"), url.logo_url(d).alias("logo_url"))


@query("url_malformed", sql=r"""
SELECT page_id, page_id%3 = 0 AS malformed, CASE WHEN page_id%3 = 0 THEN concat(url, '&a=1') ELSE url END AS repaired FROM pages""")
def _(t):
    bad = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("\\u0026a\\u003d1\\u201d,more"))).otherwise(F.col("url"))
    return t.pages.withColumn("u", bad).select("page_id", url.is_malformed("u").alias("malformed"), url.repair_url("u").alias("repaired"))


@query("image_upgrade", sql="""
SELECT page_id, CASE WHEN page_id%3 = 0 THEN concat('https://ichef.bbci.co.uk/ace/standard/960/p', page_id, '.jpg')
  WHEN page_id%3 = 1 THEN concat('https://static01.nyt.com/images/p', page_id, '-superJumbo.jpg') ELSE url END AS image_url FROM pages""")
def _(t):
    raw = F.expr("""CASE WHEN page_id%3 = 0 THEN concat('https://ichef.bbci.co.uk/ace/standard/240/p', page_id, '.jpg')
        WHEN page_id%3 = 1 THEN concat('https://static01.nyt.com/images/p', page_id, '-mediumSquareAt3X.jpg') ELSE url END""")
    return t.pages.select("page_id", url.upgrade_image(raw).alias("image_url"))


@query("dedup_url", sql=f"""
SELECT page_id, duplicate_of FROM (SELECT page_id, min(page_id) OVER (PARTITION BY url_norm) AS duplicate_of FROM
  (SELECT page_id, regexp_replace(url_norm, '/[0-9]+', '/') AS url_norm FROM {NORM})) WHERE duplicate_of < page_id""")
def _(t):
    # story numbers are folded so that pages of one section collide
    keyed = t.pages.select("page_id", F.regexp_replace(url.normalize_url("url"), "/[0-9]+", "/").alias("url_norm"))
    return dedup.first_with_key(keyed, "page_id", "url_norm", "duplicate_of").filter("duplicate_of is not null").select("page_id", "duplicate_of")


HASH = "md5(trim(concat(title,' ',description,' ',content)))"


@query("dedup_hash", uses="art", sql=f"""
SELECT article_id, duplicate_of FROM (SELECT article_id, min(article_id) OVER (PARTITION BY {HASH}) AS duplicate_of FROM art) WHERE duplicate_of < article_id""")
def _(t):
    keyed = t.art.select("article_id", text.content_hash("title", "description", "content").alias("content_hash"))
    return dedup.first_with_key(keyed, "article_id", "content_hash", "duplicate_of").filter("duplicate_of is not null").select("article_id", "duplicate_of")


@query("dup_hash_groups", uses="art", sql=f"""
SELECT {HASH} AS content_hash, count(*) AS copies, min(article_id) AS first_id FROM art GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return t.art.groupBy(text.content_hash("title", "description", "content").alias("content_hash")).agg(
        F.count("*").alias("copies"), F.min("article_id").alias("first_id")).filter("copies > 1")


@query("dedup_keep_latest", uses="art", sql=f"""
SELECT {HASH} AS content_hash, article_id FROM art QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY fetched_at DESC, article_id DESC) = 1""")
def _(t):
    keyed = t.art.select(text.content_hash("title", "description", "content").alias("content_hash"), "fetched_at", "article_id")
    return latest_by(keyed, ["content_hash"], ["fetched_at", "article_id"]).select("content_hash", "article_id")


# titles arrive in six-hour waves per source, so that near copies fall inside the window
TIMED = """timed AS (SELECT article_id, publication_id, title, description, content, TS AS published_at,
   concat(CASE WHEN article_id%2 = 0 THEN 'http://www.' ELSE 'https://' END, publication_id, '.example.com/story/', (article_id*17)%701,
          CASE WHEN article_id%3 = 0 THEN '?utm_source=feed' ELSE '/' END) AS url
   FROM SRC)"""
_TS_DUCK = "make_timestamp(1000000*(1706659200 - (age_s%21600)))"
_SIM = f"""sims AS (SELECT *, list_distinct(regexp_extract_all(lower(title),'{W}')) AS w FROM timed WHERE title <> ''),
near AS (SELECT b.article_id, min(a.article_id) AS first_id FROM sims a JOIN sims b ON a.publication_id = b.publication_id AND a.article_id < b.article_id
  AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 7200
  WHERE trim(lower(a.title)) = trim(lower(b.title)) OR (len(a.w) > 0 AND len(b.w) > 0 AND
    len(list_intersect(a.w,b.w)) / (len(a.w)+len(b.w)-len(list_intersect(a.w,b.w)))::DOUBLE > 85e-2) GROUP BY b.article_id)"""


def timed(t):
    url_ = F.expr("""concat(CASE WHEN article_id%2 = 0 THEN 'http://www.' ELSE 'https://' END, publication_id, '.example.com/story/',
        (article_id*17)%701, CASE WHEN article_id%3 = 0 THEN '?utm_source=feed' ELSE '/' END)""")
    return t.art.select("article_id", "publication_id", "title", "description", "content",
                        F.expr("timestamp_seconds(1706659200 - (age_s%21600))").alias("published_at"), url_.alias("url"))


@query("fuzzy_title_pairs", uses="art", sql=f"""
WITH {TIMED.replace('TS AS', _TS_DUCK + ' AS').replace('SRC', 'art')}, {_SIM} SELECT article_id, first_id AS duplicate_of FROM near""")
def _(t):
    return dedup.near_title(timed(t).select("article_id", "publication_id", "title", "published_at"), "article_id", "publication_id",
                            "title", "published_at", "duplicate_of").filter("duplicate_of is not null").select("article_id", "duplicate_of")


@query("dedup_3layer", uses="art", sql=f"""
WITH {TIMED.replace('TS AS', _TS_DUCK + ' AS').replace('SRC', 'art')}, {_SIM},
k AS (SELECT article_id, min(article_id) OVER (PARTITION BY publication_id, (article_id*17)%701) AS u,
   min(article_id) OVER (PARTITION BY {HASH}) AS h FROM timed),
m AS (SELECT k.article_id, CASE WHEN u < k.article_id THEN u END AS u, CASE WHEN h < k.article_id THEN h END AS h, first_id FROM k LEFT JOIN near USING (article_id))
SELECT article_id, coalesce(u, h, first_id) AS duplicate_of, CASE WHEN u IS NOT NULL THEN 'url' WHEN h IS NOT NULL THEN 'hash' ELSE 'title' END AS layer
FROM m WHERE coalesce(u, h, first_id) IS NOT NULL""")
def _(t):
    rows = timed(t).select("article_id", "publication_id", "title", "published_at", url.normalize_url("url").alias("url_norm"),
                           text.content_hash("title", "description", "content").alias("content_hash"))
    return dedup.three_layers(rows, "article_id", "url_norm", "content_hash", "publication_id", "title", "published_at")
