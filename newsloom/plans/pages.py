"""Page and block queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import html, text
from newsloom.functions.stopwords import ENGLISH
from newsloom.operators import pages, quality
from newsloom.plans.registry import query
from newsloom.session import checkpoint_root
from newsloom.sources.entries import project, read_entries, read_fixture, write_report
from newsloom.sources.tables import as_of

STRIP = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(X,'<[^>]+>',' ','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&#x27;',''''),'&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&amp;?','&','g'),'[\s ]+',' ','g'))"""
VIS = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
PARAS = rf"list_filter(list_transform(regexp_extract_all({VIS}, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda p: {STRIP.replace('X', 'p')}), lambda p: p <> '')"

# open-graph tags, an image and a teaser are planted, as the test pages have none
PLANT = """CASE WHEN page_id%3 = 0 THEN replace(html, '<head>', concat('<head><meta property="og:image" content="https://cdn.example.com/', page_id, '.jpg">'))
  WHEN page_id%3 = 1 THEN replace(html, '<head>', '<head><meta content="A short description" name="description">') ELSE html END"""


@query("page_meta", sql=f"""
SELECT page_id, CASE WHEN page_id%3 = 0 THEN concat('https://cdn.example.com/', page_id, '.jpg') ELSE '' END AS image,
  CASE WHEN page_id%3 = 1 THEN 'A short description' ELSE '' END AS description, {STRIP.replace('X', "regexp_extract(html,'(?is)<title(?:[ ][^>]*)?>(.*?)</title>',1)")} AS title FROM pages""")
def _(t):
    p = t.pages.withColumn("html", F.expr(PLANT))
    return p.select("page_id", F.coalesce(html.meta_tag("html", "og:image"), F.lit("")).alias("image"),
                    F.coalesce(html.meta_tag("html", "description"), F.lit("")).alias("description"), html.tag_text("html", "title").alias("title"))


@query("page_text", sql=f"""
SELECT page_id, {STRIP.replace('X', "regexp_extract(html,'(?is)<h1(?:[ ][^>]*)?>(.*?)</h1>',1)")} AS h1, len(p) AS paragraphs, md5(array_to_string(p, chr(10))) AS body_md5
FROM (SELECT page_id, html, {PARAS} AS p FROM pages)""")
def _(t):
    p = t.pages.select("page_id", html.tag_text("html", "h1").alias("h1"), html.paragraphs("html").alias("p"))
    return p.select("page_id", "h1", F.size("p").cast("long").alias("paragraphs"), F.md5(F.array_join("p", "\n")).alias("body_md5"))


TEASED = "CASE WHEN page_id%4 = 0 THEN replace(html, '</article>', '<div class=\"box paywall\">Subscribe to continue reading</div></article>') WHEN page_id%4 = 1 THEN replace(html, '</article>', '<p>Read more</p></article>') WHEN page_id%4 = 2 THEN replace(html, '</article>', '<div data-paywall=\"1\">x</div></article>') ELSE html END"
_PW = " + ".join(f"contains(low, '{x}')::INT" for x in html.PAYWALL_TEXT) + "".join(
    f" + regexp_matches(low, 'class=[\"''][^\"'']*\\b{c}\\b')::INT" for c in html.PAYWALL_CLASSES) + " + regexp_matches(low, '<[a-z][^>]*\\sdata-paywall([^a-z0-9_-]|$)')::INT" + "".join(
    f" + contains(body, '{x}')::INT" for x in html.TRUNCATION_TEXT if x not in html.PAYWALL_TEXT)


@query("paywall_flags", sql=f"""
SELECT page_id, ({_PW})::BIGINT AS signs, ({_PW}) >= 2 AS paywalled FROM (SELECT page_id, lower(html) AS low, lower(regexp_replace({VIS}, '<[^>]+>', ' ', 'g')) AS body
  FROM (SELECT page_id, {TEASED} AS html FROM pages))""")
def _(t):
    p = t.pages.select("page_id", F.expr(TEASED).alias("html")).withColumn("n", html.paywall_signs(F.col("html")))
    return p.select("page_id", F.col("n").cast("long").alias("signs"), (F.col("n") >= 2).alias("paywalled"))


# Pages built from the lines of documents, so that SQL knows every element without reading HTML.
HEAD = '<html><head><title>T</title><script>var react = 1</script></head><body class="home"><!-- c --><nav class="menu"><a href="/">Home page of the day</a></nav>'
OPENS = ['<article class="story">', '<section class="content">', '<div class="wrap grid">']
SHUTS = ["</article>", "</section>", "</div>"]
IMAGE = '<img src="https://cdn.example.com/i.jpg" alt="pic" width="640" height="480">'
KINDS = [(7, "<ul><li>", "</li></ul>", "list"), (5, "<blockquote><p>", "</p></blockquote>", "quote"), (11, "<h2>", "</h2>", "heading"), (13, '<div class="promo-box">', "</div>", "promo")]
#: Elements planted after the article, and of how many the id of the page decides.
PLANTED = [('<i class="column"></i>', 8), ('<div class="main-part"></div>', 6), ('<aside class="related">x</aside>', 4), ('<div class="breadcrumb"></div>', 5),
           ('<iframe src="https://twitter.com/e"></iframe>', 3), ("<video></video>", 2), ('<u class="chart"></u>', 5), ("<script>1</script>", 12)]
POPUP = '<b class="popup">hi</b>'


def _build(t):
    """``(page_id, l, html)``: lines and the page made of them."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), text.squeeze), lambda x: x != "")
    safe = F.transform(lines, lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))

    def element(x, k):
        i = k + 1
        out = F.concat(F.lit("<p>"), x, F.lit("</p>"))
        for n, a, b, _ in reversed(KINDS):
            out = F.when(i % n == 0, F.concat(F.lit(a), x, F.lit(b))).otherwise(out)
        return F.concat(out, F.when(i % 9 == 0, IMAGE).otherwise(""))

    i, first, end = F.col("page_id"), F.coalesce(F.get("s", F.lit(0)), F.lit("")), F.coalesce(F.try_element_at("s", F.lit(-1)), F.lit(""))
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % 3).cast("int"))
    page = F.concat(F.lit(HEAD), pick(OPENS), F.array_join(F.transform("s", element), ""), pick(SHUTS),
                    F.lit('<div class="sidebar"><p>'), first, F.lit("</p><p>"), end, F.lit('</p></div><div class="more"><a href="/x">'), first, F.lit("</a></div><footer>Contact us</footer>"),
                    *[F.repeat(F.lit(x), (i % n).cast("int")) for x, n in PLANTED], F.when(i % 10 == 3, POPUP).otherwise(""), F.lit("</body></html>"))
    rows = t.documents.select(F.col("doc_id").alias("page_id"), lines.alias("l"), safe.alias("s"))
    return rows.select("page_id", "l", page.alias("html"))


_KIND = "CASE " + " ".join(f"WHEN i%{n} = 0 THEN '{k}'" for n, _, _, k in KINDS) + " ELSE 'paragraph' END"
_ELEMENT = "CASE " + " ".join(f"WHEN i%{n} = 0 THEN concat('{a}', x, '{b}')" for n, a, b, _ in KINDS) + f" ELSE concat('<p>', x, '</p>') END || CASE WHEN i%9 = 0 THEN '{IMAGE}' ELSE '' END"
_PICK = lambda xs: f"CASE page_id%3 WHEN 0 THEN '{xs[0]}' WHEN 1 THEN '{xs[1]}' ELSE '{xs[2]}' END"
BUILT = rf"""b0 AS (SELECT doc_id AS page_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x,'[\s ]+',' ','g'))), lambda x: x <> '') AS l FROM documents),
b1 AS (SELECT *, list_transform(l, lambda x: replace(replace(replace(x,'&','&amp;'),'<','&lt;'),'>','&gt;')) AS s FROM b0),
built AS (SELECT page_id, l, concat('{HEAD}', {_PICK(OPENS)}, array_to_string(list_transform(s, lambda x, i: {_ELEMENT}), ''), {_PICK(SHUTS)}, '<div class="sidebar"><p>', coalesce(s[1],''), '</p><p>', coalesce(s[-1],''),
  '</p></div><div class="more"><a href="/x">', coalesce(s[1],''), '</a></div><footer>Contact us</footer>', {", ".join(f"repeat('{x}', (page_id%{n})::INT)" for x, n in PLANTED)},
  CASE WHEN page_id%10 = 3 THEN '{POPUP}' ELSE '' END, '</body></html>') AS html FROM b1),
ln AS (SELECT page_id, i, n, x, {_KIND} AS kind, length(x) AS c FROM (SELECT page_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM built)),
pg AS (SELECT page_id, l, html, coalesce(length(l[1]),0) AS c1, coalesce(length(l[1]),0) + coalesce(length(l[-1]),0) AS c2 FROM built),
sums AS (SELECT page_id, sum(c) AS c, coalesce(sum(c) FILTER (kind = 'promo'),0) AS promo, count(*) FILTER (kind = 'promo') AS promos FROM ln GROUP BY page_id),
p AS (SELECT page_id, l, html, c1, c2, coalesce(c,0)::BIGINT AS c, coalesce(promo,0)::BIGINT AS promo, coalesce(promos,0) AS promos FROM pg LEFT JOIN sums USING (page_id))"""


def _hits(ps, v):
    return "(" + " + ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {v} ELSE 0e0 END" for p in ps) + ")"


@query("page_complexity", sql=rf"""
WITH {BUILT}, q AS (SELECT *, lower(html) AS low, page_id AS i FROM p),
f AS (SELECT page_id, least(1e0, CASE WHEN i%4 = 0 THEN 4e-1 + least(3e-1, (i%5)*1e-1) ELSE 0e0 END + {_hits(pages.PAYWALL_PATTERNS, '1e-1')} + {_hits(pages.CUT_PATTERNS, '5e-2')}) AS paywall,
  least(1e0, CASE WHEN i%8 + (i%3 = 2)::INT >= 6 THEN 3e-1 ELSE 0e0 END + CASE WHEN i%6 + (i%3 = 1)::INT >= 4 THEN 2e-1 ELSE 0e0 END + CASE WHEN i%4 + 1 >= 3 THEN 2e-1 ELSE 0e0 END
    + CASE WHEN i%5 + 1 >= 4 THEN 1e-1 ELSE 0e0 END + CASE WHEN i%10 = 3 THEN 2e-1 ELSE 0e0 END) AS layout,
  least(1e0, least(4e-1, (i%3 + i%2)*1e-1) + (i%3)*1e-1 + least(3e-1, (i%5)*1e-1)) AS media,
  least(1e0, CASE WHEN 1 + i%12 > 10 THEN 3e-1 WHEN 1 + i%12 > 5 THEN 2e-1 ELSE 0e0 END + {_hits(pages.FRAMEWORKS, '1e-1')} + {_hits(pages.LOADERS, '5e-2')}
    + CASE WHEN i%6 + (i%3 = 1 AND c < 50)::INT > 2 THEN 2e-1 ELSE 0e0 END) AS dynamic,
  least(1e0, (30 + promo)/(31 + c + c2 + c1 + i%4 + CASE WHEN i%10 = 3 THEN 2 ELSE 0 END)::DOUBLE) AS noise,
  CASE i%3 WHEN 0 THEN 8e-1 WHEN 1 THEN 2e-1 ELSE 5e-1 END AS source FROM q),
s AS (SELECT *, round(paywall*25e-2 + layout*2e-1 + media*15e-2 + dynamic*15e-2 + noise*15e-2 + source*1e-1, 6) AS score FROM f)
SELECT page_id, round(paywall,6) AS paywall, round(layout,6) AS layout, round(media,6) AS media, round(dynamic,6) AS dynamic, round(noise,6) AS noise, source, score,
  CASE WHEN score >= 8e-1 THEN 'hybrid' WHEN score >= 6e-1 THEN 'llm_enhanced' ELSE 'algorithmic' END AS route FROM s""")
def _(t):
    i = F.col("page_id")
    p = _build(t).select("page_id", "html", F.concat(F.lit("Site"), (i % 3).cast("string"), F.lit(".example")).alias("source"),
                         (i % 4 == 0).alias("paywalled"), (i % 5).alias("signs"))
    out = pages.complexity(p, html.page_nodes(p), ["site0."], ["site1."])
    score = F.round(sum((F.col(k) * w for k, w in pages.WEIGHTS.items()), F.lit(0.0)), 6)
    return out.withColumn("score", score).select("page_id", *[F.round(k, 6).alias(k) for k in ("paywall", "layout", "media", "dynamic", "noise")], "source", "score",
                                                 pages.route(F.col("score")).alias("route"))


@query("built_blocks", sql=f"""
WITH {BUILT}, o AS (SELECT page_id, 2*i AS o, kind AS type, x FROM ln WHERE kind <> 'promo' UNION ALL SELECT page_id, 2*i + 1, 'image', 'pic' FROM ln WHERE i%9 = 0
 UNION ALL SELECT page_id, 1000000000, 'paragraph', l[1] FROM p WHERE len(l) > 0 UNION ALL SELECT page_id, 1000000001, 'paragraph', l[-1] FROM p WHERE len(l) > 0)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INT AS position, type, length(x)::INT AS chars, md5(x) AS content_md5 FROM o""")
def _(t):
    return pages.blocks(html.page_nodes(_build(t))).select("page_id", "position", "type", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


@query("built_clean", sql="WITH " + BUILT + """, k AS (SELECT *, len(l) > 0 AS side, c2 >= 200 AS prose, page_id%3 = 0 AS guarded, c1 >= 60 AS links FROM p)
SELECT page_id, length(html)::INT AS html_chars, (c - CASE WHEN guarded THEN 0 ELSE promo END + CASE WHEN prose THEN c2 ELSE 0 END + CASE WHEN links THEN 0 ELSE c1 END)::BIGINT AS kept_chars,
  (5 + page_id%4 + page_id%3 + page_id%12)::BIGINT AS removed_tag, 1::BIGINT AS removed_comment,
  (CASE WHEN guarded THEN 0 ELSE promos END + (side AND NOT prose)::INT + (page_id%10 = 3)::INT)::BIGINT AS removed_mark, links::BIGINT AS removed_links FROM k""")
def _(t):
    p = _build(t)
    return p.select("page_id", F.length("html").alias("html_chars")).join(pages.clean_counts(html.page_nodes(p)), "page_id", "left").fillna(0)


_BOX = """sum(CASE WHEN c >= 20 THEN pow(c::DOUBLE, 125e-2) ELSE 0e0 END::DECIMAL(24,6)) AS said, sum(CASE WHEN c >= 20 THEN c ELSE 0 END) AS n,
  sum(CASE WHEN c >= 20 THEN len(regexp_extract_all(x, '{CJK}')) ELSE 0 END) AS dense""".replace("{CJK}", text.CJK)


@query("built_containers", sql="WITH " + BUILT + f""", w AS (SELECT *, CASE page_id%3 WHEN 0 THEN 225e-2 WHEN 1 THEN 15e-1 ELSE 1e0 END AS m, CASE page_id%3 WHEN 0 THEN 'article' WHEN 1 THEN 'section' ELSE 'div' END AS wrap FROM ln),
box AS (SELECT page_id, 0 AS id, any_value(wrap) AS tag, any_value(m) AS m, {_BOX} FROM w GROUP BY page_id
 UNION ALL SELECT page_id, i, 'div', m - 75e-2, {_BOX} FROM w WHERE kind = 'promo' GROUP BY page_id, i, m
 UNION ALL SELECT page_id, 1000000000, 'div', 25e-2, {_BOX} FROM (SELECT page_id, c, x FROM ln WHERE i = 1 UNION ALL SELECT page_id, c, x FROM ln WHERE i = n) GROUP BY page_id
 UNION ALL SELECT page_id, 1000000001, 'div', 1e0, {_BOX} FROM ln WHERE i = 1 GROUP BY page_id),
sc AS (SELECT page_id, id, tag, said::DOUBLE * m * CASE WHEN dense/n >= 8e-1 THEN 36e-1 WHEN dense/n >= 5e-1 THEN 3e0 WHEN dense/n >= 2e-1 THEN 15e-1 ELSE 1e0 END AS score FROM box WHERE n > 0)
SELECT page_id, tag, round(score, 4) AS score, score >= 1600 AS good_enough FROM sc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, id DESC) = 1""")
def _(t):
    out = pages.best_container(html.page_nodes(_build(t)))
    return out.select("page_id", "tag", F.round("score", 4).alias("score"), (F.col("score") >= 1600).alias("good_enough"))


@query("page_blocks")
def _(t):
    return pages.blocks(html.page_nodes(t.pages)).select("page_id", "position", "type", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


@query("page_clean")
def _(t):
    size = t.pages.select("page_id", F.length("html").alias("html_chars"))
    return size.join(pages.clean_counts(html.page_nodes(t.pages)), "page_id", "left").fillna(0).withColumn(
        "reduction_pct", F.round((1.0 - F.col("kept_chars") / F.col("html_chars")) * 100.0, 2))


@query("container_scores")
def _(t):
    out = pages.best_container(html.page_nodes(t.pages))
    return out.select("page_id", "tag", F.round("score", 4).alias("score"), (F.col("score") >= 1600).alias("good_enough"))


# blocks by pattern, with planted images, for the queries that SQL can repeat
BLK = f"""blk AS (SELECT page_id, i - 1 AS position, CASE WHEN i%9 = 0 THEN 'image' WHEN i%5 = 0 THEN 'quote' ELSE 'paragraph' END AS type, p AS content,
   CASE WHEN i%18 = 0 THEN 'https://ads.example.com/banner.png' ELSE 'https://cdn.example.com/x.jpg' END AS src, CASE WHEN i%27 = 0 THEN 40 ELSE 800 END AS width, n
 FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (SELECT page_id, {PARAS} AS ps FROM pages)))"""


def _blocks(t):
    b = t.pages.select("page_id", html.paragraphs("html").alias("ps")).select("page_id", F.size("ps").alias("n"), F.posexplode("ps").alias("position", "content"))
    i = F.col("position") + 1
    return b.withColumn("type", F.when(i % 9 == 0, "image").when(i % 5 == 0, "quote").otherwise("paragraph")).withColumn(
        "src", F.when(i % 18 == 0, "https://ads.example.com/banner.png").otherwise("https://cdn.example.com/x.jpg")).withColumn(
        "width", F.when(i % 27 == 0, 40).otherwise(800))


@query("block_filter", sql=f"""
WITH {BLK} SELECT page_id, position, type FROM blk WHERE CASE type WHEN 'paragraph' THEN length(content) >= 20 AND NOT (length(content) < 100 AND regexp_matches(lower(content),'{'|'.join(pages.PROMO)}'))
  WHEN 'image' THEN NOT regexp_matches(src,'{'|'.join(pages.AD_IMAGE)}') AND width >= 100 ELSE true END""")
def _(t):
    b = _blocks(t)
    return b.filter(pages.keep_block(F.col("type"), F.col("content"), F.lit(""), F.col("src"), F.col("width"), F.lit(500))).select("page_id", F.col("position").cast("long").alias("position"), "type")


_MEDIA_SRC = "CASE WHEN page_id%5 = 0 THEN concat('https://ad.doubleclick.net/', page_id) WHEN page_id%5 = 1 THEN 'https://cdn.example.com/a.png' ELSE url END"


@query("media_filter", sql=f"""
SELECT page_id FROM pages WHERE NOT contains(lower({_MEDIA_SRC}), 'doubleclick') AND (page_id%2 = 1 OR (page_id%7 <> 0 AND NOT (page_id%6 = 0)))""")
def _(t):
    i = F.col("page_id")
    kind = F.when(i % 2 == 0, "image").otherwise("video")
    alt = F.when(i % 6 == 0, "Sponsored by us").otherwise("a view")
    size = F.when(i % 7 == 0, 1).otherwise(640)
    return t.pages.filter(pages.keep_media(kind, F.expr(_MEDIA_SRC), alt, size, size)).select("page_id")


@query("basic_quality", sql=rf"""
WITH {BLK}, a AS (SELECT page_id, sum(len(regexp_extract_all(content,'\S+'))) AS w, count(*) AS b, count(DISTINCT type) AS k FROM blk GROUP BY page_id)
SELECT page_id, round(least(1e0, w/5e2)*4e-1 + least(1e0, b/1e1)*3e-1 + least(1e0, k/4e0)*3e-1, 6) AS quality FROM a""")
def _(t):
    a = _blocks(t).groupBy("page_id").agg(F.sum(F.regexp_count("content", F.lit(r"\S+"))).alias("w"), F.count("*").alias("b"), F.countDistinct("type").alias("k"))
    return a.select("page_id", F.round(quality.basic_quality(F.col("w"), F.col("b"), F.col("k")), 6).alias("quality"))


SCORED = f"""{BLK}, scb AS (SELECT *, CASE type WHEN 'quote' THEN 7e0 WHEN 'image' THEN 4e0 ELSE 3e0 END + CASE WHEN position <= 3 THEN 3e0 WHEN position >= n-3 THEN 2e0
   WHEN position <= n*1e-1 THEN 1e0 WHEN position >= n*9e-1 THEN 1e0 ELSE 0e0 END AS base FROM blk),
btf AS (SELECT page_id, position, n, w, count(*) AS tf FROM (SELECT page_id, position, n, unnest(list_filter(regexp_extract_all(lower(content),'[\\p{{L}}\\p{{N}}_]+'),
   lambda w: length(w) BETWEEN 2 AND 15 AND NOT list_contains(string_split('{" ".join(ENGLISH)}', ' '), w))) AS w FROM blk) GROUP BY ALL),
bx AS (SELECT page_id, position, tf*log2(n/(count(*) OVER (PARTITION BY page_id, w))::DOUBLE) AS x FROM btf),
den AS (SELECT page_id, position, sum(x)/sqrt(sum(x*x))/count(*)*5e0 AS density FROM bx WHERE x > 0 GROUP BY page_id, position),
sc AS (SELECT scb.*, round(base + coalesce(density, 0e0), 6) AS score FROM scb LEFT JOIN den USING (page_id, position))"""


def _scored(b):
    base = pages.block_score(F.col("type"), F.col("position"), F.col("n"))
    rows = pages.with_density(b.select("page_id", "position", "type", "n", "content", F.length("content").alias("chars")))
    return rows.select("page_id", "position", "type", "chars", F.round(base + F.coalesce("density", F.lit(0.0)), 6).alias("score"))


@query("block_scores", sql=f"WITH {SCORED} SELECT page_id, position, score FROM sc")
def _(t):
    return _scored(_blocks(t)).select("page_id", F.col("position").cast("long").alias("position"), "score")


@query("block_budget", sql=f"""
WITH RECURSIVE {SCORED}, o AS (SELECT page_id, position, length(content) AS c, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS i FROM sc),
w AS (SELECT DISTINCT page_id, 0::BIGINT AS i, NULL::BIGINT AS position, false AS keep, 0::BIGINT AS used, false AS done FROM blk
 UNION ALL SELECT w.page_id, o.i, o.position, NOT done AND used + c <= 1500, CASE WHEN NOT done AND used + c <= 1500 THEN used + c ELSE used END, done OR (used + c > 1500 AND used >= 1200)
 FROM w JOIN o ON o.page_id = w.page_id AND o.i = w.i + 1)
SELECT page_id, position FROM w WHERE keep""")
def _(t):
    return pages.choose_blocks(_scored(_blocks(t)), 1500).withColumn("position", F.col("position").cast("long"))


@query("block_dedup", sql=rf"""
WITH b AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
k AS (SELECT page_id, position, regexp_replace(lower(trim(regexp_replace(content,'[\s ]+',' ','g'))), '[^\p{{L}}\p{{N}} ]', '', 'g') AS k FROM b)
SELECT page_id, min(position) AS position FROM k WHERE k <> '' GROUP BY page_id, k""")
def _(t):
    b = t.documents.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("position", "content"))
    return pages.unique_blocks(b).withColumn("position", F.col("position").cast("long"))


@query("sentence_rank", sql=r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text,'([.!?])\s+','\1'||chr(1),'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts,1) - 1 AS i, len(parts) AS n FROM p),
tf AS (SELECT doc_id, i, n, w, count(*) AS tf FROM (SELECT doc_id, i, n, unnest(list_filter(regexp_extract_all(lower(s),'[\p{L}\p{N}_]+'), lambda w: length(w) BETWEEN 2 AND 15 AND NOT list_contains(string_split('STOP', ' '), w))) AS w FROM s) GROUP BY ALL),
v AS (SELECT *, tf*log2(n/(count(*) OVER (PARTITION BY doc_id, w))::DOUBLE) AS x FROM tf), u AS (SELECT *, x/sqrt(sum(x*x) OVER (PARTITION BY doc_id, i)) AS u FROM v WHERE x > 0),
a AS (SELECT *, sum(u) OVER (PARTITION BY doc_id, w) AS allu FROM u), sc AS (SELECT doc_id, i, sum(u*allu) - 1e0 AS score FROM a GROUP BY doc_id, i),
r AS (SELECT s.doc_id, s.i, n, round(coalesce(score,0e0),6) + 0e0 AS score FROM s LEFT JOIN sc ON sc.doc_id = s.doc_id AND sc.i = s.i)
SELECT doc_id, i AS sentence, score, n <= 5 OR row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= greatest(1, floor(n*3e-1)) AS kept FROM r""".replace("STOP", " ".join(ENGLISH)))
def _(t):
    return pages.sentence_rank(t.documents, "doc_id", "text").withColumn("sentence", F.col("sentence").cast("long"))


@query("section_budget", sql="""
WITH s AS (SELECT doc_id, length(x) AS chars, i, CASE WHEN i = 1 THEN 1 WHEN i%3 = 0 THEN 3 ELSE 2 END AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) AS i FROM documents))
SELECT doc_id, i AS ordinal, greatest(0, least(chars, 2000 - coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY p, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS kept FROM s""")
def _(t):
    s = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("z", "x")).withColumn("ordinal", (F.col("z") + 1).cast("long"))
    s = s.withColumn("chars", F.length("x")).withColumn("priority", F.when(F.col("ordinal") == 1, 1).when(F.col("ordinal") % 3 == 0, 3).otherwise(2))
    return pages.section_budget(s, "doc_id", 2000).select("doc_id", "ordinal", F.col("kept").cast("long").alias("kept"))


def _block_array(t):
    b = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.when((i + F.col("doc_id")) % 4 == 0, "image").when((i + F.col("doc_id")) % 7 == 0, "video").otherwise("paragraph").alias("type"),
        F.concat(F.when(i % 2 == 0, "https://img.example.com/").otherwise("/rel/"), i.cast("string")).alias("src"),
        F.when(i == 0, 60).otherwise(640).alias("width"), F.lit(480).alias("height"), F.when(F.length(x) % 5 == 0, "Author headshot").otherwise("a view").alias("alt")))
    return t.documents.select("doc_id", b.alias("blocks"))


_BA = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) - 1 AS i FROM documents)"
_TY = "CASE WHEN (i+doc_id)%4 = 0 THEN 'image' WHEN (i+doc_id)%7 = 0 THEN 'video' ELSE 'paragraph' END"


@query("media_flags", sql=f"""
SELECT doc_id, bool_or(t = 'image') AS has_images, bool_or(t = 'video') AS has_videos, false AS has_audio, count(*) FILTER (t <> 'paragraph') AS media_count FROM (SELECT doc_id, {_TY} AS t FROM {_BA}) GROUP BY doc_id""")
def _(t):
    return _block_array(t).select("doc_id", *[c.alias(k) for k, c in pages.media_flags(F.col("blocks")).items()])


@query("first_image", sql=f"""
SELECT doc_id, coalesce(arg_min('https://img.example.com/' || i, i) FILTER ((i+doc_id)%4 = 0 AND i%2 = 0 AND i > 0 AND length(x)%5 <> 0), '') AS image FROM {_BA} GROUP BY doc_id""")
def _(t):
    return _block_array(t).select("doc_id", F.coalesce(pages.first_image(F.col("blocks")), F.lit("")).alias("image"))


# --- ingest ------------------------------------------------------------------------------


@query("ingest_explode_positions", sql="""
SELECT doc_id AS batch_id, i - 1 AS position, n AS total_entries, md5(x) AS title_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)),1) AS i, len(string_split(text, chr(10))) AS n FROM documents)""")
def _(t):
    # an API response holds a list of articles; the place in the list is a ranking signal
    response = F.to_json(F.struct(F.lit("ok").alias("status"), F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("title"))).alias("articles")))
    r = t.documents.select("doc_id", F.from_json(response, "status string, articles array<struct<title:string>>").alias("r"))
    return r.select(F.col("doc_id").alias("batch_id"), F.size("r.articles").cast("long").alias("total_entries"), F.posexplode("r.articles").alias("position", "a")).select(
        "batch_id", F.col("position").cast("long").alias("position"), "total_entries", F.md5("a.title").alias("title_md5"))


@query("rss_project", uses="art", sql=r"""
WITH e AS (SELECT article_id, title, CASE WHEN article_id%3 = 0 THEN title ELSE '' END AS summary, content, regexp_replace(trim(regexp_replace(content,'\s+',' ','g')),'<[^>]+>','','g') AS body FROM art),
p AS (SELECT *, string_split(regexp_replace(body,'([.!?]) +','\1'||chr(1),'g'), chr(1)) AS parts FROM e)
SELECT article_id, title, CASE WHEN summary <> '' THEN summary WHEN length(body) > 30 THEN substring(array_to_string(list_slice(parts,1,2),' '),1,500) ELSE '' END AS description, md5(content) AS content_md5,
  CASE WHEN article_id%4 = 0 THEN concat('https://media.example.com/', article_id, '.jpg') WHEN article_id%4 = 1 THEN concat('https://enc.example.com/', article_id, '.png') ELSE '' END AS image_url,
  CASE WHEN article_id%5 = 4 THEN 1706659200 ELSE 1704067200 + (article_id%1000)*60 END AS published_s FROM p""")
def _(t):
    i = F.col("article_id")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (i % 1000) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.to_json(F.struct(
        "title", F.when(i % 3 == 0, F.col("title")).alias("summary"), F.array(F.struct(F.col("content").alias("value"))).alias("content"),
        F.when(i % 4 == 0, F.array(F.struct(F.concat(F.lit("https://media.example.com/"), i.cast("string"), F.lit(".jpg")).alias("url")))).alias("media_thumbnail"),
        F.when(i % 4 == 1, F.array(F.struct(F.lit("image/png").alias("type"), F.concat(F.lit("https://enc.example.com/"), i.cast("string"), F.lit(".png")).alias("href")))).alias("enclosures"),
        F.when(i % 5 != 4, at).otherwise("soon").alias("published")))
    shape = ("title string, summary string, content array<struct<value:string>>, media_thumbnail array<struct<url:string>>, "
             "enclosures array<struct<type:string,href:string>>, published string")
    e = t.art.select("article_id", F.from_json(raw, shape).alias("e"))
    return project(e, "article_id", "e", as_of()).select("article_id", "title", "description", F.md5("content").alias("content_md5"),
                                                          F.coalesce("image_url", F.lit("")).alias("image_url"), F.unix_seconds("published_at").alias("published_s"))


@query("report_round_trip", uses="art pub", sql="""
SELECT publication_id, authority, count(*) AS articles, sum(length(title))::BIGINT AS title_chars, count(*) AS from_json FROM art JOIN pub USING (publication_id) GROUP BY publication_id, authority""")
def _(t):
    # in: JSON arrays of publications, a thousand or so a file, and entries as JSON lines; out: a report as JSON and as parquet; both read back
    folder = f"{checkpoint_root(t.spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    lots = max(1, t.pub.count() // 1000)
    pubs = t.pub.groupBy(F.pmod(F.xxhash64("publication_id"), F.lit(lots)).alias("lot")).agg(F.to_json(F.collect_list(F.struct("publication_id", "authority"))).alias("value"))
    pubs.write.partitionBy("lot").text(f"{folder}/publications")
    t.art.select("title", F.col("description").alias("summary"), F.array(F.struct(F.col("publication_id").alias("term"))).alias("tags")).write.json(f"{folder}/entries")
    landed = read_entries(t.spark, f"{folder}/entries").select(F.get("tags", F.lit(0))["term"].alias("publication_id"), F.length("title").alias("n"))
    counts = landed.groupBy("publication_id").agg(F.count("*").alias("articles"), F.sum("n").alias("title_chars"))
    report = read_fixture(t.spark, f"{folder}/publications").select("publication_id", "authority").join(counts, "publication_id")
    write_report(report, f"{folder}/report.json")
    write_report(report, f"{folder}/report.parquet", "parquet")
    again = t.spark.read.schema("publication_id string, articles long").json(f"{folder}/report.json").withColumnRenamed("articles", "from_json")
    return t.spark.read.schema(report.schema).parquet(f"{folder}/report.parquet").join(again, "publication_id").select(
        "publication_id", "authority", "articles", "title_chars", "from_json")
