"""Queries over text columns: hashes, tokens, titles, labels, bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.plans.registry import query
from newsloom.sources.tables import as_of

W = r"[\p{L}\p{N}_]+"


@query("content_hash", uses="art", sql="""
SELECT article_id, CASE WHEN trim(concat(title,' ',description,' ',content)) <> ''
         THEN md5(trim(concat(title,' ',description,' ',content))) END AS content_hash,
       concat(publication_id, ':', substring(md5(concat(publication_id,'/',article_id)),1,8)) AS source_article_id
FROM art""")
def _(t):
    return t.art.select(
        "article_id", text.content_hash("title", "description", "content").alias("content_hash"),
        text.source_article_id("publication_id", F.concat("publication_id", F.lit("/"), "article_id")).alias("source_article_id"))


@query("event_hash", uses="art", sql="""
SELECT article_id, substring(sha256(lower(concat(title, array_to_string(
    list_slice(string_split(content, chr(10)), 1, 2), '')))),1,20) AS event_hash FROM art""")
def _(t):
    return t.art.select("article_id", text.event_hash("title", F.split("content", "\n")).alias("event_hash"))


@query("entity_canonical", uses="pub", sql=r"""
SELECT a.doc_id AS article_id, trim(regexp_replace(regexp_replace(trim(lower(split_part(a.text, '.', 1))),
   '[^\p{L}\p{N}_\s$.\-]', '', 'g'), '\s+', ' ', 'g')) AS canonical_name FROM documents a""")
def _(t):
    return t.documents.select(F.col("doc_id").alias("article_id"),
                              text.canonical_entity(F.split_part("text", F.lit("."), F.lit(1))).alias("canonical_name"))


@query("strip_html", sql=r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html,'<[^>]+>',' ','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&#x27;',''''),
  '&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&amp;?','&','g'),'[\s ]+',' ','g')) AS plain FROM pages""")
def _(t):
    return t.pages.select("page_id", text.strip_html("html").alias("plain"))


@query("char_references", sql=f"""
SELECT doc_id, concat(w[1], 'é', w[2], ' € 😀 &lt; ©2020 ¬it; ♥ € � &bogus; &;', 'Á', w[3], ' ≂̸') AS plain FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE len(w) >= 3""")
def _(t):
    # words of the texts around planted references
    w = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("w")).filter(F.size("w") >= 3)
    said = F.concat(F.get("w", F.lit(0)), F.lit("&eacute;"), F.get("w", F.lit(1)), F.lit(" &#8364; &#x1F600; &amp;lt; &copy2020 &notit; &hearts; &#128; &#0; &bogus; &;&Aacute"),
                    F.get("w", F.lit(2)), F.lit(" &NotEqualTilde;"))
    return w.select("doc_id", text.unescape(said).alias("plain"))


@query("clean_text", sql=r"""
SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS clean FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("clean"))


@query("content_metrics", uses="art", sql=f"""
SELECT article_id, words, CASE WHEN words > 0 THEN round_even(words/238e0, 1) ELSE 5e-1 END AS read_minutes
FROM (SELECT article_id, len(regexp_extract_all(concat(title,' ',description,' ',content), '{W}')) AS words FROM art)""")
def _(t):
    words = text.word_count(text.full_text("title", "description", "content"))
    return t.art.select("article_id", words.alias("words"), text.read_minutes(words).alias("read_minutes"))


@query("keywords", uses="art", sql=f"""
SELECT article_id, coalesce(array_to_string(list_slice(list_sort(list_distinct(list_filter(
   regexp_extract_all(lower(concat(title,' ',description)), '{W}'),
   lambda w: regexp_full_match(w, '[a-zA-ZÀ-ú]{{3,15}}') AND NOT list_contains(
   string_split('{" ".join(text.KEYWORD_STOPWORDS)}',' '), w)))), 1, 10), ','), '') AS keywords FROM art""")
def _(t):
    return t.art.select("article_id", F.array_join(text.keywords("title", "description"), ",").alias("keywords"))


@query("desc_fallback", uses="art", sql=r"""
WITH b AS (SELECT article_id, title, trim(regexp_replace(regexp_replace(content,'<[^>]+>','','g'),'\s+',' ','g')) AS body FROM art),
s AS (SELECT article_id, title, body, string_split(regexp_replace(body,'([.!?]) +','\1'||chr(1),'g'), chr(1)) AS parts FROM b)
SELECT article_id, CASE WHEN article_id%4 = 0 AND title <> '' THEN title WHEN length(body) > 30
   THEN substring(array_to_string(list_slice(parts,1,2),' '),1,500) ELSE '' END AS description FROM s""")
def _(t):
    given = F.when(F.col("article_id") % 4 == 0, F.col("title"))
    return t.art.select("article_id", text.description_or_lead(given, "content").alias("description"))


@query("title_jaccard", uses="art", sql=f"""
WITH p AS (SELECT article_id, title, description AS other FROM art),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(title),'{W}')) AS a,
             list_distinct(regexp_extract_all(lower(other),'{W}')) AS b FROM p),
c AS (SELECT *, len(list_intersect(a,b)) AS i FROM k)
SELECT article_id, round(CASE WHEN title = '' OR other = '' THEN 0e0 WHEN trim(lower(title)) = trim(lower(other)) THEN 1e0
   WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE i/(len(a)+len(b)-i)::DOUBLE END, 6) AS similarity FROM c""")
def _(t):
    return t.art.select("article_id", F.round(text.title_similarity("title", "description"), 6).alias("similarity"))


@query("title_levenshtein", uses="art", sql="""
SELECT article_id, levenshtein(h, d) AS distance,
  round(CASE WHEN greatest(length(h),length(d)) = 0 THEN 1e0
     ELSE 1e0 - levenshtein(h,d)/greatest(length(h),length(d))::DOUBLE END, 6) AS ratio,
  (h = d OR contains(h, d) OR contains(d, h)) AS contained
FROM (SELECT article_id, regexp_replace(lower(split_part(title, ',', 1)),'[^ -~]','?','g') AS h,
             regexp_replace(lower(split_part(description, ' ', 1)),'[^ -~]','?','g') AS d FROM art)""")
def _(t):
    # letters outside ASCII become one mark on both sides, since DuckDB counts edits in bytes
    def plain(c, sep):
        return F.regexp_replace(F.lower(F.split_part(c, F.lit(sep), F.lit(1))), "[^ -~]", "?")

    h, d = plain("title", ","), plain("description", " ")
    return t.art.select("article_id", F.levenshtein(h, d).alias("distance"), F.round(text.levenshtein_ratio(h, d), 6).alias("ratio"),
                        ((h == d) | F.contains(h, d) | F.contains(d, h)).alias("contained"))


@query("title_quality", uses="art", sql=r"""
SELECT article_id, round(CASE WHEN title = '' THEN -5e-2 ELSE greatest(-1e-1, least(8e-2,
   CASE WHEN regexp_matches(title, '(?i)\d+%|\$[\d.]+[BMK]?|R\$\s?[\d.,]+|\d+\s*(million|billion|milhão|bilhão)') THEN 5e-2 ELSE 0e0 END
 + CASE WHEN len(regexp_extract_all(title, '(?:^|[^\p{L}\p{N}_])[A-Z][a-záéíóúãõç]+(?:\s[A-Z][a-záéíóúãõç]+)*')) >= 2 THEN 3e-2 ELSE 0e0 END
 + CASE WHEN regexp_matches(title, '\?\s*$') THEN -3e-2 ELSE 0e0 END
 + CASE WHEN regexp_matches(title, '(?:^|[^\p{L}\p{N}_])[A-Z]{5,}(?:$|[^\p{L}\p{N}_])') THEN -5e-2 ELSE 0e0 END
 + CASE WHEN length(title) < 25 THEN -5e-2 ELSE 0e0 END
 + CASE WHEN regexp_matches(title, '(?i)^\d+\s+(coisas|dicas|fatos|razões|things|tips|ways|reasons)(?:$|[^\p{L}\p{N}_])') THEN -3e-2 ELSE 0e0 END)) END, 6) AS title_adjustment
FROM art""")
def _(t):
    return t.art.select("article_id", F.round(scoring.title_quality("title"), 6).alias("title_adjustment"))


@query("time_decay", uses="art", sql="""
SELECT article_id, CASE WHEN age_s <= 21600 THEN 1e0 WHEN age_s <= 43200 THEN 9e-1 WHEN age_s <= 86400 THEN 75e-2
   WHEN age_s <= 172800 THEN 5e-1 ELSE 25e-2 END AS decay FROM art""")
def _(t):
    return t.art.select("article_id", scoring.time_decay("published_at", as_of()).alias("decay"))


@query("effective_score", uses="art pub", sql="""
SELECT article_id, round(CASE WHEN headline_score > 0 THEN headline_score
   ELSE greatest(0e0, least(coalesce(authority, 1e0), 1e1))/1e1*7e-1 END, 6) AS score
FROM art LEFT JOIN pub USING (publication_id)""")
def _(t):
    return t.art.join(t.pub, "publication_id", "left").select(
        "article_id", F.round(scoring.effective_score("headline_score", "authority"), 6).alias("score"))


@query("label_bands", uses="art pub", sql="""
SELECT article_id, CASE WHEN coalesce(authority,0) >= 8 THEN 'major/authoritative' WHEN coalesce(authority,0) >= 6 THEN 'established'
    WHEN coalesce(authority,0) >= 4 THEN 'mid-tier' ELSE 'minor/unknown' END AS authority_label,
  CASE WHEN age_s < 3600 THEN concat(age_s//60, ' minutes ago') WHEN age_s < 86400 THEN concat(age_s//3600, ' hours ago')
    ELSE concat(age_s//86400, ' days ago') END AS time_ago
FROM art LEFT JOIN pub USING (publication_id)""")
def _(t):
    return t.art.join(t.pub, "publication_id", "left").select(
        "article_id", scoring.authority_label("authority").alias("authority_label"), scoring.time_ago("age_s").alias("time_ago"))


@query("parse_dates", uses="art", sql="""
WITH raw AS (SELECT article_id, CASE WHEN article_id%4 = 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ')
    WHEN article_id%4 = 1 THEN strftime(published_at, '%Y-%m-%d') WHEN article_id%4 = 2 THEN 'yesterday' END AS s FROM art)
SELECT article_id, epoch(coalesce(try_strptime(s, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(s, '%Y-%m-%d'),
    TIMESTAMP '2024-01-31 00:00:00'))::BIGINT AS published_s FROM raw""")
def _(t):
    m = F.col("article_id") % 4
    raw = (F.when(m == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(m == 1, F.date_format("published_at", "yyyy-MM-dd")).when(m == 2, F.lit("yesterday")))
    return t.art.select("article_id", F.unix_seconds(F.coalesce(
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), as_of())).alias("published_s"))


@query("readability", sql=rf"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text,'{W}')) AS w, greatest(len(regexp_extract_all(text,'[.!?]+')),1) AS s,
   len(regexp_extract_all(lower(text),'[aeiouyáàâãäåéèêëíìîïóòôõöúùûü]+')) AS y FROM documents)
SELECT doc_id, w AS words, round(206.835e0 - 1.015e0*(w/s) - 84.6e0*(y/w), 4) AS flesch, round(w/225e0, 6) AS read_minutes FROM c WHERE w > 0""")
def _(t):
    words = text.word_count("text")
    return t.documents.select("doc_id", words.alias("words"), F.round(text.flesch("text"), 4).alias("flesch"),
                              F.round(words / F.lit(225.0), 6).alias("read_minutes")).filter("words > 0")


@query("lang_assign", uses="art pub_lang", sql="""
WITH d AS (SELECT article_id, language AS detected, ((article_id*37)%100)/1e2 AS confidence,
   CASE WHEN article_id%3 = 0 THEN 'en' END AS current_language FROM art),
known AS (SELECT DISTINCT language FROM pub_lang)
SELECT article_id, CASE WHEN current_language IS NOT NULL THEN current_language
    WHEN confidence > 8e-1 AND known.language IS NOT NULL THEN detected ELSE '' END AS language
FROM d LEFT JOIN known ON known.language = d.detected""")
def _(t):
    d = t.art.select("article_id", F.col("language").alias("detected"), (((F.col("article_id") * 37) % 100) / 100.0).alias("confidence"),
                     F.when(F.col("article_id") % 3 == 0, F.lit("en")).alias("current"))
    known = t.pub_lang.select(F.col("language").alias("detected")).distinct().withColumn("known", F.lit(True))
    return d.join(known, "detected", "left").select(
        "article_id", F.coalesce("current", F.when((F.col("confidence") > 0.8) & F.col("known"), F.col("detected")), F.lit("")).alias("language"))


# Recogniser label to entity type.
LABELS = {
    "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "FACILITY", "EVENT": "EVENT",
    "WORK_OF_ART": "WORK", "PRODUCT": "PRODUCT", "LAW": "LAW", "MONEY": "FINANCIAL_ASSET", "DATE": "OTHER", "TIME": "OTHER",
    "PERCENT": "OTHER", "QUANTITY": "OTHER", "ORDINAL": "OTHER", "CARDINAL": "OTHER",
}
_RAW_LABEL = "CASE WHEN event_id%5 = 0 THEN 'GPE' WHEN event_id%5 = 1 THEN 'ORG' WHEN event_id%5 = 2 THEN 'MONEY' WHEN event_id%5 = 3 THEN 'NORP' ELSE 'WORK_OF_ART' END"


@query("entity_label_map", sql=f"""
SELECT entity_type, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN l = '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE 'OTHER' END AS entity_type
  FROM (SELECT {_RAW_LABEL} AS l FROM events)) GROUP BY entity_type""")
def _(t):
    m = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return (t.events.select(F.coalesce(F.try_element_at(m, F.expr(_RAW_LABEL)), F.lit("OTHER")).alias("entity_type"))
            .groupBy("entity_type").agg(F.count("*").alias("n")))


@query("cjk_ratio", sql="""
WITH c AS (SELECT conv_id, turn, length(s) AS n, len(list_filter(list_transform(string_split(s, ''), lambda x: unicode(x)), lambda u: u BETWEEN 11904 AND 12031 OR u BETWEEN 12352 AND 12591
   OR u BETWEEN 12800 AND 13055 OR u BETWEEN 13312 AND 19903 OR u BETWEEN 19968 AND 40959 OR u BETWEEN 44032 AND 55215 OR u BETWEEN 63744 AND 64255 OR u BETWEEN 131072 AND 173791 OR u BETWEEN 194560 AND 195103)) AS k
   FROM (SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN concat(substr(text, 1, 12), repeat('新聞㐀', 20)) WHEN 1 THEN concat(substr(text, 1, 30), repeat('ㄅ㈠', 16)) WHEN 2 THEN concat(text, repeat('𠀀', 70)) ELSE text END AS s FROM conversations))
SELECT conv_id, turn, round(k/n, 6) AS ratio, CASE WHEN k/n >= 8e-1 THEN 36e-1 WHEN k/n >= 5e-1 THEN 3e0 WHEN k/n >= 2e-1 THEN 15e-1 ELSE 1e0 END AS multiplier FROM c WHERE n > 0""")
def _(t):
    four = F.col("turn") % 4
    s = (F.when(four == 0, F.concat(F.substring("text", 1, 12), F.repeat(F.lit("新聞㐀"), F.lit(20))))
         .when(four == 1, F.concat(F.substring("text", 1, 30), F.repeat(F.lit("ㄅ㈠"), F.lit(16))))
         .when(four == 2, F.concat("text", F.repeat(F.lit("\U00020000"), F.lit(70)))).otherwise(F.col("text")))
    rows = t.conversations.filter(F.length(s) > 0).select("conv_id", "turn", text.cjk_ratio(s).alias("ratio"))
    return rows.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), text.cjk_multiplier(F.col("ratio")).alias("multiplier"))


@query("text_agreement", uses="art", sql=f"""
WITH k AS (SELECT article_id, length(description) AS la, length(content) AS lb,
   list_distinct(regexp_extract_all(lower(description),'{W}')) AS a, list_distinct(regexp_extract_all(lower(content),'{W}')) AS b FROM art),
c AS (SELECT *, len(list_intersect(a,b)) AS i FROM k)
SELECT article_id, round(CASE WHEN greatest(la,lb) = 0 THEN 0e0 ELSE least(la,lb)/greatest(la,lb)::DOUBLE END,6) AS char_ratio,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE i/(len(a)+len(b)-i)::DOUBLE END,6) AS token_jaccard FROM c""")
def _(t):
    la, lb = F.length("description"), F.length("content")
    sets = t.art.select("article_id", "description", "content", text.token_set("description").alias("a"), text.token_set("content").alias("b"))
    return sets.select(
        "article_id",
        F.round(F.when(F.greatest(la, lb) == 0, 0.0).otherwise(F.least(la, lb) / F.greatest(la, lb)), 6).alias("char_ratio"),
        F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("token_jaccard"))


# Lines that belong to the page frame, not to the article.
CHROME_LINES = ["advertisement", "share", "share this article", "sign up", "subscribe", "related articles", "read more", "cookie policy"]


@query("strip_chrome", sql=f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))),
   lambda x: x <> '' AND NOT list_contains([{', '.join(repr(c) for c in CHROME_LINES)}], lower(x)) AND NOT starts_with(lower(x), 'released under')), chr(10)) AS body
FROM documents""")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    keep = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin(CHROME_LINES) & ~F.startswith(F.lower(x), F.lit("released under")))
    return t.documents.select("doc_id", F.array_join(keep, "\n").alias("body"))


@query("error_class", uses="art", sql="""
SELECT article_id, regexp_matches(lower(coalesce(error_message,'')), 'rate.?limit|429|too many requests') AS rate_limited,
  (regexp_matches(lower(coalesce(error_message,'')), 'rate.?limit|429|too many requests') AND analyzer_attempts < 3) AS requeue FROM art""")
def _(t):
    limited = F.lower(text.nz("error_message")).rlike("rate.?limit|429|too many requests")
    return t.art.select("article_id", limited.alias("rate_limited"), (limited & (F.col("analyzer_attempts") < 3)).alias("requeue"))


@query("body_usable", sql=rf"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id%5 = 0 THEN concat(body, ' Read more') ELSE body END AS body
   FROM (SELECT doc_id, concat('<p>', replace(text, chr(10), '</p><p>'), '</p>') AS body FROM documents)),
c AS (SELECT doc_id, body, regexp_replace(body,'<[^>]+>','','g') AS bare FROM b),
d AS (SELECT doc_id, len(regexp_extract_all(bare,'{W}')) AS words, regexp_replace(lower(right(bare,120)),'^\s+|\s+$','','g') AS tail,
   len(regexp_extract_all(body,'(?i)<p[\s>]')) AS ps, len(regexp_extract_all(body,'\n\n')) AS nn,
   length(regexp_replace(bare,'^\s+|\s+$','','g'))/length(body)::DOUBLE AS ratio FROM c)
SELECT doc_id, words, (words >= 500 AND NOT ({' OR '.join(f"ends_with(tail, '{m}')" for m in text.TRUNCATION_MARKERS)})
   AND (ps >= 2 OR nn >= 2) AND ratio >= 3e-1) AS usable FROM d""")
def _(t):
    body = F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    src = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.lit(" Read more"))).otherwise(body).alias("body"))
    words = text.word_count(text.strip_tags("body", ""))
    return src.select("doc_id", words.alias("words"), text.body_usable("body", words).alias("usable"))


@query("html_term_counts", sql="""
SELECT page_id, len(regexp_extract_all(html,'(?i)<p[\\s>]')) AS paragraphs, len(regexp_extract_all(html,'(?i)<a[\\s>]')) AS links,
  len(regexp_extract_all(lower(html),'track')) AS track_terms, length(html) AS chars FROM pages""")
def _(t):
    def n(c, pat):
        return F.regexp_count(c, F.lit(pat)).cast("bigint")

    return t.pages.select("page_id", n("html", r"(?i)<p[\s>]").alias("paragraphs"), n("html", r"(?i)<a[\s>]").alias("links"),
                          n(F.lower("html"), "track").alias("track_terms"), F.length("html").cast("bigint").alias("chars"))


@query("region_by_name", uses="pub", sql="""
SELECT publication_id, CASE WHEN contains(lower(name),'#000000001') THEN 'us' WHEN contains(lower(name),'#00000000') THEN 'br'
   ELSE region_code END AS region_code FROM pub""")
def _(t):
    out = F.col("region_code")
    for pattern, region in reversed([("#000000001", "us"), ("#00000000", "br")]):
        out = F.when(F.contains(F.lower("name"), F.lit(pattern)), F.lit(region)).otherwise(out)
    return t.pub.select("publication_id", out.alias("region_code"))


@query("smart_truncate", sql=r"""
WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text,'([.!?])\s+','\1'||chr(1),'g'), chr(1)) AS parts FROM documents),
x AS (SELECT doc_id, generate_subscripts(parts,1) AS i, unnest(parts) AS p FROM s),
r AS (SELECT doc_id, i, p, sum(length(p)+1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS run FROM x)
SELECT doc_id, count(*) FILTER (run <= 1000) AS sentences, coalesce(max(run) FILTER (run <= 1000), 0)::BIGINT AS chars, coalesce(string_agg(p, ' ' ORDER BY i) FILTER (run <= 1000), '') AS cut FROM r GROUP BY doc_id""")
def _(t):
    cut = t.documents.select("doc_id", text.whole_sentences("text", 1000).alias("kept"))
    return cut.select("doc_id", F.size("kept").cast("long").alias("sentences"), F.length(F.array_join("kept", " ")).cast("long").alias("chars"), F.array_join("kept", " ").alias("cut"))
