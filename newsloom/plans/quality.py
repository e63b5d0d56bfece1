"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import quality
from newsloom.operators.ranking import medians
from newsloom.plans.registry import query

W = r"[\p{L}\p{N}_]+"
TOK = f"list_filter(regexp_extract_all(lower(X), '{W}'), lambda w: length(w) > 1)"

# what each of three routes "extracted" from an article
EXTRACT = """CASE WHEN article_id%3 = 0 THEN description WHEN article_id%3 = 1 THEN content ELSE substring(content, length(description)+2, 100000000) END"""
F1 = f"""ex AS (SELECT article_id, {EXTRACT} AS x, content FROM art),
xa AS (SELECT article_id, unnest({TOK.replace('X', 'x')}) AS w, 1 AS a, 0 AS b FROM ex UNION ALL SELECT article_id, unnest({TOK.replace('X', 'content')}), 0, 1 FROM ex),
xw AS (SELECT article_id, w, sum(a) AS a, sum(b) AS b FROM xa GROUP BY ALL), xs AS (SELECT article_id, sum(least(a,b))::DOUBLE AS i, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM xw GROUP BY article_id),
f1 AS (SELECT article_id, CASE WHEN i > 0 THEN i/na ELSE 0e0 END AS p, CASE WHEN i > 0 THEN i/nb ELSE 0e0 END AS r, CASE WHEN i > 0 THEN (i/na)*(i/nb)*2e0/(i/na+i/nb) ELSE 0e0 END AS f FROM ex LEFT JOIN xs USING (article_id))"""


def _pairs(t):
    return t.art.select("article_id", "content", "process_cost", F.expr(EXTRACT).alias("extracted"))


@query("token_f1", uses="art", sql=f"WITH {F1} SELECT article_id, round(p,6) AS precision, round(r,6) AS recall, round(f,6) AS f1 FROM f1")
def _(t):
    out = quality.token_f1(_pairs(t), "article_id", "extracted", "content")
    return out.select("article_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("token_jaccard", uses="art", sql=f"""
SELECT article_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b)))::DOUBLE END, 6) AS jaccard
FROM (SELECT article_id, list_distinct({TOK.replace('X', EXTRACT)}) AS a, list_distinct({TOK.replace('X', 'content')}) AS b FROM art)""")
def _(t):
    # token lists are materialised before the set operations so that they are computed once
    p = _pairs(t).select("article_id", F.array_distinct(quality.long_tokens("extracted")).alias("a"), F.array_distinct(quality.long_tokens("content")).alias("b"))
    return p.select("article_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_PARTS = f"""list_transform(list_filter(CASE WHEN len(list_filter(string_split(X, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) > 1 THEN list_filter(string_split(X, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))
  ELSE list_filter(regexp_split_to_array(X, '\\r\\n|\\r|\\n'), lambda p: regexp_matches(p, '\\S')) END, lambda p: len(regexp_extract_all(p, '\\S+')) >= 10), lambda p: list_distinct({TOK.replace("X", "p").replace("lambda w:", "lambda v:").replace("length(w)", "length(v)")}))"""
_SHARE = "CASE WHEN len(h) = 0 OR len(w) = 0 THEN 0e0 ELSE len(list_intersect(h, w))/(len(h) + len(w) - len(list_intersect(h, w)))::DOUBLE END"


@query("paragraph_diff", uses="art", sql=f"""
WITH RECURSIVE px AS (SELECT article_id, {_PARTS.replace("X", "x")} AS xs, {_PARTS.replace("X", "content")} AS ys FROM (SELECT article_id, content, {EXTRACT} AS x FROM art)),
e AS (SELECT article_id, k, j, {_SHARE} AS share FROM (SELECT article_id, k, w, unnest(xs) AS h, generate_subscripts(xs, 1) AS j FROM (SELECT article_id, xs, unnest(ys) AS w, generate_subscripts(ys, 1) AS k FROM px))),
o AS (SELECT article_id, k, list(j ORDER BY share DESC, j) AS js FROM e WHERE share >= 55e-2 GROUP BY article_id, k),
walk AS (SELECT article_id, 0::BIGINT AS k, []::BIGINT[] AS used, len(ys) AS n FROM px
 UNION ALL SELECT w.article_id, w.k + 1, CASE WHEN len(list_filter(coalesce(o.js, []), lambda j: NOT list_contains(w.used, j))) > 0 THEN list_append(w.used, list_filter(o.js, lambda j: NOT list_contains(w.used, j))[1]) ELSE w.used END, n
 FROM walk w LEFT JOIN o ON o.article_id = w.article_id AND o.k = w.k + 1 WHERE w.k < n)
SELECT article_id, len(ys) - len(used) AS missing, len(xs) - len(used) AS noise, len(used) AS matched FROM px JOIN walk USING (article_id) WHERE k = n""")
def _(t):
    return quality.paragraph_diff(_pairs(t), "article_id", "extracted", "content").select(
        "article_id", F.col("missing").cast("long").alias("missing"), F.col("noise").cast("long").alias("noise"), "matched")


@query("extraction_report", uses="art", sql=f"""
WITH {F1}, s AS (SELECT CASE WHEN article_id%3 = 0 THEN 'algo' WHEN article_id%3 = 1 THEN 'ai' ELSE 'hybrid' END AS route, length(x) > 40 AS success, f, article_id%4 AS missing, length(regexp_replace(body,'[^#*$%&|<>!]','','g'))/greatest(length(body),1)::DOUBLE AS noise, process_cost AS cost
   FROM f1 JOIN ex USING (article_id) JOIN (SELECT article_id, process_cost, content AS body FROM art) USING (article_id)),
v AS (SELECT *, CASE WHEN NOT success THEN 'failed' WHEN f >= 8e-1 AND missing <= 1 THEN 'good' WHEN f >= 55e-2 THEN 'partial' ELSE 'bad' END AS verdict FROM s)
SELECT route, count(*) AS n, count(*) FILTER (success) AS n_success, round(coalesce(median(round(f,6)) FILTER (success),0e0),6) AS median_f1, round(coalesce(avg(f) FILTER (success),0e0),6) AS mean_f1,
  round(coalesce(min(f) FILTER (success),0e0),6) AS min_f1, round(1e2*count(*) FILTER (verdict = 'good')/count(*),4) AS pct_good, round(1e2*count(*) FILTER (verdict = 'partial')/count(*),4) AS pct_partial,
  round(1e2*count(*) FILTER (verdict IN ('bad','failed'))/count(*),4) AS pct_bad, round(sum(cost),6) AS total_cost, median(missing)::DOUBLE AS median_missing, round(median(round(noise,6)),6) AS median_noise FROM v GROUP BY route""")
def _(t):
    p = _pairs(t)
    f1 = quality.token_f1(p, "article_id", "extracted", "content").select("article_id", "f1")
    i = F.col("article_id")
    s = p.select("article_id", F.when(i % 3 == 0, "algo").when(i % 3 == 1, "ai").otherwise("hybrid").alias("route"),
                 (F.length("extracted") > 40).alias("success"), (i % 4).alias("missing"), (F.length(F.regexp_replace("content", "[^#*$%&|<>!]", "")) / F.greatest(F.length("content"), F.lit(1))).alias("noise"), F.col("process_cost").alias("cost")).join(f1, "article_id")
    return quality.extraction_report(s.withColumn("verdict", quality.verdict(F.col("f1"), F.col("missing"), F.col("success"))))


PRE = f"""pre AS (SELECT doc_id, CASE WHEN n < 100 THEN -8e-1 WHEN ratio > 100 THEN -5e-1 WHEN tl < 5 THEN -3e-1 WHEN doc_id%7 = 0 AND n < 500 THEN -4e-1
    WHEN n > 3000 AND tl > 10 AND ratio < 5 AND words > 300 THEN 85e-2 WHEN n > 1500 AND tl > 10 AND ratio < 10 AND blocks > 3 THEN 75e-2 END AS score,
  CASE WHEN n < 100 THEN 'empty_or_minimal_content' WHEN ratio > 100 THEN 'extraction_failed_html_ratio_high' WHEN tl < 5 THEN 'missing_or_invalid_title' WHEN doc_id%7 = 0 AND n < 500 THEN 'paywall_detected_minimal_content'
    WHEN n > 3000 AND tl > 10 AND ratio < 5 AND words > 300 THEN 'excellent_indicators_long_clean_content' WHEN n > 1500 AND tl > 10 AND ratio < 10 AND blocks > 3 THEN 'good_indicators_structured_content'
    ELSE 'uncertain_quality_needs_llm' END AS reason
 FROM (SELECT doc_id, length(text) AS n, length(html)/greatest(length(text),1)::DOUBLE AS ratio, length(trim(split_part(text,'.',1))) AS tl, len(regexp_extract_all(text,'{W}')) AS words,
   len(string_split(text, chr(10))) AS blocks FROM documents JOIN pages ON page_id = doc_id%(SELECT count(*) FROM pages)))"""


def _prefiltered(t):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % t.pages.agg(F.count("*")).scalar()).alias("page_id")).join(t.pages.select("page_id", F.length("html").alias("hn")), "page_id")
    p = quality.prefilter(F.length("text"), F.col("hn"), F.split_part("text", F.lit("."), F.lit(1)), F.col("doc_id") % 7 == 0,
                          text.word_count("text"), F.size(F.split("text", "\n")))
    return d.select("doc_id", p.alias("p")).select("doc_id", "p.*")


@query("quality_prefilter", sql=f"WITH {PRE} SELECT doc_id, coalesce(score, 0e0) AS score, score IS NULL AS needs_model, reason FROM pre")
def _(t):
    return _prefiltered(t).select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNull().alias("needs_model"), "reason")


@query("prefilter_agreement", sql=f"""
WITH {PRE}, j AS (SELECT score, CASE WHEN quality = 1 THEN 8e-1 ELSE -4e-1 END AS model FROM pre JOIN labels USING (doc_id))
SELECT count(*) AS total, count(score) AS confident, round(count(score)/count(*), 6) AS prefilter_rate, round(coalesce(count(*) FILTER (abs(score-model) < 3e-1)/nullif(count(score),0), 0e0), 6) AS agreement_rate,
  count(*) FILTER (abs(score-model) >= 3e-1) AS disagreements FROM j""")
def _(t):
    j = _prefiltered(t).join(t.labels, "doc_id").withColumn("model", F.when(F.col("quality") == 1, 0.8).otherwise(-0.4))
    near = F.abs(F.col("score") - F.col("model")) < 0.3
    return j.agg(F.count("*").alias("total"), F.count("score").alias("confident"), F.round(F.count("score") / F.count("*"), 6).alias("prefilter_rate"),
                 F.round(F.coalesce(F.count_if(near) / F.nullif(F.count("score"), F.lit(0)), F.lit(0.0)), 6).alias("agreement_rate"), F.count_if(~near).alias("disagreements"))


@query("prefilter_savings", sql="""
SELECT count(*) AS total, round(count(*)*3e-1, 6) AS prefiltered, round(count(*)*5e-4, 6) AS cost_without, round((count(*) - count(*)*3e-1)*5e-4, 6) AS cost_with FROM documents""")
def _(t):
    n = F.count("*")
    return t.documents.agg(n.alias("total"), F.round(n * 0.30, 6).alias("prefiltered"), F.round(n * 0.0005, 6).alias("cost_without"),
                           F.round((n - n * 0.30) * 0.0005, 6).alias("cost_with"))


DIMS = "(doc_id%101)/1e2 AS c, ((doc_id*3)%101)/1e2 AS p, ((doc_id*7)%101)/1e2 AS s, ((doc_id*11)%101)/1e2 AS r"
OVERALL = "greatest(-1e0, least(1e0, c - (1e0-p) + (s-5e-1)*3e-1 + (r-5e-1)*2e-1))"


@query("quality_score", sql=f"""
SELECT doc_id, round(o,6) AS score, CASE WHEN round(o,6) >= 8e-1 THEN 'EXCELLENT' WHEN round(o,6) >= 5e-1 THEN 'GOOD' WHEN round(o,6) >= 2e-1 THEN 'FAIR' WHEN round(o,6) >= -2e-1 THEN 'POOR' ELSE 'FAILED' END AS grade
FROM (SELECT doc_id, {OVERALL} AS o FROM (SELECT doc_id, {DIMS} FROM documents))""")
def _(t):
    d = t.documents.selectExpr("doc_id", *DIMS.split(", "))
    o = F.round(quality.overall_score(F.col("c"), F.col("p"), F.col("s"), F.col("r")), 6)
    return d.select("doc_id", o.alias("score"), quality.grade(o).alias("grade"))


@query("quality_parse", sql=f"""
SELECT doc_id, round(CASE WHEN doc_id%3 = 0 AND doc_id%2 = 0 THEN 33e-2 WHEN doc_id%3 = 1 AND doc_id%2 = 0 THEN 44e-2 ELSE {OVERALL} END, 6) AS overall FROM (SELECT doc_id, {DIMS} FROM documents)""")
def _(t):
    d = t.documents.selectExpr("doc_id", *DIMS.split(", "))
    i = F.col("doc_id")
    dims = [F.col(k).alias(n) for k, n in zip("cpsr", ("completeness", "purity", "structure", "readability"))]
    nested = F.to_json(F.struct(F.struct(*dims, F.when(i % 2 == 0, 0.33).alias("overall")).alias("scores"), F.struct(F.lit("x").alias("explanation")).alias("assessment")))
    legacy = F.to_json(F.struct(F.struct(*dims, F.when(i % 2 == 0, 0.44).alias("final")).alias("scores")))
    flat = F.concat(F.lit("```json\n"), F.to_json(F.struct(*dims)), F.lit("\n```"))
    return d.select("doc_id", F.round(quality.parse_evaluation(F.when(i % 3 == 0, nested).when(i % 3 == 1, legacy).otherwise(flat)), 6).alias("overall"))


@query("quality_bands", uses="art", sql="""
SELECT route, CASE WHEN quality_score >= 8e-1 THEN 'excellent' WHEN quality_score >= 5e-1 THEN 'good' WHEN quality_score >= 2e-1 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n,
  round(avg(quality_score), 6) AS avg_score FROM art GROUP BY 1, 2""")
def _(t):
    q = F.col("quality_score")
    band = F.when(q >= 0.8, "excellent").when(q >= 0.5, "good").when(q >= 0.2, "fair").otherwise("poor")
    return t.art.groupBy("route", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("avg_score"))


TEMPLATES = "(SELECT doc_id, quality AS class, k AS template, abs(((doc_id*29)%101)/1e2 - ((doc_id*(29+k))%101)/1e2) AS err FROM labels CROSS JOIN (SELECT unnest([1,2,3]) AS k))"


@query("template_mae", sql=f"""
WITH m AS (SELECT class, template, avg(err) AS mae FROM {TEMPLATES} GROUP BY ALL)
SELECT class, template, round(mae,6) AS mae, template = first_value(template) OVER (PARTITION BY class ORDER BY round(mae,6), template) AS winner FROM m""")
def _(t):
    e = t.labels.select("doc_id", F.col("quality").alias("class"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("template")).withColumn(
        "err", F.expr("abs(((doc_id*29)%101)/1e2 - ((doc_id*(29+template))%101)/1e2)"))
    m = e.groupBy("class", "template").agg(F.round(F.avg("err"), 6).alias("mae"))
    best = m.groupBy("class").agg(F.min_by("template", F.struct("mae", "template")).alias("best"))
    return m.join(best, "class").select("class", "template", "mae", (F.col("template") == F.col("best")).alias("winner"))


@query("calibration", sql="""
WITH d AS (SELECT quality AS class, ((doc_id*29)%101)/1e2 - ((doc_id*31)%101)/1e2 AS diff FROM labels)
SELECT class, count(*) AS n, round(avg(diff),6) AS mean_diff, round(avg(abs(diff)),6) AS mae, round(median(round(diff,6)),6) AS median_diff, round(max(abs(diff)),6) AS max_abs,
  count(*) FILTER (round(abs(diff),6) <= 1e-1) AS within_1, count(*) FILTER (round(abs(diff),6) <= 2e-1) AS within_2, count(*) FILTER (round(abs(diff),6) <= 3e-1) AS within_3 FROM d GROUP BY class""")
def _(t):
    d = t.labels.select(F.col("quality").alias("class"), F.expr("((doc_id*29)%101)/1e2 - ((doc_id*31)%101)/1e2").alias("diff"))
    a = F.abs("diff")
    return d.groupBy("class").agg(
        F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff"), F.round(F.avg(a), 6).alias("mae"), 
        F.round(F.max(a), 6).alias("max_abs"), *[F.count_if(F.round(a, 6) <= k / 10.0).alias(f"within_{k}") for k in (1, 2, 3)]).join(
        medians(d, ["class"], {"median_diff": F.round("diff", 6)}), "class").withColumn("median_diff", F.round("median_diff", 6))


@query("agreement_confidence", uses="art", sql=r"""
WITH x AS (SELECT article_id, CASE WHEN article_id%4 = 0 THEN '' ELSE description END AS a, content AS b, CASE WHEN article_id%5 = 0 THEN '' ELSE concat(title, ' ', description) END AS c,
   CASE WHEN article_id%9 = 0 THEN 'PAYWALL_OR_BLOCK_PAGE' WHEN article_id%2 = 0 THEN 'ARTICLE_PAGE' ELSE 'UNCLEAR' END AS k FROM art),
s AS (SELECT *, list_distinct(regexp_extract_all(lower(a),'\S+')) AS sa, list_distinct(regexp_extract_all(lower(b),'\S+')) AS sb, list_distinct(regexp_extract_all(lower(c),'\S+')) AS sc,
   len(regexp_extract_all(a,'\S+')) AS n FROM x),
p AS (SELECT article_id, 0 AS o, len(list_intersect(sa,sb))/(len(sa)+len(sb)-len(list_intersect(sa,sb)))::DOUBLE AS j, least(length(a),length(b))/greatest(length(a),length(b))::DOUBLE AS r FROM s WHERE a <> '' AND b <> ''
  UNION ALL SELECT article_id, 1, len(list_intersect(sa,sc))/(len(sa)+len(sc)-len(list_intersect(sa,sc)))::DOUBLE, least(length(a),length(c))/greatest(length(a),length(c))::DOUBLE FROM s WHERE a <> '' AND c <> ''
  UNION ALL SELECT article_id, 2, len(list_intersect(sb,sc))/(len(sb)+len(sc)-len(list_intersect(sb,sc)))::DOUBLE, least(length(b),length(c))/greatest(length(b),length(c))::DOUBLE FROM s WHERE b <> '' AND c <> ''),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY j DESC, o) = 1)
SELECT article_id, round(coalesce(j,0e0),6) AS jaccard, CASE WHEN k = 'PAYWALL_OR_BLOCK_PAGE' THEN 'failed' WHEN k = 'ARTICLE_PAGE' AND n >= 200 THEN 'high' WHEN k = 'ARTICLE_PAGE' AND n >= 80 THEN 'medium' WHEN j IS NULL THEN 'failed'
   WHEN j >= 7e-1 AND r >= 65e-2 THEN 'high' WHEN j >= 45e-2 AND r >= 45e-2 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN k = 'PAYWALL_OR_BLOCK_PAGE' THEN 'none' WHEN n >= 80 THEN 'selector' WHEN len(regexp_extract_all(b,'\S+')) >= len(regexp_extract_all(c,'\S+')) AND b <> '' THEN 'readability' WHEN c <> '' THEN 'newspaper' ELSE 'none' END AS primary_source
FROM s LEFT JOIN q USING (article_id)""")
def _(t):
    i = F.col("article_id")
    x = t.art.select("article_id", F.when(i % 4 == 0, "").otherwise(F.col("description")).alias("a"), F.col("content").alias("b"),
                     F.when(i % 5 == 0, "").otherwise(F.concat("title", F.lit(" "), "description")).alias("c"),
                     F.when(i % 9 == 0, "PAYWALL_OR_BLOCK_PAGE").when(i % 2 == 0, "ARTICLE_PAGE").otherwise("UNCLEAR").alias("k"))
    return quality.agreement(x, "a", "b", "c", "k").select(
        "article_id", F.round("jaccard", 6).alias("jaccard"), "confidence", quality.primary_text("a", "b", "c", "k").alias("primary_source"))


STRATUM = "CASE WHEN lang = 'es' THEN 'br' WHEN n_chars > 6000 THEN 'long' WHEN doc_id%7 = 0 THEN 'paywalled' WHEN n_chars < 1600 THEN 'short' ELSE 'us' END"


@query("stratified_sample", sql=f"""
SELECT stratum, doc_id FROM (SELECT doc_id, {STRATUM} AS stratum FROM documents) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('golden:', doc_id)), doc_id) <= 10""")
def _(t):
    d = t.documents.select("doc_id", F.expr(STRATUM).alias("stratum"))
    return quality.stratified_sample(d, "stratum", "doc_id", 10, "golden").select("stratum", "doc_id")


@query("confidence_select", sql="""
SELECT doc_id, c AS confidence FROM (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'failed' END AS c FROM labels) WHERE c IN ('high','medium')""")
def _(t):
    order = F.create_map(*[F.lit(x) for kv in {"high": 0, "medium": 1, "low": 2, "failed": 3}.items() for x in kv])
    c = F.get(F.array(*[F.lit(x) for x in ("high", "medium", "low", "failed")]), (F.col("doc_id") % 4).cast("int"))
    return t.labels.select("doc_id", c.alias("confidence")).filter(order[F.col("confidence")] <= order[F.lit("medium")])


# dimensions of a page from its text, judged by three templates that look at parts of it
_DIM_SQL = "VALUES ('symbols', '[#*$%&|<>!]'), ('capitals', '[A-Z]'), ('digits', '[0-9]')"
DIMENSIONS = {"symbols": "[#*$%&|<>!]", "capitals": "[A-Z]", "digits": "[0-9]"}
_MAE = f"""d AS (SELECT doc_id, quality AS class, text, dim, pat FROM documents JOIN labels USING (doc_id), ({_DIM_SQL}) v(dim, pat)),
e AS (SELECT class, dim, k AS template, abs(len(regexp_extract_all(text, pat))/greatest(length(text),1)::DOUBLE - len(regexp_extract_all(part, pat))/greatest(length(part),1)::DOUBLE) AS err
  FROM (SELECT *, substr(text, 1 + (k-1)*length(text)//3, length(text)//3) AS part FROM d, (SELECT unnest([1,2,3]) AS k)))"""


@query("template_dimension_mae", sql=f"""
WITH {_MAE}, m AS (SELECT class, dim, template, round(avg(err),6) AS mae FROM e GROUP BY ALL)
SELECT class, dim, template, mae, template = first_value(template) OVER (PARTITION BY class, dim ORDER BY mae, template) AS winner FROM m""")
def _(t):
    return quality.template_errors(_template_rows(t), ["class", "dim"])


@query("template_class_wins", sql=f"""
WITH {_MAE}, m AS (SELECT class, template, round(avg(err),6) AS mae FROM e GROUP BY ALL),
w AS (SELECT class, template = first_value(template) OVER (PARTITION BY class ORDER BY mae, template) AS winner, template FROM m)
SELECT template, count(*) FILTER (winner) AS wins FROM w GROUP BY template""")
def _(t):
    return quality.template_errors(_template_rows(t), ["class"]).groupBy("template").agg(F.count_if("winner").alias("wins"))


def _template_rows(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("quality").alias("class"), "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("template"))
    third = F.floor(F.length("text") / 3)
    start = F.floor((F.col("template") - 1) * F.length("text") / 3) + 1
    d = d.withColumn("part", F.substring("text", start.cast("int"), third.cast("int")))

    def share(c: str, pattern: str):
        return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))

    errors = F.array(*[F.struct(F.lit(k).alias("dim"), F.abs(share("text", p) - share("part", p)).alias("err")) for k, p in DIMENSIONS.items()])
    return d.select("class", "template", F.explode(errors).alias("x")).select("class", "template", "x.*")
