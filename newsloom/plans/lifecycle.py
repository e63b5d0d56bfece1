"""State table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text, url
from newsloom.operators import lifecycle
from newsloom.operators.ranking import first_rows, top_k
from newsloom.plans.registry import query
from newsloom.sources.tables import as_of

ORDER = "headline_score DESC, published_at DESC, article_id"
STATE = ["article_id", "publication_id", "headline_score", "published_at", "triage_status", "last_attempt_at", "error_message", "content",
         *[f"{s}_{x}" for s in lifecycle.STAGES for x in ("status", "attempts")]]


def day_start():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


ELIGIBLE = """el AS (SELECT * FROM art WHERE triage_status IN ('accepted','promoted') AND published_at >= TIMESTAMP '2024-01-28 00:00:00'
   AND publication_id IN (SELECT publication_id FROM pub_region WHERE region_code IN ('us','br')))"""
BUDGET = f"""{ELIGIBLE}, used AS (SELECT count(*) AS n FROM el WHERE process_status IN ('completed','processing','failed') AND last_attempt_at >= TIMESTAMP '2024-01-30 00:00:00'),
running AS (SELECT * FROM el WHERE greatest(fetch_attempts, process_attempts, summary_attempts, analyzer_attempts) > 0),
fresh AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place FROM el WHERE greatest(fetch_attempts, process_attempts, summary_attempts, analyzer_attempts) = 0
   AND fetch_status = 'pending' AND process_status = 'pending' AND summary_status = 'pending' AND analyzer_status = 'pending'),
sel AS (SELECT article_id, 'in_flight' AS entry FROM running UNION ALL SELECT article_id, 'new' FROM fresh, used WHERE place <= greatest(0, 110 - n))"""


def _selected(t):
    slim = [c for c in STATE if c != "content"]
    rows = lifecycle.eligible(t.art.select(*slim, F.length("content").alias("chars")), t.pub_region, ["us", "br"], as_of())
    return lifecycle.budgeted(rows, day_start(), 110)


@query("stage_readiness", uses="art", sql="""
SELECT article_id, fetch_status = 'pending' AND fetch_attempts < 3 AS needs_fetch,
  fetch_status = 'completed' AND length(content) > 100 AND process_status = 'pending' AND process_attempts < 3 AS needs_processing,
  (length(content) > 200 OR length(description) > 200) AND summary_status = 'pending' AND summary_attempts < 3 AS needs_summary,
  triage_status IN ('accepted','promoted') AND summary_status = 'completed' AND (length(content) > 100 OR length(description) > 100) AND analyzer_status = 'pending' AND analyzer_attempts < 3 AS needs_analysis FROM art""")
def _(t):
    cols = lifecycle.readiness("content", "description", "content")
    return t.art.select("article_id", *[c.alias(k) for k, c in cols.items()])


@query("best_content", uses="art", sql="""
SELECT article_id, CASE WHEN article_id%3 = 0 AND length(content) > 200 THEN 'full_cleaned_text' WHEN length(description) > 200 THEN 'incomplete_text' ELSE 'none' END AS summary_source,
  CASE WHEN article_id%3 = 0 AND length(content) > 100 THEN 'clean' WHEN length(description) > 100 THEN 'basic' WHEN length(title) > 50 THEN 'description' ELSE 'none' END AS analysis_source,
  CASE WHEN article_id%3 = 0 AND length(content) > 100 THEN length(content) WHEN length(description) > 100 THEN length(description) WHEN length(title) > 50 THEN length(title) ELSE 0 END AS analysis_chars FROM art""")
def _(t):
    a = t.art.select("article_id", F.when(F.col("article_id") % 3 == 0, F.col("content")).alias("clean"), F.col("description").alias("basic"), "title")
    s = lifecycle.best_content([("clean", 200, "full_cleaned_text"), ("basic", 200, "incomplete_text")])
    n = lifecycle.best_content([("clean", 100, "clean"), ("basic", 100, "basic"), ("title", 50, "description")])
    return a.select("article_id", F.coalesce(s["source"], F.lit("none")).alias("summary_source"), F.coalesce(n["source"], F.lit("none")).alias("analysis_source"),
                    F.coalesce(F.length(n["value"]), F.lit(0)).cast("long").alias("analysis_chars"))


@query("route_select", uses="art", sql="""
SELECT article_id, CASE WHEN article_id%2 = 0 AND is_top_headline THEN 'rss_model' WHEN article_id%2 = 0 THEN 'rss_direct'
  WHEN contains(publication_id,'src1') THEN 'llm_enhanced' WHEN contains(publication_id,'src2') OR contains(publication_id,'src7') THEN 'hybrid' ELSE 'llm_enhanced' END AS route FROM art""")
def _(t):
    hybrid = lifecycle.hybrid_route("publication_id", "publication_id", deny=["src1"], allow=["src2", "src7", "src12"], everywhere=False)
    from_feed = F.col("article_id") % 2 == 0
    return t.art.select("article_id", F.when(from_feed & F.col("is_top_headline"), "rss_model").when(from_feed, "rss_direct")
                        .when(hybrid, "hybrid").otherwise("llm_enhanced").alias("route"))


@query("budget_select", uses="art pub_region", sql=f"WITH {BUDGET} SELECT article_id, entry FROM sel")
def _(t):
    return _selected(t).select("article_id", "entry")


@query("stage_candidates", uses="art pub_region", sql=f"""
WITH {BUDGET}, r AS (SELECT el.* FROM el JOIN sel USING (article_id)),
f AS (SELECT article_id, 'fetch' AS stage FROM r WHERE fetch_status = 'pending' AND fetch_attempts < 3 ORDER BY {ORDER} LIMIT 15),
p AS (SELECT article_id, 'process' AS stage FROM r WHERE process_status = 'pending' AND process_attempts < 3 AND fetch_status = 'completed' AND length(content) >= 50 ORDER BY {ORDER} LIMIT 15),
s AS (SELECT article_id, 'summary' AS stage FROM r WHERE summary_status = 'pending' AND summary_attempts < 3 AND process_status = 'completed' AND length(content) >= 200 ORDER BY {ORDER} LIMIT 15),
a AS (SELECT article_id, 'analyzer' AS stage FROM r WHERE analyzer_status = 'pending' AND analyzer_attempts < 3 AND summary_status = 'completed' AND length(content) >= 200 ORDER BY {ORDER} LIMIT 15)
SELECT * FROM f UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT * FROM a""")
def _(t):
    return lifecycle.stage_candidates(_selected(t), "chars", 15)


@query("fail_exhausted", uses="art", sql="""
SELECT count(*) FILTER (fetch_status = 'pending' AND fetch_attempts >= 3) AS fetch_failures, count(*) FILTER (process_status = 'pending' AND process_attempts >= 3) AS process_failures,
  count(*) FILTER (summary_status = 'pending' AND summary_attempts >= 3) AS summary_failures, count(*) FILTER (analyzer_status = 'pending' AND analyzer_attempts >= 3) AS analyzer_failures FROM art""")
def _(t):
    before = t.art.select(*STATE)
    was = [F.col(f"{s}_status").alias(f"was_{s}") for s in lifecycle.STAGES]
    after = lifecycle.fail_exhausted(before.select("*", *was))
    return after.agg(*[F.count_if((F.col(f"was_{s}") == "pending") & (F.col(f"{s}_status") == "failed")).alias(f"{s}_failures") for s in lifecycle.STAGES])


@query("retry_select", uses="art", sql=f"""
SELECT article_id FROM art WHERE process_status = 'failed' AND process_attempts < 3 AND NOT coalesce(starts_with(error_message,'Skipped'), false) ORDER BY {ORDER} LIMIT 20""")
def _(t):
    return lifecycle.retry_candidates(t.art.select(*STATE), "process", 20).select("article_id")


@query("stuck_reset", uses="art", sql="""
SELECT article_id, stage FROM (
  SELECT article_id, last_attempt_at, 'fetch' AS stage, 2 AS h FROM art WHERE fetch_status = 'fetching' UNION ALL SELECT article_id, last_attempt_at, 'process', 4 FROM art WHERE process_status = 'processing'
  UNION ALL SELECT article_id, last_attempt_at, 'summary', 8 FROM art WHERE summary_status = 'processing' UNION ALL SELECT article_id, last_attempt_at, 'analyzer', 16 FROM art WHERE analyzer_status = 'processing')
WHERE last_attempt_at IS NULL OR epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_attempt_at) > h*3600""")
def _(t):
    return lifecycle.stuck(t.art.select(*STATE), as_of(), {"fetch": 2, "process": 4, "summary": 8, "analyzer": 16})


@query("retention", uses="art", sql="""
SELECT article_id, CASE WHEN fetch_status = 'pending' AND age > 36*3600 THEN 'unfetched' ELSE 'old' END AS reason FROM (SELECT *, age_s - 900 AS age FROM art)
WHERE age > 60*3600 OR (fetch_status = 'pending' AND age > 36*3600)""")
def _(t):
    # the reference's 30 and 7 days scaled to the 72 hours the test articles span
    return lifecycle.expired(t.art.select("article_id", "fetch_status", "fetched_at"), as_of(), 60, 36).select("article_id", "reason")


@query("feed_health", sql="""
WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'click') AS last_ok FROM events GROUP BY user_id)
SELECT user_id AS feed, errors, CASE WHEN errors >= 10 THEN 'disabled' WHEN errors >= 5 THEN 'error' ELSE 'active' END AS status FROM (
  SELECT user_id, count(*) FILTER (event_type <> 'click' AND (last_ok IS NULL OR (ts, event_id) > last_ok)) AS errors FROM events JOIN l USING (user_id) GROUP BY user_id)""")
def _(t):
    return lifecycle.feed_health(t.events, "user_id", "ts", "event_id", F.col("event_type") == "click")


@query("bulk_flag", uses="pub", sql="""
SELECT publication_id, CASE WHEN name IN ('Supplier#000000003','Supplier#000000005') THEN 'paused' ELSE 'active' END AS status FROM pub""")
def _(t):
    return t.pub.select("publication_id", F.when(F.col("name").isin("Supplier#000000003", "Supplier#000000005"), "paused").otherwise("active").alias("status"))


@query("bulk_reset", uses="art art_evt", sql="""
WITH reset AS (SELECT article_id FROM art WHERE analyzer_status = 'completed' AND (topic_id = 0 OR topic_id = 6))
SELECT 'articles' AS kind, count(*) AS n FROM reset UNION ALL
SELECT 'kept_links', count(*) FROM art_evt WHERE article_id NOT IN (SELECT article_id FROM reset)""")
def _(t):
    reset = t.art.filter("analyzer_status = 'completed' AND (topic_id = 0 OR topic_id = 6)").select("article_id")
    kept = t.art_evt.join(reset, "article_id", "left_anti")
    return reset.agg(F.lit("articles").alias("kind"), F.count("*").alias("n")).unionByName(kept.agg(F.lit("kept_links").alias("kind"), F.count("*").alias("n")))


@query("attempts_breakdown", uses="art", sql="""
SELECT process_attempts AS attempts, count(*) AS articles FROM art WHERE process_status = 'failed' AND (last_attempt_at IS NULL OR last_attempt_at >= TIMESTAMP '2024-01-30 12:00:00') GROUP BY 1""")
def _(t):
    recent = F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") >= F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return t.art.filter((F.col("process_status") == "failed") & recent).groupBy(F.col("process_attempts").alias("attempts")).agg(F.count("*").alias("articles"))


@query("dim_upsert", uses="pub", sql="""
WITH old AS (SELECT publication_id, name, domain FROM pub WHERE s_acctbal > 0), new AS (SELECT publication_id, name, CASE WHEN nation_id%2 = 0 THEN concat('new.', domain) END AS domain FROM pub WHERE nation_id < 15)
SELECT publication_id, coalesce(n.name, o.name) AS name, coalesce(n.domain, o.domain, '') AS domain,
  CASE WHEN o.publication_id IS NULL THEN 'created' WHEN n.publication_id IS NULL OR (n.name = o.name AND coalesce(n.domain, o.domain) = o.domain) THEN 'kept' ELSE 'updated' END AS action
FROM old o FULL JOIN new n USING (publication_id)""")
def _(t):
    old = t.pub.filter("s_acctbal > 0").select("publication_id", "name", "domain")
    new = t.pub.filter("nation_id < 15").select("publication_id", "name", F.when(F.col("nation_id") % 2 == 0, F.concat(F.lit("new."), "domain")).alias("domain"))
    return lifecycle.upsert(old, new, "publication_id", ["name", "domain"]).withColumn("domain", F.coalesce("domain", F.lit("")))


@query("backfill_chunks", sql="""
WITH d AS (SELECT ts::DATE AS d FROM events), c AS (SELECT date_diff('day', d, DATE '2024-01-30')//7 AS chunk, count(*) AS n FROM d GROUP BY 1)
SELECT chunk, strftime(greatest(DATE '2024-01-30' - INTERVAL (chunk*7+6) DAY, DATE '2024-01-01'), '%Y-%m-%d') AS start_day, strftime(DATE '2024-01-30' - INTERVAL (chunk*7) DAY, '%Y-%m-%d') AS end_day, n AS articles FROM c""")
def _(t):
    # windows of seven days walking back from the last day, each meeting the rows of its own days
    chunks = t.events.agg(F.lit("2024-01-30").cast("date").alias("last"), F.lit("2024-01-01").cast("date").alias("first")).select(
        "first", F.posexplode(F.sequence(F.col("last"), F.col("first"), F.expr("INTERVAL -7 DAYS"))).alias("chunk", "end_day")).select(
        F.col("chunk").cast("long").alias("chunk"), F.greatest(F.date_sub("end_day", 6), "first").alias("start_day"), "end_day")
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    by_day = chunks.withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    return by_day.join(days, "day").groupBy("chunk", F.date_format("start_day", "yyyy-MM-dd").alias("start_day"),
                                            F.date_format("end_day", "yyyy-MM-dd").alias("end_day")).agg(F.sum("n").alias("articles"))


@query("array_ops", uses="pub_topic", sql="""
WITH n AS (SELECT publication_id, list_sort(list(topic_id)) AS have, [1,2,3]::BIGINT[] AS want FROM pub_topic GROUP BY publication_id)
SELECT publication_id, array_to_string(list_filter(want, lambda x: NOT list_contains(have, x)), ',') AS missing, len(list_intersect(have, want)) AS shared FROM n""")
def _(t):
    have = t.pub_topic.groupBy("publication_id").agg(F.collect_set("topic_id").alias("have"))
    want = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    return have.select("publication_id", F.array_join(F.array_except(want, "have").cast("array<string>"), ",").alias("missing"),
                       F.size(F.array_intersect("have", want)).cast("long").alias("shared"))


@query("topic_recent_20", uses="art", sql="""
SELECT topic_id, article_id FROM art WHERE summary_status = 'completed' QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY published_at DESC, article_id) <= 20""")
def _(t):
    return top_k(t.art.filter("summary_status = 'completed'").select("topic_id", "article_id", "published_at"), ["topic_id"],
                 [F.desc("published_at"), F.asc("article_id")], 20).select("topic_id", "article_id")


@query("unique_facts", uses="art", sql="""
WITH l AS (SELECT topic_id, -epoch_us(published_at) AS age, article_id, unnest(string_split(content, chr(10))) AS fact, generate_subscripts(string_split(content, chr(10)),1) AS i FROM art),
d AS (SELECT topic_id, fact, min((age, article_id, i)) AS pos FROM l GROUP BY topic_id, fact)
SELECT topic_id, md5(string_agg(fact, chr(10) ORDER BY pos)) AS facts, count(*) AS n FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY pos) <= 20) GROUP BY topic_id""")
def _(t):
    return lifecycle.unique_facts(t.art, "topic_id", "content", 20).select("topic_id", F.md5(F.array_join("facts", "\n")).alias("facts"), F.size("facts").cast("long").alias("n"))


@query("sample_per_class", sql="""
SELECT quality, toxic, doc_id FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(concat('7:', doc_id)), doc_id) <= 5""")
def _(t):
    # seeded hash order: a repeatable random sample
    return top_k(t.labels.withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))), ["quality", "toxic"],
                 [F.asc("h"), F.asc("doc_id")], 5).select("quality", "toxic", "doc_id")


# --- publications and links ---------------------------------------------------------------


@query("pub_missing_links", uses="pub pub_topic pub_region pub_lang", sql="""
SELECT publication_id, publication_id NOT IN (SELECT publication_id FROM pub_topic) AS no_topic, publication_id NOT IN (SELECT publication_id FROM pub_region) AS no_region,
  publication_id NOT IN (SELECT publication_id FROM pub_lang) AS no_language FROM pub
WHERE publication_id NOT IN (SELECT publication_id FROM pub_topic) OR publication_id NOT IN (SELECT publication_id FROM pub_region) OR publication_id NOT IN (SELECT publication_id FROM pub_lang)""")
def _(t):
    out = t.pub.select("publication_id")
    for name, links in (("topic", t.pub_topic), ("region", t.pub_region), ("language", t.pub_lang)):
        has = links.select("publication_id").distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(has, "publication_id", "left").withColumn(f"no_{name}", F.col(f"has_{name}").isNull()).drop(f"has_{name}")
    return out.filter("no_topic OR no_region OR no_language")


@query("pub_other", uses="pub pub_topic pub_region", sql="""
SELECT publication_id FROM pub WHERE NOT (publication_id IN (SELECT publication_id FROM pub_topic WHERE topic_id = 2) AND publication_id IN (SELECT publication_id FROM pub_region WHERE region_code = 'us'))""")
def _(t):
    match = t.pub_topic.filter("topic_id = 2").join(t.pub_region.filter("region_code = 'us'"), "publication_id", "left_semi")
    return t.pub.join(match, "publication_id", "left_anti").select("publication_id")


_HOST = "concat('pub', page_id%120, '.example.com')"


@query("missing_publications", uses="pub", sql=f"""
SELECT {_HOST} AS domain, count(*) AS pages FROM pages WHERE {_HOST} NOT IN (SELECT domain FROM pub) GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    seen = t.pages.select(F.expr(_HOST).alias("domain")).groupBy("domain").agg(F.count("*").alias("pages")).filter("pages >= 2")
    return seen.join(t.pub.select("domain"), "domain", "left_anti")


@query("pub_match", uses="pub", sql="""
WITH a AS (SELECT doc_id, CASE WHEN doc_id%3 = 0 THEN upper(source) END AS sid, concat('pub', doc_id%150, '.example.com') AS domain FROM documents),
m AS (SELECT a.*, p.publication_id AS by_id, q.publication_id AS by_domain FROM a LEFT JOIN pub p ON p.publication_id = lower(sid) LEFT JOIN pub q ON q.domain = a.domain)
SELECT doc_id, coalesce(by_id, by_domain, concat('new:', domain)) AS publication_id, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_domain IS NOT NULL THEN 'domain' ELSE 'created' END AS how FROM m""")
def _(t):
    link = F.expr("concat('https://www.pub', doc_id%150, '.example.com/a?x=1')")
    a = t.documents.select("doc_id", F.lower(F.when(F.col("doc_id") % 3 == 0, F.upper("source"))).alias("sid"), url.domain_of(link).alias("domain"))
    by_id = t.pub.select(F.col("publication_id").alias("sid"), F.col("publication_id").alias("by_id"))
    by_domain = t.pub.select("domain", F.col("publication_id").alias("by_domain"))
    m = a.join(by_id, "sid", "left").join(by_domain, "domain", "left")
    return m.select("doc_id", F.coalesce("by_id", "by_domain", F.concat(F.lit("new:"), "domain")).alias("publication_id"),
                    F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_domain").isNotNull(), "domain").otherwise("created").alias("how"))


@query("pub_created", uses="pub", sql="""
WITH a AS (SELECT doc_id, CASE WHEN doc_id%3 = 0 THEN lower(source) END AS sid, concat('pub', doc_id%150, '.example.com') AS domain FROM documents)
SELECT concat('new:', a.domain) AS publication_id, a.domain, min(doc_id) AS first_doc, count(*) AS articles FROM a LEFT JOIN pub p ON p.publication_id = sid LEFT JOIN pub q ON q.domain = a.domain
WHERE p.publication_id IS NULL AND q.publication_id IS NULL GROUP BY a.domain""")
def _(t):
    link = F.expr("concat('https://www.pub', doc_id%150, '.example.com/a?x=1')")
    a = t.documents.select("doc_id", F.lower(F.when(F.col("doc_id") % 3 == 0, F.col("source"))).alias("publication_id"), url.domain_of(link).alias("domain"))
    return lifecycle.new_publications(a, t.pub, "doc_id")


@query("link_by_domain", uses="pub", sql=f"""
SELECT page_id, publication_id FROM pages JOIN pub ON pub.domain = {_HOST}""")
def _(t):
    link = F.concat(F.lit("http://WWW."), F.upper(F.expr(_HOST)), F.lit("/x"))
    return t.pages.select("page_id", url.domain_of(link).alias("domain")).join(t.pub.select(F.lower("domain").alias("domain"), "publication_id"), "domain").select("page_id", "publication_id")


@query("pub_meta_sync", uses="art pub_topic pub_region pub_lang pub", sql="""
WITH fed AS (SELECT * FROM art WHERE publication_id IN (SELECT publication_id FROM pub))
SELECT publication_id, 'topic' AS kind, topic_id::VARCHAR AS value FROM (SELECT publication_id, topic_id FROM pub_topic UNION SELECT publication_id, topic_id FROM fed)
UNION SELECT publication_id, 'language', language FROM (SELECT publication_id, language FROM pub_lang UNION SELECT publication_id, language FROM fed)
UNION SELECT publication_id, 'region', region_code FROM (SELECT publication_id, region_code FROM pub_region UNION SELECT publication_id, CASE language WHEN 'en' THEN 'us' ELSE language END FROM fed)""")
def _(t):
    region = F.when(F.col("language") == "en", "us").otherwise(F.col("language"))
    fed = t.art.select("publication_id", F.col("topic_id").cast("string").alias("topic"), "language", region.alias("region"))
    known = t.pub_topic.select("publication_id", F.lit("topic").alias("kind"), F.col("topic_id").cast("string").alias("value")).unionByName(
        t.pub_lang.select("publication_id", F.lit("language").alias("kind"), F.col("language").alias("value"))).unionByName(
        t.pub_region.select("publication_id", F.lit("region").alias("kind"), F.col("region_code").alias("value")))
    return lifecycle.spread_metadata(known, fed.join(t.pub.select("publication_id"), "publication_id", "left_semi"), ["topic", "language", "region"])


@query("pub_article_counts", uses="art", sql="""
SELECT publication_id, count(*) AS articles FROM art GROUP BY 1 ORDER BY articles DESC, publication_id LIMIT 20""")
def _(t):
    return first_rows(t.art.groupBy("publication_id").agg(F.count("*").alias("articles")), [F.desc("articles"), F.asc("publication_id")], 20)


@query("pub_completeness", uses="pub pub_topic pub_region pub_lang", sql="""
SELECT publication_id, (SELECT count(*) FROM pub_topic x WHERE x.publication_id = p.publication_id) AS topics, (SELECT count(*) FROM pub_region x WHERE x.publication_id = p.publication_id) AS regions,
  (SELECT count(*) FROM pub_lang x WHERE x.publication_id = p.publication_id) AS languages FROM pub p""")
def _(t):
    out = t.pub.select("publication_id")
    for name, links in (("topics", t.pub_topic), ("regions", t.pub_region), ("languages", t.pub_lang)):
        out = out.join(links.groupBy("publication_id").agg(F.count("*").alias(name)), "publication_id", "left")
    return out.fillna(0)


@query("pub_all_topics", uses="pub_topic", sql="""
SELECT publication_id, count(*) FILTER (topic_id IN (2,4)) = 2 AS has_all FROM pub_topic WHERE topic_id IN (2,4) GROUP BY publication_id""")
def _(t):
    return t.pub_topic.filter(F.col("topic_id").isin(2, 4)).groupBy("publication_id").agg((F.countDistinct("topic_id") == 2).alias("has_all"))


@query("meta_backfill", uses="art", sql="""
SELECT article_id, CASE WHEN image_url IS NOT NULL AND image_url <> '' THEN image_url WHEN article_id%2 = 0 THEN concat('https://cdn.example.com/', article_id, '.png') ELSE '' END AS image_url,
  CASE WHEN description <> '' THEN description ELSE title END AS description FROM art""")
def _(t):
    found = F.when(F.col("article_id") % 2 == 0, F.expr("concat('https://cdn.example.com/', article_id, '.png')"))
    return t.art.select("article_id", F.coalesce(F.when(text.nz("image_url") != "", F.col("image_url")), found, F.lit("")).alias("image_url"),
                        F.coalesce(F.when(text.nz("description") != "", F.col("description")), F.col("title")).alias("description"))
