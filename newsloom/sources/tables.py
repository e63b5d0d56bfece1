"""Domain tables over the driver's parquet files.

Each adapter is one SELECT written so that Spark and DuckDB read it alike.
``@name`` stands for a base table or another adapter; the few spellings that
differ between the engines are the ``DIALECT`` tokens.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
AS_OF_S = 1706659200


def as_of():
    """The moment that stands for "now" in every registered query."""
    return F.timestamp_seconds(F.lit(AS_OF_S))


BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: What ``trim`` takes off in DuckDB: the spaces of Unicode, not only the ASCII one.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

DIALECT = {
    "spark": {
        "TS_S(": "timestamp_seconds(",
        "EPOCH_S(": "unix_seconds(",
        "EACH123": "explode(array(1,2,3))",
        "EACH12": "explode(array(1,2))",
        "AS_TS(": "to_timestamp(",
        "BIG(": "bigint(",
        "TRIM_Z(": f"trim(BOTH '{SPACES}' FROM ",
    },
    "duck": {
        "TS_S(": "make_timestamp(1000000*",
        "EPOCH_S(": "epoch_s(",
        "EACH123": "unnest([1,2,3])",
        "EACH12": "unnest([1,2])",
        "AS_TS(": "(",
        "BIG(": "(0+",
        "TRIM_Z(": "trim(",
    },
}

ADAPTERS = {
    # one article per document; title is its first sentence, description its first line
    "art": """
        SELECT doc_id AS article_id, source AS publication_id, lang AS language, topic_id, cluster_id,
               title, description, text AS content, n_chars, age_s, headline_score,
               TS_S((1706659200 - age_s)) AS published_at,
               TS_S((1706659200 - age_s + 900)) AS fetched_at,
               TS_S((1706659200 - age_s + 1800)) AS triaged_at,
               CASE WHEN doc_id%10 < 5 THEN 'accepted' WHEN doc_id%10 < 7 THEN 'rejected'
                    WHEN doc_id%10 = 7 THEN 'pending_llm' WHEN doc_id%10 = 8 THEN 'promoted'
                    ELSE 'pending' END AS triage_status,
               CASE WHEN doc_id%4 = 0 THEN 'llm' WHEN doc_id%4 = 1 THEN 'legacy'
                    ELSE 'algorithmic' END AS triage_method,
               CASE WHEN doc_id%4 = 0 THEN (doc_id%9)/1000e0 END AS triage_cost,
               doc_id%11 = 0 AS is_top_headline,
               CASE WHEN doc_id%4 = 1 OR (doc_id*3)%8 = 0 THEN 'pending' WHEN (doc_id*3)%8 = 1 THEN 'fetching'
                    WHEN (doc_id*3)%8 = 2 THEN 'failed' ELSE 'completed' END AS fetch_status,
               CASE WHEN doc_id%4 = 1 THEN 'pending' WHEN (doc_id*5)%9 = 0 THEN 'processing' WHEN (doc_id*5)%9 = 1 THEN 'failed'
                    WHEN (doc_id*5)%9 < 4 THEN 'pending' ELSE 'completed' END AS process_status,
               CASE WHEN doc_id%4 = 1 THEN 'pending' WHEN (doc_id*7)%9 = 0 THEN 'processing' WHEN (doc_id*7)%9 = 1 THEN 'failed'
                    WHEN (doc_id*7)%9 < 4 THEN 'pending' ELSE 'completed' END AS summary_status,
               CASE WHEN doc_id%4 = 1 THEN 'pending' WHEN (doc_id*11)%9 = 0 THEN 'processing' WHEN (doc_id*11)%9 = 1 THEN 'failed'
                    WHEN (doc_id*11)%9 < 4 THEN 'pending' ELSE 'completed' END AS analyzer_status,
               CASE WHEN doc_id%4 = 1 THEN 0 ELSE doc_id%5 END AS fetch_attempts,
               CASE WHEN doc_id%4 = 1 THEN 0 ELSE (doc_id+1)%5 END AS process_attempts,
               CASE WHEN doc_id%4 = 1 THEN 0 ELSE (doc_id+2)%5 END AS summary_attempts,
               CASE WHEN doc_id%4 = 1 THEN 0 ELSE (doc_id+3)%5 END AS analyzer_attempts,
               CASE WHEN doc_id%7 = 0 THEN NULL
                    ELSE TS_S((1706659200 - (doc_id*613)%90000)) END AS last_attempt_at,
               CASE WHEN doc_id%6 = 0 THEN 'Skipped: content too short'
                    WHEN doc_id%6 = 1 THEN 'HTTP 429 Too Many Requests: rate limit reached'
                    WHEN doc_id%6 = 2 THEN 'timeout' END AS error_message,
               CASE WHEN doc_id%3 = 1 THEN '' WHEN doc_id%3 = 2
                    THEN concat('https://img.example.com/', CAST(doc_id AS STRING), '.jpg') END AS image_url,
               ((doc_id*13)%500)/10e0 AS fetch_seconds,
               CASE WHEN doc_id%3 = 0 THEN 'simple' WHEN doc_id%3 = 1 THEN 'browser'
                    ELSE 'feed' END AS fetch_strategy,
               CASE WHEN doc_id%4 = 0 THEN 'algorithmic' WHEN doc_id%4 = 1 THEN 'hybrid'
                    WHEN doc_id%4 = 2 THEN 'rss' ELSE 'ai' END AS route,
               ((doc_id*29)%101)/100e0 AS quality_score,
               (doc_id%12)/500e0 AS process_cost,
               doc_id%13 = 0 AS paywall_detected
        FROM (SELECT *, (doc_id*7919)%259200 AS age_s, ((doc_id*31)%100)/100e0 AS headline_score,
                     doc_id%7 AS topic_id, (doc_id*13)%40 AS cluster_id,
                     TRIM_Z(regexp_extract(text, '^[^.!?\\n]*', 0)) AS title,
                     TRIM_Z(regexp_extract(text, '^[^\\n]*', 0)) AS description
              FROM @documents)""",
    # M2M topic links: the article's own topic and a second one
    "art_topic": """
        SELECT DISTINCT article_id, (topic_id*k + k - 1)%7 AS topic_id
        FROM (SELECT doc_id AS article_id, doc_id%7 AS topic_id, EACH12 AS k FROM @documents)""",
    "topic": """
        SELECT n_nationkey AS topic_id, lower(n_name) AS slug, n_name AS name FROM @nation""",
    "pub": """
        SELECT concat('src', CAST(s_suppkey AS STRING)) AS publication_id, s_name AS name,
               concat('pub', CAST(s_suppkey AS STRING), '.example.com') AS domain,
               ((s_suppkey*37)%101)/10e0 AS authority, s_nationkey AS nation_id,
               CASE WHEN s_nationkey%5 = 0 THEN 'us' WHEN s_nationkey%5 = 1 THEN 'br'
                    WHEN s_nationkey%5 = 2 THEN 'de' WHEN s_nationkey%5 = 3 THEN 'fr'
                    ELSE 'es' END AS region_code,
               s_acctbal
        FROM @supplier""",
    "pub_topic": """
        SELECT DISTINCT publication_id, (s_suppkey*k)%7 AS topic_id
        FROM (SELECT concat('src', CAST(s_suppkey AS STRING)) AS publication_id, s_suppkey, EACH123 AS k
              FROM @supplier WHERE s_acctbal > 500)""",
    "pub_region": """
        SELECT concat('src', CAST(s_suppkey AS STRING)) AS publication_id,
               CASE WHEN s_nationkey%5 = 0 THEN 'us' WHEN s_nationkey%5 = 1 THEN 'br'
                    WHEN s_nationkey%5 = 2 THEN 'de' WHEN s_nationkey%5 = 3 THEN 'fr'
                    ELSE 'es' END AS region_code
        FROM @supplier WHERE s_acctbal < 9000""",
    "pub_lang": """
        SELECT concat('src', CAST(s_suppkey AS STRING)) AS publication_id,
               CASE WHEN s_suppkey%4 = 0 THEN 'en' WHEN s_suppkey%4 = 1 THEN 'fr'
                    WHEN s_suppkey%4 = 2 THEN 'de' ELSE 'es' END AS language
        FROM @supplier WHERE s_nationkey <> 4""",
    "users": """
        SELECT c_custkey AS user_id, c_name AS user_name,
               CASE WHEN c_custkey%4 = 0 THEN 'America/New_York' WHEN c_custkey%4 = 1 THEN 'UTC'
                    WHEN c_custkey%4 = 2 THEN 'Europe/Berlin' ELSE 'America/Sao_Paulo' END AS tz,
               c_custkey%6 <> 0 AS digest_enabled, 1 + c_custkey%4 AS max_topics,
               CASE WHEN c_custkey%5 = 0 THEN 'events' WHEN c_custkey%5 = 1 THEN 'articles'
                    WHEN c_custkey%5 = 2 THEN 'unknown' ELSE NULL END AS strategy,
               c_acctbal, c_mktsegment
        FROM @customer""",
    "user_topic": """
        SELECT user_id, topic_id, max(weight) AS weight
        FROM (SELECT user_id, (user_id*k)%7 AS topic_id, ((user_id+k)%5 + 1)/5e0 AS weight
              FROM (SELECT c_custkey AS user_id, EACH123 AS k FROM @customer WHERE c_acctbal > 0))
        GROUP BY user_id, topic_id""",
    "user_pub": """
        SELECT DISTINCT user_id, concat('src', CAST((user_id*k)%20 AS STRING)) AS publication_id
        FROM (SELECT c_custkey AS user_id, EACH123 AS k FROM @customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING'))""",
    "user_lang": """
        SELECT DISTINCT user_id, CASE WHEN (user_id+k)%4 = 0 THEN 'en' WHEN (user_id+k)%4 = 1 THEN 'fr'
                    WHEN (user_id+k)%4 = 2 THEN 'de' ELSE 'es' END AS language
        FROM (SELECT c_custkey AS user_id, EACH12 AS k FROM @customer WHERE c_nationkey < 13)""",
    # timed arrivals
    "arrivals": """
        SELECT event_id AS article_id, AS_TS(ts) AS published_at, user_id AS publication_id,
               event_type AS topic, least(value/500e0, 1e0) AS headline_score,
               event_id%200 AS cluster_id, event_id%3 <> 2 AS accepted,
               CASE WHEN event_id%10 = 0 THEN 'legacy' WHEN event_id%10 < 4 THEN 'llm'
                    ELSE 'algorithmic' END AS triage_method
        FROM @events""",
    # events with a centroid; two entities each
    "evt": """
        SELECT vec_id AS event_id, label AS entity_id, embedding, (vec_id*37)%96 AS age_h,
               TS_S((1706659200 - 3600*((vec_id*37)%96))) AS last_seen_at
        FROM @embeddings""",
    "evt_entity": """
        SELECT DISTINCT event_id, CASE WHEN k = 1 THEN label ELSE 100 + event_id%25 END AS entity_id
        FROM (SELECT vec_id AS event_id, label, EACH12 AS k FROM @embeddings)""",
    # each arrival mentions one event first and another second
    "art_evt": """
        SELECT article_id, event_id, max(relevance) AS relevance, min(pri) = 1 AS is_primary
        FROM (SELECT article_id, CASE WHEN k = 1 THEN (article_id*7)%(SELECT count(*) FROM @embeddings) ELSE (article_id*11+3)%(SELECT count(*) FROM @embeddings) END AS event_id,
                     CASE WHEN k = 1 AND article_id%3 <> 2 THEN 1 ELSE 2 END AS pri,
                     ((article_id*k)%97)/97e0 AS relevance
              FROM (SELECT event_id AS article_id, EACH12 AS k FROM @events))
        GROUP BY article_id, event_id""",
    "page_art": "SELECT page_id, url, html FROM @pages",
    # raw model replies for triage, some of them broken
    "replies": """
        SELECT doc_id AS article_id, CASE WHEN doc_id%8 = 0 THEN 'I cannot score this.'
            WHEN doc_id%8 = 1 THEN concat('```json', chr(10), body, chr(10), '```')
            WHEN doc_id%8 = 2 THEN replace(body, '"impact": ', '"impact": 1')
            WHEN doc_id%8 = 3 THEN concat('json ', body) ELSE body END AS reply
        FROM (SELECT doc_id, concat('{"impact": ', CAST(doc_id%10 AS STRING), ', "novelty": ', CAST((doc_id*3)%11 AS STRING),
                     ', "significance": ', CAST((doc_id*7)%11 AS STRING), ', "action": "process", "reason": "r"}') AS body
              FROM @documents WHERE source <> 'src5')""",
    # one usage row per conversation turn
    "usage": """
        SELECT conv_id, turn, role,
               CASE WHEN conv_id%4 = 0 THEN 'gpt-4.1-nano' WHEN conv_id%4 = 1 THEN 'gpt-4o-mini'
                    WHEN conv_id%4 = 2 THEN 'gpt-4o' ELSE 'text-embedding-3-small' END AS model,
               CASE WHEN conv_id%3 = 0 THEN 'article_triage' WHEN conv_id%3 = 1 THEN 'summarize'
                    ELSE 'analyze' END AS operation,
               CASE WHEN role = 'assistant' THEN 0 ELSE BIG(length(text)) END AS prompt_tokens,
               CASE WHEN role = 'assistant' THEN BIG(length(text)) ELSE 0 END AS completion_tokens
        FROM @conversations""",
}

_REF = re.compile(r"@([a-z_]+)")


def adapter_refs(name: str) -> list[str]:
    return _REF.findall(ADAPTERS[name])


def _render(sql: str, engine: str) -> str:
    for token, spelled in DIALECT[engine].items():
        sql = sql.replace(token, spelled)
    return sql


class Tables:
    """Lazy access to base tables and adapters of one parquet folder: ``t.art``, ``t.events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")
        self._tag = "nl_" + hashlib.md5(self.dir.encode()).hexdigest()[:8]
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._adapter(name) if name in ADAPTERS else self._base(name)
        return self._made[name]

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def _base(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def _view(self, name: str) -> str:
        view = f"{self._tag}_{name}"
        getattr(self, name).createOrReplaceTempView(view)
        return view

    def _adapter(self, name: str) -> DataFrame:
        sql = _render(ADAPTERS[name], "spark")
        return self.spark.sql(_REF.sub(lambda m: self._view(m.group(1)), sql))


def duck_ctes(names: str | list[str]) -> str:
    """``name AS (...)`` list for the DuckDB text of the named adapters."""
    names = names.split() if isinstance(names, str) else names
    out = []
    for n in names:
        sql = _REF.sub(lambda m: m.group(1), _render(ADAPTERS[n], "duck"))
        out.append(f"{n} AS ({sql})")
    return ",\n".join(out)
