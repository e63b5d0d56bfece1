"""The dealt operators and the pipeline as registered queries over whole tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import (
    chat_format, crf_lines, forced_bpe, gnat_negatives, label_shards, lang_ftrl, lsh_forest, multiprobe_lsh, pareto_mix, phrase_mining, pivot_distance,
    quality_fm, url_automaton,
)
from newsloom.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WALK = """
p{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY "rank", digest) AS upto FROM (
  SELECT * FROM m{j}) WHERE size > 0 AND whole < 3 AND hits = 0 AND size <= gap),
h{k} AS (SELECT digest, true AS hit FROM p{k} WHERE upto <= gap),
t{k} AS (SELECT m{j}.* EXCLUDE (gap), hits + coalesce(hit::INT, 0) AS hits_{k} FROM m{j} LEFT JOIN h{k} USING (digest)),
m{k} AS (SELECT * EXCLUDE (hits, hits_{k}), hits_{k} AS hits, target - sum((whole + hits_{k}) * size) OVER (PARTITION BY source) AS gap FROM t{k})"""


@query("op2_pareto_mix", """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), coalesce(source, '~'), coalesce(text, '~'))) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
c AS (SELECT *, sum(most) OVER o - most AS held, sum(weight) OVER () - (sum(weight) OVER o - weight) AS free, (SELECT sum(source_size) FROM s) AS goal
  FROM w WINDOW o AS (ORDER BY most / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((goal - held)::DOUBLE / free::DOUBLE) AS level FROM c),
g AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM w, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS mean,
  (('0x' || substr(md5('mix|' || digest), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
a AS (SELECT *, floor(mean)::BIGINT AS whole, mean - floor(mean) AS p FROM r),
m0 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) ELSE 1e300 END AS "rank", 0 AS hits,
  target - sum(floor(mean)::BIGINT * size) OVER (PARTITION BY source) AS gap FROM a),"""
       + ",".join(_WALK.format(k=k, j=k - 1) for k in (1, 2, 3)) + """
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + hits) * size)::BIGINT AS taken FROM m3""")
def op2_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = pareto_mix.pareto_mix(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_CHATS = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM (VALUES (0), (1)) v(k)),
r AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w IS DISTINCT FROM role AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
l AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + length(text) - length(replace(text, '<', '')) AS c,
  length(role) + length(role) - length(replace(role, '\\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, chr(10), '')) AS rc,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY n)) AS loss_sha256,
  sum(c + CASE WHEN role = 'assistant' THEN 11 ELSE 0 END + CASE WHEN opens THEN 15 + rc ELSE 5 END)::BIGINT AS formatted_chars FROM l GROUP BY conv_id"""


@query("op5_chat_format", _CHATS)
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = chat_format.format_chats(turns.unionByName(planted))
    back = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                        F.array_join(chat_format.read_loss(F.col("formatted")), "").alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def _glob_sql(glob: str) -> str:
    host, path = (g.translate(str.maketrans({"*": ".*", "?": ".", ".": "[.]"})) for g in glob.split(" ", 1))
    return f"(regexp_full_match(host, '{host}', 'si') AND regexp_full_match(path, '{path}', 'si'))"


_RULE_SQL = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
                     for v, h, p in sorted(url_automaton.RULES, key=lambda r: -len(r[1] + r[2])))
_URLS = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE {_RULE_SQL} END AS hit FROM h)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1)
  WHEN {' OR '.join(_glob_sql(g) for g in url_automaton.BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


@query("op7_url_automaton", _URLS)
def op7_url_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return url_automaton.judge_urls(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op8_label_shards")
def op8_label_shards(spark: SparkSession, folder: str) -> DataFrame:
    return label_shards.balanced_shards(table(spark, folder, "documents"))


@query("op4_forced_bpe")
def op4_forced_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    coded = forced_bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op1_quality_fm")
def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality_fm.score_rows(docs, quality_fm.train(docs, table(spark, folder, "labels")), ["doc_id"])
    return scored.select("row.*", "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_lang_ftrl")
def op3_lang_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged = lang_ftrl.judge_rows(docs, lang_ftrl.train(docs), ["doc_id"])
    return judged.select("row.*", "lang_pred", "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_crf_lines")
def op9_crf_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged = crf_lines.judge_documents(docs, crf_lines.train(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query("op6_multiprobe_lsh")
def op6_multiprobe_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return multiprobe_lsh.search(table(spark, folder, "embeddings"))


_NEAR = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS id, count(*) AS copies, any_value(w) AS w FROM d GROUP BY text),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM (
  SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT id, id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
m AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, copies FROM d JOIN t USING (text) JOIN k USING (id) LEFT JOIN m USING (id)"""


@query("op10_lsh_forest", _NEAR)
def op10_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, folder, "documents")).drop("node")


_INTS = """WITH e AS (SELECT DISTINCT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query("op11_gnat_negatives", _INTS + """,
r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM e WHERE label IS NOT NULL),
a AS (SELECT * FROM r WHERE id % 100 = 0),
p AS (SELECT a.id AS anchor_id, a.label, a.v, r.id AS positive_id, list_inner_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS positive_score
  FROM a JOIN r ON a.label = r.label AND a.id <> r.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY positive_score DESC, r.id) <= 5),
n AS (SELECT anchor_id, positive_id, r.id AS negative_id, positive_score, list_inner_product(p.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS negative_score
  FROM p JOIN r ON p.label <> r.label)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank, negative_id,
  positive_score, negative_score FROM n WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score QUALIFY rank <= 10""")
def op11_gnat_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat_negatives.mine(table(spark, folder, "embeddings"), label=label)


@query("op12_pivot_distance", _INTS + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""")
def op12_pivot_distance(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_distance.search(table(spark, folder, "embeddings"))


_PHRASES = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
s AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT lang, f, array_to_string(w[1 : k - 1], ' ') AS phrase FROM s WHERE k > 2
  UNION SELECT lang, f, array_to_string(w[2:], ' ') FROM s WHERE k > 2),
c AS (SELECT lang, phrase, f AS a, w, unnest(generate_series(1, k - 1)) AS cut FROM s ANTI JOIN i USING (lang, phrase, f)),
b AS (SELECT c.*, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m QUALIFY rank <= 2000"""


@query("op13_phrase_mining", _PHRASES)
def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
