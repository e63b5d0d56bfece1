"""A corpus from raw documents in five stages: quality, language, near duplicates, mix of sources, tokens.

Each stage reads all that the stage before it kept, and its decision takes effect: rejected documents go, one document of
each group of near duplicates stays, the mix repeats or leaves out documents. All but the last return the columns of
``documents``. ``run`` writes each stage as Parquet in the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm import forced_bpe, lang_ftrl, lsh_forest, pareto_mix, quality_fm
from newsloom.llm.common import as_row
from newsloom.session import checkpoint_root

#: Below this score a document is rejected: the classifier's own decision, as in ``op1_quality_fm``.
POOR = 0.5
#: A document without a language, or with less than this probability for the likeliest one, is rejected.
UNSURE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score_rows(docs, machine).filter(F.col("score") >= POOR).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = lang_ftrl.judge_rows(docs, lang_ftrl.train(docs))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= UNSURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the least id and then the least text hash; of rows equal in both, one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    found = lsh_forest.classes(docs).groupBy("root").agg(first).select("first.doc_id", "first.node")
    node = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(as_row(docs), node.alias("_text"), F.col("doc_id").alias("_id"))
    kept = rows.join(found, (F.col("_text") == F.col("node")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    one = F.row_number().over(W.partitionBy("_text", "_id").orderBy(F.lit(1)))
    return kept.withColumn("_k", one).filter("_k = 1").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` per row of the mix."""
    import public_tokenizers

    coded = forced_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]
#: The stages are trained models, a similarity join and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
