"""Extraction quality: agreement of texts, pre-filter, scores, reports and samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text
from newsloom.operators.ranking import medians, top_k

GOOD_F1, PARTIAL_F1, GOOD_MISSING, PARAGRAPH_MATCH = 0.80, 0.55, 1, 0.55
GRADES = [(0.8, "EXCELLENT"), (0.5, "GOOD"), (0.2, "FAIR"), (-0.2, "POOR")]


def long_tokens(c) -> Column:
    return F.filter(text.tokens(c), lambda w: F.length(w) > 1)


#: Words of both texts that are numbered together; a pair of texts with more of them goes alone.
WORDS_AT_ONCE = 1 << 18


def _shared(batches):
    """Sizes of two token lists and of what they share, repeats counted, row by row; a bounded number of words is numbered and sorted at once."""
    for batch in batches:
        words = sum(c.offsets.to_numpy() - c.offsets[0].as_py() for c in (batch["a"], batch["b"]))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(words, words[at] + WORDS_AT_ONCE, "right")) - 1)
            yield _shared_words(batch.slice(at, stop - at))
            at = stop


def _shared_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = batch["a"].flatten(), batch["b"].flatten()
    sizes = [np.diff(c.offsets.to_numpy()) for c in (batch["a"], batch["b"])]
    words = pa.concat_arrays([a, b]).dictionary_encode()
    n = max(1, len(words.dictionary))
    rows = np.concatenate([np.repeat(np.arange(batch.num_rows), s) for s in sizes])
    keys = rows * n + words.indices.to_numpy(zero_copy_only=False)
    (x, nx), (y, ny) = (np.unique(k, return_counts=True) for k in (keys[: len(a)], keys[len(a) :]))
    same, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.bincount(same // n, weights=np.minimum(nx[i], ny[j]), minlength=batch.num_rows).astype(np.int64)
    return pa.RecordBatch.from_arrays([batch["id"], pa.array(both), *[pa.array(s.astype(np.int64)) for s in sizes]], names=["id", "both", "na", "nb"])


def token_f1(df: DataFrame, id_col: str, extracted: str, truth: str) -> DataFrame:
    """``(id, precision, recall, f1)`` over token multisets, counted inside the row: neither texts nor words are shuffled."""
    rows = df.select(F.col(id_col).alias("id"), long_tokens(extracted).alias("a"), long_tokens(truth).alias("b"))
    schema = T.StructType([rows.schema["id"], *[T.StructField(c, T.LongType()) for c in ("both", "na", "nb")]])
    p, r = F.col("both") / F.nullif("na", F.lit(0)), F.col("both") / F.nullif("nb", F.lit(0))
    some = F.col("both") > 0
    return rows.mapInArrow(_shared, schema).select(
        F.col("id").alias(id_col), F.when(some, p).otherwise(0.0).alias("precision"), F.when(some, r).otherwise(0.0).alias("recall"),
        F.when(some, p * r * 2.0 / (p + r)).otherwise(0.0).alias("f1"))


def paragraph_words(c) -> Column:
    """Distinct words of every paragraph of ten or more words; blank lines part paragraphs, or line ends where none do."""
    def pieces(sep: str) -> Column:
        return F.filter(F.split(text.nz(c), sep), lambda p: F.rlike(p, F.lit(r"\S")))

    by_blank = pieces("\n\n")
    chosen = F.when(F.size(by_blank) > 1, by_blank).otherwise(pieces("\r\n|\r|\n"))
    wide = F.filter(chosen, lambda p: F.regexp_count(p, F.lit(r"\S+")) >= 10)
    return F.transform(wide, lambda p: F.array_distinct(long_tokens(p)))


def greedy_matches(extracted: Column, truth: Column) -> Column:
    """How many truth paragraphs, taken in order, find a free extracted one that overlaps enough (best first, then the first):
    a fold whose state is the places already used."""

    def best(used: Column, w: Column) -> Column:
        return F.array_max(F.transform(extracted, lambda h, j: F.struct(
            F.when(F.array_contains(used, j), -1.0).otherwise(text.jaccard(w, h)).alias("s"), (-j).alias("j"))))

    def take(used: Column, w: Column) -> Column:
        # bound once by folding over an array of one
        return F.aggregate(F.array(best(used, w)), used, lambda u, x: F.when(x["s"] >= PARAGRAPH_MATCH, F.concat(u, F.array(-x["j"]))).otherwise(u))

    return F.size(F.aggregate(truth, F.array().cast("array<int>"), take)).cast("long")


def paragraph_diff(df: DataFrame, id_col: str, extracted: str, truth: str) -> DataFrame:
    """``(id, missing, noise, matched)``: one-to-one paragraph matching of two texts."""
    words = df.select(id_col, paragraph_words(extracted).alias("x"), paragraph_words(truth).alias("y"))
    m = words.select(id_col, F.size("x").alias("nx"), F.size("y").alias("ny"), greedy_matches("x", "y").alias("matched"))
    return m.select(id_col, (F.col("ny") - F.col("matched")).alias("missing"), (F.col("nx") - F.col("matched")).alias("noise"), "matched")


def verdict(f1: Column, missing: Column, success: Column) -> Column:
    return (F.when(~success, "failed").when((f1 >= GOOD_F1) & (missing <= GOOD_MISSING), "good")
            .when(f1 >= PARTIAL_F1, "partial").otherwise("bad"))


def extraction_report(scores: DataFrame) -> DataFrame:
    """Per route over ``(route, success, f1, missing, noise, verdict, cost)``; medians are exact, scores to six digits."""
    f1 = F.expr("IF(success, f1, NULL)")

    def share(*kinds: str) -> Column:
        return F.round(F.count_if(F.col("verdict").isin(*kinds)) / F.count("*") * 100.0, 4)

    middle = medians(scores, ["route"], {"median_f1": F.round(f1, 6), "median_missing": F.col("missing").cast("double"), "median_noise": F.round("noise", 6)})
    middle = middle.withColumn("median_f1", F.round(F.coalesce("median_f1", F.lit(0.0)), 6)).withColumn("median_noise", F.round("median_noise", 6))
    return scores.groupBy("route").agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_success"),
        F.round(F.coalesce(F.avg(f1), F.lit(0.0)), 6).alias("mean_f1"), F.round(F.coalesce(F.min(f1), F.lit(0.0)), 6).alias("min_f1"),
        share("good").alias("pct_good"), share("partial").alias("pct_partial"), share("bad", "failed").alias("pct_bad"),
        F.round(F.sum("cost"), 6).alias("total_cost")).join(middle, "route")


def prefilter(content_chars: Column, html_chars: Column, title: Column, paywall: Column, words: Column, blocks: Column) -> Column:
    """``struct(score, confidence, reason)``; a null score means the model has to judge."""
    ratio = html_chars / F.greatest(content_chars, F.lit(1))
    heading = F.length(F.trim(F.coalesce(title, F.lit(""))))

    def out(score, confidence: float, reason: str) -> Column:
        return F.struct(F.lit(score).cast("double").alias("score"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    return (
        F.when(content_chars < 100, out(-0.8, 0.95, "empty_or_minimal_content"))
        .when(ratio > 100, out(-0.5, 0.90, "extraction_failed_html_ratio_high"))
        .when(heading < 5, out(-0.3, 0.88, "missing_or_invalid_title"))
        .when(paywall & (content_chars < 500), out(-0.4, 0.87, "paywall_detected_minimal_content"))
        .when((content_chars > 3000) & (heading > 10) & (ratio < 5) & (words > 300), out(0.85, 0.88, "excellent_indicators_long_clean_content"))
        .when((content_chars > 1500) & (heading > 10) & (ratio < 10) & (blocks > 3), out(0.75, 0.86, "good_indicators_structured_content"))
        .otherwise(out(None, 0.3, "uncertain_quality_needs_llm"))
    )


def overall_score(completeness: Column, purity: Column, structure: Column, readability: Column) -> Column:
    raw = completeness - (1.0 - purity) + (structure - 0.5) * 0.3 + (readability - 0.5) * 0.2
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def grade(score: Column) -> Column:
    out = F.lit("FAILED")
    for low, name in reversed(GRADES):
        out = F.when(score >= low, name).otherwise(out)
    return out


def parse_evaluation(reply: Column) -> Column:
    """Overall score from any of three historical reply shapes: nested scores with a final or overall, or flat fields."""
    c = F.regexp_replace(F.regexp_replace(F.trim(reply), "^```json", ""), "```$", "")

    def num(path: str) -> Column:
        return F.get_json_object(c, path).cast("double")

    nested = F.get_json_object(c, "$.scores").isNotNull()
    assessed = F.get_json_object(c, "$.assessment").isNotNull()
    zero = F.lit(0.0)
    dims = [F.coalesce(F.when(nested, num(f"$.scores.{d}")).otherwise(num(f"$.{d}")), zero)
            for d in ("completeness", "purity", "structure", "readability")]
    given = F.when(nested & assessed, num("$.scores.overall")).when(nested, F.coalesce(num("$.scores.final"), num("$.scores.overall")))
    return F.coalesce(given, overall_score(*dims))


def basic_quality(words: Column, blocks: Column, kinds: Column) -> Column:
    one = F.lit(1.0)
    return F.least(one, words / 500.0) * 0.4 + F.least(one, blocks / 10.0) * 0.3 + F.least(one, kinds / 4.0) * 0.3


def agreement(df: DataFrame, selector: str, readability: str, newspaper: str, page_class: str) -> DataFrame:
    """Adds ``jaccard``, ``char_ratio`` and ``confidence`` of the best agreeing pair of three extractions of a page."""
    names = [selector, readability, newspaper]
    rows = df.select("*", *[F.array_distinct(F.regexp_extract_all(F.lower(text.nz(c)), F.lit(r"(\S+)"), 1)).alias(f"_bag_{c}") for c in names],
                     F.regexp_count(text.nz(selector), F.lit(r"\S+")).alias("_n"))
    combos = [(selector, readability, 0), (selector, newspaper, 1), (readability, newspaper, 2)]
    # bags and overlaps are columns of their own, so that each is computed once per row
    rows = rows.select("*", *[F.size(F.array_intersect(f"_bag_{a}", f"_bag_{b}")).alias(f"_both_{o}") for a, b, o in combos])

    def pair(a: str, b: str, o: int) -> Column:
        la, lb = F.length(text.nz(a)), F.length(text.nz(b))
        union = F.size(f"_bag_{a}") + F.size(f"_bag_{b}") - F.col(f"_both_{o}")
        s = F.struct(F.when(union > 0, F.col(f"_both_{o}") / union).otherwise(0.0).alias("jaccard"), F.lit(-o).alias("o"),
                     (F.least(la, lb) / F.greatest(la, lb)).alias("char_ratio"))
        return F.when((text.nz(a) != "") & (text.nz(b) != ""), s)

    rows = rows.select("*", F.array_max(F.array(*[pair(*c) for c in combos])).alias("_best"))
    j, r, page, n = F.col("_best.jaccard"), F.col("_best.char_ratio"), F.col(page_class), F.col("_n")
    conf = (
        F.when(page.isin("PAYWALL_OR_BLOCK_PAGE", "SKELETON_LOAD"), "failed")
        .when((page == "ARTICLE_PAGE") & (n >= 200), "high").when((page == "ARTICLE_PAGE") & (n >= 80), "medium")
        .when(F.col("_best").isNull(), "failed").when((j >= 0.70) & (r >= 0.65), "high").when((j >= 0.45) & (r >= 0.45), "medium").otherwise("low")
    )
    return rows.select(*df.columns, F.coalesce(j, F.lit(0.0)).alias("jaccard"), F.coalesce(r, F.lit(0.0)).alias("char_ratio"), conf.alias("confidence"))


def primary_text(selector: str, readability: str, newspaper: str, page_class: str) -> Column:
    def n(c: str) -> Column:
        return F.regexp_count(text.nz(c), F.lit(r"\S+"))

    return (
        F.when(F.col(page_class).isin("PAYWALL_OR_BLOCK_PAGE", "SKELETON_LOAD"), "none").when(n(selector) >= 80, "selector")
        .when((n(readability) >= n(newspaper)) & (text.nz(readability) != ""), "readability")
        .when(text.nz(newspaper) != "", "newspaper").otherwise("none")
    )


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum by seeded hash order, the same on every run."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")))
    return top_k(df.withColumn("_h", h), [stratum], [F.asc("_h"), F.asc(id_col)], n).drop("_h")


def template_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., template, mae, winner)``: mean absolute error per template, and the template with the least per key."""
    m = rows.groupBy(*keys, "template").agg(F.round(F.avg("err"), 6).alias("mae"))
    best = m.groupBy(*keys).agg(F.min_by("template", F.struct("mae", "template")).alias("best"))
    return m.join(best, keys).select(*keys, "template", "mae", (F.col("template") == F.col("best")).alias("winner"))
