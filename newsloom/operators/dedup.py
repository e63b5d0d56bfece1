"""Three-layer duplicate search: address, content, near-equal title.

Each layer names for every row the earliest arrival (least id) it repeats. Groups of copies are collapsed by
aggregation before any join, so neither a page copied a million times nor a publisher with a third of all
rows produces pairs among copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text


def alone(id_col: str) -> Column:
    """A join key that no row shares: rows without a key are spread by it instead of meeting in one partition."""
    return F.concat(F.lit("\0"), F.col(id_col).cast("string"))


def first_with_key(df: DataFrame, id_col: str, key: str, out: str) -> DataFrame:
    """Adds the least id sharing a non-empty key, when it is not the row's own."""
    firsts = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("_key")).agg(F.min(id_col).alias("_first"))
    found = F.when(F.col("_first") < F.col(id_col), F.col("_first"))
    keyed = df.withColumn("_key", F.when(F.col(key) != "", F.col(key)).otherwise(alone(id_col)))
    return keyed.join(firsts, "_key", "left").withColumn(out, found).drop("_key", "_first")


def title_variant(title: str) -> Column:
    """Equal for titles of similarity 1: the sorted token set, or the bare text where there are no tokens."""
    words = text.token_set(title)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(
        F.concat(F.lit("="), F.trim(F.lower(text.nz(title)))))


def similar_sets(sets: DataFrame, block: list[str], span: str | None, threshold: float) -> DataFrame:
    """Pairs of different token sets with Jaccard above the threshold, within a block and adjacent spans.

    ``sets(block..., span, variant, words)``. Exact prefix filter: two sets that similar share a word among
    the rarest ``n - ceil(t*n) + 1`` words of each. Common words enter a prefix last, so they rarely meet.
    """
    words = sets.select("variant", F.explode("words").alias("word")).distinct()
    freq = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = sets.select("variant", "words").distinct().withColumn("word", F.explode("words")).join(freq, "word")
    # words of one title: bounded by the title's own length
    order = W.partitionBy("variant").orderBy("df", "word")
    n = F.size("words")
    prefix = ranked.withColumn("i", F.row_number().over(order)).filter(
        F.col("i") <= n - F.ceil(n * F.lit(threshold)) + 1).select("variant", "word", "words")
    keys = block + ([span] if span else [])
    left = sets.select(*keys, "variant").distinct().join(prefix, "variant")
    right = left.select(*keys, "word", F.col("variant").alias("other"), F.col("words").alias("other_words"))
    if span:
        right = right.withColumn(span, F.explode(F.array(F.col(span) - 1, F.col(span), F.col(span) + 1)))
    size_ok = F.least(F.size("words"), F.size("other_words")) >= F.greatest(F.size("words"), F.size("other_words")) * F.lit(threshold)
    pairs = left.join(right, keys + ["word"]).filter((F.col("variant") < F.col("other")) & size_ok)
    pairs = pairs.dropDuplicates(block + ["variant", "other"])
    return pairs.filter(text.jaccard(F.col("words"), F.col("other_words")) > threshold).select(*block, "variant", "other")


def near_title(df: DataFrame, id_col: str, publication: str, title: str, ts: str, out: str,
               threshold: float = 0.85, window_s: int = 7200) -> DataFrame:
    """Adds the least earlier id of the same publication, within the window either way, with a similar title.

    The answer depends on (publication, title variant, second) only, so rows are first reduced to that.
    Similar variants are found by the prefix filter inside two-hour spans. Each reduced row then asks its own
    span and its two neighbours for the least id: the whole span, or the part inside the window, by running
    minima over at most ``window_s`` distinct seconds.
    """
    rows = df.filter((text.nz(title) != "") & F.col(publication).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(publication).alias("p"), title_variant(title).alias("variant"), text.token_set(title).alias("words"),
        F.unix_seconds(ts).alias("t"), F.col(id_col).alias("id"))
    spots = rows.groupBy("p", "variant", "t").agg(F.min("id").alias("id"), F.first("words").alias("words"))
    spots = spots.withColumn("span", F.floor(F.col("t") / window_s))
    pairs = similar_sets(spots.filter(F.size("words") > 0).select("p", "span", "variant", "words"), ["p"], "span", threshold)
    asks = (
        pairs.unionByName(pairs.select("p", F.col("other").alias("variant"), F.col("variant").alias("other")))
        .join(spots.select("p", "variant", "t"), ["p", "variant"])
        .select("p", "variant", "t", "other")
        .unionByName(spots.select("p", "variant", "t", F.col("variant").alias("other")))
    )
    edge = F.lit(window_s)
    span = F.floor(F.col("t") / window_s)
    asks = asks.select("p", "variant", F.col("t").alias("asked"), F.col("other").alias("w"), F.explode(F.array(
        F.struct(span.alias("span"), ((span + 1) * edge - 1).alias("at"), F.lit("upto").alias("side")),
        F.struct((span + 1).alias("span"), (F.col("t") + edge).alias("at"), F.lit("upto").alias("side")),
        F.struct((span - 1).alias("span"), (F.col("t") - edge).alias("at"), F.lit("from").alias("side")),
    )).alias("q")).select("p", "variant", "asked", "w", "q.*")
    shape = ["p", "w", "span", "at", "side", "id", "variant", "asked"]
    data = spots.select("p", F.col("variant").alias("w"), "span", F.col("t").alias("at"), F.lit("data").alias("side"), "id",
                        F.lit(None).cast("string").alias("variant"), F.lit(None).cast("long").alias("asked"))
    both = data.select(*shape).unionByName(asks.withColumn("id", F.lit(None).cast(data.schema["id"].dataType)).select(*shape))
    by = W.partitionBy("p", "w", "span")
    upto = F.min("id").over(by.orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    since = F.min("id").over(by.orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow))
    seen = both.withColumn("least", F.when(F.col("side") == "upto", upto).when(F.col("side") == "from", since))
    best = seen.filter("side <> 'data' AND least IS NOT NULL").groupBy("p", "variant", F.col("asked").alias("t")).agg(
        F.min("least").alias("_least"))
    keyed = df.withColumn("p", F.col(publication)).withColumn("variant", F.when(
        (text.nz(title) != "") & F.col(publication).isNotNull() & F.col(ts).isNotNull(), title_variant(title)).otherwise(alone(id_col))).withColumn(
        "t", F.unix_seconds(ts))
    found = F.when(F.col("_least") < F.col(id_col), F.col("_least"))
    return keyed.join(best, ["p", "variant", "t"], "left").withColumn(out, found).drop("p", "variant", "t", "_least")


def three_layers(df: DataFrame, id_col: str, url_key: str, hash_key: str, publication: str, title: str, ts: str) -> DataFrame:
    """``(id, duplicate_of, layer)``: the first layer that finds an earlier arrival wins."""
    step = first_with_key(df, id_col, url_key, "by_url")
    step = first_with_key(step, id_col, hash_key, "by_hash")
    step = near_title(step, id_col, publication, title, ts, "by_title")
    layer = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_hash").isNotNull(), "hash").when(
        F.col("by_title").isNotNull(), "title")
    return step.filter(layer.isNotNull()).select(
        id_col, F.coalesce("by_url", "by_hash", "by_title").alias("duplicate_of"), layer.alias("layer"))
