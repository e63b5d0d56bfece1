"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words; a document is repeated ``target / size`` times on average. Whole copies are
certain; the fraction that is left is an inclusion probability p, and documents are ranked by random odds divided by
inclusion odds, ``u / (1 - u) * (1 - p) / p``. The sample is the head of that ranking, of a size fixed in words: it
ends where the words of the source's target are used up. A long document that no longer fits is passed over, and the
ranking is walked again for what still fits, ``PASSES`` times in all.

No source is ever sorted as a whole: a histogram of the rank finds the bin in which the sample ends, and only that
bin's rows are ordered.

Defined results: null text has size 0 and null source is a source of its own (last by code point); documents without
words take 0 words; an empty table gives no rows. Rows with the same id, words and text are interchangeable, so which
of them is taken does not show in the result. Other columns of the input are kept only by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm.common import as_row, salted_join, unit_random, with_position, word_count
from newsloom.session import cut_afresh, cut_lineage

CAP = 3
BINS = 4096
PASSES = 3


def source_targets(sizes: DataFrame, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``: weights 1, 2, 3 repeating by code point.

    The level L with target = min(cap * size, L * weight) is found as the rule says it: share by weight, stop those
    above their cap, share the excess again. A round is one sum over the sources; only its three numbers reach the driver.
    """
    rows = with_position(sizes, [F.col("source").asc_nulls_last()], "place")
    rows = rows.withColumn("weight", F.pmod("place", F.lit(3)) + 1).withColumn("most", cap * F.col("source_size"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    goal, level, stopped = total * share, 0.0, -1
    while True:
        above = F.col("most") < level * F.col("weight")
        n, held, free = rows.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most")).otherwise(0)),
                                 F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (goal - held) / free
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("place", "most")


def _digest() -> Column:
    part = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("|", *part))


def _by_source(rows: DataFrame, one: DataFrame, how: str = "left") -> DataFrame:
    """Joins one row per source; a source may hold most rows, so they are dealt by a salt as well."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("none")).alias("_s")
    return salted_join(rows.select("*", key), one.select(key, *[c for c in one.columns if c != "source"]), ["_s"], F.col("digest"), how).drop("_s")


def _walk(rows: DataFrame, gap: DataFrame) -> DataFrame:
    """Flags with ``hit`` the head of each source's ranking whose words fit into ``gap(source, gap)``."""
    rows = _by_source(rows, gap)
    fits = (F.col("free")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    bins = rows.filter("fits").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    by_bin = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS rows of a source
    ends = bins.withColumn("before", F.coalesce(F.sum("words").over(by_bin), F.lit(0))).filter(
        F.col("before") + F.col("words") > F.col("gap")).groupBy("source").agg(
        F.min(F.struct(F.col("bin").alias("last"), "before")).alias("end"))
    rows = _by_source(rows, cut_lineage(ends))
    edge = F.coalesce(F.col("fits") & (F.col("bin") == F.col("end.last")), F.lit(False))
    inside = rows.filter(~edge).withColumn("hit", F.col("fits") & (F.col("end").isNull() | (F.col("bin") < F.col("end.last"))))
    upto = W.partitionBy("source").orderBy("rank", "digest").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.filter(edge).withColumn("hit", F.col("end.before") + F.sum("size").over(upto) <= F.col("gap"))
    return inside.unionByName(ranked).drop("fits", "end", "gap")


def pareto_mix(docs: DataFrame, cap: int = CAP, share: float = 1.0, seed: str = "mix", weight: str | None = None) -> DataFrame:
    """``(doc_id, digest, size, source, source_size, target, copies)``: one row per document.

    ``weight`` names an optional positive column that raises a document's expected copies within its source; without
    it all documents of a source are equally likely, and sources differ. No document gets more than ``cap`` copies.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digest().alias("digest"),
                                   F.coalesce(w, F.lit(1.0)).alias("w")))
    rows = rows.withColumn("u", unit_random(F.col("digest"), salt=seed))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("mass"))
    aim = cut_lineage(source_targets(sums, cap, share))
    rows = _by_source(rows, aim, "inner")
    mean = F.when(F.col("mass") > 0, F.col("target") * F.col("w") / F.col("mass")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(F.least(mean, F.lit(float(cap)))).cast("long"))
    rows = rows.withColumn("p", F.least(mean, F.lit(float(cap))) - F.col("whole"))
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))).otherwise(F.lit(1e300))
    # Bins are even in u where all odds of a source are alike; else ranks would crowd in a few bins when p is near 0 or 1.
    part = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("target") / F.greatest("source_size", F.lit(1)) % 1.0))
    scaled = F.col("rank") * part / (1 - part)
    rows = rows.withColumn("rank", odds).withColumn("bin", F.floor(scaled / (1 + scaled) * BINS).cast("int"))
    rows = rows.withColumn("free", F.col("whole") < cap).withColumn("copies", F.col("whole"))
    rows = cut_afresh(rows)
    for _ in range(PASSES):
        used = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        rows = _walk(rows, cut_lineage(used))
        # Each walk is written, so that plans stay small: three walks nested would be planned as hundreds of joins.
        rows = cut_afresh(rows.withColumn("copies", F.col("copies") + F.col("hit").cast("long")).withColumn("free", F.col("free") & ~F.col("hit")).drop("hit"))
    return rows.select("doc_id", "digest", "size", "source", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with.

    Rows equal in id, source and text share what the mix takes of them evenly. They are numbered for that by their place in an
    order that may cut them anywhere, so no task needs all of them.
    """
    mix = pareto_mix(docs, **how).groupBy(F.col("digest").alias("_digest")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_n"))
    mix = cut_lineage(mix)
    rows = docs.select(as_row(docs), _digest().alias("_digest")).join(mix.filter("_all > 0"), "_digest")
    if mix.filter("_n > 1").isEmpty():
        copies = F.col("_all")
    else:
        at = with_position(rows.withColumn("_row", F.monotonically_increasing_id()), [F.asc("_digest"), F.asc("_row")], "_place")
        first = at.filter("_n > 1").groupBy("_digest").agg(F.min("_place").alias("_first"))
        rows = at.join(first, "_digest", "left")
        copies = F.expr("_all div _n") + F.coalesce(F.col("_place") - F.col("_first") < F.expr("_all % _n"), F.lit(False)).cast("int")
    taken = rows.select("row", copies.cast("int").alias("_copies")).filter("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "_copies"))).select("row.*")
