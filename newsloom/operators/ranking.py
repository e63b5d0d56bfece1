"""Ordered operators that stay spread when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.session import cut_lineage


def top_k(df: DataFrame, keys: list, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key. ``row_number() <= k`` lets Spark cut each key to k rows before the
    shuffle (WindowGroupLimit), so a hot key costs k rows per map task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_rows(df: DataFrame, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of the whole table (TakeOrderedAndProject), ranked after the cut."""
    out = df.orderBy(*order).limit(k)
    return out.withColumn(rank, F.row_number().over(W.orderBy(*order))) if rank else out


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[int]]:
    """Rows dealt by range and sorted within their range, written out, with ``_part`` and their place ``_at`` in it; and rows per part.

    Only one number per range partition is collected.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    sizes = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}
    return dealt, [sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]


def rows_between(dealt: DataFrame, sizes: list[int], first: int, last: int) -> DataFrame:
    """Rows whose place in the whole order is in [first, last): only the parts that hold such places are read."""
    keep, start = F.lit(False), 0
    for k, n in enumerate(sizes):
        if start < last and start + n > first:
            keep = keep | ((F.col("_part") == k) & (F.col("_at") >= first - start) & (F.col("_at") < last - start))
        start += n
    return dealt.filter(keep).drop("_part", "_at")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a partial aggregate: no sort, no whole group in a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest])


def rolling_count(df: DataFrame, id_col: str, key: str, ts: str, counted: Column, seconds: int,
                  bucket_s: int = 3600, out: str = "n") -> DataFrame:
    """Per row: how many ``counted`` rows of the same key lie in [ts - seconds, ts].

    Every row becomes two probes of a running total, one at its own time and one just before its window.
    Totals run inside (key, hour) and the hours of a key are then added up, so a key that holds a third of
    the table is spread over its hours instead of being sorted in one task.
    """
    t = F.unix_micros(F.col(ts))
    rows = df.select(
        F.col(id_col), F.col(key),
        F.explode(F.array(
            F.struct(t.alias("t"), counted.cast("long").alias("w"), F.lit(1).alias("sign")),
            F.struct((t - F.lit(seconds * 1000000) - 1).alias("t"), F.lit(0).cast("long").alias("w"), F.lit(-1).alias("sign")),
        )).alias("m"),
    ).select(id_col, key, "m.*").withColumn("b", F.floor(F.col("t") / (bucket_s * 1000000)))
    inside = W.partitionBy(key, "b").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("run", F.sum("w").over(inside))
    before = W.partitionBy(key).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    hours = rows.groupBy(key, "b").agg(F.sum("w").alias("bw")).withColumn("prev", F.coalesce(F.sum("bw").over(before), F.lit(0)))
    return (
        rows.join(hours.select(key, "b", "prev"), [key, "b"])
        .groupBy(id_col, key)
        .agg(F.sum((F.col("run") + F.col("prev")) * F.col("sign")).alias(out))
    )


def as_of_join(probes: DataFrame, states: DataFrame, key: str, ts: str, valid_from: str, value: str, id_col: str,
               bucket_s: int = 86400) -> DataFrame:
    """``(id, key, value)``: for each probe the state of its key that was newest at the probe's time, null if none.

    Running maxima inside (key, day) plus one carried maximum per earlier day, so a hot key spreads over its days.
    """
    shape = StructType([StructField("t", LongType()), StructField("v", states.schema[value].dataType)]).simpleString()
    s = states.select(F.col(key).alias("k"), F.unix_micros(valid_from).alias("t"), F.lit(None).cast(probes.schema[id_col].dataType).alias("id"),
                      F.struct(F.unix_micros(valid_from).alias("t"), F.col(value).alias("v")).alias("s"))
    p = probes.select(F.col(key).alias("k"), F.unix_micros(ts).alias("t"), F.col(id_col).alias("id"), F.lit(None).cast(shape).alias("s"))
    rows = s.unionByName(p).withColumn("b", F.floor(F.col("t") / (bucket_s * 1000000)))
    inside = W.partitionBy("k", "b").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("k", "b").agg(F.max("s").alias("day_s")).withColumn("carry", F.max("day_s").over(before)).select("k", "b", "carry")
    found = rows.withColumn("near", F.max("s").over(inside)).filter("id IS NOT NULL").join(days, ["k", "b"])
    return found.select(F.col("id").alias(id_col), F.col("k").alias(key), F.coalesce("near", "carry")["v"].alias(value))


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``(keys..., name...)``: exact medians from counts of equal values, nulls left out.

    Rows are reduced to one per key and different value before anything is ordered, so a key with many rows costs as
    many rows as it has different values; round the values to bound them.
    """
    out = df.select(*keys).distinct()
    for name, value in values.items():
        n = df.select(*keys, value.alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
        n = n.withColumn("_upto", upto).join(n.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
        low, high = F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("_v"))), F.min(F.when(F.col("_upto") * 2 > F.col("_all"), F.col("_v")))
        out = out.join(n.groupBy(*keys).agg(((low + high) / 2.0).alias(name)), keys, "left")
    return out
