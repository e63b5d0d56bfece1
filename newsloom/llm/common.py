"""Pieces that several operators share: words, held-out rows, stable random numbers, positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut_afresh, cut_lineage

#: A word of the contracts, in Java's and RE2's notation.
WORD = r"[^\x20\x09-\x0D]+"
#: A 52-bit integer fits a double exactly.
UNIT = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def unit_random(*cols: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the values alone, so that every rerun and every retried task draws the same."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / UNIT


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's place (long, from 0) in the order, without bringing all rows to one task.

    Rows are dealt by range and sorted inside their partition; only one count per partition is summed up. The
    dealt rows are cut from their lineage first, because places and counts have to come from the same deal.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).groupBy().agg(F.collect_list(F.struct("_part", "_n")).alias("all"))
    before = counts.select(F.explode("all").alias("p"), "all").select(
        F.col("p._part").alias("_part"),
        F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_part"] < F.col("p._part"), x["_n"]).otherwise(0)).alias("_before"))
    return dealt.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def per_batch(df: DataFrame, make, schema: str, rows: int = 512, keep: str | None = None) -> DataFrame:
    """Runs ``make()`` once per task and the function it returns on slices of ``rows`` rows.

    The function takes a dict of column lists and returns a dict of output lists, so that what a task holds is one Arrow
    batch of input and one slice of output, whatever the table's size. A column ``keep`` is passed on untouched.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    arrow = list(to_arrow_schema(made))

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True) if n != keep})
                arrays = [part.column(keep)] if keep else []
                names = [keep] if keep else []
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(out[f.name], f.type) for f in arrow]], names=[*names, *[f.name for f in arrow]])

    return df.mapInArrow(run, StructType([*([df.schema[keep]] if keep else []), *made]))


def as_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Columns as one struct named ``row``: whatever their names, they clash with nothing beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("row")


def stable_sample(rows: DataFrame, key: Column, most: int, total: int, salt: int) -> DataFrame:
    """About ``most`` of ``total`` rows, chosen by a hash of the key: the same rows in every run, without a shuffle."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * most / total))


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Joins rows whose key may be hot with a side that has few rows and each key once, which is copied per salt."""
    salt = F.pmod(F.xxhash64(spread, F.lit(13)), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, root)``: the least id of the connected component of every node that has an edge.

    A round takes the least label around each node and then that label's own label, so paths are halved and rounds grow
    with the logarithm of a component's width. A hub's edges are pre-aggregated; the jump's join, in which all
    nodes of a large component look up one label, is salted and holds only labels that have moved. What each round
    leaves is written to the shared checkpoint folder.
    """
    both = cut_lineage(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(
        edges.select(F.col(b).alias("id"), F.col(a).alias("other"))).distinct())
    labels = both.groupBy("id").agg(F.min("other").alias("near")).select("id", F.least("id", "near").alias("root"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step = cut_afresh(step)
        moved = step.filter(F.col("id") != F.col("root")).select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = moved.join(step.select("root").distinct(), "root", "left_semi")
        jumped = salted_join(step, moved, ["root"], F.col("id"), "left").select("id", "was", F.coalesce("next", "root").alias("root"))
        jumped = cut_afresh(jumped)
        labels = jumped.select("id", "root")
        if jumped.filter(F.col("was") != F.col("root")).isEmpty():
            return labels
