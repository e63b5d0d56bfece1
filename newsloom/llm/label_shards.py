"""Sharding by balanced label propagation, in Spark joins and aggregates only.

Documents with equal texts are linked, through the text as a hub, so that a group of n copies has n links and not
n * n. Every document starts in a random shard. In a round each hub counts its members per shard and calls them to the
shard where most of them are, among those with room; a shard whose callers exceed its quota accepts a stable random part
of the hubs. Rounds end when no hub asks for another shard, or none that asks is accepted. Only a group larger than a
shard is split beforehand, into parts of about a shard, which are linked inside only.

The law is ``rows``: in the end the shards' counts are at most one apart. Groups are placed whole, the largest first: in the shard
that most of their members are in while it has room, else along the shards' room (``place_groups``); the few that fall on a border there,
less than one per shard, are put where they fit, and are cut only if no shard has room for them. Documents without links
fill what is left, in their own shard if they can.

Defined results: null text has no bytes, is linked with empty text and has crc32 0; rows that repeat in every column are
interchangeable; an empty table gives no rows. Size never counts the row count's evenness. Other columns are not returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from newsloom.llm.common import salted_join, with_position
from newsloom.session import cut_lineage

SHARDS = 16
#: A shard may hold this many times its even share while labels move; groups beyond the share are placed at the end.
SLACK = 1.25
KEY = ["h", "text_crc32", "size"]


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), at).cast("long")


def _loads(rows: DataFrame, shards: int, by: str = "shard", value: Column | None = None) -> list[int]:
    """Rows, or the sum of a value, per shard: as many numbers as there are shards."""
    found = {r[0]: r[1] for r in rows.groupBy(by).agg(F.count("*") if value is None else F.sum(value)).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _majority(linked: DataFrame, group: list[str], room: list[int]) -> DataFrame:
    """Per group: the shard with room in which most members are (``b.to``), its members there (``b.n``), in all, and over how many shards."""
    votes = linked.groupBy(*group, "shard").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.when(_pick(room, F.col("shard")) > 0, 1).otherwise(0).alias("open"), "n",
                          F.xxhash64(*group, "shard").alias("tie"), F.col("shard").alias("to")))
    return votes.groupBy(*group).agg(best.alias("b"), F.sum("n").alias("all"), F.count("*").alias("spread"))


def propagate(linked: DataFrame, group: list[str], quota: int, shards: int) -> DataFrame:
    """Moves rows of ``linked`` (columns ``group``, ``shard``) towards their group's shard; no shard gets over ``quota`` by moves."""
    k = 0
    while True:
        load = _loads(linked, shards)
        room = [max(0, quota - x) for x in load]
        draw = F.pmod(F.xxhash64(*group, F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        # A crowded shard asks only for groups of which it has the most members; an empty-handed one for any.
        calls = _majority(linked, group, room).filter((F.col("spread") > 1) & (F.col("b.open") == 1)).select(
            *group, F.col("b.to").alias("to"), (F.col("all") - F.col("b.n")).alias("come"))
        calls = cut_lineage(calls)
        asked = {r[0]: r[1] for r in calls.groupBy("to").agg(F.sum("come")).collect()}
        part = [min(1.0, room[s] / asked[s]) if asked.get(s) else 0.0 for s in range(shards)]
        share = F.get(F.array(*[F.lit(float(p)) for p in part]), F.col("to"))
        calls = calls.filter(draw < share).select(*group, "to")
        if not asked or calls.isEmpty():
            return linked
        moved = salted_join(linked, calls, group, F.col("doc_id"), "left").withColumn("shard", F.coalesce("to", "shard"))
        linked = cut_lineage(moved.select(*linked.columns))
        k += 1


def _sum_before(blocks: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``before``, the sum of ``n`` over the rows that come first; only a sum per range partition is put together."""
    dealt = cut_lineage(blocks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("_n")).groupBy().agg(F.collect_list(F.struct("_part", "_n")).alias("all"))
    first = sums.select(F.explode("all").alias("p"), "all").select(F.col("p._part").alias("_part"), F.aggregate(
        "all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_part"] < F.col("p._part"), x["_n"]).otherwise(0)).alias("_first"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(first, "_part").withColumn("before", F.col("_first") + F.col("_inside")).drop("_part", "_first", "_inside")


def place_groups(groups: DataFrame, key: list[str], even: list[int]) -> tuple[DataFrame, list[int]]:
    """Adds ``goal`` to ``(key, shard, n)``, null for groups that no shard can hold whole; and the room that is left."""
    shards = len(even)
    order = [F.desc("n"), *[F.asc(c) for c in key]]
    placed = _sum_before(groups, [F.asc("shard"), *order])
    load = _loads(groups, shards, value=F.col("n"))
    start = F.col("before") - _pick([sum(load[:s]) for s in range(shards)], F.col("shard"))
    placed = cut_lineage(placed.withColumn("goal", F.when(start + F.col("n") <= _pick(even, F.col("shard")), F.col("shard"))).drop("before"))
    room = [e - x for e, x in zip(even, _loads(placed.filter("goal is not null"), shards, "goal", F.col("n")), strict=True)]

    # The others along the room of all shards, as on a rule whose sections are shards.
    marks = [sum(room[: s + 1]) for s in range(shards)]
    rest = _sum_before(placed.filter("goal is null").drop("goal"), order)
    at = F.aggregate(F.array(*[F.lit(int(m)) for m in marks]), F.lit(0), lambda n, m: n + (m <= F.col("before")).cast("int"))
    rest = rest.withColumn("goal", at)
    rest = cut_lineage(rest.withColumn("goal", F.when(F.col("before") + F.col("n") <= _pick(marks, F.col("goal")), F.col("goal"))).drop("before"))
    room = [e - x for e, x in zip(room, _loads(rest.filter("goal is not null"), shards, "goal", F.col("n")), strict=True)]

    # What lies on a mark or past the last one: fewer groups than shards on marks, and past it only if there is more than fits.
    goals = []
    for r in rest.filter("goal is null").orderBy(*order).limit(shards).collect():
        s = max(range(shards), key=lambda x: room[x])
        if r["n"] <= room[s]:
            s = min((x for x in range(shards) if room[x] >= r["n"]), key=lambda x: room[x])
            room[s] -= r["n"]
            goals.append((*[r[c] for c in key], s))
    done = placed.filter("goal is not null").unionByName(rest)
    if goals:
        kinds = [*[groups.schema[c].dataType for c in key], "int"]
        rows = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(g, kinds, [*key, "_goal"], strict=True)]) for g in goals]
        found = groups.sparkSession.range(1).select(F.inline(F.array(*rows)))
        done = done.join(F.broadcast(found), key, "left").withColumn("goal", F.coalesce("goal", "_goal")).drop("_goal")
    return done, room


def balanced_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                   F.xxhash64(text).alias("h")))
    total = rows.count()
    even = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("members")).filter("members > 1")
    start = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(shards)).cast("int")
    parts = F.ceil(F.col("members") / max(1, even[0]))
    rows = salted_join(rows, sizes, KEY, F.col("doc_id"), "left")
    rows = rows.withColumn("part", F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), parts)))
    rows = cut_lineage(rows.withColumn("shard", start).drop("members"))
    key = [*KEY, "part"]
    linked = propagate(rows.filter(F.col("part").isNotNull()), key, math.ceil(SLACK * total / shards), shards)

    groups = cut_lineage(_majority(linked, key, [1] * shards).select(*key, F.col("b.to").alias("shard"), F.col("all").alias("n")))
    groups, room = place_groups(groups, key, even)
    linked = salted_join(linked, groups.select(*key, "goal"), key, F.col("doc_id"), "left")
    linked = cut_lineage(linked.select(*rows.columns, "goal"))

    # Rows without links, and of groups that fit nowhere, as runs.
    free = linked.filter("goal is null").drop("goal").unionByName(rows.filter(F.col("part").isNull()))
    free = with_position(free, [F.asc("shard"), F.asc_nulls_last("part"), *[F.asc(c) for c in KEY], F.asc_nulls_last("doc_id")], "place")
    load = _loads(free, shards)
    first = [sum(load[:s]) for s in range(shards)]
    over = [max(0, x - e) for x, e in zip(load, room, strict=True)]
    need = [max(0, e - x) for x, e in zip(load, room, strict=True)]
    pool, upto = [sum(over[:s]) for s in range(shards)], [sum(need[: s + 1]) for s in range(shards)]
    past = F.col("place") - _pick(first, F.col("shard")) - _pick(room, F.col("shard"))
    queue = F.col("queue")
    goal = F.aggregate(F.array(*[F.lit(int(u)) for u in upto]), F.lit(0), lambda n, u: n + (u <= queue).cast("int"))
    free = free.withColumn("queue", F.when(past >= 0, _pick(pool, F.col("shard")) + past)).withColumn("goal", F.when(queue.isNotNull(), goal).otherwise(F.col("shard")))
    final = linked.filter("goal is not null").unionByName(free.select(*linked.columns)).drop("shard").withColumnRenamed("goal", "shard")
    final = with_position(final, [F.asc("shard"), F.asc_nulls_last("part"), *[F.asc(c) for c in KEY], F.asc_nulls_last("doc_id")], "place")
    slot = F.col("place") - _pick([sum(even[:s]) for s in range(shards)], F.col("shard"))
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
