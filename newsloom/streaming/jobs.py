"""Structured Streaming forms of the batch operators: the same functions, event time and bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators import graph, stories, triage
from newsloom.operators.ranking import latest_by
from newsloom.session import checkpoint_root, cut_lineage

LATE = "2 hours"
#: Files of a replayed slice, where it has rows enough for all of them.
SLICE_FILES = 4


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def fresh_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Process what is available and return the sink's rows; files and progress live in the shared folder.
    With the same ``root`` a later run goes on where this one stopped."""
    spark = stream.sparkSession
    root = root or fresh_folder(spark)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, str, str | None], None], mode: str = "append",
                root: str | None = None) -> tuple[SparkSession, str]:
    """Process what is available through ``each(rows, folder, folder of the batch before)``.

    Folders are named by batch id and overwritten, so a batch that runs again after a failure leaves the same
    result and always builds on the batch before it, in this run or an earlier one.
    """
    spark = stream.sparkSession
    root = root or fresh_folder(spark)

    def handle(rows: DataFrame, batch_id: int) -> None:
        before = f"{root}/out/batch={batch_id - 1:09d}" if batch_id else None
        each(rows, f"{root}/out/batch={batch_id:09d}", before)

    q = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{root}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark, f"{root}/out"


def replay(df: DataFrame, ts: str, batches: int = 4, root: str | None = None, close: str | None = None, closing: tuple[dict, ...] = ({},)) -> DataFrame:
    """A table as a stream of that many micro-batches in order of time: the files of one written slice are one batch.

    ``close`` ends the input: a last batch holds rows, null but for their time (this long after the newest) and the values in ``closing``,
    that move the watermark past every window, session and wait still open. What they open themselves stays open.
    """
    spark = df.sparkSession
    folder = f"{root or fresh_folder(spark)}/in"
    lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    width = ((hi or 0) - (lo or 0)) // batches + 1
    slot = F.coalesce(F.floor((F.unix_micros(ts) - F.lit(lo or 0)) / width), F.lit(0))
    sizes = {r[0]: r[1] for r in df.groupBy(slot).count().collect()}
    files = SLICE_FILES if min(sizes.values(), default=0) >= 10_000 * SLICE_FILES else 1
    for k in range(batches):
        if k in sizes:
            df.filter(slot == k).repartition(files).write.parquet(f"{folder}/slice{k:04d}")
    if close:
        end = F.timestamp_micros(F.lit(hi or 0)) + F.expr(f"INTERVAL {close}")
        rows = [spark.range(1).select(*[(end if f.name == ts else F.lit(c.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema]) for c in closing]
        last = rows[0]
        for r in rows[1:]:
            last = last.unionByName(r)
        last.coalesce(1).write.parquet(f"{folder}/slice{batches:04d}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)


def save(rows: DataFrame, folder: str, before: str | None = None) -> None:
    rows.write.mode("overwrite").parquet(folder)


def dedup(stream: DataFrame, ts: str, keys: list[str], root: str | None = None, parts: int = 64) -> DataFrame:
    """First arrival of every key ever, however late a copy comes and however the input is cut into batches.

    What earlier batches let through is the table of known keys, kept in the shared folder by hash of the key; a batch is
    reduced to its own first arrivals and joined against it, reading only folders whose hash it has. A batch that runs
    again reads earlier batches only.
    """

    def each(rows: DataFrame, folder: str, before: str | None) -> None:
        out, _, number = folder.rpartition("/batch=")
        first = rows.groupBy(*keys).agg(F.min(ts).alias(ts)).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if before:
            first = cut_lineage(first)
            present = [r[0] for r in first.select("part").distinct().collect()]
            known = rows.sparkSession.read.parquet(out).filter((F.col("batch") < int(number)) & F.col("part").isin(present))
            known = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            first = first.join(known, same, "left_anti")
        first.write.mode("overwrite").partitionBy("part").parquet(folder)

    spark, out = run_batches(stream, each, root=root)
    return spark.read.parquet(out).select(*keys, ts)


def tumbling_counts(stream: DataFrame, ts: str, key: str, size: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, LATE).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(
        key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sliding_counts(stream: DataFrame, ts: str, key: str, size: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Counts per step first, so that a window's many steps are sums of counts and not copies of rows."""
    steps = stream.withWatermark(ts, LATE).groupBy(F.window(ts, step).alias("w"), key).agg(F.count("*").alias("n"))
    return steps.groupBy(F.window(F.window_time("w"), size, step), key).agg(F.sum("n").alias("n")).select(
        key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Reader sessions: runs of events less than the gap apart."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, LATE).groupBy(w, key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def timeouts(pending: DataFrame, resolved: DataFrame, key: str, ts: str, wait: str = "1 hour") -> DataFrame:
    """Pending items with no resolution of the same key within the wait: the unmatched side of a stream-stream
    outer join, which emits a row once the watermark shows that no match can come any more."""
    p = pending.withWatermark(ts, LATE).select(F.col(key), F.col(ts).alias("pending_at"), "item_id")
    r = resolved.withWatermark(ts, LATE).select(F.col(key).alias("r_key"), F.col(ts).alias("resolved_at"))
    on = (F.col(key) == F.col("r_key")) & (F.col("resolved_at") >= F.col("pending_at")) & (
        F.col("resolved_at") <= F.col("pending_at") + F.expr(f"INTERVAL {wait}"))
    return p.join(r, on, "left_outer").filter("r_key IS NULL").select(key, "item_id", "pending_at")


def bursts(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Three earliest arrivals of each key and the burst they make; the state is three times, whatever the key
    holds, and goes twelve hours after the key's last arrival. Of the rows of a key that lie in one Arrow batch three and the newest
    are shuffled, so a hot key does not bring all its rows to one worker."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("t", kind="stable")
            per = pdf.groupby("key", dropna=False)
            yield pdf[(per.cumcount() < 3) | (per.cumcount(ascending=False) == 0)]

    def fold(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = list(state.get) if state.exists else [None, None, None]
        best = [t for t in first if t is not None]
        newest = state.getCurrentWatermarkMs()
        for pdf in chunks:
            newest = max(newest, int(pdf["t"].max()) // 1000)
            best = sorted(best + [int(x) for x in pdf["t"].nsmallest(3)])[:3]
        state.update(tuple(best + [None] * (3 - len(best))))
        state.setTimeoutTimestamp(newest + 12 * 3600 * 1000)
        gap = (best[2] - best[0]) / 1e6 if len(best) == 3 else None
        score = 0.0 if gap is None else 1.0 if gap < 3600 else 0.8 if gap < 7200 else 0.0
        yield pd.DataFrame({"key": [k[0]], "first_us": [best[0]], "burst": [score]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("t"))
    rows = rows.mapInPandas(heads, "key long, at timestamp, t long").withWatermark("at", LATE)
    return rows.groupBy("key").applyInPandasWithState(
        fold, "key long, first_us long, burst double", "a long, b long, c long", "update", GroupStateTimeout.EventTimeTimeout)


def story_updates(stream: DataFrame, vocabulary: DataFrame, id_col: str, body: str, language: str, ts: str,
                  expiry_s: int = 12 * 3600, root: str | None = None) -> tuple[SparkSession, str]:
    """Story groups kept up to date by micro-batch.

    The state is a table of active coverage variants and their stories, one version per batch in the shared
    folder. A batch joins its own variants with the active ones, compares and regroups them, and writes the next
    version; variants older than the expiry stay behind. No key holds all of a language.
    """
    spark = stream.sparkSession

    def each(rows: DataFrame, folder: str, before: str | None) -> None:
        new = stories.coverage_variants(rows, id_col, body, language, ts).withColumn("story_id", F.col("variant")).withColumn("fresh", F.lit(True))
        if before:
            # Against the batch's oldest row: a batch may be longer than the expiry.
            oldest = rows.agg(F.coalesce(F.min(F.unix_seconds(ts)), F.lit(0))).scalar()
            old = spark.read.parquet(before).filter(F.col("last_s") >= oldest - expiry_s)
            new = new.unionByName(old.withColumn("fresh", F.lit(False)).select(new.columns))
            new = new.groupBy("language", "span", "h").agg(
                F.first("body").alias("body"), F.min("variant").alias("variant"), F.sum("copies").alias("copies"), F.min("first_s").alias("first_s"),
                F.max("last_s").alias("last_s"), F.min("story_id").alias("story_id"), F.max("fresh").alias("fresh"))
        new = cut_lineage(new)  # read three times below
        pairs = stories.similar_coverage(new, vocabulary, fresh="fresh").select("a", "b")
        bonds = new.filter("variant <> story_id").select(F.col("variant").alias("a"), F.col("story_id").alias("b"))
        comp = graph.components(pairs.unionByName(bonds)).withColumnRenamed("id", "variant")
        new.join(comp, "variant", "left").withColumn("story_id", F.coalesce("component", "story_id")).drop("component", "fresh").write.mode(
            "overwrite").parquet(folder)

    return run_batches(stream, each, root=root)


def stories_now(spark: SparkSession, out: str) -> DataFrame:
    """Every variant once, as its newest version has it, with its story's present name.

    A variant that has expired keeps the name its story had then; the versions' names are joined up to the least.
    """
    versions = spark.read.parquet(out)
    newest = latest_by(versions.drop("body"), ["language", "span", "h"], ["batch"])
    bonds = versions.filter("variant <> story_id").select(F.col("variant").alias("a"), F.col("story_id").alias("b"))
    renamed = versions.join(newest.select("language", "span", "h", F.col("variant").alias("now")), ["language", "span", "h"]).filter(
        "variant <> now").select(F.col("variant").alias("a"), F.col("now").alias("b"))
    comp = graph.components(bonds.unionByName(renamed).distinct()).withColumnRenamed("id", "variant")
    return newest.join(comp, "variant", "left").withColumn("story_id", F.coalesce("component", "story_id")).drop("component", "batch")


def triage_updates(stream: DataFrame, links: DataFrame, pub_counts: DataFrame, topic_counts: DataFrame, ts: str,
                   root: str | None = None) -> tuple[SparkSession, str]:
    """Tier 1 by micro-batch, each batch seeing what the batches before it accepted.

    A batch decides as of its newest row. The state is a small table of what was accepted per publisher and topic and when, one
    version per batch in the shared folder: a batch reads the version before its own, adds counts of the last 24 hours per publisher
    and of the day per topic to the given ones, decides, and writes the next version. A batch that runs again writes the same.
    """
    spark = stream.sparkSession
    root = root or fresh_folder(spark)
    day = 24 * 3600

    def each(rows: DataFrame, folder: str, before: str | None) -> None:
        now = rows.agg(F.max(F.unix_seconds(ts))).first()[0]
        pubs, topics = pub_counts, topic_counts
        state = None
        if before:
            state = spark.read.parquet(before.replace("/out/", "/state/"))
            if now is not None:
                state = state.filter((F.col("at") > now - day) | (F.floor(F.col("at") / day) == now // day))
                pubs = pubs.unionByName(state.filter((F.col("kind") == "publisher") & (F.col("at") > now - day)).select(
                    F.col("key").cast(pubs.schema["publication_id"].dataType).alias("publication_id"), F.col("n").alias("accepted_24h")))
                topics = topics.unionByName(state.filter((F.col("kind") == "topic") & (F.floor(F.col("at") / day) == now // day)).select(
                    F.col("key").cast(topics.schema["topic_id"].dataType).alias("topic_id"), F.col("n").alias("accepted_today")))
                pubs = pubs.groupBy("publication_id").agg(F.sum("accepted_24h").alias("accepted_24h"))
                topics = topics.groupBy("topic_id").agg(F.sum("accepted_today").alias("accepted_today"))
        triage.tier1(triage.with_adjustments(rows, links, topics, pubs)).withColumn("decided_at", F.lit(now).cast("long")).write.mode("overwrite").parquet(folder)
        taken = spark.read.parquet(folder).filter("status = 'accepted'").select("article_id", "publication_id")
        new = taken.filter("publication_id IS NOT NULL").groupBy(F.lit("publisher").alias("kind"), F.col("publication_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
        new = new.unionByName(links.join(taken, "article_id").groupBy(F.lit("topic").alias("kind"), F.col("topic_id").cast("string").alias("key")).agg(F.count("*").alias("n")))
        new = new.withColumn("at", F.lit(now).cast("long"))
        (new if state is None else new.unionByName(state.select(new.columns))).write.mode("overwrite").parquet(folder.replace("/out/", "/state/"))

    return run_batches(stream, each, root=root)
