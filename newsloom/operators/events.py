"""Event and entity resolution, merging, links and cluster reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import graph, vectors
from newsloom.operators.ranking import top_k
from newsloom.session import cut_afresh, cut_lineage


def distinct_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events with the same centroid and the same entities as one row: ``(event_id, copies, embedding, entity_ids)``."""
    sets = entities.groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return events.join(sets, "event_id").groupBy("embedding", "entity_ids").agg(
        F.min("event_id").alias("event_id"), F.count("*").alias("copies"))


def event_pairs(events: DataFrame, entities: DataFrame, max_dist: float = 0.25, min_shared: int = 1) -> DataFrame:
    """``(a, b, similarity, shared)``: similar events that share entities, copies collapsed to their least id.

    The shared entity is the block, so no pair without one is ever compared, and the number of blocks a pair
    turns up in is the number of entities it shares.
    """
    reps = distinct_events(events, entities).select("event_id", "embedding", F.explode("entity_ids").alias("entity_id"))
    found = vectors.similar_pairs(reps, "event_id", "embedding", ["entity_id"], 1.0 - max_dist)
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.count("*").alias("shared")).filter(
        F.col("shared") >= min_shared)


def by_entity(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct events once per entity: ``(event_id, embedding, entity_id, before, one)``; ``before`` are its entities less than this one."""
    reps = distinct_events(events, entities)
    rows = reps.select("event_id", "embedding", "entity_ids", F.explode("entity_ids").alias("entity_id"))
    return cut_lineage(rows.select("event_id", "embedding", "entity_id", F.filter("entity_ids", lambda e: e < F.col("entity_id")).cast("array<long>").alias("before"),
                                   F.lit(1).cast("long").alias("one")))


def pair_counts(rows: DataFrame, max_dist: float) -> DataFrame:
    """``(event_id, n)``: in how many pairs of ``event_pairs`` an event is; no pair leaves a task. ``rows`` as of ``by_entity``."""
    found = vectors.similar_counts(rows, "event_id", "embedding", "one", 1.0 - max_dist, block=("entity_id",), before="before")
    return found.select(F.col("id").alias("event_id"), F.col("near").alias("n"))


def pair_links(rows: DataFrame, max_dist: float) -> DataFrame:
    """``(a, b)`` with the components of ``event_pairs``."""
    return vectors.similar_links(rows, "event_id", "embedding", ["entity_id"], 1.0 - max_dist)


def representatives(rows: DataFrame, max_dist: float, links_each: int = 32, least: int = 1 << 20) -> DataFrame:
    """``(id, representative)`` of a greedy cover of ``event_pairs`` by falling (pairs, id), as ``graph.representatives`` gives it.

    Pairs grow with the square of an entity's events, so while there may be more than ``links_each`` per event (and ``least`` in all), rounds ask
    the vectors: what has no heavier undecided neighbour is kept, what is similar to it is dropped. Only the rest is made into pairs.
    """
    sim, key = 1.0 - max_dist, ["event_id", "embedding"]
    ask = lambda df, among=None: vectors.heaviest(df, "event_id", "embedding", "n", ["entity_id"], sim, among).withColumnRenamed("id", "event_id")
    every = cut_afresh(rows.select(*key, "entity_id").join(pair_counts(rows, max_dist), "event_id"))
    open_, won, most = every, [], None
    while True:
        nodes = open_.groupBy("event_id").agg(F.first("n").alias("n")).agg(F.count("*").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("ends")).first()
        most = max(least, links_each * nodes["events"]) if most is None else most
        met = open_.groupBy("entity_id").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)), F.lit(0))).first()[0]
        if min(nodes["ends"], met) <= 2 * most:
            break
        best = cut_afresh(open_.join(ask(open_), "event_id", "left_anti"))
        won.append(best)
        left = cut_afresh(open_.join(best.select("event_id"), "event_id", "left_anti"))
        open_ = cut_afresh(left.join(ask(left, best), "event_id", "left_anti"))
    pairs = vectors.similar_pairs(open_, "event_id", "embedding", ["entity_id"], sim).select("a", "b").distinct()
    last = graph.kept(open_.select(F.col("event_id").alias("id"), "n").distinct(), cut_afresh(pairs), "n").select(F.col("id").alias("event_id"))
    chosen = every.join(last, "event_id", "left_semi")
    for part in won:
        chosen = chosen.unionByName(part)
    chosen = cut_afresh(chosen)
    rest = every.join(chosen.select("event_id"), "event_id", "left_anti")
    members = ask(rest, chosen).select(F.col("event_id").alias("id"), F.col("rank.i").alias("representative"))
    return chosen.select(F.col("event_id").alias("id"), F.col("event_id").alias("representative")).distinct().unionByName(members)


def related_counts(events: DataFrame, links: DataFrame, as_of: Column, max_dist: float = 0.30, hours: int = 48) -> DataFrame:
    """How many recent events are similar to each recent event, leaving out events that share an article.

    Copies of one centroid are counted through their representative: neighbours' copies, plus own copies
    less one, less the similar events that share an article (an article has at most a few events).
    """
    recent = events.filter(F.col("last_seen_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")).select("event_id", "embedding")
    reps = recent.groupBy("embedding").agg(F.min("event_id").alias("rep"), F.count("*").alias("copies"))
    member = recent.join(reps, "embedding").select("event_id", "rep", "copies", "embedding")
    around = vectors.similar_counts(reps, "rep", "embedding", "copies", 1.0 - max_dist).withColumnRenamed("id", "rep")
    one = links.select("article_id", "event_id").join(member.select("event_id", "rep", "embedding"), "event_id")
    other = one.select("article_id", F.col("event_id").alias("other"), F.col("rep").alias("other_rep"), F.col("embedding").alias("other_v"))
    together = one.join(other, "article_id").filter("event_id <> other")
    alike = (F.col("rep") == F.col("other_rep")) | (F.round(vectors.cosine("embedding", "other_v"), 6) >= 1.0 - max_dist)
    shared = together.filter(alike).select("event_id", "other").distinct().groupBy("event_id").agg(F.count("*").alias("joint"))
    n = F.coalesce("near", F.lit(0)) + F.col("copies") - 1 - F.coalesce("joint", F.lit(0))
    return member.drop("embedding").join(around, "rep", "left").join(shared, "event_id", "left").select("event_id", n.alias("related"))


def event_groups(links: DataFrame) -> DataFrame:
    """Articles of each event by role; secondary leaves out the primary ones (links are unique per pair)."""
    return links.groupBy("event_id", "article_id").agg(F.max("is_primary").alias("is_primary")).select(
        "event_id", "article_id", F.when(F.col("is_primary"), "primary").otherwise("secondary").alias("role"))


def event_scores(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mentions and score ``2 * primary + secondary`` per event (and further keys)."""
    out = links.groupBy(*(keys or []), "event_id").agg(
        F.count_if("is_primary").alias("primary_mentions"), F.count_if(~F.col("is_primary")).alias("secondary_mentions"))
    return out.withColumn("score", F.col("primary_mentions") * 2.0 + F.col("secondary_mentions"))


def boosted(scores: DataFrame, related: DataFrame, weight: float = 0.5) -> DataFrame:
    return scores.join(related, "event_id", "left").withColumn("related", F.coalesce("related", F.lit(0))).withColumn(
        "score", F.col("score") + F.col("related") * weight)


def single_primary(links: DataFrame) -> DataFrame:
    """Exactly one primary event per article: best of the primaries, else the most relevant."""
    best = F.max_by("event_id", F.struct("is_primary", "relevance", -F.col("event_id")))
    return links.groupBy("article_id").agg(best.alias("event_id"))


def canonical_events(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(event_id, last_seen_at, canonical)``: the earliest event of each component stands for it."""
    comp = graph.components(pairs).withColumnRenamed("id", "event_id")
    first = events.join(comp, "event_id").groupBy("component").agg(
        F.min_by("event_id", F.struct("last_seen_at", "event_id")).alias("canonical"))
    return cut_lineage(events.join(comp, "event_id", "left").join(first, "component", "left").select(
        "event_id", "last_seen_at", F.coalesce("canonical", "event_id").alias("canonical")))


def move_entities(entities: DataFrame, target: DataFrame) -> DataFrame:
    """``(event_id, entity_id)``: the entity links of merged events, each once; ``target`` is from ``canonical_events``."""
    return entities.join(target.select("event_id", "canonical"), "event_id").select(F.col("canonical").alias("event_id"), "entity_id").distinct()


def merge(target: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of similar events become their earliest member (first seen, then id), as ``canonical_events`` says.

    Returns merged events ``(event_id, members, article_count, last_seen_at)`` and moved links with the highest
    relevance per article, primary if any of the moved links was.
    """
    moved = links.join(target.select("event_id", "canonical"), "event_id").groupBy("article_id", "canonical").agg(
        F.max("relevance").alias("relevance"), F.max("is_primary").alias("is_primary"))
    counts = moved.groupBy("canonical").agg(F.count("*").alias("article_count"))
    merged = target.groupBy("canonical").agg(F.count("*").alias("members"), F.max("last_seen_at").alias("last_seen_at"))
    out = merged.join(counts, "canonical", "left").select(
        F.col("canonical").alias("event_id"), "members", F.coalesce("article_count", F.lit(0)).alias("article_count"), "last_seen_at")
    return out, moved.withColumnRenamed("canonical", "event_id")


def resolve_events(incoming: DataFrame, base: DataFrame, entities: DataFrame, max_dist: float = 0.25, hours: int = 48) -> DataFrame:
    """``(event_id, resolved_id, how)``: same hash, else nearest base event that shares an entity and was seen
    within the window, else a new event, alike newcomers sharing one id.

    Both sides: ``event_id, event_hash, embedding, last_seen_at``.
    """
    hashes = base.groupBy("event_hash").agg(F.min("event_id").alias("by_hash"))
    step = incoming.join(hashes, "event_hash", "left")
    open_ = step.filter("by_hash IS NULL")
    ent = entities.select("event_id", "entity_id")
    seen = F.unix_micros("last_seen_at")
    left = open_.select("event_id", "embedding", (seen - hours * 3_600_000_000).alias("since"))
    # What was last seen before the window of every newcomer is not looked at.
    begin = left.agg(F.coalesce(F.min("since"), F.lit((1 << 63) - 1))).scalar()
    right = base.select("event_id", "embedding", seen.alias("since")).filter(F.col("since") >= begin)
    near = vectors.nearest_between(left.join(ent, "event_id"), right.join(ent, "event_id"), "event_id", "embedding", ["entity_id"], 1.0 - max_dist, since="since")
    best = near.select(F.col("a").alias("event_id"), F.col("b").alias("by_vector"))
    fresh = open_.select("event_id", "embedding").join(best, "event_id", "left_anti")
    pairs = event_pairs(fresh, ent.join(fresh, "event_id", "left_semi"), max_dist)
    comp = graph.components(pairs).withColumnRenamed("id", "event_id").withColumnRenamed("component", "by_batch")
    how = F.when(F.col("by_hash").isNotNull(), "hash").when(F.col("by_vector").isNotNull(), "vector").otherwise("new")
    return step.join(best, "event_id", "left").join(comp, "event_id", "left").select(
        "event_id", F.coalesce("by_hash", "by_vector", "by_batch", "event_id").alias("resolved_id"), how.alias("how"))


def resolve_entities(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, max_dist: float = 0.10) -> DataFrame:
    """``(mention_id, entity_id, how)``: canonical name, else alias, else nearest vector of the type, else new.

    ``mentions(mention_id, name, type, embedding)``, ``entities(entity_id, canonical_name, type, embedding)``,
    ``aliases(alias, entity_id)``. New entities take the least mention id of their canonical name.
    """
    m = mentions.withColumn("canonical_name", text.canonical_entity("name"))
    names = entities.groupBy("canonical_name").agg(F.min("entity_id").alias("by_name"))
    known = aliases.groupBy(F.col("alias").alias("canonical_name")).agg(F.min("entity_id").alias("by_alias"))
    step = m.join(names, "canonical_name", "left").join(known, "canonical_name", "left")
    open_ = step.filter("by_name IS NULL AND by_alias IS NULL").select(F.col("mention_id").alias("i"), "type", "embedding")
    near = vectors.nearest_between(open_, entities.select(F.col("entity_id").alias("i"), "type", "embedding"), "i", "embedding", ["type"], 1.0 - max_dist)
    best = near.select(F.col("a").alias("mention_id"), F.col("b").alias("by_vector"))
    step = step.join(best, "mention_id", "left")
    unknown = step.filter("by_name IS NULL AND by_alias IS NULL AND by_vector IS NULL")
    new = unknown.groupBy("canonical_name").agg(F.min("mention_id").alias("by_new"))
    how = (F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias")
           .when(F.col("by_vector").isNotNull(), "vector").otherwise("new"))
    return step.join(new, "canonical_name", "left").select(
        "mention_id", F.coalesce("by_name", "by_alias", "by_vector", "by_new").alias("entity_id"), how.alias("how"))


def drop_repeats_in_article(extracted: DataFrame, near: float = 0.10, near_titled: float = 0.15, title: float = 0.8) -> DataFrame:
    """Events of one article (a handful) without repeats: best first, a later one goes when too near a kept one.

    ``extracted(article_id, event_id, title, embedding, is_primary, relevance, n_facts, ordinal)``.
    """
    item = F.struct((~F.col("is_primary")).alias("p"), (-F.col("relevance")).alias("r"), (-F.col("n_facts")).alias("f"),
                    F.col("ordinal").alias("o"), "event_id", F.col("title").alias("title"), F.col("embedding").alias("v"))
    lists = extracted.groupBy("article_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def same(k: Column, x: Column) -> Column:
        d = F.lit(1.0) - F.coalesce(vectors.cosine(k["v"], x["v"]), F.lit(0.0))
        return (d < near) | ((d < near_titled) & (text.levenshtein_ratio(F.lower(k["title"]), F.lower(x["title"])) > title))

    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(
        F.concat(acc, F.array(x))))
    return lists.select("article_id", F.explode(kept).alias("x")).select("article_id", "x.event_id")


def extract_entities(articles: DataFrame, id_col: str, c: str, top: int = 15) -> DataFrame:
    """Names found by pattern: company suffixes, two or three capitalised words, tickers; the most mentioned ``top``."""
    kinds = [
        (r"([A-Z][a-zA-Z0-9\s]+\s+(?:Inc\.?|Corp\.?|Corporation|Company|Ltd\.?|Limited))", "ORGANIZATION", 0.7),
        (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})", "PERSON", 0.6),
        (r"(\$[A-Z]{2,6})", "FINANCIAL_ASSET", 0.95),
    ]

    def labelled(pattern: str, kind: str, confidence: float) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda n: F.struct(
            F.trim(n).alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    found = F.concat(*[labelled(*k) for k in kinds])
    rows = articles.select(id_col, F.explode(found).alias("e")).select(id_col, "e.*")
    counts = rows.groupBy(id_col, "name").agg(F.count("*").alias("mentions"), F.min("type").alias("type"), F.max("confidence").alias("confidence"))
    return top_k(counts, [id_col], [F.desc("mentions"), F.asc("name")], top)
