"""Score columns: headline score, triage adjustments, decay and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col, nz

HEADLINE_THRESHOLD = 0.60

# Feed tags that mark an important entry.
IMPORTANT_TAGS = (
    "breaking breaking-news top-story top-stories featured exclusive developing urgent lead "
    "front-page homepage editors-pick editor-pick editors-picks "
    "destaque manchete urgente exclusivo capa principal plantao plantão últimas"
).split()


def authority01(authority) -> Column:
    return F.coalesce(F.least(col(authority), F.lit(10.0)) / 10.0, F.lit(0.0))


def position_score(index, curated) -> Column:
    i = col(index)
    return F.when(col(curated), F.greatest(1.0 - i * 0.15, F.lit(0.2))).otherwise(
        F.greatest(1.0 - i * 0.05, F.lit(0.3))
    )


def feed_signals(index, curated, tags: Column, slash_comments, thr_total) -> Column:
    """Half position, then category tags, then reader comments."""
    terms = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))
    category = F.arrays_overlap(terms, F.array(*[F.lit(t) for t in IMPORTANT_TAGS])).cast("double")
    comments = F.greatest(
        F.coalesce(F.expr(f"try_cast({slash_comments} AS int)"), F.lit(0)),
        F.coalesce(F.expr(f"try_cast({thr_total} AS int)"), F.lit(0)),
    )
    engagement = F.least(comments / 50.0, F.lit(1.0))
    return position_score(index, curated) * 0.50 + F.coalesce(category, F.lit(0.0)) * 0.35 + engagement * 0.15


def api_signals(top_headline, position) -> Column:
    factor = F.greatest(1.0 - col(position) * 0.03, F.lit(0.7))
    return F.when(col(top_headline), F.least(F.lit(1.0), factor * 0.85 + 0.15)).otherwise(F.lit(0.30))


def centrality(n) -> Column:
    return F.least(F.log2(col(n) + 1) / 3.0, F.lit(1.0))


def headline_score(authority, central, signals, burst, cluster_size, market_feeds) -> Column:
    """Weighted signals with a boost for markets of few feeds and a floor for elite exclusives."""
    a, m = col(authority), col(market_feeds)
    c = F.when(m < 12, F.least(col(central) * (12.0 / F.greatest(m, F.lit(3))), F.lit(1.0))).otherwise(col(central))
    score = a * 0.25 + c * 0.40 + col(signals) * 0.20 + col(burst) * 0.15
    elite = (a > 0.90) & (col(cluster_size) == 1) & (col(signals) > 0.6)
    return F.least(F.when(elite, F.greatest(score, F.lit(0.60))).otherwise(score), F.lit(1.0))


def time_decay(published_at, as_of) -> Column:
    age = as_of.cast("double") - col(published_at).cast("double")
    return (
        F.when(age <= 6 * 3600, 1.0).when(age <= 12 * 3600, 0.9)
        .when(age <= 24 * 3600, 0.75).when(age <= 48 * 3600, 0.5).otherwise(0.25)
    )


def effective_score(score, authority) -> Column:
    fallback = F.greatest(F.lit(0.0), F.least(F.coalesce(col(authority), F.lit(1.0)), F.lit(10.0))) / 10.0 * 0.7
    return F.when(col(score) > 0, col(score)).otherwise(fallback)


def title_quality(title) -> Column:
    """Sum of six title rules, held between -0.10 and 0.08."""
    t = nz(title)

    def rule(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    figures = t.rlike(r"(?i)\d+%|\$[\d.]+[BMK]?|R\$\s?[\d.,]+|\d+\s*(million|billion|milhão|bilhão)")
    name = r"(?<![\p{L}\p{N}_])[A-Z][a-záéíóúãõç]+(?:\s[A-Z][a-záéíóúãõç]+)*"
    total = (
        rule(figures, 0.05)
        + rule(F.regexp_count(t, F.lit(name)) >= 2, 0.03)
        + rule(t.rlike(r"\?\s*$"), -0.03)
        + rule(t.rlike(r"(?<![\p{L}\p{N}_])[A-Z]{5,}(?![\p{L}\p{N}_])"), -0.05)
        + rule(F.length(t) < 25, -0.05)
        + rule(t.rlike(r"(?i)^\d+\s+(coisas|dicas|fatos|razões|things|tips|ways|reasons)(?![\p{L}\p{N}_])"), -0.03)
    )
    return F.when(t == "", F.lit(-0.05)).otherwise(F.greatest(F.lit(-0.10), F.least(F.lit(0.08), total)))


def volume_penalty(accepted_24h, soft: int = 10, hard: int = 25, rate: float = 0.02) -> Column:
    """0 up to the soft cap, then a falling penalty; -1 at the hard cap."""
    n = F.coalesce(col(accepted_24h), F.lit(0))
    return F.when(n >= hard, F.lit(-1.0)).when(n > soft, -((n - soft) * rate)).otherwise(F.lit(0.0))


def topic_adjustment(accepted_today) -> Column:
    n = F.coalesce(col(accepted_today), F.lit(0))
    return F.when(n < 5, F.lit(0.10)).when(n > 30, F.lit(-0.05)).otherwise(F.lit(0.0))


def authority_label(authority) -> Column:
    a = F.coalesce(col(authority), F.lit(0.0))
    return (
        F.when(a >= 8, "major/authoritative").when(a >= 6, "established")
        .when(a >= 4, "mid-tier").otherwise("minor/unknown")
    )


def time_ago(age_s) -> Column:
    s = col(age_s)
    return (
        F.when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" minutes ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" days ago")))
    )
