"""Page jobs over rows of parsed nodes: blocks, cleaning, container scores, complexity, block choice."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text
from newsloom.functions.stopwords import ENGLISH
from newsloom.operators.ranking import latest_by

# Elements that never hold the article, and class or id words that speak against a block.
DROP_TAGS = ["script", "style", "noscript", "link", "meta", "template", "iframe", "object", "embed", "form", "input", "button",
             "select", "textarea", "label", "fieldset", "nav", "header", "footer", "aside", "svg", "head", "title"]
AGAINST = (
    "advertisement|breadcrumb|combx|comment|contact|disqus|footer|mod-conversations|promo|related|scroll|share|shoutbox|sidebar|"
    "social|sponsor|subscribe|tags|toolbox|widget|_ad$|navigation|nav-|menu-|newsletter|popup|paywall|cookie|gdpr|consent|recirc|"
    "recommended|trending|read-more|read-next|read-also|hide-on-print"
)
NEVER = "instapaper_ignore|skip-to-content|visually-hidden|sr-only"
FOR = "article|body|content|entry|hentry|main|page|post|text|blog|story"
# Heading elements, sources of tracking pixels, promotional phrases, and signs of advertising or portraits.
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
TRACKERS = ["pixel", "tracking", "beacon", "/1x1.", "doubleclick", "googletagmanager"]
PROMO = ["click here", "learn more", "read more", "subscribe", "follow us", "share this", "advertisement", "sponsored"]
AD_IMAGE = ["ad", "logo", "banner", "promo", "sponsor"]
AD_DOMAINS = ["doubleclick", "googleadservices", "googlesyndication", "facebook.com/tr", "google-analytics", "googletagmanager",
              "scorecardresearch", "quantserve", "outbrain", "taboola"]
AD_ALT = ["advertisement", "sponsored", "promo", "ad ", "banner"]
PORTRAITS = ["headshot", "profile", "avatar", "author", "byline", "contributor"]


# --- the tree as intervals: a page's nodes are numbered, and those below an element are a run of numbers ---


def _in_order() -> W:
    return W.partitionBy("page_id").orderBy("seq")


def under(which: Column) -> Column:
    """Whether a node is one of these elements or below one: intervals nest, so the farthest end so far tells."""
    return F.coalesce(F.max(F.when(which, F.col("last"))).over(_in_order().rowsBetween(W.unboundedPreceding, 0)) >= F.col("seq"), F.lit(False))


def outermost(which: Column) -> Column:
    """``(seq, tag)`` of the outermost of these elements around a node, itself included; null when there is none."""
    far = F.max(F.when(which, F.struct("last", (-F.col("seq")).alias("s"), "tag"))).over(_in_order().rowsBetween(W.unboundedPreceding, 0))
    return F.when(far["last"] >= F.col("seq"), F.struct((-far["s"]).alias("seq"), far["tag"].alias("tag")))


def _at_ends(rows: DataFrame) -> DataFrame:
    """Every node twice where others lie below it: where it opens, as ``(page_id, seq, at = 0)`` alone with what ``opens`` holds, and with
    all its columns where it ends (``at`` = 1); a node without others below it once, with ``at`` = 2. Needs a column ``opens``.

    Rows stay in their page's partition, so that what is known at a node's end is read by a window, without a join.
    """
    kept = rows.drop("page_id", "opens")
    whole, none = F.struct(*kept.columns), F.lit(None).cast(kept.schema)
    more = F.col("last") > F.col("seq")
    events = F.when(more, F.array(
        F.struct(F.col("seq").alias("key"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.col("opens").alias("given"), none.alias("node")),
        F.struct(F.col("last").alias("key"), F.lit(1).alias("at"), (-F.col("seq")).alias("depth"), F.col("opens").alias("given"), whole.alias("node")))).otherwise(F.array(
            F.struct(F.col("seq").alias("key"), F.lit(2).alias("at"), F.lit(0).alias("depth"), F.col("opens").alias("given"), whole.alias("node"))))
    # a node without others below it comes before the ends at its place
    order = F.when(F.col("e.at") == 1, 1).otherwise(0)
    return rows.select("page_id", F.explode(events).alias("e")).select("page_id", "e.key", "e.at", order.alias("closes"), "e.depth", "e.given", "e.node")


def _by_end() -> W:
    return W.partitionBy("page_id").orderBy("key", "closes", "depth")


def below(nodes: DataFrame, **values: Column) -> DataFrame:
    """Adds, per node, sums of values over it and all nodes below it: a difference of prefix sums at the interval's ends."""
    upto = _in_order().rowsBetween(W.unboundedPreceding, 0)
    run = nodes.withColumns({f"_v_{k}": v for k, v in values.items()})
    run = run.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(upto) for k in values})
    events = _at_ends(run.withColumn("opens", F.struct(*[F.col(f"_v_{k}").alias(k) for k in values])))
    so_far = _by_end().rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumns({f"_e_{k}": F.sum(F.when(F.col("at") != 1, F.col(f"given.{k}"))).over(so_far) for k in values}).filter("at > 0")
    return events.select("page_id", *[F.col(f"node.{c}").alias(c) for c in nodes.columns if c != "page_id"], *[
        (F.col(f"_e_{k}") - F.col(f"node._s_{k}") + F.col(f"node._v_{k}")).alias(k) for k in values]).select(*nodes.columns, *values)


def blocks(nodes: DataFrame) -> DataFrame:
    """``(page_id, position, type, content, src, width, height)``: headings, paragraphs, quotes, list items, images.

    A text node belongs to the outermost quote or list around it, else to its innermost heading or paragraph.
    Grouping is by (page, block), so a task never holds more than one block's pieces.
    """
    marked = nodes.select("*", under(F.col("tag").isin(DROP_TAGS)).alias("dropped"), outermost(F.col("tag").isin("blockquote", "ul", "ol")).alias("group"))
    tracker = text.contains_any(F.lower("src"), TRACKERS) | ((F.col("width") > 0) & (F.col("width") <= 2) & (F.col("height") <= 2))
    image = (F.col("tag") == "img") & (F.col("src") != "") & ~tracker
    own, tag = F.coalesce("group.seq", "prose"), F.coalesce("group.tag", "prose_tag")
    kind = F.when(tag == "blockquote", "quote").when(tag.isin("ul", "ol"), "list").when(tag == "p", "paragraph").otherwise("heading")
    # an image is a block of its own
    pieces = marked.filter("not dropped").select(
        "page_id", "seq", F.when(F.col("kind") == "text", own).when(image, F.col("seq")).alias("own"), F.when(F.col("kind") == "text", kind).otherwise("image").alias("type"),
        "body", F.struct("src", "width", "height").alias("image")).filter("own IS NOT NULL")
    said = pieces.groupBy("page_id", "own", "type").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("parts"), F.min("image").alias("image"))
    of_image = F.col("type") == "image"
    content = F.when(of_image, F.col("parts")[0]["body"]).otherwise(text.squeeze(F.array_join(F.transform("parts", lambda p: p["body"]), " ")))
    both = said.select("page_id", "seq", "type", content.alias("content"), F.when(of_image, F.col("image.src")).otherwise("").alias("src"),
                       *[F.when(of_image, F.col(f"image.{k}")).otherwise(0).alias(k) for k in ("width", "height")]).filter((F.col("type") == "image") | (F.col("content") != ""))
    place = F.row_number().over(W.partitionBy("page_id").orderBy("seq")) - 1  # one page's blocks
    return both.withColumn("position", place).drop("seq")


def keep_block(kind: Column, content: Column, alt: Column, src: Column, width: Column, height: Column) -> Column:
    """False for short or promotional paragraphs and for advertising or tiny images."""
    low = F.lower(content)
    short = F.length(F.trim(low)) < 20
    promo = text.contains_any(low, PROMO) & (F.length(low) < 100)
    ad = text.contains_any(F.lower(alt), AD_IMAGE) | text.contains_any(F.lower(src), AD_IMAGE)
    tiny = (width > 0) & (height > 0) & ((width < 100) | (height < 100))
    return F.when(kind == "paragraph", ~short & ~promo).when(kind == "image", ~ad & ~tiny).otherwise(F.lit(True))


def keep_media(kind: Column, src: Column, alt: Column, width: Column, height: Column) -> Column:
    """False for tracking pixels, advertising domains and advertising captions."""
    low = F.lower(src)
    image = ~((width == 1) & (height == 1)) & ~text.contains_any(low, AD_DOMAINS) & ~text.contains_any(F.lower(alt), AD_ALT)
    video = ~text.contains_any(low, ["doubleclick", "googlevideo", "youtube.com/ads"])
    return F.when(kind == "image", image).when(kind.isin("video", "video_embed"), video).otherwise(F.lit(True))


def _named(pattern: str) -> Column:
    """Whether an element's class or id matches."""
    return F.col("class").rlike("(?i)" + pattern) | F.col("name").rlike("(?i)" + pattern)


def _text_below(nodes: DataFrame, gone: Column) -> DataFrame:
    """Adds ``chars``, ``link_chars``, ``n_p`` (paragraphs with text) and ``guarded`` (text inside an article) of what is not ``gone``; ``said`` is a text's length."""
    flagged = nodes.select("*", gone.alias("gone"), under(F.col("tag") == "a").alias("linked"), under(F.col("tag").isin("article", "main")).alias("in_article"))
    alive = (F.col("kind") == "text") & ~F.col("gone")
    n = F.when(alive, F.col("said")).otherwise(0)
    # a paragraph cannot hold another, so their numbers rise in document order
    in_p = F.when(alive & (F.col("prose_tag") == "p"), F.col("prose"))
    flagged = flagged.withColumn("in_p", in_p).withColumn("before_p", F.max("in_p").over(_in_order().rowsBetween(W.unboundedPreceding, -1)))
    opens = F.coalesce(F.col("in_p") > F.coalesce("before_p", F.lit(-1)), F.lit(False))
    flagged = flagged.withColumn("opens_p", opens.cast("int")).drop("in_p", "before_p")
    out = below(flagged, chars=n, link_chars=F.when(F.col("linked"), n).otherwise(0), n_p=F.col("opens_p"), guarded=F.when(F.col("in_article"), n).otherwise(0))
    return out.drop("linked", "in_article", "opens_p")


def _cleaned(nodes: DataFrame, *more: Column | str) -> DataFrame:
    """What cleaning reads of a node, patterns looked for and texts measured before rows are dealt by page."""
    element = F.col("kind") == "element"
    return nodes.select("page_id", "seq", "last", "kind", "tag", "prose", "prose_tag", F.when(F.col("kind") == "text", F.length(F.trim("body"))).otherwise(0).alias("said"),
                        (element & _named(NEVER)).alias("never"), (element & _named(AGAINST)).alias("doubted"), *more)


def _clean_marks(e: DataFrame, link_density: float, min_link_text: int) -> DataFrame:
    """Rows of ``_cleaned`` with the reasons for which a node goes by itself, and whether it is ``gone`` with them."""
    unwanted = F.col("tag").isin(DROP_TAGS)
    e = _text_below(e, under(unwanted))
    prose = (F.col("chars") >= 200) & (F.col("n_p") >= 2)
    guarded = F.col("guarded") > 0
    against = (F.col("kind") == "element") & (F.col("chars") > 0) & (F.col("never") | (F.col("doubted") & ~F.col("tag").isin("article", "main") & ~guarded & ~prose))
    e = e.withColumn("against", against).drop("chars", "link_chars", "n_p", "guarded", "never", "doubted")
    e = _text_below(e.withColumnRenamed("gone", "gone_before"), F.col("gone_before") | under(F.col("against")))
    links = F.col("tag").isin("div", "section", "ul", "ol") & (F.col("chars") >= min_link_text) & (F.col("link_chars") / F.col("chars") >= link_density)
    e = e.withColumn("links", F.coalesce(links, F.lit(False)))
    e = e.withColumn("gone", F.col("gone") | under(F.col("links")))
    reasons = {"tag": unwanted, "comment": F.col("kind") == "comment", "mark": F.col("against"), "links": F.col("links")}
    return e.withColumns({f"by_{k}": v for k, v in reasons.items()})


REASONS = ("tag", "comment", "mark", "links")


def clean(nodes: DataFrame, link_density: float = 0.6, min_link_text: int = 60) -> tuple[DataFrame, DataFrame]:
    """Subtractive cleaning: ``(surviving text nodes, removals(page_id, reason, n))``.

    Unwanted tags and comments first, then elements whose class or id speaks against them (unless they hold an
    article, or real prose), then link lists. Nothing leaves the table before the end: what goes is flagged.
    """
    e = _clean_marks(_cleaned(nodes, "body"), link_density, min_link_text)
    reason = F.explode(F.array_compact(F.array(*[F.when(F.col(f"by_{k}"), k) for k in REASONS])))
    counts = e.select("page_id", reason.alias("reason")).groupBy("page_id", "reason").agg(F.count("*").alias("n"))
    return e.filter("kind = 'text' AND NOT gone").select("page_id", "seq", "body"), counts


def clean_counts(nodes: DataFrame, link_density: float = 0.6, min_link_text: int = 60) -> DataFrame:
    """``(page_id, kept_chars, removed_tag, removed_comment, removed_mark, removed_links)`` of ``clean``: rows are dealt by page once, without their texts."""
    e = _clean_marks(_cleaned(nodes, F.length("body").alias("chars_whole")), link_density, min_link_text)
    kept = F.sum(F.when((F.col("kind") == "text") & ~F.col("gone"), F.col("chars_whole")).otherwise(0)).alias("kept_chars")
    return e.groupBy("page_id").agg(kept, *[F.count_if(F.col(f"by_{k}")).alias(f"removed_{k}") for k in REASONS])


def best_container(nodes: DataFrame, power: float = 1.25, min_chars: int = 20) -> DataFrame:
    """``(page_id, id, tag, score)``: the container whose direct and inner text scores highest. A score is multiplied for
    scripts that say more in fewer characters, by the share of such characters in the container's text.

    Every text node of 20 or more characters gives length^1.25 to each container around it, times a multiplier
    for what the containers on its path are called: the sum of their weights, which is what has opened so far less what has closed.
    """
    w = F.lit(0.0)
    for name in ("class", "name"):  # class and id count one by one
        w = w + F.when(F.col(name).rlike("(?i)" + FOR), 0.5).otherwise(0.0) - F.when(F.col(name).rlike("(?i)" + AGAINST), 0.75).otherwise(0.0)
    w = w + F.when(F.col("tag").isin("article", "main"), 0.75).otherwise(0.0)
    w = w - F.when(F.col("tag").isin("nav", "aside", "header", "footer"), 0.75).otherwise(0.0)
    ok = (F.col("kind") == "text") & (F.length("body") >= min_chars)
    n = F.when(ok, F.length("body")).otherwise(0)
    rows = nodes.select("page_id", "seq", "last", "tag", n.alias("n"), F.when(ok, F.regexp_count("body", F.lit(text.CJK))).otherwise(0).alias("dense"),
                        F.when(F.col("kind") == "element", w).otherwise(0.0).alias("w"))
    # What a node adds counts until it ends; at its own end, what was added inside has been taken back.
    events = _at_ends(rows.withColumn("opens", F.col("w")))
    step = F.when(F.col("at") == 0, F.col("given")).when(F.col("at") == 1, -F.col("given")).otherwise(0.0)
    around = F.coalesce(F.sum("step").over(_by_end().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + F.when(F.col("at") == 2, F.col("given")).otherwise(0.0)
    rows = events.withColumn("step", step).withColumn("mult", F.greatest(F.lit(0.1), 1.0 + around)).filter("at > 0").select(
        "page_id", *[F.col(f"node.{c}").alias(c) for c in rows.columns if c != "page_id"], "mult")
    # Exact sums, so that a difference of prefix sums is what the sum of the parts would be.
    said = F.pow(F.col("n").cast("double"), F.lit(power)).cast("decimal(24,6)")
    boxes = below(rows, said=said, all_n=F.col("n"), all_dense=F.col("dense")).filter(F.col("tag").isin("div", "section", "article", "main", "td") & (F.col("all_n") > 0))
    score = F.col("said").cast("double") * F.col("mult") * text.cjk_multiplier(F.col("all_dense") / F.col("all_n"))
    scored = boxes.select("page_id", F.col("seq").alias("id"), "tag", score.alias("score"))
    return latest_by(scored, ["page_id"], ["score", "id"]).select("page_id", "id", "tag", "score")


# --- complexity and choice -----------------------------------------------------------------

# Feature weights and patterns of the page complexity score.
WEIGHTS = {"paywall": 0.25, "layout": 0.20, "media": 0.15, "dynamic": 0.15, "noise": 0.15, "source": 0.10}
PAYWALL_PATTERNS = ["subscription.*required", "premium.*content", "subscriber.*only", "continue.*reading", "unlock.*full.*article",
                    "sign.*in.*to.*read", "become.*a.*member"]
CUT_PATTERNS = [r"\.{3,}", "read.*more", "continue.*below", r"\[.*continued.*\]"]
FRAMEWORKS = ["react", "angular", "vue", "ember", "backbone", "knockout", "jquery"]
LOADERS = ["data-.*url", "lazy.*load", "infinite.*scroll", "load.*more", "ajax"]
#: Tags (any, if none) and class words of elements, how many are needed at least, and what they add.
LAYOUT_RULES = [([], "grid|flex|column", 6, 0.3), (["section", "article", "div"], "content|article|main", 4, 0.2), (["aside", "div"], "sidebar|aside|related", 3, 0.2),
                (["nav", "div"], "nav|menu|breadcrumb", 4, 0.1), ([], "modal|overlay|popup|lightbox", 1, 0.2)]
EMBEDS = ["iframe", "video", "embed", "object"]
SOCIAL = [r"twitter\.com", r"instagram\.com", r"facebook\.com", r"youtube\.com", r"vimeo\.com", r"tiktok\.com"]
ACTIVE = "interactive|chart|graph|widget"
NOISE_TAGS = ["nav", "header", "footer"]
NOISE_CLASSES = ["ad|advertisement|banner|promo", "social|share|follow", "comment|discussion"]


def _element_features(nodes: DataFrame) -> DataFrame:
    """Per page: what its elements say about layout, media, scripts, empty containers and noise."""
    hidden = under(F.col("tag").isin("script", "style", "template"))
    n = F.when((F.col("kind") == "text") & ~F.col("hidden"), F.col("size")).otherwise(0)
    # patterns are looked for and texts measured before rows are dealt by page
    patterns = list(dict.fromkeys([*[w for _, w, _, _ in LAYOUT_RULES], *NOISE_CLASSES, ACTIVE, "content|article|main"]))
    slim = nodes.select("page_id", "seq", "last", "kind", "tag", F.length(F.regexp_replace("body", r"^[\s\u00a0]+|[\s\u00a0]+$", "")).alias("size"),
                        F.col("src").rlike("(?i)" + "|".join(SOCIAL)).alias("to_social"), *[F.col("class").rlike("(?i)" + p).alias(f"called{k}") for k, p in enumerate(patterns)])
    e = below(slim.withColumn("hidden", hidden).withColumn("n", n).drop("size"), chars=F.col("n"))
    tag, on = F.col("tag"), F.col("kind") == "element"

    def called(words: str) -> Column:
        return F.col(f"called{patterns.index(words)}")

    layout = [F.count_if(on & called(words) & (tag.isin(tags) if tags else F.lit(True))).alias(f"layout{k}") for k, (tags, words, _, _) in enumerate(LAYOUT_RULES)]
    noise = F.when(tag.isin(NOISE_TAGS), F.col("chars")).otherwise(0)
    for words in NOISE_CLASSES:
        noise = noise + F.when(called(words), F.col("chars")).otherwise(0)
    return e.groupBy("page_id").agg(
        *layout, F.count_if(tag.isin(EMBEDS)).alias("embeds"), F.count_if((tag == "iframe") & F.col("to_social")).alias("social"),
        F.count_if(on & called(ACTIVE)).alias("active"), F.count_if(tag == "script").alias("scripts"),
        F.count_if(tag.isin("div", "section") & called("content|article|main") & (F.col("chars") < 50)).alias("empty"),
        F.sum("n").alias("shown"), F.sum(F.when(on, noise).otherwise(0)).alias("noise"))


def complexity(pages: DataFrame, nodes: DataFrame, complex_sources: list[str], simple_sources: list[str]) -> DataFrame:
    """``(page_id, paywall, layout, media, dynamic, noise, source)``: six features in [0, 1].

    ``pages(page_id, html, source, paywalled, signs)``: ``paywalled`` is the stored flag, ``signs`` the number of stored indicators.
    Patterns are looked for in the page's source, everything else is counted per element.
    """
    low, one, zero = F.lower("html"), F.lit(1.0), F.lit(0)

    def hits(patterns: list[str], value: float) -> Column:
        total = F.lit(0.0)
        for p in patterns:
            total = total + F.when(low.rlike(p), value).otherwise(0.0)
        return total

    def some(c: str) -> Column:
        return F.coalesce(F.col(c), zero)

    flag = F.when(F.col("paywalled"), 0.4 + F.least(F.lit(0.3), some("signs") * 0.1)).otherwise(0.0)
    layout = F.lit(0.0)
    for k, (_, _, least, value) in enumerate(LAYOUT_RULES):
        layout = layout + F.when(some(f"layout{k}") >= least, value).otherwise(0.0)
    scripts = F.when(some("scripts") > 10, 0.3).when(some("scripts") > 5, 0.2).otherwise(0.0)
    name = F.lower(F.coalesce("source", F.lit("")))
    # what a page's source says is known before the join, which no source goes through
    said = pages.select("page_id", "source", F.least(one, flag + hits(PAYWALL_PATTERNS, 0.1) + hits(CUT_PATTERNS, 0.05)).alias("paywall"),
                        hits(FRAMEWORKS, 0.1).alias("frameworks"), hits(LOADERS, 0.05).alias("loaders"))
    return said.join(_element_features(nodes), "page_id", "left").select(
        "page_id", "paywall", F.least(one, layout).alias("layout"),
        F.least(one, F.least(F.lit(0.4), some("embeds") * 0.1) + some("social") * 0.1 + F.least(F.lit(0.3), some("active") * 0.1)).alias("media"),
        F.least(one, scripts + F.col("frameworks") + F.col("loaders") + F.when(some("empty") > 2, 0.2).otherwise(0.0)).alias("dynamic"),
        F.when(some("shown") == 0, 1.0).otherwise(F.least(one, some("noise") / some("shown"))).alias("noise"),
        F.when(text.contains_any(name, complex_sources), 0.8).when(text.contains_any(name, simple_sources), 0.2).otherwise(0.5).alias("source"))


def route(score: Column, model: float = 0.6, hybrid: float = 0.8) -> Column:
    return F.when(score >= hybrid, "hybrid").when(score >= model, "llm_enhanced").otherwise("algorithmic")


def block_score(kind: Column, position: Column, total: Column) -> Column:
    """Importance by block type and place in the page."""
    base = (F.when(kind == "subtitle", 10.0).when(kind == "heading", 8.0).when(kind == "quote", 7.0).when(kind == "list", 5.0)
            .when(kind == "image", 4.0).when(kind == "divider", 1.0).otherwise(3.0))
    bonus = (F.when(position <= 3, 3.0).when(position >= total - 3, 2.0).when(position <= total * 0.1, 1.0)
             .when(position >= total * 0.9, 1.0).otherwise(0.0))
    return base + bonus


def with_density(blocks_: DataFrame, stop_words: list[str] = ENGLISH) -> DataFrame:
    """Blocks without their content, and ``density``: five times the mean TF-IDF weight of a block's terms among its page's blocks.

    Weights have unit length per block; terms that every block of the page has weigh nothing and do not count: null where no term is left.
    Rows are dealt by page once, as lists of words, and counted there.
    """
    kept = [c for c in blocks_.columns if c not in ("page_id", "position", "content")]
    words = F.filter(text.tokens("content"), lambda w: F.length(w).between(2, 15) & ~w.isin(stop_words))
    rows = blocks_.select("page_id", "position", *kept, words.alias("_words")).withColumn("_blocks", F.count("*").over(W.partitionBy("page_id")))
    tf = rows.select("page_id", "position", *kept, "_blocks", F.explode_outer("_words").alias("_w")).groupBy(
        "page_id", "position", *kept, "_blocks", "_w").agg(F.count("*").alias("_tf"))
    x = F.when(F.col("_w").isNotNull(), F.col("_tf") * F.log2(F.col("_blocks") / F.col("_df")))
    x = tf.withColumn("_df", F.count("*").over(W.partitionBy("page_id", "_w"))).withColumn("_x", x).withColumn("_x", F.when(F.col("_x") > 0, F.col("_x")))
    unit = F.when(F.count("_x") > 0, F.sum("_x") / F.sqrt(F.sum(F.col("_x") * F.col("_x"))) / F.count("_x"))
    return x.groupBy("page_id", "position", *kept).agg((unit * 5.0).alias("density"))


def choose_blocks(scored: DataFrame, budget: int) -> DataFrame:
    """``(page_id, position)`` of the blocks kept: headings first, then by score, skipping what does not fit, until
    four fifths of the budget are full. One page's blocks are folded in an array."""
    order = F.struct((-F.col("score")).alias("s"), F.col("position").alias("p"), (F.col("type").isin("subtitle", "heading")).alias("head"), F.col("chars").alias("n"))
    pages = scored.groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("xs"))
    state = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"))

    def take(a: Column, x: Column, may_stop: bool) -> Column:
        fits = ~a["done"] & (a["used"] + x["n"] <= budget) & ~F.array_contains(a["kept"], x["p"])
        stop = F.lit(may_stop) & (a["used"] + x["n"] > budget) & (a["used"] >= budget * 0.8) & ~F.array_contains(a["kept"], x["p"])
        return F.struct(F.when(fits, F.concat(a["kept"], F.array(x["p"]))).otherwise(a["kept"]).alias("kept"),
                        F.when(fits, a["used"] + x["n"]).otherwise(a["used"]).alias("used"), (a["done"] | stop).alias("done"))

    heads = F.aggregate(F.filter("xs", lambda x: x["head"]), state, lambda a, x: take(a, x, False))
    with_heads = pages.withColumn("h", heads)
    final = F.aggregate("xs", F.col("h"), lambda a, x: take(a, x, True))
    return with_heads.select("page_id", F.explode(final["kept"]).alias("position"))


def unique_blocks(rows: DataFrame) -> DataFrame:
    """First block of each normalised content per page, as a partial aggregate."""
    key = F.regexp_replace(F.lower(text.squeeze("content")), r"[^\p{L}\p{N} ]", "")
    firsts = rows.select("page_id", "position", key.alias("k")).filter("k <> ''").groupBy("page_id", "k").agg(F.min("position").alias("position"))
    return firsts.select("page_id", "position")


def sentence_rank(docs: DataFrame, id_col: str, c: str, ratio: float = 0.3, whole_below: int = 6,
                  stop_words: list[str] = ENGLISH) -> DataFrame:
    """``(id, sentence, score, kept)``: sentences by summed cosine to the others, stop words left out; texts of fewer
    than ``whole_below`` sentences are kept whole.

    The sum over all pairs is never formed: a unit vector's summed similarity to the rest is its product with
    the sum of all unit vectors, less one.
    """
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim by name would take the place as characters to trim
    words = F.transform(parts, lambda s: F.filter(text.tokens(s), lambda w: F.length(w).between(2, 15) & ~w.isin(stop_words)))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    schema = T.StructType([rows.schema["id"], T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def score(batches):
        for batch in batches:
            scores = pa.array([_sentence_scores(w.as_py() or []) for w in batch["words"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["id"], scores], names=["id", "scores"])

    scored = rows.mapInArrow(score, schema).withColumn("scores", F.transform("scores", lambda x: F.round(x, 6)))
    best = F.transform(F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), lambda x: x["i"])
    scored = scored.withColumn("best", F.slice(best, 1, F.greatest(F.lit(1), F.floor(F.size("scores") * F.lit(ratio))).cast("int")))
    each = scored.select(F.col("id").alias(id_col), "best", F.size("scores").alias("n_s"), F.posexplode("scores").alias("sentence", "score"))
    return each.select(id_col, "sentence", "score", ((F.col("n_s") < whole_below) | F.array_contains("best", F.col("sentence"))).alias("kept"))


def _sentence_scores(sentences: list[list[str]]) -> list[float]:
    """Summed cosine of each sentence's TF-IDF vector to the others'."""
    tf = [Counter(s) for s in sentences]
    df = Counter(w for s in tf for w in s)
    n, every, units = len(tf), Counter(), []
    for s in tf:
        x = {w: k * math.log2(n / df[w]) for w, k in s.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        units.append({w: v / length for w, v in x.items()} if length else {})
        for w, v in units[-1].items():
            every[w] += v
    return [sum(v * every[w] for w, v in u.items()) - 1.0 if u else 0.0 for u in units]


def section_budget(sections: DataFrame, id_col: str, budget: int) -> DataFrame:
    """Characters kept of each section when sections are taken by priority and then order until the budget ends."""
    before = F.coalesce(F.sum("chars").over(W.partitionBy(id_col).orderBy("priority", "ordinal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sections.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("chars"), F.lit(budget) - before)))


def first_image(blocks_: Column) -> Column:
    """Source of the first web image that is neither tiny nor a portrait; null when there is none."""
    good = F.filter(blocks_, lambda b: b["type"].isin("img", "image", "figure") & F.trim(b["src"]).rlike("^https?://")
                    & ~((b["width"] > 0) & (b["height"] > 0) & ((b["width"] < 100) | (b["height"] < 100)))
                    & ~text.contains_any(F.lower(F.coalesce(b["alt"], F.lit(""))), PORTRAITS))
    return F.trim(F.get(good, F.lit(0))["src"])


def media_flags(blocks_: Column) -> dict[str, Column]:
    kinds = {"has_images": ["img", "figure", "image"], "has_videos": ["video"], "has_audio": ["audio"]}
    every = [k for v in kinds.values() for k in v]
    flags = {name: F.exists(blocks_, _is_any(v)) for name, v in kinds.items()}
    return {**flags, "media_count": F.size(F.filter(blocks_, _is_any(every))).cast("long")}


def _is_any(kinds: list[str]):
    return lambda b: b["type"].isin(kinds)
