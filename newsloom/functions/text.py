"""Text columns: tokens, hashes, cleaning, metrics. Everything stays inside code generation."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word characters; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"

# Words ignored by feed keywords.
KEYWORD_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "de", "da", "do", "dos", "das",
    "em", "no", "na", "um", "uma", "que", "com", "para", "por", "sobre", "como",
]

# Endings that mark a teaser body.
TRUNCATION_MARKERS = [
    "...", "…", "[...]", "[…]", "read more", "continue reading", "leia mais",
    "continuar lendo", "continuar leyendo", "ler mais",
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """Null text as empty text."""
    return F.coalesce(col(c), F.lit(""))


def word_count(c) -> Column:
    return F.regexp_count(nz(c), F.lit(WORD)).cast("bigint")


def tokens(c) -> Column:
    """Lower-cased words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(nz(c)), F.lit(f"({WORD})"), 1)


def token_set(c) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays without repeats; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both).cast("double")
    )


def title_similarity(a, b) -> Column:
    """1 for equal trimmed lower-case titles, else token-set overlap; 0 for an empty title."""
    la, lb = F.trim(F.lower(nz(a))), F.trim(F.lower(nz(b)))
    return (
        F.when((nz(a) == "") | (nz(b) == ""), F.lit(0.0))
        .when(la == lb, F.lit(1.0))
        .otherwise(jaccard(token_set(a), token_set(b)))
    )


def full_text(title, description, content) -> Column:
    return F.trim(F.concat(nz(title), F.lit(" "), nz(description), F.lit(" "), nz(content)))


def content_hash(title, description, content) -> Column:
    text = full_text(title, description, content)
    return F.when(text != "", F.md5(text))


def source_article_id(source, url) -> Column:
    return F.concat(nz(source), F.lit(":"), F.substring(F.md5(nz(url)), 1, 8))


def event_hash(headline, facts: Column) -> Column:
    """First 20 hex digits over the lower-cased headline and the first two facts."""
    key = F.lower(F.concat(nz(headline), F.array_join(F.slice(facts, 1, 2), "")))
    return F.substring(F.sha2(key, 256), 1, 20)


def read_minutes(words: Column, wpm: int = 238) -> Column:
    return F.when(words > 0, F.bround(words / F.lit(float(wpm)), 1)).otherwise(F.lit(0.5))


def strip_tags(c, gap: str = " ") -> Column:
    return F.regexp_replace(nz(c), "<[^>]+>", gap)


# Named character references come from the standard library's table of the HTML standard; those without a semicolon may be
# followed by anything, the longest name first. Numbers from 128 to 159 mean what they do in Windows-1252.
_NAMED = html5
_SHORT = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_WINDOWS = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
_REFERENCE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.map_from_arrays(F.split(F.lit("\t".join(table)), "\t"), F.split(F.lit("\x01".join(table.values())), "\x01")), key)


def _code_point(n: Column) -> Column:
    """The character of a number in a reference: null where the number is no number."""
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534)
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n.between(128, 159), F.coalesce(
        _lookup({str(k): v for k, v in _WINDOWS.items()}, n.cast("string")), plain)).when(none, "").otherwise(plain))


def _reference(p: Column) -> Column:
    """One piece of a text: a reference decoded, anything else as it is."""
    digits = F.regexp_extract(p, r"^&#([0-9]+)", 1)
    hexes = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+)", 1)
    # Longer numbers than any character's are cut to one that is out of range as well.
    number = F.when(digits != "", F.substring(F.regexp_replace(digits, "^0+(?=[0-9])", ""), 1, 9).cast("long")).otherwise(
        F.conv(F.substring(F.regexp_replace(hexes, "^0+(?=.)", ""), 1, 8), 16, 10).cast("long"))
    name = F.substring(p, 2, 100)
    short = F.regexp_extract(p, "^&(" + "|".join(_SHORT) + ")", 1)
    named = F.coalesce(_lookup(_NAMED, name), F.when(short != "", F.concat(_lookup(_NAMED, short), F.substring(p, F.length(short) + 2, F.length(p)))), p)
    return F.when(F.startswith(p, F.lit("&#")) & (F.length(p) > 2), _code_point(number)).when(F.startswith(p, F.lit("&")) & (F.length(p) > 1), named).otherwise(p)


def unescape(c) -> Column:
    """Character references decoded, named ones by table and numeric ones by code point; a text without one is passed by."""
    pieces = F.transform(F.regexp_extract_all(nz(c), F.lit(_REFERENCE), 0), _reference)
    return F.when(F.contains(nz(c), F.lit("&")), F.array_join(pieces, "")).otherwise(nz(c))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(nz(c), r"[\s ]+", " "))


def strip_html(c) -> Column:
    """Plain text of an HTML fragment: tags out, entities decoded, blanks collapsed."""
    return squeeze(unescape(strip_tags(c)))


def canonical_entity(c) -> Column:
    kept = F.regexp_replace(F.trim(F.lower(nz(c))), r"[^\p{L}\p{N}_\s$.\-]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def keywords(title, description, limit: int = 10) -> Column:
    """Distinct lower-case words of 3 to 15 letters that are no stop words, in alphabetical order."""
    text = F.lower(F.concat(nz(title), F.lit(" "), nz(description)))
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    good = F.filter(found, lambda w: w.rlike("^[a-zA-ZÀ-ú]{3,15}$"))
    kept = F.array_except(good, F.array(*[F.lit(w) for w in KEYWORD_STOPWORDS]))
    return F.slice(F.array_sort(kept), 1, limit)


def description_or_lead(description, content, max_chars: int = 500) -> Column:
    """The given description, else the first two sentences of a body longer than 30 characters."""
    text = F.trim(F.regexp_replace(strip_tags(content, ""), r"\s+", " "))
    lead = F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 2), " ")
    return F.when(nz(description) != "", col(description)).when(
        F.length(text) > 30, F.substring(lead, 1, max_chars)
    ).otherwise(F.lit(""))


def looks_truncated(content) -> Column:
    """The visible text of the last 120 characters ends in a teaser marker."""
    bare = strip_tags(content, "")
    tail = F.lower(F.trim(F.substring(bare, -120, 120)))
    tail = F.regexp_replace(tail, r"^\s+|\s+$", "")
    hit = F.lit(False)
    for m in TRUNCATION_MARKERS:
        hit = hit | F.endswith(tail, F.lit(m))
    return hit


def has_paragraphs(content) -> Column:
    c = nz(content)
    tags = F.regexp_count(c, F.lit(r"(?i)<p[\s>]"))
    breaks = F.regexp_count(c, F.lit("\n\n"))
    return (tags >= 2) | (breaks >= 2)


def text_ratio(content) -> Column:
    c = nz(content)
    bare = F.regexp_replace(strip_tags(c, ""), r"^\s+|\s+$", "")
    return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.length(bare) / F.length(c).cast("double"))


def body_usable(content, words: Column, min_words: int = 500, min_ratio: float = 0.3) -> Column:
    return (
        (words >= min_words)
        & ~looks_truncated(content)
        & has_paragraphs(content)
        & (text_ratio(content) >= min_ratio)
    )


def contains_any(c, needles: list[str]) -> Column:
    """Whether the text holds one of a fixed, short list of substrings."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(nz(c), F.lit(n))
    return hit


def count_any(c, needles: list[str]) -> Column:
    """How many of the listed substrings occur at least once."""
    total = F.lit(0)
    for n in needles:
        total = total + F.contains(nz(c), F.lit(n)).cast("int")
    return total


def levenshtein_ratio(a, b) -> Column:
    longest = F.greatest(F.length(nz(a)), F.length(nz(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(nz(a), nz(b)) / longest.cast("double")
    )


def syllables(c) -> Column:
    """Vowel groups; a documented stand-in for a syllable dictionary."""
    return F.regexp_count(F.lower(nz(c)), F.lit("[aeiouyáàâãäåéèêëíìîïóòôõöúùûü]+")).cast("bigint")


def sentence_count(c) -> Column:
    return F.greatest(F.regexp_count(nz(c), F.lit(r"[.!?]+")).cast("bigint"), F.lit(1))


def flesch(c) -> Column:
    """Reading ease from words, sentences and vowel groups; null for a text without words."""
    w, s, y = word_count(c), sentence_count(c), syllables(c)
    return F.when(w > 0, F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (y / w))


# Blocks of characters counted as Chinese, Japanese or Korean, and the bands of their share.
CJK = ("[\\x{2E80}-\\x{2EFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{3100}-\\x{312F}\\x{3200}-\\x{32FF}\\x{3400}-\\x{4DBF}"
       "\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2F800}-\\x{2FA1F}]")
CJK_BANDS = [(0.8, 3.6), (0.5, 3.0), (0.2, 1.5)]


def cjk_ratio(c) -> Column:
    """Share of such characters in the whole text; null for an empty one."""
    return F.regexp_count(c, F.lit(CJK)) / F.nullif(F.length(c), F.lit(0))


def cjk_multiplier(ratio: Column) -> Column:
    out = F.lit(1.0)
    for least, value in reversed(CJK_BANDS):
        out = F.when(ratio >= least, value).otherwise(out)
    return out


def whole_sentences(c, limit: int) -> Column:
    """The first sentences of a text that together, joined by blanks, have at most ``limit`` characters."""
    parts = F.split(c, r"(?<=[.!?])\s+")
    state = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("bigint").alias("run"))
    fold = F.aggregate(parts, state, lambda a, p: F.struct(
        (a["n"] + F.when(a["run"] + 1 + F.length(p) <= limit, 1).otherwise(0)).alias("n"), (a["run"] + 1 + F.length(p)).alias("run")))
    return F.slice(parts, F.lit(1), fold["n"])
