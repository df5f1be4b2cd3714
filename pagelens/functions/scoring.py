"""Rule tables as Column expressions: scores, problem lists, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import content_density, count_keyword

HIJACK_AT = 60
MIN_USABLE_WORDS = 150


@dataclass(frozen=True)
class Rules:
    """Thresholds and penalties of a page score. The defaults."""

    title: tuple[int, int] = (30, 60)
    title_missing: int = 15
    title_length: int = 5
    meta: tuple[int, int] = (70, 170)
    meta_missing: int = 10
    meta_short: int = 5
    meta_long: int = 5
    h1_missing: int = 15
    h1_multiple: int = 5
    min_words: int = 300
    thin: int = 10
    max_alt: int = 10
    min_links: int = 1
    no_links: int = 5
    no_canonical: int = 5
    noindex: int = 20


DEFAULT_RULES = Rules()
LEGACY_RULES = Rules(meta_short=3)


def _penalties(r: Rules, title_length, meta_length, h1, words, no_alt, internal, canonical, robots) -> list[tuple[str, Column]]:
    lo, hi = r.title
    mlo, mhi = r.meta
    return [
        ("title", F.when(title_length == 0, r.title_missing).when((title_length < lo) | (title_length > hi), r.title_length).otherwise(0)),
        ("meta", F.when(meta_length == 0, r.meta_missing).when(meta_length < mlo, r.meta_short).when(meta_length > mhi, r.meta_long).otherwise(0)),
        ("h1", F.when(h1 == 0, r.h1_missing).when(h1 > 1, r.h1_multiple).otherwise(0)),
        ("thin", F.when(words < r.min_words, r.thin).otherwise(0)),
        ("alt", F.least(no_alt, F.lit(r.max_alt))),
        ("links", F.when(internal < r.min_links, r.no_links).otherwise(0)),
        ("canonical", F.when(F.coalesce(canonical, F.lit("")) == "", r.no_canonical).otherwise(0)),
        ("noindex", F.when(F.contains(F.lower(F.coalesce(robots, F.lit(""))), F.lit("noindex")), r.noindex).otherwise(0)),
    ]


def page_score(r: Rules, *measures: Column) -> Column:
    """100 less the penalties, at least 0. measures: title length, meta length, h1 count, words, images without alt, internal links, canonical, robots."""
    return F.greatest(F.lit(0), F.lit(100) - sum((p for _, p in _penalties(r, *measures)), F.lit(0))).cast("long")


def page_problems(r: Rules, *measures: Column) -> Column:
    return F.array_compact(F.array(*[F.when(p > 0, n) for n, p in _penalties(r, *measures)]))


def duplicate_headings(headings: Column) -> Column:
    """Sorted distinct headings that occur more than once, trimmed and lower-cased."""
    named = F.array_sort(F.filter(F.transform(headings, lambda h: F.lower(F.trim(h))), lambda h: h != ""))
    return F.array_distinct(F.filter(named, lambda h, i: F.get(named, i - 1) == h))


def heading_score(h1: Column, h2: Column, h3: Column, keyword: Column) -> Column:
    key = F.lower(F.trim(keyword))
    has = lambda hs: F.exists(hs, lambda h: F.contains(F.lower(h), key))
    n1, n2, n3 = F.size(h1), F.size(h2), F.size(h3)
    every = F.concat(h1, h2, h3)
    empty = F.size(F.filter(every, lambda h: F.trim(h) == ""))
    score = (
        F.lit(100)
        - F.when(n1 == 0, 25).when(n1 > 1, 15).otherwise(0)
        - F.when(n2 == 0, 20).when(n2 < 3, 8).otherwise(0)
        - F.when((n3 > 0) & (n2 == 0), 10).otherwise(0)
        - F.when(~has(h1), 10).otherwise(0)
        - F.when((n2 > 0) & ~has(h2), 5).otherwise(0)
        - F.least(F.lit(10), 2 * empty)
        - F.least(F.lit(10), 2 * F.size(duplicate_headings(every)))
    )
    return F.greatest(score, F.lit(0)).cast("long")


def density_band(density: Column) -> Column:
    return F.when(density == 0, "none").when(density < 0.3, "low").when(density > 3, "high").otherwise("normal")


def content_problems(in_title: Column, in_meta: Column, in_h1: Column, density: Column, n: Column, average: Column, longest: Column) -> Column:
    checks = [
        (~in_title, "title"), (~in_meta, "meta"), (~in_h1, "h1"), (density_band(density) != "normal", "density"),
        (n == 0, "paragraphs"), (average > 80, "average"), (longest > 150, "longest"),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in checks]))


def is_usable(words: Column, text: Column, tokens: Column) -> Column:
    body = F.lower(F.coalesce(text, F.lit("")))
    return F.when(words < MIN_USABLE_WORDS, F.lit(False)).otherwise((F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(body, t)))


def cloaking(similarity: Column, hits: Column, hits_bot: Column, title_changed: Column) -> Column:
    """Null where either version is missing (similarity null)."""
    return (similarity < 0.45) | ((hits_bot >= 3) & (hits == 0)) | (title_changed & (similarity < 0.7))


def hijack_parts(cloak, only_bot, kind, parasite, root_checked, root_hits, root_density, density) -> Column:
    """struct<score, evidence>: the signals of a hijacked host, before and after the cap without evidence."""
    no = F.lit(False)
    cloak, only_bot, parasite = (F.coalesce(x, no) for x in (cloak, only_bot, parasite))
    root_bad = F.coalesce(root_checked, no) & ((root_hits == 0) | (root_density >= 2.0))
    unchecked = ~F.coalesce(root_checked, no)
    stuffed = (kind == "institutional") & (density >= 2.5)
    score = (
        F.when(cloak, 50).otherwise(0) + F.when(only_bot, 25).otherwise(0)
        + F.when(kind == "institutional", 35).when(kind == "ngo", 15).otherwise(0)
        + F.when(parasite & root_bad, 45).when(parasite & unchecked, 30).otherwise(0)
        + F.when(stuffed, 25).otherwise(0) + F.when(density > 6, 15).otherwise(0)
    )
    evidence = cloak | only_bot | (parasite & (root_bad | unchecked)) | stuffed
    capped = F.least(F.when(evidence, score).otherwise(F.least(score, F.lit(45))), F.lit(100)).cast("long")
    return F.struct(capped.alias("score"), evidence.alias("evidence"), (capped >= HIJACK_AT).alias("hijacked"))


def paragraph_stats(paragraphs: Column) -> Column:
    """struct<n, average, longest> of the word counts by white space."""
    sizes = F.transform(paragraphs, lambda p: F.regexp_count(p, F.lit(r"(?U)\S+")))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    n = F.size(paragraphs)
    return F.struct(
        n.cast("long").alias("n"),
        F.round(F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)), 1).alias("average"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest"),
    )


def keyword_flags(title: Column, meta: Column, h1: Column, keyword: Column) -> Column:
    """struct<in_title, in_meta, in_h1>: where the keyword is said; h1 is an array."""
    key = F.lower(F.trim(keyword))
    has = lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), key)
    return F.struct(has(title).alias("in_title"), has(meta).alias("in_meta"), F.exists(h1, has).alias("in_h1"))


def length_check(label: str, length: Column, least: int, most: int) -> Column:
    """What is wrong with a length, or null."""
    say = lambda what, edge: F.concat(F.lit(f"{label} {what} ("), length.cast("string"), F.lit(f" < {edge})" if what == "too short" else f" > {edge})"))
    return F.when(length == 0, F.lit(f"{label} missing")).when(length < least, say("too short", least)).when(length > most, say("too long", most))


def content_metrics(words: Column, text: Column, keyword: Column) -> Column:
    hits = count_keyword(text, keyword)
    return F.struct(
        words.alias("word_count"), F.round(words / F.lit(200.0), 1).alias("reading_time"),
        hits.alias("keyword_count"), content_density(hits, words).alias("keyword_density"),
    )


def length_budget(current: Column, role: Column | None = None) -> Column:
    room = F.floor(F.length(F.trim(current)) * 1.35)
    free = F.greatest(F.lit(40), F.least(room, F.lit(1200)))
    if role is None:
        return free.cast("long")
    return F.when(role == "title", 60).when(role == "meta_description", 160).when(role == "meta_keywords", 200).otherwise(free).cast("long")


# Words of a heading that tell what its section is.
FAQ_WORDS = ["faq", "pertanyaan", "tanya jawab"]
STEP_WORDS = ["cara", "langkah", "panduan", "tutorial", "step"]


def section_type(heading: Column, has_table: Column, list_items: Column) -> Column:
    h = F.lower(heading)
    any_of = lambda *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(h, w))
    return (
        F.when(F.contains(h, F.lit("?")) | any_of(*FAQ_WORDS), "faq")
        .when(any_of(*STEP_WORDS), "steps")
        .when(has_table, "table").when(list_items >= 4, "list").otherwise("paragraph")
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255


def saturation(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) - F.least(r, g, b)) / F.lit(255.0)


def channel(hex_: Column, i: int) -> Column:
    """Channel 0..2 of #rgb or #rrggbb."""
    h = F.regexp_replace(hex_, "^#", "")
    wide = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.conv(F.substring(wide, 2 * i + 1, 2), 16, 10).cast("long")
