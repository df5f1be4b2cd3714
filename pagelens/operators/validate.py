"""Finished pages against their targets, and content plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_substring, count_words, thai_share, validated_density


def validate_page(page: Column, html: Column, keyword: Column, words_top: Column, words_all: Column, h2_target: Column) -> Column:
    """struct<score, passed, problems>: length checks add problems only, so the denominator varies."""
    c = lambda n: page[n]
    key = F.lower(keyword)
    target = F.greatest(words_top, words_all).cast("int")
    density = validated_density(count_substring(c("visible_text"), key), F.size(F.filter(F.split(key, r"\s+"), lambda w: w != "")), c("word_count"))
    checks = {
        "keyword in title": F.contains(F.lower(c("title")), key),
        "keyword in description": F.contains(F.lower(c("meta_description")), key),
        "one h1": c("h1_count") == 1,
        "keyword in h1": F.contains(F.lower(F.array_join(c("h1"), " ")), key),
        "words": ~((target > 0) & (c("word_count") < target * 0.8)),
        "h2": ~((h2_target.cast("int") > 0) & (c("h2_count") < h2_target.cast("int"))),
        "density": (density >= 0.5) & (density <= 3),
        "canonical": c("canonical") != "",
        "amp link": html.rlike(r"""(?i)<link[^>]+rel=["']amphtml["']"""),
        "structured data": F.contains(html, F.lit("application/ld+json")),
        "faq schema": F.contains(html, F.lit('"FAQPage"')),
    }
    lengths = {"title length": ~c("title_length").between(30, 62), "description length": ~c("meta_description_length").between(120, 165)}
    passed = F.array_compact(F.array(*[F.when(v, n) for n, v in checks.items()]))
    problems = F.array_compact(F.array(*[F.when(v, n) for n, v in lengths.items()], *[F.when(~v, n) for n, v in checks.items()]))
    score = F.bround(F.size(passed) * 100.0 / F.greatest(F.size(passed) + F.size(problems), F.lit(1))).cast("long")
    return F.struct(score.alias("score"), passed.alias("passed"), problems.alias("problems"), density.alias("keyword_density"))


def language_ok(text: Column, unspaced_region: Column) -> Column:
    return ~(unspaced_region & (thai_share(text) < 0.4))


def plan_words(sections: Column) -> Column:
    """Words of array<struct<heading, paragraphs, items>>."""
    every = F.flatten(F.transform(sections, lambda s: F.concat(F.array(s["heading"]), s["paragraphs"], s["items"])))
    return F.aggregate(F.transform(every, count_words), F.lit(0).cast("long"), lambda a, x: a + x)


def normalise_sections(sections: Column) -> Column:
    """Blank paragraphs and items go, then sections with neither."""
    keep = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.transform(sections, lambda s: F.struct(F.trim(s["heading"]).alias("heading"), keep(s["paragraphs"]).alias("paragraphs"), keep(s["items"]).alias("items")))
    return F.filter(clean, lambda s: (F.size(s["paragraphs"]) > 0) | (F.size(s["items"]) > 0))


def action_plan(items: Column) -> Column:
    """array<struct<priority, title>>: sorted by priority, missing ones by place; stable."""
    placed = F.transform(items, lambda x, i: F.struct(F.coalesce(x["priority"], i + 1).alias("priority"), i.alias("pos"), x["title"].alias("title")))
    return F.transform(F.array_sort(F.filter(placed, lambda x: x["title"].isNotNull())), lambda x: F.struct(x["priority"], x["title"]))
