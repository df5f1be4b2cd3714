"""From a template's texts to a page plan, a site's identity, and what a run gave: projections of structs."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.dates import iso_date
from ..sources.shared import workers_find_us
from .joins import cut_to_shorter, region_join


def sections_from_parts(headings: Column, paragraphs: Column) -> Column:
    """array<struct<heading, paragraphs>>: the paragraphs dealt in order to the headings, one more to the first ones; empty sections go."""
    n, total = F.size(headings), F.size(paragraphs)
    share, rest = F.try_divide(total, n).cast("int"), total % n

    def one(h: Column, i: Column) -> Column:
        size = share + F.when(i < rest, 1).otherwise(0)
        return F.struct(h.alias("heading"), F.slice(paragraphs, i * share + F.least(i, rest) + 1, size).alias("paragraphs"))

    none = F.array().cast("array<struct<heading:string,paragraphs:array<string>>>")
    return F.when(n > 0, F.filter(F.transform(headings, one), lambda s: F.size(s["paragraphs"]) > 0)).otherwise(none)


def plan(content: Column, keyword: Column) -> Column:
    """A page plan from the texts that fill a template.

    content: struct<title, meta_description, meta_keywords, h1 strings; heading, paragraph,
    faq_question, faq_answer, review_text, review_author arrays of strings>.
    """
    c = lambda n: content[n]
    text = lambda n: F.coalesce(c(n), F.lit(""))
    items = lambda n: F.coalesce(c(n), F.array().cast("array<string>"))
    pairs = lambda a, b: F.arrays_zip(cut_to_shorter(items(a), items(b))["left"].alias("left"), cut_to_shorter(items(a), items(b))["right"].alias("right"))
    said = F.filter(items("paragraph"), lambda p: F.trim(p) != "")
    words = F.filter(F.transform(F.split(text("meta_keywords"), ","), lambda w: F.trim(w)), lambda w: w != "")
    keywords = F.when(F.array_contains(words, keyword), words).otherwise(F.concat(F.array(keyword), words))
    return F.struct(
        text("title").alias("title"), text("meta_description").alias("meta_description"), T.url_slug(F.coalesce(F.nullif(text("h1"), F.lit("")), keyword)).alias("slug"), text("h1").alias("h1"),
        F.slice(said, 1, 2).alias("intro"), sections_from_parts(items("heading"), F.slice(said, F.lit(3), F.greatest(F.size(said) - 2, F.lit(0)))).alias("sections"),
        pairs("faq_question", "faq_answer").alias("faq"), F.slice(keywords, 1, 12).alias("keywords"), pairs("review_text", "review_author").alias("reviews"),
    )


def brands(rows: DataFrame, regions: DataFrame, today: Column, default_name: str, default_url: str) -> DataFrame:
    """Adds site_name, site_url and the region's language, calendar year and date to brand_name, base_url, region_code."""
    named = region_join(rows, F.col("region_code"), regions)
    filled = lambda c, d: F.coalesce(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(d))
    url = F.regexp_replace(filled("base_url", default_url), "/+$", "")
    return named.withColumns(
        {"site_name": filled("brand_name", default_name), "site_url": F.when(url == "", url).otherwise(U.with_scheme(url)), "year": (F.year(today) + F.col("year_offset")).cast("string"), "today_iso": iso_date(today)}
    )


def run_summary(blueprint: Column, plan_: Column, seo: Column, amp: Column, analyze_only: Column) -> Column:
    """What a run gave, for a list of runs; a run that only analysed has no page fields."""
    page = lambda x: F.when(~analyze_only, x)
    return F.struct(
        analyze_only.alias("analyze_only"), blueprint["hijacked_count"].alias("hijacked_count"), blueprint["unreadable_count"].alias("unreadable_count"),
        F.when(analyze_only, blueprint["analyzed_pages"]).alias("analyzed_pages"), page(plan_["title"]).alias("title"), page(plan_["slug"]).alias("slug"),
        page(F.size(plan_["sections"])).alias("sections"), page(F.size(plan_["faq"])).alias("faq"), page(amp["valid"]).alias("amp_valid"), page(seo["score"]).alias("seo_score"), page(seo["word_count"]).alias("word_count"),
    )


def output_name(brand: Column, keyword: Column, at: Column) -> Column:
    """The folder of a run's files."""
    return F.concat_ws("-", T.file_slug(brand), T.file_slug(keyword), F.date_format(at, "yyyyMMdd-HHmmss"))


def analysis_markdown(title: Column, values: dict[str, Column]) -> Column:
    """A report in Markdown: a heading and a table of names and values; missing values are dashes."""
    cell = lambda v: F.replace(F.replace(F.coalesce(v.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = [F.concat(F.lit(f"| {n} | "), cell(v), F.lit(" |")) for n, v in values.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.lit("| target | value |"), F.lit("| --- | --- |"), *rows)


def zip_bundles(files: DataFrame, group: str) -> DataFrame:
    """group, n, bundle: a ZIP of each group's files (name, content), by name. Files go into their ZIP one by one, so that a task holds one ZIP, not a group's files."""
    kind = files.schema[group].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, n, c) for p in parts for k, n, c in zip(p[group], p["name"], p["content"]))
        for key, own in itertools.groupby(rows, lambda r: None if pd.isna(r[0]) else r[0]):
            out, n = io.BytesIO(), 0
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, name, content in own:
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
                    n += 1
            yield pd.DataFrame({group: [key], "n": [n], "bundle": [out.getvalue()]})

    workers_find_us(files.sparkSession)
    own = files.select(group, "name", "content").repartition(group).sortWithinPartitions(group, "name")
    return own.mapInPandas(run, f"{group} {kind}, n long, bundle binary")


def unzip(bundles: DataFrame, group: str) -> DataFrame:
    """group, name, content of every file in the bundles, some thousands at a time."""
    kind = bundles.schema[group].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.bundle)) as z:
                    # Entries rather than names: a group may hold two files of one name.
                    entries = z.infolist()
                    for lo in range(0, len(entries), 2000):
                        some = entries[lo : lo + 2000]
                        yield pd.DataFrame({group: [getattr(r, group)] * len(some), "name": [e.filename for e in some], "content": [z.read(e) for e in some]})

    workers_find_us(bundles.sparkSession)
    return bundles.select(group, "bundle").mapInPandas(run, f"{group} {kind}, name string, content binary")
