"""What pages of a group have in common: exact medians, adoption rates, top terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash

# Words that are never topics.
STOPWORDS = [
    "yang", "dan", "di", "ke", "dari", "untuk", "dengan", "pada", "ini", "itu", "adalah", "atau", "juga", "bisa", "dapat",
    "the", "and", "for", "with", "you", "your", "are", "our", "situs", "link", "daftar", "login", "hari",
]


def safe_median(x: Column) -> Column:
    """The exact median to one decimal; 0.0 of nothing."""
    return F.coalesce(F.round(F.median(x), 1), F.lit(0.0))


def word_targets(pages: DataFrame, group: str, top: int = 5) -> DataFrame:
    w = F.col("word_count")
    return pages.groupBy(group).agg(
        F.count("*").alias("analyzed_pages"),
        safe_median(w).alias("word_count_median"),
        safe_median(F.when(F.col("position") <= top, w)).alias("word_count_top_median"),
        F.coalesce(F.max(w), F.lit(0)).alias("word_count_max"),
    )


def targets(pages: DataFrame, group: str, top: int = 5) -> DataFrame:
    """All ten targets of page facts; zero title and meta lengths count as missing."""
    c = F.col
    return pages.groupBy(group).agg(
        F.count("*").alias("analyzed_pages"),
        safe_median(c("word_count")).alias("word_count_median"),
        safe_median(F.when(c("position") <= top, c("word_count"))).alias("word_count_top5_median"),
        F.coalesce(F.max("word_count"), F.lit(0)).alias("word_count_max"),
        safe_median(F.nullif(c("title_length"), F.lit(0))).alias("title_length_median"),
        safe_median(F.nullif(c("meta_description_length"), F.lit(0))).alias("meta_length_median"),
        safe_median(c("h2_count")).alias("h2_median"),
        safe_median(c("h3_count")).alias("h3_median"),
        safe_median(c("internal_count")).alias("internal_links_median"),
        safe_median(c("image_count")).alias("images_median"),
        safe_median(c("keyword_density")).alias("keyword_density_median"),
    )


def adoption(pages: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    rate = lambda c: F.round(F.count_if(c) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1)
    return pages.groupBy(group).agg(F.count("*").alias("pages"), *[rate(c).alias(n) for n, c in flags.items()])


def buckets(pages: DataFrame, hijacked: Column, usable: Column) -> DataFrame:
    """Adds bucket: hijacked first, then unreadable, else ok; unknown counts as clean and usable."""
    no = F.lit(False)
    return pages.withColumn("bucket", F.when(F.coalesce(hijacked, no), "hijacked").when(~F.coalesce(usable, F.lit(True)), "unreadable").otherwise("ok"))


def with_fallback(pages: DataFrame, group: list[str]) -> DataFrame:
    """The ok pages of each group, or all of its pages where none is ok; adds fallback."""
    any_ok = F.max((F.col("bucket") == "ok").cast("int")).over(Window.partitionBy(*group)) == 1
    return pages.withColumn("fallback", ~any_ok).where((F.col("bucket") == "ok") | F.col("fallback"))


def bucket_counts(pages: DataFrame, group: str) -> DataFrame:
    n = lambda b: F.count_if((F.col("bucket") == b) & (F.col("status") == "ok")).alias(f"{b}_count")
    return pages.groupBy(group).agg(n("ok"), n("hijacked"), n("unreadable"), F.count_if(F.col("status") != "ok").alias("failed_pages"))


def top_headings(rows: DataFrame, column: str, k: int) -> DataFrame:
    named = rows.select(squash(F.col(column)).alias("heading")).where(F.length("heading").between(8, 120))
    return named.groupBy("heading").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "heading").limit(k)


def heading_topics(pages: DataFrame, page: str, headings: str, keyword: Column, k: int) -> DataFrame:
    """Terms by the number of pages that use them; ties go by term."""
    total = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    words = F.array_distinct(F.flatten(F.transform(headings, lambda h: F.regexp_extract_all(F.lower(h), F.lit("[a-z0-9]+"), F.lit(0)))))
    skip = F.array_union(F.array(*map(F.lit, STOPWORDS)), F.split(F.lower(keyword), r"\s+"))
    terms = pages.select(page, F.explode(F.filter(F.array_except(words, skip), lambda w: F.length(w) >= 4)).alias("term"))
    top = terms.groupBy("term").agg(F.count("*").alias("domain_count")).orderBy(F.desc("domain_count"), "term").limit(k)
    return top.crossJoin(F.broadcast(total)).select("term", "domain_count", F.round(F.col("domain_count") * 100.0 / F.col("_n"), 1).alias("coverage"))


def top_values(pages: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """Array values by the number of pages that have them."""
    total = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    top = pages.select(F.explode(F.array_distinct(column)).alias(name)).groupBy(name).agg(F.count("*").alias("domain_count")).orderBy(F.desc("domain_count"), name).limit(k)
    return top.crossJoin(F.broadcast(total)).select(name, "domain_count", F.round(F.col("domain_count") * 100.0 / F.col("_n"), 1).alias("coverage"))


def ordered_items(rows: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """The first k values of each group in order, duplicates kept."""
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    items = F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("v"))))
    return first.groupBy(group).agg(F.transform(items, lambda x: x["v"]).alias("items"))


def insight(pages: DataFrame, group: str) -> DataFrame:
    """Strengths and weaknesses against the group's medians; the medians have a row for each group."""
    m = pages.groupBy(group).agg(F.median("word_count").alias("_w"), F.median("h2_count").alias("_h"))
    w, h = F.col("word_count"), F.col("h2_count")
    good = [(w >= F.col("_w"), "long"), (h >= F.col("_h"), "structured")]
    bad = [(w < F.col("_w") * 0.7, "short"), (h < F.col("_h"), "flat")]
    names = lambda cs, k: F.slice(F.array_compact(F.array(*[F.when(c, n) for c, n in cs])), 1, k)
    return pages.join(m, group).withColumn("strengths", names(good, 4)).withColumn("weaknesses", names(bad, 3)).drop("_w", "_h")


def word_target(top: Column, every: Column) -> Column:
    return F.greatest(top, every, F.lit(900)).cast("int")


def section_target(h2: Column) -> Column:
    return F.least(F.greatest(h2.cast("int"), F.lit(5)), F.lit(9))
