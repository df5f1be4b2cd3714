"""Windows: ranks, tails, dedup by first, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_domain(results: DataFrame, domain: Column, order: list[str], limit: int, group: list[str] | None = None) -> DataFrame:
    """Keeps the first result of each domain and renumbers positions 1..limit within the group."""
    group = group or []
    keyed = results.withColumn("domain", domain)
    first = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "domain").orderBy(*order))).where("_k = 1").drop("_k")
    if not group:  # a global top-k before the numbering, so that few rows are numbered
        first = first.orderBy(*order).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= limit)


def reference_score() -> Column:
    c = F.col
    flags = F.when(c("has_faq"), 12).otherwise(0) + F.when(c("has_schema"), 8).otherwise(0)
    return F.greatest(F.lit(0), 11 - c("position")) * 3 + c("h2_count") * 1.5 + flags + F.least(c("word_count") / 200.0, F.lit(15.0))


def rank_reference_pages(pages: DataFrame, group: str, k: int) -> DataFrame:
    scored = pages.withColumn("score", reference_score().cast("double"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "position"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def unique_ids(rows: DataFrame, group: list[str], base: str, order: str) -> DataFrame:
    """Adds unique_id: the n-th repeat of a base gets -n."""
    k = F.row_number().over(Window.partitionBy(*group, base).orderBy(order))
    return rows.withColumn("_k", k).withColumn("unique_id", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, "_k"))).drop("_k")


def deal(rows: DataFrame, group: list[str], order: str, parts: int) -> DataFrame:
    return rows.withColumn("part", F.ntile(parts).over(Window.partitionBy(*group).orderBy(order)))


def mark_overlaps(edits: DataFrame, group: list[str]) -> DataFrame:
    """Adds overlaps: the edit ends after the next one begins."""
    later = F.lag("start").over(Window.partitionBy(*group).orderBy(F.desc("start")))
    return edits.withColumn("overlaps", F.coalesce(F.col("end") > later, F.lit(False)))


def slot_spec(slots: DataFrame, group: list[str]) -> DataFrame:
    return slots.groupBy(*group, "role").agg(F.count("*").alias("n"), F.min("budget").alias("max_length"), F.max("budget").alias("max_length_any"))


def tail(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The last k rows of each group, with rank 1 for the last."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k by order with its rank: sorted and limited per partition before anything meets."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def demote_block_title(slots: DataFrame, group: str) -> DataFrame:
    """Of three or more questions, a single shallowest one is the block's heading."""
    q = F.col("role") == "faq_question"
    w = Window.partitionBy(group, "role")
    least = F.min("depth").over(w)
    marked = slots.withColumn("_n", F.count("*").over(w)).withColumn("_top", F.col("depth") == least)
    marked = marked.withColumn("_tops", F.count_if("_top").over(w))
    alone = q & (F.col("_n") >= 3) & F.col("_top") & (F.col("_tops") == 1)
    return marked.withColumn("role", F.when(alone, "heading").otherwise(F.col("role"))).drop("_n", "_top", "_tops")


def first_success(rows: DataFrame, group: str, rank: str, ok: Column, tries: int = 4) -> DataFrame:
    """Of the first few candidates of a group, the first that worked."""
    w = Window.partitionBy(group).orderBy(rank)
    return rows.where(F.col(rank) <= tries).where(ok).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
