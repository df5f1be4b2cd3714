"""Quality rules: a learned decision list over text statistics, DataFrame functions only.

``features`` computes per-document statistics inside one projection. ``learn`` runs
sequential covering on counts of labelled rows: a rule is grown condition by
condition on two thirds of the rows, pruned on the other third, kept if precise,
and the rows it covers leave before the next rule. ``verdict`` turns the list into
one ordered CASE expression.

Defined results: null text has no words; documents without a label take no part in
learning; without any labelled rows, none of one class, or too few bad ones (a rule
must cover three and be right about nine in ten, so some tens of labels give none),
the list is empty and only the base test decides. Ties between conditions go to the
first in the order of FEATURES, then to the lower threshold. Repeated rows have the
same statistics and verdict, a null doc_id has no label, very long texts are taken
whole, an empty table gives no rows, and extra columns, whatever their names, stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, Scratch, words_col

WINDOW = 8
#: Ratios of the base statistics that conditions may test.
FEATURES = {
    "symbols_per_word": lambda c: F.try_divide(c("n_symbols") * 1.0, c("n_words")),
    "chars_per_word": lambda c: F.try_divide(c("word_chars") * 1.0, c("n_words")),
    "repeat_share": lambda c: F.try_divide(c("n_repeat_words") * 1.0, c("n_words")),
    "dup_lines_per_word": lambda c: F.try_divide(c("n_dup_lines") * 1.0, c("n_words")),
    "upper_share": lambda c: F.try_divide(c("n_upper") * 1.0, c("word_chars")),
    "digit_share": lambda c: F.try_divide(c("n_digits") * 1.0, c("word_chars")),
    "mark_share": lambda c: F.try_divide(c("n_marks") * 1.0, c("word_chars")),
    "distinct_share": lambda c: F.try_divide(c("n_distinct_words") * 1.0, c("n_words")),
    "n_words": lambda c: c("n_words") * 1.0,
}


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, _v (of the text) and the statistics of each whole text; windows are compared by 64-bit hashes of 64-bit word hashes, inside the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("_v"), text.alias("_t"), words_col(F.col("text")).alias("_w"))
    base = base.select(
        "doc_id", "_v",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", GAP_CHARS, "")).cast("long").alias("word_chars"),
        _count_chars(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        _count_chars(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count_chars(F.col("_t"), "0123456789").alias("n_digits"),
        _count_chars(F.col("_t"), "!?.,;:\"'()[]{}-_=+/\\@^~`").alias("n_marks"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, GAP_CHARS, "") != "").alias("_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    ).withColumn("_words", F.col("_h"))
    # Hashes of two, four and eight neighbours, each made of two of the step before; shorter texts have none.
    for k in (1, 2, 4):
        n = F.greatest(F.size("_h") - k, F.lit(0))
        base = base.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b)))
        if k == 1:
            base = base.select(*[c for c in base.columns if c not in ("_lines", "_words")], (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"))
    base = base.withColumnRenamed("_h", "_win")
    # Few texts repeat a window: only those sort their windows with positions.
    base = base.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    pairs = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_s", F.when(F.col("_again"), pairs)).drop("_win")
    s = F.col("_s")
    n = F.size(s)
    here = lambda i: F.get(s, i)["h"]
    again = F.filter(
        F.transform(s, lambda x, i: F.when((here(i - 1) == x["h"]) | (here(i + 1) == x["h"]), x["i"])),
        lambda p: p.isNotNull(),
    )
    base = base.withColumn("_p", F.when(n > 0, F.array_sort(again))).drop("_s", "_again")
    p = F.col("_p")
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last")),
        lambda acc: acc["sum"],
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.coalesce(FEATURES[self.feature](F.col), F.lit(0.0))
        return x >= self.threshold if self.above else x < self.threshold


def labelled_counts(stats: DataFrame, labels: DataFrame, scratch: Scratch, bins: int = 16, sample_rows: int = 20_000) -> tuple[dict[str, list[float]], list]:
    """Thresholds, and counts of good and bad rows by vector of bins.

    ``sample_rows`` bounds the labelled rows looked at: those of lowest
    xxhash64(doc_id). Thresholds are quantiles of either class, so a rare class
    has its own.
    """
    own = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    rows = stats.where(~F.col("base_failed")).join(own, "doc_id").select(
        "_good", F.xxhash64("doc_id").alias("_k"), *[F.coalesce(f(F.col), F.lit(0.0)).alias(k) for k, f in FEATURES.items()]
    ).orderBy("_k", *FEATURES, "_good").limit(sample_rows)
    rows = scratch.put(rows, "sample")  # read twice
    at = [(i + 1) / (bins + 1) for i in range(bins)]
    cuts = rows.groupBy("_good").agg(*[F.percentile_approx(k, at, 1000).alias(k) for k in FEATURES]).collect()
    thresholds = {k: sorted({float(x) for r in cuts for x in (r[k] or [])}) for k in FEATURES}
    bin_of = lambda k: sum((F.when(F.col(k) >= t, 1).otherwise(0) for t in thresholds[k]), F.lit(0))
    counted = rows.select(
        *[bin_of(k).alias(k) for k in FEATURES], "_good", (F.pmod(F.floor(F.col("_k") / 7), F.lit(3)) == 0).alias("_prune")
    ).groupBy(*FEATURES, "_prune").agg(F.count_if(F.col("_good") == 1).alias("_n1"), F.count_if(F.col("_good") == 0).alias("_n0"))
    return thresholds, counted.collect()


def learn(thresholds: dict[str, list[float]], counts: list, precision: float = 0.9, max_conditions: int = 3, max_rules: int = 8, min_bad: int = 3) -> list[list[Condition]]:
    """Rules that reject, in order. Pure arithmetic on the bounded counts."""
    rows = sorted(((tuple(r[k] for k in FEATURES), bool(r["_prune"]), r["_n1"], r["_n0"]) for r in counts))
    names = list(FEATURES)
    conditions = [(Condition(k, up, t), names.index(k), j + 1) for k in names for j, t in enumerate(thresholds[k]) for up in (True, False)]

    def holds(rule, vector) -> bool:
        return all((vector[f] >= j) == c.above for c, f, j in rule)

    def score(rule, part) -> tuple[int, int]:
        got = [(g, b) for v, _, g, b in part if holds(rule, v)]
        return sum(g for g, _ in got), sum(b for _, b in got)

    def worth(good: int, bad: int) -> float:
        return (bad + 1) / (good + bad + 2)

    rules = []
    while rows and len(rules) < max_rules:
        grow = [r for r in rows if not r[1]]
        prune = [r for r in rows if r[1]]
        rule: list = []
        part = grow
        while len(rule) < max_conditions:
            good0, bad0 = sum(r[2] for r in part), sum(r[3] for r in part)
            if not good0 or not bad0:
                break
            best = None
            for c, f, j in conditions:
                good = bad = 0
                for v, _, g, b in part:
                    if (v[f] >= j) == c.above:
                        good += g
                        bad += b
                if bad < min_bad:
                    continue
                gain = bad * (_log2(worth(good, bad)) - _log2(worth(good0, bad0)))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, (c, f, j))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            part = [r for r in part if holds([best[1]], r[0])]
        # Prune: drop last conditions while the held-out part doesn't get worse.
        while len(rule) > 1 and worth(*score(rule[:-1], prune)) >= worth(*score(rule, prune)):
            rule.pop()
        good, bad = score(rule, rows)
        if not rule or bad < min_bad or worth(good, bad) < precision:
            break
        rules.append([c for c, _, _ in rule])
        rows = [r for r in rows if not holds(rule, r[0])]
    return rules


def _log2(x: float) -> float:
    from math import log2

    return log2(x)


def verdict(rules: list[list[Condition]]) -> Column:
    """CASE WHEN rule1 THEN false WHEN rule2 THEN false ... ELSE true END."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics of each document with base_failed and kept."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.put(features(docs), "stats")
    rules = learn(*labelled_counts(stats, labels, scratch, **options))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumn(
        "rules", F.lit("; ".join(" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold!r}" for c in r) for r in rules))
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows; all columns, whatever their names, as they were."""
    gone = judge(docs, labels, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_d"), "_v").distinct()
    own = docs.select(F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_w"), F.struct("*").alias("_row"))
    return own.join(gone, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_w") == F.col("_v")), "left_anti").select("_row.*")
