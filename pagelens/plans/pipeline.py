"""From ranked results and fetched pages to page facts and blueprints, for many keywords at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import blueprint as B
from ..operators.html_pages import parse_pages
from ..operators.joins import entity_coverage


def root_probe(probes: DataFrame) -> DataFrame:
    """root, root_words, root_hits: of each root domain the https answer, or else the http one.

    probes: root, scheme, words, hits; a probe that failed has null words.
    """
    ok = probes.where("words is not null")
    first = F.max_by(F.struct("words", "hits"), F.col("scheme") == "https")
    return ok.groupBy("root").agg(first.alias("x")).select("root", F.col("x.words").alias("root_words"), F.col("x.hits").alias("root_hits"))


def _versions(wanted: DataFrame, fetched: DataFrame, unclosed: bool) -> DataFrame:
    """url, browser, bot, failure: the parsed page as each agent got it, where it did."""
    own = fetched.join(wanted.select("url").distinct(), "url", "left_semi")
    parsed = parse_pages(own, unclosed=unclosed).join(own.select("page_id", "agent"), "page_id")
    page = lambda a: F.first(F.when(F.col("agent") == a, F.col("page")), ignorenulls=True).alias(a)
    return parsed.groupBy("url").agg(page("browser"), page("bot"), F.max(F.nullif("error", F.lit(""))).alias("failure"))


def page_facts(results: DataFrame, fetched: DataFrame, limit: int = 10, roots: DataFrame | None = None, entities: Column | None = None, unclosed: bool = True) -> DataFrame:
    """A row for each of the first ``limit`` results of every keyword: status, page, and every score.

    results: keyword, position, url. fetched: page_id, url, agent ('browser' or 'bot'),
    html. roots: as root_probe gives. entities: array<string> looked for in the text.
    unclosed: as in parse_pages.
    The bot's version is the one indexed; pages that failed or weren't fetched keep
    their row with status error.
    """
    wanted = results.where(F.col("position") <= limit)
    both = wanted.join(_versions(wanted, fetched, unclosed), "url", "left")
    keyword, normal, bot = F.col("keyword"), F.col("browser"), F.col("bot")
    tokens = T.keyword_tokens(keyword)
    similar = F.when(normal.isNotNull() & bot.isNotNull(), T.similarity(T.token_set(normal["visible_text"]), T.token_set(bot["visible_text"])))
    host = U.domain(F.col("url"))
    out = both.withColumns({"page": F.coalesce("bot", "browser"), "domain": host, "similarity": similar})
    out = out.withColumn("root", U.host_parts(F.col("domain"))["root"])
    none = F.lit(None).cast("long")
    out = out.join(roots, "root", "left") if roots is not None else out.withColumns({"root_words": none, "root_hits": none})
    out = out.withColumn("_text", F.col("page.visible_text")).withColumn("_es", entities if entities is not None else F.array().cast("array<string>"))
    out = entity_coverage(out, "_text", "_es")
    p = F.col("page")
    hits, hits_bot = T.count_substring(normal["visible_text"], keyword), T.count_substring(bot["visible_text"], keyword)
    cloak = S.cloaking(F.col("similarity"), hits, hits_bot, F.lower(F.trim(normal["title"])) != F.lower(F.trim(bot["title"])))
    only_bot = F.col("similarity").isNotNull() & (hits_bot >= 3) & (hits == 0)
    density = lambda h, words: F.coalesce(T.indexed_density(h, F.size(tokens), words), F.lit(0.0))
    own = density(T.count_substring(p["visible_text"], keyword), p["word_count"])
    root_density = density(F.col("root_hits"), F.col("root_words"))
    hijack = S.hijack_parts(cloak, only_bot, U.host_class(F.col("domain")), U.is_parasite(F.col("domain"), tokens), F.col("root_words").isNotNull(), F.col("root_hits"), root_density, own)
    measures = [p["title_length"], p["meta_description_length"], p["h1_count"], p["word_count"], F.size(p["images_without_alt"]), F.size(p["internal"]), p["canonical"], p["robots_meta"]]
    paragraph, content = S.paragraph_stats(p["paragraphs"]), S.content_metrics(p["word_count"], p["visible_text"], keyword)
    flags = S.keyword_flags(p["title"], p["meta_description"], p["h1"], keyword)
    return out.select(
        "keyword", "position", "url", "domain", "page", "similarity", cloak.alias("cloaking"),
        F.when(p.isNull(), "error").otherwise("ok").alias("status"), F.when(p.isNull(), F.coalesce("failure", F.lit("not fetched"))).alias("error"),
        content.alias("content"), paragraph.alias("paragraph"), flags.alias("flags"), F.struct("found", "missing", "coverage").alias("entity"),
        S.heading_score(p["h1"], p["h2"], p["h3"], keyword).alias("heading_score"), S.duplicate_headings(F.concat(p["h1"], p["h2"], p["h3"])).alias("duplicate_headings"),
        S.page_score(S.DEFAULT_RULES, *measures).alias("seo_score"), S.page_problems(S.DEFAULT_RULES, *measures).alias("problems"), hijack.alias("hijack"),
        S.is_usable(p["word_count"], p["visible_text"], tokens).alias("usable"),
    ).withColumn(
        "content_problems",
        S.content_problems(F.col("flags.in_title"), F.col("flags.in_meta"), F.col("flags.in_h1"), F.col("content.keyword_density"), F.col("paragraph.n"), F.col("paragraph.average"), F.col("paragraph.longest")),
    )


def _ranked(rows: DataFrame, name: str, k: int) -> DataFrame:
    """keyword, name: the k values of each keyword that most rows have, as array<struct<value, n>>; ties by value."""
    n = rows.groupBy("keyword", "value").agg(F.count("*").alias("n"))
    first = n.withColumn("_k", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("n"), "value"))).where(F.col("_k") <= k)
    return first.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))


def _topics(ok: DataFrame, k: int) -> DataFrame:
    heads = F.concat("page.h2", "page.h3")
    words = F.array_distinct(F.flatten(F.transform(heads, lambda h: F.regexp_extract_all(F.lower(h), F.lit("[a-z0-9]+"), F.lit(0)))))
    skip = F.array_union(F.array(*map(F.lit, B.STOPWORDS)), F.split(F.lower("keyword"), r"\s+"))
    terms = F.filter(F.array_except(words, skip), lambda w: F.length(w) >= 4)
    return _ranked(ok.select("keyword", F.explode(terms).alias("value")), "heading_topics", k)


def blueprint(facts: DataFrame) -> DataFrame:
    """One row for each keyword: targets, adoption, counts by bucket, topics, headings, schema types, entities, questions.

    Targets come from the usable pages that aren't hijacked, or from all that were
    fetched where there is none (fallback).
    """
    counted = B.bucket_counts(B.buckets(facts, F.col("hijack.hijacked"), F.col("usable")), "keyword").drop("ok_count")
    ok = B.with_fallback(B.buckets(facts.where("status = 'ok'"), F.col("hijack.hijacked"), F.col("usable")), ["keyword"])
    p = F.col("page")
    flat = ok.select(
        "keyword", "position", p["word_count"].alias("word_count"), p["title_length"].alias("title_length"), p["meta_description_length"].alias("meta_description_length"),
        p["h2_count"].alias("h2_count"), p["h3_count"].alias("h3_count"), F.size(p["internal"]).alias("internal_count"), p["image_count"].alias("image_count"),
        F.col("content.keyword_density").alias("keyword_density"),
    )
    s = p["signals"]
    adoption = B.adoption(ok, "keyword", {"faq_percentage": s["has_faq"], "amp_percentage": s["is_amp"] | s["has_amp_version"], "table_percentage": s["table_count"] > 0}).drop("pages")
    each = lambda c: ok.select("keyword", F.explode(F.array_distinct(c)).alias("value"))
    heads = ok.select("keyword", F.explode(p["h2"]).alias("value")).select("keyword", T.squash(F.col("value")).alias("value")).where(F.length("value").between(8, 120))
    asked = ok.select("keyword", "position", F.posexplode(s["questions"]).alias("at", "q"))
    parts = [
        counted, adoption, ok.groupBy("keyword").agg(F.max("fallback").alias("hijack_fallback")), _topics(ok, 20), _ranked(heads, "common_headings", 25), _ranked(each(s["schema_types"]), "schema_types", 10),
        _ranked(each(F.col("entity.found")), "entities", 15), B.ordered_items(asked, "keyword", ["position", "at"], "q", 25).withColumnRenamed("items", "competitor_questions"),
    ]
    out = B.targets(flat, "keyword")
    for part in parts:
        out = out.join(part, "keyword", "left")
    return out


def insight(facts: DataFrame, blueprints: DataFrame) -> DataFrame:
    """keyword, position, domain, status, strengths (four at most), weaknesses (three), score, h2_count, internal_count: each result against its keyword's targets.

    Names stand for the messages. A page that wasn't fetched has empty lists and no numbers.
    """
    p, ok = F.col("page"), F.col("status") == "ok"
    own = facts.join(blueprints.select("keyword", F.col("word_count_median").alias("_median")), "keyword", "left")
    enough, titled, schema = p["word_count"] >= F.col("_median"), F.col("flags.in_title"), p["signals"]["schema_types"]
    good = [(enough, F.lit("words")), (titled, F.lit("keyword_in_title")), (p["signals"]["has_faq"], F.lit("faq")), (F.size(schema) > 0, F.concat(F.lit("schema:"), F.array_join(F.slice(schema, 1, 3), ",")))]
    bad = [(~enough, F.lit("few_words")), (~titled, F.lit("keyword_not_in_title")), (F.size(schema) == 0, F.lit("no_schema"))]
    names = lambda cs, k: F.slice(F.array_compact(F.array(*[F.when(ok & c, n) for c, n in cs])), 1, k)
    return own.select(
        "keyword", "position", "domain", "status", names(good, 4).alias("strengths"), names(bad, 3).alias("weaknesses"),
        F.when(ok, F.col("seo_score")).alias("score"), p["h2_count"].alias("h2_count"), F.size(p["internal"]).alias("internal_count"),
    )


def advice(blueprints: DataFrame) -> DataFrame:
    """keyword, summary, gaps, strategy: the numbers that stand in the page-one summary, its gaps and the advice."""
    whole = lambda c: F.col(c).cast("int").alias(c)
    return blueprints.select(
        "keyword", F.struct("word_count_median", "h2_median", "faq_percentage").alias("summary"), F.struct("faq_percentage", "amp_percentage", "table_percentage").alias("gaps"),
        F.struct(whole("word_count_top5_median"), whole("h2_median"), whole("internal_links_median")).alias("strategy"),
    )
