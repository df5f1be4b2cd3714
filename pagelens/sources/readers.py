"""Readers and writers of the files that the analyses use."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import DEFAULT_RULES, LEGACY_RULES, Rules, page_problems, page_score
from ..functions.text import count_spaced
from ..functions.urls import domain
from ..operators.ranking import first_per_domain

RESULT = "array<struct<link:string,url:string,title:string,snippet:string>>"
REPORT = (
    "analyzed_at string, requested_url string, final_url string, status_code int, content_type string, keyword string, intent struct<intent:string,confidence:double>, seo_score int, "
    "page struct<title:string,visible_text:string,paragraphs:array<string>,title_length:int,meta_description:string,meta_description_length:int,robots_meta:string,canonical:string,word_count:int,"
    "headings:struct<h1:array<string>,h1_count:int,h2:array<string>,h2_count:int,h3:array<string>,h3_count:int>,images:struct<total:int,without_alt:array<string>,without_alt_count:int>,"
    "links:struct<internal:array<string>,internal_count:int,external:array<string>,external_count:int>>, "
    "entity struct<topic_found:boolean,topic:string,coverage_percentage:double,total_entities:int,found_count:int,missing_count:int,found_entities:array<string>,missing_entities:array<string>,message:string>, "
    "content struct<word_count:int,reading_time:double,keyword_count:int,keyword_density:double,keyword_in_title:boolean,keyword_in_meta:boolean,keyword_in_h1:boolean,paragraph_count:int,average_paragraph_length:double,longest_paragraph_length:int>, "
    "heading_analysis struct<heading_score:int,h1_count:int,h2_count:int,h3_count:int,problems:array<string>,recommendations:array<string>>, problems array<string>, recommendations array<string>"
)


# Where a rules file keeps each number.
RULE_KEYS = {
    "title_missing": ("title", "penalty_missing"), "title_length": ("title", "penalty_length"), "meta_missing": ("meta_description", "penalty_missing"),
    "meta_short": ("meta_description", "penalty_length"), "meta_long": ("meta_description", "penalty_length"), "h1_missing": ("h1", "penalty_missing"),
    "h1_multiple": ("h1", "penalty_multiple"), "min_words": ("content", "minimum_words"), "thin": ("content", "penalty_thin"), "max_alt": ("images", "maximum_penalty"),
    "min_links": ("internal_links", "minimum"), "no_links": ("internal_links", "penalty_missing"), "no_canonical": ("canonical", "penalty_missing"), "noindex": ("noindex", "penalty"),
}


def read_reports(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Audit reports of the files under a path, each one JSON document or an array of them, with status (ok, corrupt).

    Keys a report lacks are null; a file that can't be read as JSON gives one corrupt row
    without a report.
    """
    rows = spark.read.schema(f"{REPORT}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.withColumn("status", F.when(F.col("_corrupt").isNull(), "ok").otherwise("corrupt")).drop("_corrupt")


def write_reports(reports: DataFrame, path: str, per_file: int = 500) -> None:
    """Reports as files of JSON arrays, some ``per_file`` in each."""
    files = max(-(-reports.count() // per_file), 1)
    number = F.pmod(F.xxhash64("requested_url"), F.lit(files)).alias("file")
    arrays = reports.select(number, F.struct("*").alias("_r")).groupBy("file").agg(F.to_json(F.collect_list("_r")).alias("value"))
    # A folder a row, so that a file holds one array.
    arrays.write.mode("append").partitionBy("file").text(path)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="keyword string, intent string")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """topic, ord, entities, ideal, must_have from a JSON object of topics."""
    one = spark.read.text(path, wholetext=True)
    topic = "map<string,struct<entities:array<string>,ideal:map<string,double>,must_have:array<string>>>"
    rows = one.select(F.posexplode(F.map_entries(F.from_json("value", topic))).alias("ord", "e"))
    none = F.array().cast("array<string>")
    return rows.select(F.col("e.key").alias("topic"), "ord", F.coalesce("e.value.entities", none).alias("entities"), "e.value.ideal", F.coalesce("e.value.must_have", none).alias("must_have"))


def read_manual_results(spark: SparkSession, path: str, keyword: str, region: str, limit: int = 10) -> DataFrame:
    """position, url, domain from a JSON file: an object of lists by keyword or region:keyword, or one list."""
    text = spark.read.text(path, wholetext=True).withColumn("m", F.from_json("value", "map<string,array<string>>"))
    plain = F.from_json("value", "array<string>")
    own = F.try_element_at("m", F.lit(f"{region}:{keyword}"))
    urls = F.coalesce(F.when(F.size(own) > 0, own), F.try_element_at("m", F.lit(keyword)), plain)
    rows = text.select(F.posexplode(urls).alias("ord", "url")).where(F.col("url").rlike("^https?://"))
    return first_per_domain(rows, domain(F.col("url")), ["ord"], limit).select("position", "url", "domain")


def read_manual_lists(spark: SparkSession, path: str) -> DataFrame:
    """name (keyword or region:keyword), urls of all files of lists under a path."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "urls"))


def manual_results_of(requests: DataFrame, lists: DataFrame, limit: int = 10) -> DataFrame:
    """keyword, region, position, url, domain: each request's list, the region's own if it holds anything, else the keyword's. requests: keyword, region."""
    names = requests.select("keyword", "region", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.concat_ws(":", "region", "keyword").alias("name")), F.struct(F.lit(1).alias("tier"), F.col("keyword").alias("name")))).alias("n"))
    found = names.select("keyword", "region", "n.*").join(lists.where(F.size("urls") > 0), "name")
    own = found.groupBy("keyword", "region").agg(F.min_by("urls", "tier").alias("urls"))
    rows = own.select("keyword", "region", F.posexplode("urls").alias("ord", "url")).where(F.col("url").rlike("^https?://"))
    return first_per_domain(rows, domain(F.col("url")), ["ord"], limit, ["keyword", "region"]).drop("ord")


def read_provider_results(payloads: DataFrame, column: str, field: str, limit: int = 10) -> DataFrame:
    """keyword, position, url, title, snippet, domain from stored provider replies (JSON text); field is organic or items."""
    reply = F.from_json(column, f"struct<{field}:{RESULT}>")[field]
    rows = payloads.select("keyword", F.posexplode(reply).alias("ord", "r")).select("keyword", "ord", F.coalesce("r.link", "r.url").alias("url"), "r.title", "r.snippet")
    rows = rows.where(F.col("url").rlike("^https?://"))
    return first_per_domain(rows, domain(F.col("url")), ["ord"], limit, ["keyword"]).drop("ord")


def read_questions(payloads: DataFrame, column: str) -> DataFrame:
    """keyword, people_also_ask, related_searches of stored replies."""
    r = F.from_json(column, "struct<peopleAlsoAsk:array<struct<question:string>>,relatedSearches:array<struct<query:string>>>")
    return payloads.select("keyword", F.transform(r["peopleAlsoAsk"], lambda x: x["question"]).alias("people_also_ask"), F.transform(r["relatedSearches"], lambda x: x["query"]).alias("related_searches"))


#: Result sources by name.
PROVIDERS = {"serper": lambda p, c: read_provider_results(p, c, "organic"), "google_cse": lambda p, c: read_provider_results(p, c, "items")}


def run_provider(name: str, payloads: DataFrame, column: str) -> DataFrame:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](payloads, column)


def read_templates(spark: SparkSession, path: str, max_bytes: int = 2 << 20, glob: str = "*") -> DataFrame:
    """path, html, status of the files under a path whose names fit. Files beyond the limit aren't read, their size tells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("html"), F.lit("too large").alias("status"))
    return checked_templates(files.where(F.col("length") <= max_bytes).select("path", "content"), max_bytes).unionByName(large)


def pack_templates(files: DataFrame, path: str) -> None:
    """Many template files as rows of few: path, content. A file of its own costs more to make, list and open than to read."""
    files.select("path", "content").write.mode("append").parquet(path)


def read_packed(spark: SparkSession, path: str, max_bytes: int = 2 << 20) -> DataFrame:
    """path, html, status of the packed files under a path."""
    return checked_templates(spark.read.schema("path string, content binary").parquet(path), max_bytes)


def checked_templates(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """path, html, status (ok, too large, not utf-8) of files (path, content); only ok files have html."""
    small = F.octet_length("content") <= max_bytes
    html = F.when(small, F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", html.alias("html"), F.when(~small, "too large").when(html.isNull(), "not utf-8").otherwise("ok").alias("status"))


def read_rules(spark: SparkSession, path: str, base: Rules = DEFAULT_RULES) -> Rules:
    """Scoring rules from a JSON object of objects of integers; what the file leaves out keeps its default."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("rule", "values")).collect()  # one small file
    got = {(r["rule"], k): v for r in rows for k, v in (r["values"] or {}).items()}
    one = {f: got[k] for f, k in RULE_KEYS.items() if k in got}
    pair = lambda rule, old: (got.get((rule, "min"), old[0]), got.get((rule, "max"), old[1]))
    return replace(base, **one, title=pair("title", base.title), meta=pair("meta_description", base.meta))


def sitemap(urls: DataFrame, path: str) -> None:
    urls.select(F.col("url").alias("loc"), F.col("lastmod")).write.mode("overwrite").option("rootTag", "urlset").option("rowTag", "url").xml(path)


def jsonld_article(title: Column, description: Column, url: Column, published: Column) -> Column:
    body = F.to_json(F.struct(F.lit("Article").alias("@type"), title.alias("headline"), description.alias("description"), url.alias("url"), published.alias("datePublished")))
    from ..functions.text import json_for_html

    return json_for_html(body)


def legacy_reports(parsed: DataFrame) -> DataFrame:
    """The older report of parsed pages: page_id, requested_url, http_status, title, h1, word_count, seo_score, problems."""
    c = lambda n: F.col(f"page.{n}")
    words = count_spaced(c("visible_text"))
    measures = [c("title_length"), c("meta_description_length"), c("h1_count"), words, F.size(c("images_without_alt")), F.size(c("internal")), c("canonical"), c("robots_meta")]
    ok = parsed.where("status = 'ok'")
    return ok.select(
        "page_id", F.col("url").alias("requested_url"), F.lit(200).alias("http_status"), c("title").alias("title"), F.coalesce(F.get(c("h1"), 0), F.lit("")).alias("h1"),
        words.alias("word_count"), page_score(LEGACY_RULES, *measures).alias("seo_score"), page_problems(LEGACY_RULES, *measures).alias("problems"),
    )
