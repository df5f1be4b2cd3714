"""Queries of page plans, site identities, summaries, bundles, rule files and older reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.regions import regions
from ..operators import amp, content, templates, validate
from ..operators import blueprint as B
from ..sources import readers
from ..sources.shared import pinned, shared_folder
from .pages import _H1, _M, _PLAIN, _TITLE, _WC, _sql_text, parsed
from .registry import query


@query("""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) as k from conversations where text is not null),
a as (select conv_id, coalesce(list(text order by k) filter (where role = 'user'), []) as us, coalesce(list(text order by k) filter (where role = 'assistant'), []) as ans, coalesce(list(role order by k), []) as rs from t group by conv_id),
b as (select *, list_filter(us || ans, lambda x: trim(x) <> '') as ps from a), c as (select *, ps[3:] as rest, len(ps[3:]) // len(rs) as share, len(ps[3:]) % len(rs) as more from b),
d as (select conv_id, ps, us, ans, rs, least(len(rs), len(rest)) as sections, rest from c)
select conv_id, 'c' || conv_id as slug, md5(array_to_string(ps[:2], '|')) as intro, sections::bigint as sections, len(rest)::bigint as paragraphs, least(len(us), len(ans))::bigint as faq, 'kw,a,b' as keywords from d""")
def template_plan(load):
    """Conversations as page plans: questions, answers, and paragraphs dealt to headings (V-6, J-9, W-15)."""
    rows = load("conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    of = lambda r: F.transform(F.filter("xs", lambda x: x["role"] == r), lambda x: x["text"])
    c = F.struct(
        F.lit("t").alias("title"), F.lit("d").alias("meta_description"), F.lit("a, ,b").alias("meta_keywords"), F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("h1"),
        F.transform("xs", lambda x: x["role"]).alias("heading"), F.concat(of("user"), of("assistant")).alias("paragraph"), of("user").alias("faq_question"), of("assistant").alias("faq_answer"),
        F.lit(None).cast("array<string>").alias("review_text"), F.lit(None).cast("array<string>").alias("review_author"),
    )
    p = rows.select("conv_id", content.plan(c, F.lit("kw")).alias("p"))
    n = F.aggregate("p.sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["paragraphs"]))
    return p.select("conv_id", "p.slug", F.md5(F.array_join("p.intro", "|")).alias("intro"), F.size("p.sections").cast("long").alias("sections"), n.alias("paragraphs"), F.size("p.faq").cast("long").alias("faq"), F.array_join("p.keywords", ",").alias("keywords"))


@query("""select s_suppkey, case when s_suppkey % 4 = 0 then 'Site' else s_name end as site_name, case when s_suppkey % 3 = 0 then 'https://a.b' else 'https://x' || s_suppkey || '.c' end as site_url,
case when s_suppkey % 2 = 0 then 'Thailand' else 'Indonesia' end as label, case when s_suppkey % 2 = 0 then '2567' else '2024' end as year, '2024-01-31' as today_iso from supplier""")
def brand_rows(load):
    """Identities of sites, with defaults, by region (V-8)."""
    k = F.col("s_suppkey")
    s = load("supplier").select(
        "s_suppkey", F.when(k % 4 == 0, " ").otherwise(F.col("s_name")).alias("brand_name"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit(" x"), k.cast("string"), F.lit(".c// "))).alias("base_url"), F.when(k % 2 == 0, "TH").otherwise("").alias("region_code")
    )
    out = content.brands(s, regions(s.sparkSession), F.lit("2024-01-31").cast("date"), "Site", "a.b/")
    return out.select("s_suppkey", "site_name", "site_url", "label", "year", "today_iso")


@query("""select o_orderkey, o_orderkey % 2 = 0 as analyze_only, (o_orderkey % 3)::bigint as hijacked_count, case when o_orderkey % 2 = 0 then 9 end::bigint as analyzed_pages, case when o_orderkey % 2 = 1 then 'T' end as title,
case when o_orderkey % 2 = 1 then 2 end::int as sections, case when o_orderkey % 2 = 1 then true end as amp_valid, case when o_orderkey % 2 = 1 then o_custkey end::bigint as seo_score from orders""")
def run_summaries(load):
    """What each run gave; runs that only analysed have no page (A-24)."""
    k = F.col("o_orderkey")
    b = F.struct((k % 3).alias("hijacked_count"), F.lit(0).alias("unreadable_count"), F.lit(9).cast("long").alias("analyzed_pages"))
    p = F.struct(F.lit("T").alias("title"), F.lit("t").alias("slug"), F.array(F.lit(1), F.lit(2)).alias("sections"), F.array(F.lit(1)).alias("faq"))
    seo = F.struct(F.col("o_custkey").alias("score"), F.lit(5).alias("word_count"))
    s = content.run_summary(b, p, seo, F.struct(F.lit(True).alias("valid")), k % 2 == 0)
    return load("orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.analyze_only", "s.hijacked_count", "s.analyzed_pages", "s.title", "s.sections", "s.amp_valid", "s.seo_score")


@query("""select s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-key-' || s_suppkey || '-20240131-120000' as folder from supplier""")
def output_folders(load):
    """Folders of runs (S-22)."""
    at = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return load("supplier").select("s_suppkey", content.output_name(F.col("s_name"), F.concat(F.lit("key "), F.col("s_suppkey").cast("string")), at).alias("folder"))


@query("""select n_nationkey, '# ' || n_name || chr(10) || chr(10) || '| target | value |' || chr(10) || '| --- | --- |' || chr(10) || '| region | ' || n_regionkey || ' |' || chr(10) || '| note | ' || case when n_nationkey % 2 = 0 then 'a\\|b' else '-' end || ' |' as report from nation""")
def markdown_reports(load):
    """Reports in Markdown (S-20)."""
    note = F.when(F.col("n_nationkey") % 2 == 0, "a|b")
    return load("nation").select("n_nationkey", content.analysis_markdown(F.col("n_name"), {"region": F.col("n_regionkey"), "note": note}).alias("report"))


@query("select c_nationkey, c_name as name, md5(c_mktsegment) as content, count(*) over (partition by c_nationkey)::bigint as n from customer")
def zip_round_trip(load):
    """Every owner's files in one ZIP, and out of it again (S-26)."""
    c = load("customer").select("c_nationkey", F.col("c_name").alias("name"), F.encode("c_mktsegment", "UTF-8").alias("content"))
    z = pinned(content.zip_bundles(c, "c_nationkey"), "bundles")
    out = content.unzip(z, "c_nationkey").join(z.select("c_nationkey", "n"), "c_nationkey")
    return out.select("c_nationkey", "name", F.md5("content").alias("content"), "n")


_RULED = "greatest(0, 100 - case when tl = 0 then 30 when tl < 10 or tl > 20 then 8 else 0 end - 10 - case when h1 = 0 then 15 when h1 > 1 then 5 else 0 end - case when wc < 500 then 10 else 0 end - case when links < 1 then 5 else 0 end - 5)::bigint"


@query(f"{_M} select page_id, {_RULED} as seo_score from m")
def rules_scan(load):
    """Page scores by a rules file; what the file leaves out keeps its default (S-9, P-13)."""
    pages = load("pages")
    at = f"{shared_folder(pages.sparkSession)}/rules"
    text = '{"title": {"min": 10, "max": 20, "penalty_missing": 30, "penalty_length": 8}, "content": {"minimum_words": 500}, "unknown": {"x": 1}}'
    pages.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    rules = readers.read_rules(pages.sparkSession, at)
    c = lambda n: F.col(f"page.{n}")
    measures = [c("title_length"), c("meta_description_length"), c("h1_count"), c("word_count"), F.size(c("images_without_alt")), F.size(c("internal")), c("canonical"), c("robots_meta")]
    return parsed(pages).select("page_id", S.page_score(rules, *measures).alias("seo_score"))


@query(f"""{_M} select m.page_id, 200::int as http_status, {_TITLE} as title, {_H1} as h1, {_WC}::bigint as word_count, greatest(0, 100 - case when tl = 0 then 15 when tl < 30 or tl > 60 then 5 else 0 end - 10 - case when h1 = 0 then 15 when h1 > 1 then 5 else 0 end
- case when wc < 300 then 10 else 0 end - case when links < 1 then 5 else 0 end - 5)::bigint as seo_score from m join pages using (page_id)""")
def legacy_reports(load):
    """The older report of every page: words by white space alone, the older rules (H-22, P-37, S-28, S-29)."""
    return readers.legacy_reports(parsed(load("pages"))).select("page_id", "http_status", "title", "h1", "word_count", "seo_score")


@query("""with h as (select s_suppkey, s_nationkey, 'h' || s_suppkey % 7 || '.c' as domain, 'https://H' || s_suppkey % 7 || '.c/' || s_suppkey as url, row_number() over (partition by s_nationkey, s_suppkey % 7 order by s_suppkey) as n from supplier)
select 'kw ' || s_nationkey as keyword, row_number() over (partition by s_nationkey order by s_suppkey)::bigint as position, url, domain from h where n = 1 qualify position <= 10""")
def manual_results(load):
    """Result lists from files, one for each nation: a region's own list where it holds any, else the keyword's; one result for each domain (S-6, J-14, W-1)."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = load("supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("https://H"), (k % 7).cast("string"), F.lit(".c/"), k.cast("string")).alias("url"))
    spark = s.sparkSession
    at = f"{shared_folder(spark)}/manual"
    urls = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "url"))), lambda x: x["url"])  # a nation's list is one entry of its file
    key, none = F.concat(F.lit("kw "), n.cast("string")), F.array().cast("array<string>")
    lists = s.groupBy("s_nationkey").agg(urls.alias("urls"))
    # Every second nation has its list under its region; the others have an empty one there.
    entries = F.when(n % 2 == 0, F.create_map(F.concat(F.lit("id:"), key), F.col("urls"), key, F.array(F.lit("https://other.c/")))).otherwise(F.create_map(F.concat(F.lit("id:"), key), none, key, F.col("urls")))
    lists.select("s_nationkey", F.to_json(entries).alias("value")).write.partitionBy("s_nationkey").text(at)
    asked = lists.select(key.alias("keyword"), F.lit("id").alias("region"))
    return readers.manual_results_of(asked, readers.read_manual_lists(spark, at)).select("keyword", F.col("position").cast("long").alias("position"), "url", "domain")


@query("select page_id, 'a{b:' || page_id || '}' || chr(10) || 'c{}' as css from pages")
def amp_styles(load):
    """The custom style of AMP pages (H-21)."""
    style = F.concat(F.lit("<STYLE  amp-custom x>a{b:"), F.col("page_id").cast("string"), F.lit("}\nc{}</style></head>"))
    return load("pages").select("page_id", amp.custom_css(F.replace("html", F.lit("</head>"), style)).alias("css"))


_BODY = _sql_text(_PLAIN)


@query(f"""with m as (select page_id, lower({_TITLE}) as t, lower({_H1}) as h, len(regexp_extract_all(html, '(?i)<h1[ >]')) as n1, {_WC} as wc, lower({_BODY}) as body from pages),
d as (select *, round(((length(body) - length(replace(body, 'the', ''))) // 3) / greatest(wc, 1)::double * 100, 2) as density from m),
c as (select page_id, density, contains(t, 'the')::int + (n1 = 1)::int + contains(h, 'the')::int + (wc >= 400)::int + (density between 0.5 and 3)::int as passed, (length(t) not between 30 and 62)::int + 1 as lengths from d)
select page_id, density as keyword_density, passed::bigint as passed, (11 - passed + lengths)::bigint as problems, round_even(passed * 100.0 / (11 + lengths), 0)::bigint as score from c""")
def validated_pages(load):
    """Every page against targets: what it passes, its problems and its score (P-18)."""
    p = parsed(load("pages")).join(load("pages").select("page_id", "html"), "page_id")
    v = validate.validate_page(F.col("page"), F.col("html"), F.lit("the"), F.lit(500), F.lit(300), F.lit(3))
    return p.select("page_id", v.alias("v")).select("page_id", "v.keyword_density", F.size("v.passed").cast("long").alias("passed"), F.size("v.problems").cast("long").alias("problems"), "v.score")


@query("select page_id as template_id, (strpos(html, '</head>') - 1)::bigint as at from pages")
def insert_points(load):
    """Where a template takes more mark-up (V-5)."""
    return templates.insert_points(load("pages").select(F.col("page_id").alias("template_id"), "html"))


@query("""with t as (select lang, median(n_chars // 6) as every, median(n_chars // 6) filter (where doc_id % 10 < 5) as top, median(doc_id % 12) as h2 from documents group by lang)
select lang, greatest(top, every, 900)::int as words, least(greatest(floor(h2)::int, 5), 9)::int as sections from t""")
def prompt_numbers(load):
    """The numbers that a writer is given: words and sections to aim at (X-3)."""
    i, n = F.col("doc_id"), F.floor(F.col("n_chars") / 6)
    t = load("documents").groupBy("lang").agg(F.median(n).alias("every"), F.median(F.when(i % 10 < 5, n)).alias("top"), F.median(i % 12).alias("h2"))
    return t.select("lang", F.floor(B.word_target(F.col("top"), F.col("every"))).cast("int").alias("words"), B.section_target(F.col("h2")).alias("sections"))
