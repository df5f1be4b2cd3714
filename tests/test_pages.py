from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.functions import scoring as S
from pagelens.functions import urls as U
from pagelens.operators import amp, html_pages, templates, validate

FULL = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A  page about
 testing &amp; more</title><meta name="Description" content="What it says"><meta name="robots" content="noindex"><link rel="canonical" href="/c">
<link rel="amphtml" href="/amp"><meta property="og:title" content="x"><meta name="viewport" content="width=device-width">
<script type="application/ld+json">{"@graph":[{"@type":"FAQPage","mainEntity":[{"@type":["Question","Thing"]}]}]}</script>
<script type="application/ld+json">{broken</script><style>p{margin:0}</style></head>
<body itemtype="http://schema.org/Article"><h1>One</h1><h2>Is it?</h2><h3></h3><img src="a.png"><img src="b.png" alt=" "><img src="c.png" alt="ok">
<p><b>bold<br><p>inner</p> tail<ul><li>1<li>2</ul><table></table>
<a href="/x#f">x</a><a href="http://other.example/y">y</a><a href="#z">z</a><a href="mailto:a@b">m</a><a href="/x">again</a><noscript>hidden</noscript></body></html>"""


def test_page_facts():
    p = html_pages.page_facts(FULL, "http://Site.example/dir/")
    assert p["title"] == "A page about testing & more" and p["meta_description"] == "What it says" and p["robots_meta"] == "noindex"
    assert p["canonical"] == "http://Site.example/c" and p["h1"] == ["One"] and p["h3"] == [""]
    assert p["images_without_alt"] == ["http://Site.example/dir/a.png", "http://Site.example/dir/b.png"] and p["image_count"] == 3
    assert p["internal"] == ["http://Site.example/x"] and p["external"] == ["http://other.example/y"]
    # Nothing closes by itself: the outer paragraph holds the inner one and all that follows.
    assert p["paragraphs"][0].startswith("bold inner tail 1 2") and p["paragraphs"][1] == "inner"
    assert "hidden" not in p["visible_text"] and "broken" not in p["visible_text"]
    s = p["signals"]
    assert s["schema_types"] == ["Article", "FAQPage", "Question", "Thing"] and s["has_faq"] and s["questions"] == ["Is it?"]
    assert s["has_amp_version"] and s["amp_url"] == "/amp" and not s["is_amp"] and s["table_count"] == 1 and s["list_count"] == 1
    assert s["list_item_count"] == 1 and s["has_viewport"] and s["open_graph_count"] == 1 and s["script_count"] == 2 and s["inline_style_bytes"] == 11


def test_parse_keeps_failed_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b", FULL), (2, "http://a.b", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_pages.parse_pages(df).collect()}
    assert got[1].status == "ok" and got[1].page.h1_count == 1 and got[2].page.word_count == 0


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scores(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    # A page with five h1 and no keyword in them; a title and description that are too short, no canonical.
    assert one(spark, S.heading_score(arr("a", "b", "c", "d", "e"), arr("python", "x", "y"), arr("z"), F.lit("python"))) == 75
    measures = [F.lit(x) for x in (20, 50, 5, 1149, 0, 10)]
    assert one(spark, S.page_score(S.DEFAULT_RULES, *measures, F.lit(""), F.lit(""))) == 80
    assert one(spark, S.page_score(S.LEGACY_RULES, *measures, F.lit(""), F.lit(""))) == 82
    assert one(spark, F.array_join(S.page_problems(S.DEFAULT_RULES, *measures, F.lit(""), F.lit("")), ",")) == "title,meta,h1,canonical"


def test_hijack(spark):
    def score(**k):
        base = dict(cloak=False, only_bot=False, kind="other", parasite=False, root_checked=False, root_hits=0, root_density=0.0, density=0.0) | k
        return tuple(one(spark, S.hijack_parts(*[F.lit(v) for v in base.values()])))

    assert score(kind="institutional", density=2.0) == (35, False, False)
    assert score(kind="institutional", density=7.0) == (75, True, True)
    assert score(cloak=True, only_bot=True) == (75, True, True)
    assert score(kind="ngo", density=7.0) == (30, False, False)
    assert score(parasite=True) == (30, True, False)
    assert score(parasite=True, root_checked=True, root_hits=3, root_density=1.0) == (0, False, False)
    assert score(cloak=True, only_bot=True, kind="institutional", density=9.0) == (100, True, True)


def test_hosts_and_addresses(spark):
    p = lambda h: tuple(one(spark, U.host_parts(F.lit(h))))
    assert p("slot.shop.example.com") == ("slot.shop", "example.com") and p("a.b.co.uk") == ("a", "b.co.uk") and p("x.org") == ("", "x.org")
    asked = spark.createDataFrame([("10.1.2.3",), ("127.0.0.1",), ("8.8.8.8",), ("bad",), ("2001:db8::5",)], "ip string")
    listed = spark.createDataFrame([("10.0.0.0/8",), ("2001:db8::/32",), ("oops",)], "entry string")
    got = {r.ip: r.allowed for r in U.allowed(asked, "ip", listed, "entry").collect()}
    assert got == {"10.1.2.3": True, "127.0.0.1": True, "8.8.8.8": False, "bad": False, "2001:db8::5": True}


TEMPLATE = """<html lang=en><head><title>Old</title><meta name="description" content="d &quot;q&quot;"></head><body><nav><p>menu text that is long enough to be a paragraph here</p></nav>
<h1>Head</h1><div class="faq"><h2>Questions</h2><div><h3>Why?</h3><p>Because</p></div><div><h3>How?</h3><p>So</p></div></div>
<div class="ads"><p>never touch this advert text, whatever its length may be</p></div><p>A paragraph of text that is more than forty characters.</p>
<a href="/k"><h2>Linked</h2></a><script>var x = "<p>no</p>";</script><img alt='pic' src=i.png><p data-slot="caption">note</p><p data-slot="skip">price</p></body></html>"""


def test_templates(spark):
    df = spark.createDataFrame([(1, TEMPLATE)], "template_id long, html string")
    slots = templates.slot_map(templates.scan_slots(df)).cache()
    got = Counter(r.role for r in slots.collect())
    assert got == Counter(title=1, meta_description=1, h1=1, heading=1, faq_question=2, faq_answer=2, paragraph=1, caption=2)
    content = spark.createDataFrame([("title", 1, "N<ew"), ("faq_question", 1, "Q1"), ("faq_question", 2, "Q2"), ("caption", 1, "it's")], "role string, ordinal int, text string")
    out = templates.fill(df, templates.build_edits(slots, content)).first()
    assert out.violations == [] and "<title>N&lt;ew</title>" in out.filled and "<h3>Q1</h3>" in out.filled and "alt='it&#39;s'" in out.filled
    assert "never touch this advert" in out.filled and templates.insert_point(TEMPLATE) == TEMPLATE.index("</head>")


def test_template_guards():
    with pytest.raises(templates.TooDeep):
        templates.Scanner("<div>" * 201)
    with pytest.raises(ValueError):
        templates.apply_edits("abcdef", [dict(start=0, end=3, kind="text", quote="", text="x"), dict(start=2, end=4, kind="text", quote="", text="y")])
    assert templates.verify("<a href='x'>t</a>", "<a href='y'>t</a>", []) == ["lost links", "lost signatures", "text between edits"]
    assert templates.verify("<p>t</p>", "<p>u</p>", [dict(start=3, end=4, kind="text", quote="", text="u")]) == []


def test_amp():
    good = """<!doctype html><html ⚡ lang="en"><head><meta charset="utf-8"><script async src="https://cdn.ampproject.org/v0.js"></script><link rel="canonical" href="x">
<meta name="viewport" content="width=device-width"><style amp-boilerplate></style><noscript><style amp-boilerplate></style></noscript><style amp-custom>a{b:c}</style></head><body>ok</body></html>"""
    assert amp.check(good) == {"valid": True, "errors": [], "warnings": [], "css_bytes": 6}
    bad = {"<body><img src=x>": "img", '<body><i style="x">': "inline-style", '<body><p onclick = "x">': "handler", "<body><script>1</script>": "script", "<body><form>": "form"}
    for new, rule in bad.items():
        assert amp.check(good.replace("<body>", new))["errors"] == [rule]
    swaps = {
        "a{b:c}": ("a{b:c ! important}", "important"), 'charset="utf-8"': ("name=x", "charset"), "<!doctype html>": ("", "doctype"), " ⚡": ("", "amp-attribute"), "v0.js": ("v1.js", "runtime"),
        "width=device-width": ("width=5", "viewport"), '<link rel="canonical" href="x">': ("", "canonical"), "<noscript><style amp-boilerplate></style></noscript>": ("", "boilerplate"), "ok": ("ok<style amp-custom></style>", "one-style"),
    }
    for old, (new, rule) in swaps.items():
        assert amp.check(good.replace(old, new))["errors"] == [rule]
    assert amp.check(good, 5)["errors"] == ["css-size"] and amp.check(good.replace(' lang="en"', ""))["warnings"] == ["lang"]
    assert "head" in amp.check("")["errors"]

def test_design(spark):
    css = "a{color:#fff;background:#0B0F19;border-radius:8px;font-family:'Open Sans', Arial} b{color:rgb(11,15,25);border-radius:8px;border-radius:99px;font-family:inherit,Roboto}"
    df = spark.createDataFrame([(1, css)], "k long, css string")
    ranked = [(r.bucket, r["rank"], r.color, r.n) for r in templates.palette(df, "k", "css").orderBy("bucket", "rank").collect()]
    assert ranked == [("dark", 1, "#0b0f19", 2), ("light", 1, "#ffffff", 1)]
    assert df.select(templates.corner_radius(F.col("css")).alias("r"), templates.fonts(F.col("css")).alias("f")).first()[:] == (8, ["Open Sans", "Roboto"])
    assert templates.design(templates.palette(df, "k", "css"), "k").first().background == "#0b0f19"


def test_validate_page(spark):
    df = spark.createDataFrame([(1, "http://a.b/", FULL)], "page_id long, url string, html string")
    parsed = html_pages.parse_pages(df).join(df.select("page_id", "html"), "page_id")
    v = parsed.select(validate.validate_page(F.col("page"), F.col("html"), F.lit("page"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("v")).first().v
    assert "keyword in title" in v.passed and "keyword in h1" in v.problems and "faq schema" in v.passed and 0 < v.score < 100


def test_domain_of_odd_tails(spark):
    """A second # or characters that no URL may have come after the authority, which is told all the same."""
    urls = ["https://www.A.org/p#top#12", "http://b.org?x=1|2#a b", "https://c.org", "no address", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.domain(F.col("u")).alias("d")).collect()
    assert [r.d for r in got] == ["a.org", "b.org", "c.org", None, None]


def test_references_without_semicolon(spark):
    """Browsers read them; queries take them as text, in titles, attributes and scripts alike."""
    html = '<title>a &amp;&lt;b &amp</title><a href="/x?a=1&copy=2&amp;b">&copy; &am &ampx</a><script>a && b &amp c</script>'
    assert html_pages.page_facts(html, "http://a.b/")["title"] == "a &<b &"
    t = html_pages.Tree(html, unclosed=False)
    assert t.text(0) == "a &<b &amp" and t.attrs[1]["href"] == "/x?a=1&copy=2&b" and t.text(1) == "© &am &ampx" and t.raw(2) == "a && b &amp c"
    df = spark.createDataFrame([(1, "http://a.b", html)], "page_id long, url string, html string")
    assert html_pages.parse_pages(df, unclosed=False).first().page.title_length == 10


def test_deep_templates(spark):
    """Elements are counted and the end of the head is found at any depth."""
    html = "<head></head>" + "<b>" * 300 + "</b>"
    df = spark.createDataFrame([(1, html)], "template_id long, html string")
    assert {(r.tag, r.n) for r in templates.fingerprints(df).collect()} == {("head", 1), ("b", 300)}
    assert templates.insert_points(df).first().at == 6 and templates.verify(html, html, []) == []


def test_pages_are_parsed_some_at_a_time(spark):
    """A batch of Spark's is cut, so that a worker holds the facts of few pages; none is lost."""
    assert html_pages.PARSED_AT_ONCE <= 100
    df = spark.range(0, 3 * html_pages.PARSED_AT_ONCE + 1, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a.b").alias("url"), F.concat(F.lit("<title>"), F.col("id").cast("string")).alias("html"))
    assert {r.page_id: r.title for r in html_pages.parse_pages(df).select("page_id", "page.title").collect()} == {i: str(i) for i in range(3 * html_pages.PARSED_AT_ONCE + 1)}


def deep_pages(spark, tmp_path):
    """For a query's name its rows and its SQL's, over pages whose elements aren't closed."""
    import duckdb

    from pagelens import catalog

    html = '<html lang="id"><head><title>t</title></head><body>' + '<p class="x"><b>word' * 150 + "<h1>" + "h" * 50 + "</h1></body></html>"
    spark.createDataFrame([(1, "http://a.b/", html), (2, "http://a.b/", html.replace('<p class="x"><b>', "<p>", 149))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    return lambda name: (sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())), sorted(con.execute(catalog.ORACLE[name]).fetchall()))


def test_deep_pages_are_filled(spark, tmp_path):
    got, want = deep_pages(spark, tmp_path)("template_fill")
    assert got == want


def test_slots_keep_what_is_around_them_at_any_depth():
    """What a slot keeps of the elements around it doesn't grow with their number; closed ones don't count."""
    html = '<nav class="faq"><p class="faq">a</p></nav>' + '<div class="review x"><a>' * 500 + "deep" + "</a></div>" * 500 + '<p id="by">b'
    first, deep, last = templates.Scanner(html, deepest=None).slots
    assert (first["around"], first["near"], first["own"]) == (["nav"], ["faq"], ["faq"])
    assert (deep["around"], deep["near"], deep["own"], deep["depth"]) == (["a"], ["review"], [], 1000)
    assert (last["around"], last["near"], last["own"]) == ([], ["author"], ["author"])


def test_deep_pages_have_heads(spark, tmp_path):
    got, want = deep_pages(spark, tmp_path)("template_heads")
    assert got == want and len(got) == 6


def test_deep_pages_are_summed_up(spark, tmp_path):
    """No page is too deep for the query; the library's own limit stays where it is asked for."""
    got, want = deep_pages(spark, tmp_path)("template_summary")
    assert got == want == [(1, 0, False), (2, 0, False)]
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet").selectExpr("page_id as template_id", "html")
    assert {r.template_id: r.too_deep for r in templates.summary(templates.scan_slots(pages)).collect()} == {1: True, 2: False}


def test_sections_of_long_pages():
    """All sections count, and what is far behind a heading tells its kind."""
    html = "<body><h2>a</h2>" + "<p>x</p>" * 600 + "<li>" * 4 + "<h3>s</h3>" + "<h1>b</h1>" * 30 + "<p>x</p>" * 600 + "<table></table>"
    got = html_pages.sections(html_pages.Tree(html))
    assert [s["position"] for s in got] == list(range(1, 32))
    assert (got[0]["kind"], got[0]["subheadings"], got[1]["kind"], got[-1]["kind"]) == ("list", 1, "paragraph", "table")
