"""Queries of the text functions over whole documents, conversations, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import scoring as S
from ..functions import text as T
from ..functions.regions import REGIONS
from ..operators import validate
from .registry import query

#: Documents with a share of Thai letters and marks that differs by id, so that both kinds of text occur.
_MIXED = "select doc_id, text || repeat('ก่า', (length(text) * (doc_id % 5)) // 30) as t from documents where text is not null"
_SOLID = "length(regexp_replace(t, '\\s+', '', 'g'))"
_THAI = "length(regexp_replace(t, '[^\\x{0E00}-\\x{0E7F}]', '', 'g'))"
_LETTERS = "length(regexp_replace(regexp_replace(t, '\\p{Mn}', '', 'g'), '[^\\x{0E00}-\\x{0E7F}]', '', 'g'))"
_PARTS = "len(list_filter(regexp_split_to_array(regexp_replace(t, '[\\x{0E00}-\\x{0E7F}]+', ' ', 'g'), '\\s+'), lambda x: x <> ''))"
_SPACED = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))"


def _mixed(load):
    d = load("documents").where("text is not null")
    n = F.floor(F.length("text") * (F.col("doc_id") % 5) / 30).cast("int")
    return d.select("doc_id", F.concat("text", F.repeat(F.lit("ก่า"), n)).alias("t"))


@query(f"with m as ({_MIXED}) select doc_id, coalesce({_THAI}::double / nullif({_SOLID}, 0), 0) >= 0.15 as unspaced, {_LETTERS}::bigint as letters from m")
def unspaced_text(load):
    """Whether a text is written without spaces, and its letters without marks (T-2, T-3)."""
    return _mixed(load).select("doc_id", T.is_unspaced(F.col("t")).alias("unspaced"), F.length(F.regexp_replace(T.strip_marks(F.col("t")), f"[^{T.THAI}]", "")).cast("long").alias("letters"))


@query(f"""with m as ({_MIXED}), e as (select doc_id, doc_id % 2 = 0 as mode, {_THAI} as thai, (round_even({_LETTERS} / 3.5, 0) + {_PARTS})::bigint as estimate, {_SPACED}::bigint as spaced from m)
select doc_id, case when mode then greatest(estimate, case when thai > 0 then 1 else 0 end) else spaced end as words from e""")
def words_by_region(load):
    """Words counted as the region writes them: every second document as unspaced text (T-5)."""
    return _mixed(load).select("doc_id", T.count_words_by_mode(F.col("t"), F.col("doc_id") % 2 == 0).alias("words"))


@query(r"select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as line from documents")
def normal_text(load):
    """Runs of white space joined (T-11)."""
    return load("documents").select("doc_id", T.squash(F.col("text")).alias("line"))


_BETWEEN = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""select page_id, md5({_BETWEEN}) as between_tags, md5(replace({_BETWEEN}, '"', '&quot;')) as double_quoted, md5(replace({_BETWEEN}, '''', '&#39;')) as single_quoted from pages""")
def escaped_markup(load):
    """Markup as text, and as an attribute in either quote (T-15)."""
    h = F.col("html")
    return load("pages").select(
        "page_id", F.md5(T.escape_between_tags(h)).alias("between_tags"), F.md5(T.escape_attribute(h, F.lit('"'))).alias("double_quoted"), F.md5(T.escape_attribute(h, F.lit("'"))).alias("single_quoted")
    )


@query(r"""with c as (select page_id, regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1) || '/* note ' || page_id || ' */ a { color : red ; } b , i > u { top : 0 ; }' as css from pages),
m as (select page_id, css, trim(replace(regexp_replace(regexp_replace(regexp_replace(css, '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'), '\s*([{}:;,>])\s*', '\1', 'g'), ';}', '}')) as min from c)
select page_id, min, length(css)::bigint as before from m""")
def minified_css(load):
    """The style of every page, shortened (T-17)."""
    css = F.concat(F.regexp_extract("html", r"(?is)<style[^>]*>(.*?)</style>", 1), F.lit("/* note "), F.col("page_id").cast("string"), F.lit(" */ a { color : red ; } b , i > u { top : 0 ; }"))
    return load("pages").select("page_id", T.minify_css(css).alias("min"), F.length(css).cast("long").alias("before"))


@query(r"""with l as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as own, contains(lower(coalesce(text, '')), 'quality') as has from documents),
p as (select doc_id, has, case when has then own else trim('Quality - ' || own) end as line from l), h as (select *, substr(line, 1, 60) as head from p),
c as (select *, case when contains(head, ' ') and 60 - strpos(reverse(head), ' ') > 36 then substr(head, 1, length(head) - strpos(reverse(head), ' ')) else head end as cut from h)
select doc_id, case when length(line) <= 60 then line else regexp_replace(cut, '[ ,.;:-]+$', '') end as line from c""")
def forced_keyword(load):
    """A missing keyword goes in front of the line, which is then cut at a word (T-20)."""
    return load("documents").select("doc_id", T.ensure_contains(F.col("text"), F.lit("Quality"), 60).alias("line"))


@query("select p_partkey, ((p_size + 9) // 10 * 10)::bigint as tens, ((length(p_name) + 249) // 250 * 250)::bigint as room from part")
def rounded_up(load):
    """Sizes up to the next step (T-24)."""
    return load("part").select("p_partkey", T.round_up(F.col("p_size"), 10).alias("tens"), T.round_up(F.length("p_name"), 250).alias("room"))


@query(r"""with n as (select conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as line, turn, role from conversations),
k as (select conv_id, line, row_number() over (partition by conv_id order by turn, role, line) as k from n where line <> '')
select conv_id, coalesce(string_agg('- ' || line, chr(10) order by k) filter (where k <= 4), '') as list from k group by conv_id""")
def bulleted_list(load):
    """The first four turns that say something, as a list (T-26)."""
    turns = load("conversations").withColumn("line", T.squash(F.col("text"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))).alias("xs"))
    out = turns.select("conv_id", T.bullets(F.transform("xs", lambda x: x["line"]), 4).alias("list"))
    return out.where("list <> ''")


@query("select doc_id, replace(lang || '_' || upper(lang), '_', '-') as tag from documents")
def language_codes(load):
    """Locales as language tags (T-27)."""
    return load("documents").select("doc_id", T.language_tag(F.concat_ws("_", "lang", F.upper("lang"))).alias("tag"))


@query("""with f as (select p_partkey, [p_brand, ' ' || p_type || ' ', '', 'Arial', 'Open Sans', 'Arial'] as fs from part), u as (select p_partkey, trim(unnest(fs)) as f, generate_subscripts(fs, 1) as k from f),
d as (select p_partkey, f, min(k) as k from u where f <> '' group by all)
select p_partkey, string_agg(case when regexp_full_match(f, '[A-Za-z0-9-]+') then f else '"' || f || '"' end, ', ' order by k) as stack from d group by p_partkey""")
def font_stacks(load):
    """Own fonts, then the region's, each once and quoted where it must be (T-28)."""
    own = F.array("p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""))
    return load("part").select("p_partkey", T.font_stack(own, F.array(F.lit("Arial"), F.lit("Open Sans"), F.lit("Arial"))).alias("stack"))


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
select doc_id, contains(lower(ls[1]), 'the') as in_title, contains(lower(ls[-1]), 'the') as in_meta, len(list_filter(ls, lambda x: length(x) < 60 and contains(lower(x), 'the'))) > 0 as in_h1 from l""")
def keyword_flags(load):
    """Whether a document's first line, last line and any short line say the keyword (T-29)."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    f = S.keyword_flags(F.get(ls, 0), F.element_at(ls, -1), F.filter(ls, lambda x: F.length(x) < 60), F.lit("the"))
    return load("documents").select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query("""select event_id, trim(case when contains(props, ':') then substr(props, 1, strpos(props, ':') - 1) else props end) as label,
case when contains(props, ':') then trim(substr(props, strpos(props, ':') + 1)) else '' end as value from events""")
def table_pairs(load):
    """Lines "label: value" in two columns (T-30)."""
    return load("events").select("event_id", T.split_pair(F.col("props")).alias("p")).select("event_id", "p.*")


@query(r"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents)
select doc_id, len(ps)::bigint as n, coalesce(ps[1], '') as intro from p""")
def intro_paragraphs(load):
    """Parts between blank lines, and the first of them (T-31); every sentence is made a paragraph here."""
    ps = T.paragraphs(F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return load("documents").select("doc_id", F.size(ps).cast("long").alias("n"), F.coalesce(F.get(ps, 0), F.lit("")).alias("intro"))


def _sections(load):
    """A section for each document: its language as heading, its lines as paragraphs, its sentences as items."""
    t = F.coalesce("text", F.lit(""))
    return load("documents").select("doc_id", F.array(F.struct(F.col("lang").alias("heading"), F.split(t, "\n").alias("paragraphs"), F.split(t, r"\. ").alias("items")), F.struct(F.lit("none").alias("heading"), F.array(F.lit(" ")).alias("paragraphs"), F.array().cast("array<string>").alias("items"))).alias("s"))


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SENTENCES = "list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"""with s as (select doc_id, len({_LINES}) as p, len({_SENTENCES}) as i from documents)
select doc_id, case when p + i > 0 then 1 else 0 end::bigint as sections, p::bigint as paragraphs, i::bigint as items from s""")
def plan_shape(load):
    """Blank paragraphs and items go, then sections with neither (T-21)."""
    n = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(x[c]))
    s = _sections(load).select("doc_id", validate.normalise_sections(F.col("s")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sections"), n("paragraphs").alias("paragraphs"), n("items").alias("items"))


_N = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"


@query(f"""select doc_id, ({_N.format("lang")} + 1 + 2 * {_N.format("coalesce(text, '')")} + len(list_filter(string_split(coalesce(text, ''), '. '), lambda x: false)))::bigint as words from documents where not contains(coalesce(text, ''), '. .')""")
def plan_word_count(load):
    """Words of all headings, paragraphs and items (A-22)."""
    return _sections(load).join(load("documents").where("not contains(coalesce(text, ''), '. .')").select("doc_id"), "doc_id").select("doc_id", validate.plan_words(F.col("s")).alias("words"))


@query("""with n as (select conv_id, text, role, case when turn % 3 = 0 then null else 9 - turn end as p, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
o as (select conv_id, text, coalesce(p, k) as p, k from n where role <> 'system')
select conv_id, md5(string_agg(p || '=' || text, '|' order by p, k)) as plan from o where text is not null group by conv_id""")
def action_order(load):
    """Steps by priority; one without gets its place (W-7)."""
    c = load("conversations").withColumn("p", F.when(F.col("turn") % 3 == 0, None).otherwise(9 - F.col("turn")).cast("int"))
    said = F.when(F.col("role") != "system", F.col("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "p", said.alias("said")))).alias("xs"))
    items = F.transform("xs", lambda x: F.struct(x["p"].alias("priority"), x["said"].alias("title")))
    out = rows.select("conv_id", validate.action_plan(items).alias("plan")).where(F.size("plan") > 0)
    return out.select("conv_id", F.md5(F.array_join(F.transform("plan", lambda x: F.concat(x["priority"].cast("string"), F.lit("="), x["title"])), "|")).alias("plan"))


@query("""select o_orderkey, array_to_string(list_transform(range(0, 4), lambda i: strftime(o_orderdate::date - (3 * i)::int, '%Y-%m-%d')), ',') as dates from orders""")
def spread_dates(load):
    """The order's date and three before it, three days apart (W-16)."""
    d = dates.spread_dates(F.to_date("o_orderdate"), 4)
    return load("orders").select("o_orderkey", F.array_join(F.transform(d, dates.iso_date), ",").alias("dates"))


@query("""with c as (select doc_id, case when doc_id % 3 = 0 then 'th' when doc_id % 3 = 1 then '' else ' ID ' end as code, coalesce(text, '') || repeat('ก', (length(text) * (doc_id % 4)) // 8) as t from documents where text is not null),
n as (select *, coalesce(nullif(lower(trim(code)), ''), 'id') as region from c)
select doc_id, region, case region when 'th' then 'Thailand' else 'Indonesia' end as label, not (region = 'th' and coalesce(length(regexp_replace(t, '[^ก]', '', 'g'))::double / nullif(length(regexp_replace(t, '\\s+', '', 'g')), 0), 0) < 0.4) as language_ok from n""")
def region_language(load):
    """Each document with its region's row, and whether it is written in the region's script (P-20, P-38, J-7)."""
    from ..functions.regions import regions
    from ..operators.joins import region_join

    d = load("documents").where("text is not null")
    n = F.floor(F.length("text") * (F.col("doc_id") % 4) / 8).cast("int")
    code = F.when(F.col("doc_id") % 3 == 0, "th").when(F.col("doc_id") % 3 == 1, "").otherwise(" ID ")
    rows = d.select("doc_id", code.alias("code"), F.concat("text", F.repeat(F.lit("ก"), n)).alias("t"))
    out = region_join(rows, F.col("code"), regions(d.sparkSession))
    return out.select("doc_id", "region", "label", validate.language_ok(F.col("t"), F.col("word_mode") == "unspaced").alias("language_ok"))


@query("select r_regionkey, r_regionkey % 2 = 0 as known from region")
def region_known(load):
    """Codes that name a region (P-38)."""
    codes = [r[0] for r in REGIONS]
    return load("region").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, codes[-1]).otherwise("xx").isin(codes).alias("known"))


@query("""with l as (select doc_id, length(coalesce(text, '')) as n from documents)
select doc_id, case when n = 0 then 'text missing' when n < 300 then 'text too short (' || n || ' < 300)' when n > 5000 then 'text too long (' || n || ' > 5000)' end as problem from l""")
def length_problem(load):
    """What is wrong with a length (P-17)."""
    return load("documents").select("doc_id", S.length_check("text", F.length(F.coalesce("text", F.lit(""))), 300, 5000).alias("problem"))


@query("""select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1) as known, coalesce(try_cast(case when event_id % 3 = 0 then 'n/a' else event_id::varchar end as double), 7.5) as shaped from events""")
def safe_numbers(load):
    """Numbers, or a default (P-31); a nested value by path, or a default (P-32)."""
    path = F.get_json_object("props", "$.k")
    shaped = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return load("events").select("event_id", T.number(path, -1.0).alias("known"), T.number(shaped, 7.5).alias("shaped"))
