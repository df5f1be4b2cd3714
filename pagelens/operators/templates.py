"""Page templates: slots by position, their roles, edits in place, and proof that nothing else changed.

Scanning, editing and verifying work on character positions of the source, so the
parts that aren't edited stay byte for byte. Roles are Column expressions over the
scanned slots.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import length_budget
from ..sources.shared import workers_find_us
from .html_pages import VOID

MAX_DEPTH = 200
# Elements and attributes by treatment.
OPAQUE = {"script", "style", "noscript", "template", "svg", "canvas", "code", "pre", "textarea"}
EMPTY = VOID | {"amp-img", "amp-pixel"}
AD_TAGS = {"ins", "amp-ad", "amp-embed", "amp-analytics", "amp-pixel"}
AD_MARK = re.compile(r"adsbygoogle|googlesyndication|googletag|data-ad-|\bads?\b|\badslot\b|banner|sponsor|propeller|adsterra", re.I)
FILLABLE = {("meta", "content"), ("img", "alt"), ("amp-img", "alt"), ("time", "datetime"), ("a", "title"), ("html", "lang"), ("meta", "charset")}
CHROME = ["nav", "header", "footer", "aside", "menu"]
NEVER = ["a", "button", "label", "option", "th", "abbr"]
AROUND = [*CHROME, *NEVER]
ROLES = ["title", "meta_description", "meta_keywords", "h1", "heading", "paragraph", "faq_question", "faq_answer", "review_text", "review_author", "review_date", "caption", "date", "lang"]
META_ROLES = {"description": "meta_description", "keywords": "meta_keywords", "og:description": "meta_description", "twitter:description": "meta_description", "og:title": "title", "twitter:title": "title"}
HINTS = {
    "faq": r"faq|accordion|question|tanya|pertanyaan|คำถาม", "review": r"review|testimoni|ulasan|rating|comment|รีวิว",
    "author": r"author|name|user|nama|reviewer|by\b|ผู้", "date": r"date|time|tanggal|waktu|posted|วันที่", "caption": r"caption|figcaption|keterangan",
}
#: Prefix of the attributes by which an author marks roles and parts to skip.
MARK = "data-slot"
# Attributes whose change is a change of structure.
SIGNATURE = ["href", "src", "srcset", "class", "id", "layout", "width", "height", "type", "rel", "data-ad-client", "data-ad-slot"]

_ATTR = re.compile(r"""([^\s=/>"']+)(\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


class TooDeep(ValueError):
    pass


class Scanner(HTMLParser):
    """Slots (text and fillable attributes), elements, and end tags with their positions.

    A template nested over ``deepest`` deep is refused; with None, or without slots, any is read. What
    lies around a slot is kept as the kinds that roles ask for, so a slot takes no more room when deeper.
    """

    def __init__(self, source: str, slots: bool = True, deepest: int | None = MAX_DEPTH):
        super().__init__(convert_charrefs=False)
        self.source = source
        self.line_at = [0]
        for m in re.finditer("\n", source):
            self.line_at.append(m.end())
        self.deepest = deepest if slots else None
        self.open: list[dict] = []
        self.opened: Counter = Counter()  # open elements by name
        self.hinted: Counter = Counter()  # open elements by what they hint at
        self.slots: list[dict] = []
        self.elements: list[dict] = []
        self.ends: list[dict] = []
        self.text_from: int | None = None
        self.muted = 0 if slots else 1  # open elements that are opaque or advertising
        self.ads = 0
        self.feed(source)
        self._flush(len(source))
        self.close()

    def _here(self) -> int:
        line, column = self.getpos()
        return self.line_at[line - 1] + column

    def _slot(self, kind: str, start: int, end: int, tag: str, attrs: dict, attr: str, quote: str, element: int) -> None:
        own = _hints(attrs)
        self.slots.append({
            "kind": kind, "start": start, "end": end, "current": self.source[start:end], "tag": tag, "attrs": attrs, "attr": attr, "quote": quote,
            "around": [t for t in AROUND if self.opened.get(t)], "near": [h for h in HINTS if self.hinted.get(h) or h in own], "own": list(own), "in_ad": self.ads > 0, "depth": len(self.open), "element": element,
        })

    def _flush(self, end: int) -> None:
        start, self.text_from = self.text_from, None
        if start is None or not self.source[start:end].strip():
            return
        top = self.open[-1] if self.open else {"tag": "", "attrs": {}, "index": -1}
        self._slot("text", start, end, top["tag"], top["attrs"], "", "", top["index"])

    def handle_data(self, data):
        if not self.muted and self.text_from is None:
            self.text_from = self._here()

    def handle_entityref(self, name):
        self.handle_data(name)

    handle_charref = handle_entityref

    def _element(self, tag, attrs) -> dict:
        at = self._here()
        self._flush(at)
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        ad = tag in AD_TAGS or bool(AD_MARK.search(" ".join([tag, *own, *(own.get(k, "") for k in ("class", "id", "data-ad-client", "type"))])))
        e = {"tag": tag, "attrs": own, "start": at, "is_ad": ad, "index": len(self.elements), "hints": ()}
        self.elements.append(e)
        if not self.muted:
            raw, seen = self.get_starttag_text() or "", set()
            for m in _ATTR.finditer(raw, len(tag) + 1):
                name = m[1].lower()
                group = next((g for g in (3, 4, 5) if m[g] is not None), None)
                if group is None or name in seen:
                    continue
                seen.add(name)
                if (tag, name) in FILLABLE and m.end(group) > m.start(group):
                    self._slot("attribute", at + m.start(group), at + m.end(group), tag, own, name, {3: '"', 4: "'", 5: ""}[group], e["index"])
        return e

    def handle_starttag(self, tag, attrs):
        e = self._element(tag, attrs)
        if tag in EMPTY:
            return
        if self.deepest is not None and len(self.open) >= self.deepest:
            raise TooDeep(f"elements are nested over {self.deepest} deep")
        self.open.append(e)
        self.opened[tag] += 1
        if not self.muted and e["attrs"]:  # what is muted has no slots in it
            e["hints"] = _hints(e["attrs"])
            self.hinted.update(e["hints"])
        self.muted += (tag in OPAQUE) + e["is_ad"]
        self.ads += e["is_ad"]

    def handle_startendtag(self, tag, attrs):
        self._element(tag, attrs)

    def handle_endtag(self, tag):
        at = self._here()
        self._flush(at)
        self.ends.append({"tag": tag, "start": at})
        if self.opened.get(tag):
            while self.open:
                e = self.open.pop()
                self.opened[e["tag"]] -= 1
                if e["hints"]:
                    self.hinted.subtract(e["hints"])
                self.muted -= (e["tag"] in OPAQUE) + e["is_ad"]
                self.ads -= e["is_ad"]
                if e["tag"] == tag:
                    break

    def _other(self, _):
        self._flush(self._here())

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def _hints(attrs: dict) -> tuple[str, ...]:
    """What an element's names hint at."""
    return _hinted(" ".join(attrs.get(k, "") for k in ("class", "id", "itemprop")))


@lru_cache(4096)
def _hinted(names: str) -> tuple[str, ...]:
    return tuple(h for h, x in HINTS.items() if re.search(x, names, re.I)) if names.strip() else ()


SLOT = (
    "template_id long, kind string, start long, end long, current string, tag string, attrs map<string,string>, attr string, quote string, around array<string>, "
    "near array<string>, own array<string>, in_ad boolean, depth long, element long"
)


def scan_slots(templates: DataFrame, deepest: int | None = MAX_DEPTH) -> DataFrame:
    """A row for each slot of each template (template_id, html).

    A template nested over ``deepest`` deep gives one row of kind "too deep", which has no role; with None every one is read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SLOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    found = Scanner(r["html"] or "", deepest=deepest).slots
                except TooDeep:
                    found = [dict.fromkeys(schema.names) | {"kind": "too deep", "attrs": {}, "current": "", "tag": "", "attr": "", "quote": "", "around": [], "near": [], "own": [], "in_ad": True}]
                rows = [{**s, "template_id": r["template_id"], "attrs": list(s["attrs"].items())} for s in found]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    workers_find_us(templates.sparkSession)
    return templates.select("template_id", "html").mapInArrow(run, SLOT)


def role() -> Column:
    """The role of a slot, or an empty string where it must not be touched."""
    c = F.col
    own = lambda h: F.array_contains("own", h)
    near = lambda h: F.array_contains("near", h)
    tag_in = lambda *ts: c("tag").isin(*ts)
    among = lambda ts: F.arrays_overlap("around", F.array(*map(F.lit, ts)))
    long = F.length(F.trim("current")) >= 40
    entries = F.map_entries("attrs")
    skip = F.exists(entries, lambda e: F.lower(e["key"]).isin(MARK + "-skip", MARK) & F.lower(e["value"]).isin("skip", "", "no", "false"))
    marked = F.lower(F.trim(F.coalesce(F.try_element_at("attrs", F.lit(MARK)), F.lit(""))))
    name = F.lower(F.trim(F.coalesce(F.nullif(F.try_element_at("attrs", F.lit("name")), F.lit("")), F.try_element_at("attrs", F.lit("property")), F.lit(""))))
    meta = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in META_ROLES.items() for x in kv]), name), F.lit(""))
    attribute = (
        F.when((c("tag") == "html") & (c("attr") == "lang"), "lang").when(c("tag") == "meta", meta)
        .when(c("attr") == "datetime", F.when(near("review"), "review_date").otherwise("date")).when(c("attr") == "alt", "caption").otherwise("")
    )
    review = (
        F.when(own("author"), "review_author").when(own("date"), "review_date").when(c("tag") == "h2", "heading")
        .when(tag_in("p", "blockquote", "q") | long, "review_text").otherwise("")
    )
    text = (
        F.when(tag_in(*NEVER) | among(NEVER), "").when(c("tag") == "title", "title").when(c("tag") == "h1", "h1").when(among(CHROME), "")
        .when(c("tag") == "time", F.when(near("review"), "review_date").otherwise("date")).when(c("tag") == "summary", "faq_question")
        .when((c("tag") == "figcaption") | near("caption"), "caption").when(near("review"), review)
        .when(near("faq") & tag_in("h2", "h3", "h4", "h5", "dt", "strong", "b"), "faq_question").when(near("faq") & tag_in("p", "div", "dd", "span"), "faq_answer")
        .when(tag_in("h2", "h3", "h4"), "heading").when(tag_in("p", "li") & long, "paragraph").otherwise("")
    )
    return F.when(c("in_ad") | skip, "").when(marked.isin(*ROLES), marked).when(c("kind") == "attribute", attribute).otherwise(text)


def slot_map(slots: DataFrame) -> DataFrame:
    """Adds role, ordinal within it, and budget; unquoted attributes keep no role; block titles are headings."""
    from pyspark.sql import Window

    from .ranking import demote_block_title

    named = slots.withColumn("role", F.when((F.col("kind") == "attribute") & (F.col("quote") == ""), "").otherwise(role()))
    named = demote_block_title(named, "template_id").where("role <> ''")
    named = named.withColumn("budget", length_budget(F.col("current"), F.col("role")))
    return named.withColumn("ordinal", F.row_number().over(Window.partitionBy("template_id", "role").orderBy("start")))


def build_edits(slots: DataFrame, content: DataFrame) -> DataFrame:
    """template_id, start, end, kind, quote, text: the n-th slot of a role takes its n-th text; a role with one text fans out to all."""
    several = content.groupBy("role").agg(F.count("*").alias("_n"))
    own = content.join(several, "role")
    exact = slots.join(own.where("_n > 1").drop("_n"), ["role", "ordinal"])
    fan = slots.join(own.where("_n = 1").select("role", "text"), "role")
    cols = ["template_id", "start", "end", "kind", "quote", "text"]
    return exact.select(*cols).unionAll(fan.select(*cols))


# -- edits ------------------------------------------------------------------------


def replacement(edit: dict) -> str:
    text = edit["text"]
    if edit["kind"] == "raw":
        return text
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if edit["kind"] == "attribute":
        if not edit["quote"]:
            raise ValueError("an unquoted attribute can't be filled")
        out = out.replace('"', "&quot;") if edit["quote"] == '"' else out.replace("'", "&#39;")
    return out


def apply_edits(html: str, edits: list[dict]) -> str:
    parts, at = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], e["end"])):
        if e["start"] < at:
            raise ValueError(f"edits overlap at {e['start']}")
        parts += [html[at : e["start"]], replacement(e)]
        at = e["end"]
    return "".join([*parts, html[at:]])


def insert_point(html: str) -> int:
    """Before the first </head>, else the first </body>, else at the end, as the parser sees them."""
    ends = Scanner(html, slots=False).ends
    for tag in ("head", "body"):
        at = [e["start"] for e in ends if e["tag"] == tag]
        if at:
            return min(at)
    return len(html)


def insert_points(templates: DataFrame) -> DataFrame:
    """template_id, at: where a template takes more mark-up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [insert_point(html or "") for html in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(at, pa.int64())], ["template_id", "at"])

    workers_find_us(templates.sparkSession)
    return templates.select(F.col("template_id").cast("long").alias("template_id"), "html").mapInArrow(run, "template_id long, at long")


# -- verification -------------------------------------------------------------------


def fingerprint(html: str) -> dict:
    es = Scanner(html, slots=False).elements
    sign = lambda e: "|".join([e["tag"], *(f"{k}={e['attrs'][k]}" for k in SIGNATURE if k in e["attrs"])])
    return {
        "order": [e["tag"] for e in es],
        "links": Counter(e["attrs"]["href"] for e in es if "href" in e["attrs"]),
        "sources": Counter(e["attrs"]["src"] for e in es if "src" in e["attrs"]),
        "ads": Counter(sign(e) for e in es if e["is_ad"]),
        "signatures": Counter(sign(e) for e in es),
    }


def verify(original: str, filled: str, edits: list[dict], allow: Counter | None = None) -> list[str]:
    """What changed that must not: tag order, lost links, sources, ads or signatures, text between edits."""
    a, b = fingerprint(original), fingerprint(filled)
    allow = allow or Counter()
    out = []
    grown = list(b["order"])
    for tag, n in allow.items():
        for _ in range(min(n, grown.count(tag) - a["order"].count(tag))):
            grown.reverse()
            grown.remove(tag)
            grown.reverse()
    if a["order"] != grown and Counter(a["order"]) != Counter(grown):
        out.append("tags")
    elif not allow and a["order"] != b["order"]:
        out.append("order")
    out += [f"lost {k}" for k in ("links", "sources", "ads", "signatures") if a[k] - b[k]]
    return out + ([] if untouched(original, filled, edits) else ["text between edits"])


def untouched(original: str, filled: str, edits: list[dict]) -> bool:
    at, pos = 0, 0
    for e in sorted(edits, key=lambda e: (e["start"], e["end"])):
        gap = original[at : e["start"]]
        if filled[pos : pos + len(gap)] != gap:
            return False
        pos += len(gap) + len(replacement(e))
        at = e["end"]
    return filled[pos:] == original[at:]


def fill(templates: DataFrame, edits: DataFrame) -> DataFrame:
    """template_id, filled, violations: applies each template's edits and verifies the result."""
    cols = ["start", "end", "kind", "quote", "text"]
    grouped = edits.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("edits"))
    both = templates.select("template_id", "html").join(grouped, "template_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own, html = r["edits"] or [], r["html"] or ""
                try:
                    filled = apply_edits(html, own)
                    rows.append((r["template_id"], filled, verify(html, filled, own)))
                except ValueError as e:
                    rows.append((r["template_id"], None, [str(e)]))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["template_id", "filled", "violations"])

    workers_find_us(both.sparkSession)
    return both.mapInArrow(run, "template_id long, filled string, violations array<string>")


def summary(slots: DataFrame) -> DataFrame:
    """template_id, total, unquoted (attributes that can't be filled), skipped (slots without a role), too_deep: of each template that has slots."""
    unquoted = (F.col("kind") == "attribute") & (F.col("quote") == "")
    deep = F.col("kind") == "too deep"
    named = slots.withColumn("_r", role())
    return named.groupBy("template_id").agg(
        F.count_if(~deep).alias("total"), F.count_if(unquoted & (F.col("_r") != "")).alias("unquoted"), F.count_if(~deep & (F.col("_r") == "")).alias("skipped"), F.max(deep).alias("too_deep")
    )


def fingerprints(templates: DataFrame) -> DataFrame:
    """template_id, tag, n: elements of each template by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += [(r["template_id"], tag, n) for tag, n in Counter(e["tag"] for e in Scanner(r["html"] or "", slots=False).elements).items()]
            yield pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], ["template_id", "tag", "n"])

    workers_find_us(templates.sparkSession)
    return templates.select("template_id", "html").mapInArrow(run, "template_id long, tag string, n long")


def collected_css(parsed: DataFrame, sheets: DataFrame, limit: int = 400_000) -> DataFrame:
    """page_id, css: each page's own styles and its host's linked stylesheets, found in a table (url, css).

    Sheets longer than ``limit`` characters are cut there, as a fetch with that limit would.
    """
    linked = parsed.select("page_id", F.posexplode("page.stylesheets").alias("pos", "sheet")).join(sheets.select(F.col("url").alias("sheet"), F.col("css").alias("_c")), "sheet")
    more = linked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.left("_c", F.lit(limit)).alias("c")))).alias("_more"))
    both = parsed.select("page_id", F.col("page.css").alias("_own")).join(more, "page_id", "left")
    return both.select("page_id", F.array_join(F.filter(F.concat(F.array("_own"), F.coalesce(F.transform("_more", lambda x: x["c"]), F.array().cast("array<string>"))), lambda x: x != ""), "\n").alias("css"))


def template_record(parsed: DataFrame, sheets: DataFrame) -> DataFrame:
    """What a page's template is made of: design, structure, and lengths, a row for each page that could be parsed."""
    css = collected_css(parsed, sheets)
    look = design(palette(css, "page_id", "css"), "page_id")
    own = parsed.where("status = 'ok'").select(
        "page_id", "url", "page.sections", F.size("page.sections").cast("long").alias("section_count"), F.transform("page.sections", lambda x: x["kind"]).alias("section_types"),
        "page.signals.has_faq", "page.signals.schema_types", F.col("page.title_length").alias("title_length"), F.col("page.meta_description_length").alias("meta_length"),
    )
    with_css = own.join(css, "page_id").withColumns({"radius": corner_radius(F.col("css")), "fonts": fonts(F.col("css")), "css_bytes": F.octet_length("css").cast("long")})
    return with_css.drop("css").join(look, "page_id", "left")


# -- design: colours, fonts, corners ------------------------------------------------

GENERIC_FONTS = ["inherit", "initial", "unset", "serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"]


def palette(pages: DataFrame, key: str, css: str, top: int = 40) -> DataFrame:
    """key, bucket (dark, light, accent), rank, color, n: colours by use, as far as the top ones go."""
    from pyspark.sql import Window

    from ..functions.scoring import channel, luminance, saturation

    hexes = F.regexp_extract_all(css, F.lit(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"), F.lit(1))
    rgbs = F.filter(
        F.transform(F.regexp_extract_all(css, F.lit(r"(?i)rgba?\(\s*([0-9]{1,3}\s*,\s*[0-9]{1,3}\s*,\s*[0-9]{1,3})"), F.lit(1)), lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda v: v.cast("int"))),
        lambda v: F.forall(v, lambda x: x <= 255),
    )
    from_hex = F.transform(hexes, lambda h: F.lower(F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)))
    from_rgb = F.transform(rgbs, lambda v: F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")))
    seen = pages.select(key, F.posexplode(F.concat(from_hex, from_rgb)).alias("pos", "color"))
    counted = seen.groupBy(key, "color").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    counted = counted.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("_k") <= top)
    r, g, b = (channel(F.col("color"), i) for i in range(3))
    lum, sat = luminance(r, g, b), saturation(r, g, b)
    kinds = F.array_compact(F.array(F.when(lum < 0.25, "dark"), F.when(lum > 0.85, "light"), F.when((sat > 0.35) & (lum > 0.2) & (lum < 0.85), "accent")))
    named = counted.withColumn("bucket", F.explode(kinds))
    rank = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("_k")).cast("long")
    return named.select(key, "bucket", rank.alias("rank"), F.concat(F.lit("#"), "color").alias("color"), "n")


def design(ranked: DataFrame, key: str) -> DataFrame:
    """key, mode, background, surface, text, accent, accent_2: colours by role. The defaults."""
    pick = lambda b, k: F.max(F.when((F.col("bucket") == b) & (F.col("rank") == k), F.col("color")))
    n = lambda b: F.count_if(F.col("bucket") == b)
    got = ranked.groupBy(key).agg((n("dark") >= n("light")).alias("dark"), *[pick(b, k).alias(f"{b}{k}") for b in ("dark", "light", "accent") for k in (1, 2)])
    either = lambda d, l: F.when(F.col("dark"), d).otherwise(l)
    c = lambda n, default: F.coalesce(F.col(n), F.lit(default))
    return got.select(
        key, either(F.lit("dark"), F.lit("light")).alias("mode"),
        either(c("dark1", "#0b0f19"), c("light1", "#ffffff")).alias("background"), either(c("dark2", "#151b2b"), c("light2", "#f5f7fb")).alias("surface"),
        either(F.lit("#e8ecf5"), c("dark1", "#14181f")).alias("text"), c("accent1", "#f5b301").alias("accent"), F.coalesce("accent2", "accent1", F.lit("#e8531f")).alias("accent_2"),
    )


def corner_radius(css: Column) -> Column:
    """The most frequent radius of 1 to 40 px; ties go to the smallest; 12 where there is none."""
    got = F.filter(F.transform(F.regexp_extract_all(css, F.lit(r"(?i)border-radius\s*:\s*([0-9]{1,9})px"), F.lit(1)), lambda x: x.cast("int")), lambda v: (v > 0) & (v <= 40))
    counted = F.transform(F.array_distinct(got), lambda v: F.struct(F.size(F.filter(got, lambda x: x == v)).alias("n"), (-v).alias("v")))
    return F.coalesce(-F.array_max(counted)["v"], F.lit(12))


def fonts(css: Column, k: int = 3) -> Column:
    """The first safe, specific font of each declaration; the first k distinct."""
    stacks = F.regexp_extract_all(css, F.lit(r"(?i)font-family\s*:\s*([^;}]+)"), F.lit(1))
    clean = lambda s: F.transform(F.split(s, ","), lambda f: F.trim(F.regexp_replace(F.trim(f), "^['\"]+|['\"]+$", "")))
    ok = lambda f: f.rlike("^[A-Za-z0-9 _-]{1,40}$") & ~F.lower(f).isin(*GENERIC_FONTS)
    firsts = F.transform(stacks, lambda s: F.get(F.filter(clean(s), ok), 0))
    return F.slice(F.array_distinct(F.array_compact(firsts)), 1, k)
