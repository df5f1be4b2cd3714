"""AMP rules over the parsed page.

A rule is a name and a test on the page's tree: what must be in the head, how often,
and what must not be anywhere. The rules are those of the published AMP HTML
specification (required mark-up, stylesheets, scripts, attributes), with the stricter
choices that inline styles and forms are refused, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import workers_find_us
from .html_pages import Tree

CSS_LIMIT = 75_000
# Tags that may not stand in the body, the runtime, and what a custom style may not say.
FORBIDDEN = ["img", "video", "audio", "iframe", "embed", "object", "frame", "frameset", "applet", "form"]
RUNTIME = "https://cdn.ampproject.org/"
CSS_FORBIDDEN = {"important": "!important", "import": "@import", "moz-binding": "-moz-binding", "behavior": "behavior:"}


class Page:
    """A page's elements by place."""

    def __init__(self, html: str):
        self.html, self.tree = html, Tree(html)

    def inside(self, tag: str) -> range:
        i = next(self.tree.find(tag), None)
        return range(0) if i is None else range(i + 1, self.tree.stop[i])

    @cached_property
    def head(self) -> range:
        return self.inside("head")

    @cached_property
    def body(self) -> range:
        return self.inside("body")

    def have(self, where: range, tag: str, **attrs: str) -> list[int]:
        """Elements of that name there whose attributes have these values (underscores stand for hyphens; "" is any value)."""
        want = {k.strip("_").replace("_", "-"): v for k, v in attrs.items()}
        t = self.tree
        return [i for i in where if t.name[i] == tag and all(k in t.attrs[i] and (not v or t.attrs[i][k].strip().lower() == v) for k, v in want.items())]

    @cached_property
    def every(self) -> range:
        return range(len(self.tree.name))

    @cached_property
    def custom(self) -> list[int]:
        return self.have(self.every, "style", amp_custom="")

    @cached_property
    def css(self) -> str:
        return self.tree.raw(self.custom[0]) if self.custom else ""

    @cached_property
    def first(self) -> int | None:
        return self.head[0] if len(self.head) else None


class Rule(NamedTuple):
    name: str
    broken: Callable[[Page], bool]


def _viewport(p: Page) -> list[str]:
    return [p.tree.attrs[i].get("content", "").replace(" ", "") for i in p.have(p.head, "meta", name="viewport")]


def _foreign_script(p: Page, i: int) -> bool:
    a = p.tree.attrs[i]
    return not a.get("src", "").startswith(RUNTIME) and a.get("type", "").strip().lower() != "application/ld+json"


RULES = [
    Rule("doctype", lambda p: not p.html.lstrip()[:15].lower().startswith("<!doctype html")),
    Rule("amp-attribute", lambda p: not any({"amp", "⚡"} & set(p.tree.attrs[i]) for i in p.tree.find("html"))),
    Rule("head", lambda p: not len(p.head)),
    Rule("charset", lambda p: len(p.head) > 0 and p.first not in p.have(p.head, "meta", charset="utf-8")),
    Rule("viewport", lambda p: not any("width=device-width" in x for x in _viewport(p))),
    Rule("canonical", lambda p: not p.have(p.head, "link", rel="canonical")),
    Rule("runtime", lambda p: not p.have(p.head, "script", src=RUNTIME + "v0.js")),
    Rule("boilerplate", lambda p: len(p.have(p.head, "style", amp_boilerplate="")) < 2),
    Rule("one-style", lambda p: len(p.custom) > 1),
    *[Rule(name, lambda p, x=x: x in p.css.lower().replace(" ", "")) for name, x in CSS_FORBIDDEN.items()],
    Rule("stylesheet", lambda p: bool(p.have(p.head, "link", rel="stylesheet"))),
    Rule("script", lambda p: any(_foreign_script(p, i) for i in p.tree.find("script"))),
    Rule("inline-style", lambda p: any("style" in p.tree.attrs[i] for i in p.body)),
    Rule("handler", lambda p: any(k.startswith("on") and len(k) > 2 for i in p.body for k in p.tree.attrs[i])),
    *[Rule(tag, lambda p, tag=tag: bool(p.have(p.body, tag))) for tag in FORBIDDEN],
]


def check(html: str, css_limit: int = CSS_LIMIT) -> dict:
    p = Page(html)
    n = len(p.css.encode())
    errors = sorted([r.name for r in RULES if r.broken(p)] + ["css-size"] * (n > css_limit))
    lang = any(p.tree.attrs[i].get("lang") for i in p.tree.find("html"))
    return {"valid": not errors, "errors": errors, "warnings": [] if lang else ["lang"], "css_bytes": n}


def custom_css(html: Column) -> Column:
    """The text of the page's custom style."""
    return F.regexp_extract(html, r"(?is)<style\s+amp-custom[^>]*>(.*?)</style>", 1)


def validate(pages: DataFrame, key: str = "page_id", html: str = "html", css_limit: int = CSS_LIMIT) -> DataFrame:
    """key, valid, errors, warnings, css_bytes: errors by rule, sorted; a null page has no head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [check(x or "", css_limit) for x in b.column(1).to_pylist()]
            kinds = {"valid": pa.bool_(), "errors": pa.list_(pa.string()), "warnings": pa.list_(pa.string()), "css_bytes": pa.int64()}
            yield pa.record_batch([b.column(0), *(pa.array([r[c] for r in rows], k) for c, k in kinds.items())], [key, *kinds])

    workers_find_us(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, f"{key} long, valid boolean, errors array<string>, warnings array<string>, css_bytes long")
