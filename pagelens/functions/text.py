"""Script-aware text functions: Column in, Column out.

Scripts written without spaces are recognised by their share of Thai characters.
Java's ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` is set, so it always is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character range, share of it that marks unspaced text, characters per word.
THAI = r"\x{0E00}-\x{0E7F}"
THAI_SHARE = 0.15
THAI_CHARS_PER_WORD = 3.5
TOKEN_LIMIT = 4000
# Names that a file may not have on Windows.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squash(x: Column) -> Column:
    """Runs of any white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " "))


def split_words(x: Column) -> Column:
    return F.filter(F.split(text_of(x), r"(?U)\s+"), lambda w: w != "")


def has_thai(x: Column) -> Column:
    return text_of(x).rlike(f"[{THAI}]")


def thai_share(x: Column) -> Column:
    """Measured only where a text has any: most texts cost one short search."""
    solid = F.length(F.regexp_replace(text_of(x), r"(?U)\s+", ""))
    thai = F.length(F.regexp_replace(text_of(x), f"[^{THAI}]", ""))
    return F.when(has_thai(x), F.coalesce(F.try_divide(thai.cast("double"), solid), F.lit(0.0))).otherwise(F.lit(0.0))


def is_unspaced(x: Column) -> Column:
    return thai_share(x) >= THAI_SHARE


def strip_marks(x: Column) -> Column:
    """Without non-spacing marks. Nothing in the Thai range changes under canonical decomposition, so none is needed."""
    return F.regexp_replace(text_of(x), r"\p{Mn}", "")


def _estimated(x: Column) -> Column:
    letters = F.length(F.regexp_replace(strip_marks(x), f"[^{THAI}]", ""))
    thai = F.bround(letters / THAI_CHARS_PER_WORD).cast("long")
    return thai + count_spaced(F.regexp_replace(text_of(x), f"[{THAI}]+", " "))


def count_spaced(x: Column) -> Column:
    """Words between white space, in one pass and without an array."""
    return F.regexp_count(text_of(x), F.lit(r"(?U)\S+")).cast("long")


def count_words(x: Column) -> Column:
    return F.when(is_unspaced(x), F.greatest(_estimated(x), F.lit(1))).otherwise(count_spaced(x)).cast("long")


def count_words_by_mode(x: Column, unspaced: Column) -> Column:
    """The variant that trusts the region instead of the text."""
    has = F.length(F.regexp_replace(text_of(x), f"[^{THAI}]", "")) > 0
    return F.when(unspaced, F.greatest(_estimated(x), F.when(has, 1).otherwise(0))).otherwise(count_spaced(x)).cast("long")


def quoted(x: Column) -> Column:
    """As a literal inside a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def count_substring(x: Column, part: Column) -> Column:
    """Non-overlapping occurrences, both lower-cased; an empty part gives length + 1, as str.count does."""
    body, part = F.lower(text_of(x)), F.lower(text_of(part))
    hits = F.try_divide(F.length(body) - F.length(F.replace(body, part, F.lit(""))), F.length(part))
    return F.when(F.length(part) == 0, F.length(body) + 1).otherwise(hits).cast("long")


def count_keyword(x: Column, keyword: Column) -> Column:
    """Occurrences between ASCII word borders; of an unspaced keyword, any."""
    key = F.lower(F.regexp_replace(text_of(keyword), r"(?U)^\s+|\s+$", ""))
    bounded = F.regexp_count(F.lower(text_of(x)), F.concat(F.lit("(?<![0-9A-Za-z_])"), quoted(key), F.lit("(?![0-9A-Za-z_])")))
    return F.when(F.length(key) == 0, F.lit(0)).when(is_unspaced(key), count_substring(x, key)).otherwise(bounded).cast("long")


def keyword_tokens(keyword: Column) -> Column:
    key = F.lower(F.regexp_replace(text_of(keyword), r"(?U)^\s+|\s+$", ""))
    words = F.filter(F.regexp_extract_all(key, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.when(F.length(key) == 0, F.array().cast("array<string>")).when(is_unspaced(key), F.array(key)).otherwise(words)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: an expression that a lambda names is worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def token_set(x: Column, limit: int = TOKEN_LIMIT) -> Column:
    """Sorted distinct words of four letters or more, and 4-grams of unspaced script; the first ``limit``."""
    none = F.array().cast("array<string>")

    def grams(thai: Column) -> Column:
        return F.when(F.length(thai) >= 4, F.transform(F.sequence(F.lit(1), F.length(thai) - 3), lambda i: F.substring(thai, i, F.lit(4)))).otherwise(none)

    def tokens(body: Column) -> Column:
        words = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{Nl}\p{No}]{4,}"), F.lit(0))
        return F.when(is_unspaced(body), F.concat(let(F.regexp_replace(body, f"[^{THAI}]", ""), grams), words)).otherwise(words)

    return F.slice(F.sort_array(F.array_distinct(let(F.lower(text_of(x)), tokens))), 1, limit)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token sets (arrays without repeats); two empty sets are alike."""

    def share(s: Column) -> Column:
        both = F.size(s["a"]) + F.size(s["b"]) - s["n"]
        return F.when(both == 0, F.lit(1.0)).otherwise(F.try_divide(s["n"].cast("double"), both))

    counted = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.size(F.array_intersect(s["a"], s["b"])).alias("n")))
    return let(counted, share)


def anchor_id(x: Column, fallback: str = "bagian") -> Column:
    kept = F.regexp_replace(F.lower(text_of(x)), r"[^\p{L}\p{N}\p{Mn}]", "-")
    slug = F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 60), F.lit("")), F.lit(fallback))


def url_slug(x: Column, fallback: str = "halaman") -> Column:
    clean = F.lower(F.regexp_replace(text_of(x), r"(?U)^\s+|\s+$", ""))
    clean = F.regexp_replace(clean, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}\x{FEFF}]", "")
    clean = F.regexp_replace(clean, r"(?U)[\s/\\?#\[\]@!$&'()*+,;=%\"<>{}|^`~]+", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def file_slug(x: Column, fallback: str = "halaman", guarded: bool = True) -> Column:
    """A slug for a file's name. guarded: names that Windows keeps for itself get the fallback behind them."""
    clean = F.lower(F.regexp_replace(text_of(x), r"(?U)^\s+|\s+$", ""))
    ascii_ = F.regexp_replace(F.regexp_replace(clean, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    named = F.when(ascii_ == "", F.substring(F.sha1(clean), 1, 10)).otherwise(ascii_)
    safe = F.when(F.lit(guarded) & named.isin(RESERVED), F.concat(named, F.lit("-" + fallback))).otherwise(named)
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(safe, 1, 80), "-+$", ""), F.lit("")), F.lit(fallback))


def cache_key(keyword: Column, provider: Column, region: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", provider, region, keyword)), 1, 10)


def report_name(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")


def html_escape(x: Column) -> Column:
    out = text_of(x)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def escape_between_tags(x: Column) -> Column:
    out = text_of(x)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def escape_attribute(x: Column, quote: Column) -> Column:
    out = escape_between_tags(x)
    return F.when(quote == '"', F.replace(out, F.lit('"'), F.lit("&quot;"))).when(quote == "'", F.replace(out, F.lit("'"), F.lit("&#39;"))).otherwise(out)


def minify_css(x: Column) -> Column:
    out = F.regexp_replace(text_of(x), r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"\s*([{}:;,>])\s*", "$1")
    return F.trim(F.replace(out, F.lit(";}"), F.lit("}")))


def sentences(x: Column) -> Column:
    return F.filter(F.split(squash(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def truncate_words(x: Column, limit: int, share: float = 0.6) -> Column:
    """At most ``limit`` characters, cut at a space if that keeps more than the share, without closing punctuation.

    One more than ``limit`` characters that aren't space tell all, so of a long text only its beginning is squashed.
    """

    def shortened(line: Column) -> Column:
        head = F.substring(line, 1, limit)
        at = F.length(head) - F.locate(" ", F.reverse(head))
        cut = F.when((F.locate(" ", head) > 0) & (at > limit * share), F.substring(head, F.lit(1), at)).otherwise(head)
        return F.when(F.length(line) <= limit, line).otherwise(F.regexp_replace(cut, r"[ ,.;:-]+$", ""))

    return let(squash(F.regexp_extract(text_of(x), rf"(?U)^(?:\s*+\S){{0,{limit + 1}}}+", 0)), shortened)


def ensure_contains(x: Column, part: Column, limit: int) -> Column:
    """Puts a missing part in front, and truncates."""
    return truncate_words(F.when(F.contains(F.lower(text_of(x)), F.lower(part)), text_of(x)).otherwise(F.concat(part, F.lit(" - "), text_of(x))), limit)


def chat_title(x: Column, limit: int = 42) -> Column:
    line = squash(x)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("..."))).otherwise(line)


def estimate_tokens(x: Column) -> Column:
    thai = F.length(F.regexp_replace(text_of(x), f"[^{THAI}]", ""))
    return (thai + F.floor((F.length(text_of(x)) - thai) / 3)).cast("long")


def round_up(x: Column, step: int) -> Column:
    return (F.floor((x + step - 1) / step) * step).cast("long")


def mask(x: Column) -> Column:
    n = F.length(x)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(x, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(x, F.lit(4))))


def bullets(items: Column, limit: int) -> Column:
    kept = F.slice(F.filter(F.transform(items, squash), lambda x: x != ""), 1, limit)
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")


def split_pair(x: Column) -> Column:
    """struct<label, value> of a line "label: value"; a line without a colon is a label alone."""
    parts = F.split(text_of(x), ":", 2)
    return F.struct(F.trim(F.get(parts, 0)).alias("label"), F.coalesce(F.trim(F.get(parts, 1)), F.lit("")).alias("value"))


def paragraphs(x: Column) -> Column:
    """The parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text_of(x), r"\n{2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def union_lists(*lists: Column) -> Column:
    """The lists behind each other, the first of each entry; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def font_stack(extra: Column, fallback: Column) -> Column:
    names = F.array_distinct(F.filter(F.transform(F.concat(extra, fallback), lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(F.transform(names, lambda x: F.when(x.rlike("^[A-Za-z0-9-]+$"), x).otherwise(F.concat(F.lit('"'), x, F.lit('"')))), ", ")


def language_tag(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit("-"))


def json_for_html(x: Column) -> Column:
    out = x
    for c in "&<>":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def number(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


# -- densities: three formulas, by purpose ---------------------------------------


def content_density(hits: Column, words: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(hits.cast("double"), words) * 100, F.lit(0.0)), 2)


def indexed_density(hits: Column, n_tokens: Column, words: Column) -> Column:
    return hits * F.greatest(n_tokens, F.lit(1)) / F.greatest(words, F.lit(1)).cast("double") * 100


def validated_density(hits: Column, n_parts: Column, words: Column) -> Column:
    return F.round(hits * n_parts / F.greatest(words, F.lit(1)).cast("double") * 100, 2)
