"""What can be read from HTML by regular expressions in the JVM: whole-page properties without a tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, one_line, strip


def is_html(c: Column) -> Column:
    return c.rlike(r"(?is)</?[a-z].*>")


def decode_entities(c: Column) -> Column:
    """The references that are common in prose; the tree reader knows all of them."""
    for ref, by in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "'"), ("&nbsp;?", " "), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        c = F.regexp_replace(c, ref, by)
    return c


def without_tags(c: Column) -> Column:
    return decode_entities(F.regexp_replace(c, "(?s)<[^>]*>", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def element(html: Column, tag: str) -> Column:
    return blank_to_null(decode_entities(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)))


def meta(html: Column, name: str) -> Column:
    return blank_to_null(decode_entities(F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)))


def title(html: Column) -> Column:
    return F.coalesce(meta(html, "og:title"), meta(html, "twitter:title"), element(html, "title"))


def headings(html: Column, most: int = 24) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3](?:\s[^>]*)?>(.*?)</h[1-3]>"), F.lit(1))
    texts = F.filter(F.transform(found, lambda h: one_line(without_tags(h))), lambda h: F.length(h) > 0)
    return F.slice(F.array_distinct(texts), 1, most)


def comments(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1))


def json_ld(html: Column, most: int = 20, preview: int = 240) -> Column:
    """JSON of each ld+json script, arrays spread; what can't be parsed becomes {"parse_error":true, ...}."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    bad = lambda s: F.to_json(F.struct(F.lit(True).alias("parse_error"), F.substring(strip(s), 1, preview).alias("text_preview")))
    each = F.transform(
        F.filter(scripts, lambda s: F.length(strip(s)) > 0),
        lambda s: F.when(F.try_parse_json(s).isNull(), F.array(bad(s)))
        .when(strip(s).startswith("["), F.transform(F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"), lambda v: F.to_json(v)))
        .otherwise(F.array(F.to_json(F.try_parse_json(s)))),
    )
    return F.slice(F.flatten(each), 1, most)


def visible_text(c: Column) -> Column:
    """All text outside tags, scripts, styles and comments."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)(?:\s[^>]*)?>.*?</\1>|<!--.*?-->", " ")
    return normalize(without_tags(c))
