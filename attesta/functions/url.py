"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BLOG_HOSTS, FORUM_HOSTS, MARKET_HOSTS, NEWS_HOSTS, RESEARCH_HOSTS


def any_in(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | (F.instr(c, p) > 0)
    return found


def source_class(url: Column, title: Column | None = None) -> Column:
    """One of ten classes, by host, then path, then title; what isn't a URL is unknown."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    hay = F.concat_ws(" ", host, path, F.lower(F.coalesce(title, F.lit(""))) if title is not None else F.lit(""))
    home = F.regexp_replace(path, "/+$", "")
    return (
        F.when(host.isNull(), "unknown")
        .when(host.endswith(".gov") | host.endswith(".mil"), "government")
        .when(host.endswith(".edu"), "academic")
        .when(any_in(host, RESEARCH_HOSTS), "research")
        .when(any_in(path, ["/docs", "/documentation", "/api"]) | any_in(hay, ["developer", "reference"]), "documentation")
        .when(any_in(host, FORUM_HOSTS), "forum")
        .when(any_in(host, MARKET_HOSTS), "marketplace")
        .when(any_in(host, NEWS_HOSTS), "news")
        .when(any_in(host, BLOG_HOSTS) | any_in(path, ["/blog", "/posts"]), "blog")
        .when(home.isin("", "/about", "/docs"), "official")
        .otherwise("unknown")
    )


def unwrap_redirect(url: Column, base: str = "https://duckduckgo.com") -> Column:
    """The target in a search engine's redirect link, else the absolute URL; null if it can't be one."""
    absolute = F.when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url))
    return F.coalesce(F.try_url_decode(F.try_parse_url(absolute, F.lit("QUERY"), F.lit("uddg"))), absolute)


def cache_key(url: Column, user_agent: Column, render: Column, max_bytes: Column | None = None) -> Column:
    """What makes two fetches the same; with max_bytes a truncated body never answers a larger request."""
    parts = [user_agent, F.concat(F.lit("render="), render)]
    if max_bytes is not None:
        parts.append(F.concat(F.lit("max_bytes="), max_bytes.cast("string")))
    return F.concat(F.concat_ws("|", *parts), F.lit("\n"), url)
