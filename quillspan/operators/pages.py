"""Exchanges by the pages that made them, reports of verdicts, and scripts that pages name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import settle
from quillspan.operators.links import resolve

# Extensions of static assets, as pages are kept without them.
ASSETS = (
    ".css", ".js", ".map",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".avif",
    ".woff", ".woff2", ".ttf", ".eot", ".otf", ".webmanifest",
    ".mp4", ".webm", ".mp3", ".ogg",
)


def is_static_asset(url: Column) -> Column:
    return F.lower(F.coalesce(U.path(url), F.lit(""))).rlike("(" + "|".join(e.replace(".", r"\.") for e in ASSETS) + r")\z")


def page_exchange() -> Column:
    """An exchange as a page keeps it: headers with lists of values, and a response only where there is one."""
    several = lambda h: F.when(F.size(h) > 0, F.transform_values(h, lambda _, v: F.array(v)))
    r, text = F.col("response"), lambda b: F.coalesce(b.cast("string"), F.lit(""))
    answer = F.struct(r["status_code"].alias("status_code"), several(r["headers"]).alias("headers"), text(r["body"]).alias("body"))
    there = (F.coalesce(r["status_code"], F.lit(0)) != 0) | (F.coalesce(F.octet_length(r["body"]), F.lit(0)) > 0) | (F.size(r["headers"]) > 0)
    return F.struct(F.col("url").alias("requested_url"), "method", several(F.col("headers")).alias("headers"), text(F.col("body")).alias("body"), F.when(there, answer).alias("response"))


def web_pages(exchanges: DataFrame) -> DataFrame:
    """(page, seq, exchange): exchanges with the page that made them (or their own address), static assets left out.

    One row for each exchange: a page of very many is no single row. Ordered by page, then seq, they are the pages' lists.
    """
    page = F.coalesce(F.nullif(F.col("page_url"), F.lit("")), F.col("url"))
    fine = (F.col("url") != "") & ~is_static_asset(F.col("url"))
    rows = exchanges.filter(fine).withColumn("page", page)
    return rows.filter((F.col("page") == F.col("url")) | ~is_static_asset(F.col("page"))).select("page", "seq", page_exchange().alias("exchange"))


def page_sizes(exchanges: DataFrame) -> DataFrame:
    """(page, first_seq, exchanges, answered) of :func:`web_pages`."""
    return web_pages(exchanges).groupBy("page").agg(F.min("seq").alias("first_seq"), F.count("*").alias("exchanges"), F.count_if(F.col("exchange.response").isNotNull()).alias("answered"))


def printable(text: Column) -> Column:
    """Control characters, which could drive a terminal, as ``\\xNN``."""

    def shown(c: Column) -> Column:
        return F.when(c.rlike(r"\A[\x00-\x1f\x7f-\x9f]\z"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)

    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.array_join(F.transform(F.split(text, ""), shown), "")).otherwise(text)


def explain(classified: DataFrame) -> DataFrame:
    """(line, n): what was found, and why: a line for each verdict and how often it is given; ordered by line they are the report."""
    url = F.col("url")
    bare = F.coalesce(U.path(url), F.lit(""))
    shown = F.when(U.is_valid(url) & (bare != ""), bare).when(U.is_valid(url) & (U.host(url) != ""), F.concat(U.scheme(url), F.lit("://"), U.authority(url))).otherwise(U.redact(url))
    reason = F.when(F.col("reason") == "", "-").otherwise(F.col("reason"))
    line = F.format_string("  %-6s %s [type=%s confidence=%.2f reason=%s]", printable(F.upper("method")), printable(shown), "api_type", "confidence", reason)
    return classified.groupBy(line.alias("line")).agg(F.count("*").alias("n"))


def is_script_url(url: Column) -> Column:
    return F.lower(F.coalesce(U.path(url), F.lit(""))).rlike(r"\.m?js\z")


def script_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, pos, script): distinct script files that pages name, in order."""
    sources = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<script[^>]+src=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("base"), F.posexplode(sources).alias("pos", "src"))
    found = settle(rows, script=resolve(F.col("base"), F.col("src"))).filter(is_script_url(F.col("script")))
    return found.groupBy(id_col, "script").agg(F.min("pos").alias("pos")).select(id_col, "pos", "script")


def inline_scripts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, nth, script): the texts of scripts that stand in pages themselves."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<script\b([^>]*)>.*?</script\s*>"), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("script"))).alias("nth", "s"))
    return rows.filter(~F.col("s.tag").rlike(r"(?i)\bsrc\s*=") & (F.trim("s.script") != "")).select(id_col, "nth", F.col("s.script").alias("script"))
