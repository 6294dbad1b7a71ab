"""Links of recorded pages: extraction, scope, and the crawl frontier level by level."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import let, settle

# Extensions that are no pages, segments of transports, and elements and attributes that name links.
NOT_PAGES = (
    ".js", ".mjs", ".cjs", ".css", ".map",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".avif",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".mp3", ".mp4", ".webm", ".ogg", ".wav", ".avi", ".mov",
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z",
)
TRANSPORTS = ("socket.io", "engine.io")
LINKS = (("a", "href"), ("form", "action"), ("iframe", "src"), ("area", "href"), (r"[a-z][a-z0-9-]*", "data-href"), (r"[a-z][a-z0-9-]*", "data-url"))


def is_likely_page(url: Column) -> Column:
    """Neither a file of an extension that is no page, nor a transport's address; a malformed URL may be a page."""
    path = F.lower(F.coalesce(U.path(url), F.lit("")))
    return ~path.rlike("(" + "|".join(e.replace(".", r"\.") for e in NOT_PAGES) + r")\z") & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TRANSPORTS)))


def fold_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments (RFC 3986, 5.2.4): ``..`` takes the segment before it away and never goes above the root."""
    kept = F.aggregate(
        F.slice(F.split(path, "/", -1), F.lit(2), F.size(F.split(path, "/", -1))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?\z") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of a reference, without its fragment; null for other schemes. As RFC 3986 has it (5.2), dot segments of the path are folded."""
    folder = F.regexp_replace(U.raw_path(base), r"[^/]*\z", "")

    def joined(ref: Column) -> Column:
        return (
            F.when(ref.rlike(r"(?i)^https?://"), ref)
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
            .when(ref.startswith("//"), F.concat(U.scheme(base), F.lit(":"), ref))
            .when(ref == "", F.regexp_replace(base, r"#.*\z", ""))
            .when(ref.startswith("/"), F.concat(U.root(base), ref))
            .when(ref.startswith("?"), F.concat(U.root(base), U.raw_path(base), ref))
            .otherwise(F.concat(U.root(base), F.when(folder == "", "/").otherwise(folder), ref))
        )

    def folded(whole: Column) -> Column:
        cut = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)\z"
        return F.concat(F.regexp_extract(whole, cut, 1), fold_dots(F.regexp_extract(whole, cut, 2)), F.regexp_extract(whole, cut, 3))

    whole = let(F.regexp_replace(F.trim(ref), r"#.*\z", ""), joined)
    return let(whole, lambda whole: F.when(whole.rlike(r"^[^?#]*/\.\.?([/?#]|\z)"), folded(whole)).otherwise(whole))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, base, pos, link): distinct page-like links in the order of :data:`LINKS`, then of the page, relative to its base."""
    unescaped = lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))
    take = lambda tag, name: F.transform(F.regexp_extract_all(F.col(html_col), F.lit(rf"""(?is)<{tag}\s(?:[^>]*?\s)?{name}\s*=\s*["']([^"']*)["']"""), F.lit(1)), unescaped)
    refs = F.filter(F.concat(*[take(tag, name) for tag, name in LINKS]), lambda h: F.trim(h) != "")
    based = settle(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("base"), F.col(html_col)), root=base_url(F.col(html_col), F.col("base")))
    rows = based.select("page_id", "base", "root", F.posexplode(refs).alias("pos", "href"))
    links = settle(rows, link=resolve(F.col("root"), F.col("href"))).filter(F.col("link").isNotNull())
    return settle(links, likely=is_likely_page(F.col("link"))).filter("likely").groupBy("page_id", "base", "link").agg(F.min("pos").alias("pos"))


def base_url(html: Column, page: Column) -> Column:
    """What a page's references are relative to: its first ``base``, unless that is no http address, less secure or another host."""
    href = F.trim(F.replace(F.regexp_extract(html, r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']""", 1), F.lit("&amp;"), F.lit("&")))
    base = resolve(page, href)
    fine = (href != "") & U.scheme(base).isin("http", "https") & ~((U.scheme(page) == "https") & (U.scheme(base) == "http")) & (F.lower(U.authority(base)) == F.lower(U.authority(page)))
    return F.when(fine, base).otherwise(page)


def crawl_depths(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth): pages by the least number of links from a seed; each level leaves out what was seen before.

    edges: (source, target) of normalised URLs. Each level is written out, so plans stay short.
    """
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct().checkpoint()
    level = seen
    for depth in range(1, max_depth + 1):
        reached = level.join(edges, level["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        level = reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def within_budget(reached: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages (url, depth) of each host, by depth, then address."""
    place = F.row_number().over(Window.partitionBy(U.host(F.col("url"))).orderBy("depth", "url"))
    return reached.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def merge_links(*found: DataFrame) -> DataFrame:
    """(page, pos, link): the links of several extractions of a page, each once, in the order of the extractions."""
    every = functools.reduce(DataFrame.unionByName, [f.select("page_id", "pos", "link", F.lit(i).alias("nth")) for i, f in enumerate(found)])
    first = every.groupBy("page_id", "link").agg(F.min(F.struct("nth", "pos")).alias("at"))
    return first.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("pos"), "link")
