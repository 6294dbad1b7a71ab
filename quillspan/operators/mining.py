"""API paths named in scripts, and what recorded probes say about endpoints."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import let, settle

# What marks a path as an API's, what a path is written with, static files, what stands for an operand that is no literal, and bounds.
INDICATOR = r"(?:api/|v[1-9][0-9]*/|rest/|rpc/|graphql)"
_API_PATH = r"(/?(?:[a-zA-Z0-9_-]+/)*" + INDICATOR + r"[a-zA-Z0-9/_{}.:-]*)"
_FULL_URL = r"(https?://[a-zA-Z0-9._-]+(?::[0-9]+)?/(?:[a-zA-Z0-9_-]+/)*" + INDICATOR + r"[a-zA-Z0-9/_{}.:-]*)"
STATIC_FILES = (".js", ".css", ".map", ".html", ".htm", ".png", ".jpg", ".svg")
SENTINEL = "0"
MAX_PREFIXES, MAX_CONCATS, MAX_OPERANDS, MAX_CHAIN, MAX_ARGUMENTS = 8, 256, 16, 1024, 500

#: JavaScript's strings, templates and balanced brackets, as groups that the patterns below call by name.
_JS = r"""(?(DEFINE)(?<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')(?<template>`(?:\\.|\$\{(?&inner)*\}|[^`\\])*+`)(?<inner>\\.|\{(?&inner)*\}|(?&template)|[^{}`\\])
(?<bracket>\((?&piece)*\)|\[(?&piece)*\]|\{(?&piece)*\})(?<piece>(?&string)|(?&template)|(?&bracket)|[^()\[\]{}"'`]))""".replace("\n(", "(")
_TEMPLATE = regex.compile(_JS + r"(?&template)", regex.S)
_HOLE = regex.compile(_JS + r"\$\{(?<hole>(?&inner)*)\}", regex.S)
# What the two above match, too, where nothing is nested or escaped; these are tried first, since they take a small part of the time.
_PLAIN_TEMPLATE = re.compile(r"`[^`\\$]*`")
_PLAIN_HOLE = re.compile(r"\$\{(?P<hole>[^{}`\\]*)\}")
_ARGUMENTS = regex.compile(_JS + r"(?:(?&string)|(?&template)|(?&bracket)|[^()\[\]{}\"'`])*(?=\))", regex.S)
_ARGUMENT = regex.compile(_JS + r"(?:(?&string)|(?&template)|(?&bracket)|[^()\[\]{}\"'`,])+", regex.S)
_OPERAND = regex.compile(_JS + r"\s*+(?:(?<literal>(?&string)|(?&template))|(?:(?&string)|(?&template)|(?&bracket)|[^()\[\]{}\"'`+;,\n\r])+)\s*+(?<more>\+?)", regex.S)
_CONCAT = regex.compile(r"""["'](/?[a-zA-Z0-9/_{}.:?=&%~-]+)["']\.concat\(""")
_CHAIN = regex.compile(r"""["']""" + _API_PATH + r"""["']\s*\+""")
_PREFIX_CHAIN = regex.compile(r"""["']([a-zA-Z][a-zA-Z0-9_-]{0,30}/)["']\s*\+""")
_MARKED = regex.compile(INDICATOR, regex.I)
_ABSOLUTE = regex.compile("(?i)https?://")
_SPACE = re.compile(r"[ \t\r\n]")
_TAIL = re.compile("([?#])")
_SLASHES = re.compile("/+")
_IN_PATH = regex.compile(r"(?:[A-Za-z0-9/_.:{}~@!$'()*+,;\[\]|-]|%(?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e]))*+\Z")
_IN_QUERY = regex.compile(r"(?:[A-Za-z0-9/_.:{}~@!$'()*+,;\[\]|?=&#-]|%(?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e]))*+\Z")


def fill_holes(template: str, shown: Callable[[str], str]) -> str:
    """A template's text with each hole as ``shown`` says of what is in it. Holes are looked for where one can begin, not at every character."""
    out, last, at = [], 0, template.find("${")
    while at >= 0:
        m = _PLAIN_HOLE.match(template, at) or _HOLE.match(template, at)
        if m:
            out += template[last:at], shown(m["hole"])
            last = m.end()
        at = template.find("${", m.end() if m else at + 1)
    return "".join(out) + template[last:]


def template_paths(script: str) -> list[str]:
    """Template literals that name an API path, each hole written as ``{param}``; what stands before the path is left out. Nothing is read behind a literal without an end."""
    out, at = [], script.find("`")
    while at >= 0:
        m = _PLAIN_TEMPLATE.match(script, at) or _TEMPLATE.match(script, at)
        if m is None:
            break
        at = script.find("`", m.end())
        text = m[0][1:-1]
        if not _MARKED.search(text):
            continue
        text = fill_holes(text, lambda _: "{param}").strip()
        if not text.startswith("/") and not _ABSOLUTE.match(text) and text.find("/") > 0:
            text = text[text.index("/") :]
        if _MARKED.search(text) and not _SPACE.search(text):
            out.append(text)
    return out


def _literal(operand: str) -> str:
    """A literal's text; the sentinel for anything else."""
    text = operand.strip()
    whole = text[:1] in "\"'`" and text[-1:] == text[:1] and len(text) > 1 and not (text[0] == "`" and "${" in text)
    return text[1:-1] if whole and text[0] not in text[1:-1].replace("\\" + text[0], "") else SENTINEL


def _chain(script: str, at: int) -> str:
    """The operands of a chain of plus signs from ``at`` on."""
    out, end = [], min(len(script), at + MAX_CHAIN)
    for _ in range(MAX_OPERANDS):
        m = _OPERAND.match(script, at, end)
        if m is None or not m[0].strip(" \t\n\r+"):
            break
        out.append(_literal(m["literal"] or "x"))
        if not m["more"]:
            break
        at = m.end()
    return "".join(out)


def clean_path(path: str) -> str:
    """A path put together: single slashes, none at its end; empty without an API's mark or with characters that no URL has."""
    head, sign, tail = (*_TAIL.split(path, maxsplit=1), "", "")[:3]
    scheme, colon, rest = head.partition("://")
    head = scheme + colon + _SLASHES.sub("/", rest) if colon else _SLASHES.sub("/", head)
    head, tail = head.rstrip("/"), sign + tail
    return head + tail if _MARKED.search(head + tail) and _IN_PATH.match(head) and _IN_QUERY.match(tail) else ""


def concat_paths(script: str) -> list[str]:
    """Paths put together by ``.concat()``, by plus signs behind an API path, and by plus signs behind a service's prefix."""
    calls = []
    for m in _CONCAT.finditer(script) if ".concat(" in script else ():
        args = _ARGUMENTS.match(script, m.end(), min(len(script), m.end() + MAX_ARGUMENTS))
        if args:
            calls.append(m[1] + "".join(_literal(a[0]) for a in _ARGUMENT.finditer(args[0]) if a[0].strip()))
    chained = "+" in script
    chains = [m[1] + _chain(script, m.end()) for m in _CHAIN.finditer(script)] if chained else []
    prefixed = [m[1] + _chain(script, m.end()) for m in _PREFIX_CHAIN.finditer(script)] if chained else []
    unique = lambda found: [p for p in dict.fromkeys(map(clean_path, found)) if p][:MAX_CONCATS]
    return unique([*calls, *chains]) + unique(prefixed)


def _scanned(find):
    """A function from a script to paths, as a column over Arrow batches; null has none."""

    @F.arrow_udf("array<string>")
    def scan(scripts: pa.Array) -> pa.Array:
        return pa.array([find(s or "") for s in scripts.to_pylist()], pa.list_(pa.string()))

    return scan


def service_prefixes(script: Column, most: int = MAX_PREFIXES) -> Column:
    """Prefixes (``identity/``) of services: those joined to an API path by a plus sign, then short literals by falling frequency and name, up to ``most`` in all."""
    joined = F.array_distinct(F.regexp_extract_all(script, F.lit(r"""["']([a-zA-Z][a-zA-Z0-9_-]{1,30}/)["']\s*\+\s*["']""" + INDICATOR), F.lit(1)))
    alone = F.filter(F.regexp_extract_all(script, F.lit(r"""["']([a-z][a-z0-9_-]{1,30}/)["']"""), F.lit(1)), lambda p: ~p.rlike("(?i)" + INDICATOR))

    def ranked(names: Column) -> Column:
        """(-n, prefix) of sorted names, best first: a run of equal names begins where one differs from the one before."""
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: (i <= F.size(names)) & ((i == 1) | (F.get(names, i - 1) != F.get(names, F.greatest(i - 2, F.lit(0))))))
        ends = lambda starts: F.transform(starts, lambda at, j: F.struct((at - F.coalesce(F.get(starts, j + 1), F.size(names) + 1)).alias("n"), F.get(names, at - 1).alias("prefix")))
        return F.array_sort(let(starts, ends))

    def chosen(joined: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(most) - F.size(joined))
        others = F.filter(let(F.array_sort(alone), ranked), lambda r: ~F.array_contains(joined, r["prefix"]))
        return F.concat(joined, F.transform(F.slice(others, F.lit(1), room), lambda r: r["prefix"]))

    return let(joined, chosen)


def recorded_prefixes(rows: DataFrame) -> DataFrame:
    """(origin, prefix, first_seq): prefixes of services that a crawl shows: addresses (seq, url, source) taken from a recorded script that are one short segment below its folder.

    Scripts are matched to what came from them by address, so that a script of very many addresses costs no more than its rows.
    """
    is_script = lambda c: F.lower(F.coalesce(U.raw_path(F.col(c)), F.lit(""))).rlike(r"\.m?js\z")
    scripts = rows.filter(is_script("url")).select(F.col("url").alias("source")).distinct()
    taken = rows.filter(is_script("source")).join(scripts, "source", "left_semi")
    folder = F.regexp_replace(U.path(F.col("source")), r"[^/]*\z", "")
    path = U.path(F.col("url"))
    below = F.when(F.startswith(path, folder), F.rtrim(F.substring(path, F.length(folder) + 1, F.length(path)), F.lit("/")))
    named = settle(taken, origin=U.origin(F.col("source")), below=below).filter(F.col("below").rlike(r"^[a-z0-9_\-]{2,30}\z"))
    return named.groupBy("origin", F.concat("below", F.lit("/")).alias("prefix")).agg(F.min("seq").alias("first_seq"))


def is_static_file(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in STATIC_FILES) + r")\z")


def mine_paths(scripts: DataFrame, id_col: str, text_col: str, recorded: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """(id, pos, path): distinct API paths that scripts name, in the order in which the strategies find them.

    Quoted paths, template literals (with and without holes), full URLs, paths put together. A path without a service's
    prefix is tried under every prefix that its script names, and under those that requests of the script's origin show (``recorded``, see
    :func:`recorded_prefixes`; an origin's services stand in one list). Static files are left out; null scripts have none.
    """
    text = F.col(text_col)
    take = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    found = [take(f"[\"']{_API_PATH}[\"']"), _scanned(template_paths)(text), take(f"`{_API_PATH}`"), take(f"[\"'`]{_FULL_URL}[\"'`]"), _scanned(concat_paths)(text)]
    named = scripts.select(id_col, *([url_col] if recorded is not None else []), service_prefixes(text).alias("prefixes"), F.concat(*found).alias("found"))
    if recorded is not None:
        shown = recorded.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("first_seq", "prefix"))).alias("shown"))
        named = settle(named, origin=U.origin(F.col(url_col))).join(shown, "origin", "left")
        named = named.withColumn("prefixes", F.array_distinct(F.concat("prefixes", F.coalesce(F.transform("shown", lambda x: x["prefix"]), F.array().cast("array<string>")))))
    # Dealt out by id as rows of a script, which are fewer than those of its paths; what is done for each id below then needs no further shuffle.
    # The generator is an outer one, since for others Catalyst adds a filter that scans every script once more; its rows of null go with the static files.
    rows = named.repartition(id_col).select(id_col, "prefixes", F.posexplode_outer("found").alias("at", "raw"))
    rows = rows.filter(~is_static_file(F.col("raw"))).withColumns({"absolute": U.is_absolute_http(F.col("raw")), "bare": F.regexp_replace("raw", "^/", "")})
    own = F.exists("prefixes", lambda p: F.col("bare").startswith(p)) | (~F.col("bare").rlike("(?i)^" + INDICATOR) & F.col("bare").rlike("(?i)" + INDICATOR)) | (F.size("prefixes") == 0)
    whole = F.when(F.col("absolute"), F.when(U.is_admissible(F.col("raw")), F.array(F.rtrim(F.col("raw"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    tried = whole.when(own, F.array(F.concat(F.lit("/"), F.col("bare")))).otherwise(F.transform("prefixes", lambda p: F.concat(F.lit("/"), p, F.col("bare"))))
    spread = rows.select(id_col, "at", F.posexplode(tried).alias("nth", "path")).withColumn("path", F.when(U.is_absolute_http(F.col("path")), F.col("path")).otherwise(F.rtrim(F.col("path"), F.lit("/")))).filter("path <> ''")
    first = spread.groupBy(id_col, "path").agg(F.min(F.shiftleft(F.col("at").cast("long"), 32) + F.col("nth")).alias("place"))
    return first.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("place")) - 1).alias("pos"), "path")


def prefix_counts(scripts: DataFrame, text_col: str) -> DataFrame:
    """(prefix, scripts): in how many scripts each service prefix is named."""
    return scripts.select(F.explode(service_prefixes(F.col(text_col))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("scripts"))


def allowed_methods(allow: Column) -> Column:
    return F.filter(F.transform(F.split(allow, ","), lambda m: F.upper(F.trim(m))), lambda m: m != "")


def enrich_by_url(rows: DataFrame, answers: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Rows with the columns of the first recorded answer for their URL; with a budget, only the ``most`` URLs that appear first are asked for."""
    if most is not None:
        asked = rows.groupBy("url").agg(F.min("seq").alias("first")).orderBy("first", "url").limit(most)
        answers = answers.join(asked, "url", "left_semi")
    known = answers.groupBy("url").agg(*[F.min_by(c, F.col("seq")).alias(c) for c in columns])
    return rows.join(known, "url", "left")


def drop_refuted(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows less the candidates put together from scripts whose address was answered with 404."""
    gone = probes.filter(F.col("status") == 404).select(U.normalized(F.col("url")).alias("address")).distinct()
    guess = F.col("source") == "static:js-concat"
    marked = rows.withColumn("address", F.when(guess, U.normalized(F.col("url"))))
    return marked.join(gone, "address", "left_anti").drop("address")


def uncovered_services(bindings: DataFrame, reflected: DataFrame) -> DataFrame:
    """Services named by scripts that no reflection covers."""
    return bindings.select("service").distinct().join(reflected.select("service").distinct(), "service", "left_anti")
