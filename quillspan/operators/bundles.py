"""Endpoints that script bundles call: fetch and axios calls and paths put together, as synthetic exchanges.

Calls of fetch, axios, XMLHttpRequest and jQuery and changes of location are found by :mod:`scripts`, which follows constants through scopes; paths put together by patterns.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import settle
from quillspan.operators import mining, scripts
from quillspan.operators.links import resolve

# Schemes and assets that are no endpoints, bounds of a bundle, and tags of the rows.
SCHEMES = ("javascript:", "data:", "blob:", "mailto:", "tel:", "chrome-extension:")
ASSETS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff",
    ".css", ".svg", ".woff", ".woff2", ".ttf", ".eot",
    ".map", ".js", ".ico", ".pdf", ".zip",
)
MAX_BUNDLE, MAX_ENDPOINTS, MAP_TAIL, MAX_MAP = 5 << 20, 500, 2048, 10 << 20
#: Places that paths put together keep of a bundle's endpoints, at most half of them.
CONCAT_PLACES = 16
SCRIPT, SOURCEMAP, CONCAT = "static:js", "static:js-sourcemap", "static:js-concat"

_JS = mining._JS
_KEY = regex.compile(_JS + r"(?:^|,)\s*(?:(?<quoted>(?&string))|(?<name>[A-Za-z_$][\w$]*))\s*(?=[:,]|$)(?:(?&string)|(?&template)|(?&bracket)|[^()\[\]{}\"'`,])*", regex.S)
_LAST_NAME = regex.compile(r"\s*[\w$.]*?([A-Za-z_$][\w$]*)\s*")
_TAIL = re.compile("[?#]")
_ORIGIN = regex.compile(r"^[A-Za-z][\w+.-]*://[^/]*")
_SAYS_NOTHING = regex.compile(r"\{\w+\}|/")
_UNKNOWN = regex.compile(r"\{\w+\}|(?<=/)0(?=/|$)")
_MAP = regex.compile(r"//[#@]\s*sourceMappingURL=(\S+)")


def placeholders(template: str) -> str:
    """A template with its holes as ``{name}``: the last name of an identifier or member, else ``{param}``, ``{param1}``, ..."""
    unnamed = 0

    def shown(hole: str) -> str:
        nonlocal unnamed
        if name := _LAST_NAME.fullmatch(hole):
            return "{" + name[1] + "}"
        unnamed += 1
        return "{param}" if unnamed == 1 else f"{{param{unnamed - 1}}}"

    return mining.fill_holes(template, shown)


def address(literal: str) -> str:
    """The address that a literal names; empty for what is no endpoint or says nothing but placeholders."""
    text = placeholders(literal[1:-1]) if literal[0] == "`" else literal[1:-1]
    path = _TAIL.split(text, maxsplit=1)[0]
    bare = _ORIGIN.sub("", path)
    if not text or text.lower().startswith(SCHEMES) or path.lower().endswith(ASSETS) or not _SAYS_NOTHING.sub("", bare):
        return ""
    return text


def fields(body: str) -> list[str]:
    """The names of an object literal's own properties, in order, each once."""
    inner, at, names = body[1:-1], 0, []
    while at >= 0:  # a property begins at the front or at a comma
        m = _KEY.match(inner, at)
        if m and (m["quoted"] or m["name"]):
            names.append((m["quoted"] or "")[1:-1] or m["name"])
        at = inner.find(",", m.end() if m else at + 1)
    return list(dict.fromkeys(names))


def calls(script: str) -> list[tuple[str, str, list[str], str]]:
    """(method, address, body fields, kind) of a script: axios calls, fetch calls, then paths put together, each method and address once."""
    told = sorted(scripts.sinks(script), key=lambda c: ("axios", "fetch").index(c[3]) if c[3] in ("axios", "fetch") else 2)
    found = [(method, address(f'"{url}"'), fields(sent) if sent.startswith("{") else []) for method, url, sent, _ in told]
    once: dict[tuple[str, str], tuple[list[str], str]] = {}
    for method, url, names in found:
        if url and (not once.get((method, url)) or names and not once[method, url][0]):
            once[method, url] = (names, "call")
    shape = lambda u: _UNKNOWN.sub("*", u)
    seen = {shape(u) for _, u in once}
    for url in mining.concat_paths(script):
        if shape(url) not in seen:
            once.setdefault(("GET", url), ([], "concat"))
    return [(m, u, n, k) for (m, u), (n, k) in once.items()]


def inline_sources(script: str) -> list[str]:
    """The sources within a source map that the end of a bundle carries as a data URI; malformed maps have none."""
    found = _MAP.findall(script[-MAP_TAIL:] if "base64" not in script[-MAX_MAP:] else script[-MAX_MAP:])
    if not found or not found[-1].startswith("data:"):
        return []
    head, _, data = found[-1].partition(",")
    try:
        text = base64.b64decode(data, validate=True).decode() if head.endswith(";base64") else unquote(data)
        said = json.loads(text) if len(text) <= MAX_MAP else {}
        return [s for s in said.get("sourcesContent") or [] if isinstance(s, str) and s]
    except (ValueError, AttributeError):
        return []


def within_budget(endpoints: list[dict], most: int = MAX_ENDPOINTS) -> list[dict]:
    """The first ``most`` endpoints, calls before paths put together, for which some places are kept and which take those that calls leave."""
    called = [e for e in endpoints if e["source"] != CONCAT]
    joined = [e for e in endpoints if e["source"] == CONCAT]
    called = called[: most - min(len(joined), CONCAT_PLACES, most // 2)]
    return called + joined[: most - len(called)]


def is_bundle() -> Column:
    """A script by its answer's media type or its address."""
    kind = F.lower(F.coalesce("response.content_type", F.lit("")))
    return kind.contains("javascript") | kind.contains("ecmascript") | F.lower(U.raw_path(F.col("url"))).rlike(r"\.m?js\z")


def analyze(exchanges: DataFrame) -> DataFrame:
    """(seq, nth, method, url, body, source, page_url): synthetic exchanges of the calls in recorded bundles.

    A bundle gives its own calls and those of the sources in its inline map, 500 at most, by the same rule at any
    size of the input; bundles over 5 MB are not read. Addresses are resolved against the page, else the bundle;
    those that are no http(s) address of a host go, and paths put together count for the bundle's own origin alone.
    Fields of a body are null.
    """
    body = F.col("response.body")
    bundles = exchanges.filter(is_bundle() & (F.octet_length(body) > 0) & (F.octet_length(body) <= MAX_BUNDLE)).select("seq", "url", "page_url", F.make_valid_utf8(body.cast("string")).alias("script"))
    kind = pa.list_(pa.struct([("method", pa.string()), ("address", pa.string()), ("fields", pa.list_(pa.string())), ("source", pa.string())]))

    def row(script: str) -> list[dict]:
        once: dict[tuple[str, str], dict] = {}
        for tag, text in [(SCRIPT, script), *((SOURCEMAP, s) for s in inline_sources(script))]:
            for method, url, names, how in calls(text):
                once.setdefault((method, url), {"method": method, "address": url, "fields": names, "source": CONCAT if how == "concat" else tag})
        return within_budget(list(once.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([row(s or "") for s in batch.column(3).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["seq", "url", "page_url", "found"])

    made = bundles.mapInArrow(run, "seq long, url string, page_url string, found array<struct<method:string,address:string,fields:array<string>,source:string>>")
    base = F.when(U.host(F.coalesce("page_url", F.lit(""))) != "", F.col("page_url")).otherwise(F.col("url"))
    rows = settle(made, base=base).select("seq", "url", "page_url", "base", F.posexplode("found").alias("nth", "f")).select("seq", "nth", "url", "page_url", "base", "f.*")
    target = settle(rows, target=resolve(F.col("base"), F.col("address")))
    fine = U.is_admissible(F.col("target")) & ((F.col("source") != CONCAT) | (U.canonical_origin(F.col("target")) == U.canonical_origin(F.col("url"))))
    sent = F.when(F.size("fields") > 0, F.to_json(F.map_from_arrays(F.array_sort("fields"), F.transform("fields", lambda _: F.lit(None).cast("string"))), {"ignoreNullFields": "false"}))
    return target.filter(fine).select("seq", "nth", "method", F.col("target").alias("url"), sent.alias("body"), "source", F.coalesce(F.nullif("page_url", F.lit("")), "url").alias("page_url"))


def statistics(exchanges: DataFrame) -> DataFrame:
    """One row: bundles that were read, bundles too large, and endpoints found by source."""
    size = F.octet_length("response.body")
    read = exchanges.filter(is_bundle()).agg(F.count_if((size > 0) & (size <= MAX_BUNDLE)).alias("analyzed"), F.count_if(size > MAX_BUNDLE).alias("skipped"))
    found = analyze(exchanges).agg(*[F.count_if(F.col("source") == tag).alias(name) for tag, name in ((SCRIPT, "from_scripts"), (SOURCEMAP, "from_sourcemaps"), (CONCAT, "from_concats"))])
    return read.crossJoin(F.broadcast(found))  # one row each
