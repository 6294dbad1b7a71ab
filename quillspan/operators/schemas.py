"""Schemas of request and response bodies: inferred from each distinct body, merged by operation, named as components."""

from __future__ import annotations

import email.parser
import json
import math
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.operators.dedup import response_order
from quillspan.operators.paths import singular

# Bounds on what is read, methods that have a request body, endings that are no part of a resource's name, and the suffixes of responses by status.
MAX_BODY, MAX_DEPTH, MAX_FIELDS, MAX_VALUE = 10 << 20, 20, 1000, 4096
WITH_BODY = ("post", "put", "patch")
ENDINGS = (".php", ".asp", ".aspx", ".jsp", ".mvc", ".html", ".htm", ".json", ".xml", ".action", ".do")
SUFFIXES = {
    "200": "Response",
    "201": "CreatedResponse",
    "204": "",
    "400": "BadRequestResponse",
    "401": "UnauthorizedResponse",
    "403": "ForbiddenResponse",
    "404": "NotFoundResponse",
    "500": "InternalErrorResponse",
}
#: The order in which a path's methods are looked through.
METHOD_ORDER = ("post", "put", "patch", "get", "delete", "head", "options")

FORM, MULTIPART, JSON = "application/x-www-form-urlencoded", "multipart/form-data", "application/json"
OPERATION = ["template", "method", "origin"]
_INTEGER, _NUMBER = re.compile(r"[+-]?[0-9]{1,18}\Z"), re.compile(r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\Z|[+-]?(inf|infinity|nan)\Z")
_BROKEN = re.compile(r"%(?![0-9a-fA-F]{2})|;")


def _refuse(name: str) -> None:
    raise ValueError(name)


def json_schema(value: object, depth: int = 0) -> dict:
    """The schema of one JSON value: arrays by their first element, nulls without a type, nothing below the greatest depth."""
    if depth >= MAX_DEPTH:
        return {"type": "object"}
    if value is None:
        return {"nullable": True}
    if isinstance(value, bool):
        return {"type": "boolean"}
    if isinstance(value, (int, float)):
        whole = math.isfinite(value) and value == math.trunc(value) and abs(value) <= 2**63
        return {"type": "integer" if whole else "number"}
    if isinstance(value, list):
        return {"type": "array"} | ({"items": json_schema(value[0], depth + 1)} if value else {})
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: json_schema(v, depth + 1) for k, v in value.items()}}
    return {"type": "string"}


def text_schema(text: str) -> dict:
    """The schema of a form's value."""
    if _INTEGER.match(text):
        return {"type": "integer"}
    return {"type": "number" if _NUMBER.match(text) else "boolean" if text in ("true", "false") else "string"}


def _of_json(body: bytes) -> dict | None:
    try:
        return json_schema(json.loads(body.decode(errors="replace"), parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


def _of_form(body: bytes) -> dict | None:
    pairs = [p.partition("=") for p in body.decode(errors="replace").split("&") if p]
    if any(_BROKEN.search(k) or _BROKEN.search(v) for k, _, v in pairs):
        return None
    first: dict[str, str] = {}
    for k, _, v in pairs:
        first.setdefault(unquote_plus(k), unquote_plus(v))
    return {"type": "object", "properties": {k: text_schema(v) for k, v in first.items()}} if 0 < len(first) <= MAX_FIELDS else None


def _of_multipart(body: bytes, given: str) -> dict | None:
    message = email.parser.BytesParser().parsebytes(b"Content-Type: " + given.encode() + b"\r\n\r\n" + body)
    found = {}
    for part in (message.get_payload() if message.is_multipart() else [])[:MAX_FIELDS]:
        name = part.get_param("name", header="content-disposition")
        if isinstance(name, str) and name:
            value = part.get_payload(decode=True) or b""
            found[name] = {"type": "string", "format": "binary"} if part.get_filename() else text_schema(value[:MAX_VALUE].decode(errors="replace"))
    return {"type": "object", "properties": found} if found else None


def body_schema(body: bytes, media: str, given: str) -> dict | None:
    """The schema of a body by its media type; None if it cannot be read."""
    if not body or len(body) > MAX_BODY:
        return None
    if media == FORM:
        return _of_form(body)
    return _of_multipart(body, given) if media == MULTIPART else _of_json(body)


_FOUND = "array<struct<name:string,type:string,schema:string>>"


def infer(bodies: DataFrame) -> DataFrame:
    """Rows with a column ``found`` behind ``media``, ``given`` and ``body``: (name, type, schema) of the root (name null) and of its properties; null without a schema.

    Bodies should be distinct: this is Python, a row at a time, within Arrow batches.
    """
    kept = [c for c in bodies.columns if c not in ("media", "given", "body")]
    text = lambda s: json.dumps(s, sort_keys=True, separators=(",", ":"))

    def row(body: bytes, media: str, given: str) -> list[dict] | None:
        schema = body_schema(body, media, given)
        if schema is None:
            return None
        root = {"name": None, "type": schema.get("type", ""), "schema": text(schema)}
        return [root, *({"name": k, "type": v.get("type", ""), "schema": text(v)} for k, v in sorted(schema.get("properties", {}).items()))]

    kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("schema", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = [row(b, m, g) for b, m, g in zip(*(of[c].to_pylist() for c in ("body", "media", "given")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(of[c] for c in kept), pa.array(found, kind)], [*kept, "found"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bodies.schema if f.name in kept)
    return bodies.mapInArrow(run, f"{types}, found {_FOUND}")


def merge(observed: DataFrame, keys: list[str], promote: bool) -> DataFrame:
    """(*keys, name, type, schema): the properties of all bodies of a key, from columns ``at`` (their order) and ``found``.

    The first body that has a schema is the base; where that is no object it is all there is (a row without a
    name). Of a property the first one seen is taken; with ``promote`` one that is seen with different types is a
    string, unless it was null at first.
    """
    rows = observed.select(*keys, "at", F.explode("found").alias("f")).select(*keys, "at", "f.*")
    kinds = F.count_distinct(F.when(F.col("type") != "", F.col("type"))).alias("kinds") if promote else F.lit(1).alias("kinds")
    # the root (without a name) and the properties in one pass, in which every body is read once; a window tells each property its root
    every = rows.groupBy(*keys, "name").agg(F.min_by(F.struct("type", "schema"), "at").alias("first"), kinds)
    own = F.col("name").isNull()
    whole = every.withColumn("root", F.max(F.when(own, F.col("first"))).over(Window.partitionBy(*keys)))
    mixed = ~own & (F.col("kinds") > 1) & (F.col("first.type") != "")
    kept = whole.filter((~own & (F.col("root.type") == "object")) | (own & (F.col("root.type") != "object")))
    return kept.select(*keys, "name", F.when(mixed, "string").otherwise(F.col("first.type")).alias("type"), F.when(mixed, '{"type":"string"}').otherwise(F.col("first.schema")).alias("schema"))


def request_bodies(rows: DataFrame) -> DataFrame:
    """(template, method, origin, media, name, type, schema) of the request bodies of exchanges with an operation."""
    given = H.header(F.col("headers"), "content-type")
    media = F.coalesce(F.nullif(H.media_base(given), F.lit("")), F.lit(JSON))
    sent = rows.filter(F.col("method").isin(*WITH_BODY) & (F.octet_length("body") > 0)).select(*OPERATION, "url", "body", given.alias("given"), media.alias("media"))
    distinct = sent.withColumn("given", F.when(F.col("media") == MULTIPART, F.col("given")).otherwise("")).groupBy(*OPERATION, "media", "given", "body").agg(F.min("url").alias("url"))
    at = distinct.withColumn("at", F.struct("url", "body")).withColumn("medium", F.col("media"))
    return merge(infer(at.drop("url")), [*OPERATION, "medium"], promote=True).withColumnRenamed("medium", "media")


def response_bodies(rows: DataFrame) -> DataFrame:
    """(template, method, origin, status, name, type, schema) of the JSON responses of exchanges with an operation; no status counts as 200."""
    r = F.col("response")
    kind = F.lower(F.coalesce(r["content_type"], F.lit("")))
    told = rows.filter((F.octet_length(r["body"]) > 0) & ((kind == "") | kind.contains("json")))
    status = F.when(r["status_code"] > 0, r["status_code"]).otherwise(200).cast("string")
    order = F.min(F.struct(F.col("url"), F.col("body").alias("sent"), response_order().dropFields("seq").alias("told"))).alias("at")
    distinct = told.select(*OPERATION, "url", "body", "response", "seq", status.alias("status")).groupBy(*OPERATION, "status", r["body"].alias("answer")).agg(order)
    return merge(infer(distinct.withColumnRenamed("answer", "body").withColumns({"media": F.lit(JSON), "given": F.lit("")})), [*OPERATION, "status"], promote=False)


def fingerprints(properties: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, fingerprint): sorted ``name:type`` pairs of objects with properties."""
    pair = F.concat("name", F.lit(":"), F.when(F.col("type") == "", "unknown").otherwise(F.col("type")))
    return properties.filter("name IS NOT NULL").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("fingerprint"))


def resource_name(template: Column) -> Column:
    """The last segment that is no parameter: without a file ending, in camel case, in the singular; ``Resource`` if nothing is left."""
    segment = F.coalesce(F.try_element_at(F.filter(F.split(template, "/"), lambda s: (s != "") & ~s.startswith("{")), F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(segment, "(?i)(" + "|".join(map(re.escape, sorted(ENDINGS, key=len, reverse=True))) + r")\z", "")
    camel = F.array_join(F.transform(F.split(bare, "[^A-Za-z0-9]+"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return F.when(camel == "", "Resource").when(camel.rlike("^[0-9]"), F.concat(F.lit("Resource"), camel)).otherwise(singular(camel))


def components(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(template, method, origin, place, key, component): which named schema stands for each object body.

    Bodies of one fingerprint share a name, requests and responses apart. The first of them, by path, method, place
    (request first) and media type or status, gives the name; a name that is taken already is numbered.
    """
    sent = fingerprints(requests, [*OPERATION, "media"]).withColumnRenamed("media", "key").withColumn("place", F.lit("request"))
    told = fingerprints(responses, [*OPERATION, "status"]).withColumnRenamed("status", "key").withColumn("place", F.lit("response"))
    suffix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.col("key")), F.concat("key", F.lit("Response")))
    prefix = F.when(F.col("method") == "post", "Create").when(F.col("method").isin("put", "patch"), "Update").otherwise("")
    resource = resource_name(F.col("template"))
    name = F.when(F.col("place") == "request", F.concat(prefix, resource, F.lit("Request"))).otherwise(F.concat(resource, suffix))
    rank = F.array_position(F.array(*map(F.lit, METHOD_ORDER)), F.col("method"))
    rows = sent.unionByName(told).filter((F.col("place") == "request") | (suffix != "")).withColumns({"name": name, "at": F.struct("template", rank.alias("rank"), "place", "key", "origin")})
    first = rows.groupBy("place", "fingerprint").agg(F.min(F.struct("at", "name")).alias("first")).select("place", "fingerprint", "first.*")
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "place", "fingerprint"))).alias("all"))
    numbered = listed.select("name", F.posexplode("all").alias("n", "one")).select("one.place", "one.fingerprint", F.concat("name", F.when(F.col("n") > 0, (F.col("n") + 1).cast("string")).otherwise("")).alias("component"))
    return rows.join(numbered, ["place", "fingerprint"]).select(*OPERATION, "place", "key", "component")
