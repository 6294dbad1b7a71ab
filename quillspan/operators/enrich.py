"""What recorded answers to probes add to endpoints: schemas, WSDL, introspection, gateways and script bindings; always joins, never calls."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.functions.rows import let
from quillspan.operators.mining import enrich_by_url

# Bounds of what a probe's schema shows, and the shapes of services' names in a gateway's document.
MAX_DEPTH, MAX_PROPERTIES = 64, 200
_OPERATION_ID = r"\A([A-Za-z_][A-Za-z0-9_.]*)_([A-Za-z][A-Za-z0-9]*)\z"
_SERVICE = r"\A[a-z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\.[A-Z][A-Za-z0-9_]*\z"
_VERSIONED = r"(?:\A|\.)v[0-9]+(?:(?:alpha|beta)[0-9]+)?(?:\.|\z)"
_DOTTED = r"\A[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\z"


def probe_schema(value: object, depth: int = 0) -> dict:
    """The schema of a probe's answer: unlike a body's, numbers are numbers, null is a type, and properties are bounded."""
    if depth > MAX_DEPTH:
        return {"type": "unknown"}
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: probe_schema(v, depth + 1) for k, v in sorted(value.items())[:MAX_PROPERTIES]}}
    if isinstance(value, list):
        return {"type": "array"} | ({"items": probe_schema(value[0], depth + 1)} if value else {})
    kinds = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    return {"type": kinds[type(value)]}


def _schema_text(body: bytes | None) -> str | None:
    try:
        return json.dumps(probe_schema(json.loads((body or b"").decode(errors="replace"))), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def is_json_type(content_type: Column) -> Column:
    base = H.media_base(content_type)
    return base.endswith("/json") | base.endswith("+json")


def with_schemas(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with ``schema``, the JSON text of the schema of the first recorded JSON answer (url, seq, status, content_type, body) to their URL."""

    @F.pandas_udf("string")
    def infer(bodies: pd.Series) -> pd.Series:
        return bodies.map(_schema_text)

    good = answers.filter((F.col("status") == 200) & is_json_type(F.col("content_type"))).groupBy("url").agg(F.min_by("body", "seq").alias("body"))
    return rows.join(good.select("url", infer("body").alias("schema")), "url", "left")


def wsdl_base(url: Column) -> Column:
    """A URL without its ``wsdl`` parameter, with the others in the order of names, and without ``/wsdl`` at the end of its path."""
    pairs = F.array_sort(F.filter(U.query_pairs(url), lambda p: p["name"] != "wsdl"))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    head = F.concat(U.scheme(url), F.lit("://"), U.authority(url), F.regexp_replace(U.raw_path(url), r"/wsdl\z", ""))
    return F.when(U.is_valid(url), F.concat(head, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))).otherwise(url)


def is_wsdl(body: Column) -> Column:
    """Does a body look like a WSDL document?"""
    text = H.body_text(body)
    return text.contains("definitions") & (text.contains("schemas.xmlsoap.org/wsdl") | text.contains("portType") | text.contains("message"))


def with_wsdl(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with ``wsdl``, the first recorded WSDL document (base_url, seq, body) of their service."""
    found = documents.filter(is_wsdl(F.col("body"))).groupBy("base_url").agg(F.min_by("body", "seq").alias("wsdl"))
    return rows.withColumn("base_url", wsdl_base(F.col("url"))).join(found, "base_url", "left").drop("base_url")


def with_introspection(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with ``introspection``: of the recorded answers (url, tier, status, body) to their URL that of the lowest tier that succeeded."""
    good = F.try_parse_json(H.body_text(F.col("body")))
    types = F.try_variant_get(good, "$.data.__schema.types", "array<variant>")
    found = answers.filter((F.col("status") == 200) & (F.size(types) > 0)).groupBy("url").agg(F.min_by("body", "tier").alias("introspection"))
    return rows.join(found, "url", "left")


def _looks_like_service(name: Column) -> Column:
    return F.coalesce(name.rlike(_SERVICE) | (name.rlike(_VERSIONED) & name.rlike(_DOTTED)), F.lit(False))


def gateway_services(documents: DataFrame, key: str, body_col: str = "body") -> DataFrame:
    """(key, service, method, input_type, output_type) of recorded OpenAPI documents of gRPC gateways.

    An operation id ``Service_Method`` names both; a tag that is a service's full name goes before the document's title,
    and that before the id. A document without any such name says nothing.
    """
    kind = "struct<info:struct<title:string>,tags:array<struct<name:string>>,paths:map<string,map<string,struct<operationId:string,tags:array<string>>>>>"
    docs = documents.select(key, F.from_json(F.col(body_col).cast("string"), kind).alias("d")).select(key, F.col("d.info.title").alias("title"), F.col("d.tags").alias("tags"), F.col("d.paths").alias("paths"))
    ops = docs.select(key, "title", "tags", F.explode("paths").alias("path", "ops")).select(key, "title", "tags", F.explode("ops").alias("verb", "op"))
    service, method = F.regexp_extract("op.operationId", _OPERATION_ID, 1), F.regexp_extract("op.operationId", _OPERATION_ID, 2)
    named = ops.withColumns({"service": service, "method": method}).filter(F.substring_index("service", ".", -1).rlike("^[A-Z]") & F.col("method").rlike("^[A-Z]"))
    tag = F.try_element_at(F.filter("op.tags", _looks_like_service), F.lit(1))
    chosen = F.coalesce(tag, F.when(_looks_like_service(F.col("title")), F.col("title")), F.col("service"))
    return named.select(key, chosen.alias("service"), "method").distinct().withColumns({"input_type": F.concat("method", F.lit("Request")), "output_type": F.concat("method", F.lit("Response"))})


def host_seeds(rows: DataFrame, most: int = 500) -> DataFrame:
    """(origin): canonical origins that no gRPC row is of, in order, up to ``most``, which bounds live probes."""
    of = lambda r: r.select(U.canonical_origin(F.col("url")).alias("origin")).filter("origin <> ''").distinct()
    return of(rows).join(of(rows.filter("api_type = 'grpc'")), "origin", "left_anti").orderBy("origin").limit(most)


def name_only_services(bindings: DataFrame, named: DataFrame, reflected: DataFrame) -> DataFrame:
    """Services of scripts that some row knows by name alone and no reflection describes."""
    return bindings.select("service").distinct().join(named.select("service").distinct(), "service", "left_semi").join(reflected.select("service").distinct(), "service", "left_anti")


def same_origin_only(candidates: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of the target's origin, and (origin, rejected) counts of the others."""
    own = U.canonical_origin(F.col("url")) == U.canonical_origin(F.lit(target))
    return candidates.filter(own), candidates.filter(~own).groupBy(U.canonical_origin(F.col("url")).alias("origin")).agg(F.count("*").alias("rejected"))


#: Which enrichments an API of each type gets, in order.
STRATEGIES: dict[str, tuple[Callable[..., DataFrame], ...]] = {"rest": (enrich_by_url, with_schemas), "wsdl": (with_wsdl,), "graphql": (with_introspection,), "grpc": (gateway_services,)}


def grpc_bindings(scripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(service, method, input_type, output_type, client_streaming, server_streaming, first_seq) that generated gRPC-Web code declares.

    Three shapes: ``new MethodDescriptor('/pkg.Service/Method', type, Request, Response``; an object with ``typeName`` and
    ``methods``; and ``X.serviceName = "pkg.Service"`` with ``X.Method = {methodName: ...}``. The first script that names a method decides.
    """
    text = F.col(text_col)
    every = lambda pattern, groups: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])
    name = r"[A-Za-z_$][\w$.]*"
    descriptor = rf"""MethodDescriptor\(\s*["']/([A-Za-z_][\w.]*)/([A-Za-z_]\w*)["']\s*,\s*[^,]*?\b(UNARY|SERVER_STREAMING)\s*,\s*({name})\s*,\s*({name})"""
    service = r"""typeName\s*:\s*["']([A-Za-z_][\w.]*)["']\s*,\s*methods\s*:\s*\{((?:[^{}]|\{[^{}]*\})*)\}"""
    method = rf"""name\s*:\s*["']([A-Za-z_]\w*)["']\s*,\s*I\s*:\s*({name})\s*,\s*O\s*:\s*({name})\s*,\s*kind\s*:\s*[\w$.]*?(Unary|ServerStreaming|ClientStreaming|BiDiStreaming)"""
    owner = rf"""({name})\.serviceName\s*=\s*["']([A-Za-z_][\w.]*)["']"""
    stub = rf"""({name})\.[A-Za-z_]\w*\s*=\s*\{{\s*methodName\s*:\s*["']([A-Za-z_]\w*)["']\s*,\s*service\s*:[^,]*,\s*requestStream\s*:\s*(true|false|!0|!1)\s*,\s*responseStream\s*:\s*(true|false|!0|!1)\s*,\s*requestType\s*:\s*({name})\s*,\s*responseType\s*:\s*({name})"""
    tail = lambda c: F.substring_index(c, ".", -1)
    shape = lambda s, m, i, o, client, server: F.struct(s.alias("service"), m.alias("method"), tail(i).alias("input_type"), tail(o).alias("output_type"), client.alias("client_streaming"), server.alias("server_streaming"))
    no = F.lit(False)
    one = F.transform(every(descriptor, {"s": 1, "m": 2, "k": 3, "i": 4, "o": 5}), lambda x: shape(x["s"], x["m"], x["i"], x["o"], no, x["k"] == "SERVER_STREAMING"))

    def of_service(x: Column) -> Column:
        inner = F.arrays_zip(*[F.regexp_extract_all(x["b"], F.lit(method), F.lit(g)).alias(n) for n, g in {"m": 1, "i": 2, "o": 3, "k": 4}.items()])
        return F.transform(inner, lambda y: shape(x["s"], y["m"], y["i"], y["o"], y["k"].isin("ClientStreaming", "BiDiStreaming"), y["k"].isin("ServerStreaming", "BiDiStreaming")))

    two = F.flatten(F.transform(every(service, {"s": 1, "b": 2}), of_service))
    true = lambda c: c.isin("true", "!0")
    whose = lambda x, owners: F.try_element_at(F.filter(owners, lambda y: y["x"] == x["x"]), F.lit(1))["s"]
    stubs = every(stub, {"x": 1, "m": 2, "c": 3, "r": 4, "i": 5, "o": 6})
    three = let(every(owner, {"x": 1, "s": 2}), lambda owners: F.transform(stubs, lambda x: shape(whose(x, owners), x["m"], x["i"], x["o"], true(x["c"]), true(x["r"]))))
    found = scripts.select(F.col(id_col).alias("seq"), F.posexplode(F.concat(one, two, three)).alias("pos", "b")).select("seq", "pos", "b.*").filter("service IS NOT NULL")
    first = F.min_by(F.struct("input_type", "output_type", "client_streaming", "server_streaming"), F.struct("seq", "pos")).alias("d")
    return found.groupBy("service", "method").agg(first, F.min("seq").alias("first_seq")).select("service", "method", "d.*", "first_seq")


def fill_from_bindings(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """gRPC rows (seq, service, methods) with the methods of script bindings where they have none; a service that no row has follows behind the last row."""
    known = bindings.groupBy("service").agg(F.array_sort(F.collect_set("method")).alias("bound"))
    filled = rows.join(known, "service", "left").select("seq", "service", F.coalesce("methods", "bound").alias("methods"))
    last = rows.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    missing = known.join(rows.select("service").distinct(), "service", "left_anti").crossJoin(F.broadcast(last))  # one row
    number = F.col("last") + F.row_number().over(Window.orderBy("service"))
    return filled.unionByName(missing.select(number.alias("seq"), "service", F.col("bound").alias("methods")))


def descriptor_closure(imports: DataFrame, roots: DataFrame, most: int = 1000, rounds: int = 64) -> DataFrame:
    """(root, file, depth): the files that descriptors import, directly or through others, nearest first and ``most`` of each root.

    imports: (file, dependency); roots: (root, file). Each level is joined to the imports and leaves out what was seen;
    it is written out, so plans stay short. Cycles end.
    """
    seen = roots.select("root", "file", F.lit(0).alias("depth")).distinct().checkpoint()
    level = seen
    for depth in range(1, rounds + 1):
        reached = level.select("root", "file").join(imports, "file").select("root", F.col("dependency").alias("file")).distinct()
        level = reached.join(seen, ["root", "file"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level)
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "file"))
    return seen.withColumn("place", place).filter(F.col("place") <= most).drop("place")
