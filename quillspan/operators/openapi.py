"""REST operations: groups of exchanges by template, method and origin, with their parameters, servers and trust."""

from __future__ import annotations

import http
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import settle
from quillspan.operators.paths import normalize, path_template
from quillspan.sources.schema import STATIC_JS_SOURCES

# Tags of static sources by falling confidence.
SOURCE_TAGS = ("js-bundle", "js-sourcemap", "js-bundle-concat")
OPERATION = ["template", "method", "origin"]


def is_static_source() -> Column:
    return F.coalesce(F.col("source").isin(*STATIC_JS_SOURCES), F.lit(False))


def located(rows: DataFrame) -> DataFrame:
    """http(s) exchanges with decoded path, lower-case method and canonical origin."""
    seen = settle(rows.withColumn("method", F.lower("method")), path=U.path(F.col("url")), origin=U.canonical_origin(F.col("url")))
    return seen.filter((F.col("origin") != "") & F.col("path").isNotNull())


def templated(rows: DataFrame, merge_slugs: bool = False, threshold: int = 2) -> DataFrame:
    """Rows with a path and its template. A template depends on its path alone, unless slugs are merged over all paths."""
    return rows.join(normalize(rows, merge_slugs, threshold), "path") if merge_slugs else rows.withColumn("template", path_template(F.col("path")))


def with_operation(rows: DataFrame, merge_slugs: bool = False, threshold: int = 2) -> DataFrame:
    """http(s) exchanges with template, method and origin. For raw traffic count :func:`places` first, of which there are fewer."""
    return templated(located(rows), merge_slugs, threshold)


def places(rows: DataFrame) -> DataFrame:
    """(path, method, origin, source, exchanges, first_seq): what operations are made of, combined before the shuffle."""
    return located(rows).groupBy("path", "method", "origin", "source").agg(F.count("*").alias("exchanges"), F.min("seq").alias("first_seq"))


def source_tag() -> Column:
    """dynamic if any row is; else the least certain static source's tag."""
    rank = F.array_position(F.array(*map(F.lit, STATIC_JS_SOURCES)), F.col("source"))
    return F.when(F.bool_or(~is_static_source()), "dynamic").otherwise(F.element_at(F.array(*map(F.lit, SOURCE_TAGS)), F.max(rank).cast("int")))


def operations(rows: DataFrame) -> DataFrame:
    """(template, method, origin, exchanges, first_seq, source_tag, path_params) of places with templates."""
    grouped = rows.groupBy(*OPERATION).agg(F.sum("exchanges").alias("exchanges"), F.min("first_seq").alias("first_seq"), source_tag().alias("source_tag"))
    return grouped.withColumn("path_params", F.array_join(F.regexp_extract_all("template", F.lit(r"\{([^}]*)\}"), F.lit(1)), ","))


def servers(rows: DataFrame, target: str = "") -> DataFrame:
    """(origin, role): primary (the target's, else the least observed), observed, or excluded (from scripts alone)."""
    seen = rows.filter(F.col("origin") != "").groupBy("origin").agg(F.bool_or(~is_static_source()).alias("observed"))
    first = seen.filter("observed").agg(F.min("origin").alias("least"))
    primary = F.coalesce(F.nullif(U.canonical_origin(F.lit(target)), F.lit("")), F.col("least"))
    role = F.when(F.col("origin") == primary, "primary").when(F.col("observed"), "observed").otherwise("excluded")
    return seen.crossJoin(F.broadcast(first)).select("origin", role.alias("role"))  # one row


def resolve_collisions(ops: DataFrame, roles: DataFrame) -> DataFrame:
    """The operation of the most trusted origin for each template and method, with the other origins in order."""
    rank = F.when(F.col("role") == "primary", 0).when(F.col("role") == "excluded", 2).otherwise(1)
    ranked = ops.join(roles, "origin", "left").withColumn("rank", rank)
    slots = ranked.groupBy("template", "method").agg(F.min_by(F.struct(*ops.columns), F.struct("rank", "origin")).alias("kept"), F.collect_set("origin").alias("origins"))
    return slots.withColumn("collision_origins", F.array_join(F.array_sort(F.array_except("origins", F.array("kept.origin"))), ",")).select("kept.*", "collision_origins")


def sort_operations(ops: DataFrame) -> DataFrame:
    """Operations in the order in which a document lists them: by path, method and origin."""
    return ops.orderBy("template", "method", "origin")


def value_type(values: Column) -> Column:
    """integer, number, boolean or string: what all values of an array are."""
    every = lambda pattern: F.forall(values, lambda v: v.rlike(pattern))
    return (
        F.when(F.size(values) == 0, "string")
        .when(every(r"^[+-]?[0-9]+\z"), "integer")
        .when(every(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z|^[+-]?(inf|infinity|nan)\z"), "number")
        .when(every(r"^(true|false)\z"), "boolean")
        .otherwise("string")
    )


def _common_type(kinds: Column) -> Column:
    """The type of all values, from the set of the types of each exchange's values (four at most)."""
    return F.when(F.size(kinds) == 1, kinds[0]).when(F.array_contains(kinds, "number") & (F.size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("number")))) == 0), "number").otherwise("string")


def query_parameters(rows: DataFrame) -> DataFrame:
    """(template, method, origin, name, type, several, required) of exchanges: required if every exchange with parameters has it.

    The exchanges of a path are combined first; one more pair without a name counts them.
    """
    pair = "struct<key:string,value:array<string>>"
    pairs = F.concat(F.array(F.lit(None).cast(pair)), F.map_entries("query_params").cast(f"array<{pair}>"))
    each = located(rows).filter(F.size("query_params") > 0).select("path", "method", "origin", F.explode(pairs).alias("p")).select("path", "method", "origin", F.col("p.key").alias("name"), F.col("p.value").alias("values"))
    kinds = F.collect_set(F.when(F.size("values") > 0, value_type(F.col("values"))))
    seen = templated(each.groupBy("path", "method", "origin", "name").agg(F.count("*").alias("n"), F.bool_or(F.size("values") > 1).alias("several"), kinds.alias("kinds")))
    merged = seen.groupBy(*OPERATION, "name").agg(F.sum("n").alias("n"), F.bool_or("several").alias("several"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    total = F.max(F.when(F.col("name").isNull(), F.col("n"))).over(Window.partitionBy(*OPERATION))
    return merged.withColumn("total", total).filter("name IS NOT NULL").select(*OPERATION, "name", _common_type(F.col("kinds")).alias("type"), "several", (F.col("n") == F.col("total")).alias("required"))


#: Phrases of statuses in documents: the registered ones, and those that were registered under another phrase before.
STATUS_TEXT = {s.value: s.phrase for s in http.HTTPStatus} | {413: "Request Entity Too Large", 414: "Request URI Too Long", 416: "Requested Range Not Satisfiable", 418: "I'm a teapot", 422: "Unprocessable Entity"}


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _object(parts: Column) -> Column:
    """An array of ``"name":value`` texts as a JSON object, by name."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(parts), ","), F.lit("}"))


def body_content(properties: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, schema): the JSON text of merged body schemas."""
    pair = F.when(F.col("name").isNotNull(), F.concat(_quoted(F.col("name")), F.lit(":"), "schema"))
    whole = properties.groupBy(*keys).agg(F.collect_list(pair).alias("pairs"), F.max(F.when(F.col("name").isNull(), F.col("schema"))).alias("plain"))
    return whole.select(*keys, F.coalesce("plain", F.concat(F.lit('{"properties":'), _object(F.col("pairs")), F.lit(',"type":"object"}'))).alias("schema"))


def render_openapi(ops: DataFrame, params: DataFrame, requests: DataFrame | None = None, responses: DataFrame | None = None, named: DataFrame | None = None, statuses: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One row (path, item) for each path of an OpenAPI 3.0 document, as JSON text; assembled by operation, not by traffic.

    requests, responses: merged properties of bodies, by media type and by status; named: which component stands for a body
    (:func:`schemas.components`), which is referred to instead of shown; statuses: (operation, status) of answers, with or without a body;
    sources: one row (from_scripts), whether operations' sources are named at all.
    """
    query = params.groupBy(*OPERATION).agg(F.array_sort(F.collect_list(F.struct("name", "required", "type", "several"))).alias("query"))
    rows = ops.join(query, OPERATION, "left")
    rows = rows.withColumn("from_scripts", F.lit(True)) if sources is None else rows.crossJoin(F.broadcast(sources))  # one row
    simple = lambda kind: F.struct(kind.alias("type"), F.lit(None).cast("struct<type:string>").alias("items"))
    one = lambda p, where, required, schema, style, explode: F.struct(p.alias("name"), F.lit(where).alias("in"), required.alias("required"), schema.alias("schema"), style.alias("style"), explode.alias("explode"))
    path_list = F.transform(F.filter(F.split("path_params", ","), lambda p: p != ""), lambda p: one(p, "path", F.lit(True), simple(F.lit("string")), F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    listed = lambda p: F.when(p["several"], F.struct(F.lit("array").alias("type"), F.struct(p["type"].alias("type")).alias("items"))).otherwise(simple(p["type"]))
    query_list = F.transform(
        F.coalesce("query", F.array().cast("array<struct<name:string,required:boolean,type:string,several:boolean>>")),
        lambda p: one(p["name"], "query", p["required"], listed(p), F.when(p["several"], "form"), F.when(p["several"], F.lit(True))),
    )
    summary = F.concat(F.initcap("method"), F.lit(" "), F.col("template"))
    every = F.concat(query_list, path_list)
    item = F.struct(summary.alias("summary"), F.when(F.col("from_scripts"), F.col("source_tag")).alias("x-source"), F.nullif(F.col("collision_origins"), F.lit("")).alias("x-collision-origins"), F.when(F.size(every) > 0, every).alias("parameters"))
    rows = rows.withColumn("item", F.to_json(item))
    for bodies, key, wrap in ((requests, "media", "requestBody"), (responses, "status", "responses")):
        if bodies is None:
            continue
        told = body_content(bodies, [*OPERATION, key])
        if named is not None:
            place = named.filter(F.col("place") == wrap.removesuffix("Body").removesuffix("s")).select(*OPERATION, F.col("key").alias(key), "component")
            told = told.join(place, [*OPERATION, key], "left").withColumn("schema", F.coalesce(F.concat(F.lit('{"$ref":"#/components/schemas/'), "component", F.lit('"}')), "schema"))
        if wrap == "responses" and statuses is not None:
            told = statuses.select(*OPERATION, key).join(told, [*OPERATION, key], "left")
        text = F.concat(F.lit('{"schema":'), "schema", F.lit("}"))
        if wrap == "responses":
            phrase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS_TEXT.items() for x in (str(k), v)]), F.col(key)), F.col(key))
            held = F.coalesce(F.concat(F.lit('"content":{"application/json":'), text, F.lit("},")), F.lit(""))
            text = F.concat(F.lit("{"), held, F.lit('"description":'), _quoted(phrase), F.lit("}"))
        merged = told.groupBy(*OPERATION).agg(_object(F.collect_list(F.concat(_quoted(F.col(key)), F.lit(":"), text))).alias("body"))
        shown = F.concat(F.lit('{"content":'), "body", F.lit("}")) if wrap == "requestBody" else F.col("body")
        added = F.concat(F.expr("left(item, length(item) - 1)"), F.lit(f',"{wrap}":'), shown, F.lit("}"))
        rows = rows.join(merged, OPERATION, "left").withColumn("item", F.coalesce(added, "item")).drop("body")
    return rows.groupBy("template").agg(_object(F.collect_list(F.concat(_quoted(F.col("method")), F.lit(":"), "item"))).alias("item"))


def document(items: DataFrame, origins: list[str], title: str = "API") -> str:
    """The OpenAPI document of rendered paths; one row for each path comes to the driver."""
    paths = {r["template"]: json.loads(r["item"]) for r in items.orderBy("template").collect()}
    return json.dumps({"openapi": "3.0.3", "info": {"title": title, "version": "1.0.0"}, "servers": [{"url": o} for o in origins], "paths": paths}, indent=4, sort_keys=True)
