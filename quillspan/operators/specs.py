"""gRPC services and proto3, GraphQL operations, introspection and like types."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U

# GraphQL's own scalars, and what makes two types alike.
SCALARS = ("String", "Int", "Float", "Boolean", "ID")
SHARED_FIELDS, SHARED_PART = 3, 0.5


def grpc_services(rows: DataFrame) -> DataFrame:
    """(service, method, first_seq) of the paths of gRPC calls."""
    path = U.path(F.col("url"))
    calls = rows.select("seq", F.regexp_extract(path, r"^/([A-Za-z][A-Za-z0-9_.]*)/([A-Z][A-Za-z0-9_]*)\z", 1).alias("service"), F.regexp_extract(path, r"^/([A-Za-z][A-Za-z0-9_.]*)/([A-Z][A-Za-z0-9_]*)\z", 2).alias("method"))
    return calls.filter(F.col("service") != "").groupBy("service", "method").agg(F.min("seq").alias("first_seq"))


def render_proto(methods: DataFrame) -> DataFrame:
    """(package, proto): one proto3 file for each package, services and methods in order, messages without fields."""
    name = F.substring_index("service", ".", -1)
    package = F.when(F.col("service").contains("."), F.regexp_replace("service", r"\.[^.]*\z", "")).otherwise("")
    call = F.format_string("  rpc %s (%sRequest) returns (%sResponse);\n", "method", "method", "method")
    shape = F.format_string("message %sRequest {}\nmessage %sResponse {}\n", "method", "method")
    services = methods.withColumns({"package": package, "name": name, "call": call, "shape": shape}).groupBy("package", "name").agg(F.array_join(F.array_sort(F.collect_set("call")), "").alias("calls"), F.collect_set("shape").alias("shapes"))
    block = F.format_string("service %s {\n%s}\n", "name", "calls")
    head = F.concat(F.lit('syntax = "proto3";\n'), F.when(F.col("package") == "", "").otherwise(F.concat(F.lit("package "), F.col("package"), F.lit(";\n"))))
    files = services.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("blocks"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shapes")))), "").alias("messages"))
    return files.select("package", F.concat(head, "blocks", "messages").alias("proto"))


def graphql_operations(rows: DataFrame) -> DataFrame:
    """(kind, name, field, first_seq, n): operations of GraphQL bodies by their first root field."""
    document = F.regexp_replace(F.get_json_object(H.body_text(F.col("body")), "$.query"), r"#[^\n]*", "")
    kind = F.coalesce(F.nullif(F.regexp_extract(document, r"^\s*(query|mutation|subscription)\b", 1), F.lit("")), F.lit("query"))
    name = F.regexp_extract(document, r"^\s*(?:query|mutation|subscription)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    field = F.regexp_extract(document, r"^[^{]*\{\s*(?:[A-Za-z_][A-Za-z0-9_]*\s*:\s*)?([A-Za-z_][A-Za-z0-9_]*)", 1)
    seen = rows.select("seq", kind.alias("kind"), name.alias("name"), field.alias("field"), document.rlike(r"^\s*(\{|query|mutation|subscription)").alias("fine"))
    return seen.filter(F.col("fine") & (F.col("field") != "")).groupBy("kind", "name", "field").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


#: How many wrappers of a type reference are read.
WRAPPERS = 7
_TYPE = functools.reduce(lambda inner, _: f"struct<kind:string,name:string,ofType:{inner}>", range(WRAPPERS), "struct<kind:string,name:string>")
_VALUE = f"struct<name:string,type:{_TYPE}>"
INTROSPECTION = (
    f"struct<data:struct<__schema:struct<queryType:struct<name:string>,mutationType:struct<name:string>,subscriptionType:struct<name:string>,types:array<struct<kind:string,name:string,"
    f"fields:array<struct<name:string,args:array<{_VALUE}>,type:{_TYPE}>>,inputFields:array<{_VALUE}>,interfaces:array<struct<name:string>>,enumValues:array<struct<name:string>>,possibleTypes:array<struct<name:string>>>>>>>"
)


def _shown(t: Column, depth: int = WRAPPERS) -> Column:
    """A type reference in SDL: ``T``, ``T!``, ``[T]``."""
    if not depth:
        return t["name"]
    inner = _shown(t["ofType"], depth - 1)
    return F.when(t["kind"] == "NON_NULL", F.concat(inner, F.lit("!"))).when(t["kind"] == "LIST", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(t["name"])


def introspection_sdl(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(name, sdl): the types of the first recorded introspection answer that has any, in SDL; built-in types left out, fields in order, and a ``schema`` block of the roots.

    Answers are never mixed: the least ``seq`` counts (the least text, without that column), and of a name that comes twice in it the first.
    """
    order = F.col("seq") if "seq" in answers.columns else F.col(text_col)
    read = answers.select(order.alias("at"), F.from_json(text_col, INTROSPECTION)["data"]["__schema"].alias("s")).filter(F.size("s.types") > 0)
    said = read.agg(F.min_by("s", "at").alias("s"))
    first = said.select(F.posexplode("s.types").alias("pos", "t")).groupBy(F.col("t.name").alias("type_name")).agg(F.min_by("t", "pos").alias("t"))
    own = first.select("t.*").filter(~F.col("name").startswith("__") & ~F.col("name").isin(*SCALARS))
    value = lambda v: F.concat(v["name"], F.lit(": "), _shown(v["type"]))
    given = lambda f: F.when(F.size(f["args"]) > 0, F.concat(F.lit("("), F.array_join(F.transform(f["args"], value), ", "), F.lit(")"))).otherwise("")
    line = lambda f: F.concat(F.lit("  "), f["name"], given(f), F.lit(": "), _shown(f["type"]), F.lit("\n"))
    names = F.array_join(F.array_sort(F.transform("interfaces", lambda i: i["name"])), " & ")
    implements = F.when(F.size("interfaces") > 0, F.concat(F.lit(" implements "), names)).otherwise("")
    block = lambda word, items: F.concat(F.lit(word + " "), "name", implements, F.lit(" {\n"), F.array_join(F.array_sort(items), ""), F.lit("}\n"))
    sdl = (
        F.when(F.col("kind") == "OBJECT", block("type", F.transform("fields", line)))
        .when(F.col("kind") == "INTERFACE", block("interface", F.transform("fields", line)))
        .when(F.col("kind") == "INPUT_OBJECT", block("input", F.transform("inputFields", lambda v: F.concat(F.lit("  "), value(v), F.lit("\n")))))
        .when(F.col("kind") == "ENUM", block("enum", F.transform("enumValues", lambda v: F.concat(F.lit("  "), v["name"], F.lit("\n")))))
        .when(F.col("kind") == "UNION", F.concat(F.lit("union "), "name", F.lit(" = "), F.array_join(F.array_sort(F.transform("possibleTypes", lambda p: p["name"])), " | "), F.lit("\n")))
        .otherwise(F.concat(F.lit("scalar "), "name", F.lit("\n")))
    )
    root = lambda word: F.when(F.col(f"s.{word}Type.name").isNotNull(), F.concat(F.lit(f"  {word}: "), F.col(f"s.{word}Type.name"), F.lit("\n"))).otherwise("")
    roots = said.filter("s.queryType.name IS NOT NULL").select(F.lit("schema").alias("name"), F.concat(F.lit("schema {\n"), root("query"), root("mutation"), root("subscription"), F.lit("}\n")).alias("sdl")).distinct()
    return own.select("name", sdl.alias("sdl")).union(roots)


def like_types(fields: DataFrame) -> DataFrame:
    """(type, representative): types that share at least three fields and half of all they have, and chains of such.

    fields: (type, field). Types of which one has n fields can only be alike if they share one of the first n - n/2 + 1 of
    each in the order of rarity, so types meet on those alone and a field that all have brings none together; what they
    share is counted then. The components are found by passing the least name along links until nothing changes, a
    chain of n types in about log n rounds since names jump; each round is written out.
    """
    f = fields.distinct()
    rarity = f.groupBy("field").agg(F.count("*").alias("types"))
    listed = f.join(rarity, "field").groupBy("type").agg(F.array_sort(F.collect_list(F.struct("types", "field"))).alias("all"))
    sets = listed.select("type", F.transform("all", lambda x: x["field"]).alias("fields"), F.size("all").alias("n")).checkpoint()
    first = sets.select("type", F.explode(F.slice("fields", F.lit(1), F.col("n") - F.ceil(F.col("n") * SHARED_PART).cast("int") + 1)).alias("field"))
    pairs = first.withColumnRenamed("type", "a").join(first.withColumnRenamed("type", "b"), "field").filter("a < b").select("a", "b").distinct()
    one, two = (sets.select(F.col("type").alias(c), F.col("fields").alias(f"f{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").withColumns({"both": F.size(F.array_intersect("fa", "fb")), "either": F.size(F.array_union("fa", "fb"))})
    links = both.filter((F.col("both") >= SHARED_FIELDS) & (F.col("both") / F.col("either") >= SHARED_PART)).select("a", "b")
    both_ways = links.union(links.select("b", "a")).checkpoint()
    label = sets.select("type", F.col("type").alias("representative")).checkpoint()
    while True:
        told = both_ways.join(label, both_ways["b"] == label["type"]).groupBy("a").agg(F.min("representative").alias("least"))
        heard = label.join(told, label["type"] == told["a"], "left").select("type", F.least("representative", F.coalesce("least", "representative")).alias("heard"))
        jump = label.select(F.col("type").alias("at"), F.col("representative").alias("beyond"))
        after = heard.join(jump, heard["heard"] == jump["at"]).select("type", F.least("heard", "beyond").alias("representative")).checkpoint()
        same = after.join(label.withColumnRenamed("representative", "old"), "type").filter("old <> representative").isEmpty()
        label = after
        if same:
            return label
