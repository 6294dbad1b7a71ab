"""The OpenAPI document of recorded endpoints as YAML, with named schemas referred to."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.operators import schemas
from quillspan.operators.openapi import OPERATION, body_content, is_static_source, operations, places, query_parameters, render_openapi, resolve_collisions, servers, templated, with_operation
from quillspan.operators.schemas import METHOD_ORDER


def statuses(rows: DataFrame) -> DataFrame:
    """(template, method, origin, status): the statuses of the answers of exchanges with an operation; an answer without one counts as 200."""
    r = F.col("response")
    answered = rows.filter((r["status_code"] > 0) | (F.octet_length(r["body"]) > 0))
    return answered.select(*OPERATION, F.when(r["status_code"] > 0, r["status_code"]).otherwise(200).cast("string").alias("status")).distinct()


def component_schemas(named: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(component, schema): the JSON text of each named schema, that of the body which gave the name."""
    sent = body_content(requests, [*OPERATION, "media"]).withColumnRenamed("media", "key").withColumn("place", F.lit("request"))
    told = body_content(responses, [*OPERATION, "status"]).withColumnRenamed("status", "key").withColumn("place", F.lit("response"))
    rank = F.array_position(F.array(*map(F.lit, METHOD_ORDER)), F.col("method"))
    at = F.struct("template", rank.alias("rank"), "place", "key", "origin")
    return named.join(sent.unionByName(told), [*OPERATION, "place", "key"]).groupBy("component").agg(F.min_by("schema", at).alias("schema"))


_PLAIN = re.compile(r"[A-Za-z_/$.<(][^\x00-\x1f]*|[0-9][^\x00-\x1f]*")
_OTHER = re.compile(r"(?i:~|null|true|false|yes|no|on|off|y|n|\.inf|\.nan)|[-+]?[0-9][0-9_]*(\.[0-9]*)?([eE][-+]?[0-9]+)?|0[xob][0-9A-Fa-f]+|[-+]?\.[0-9]+|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*")


def _scalar(value: object) -> str:
    """A scalar in YAML: texts stand plain, in single quotes where they would be read as syntax, in double quotes where they would be read as something else."""
    if not isinstance(value, str):
        return json.dumps(value)
    if not value or _OTHER.fullmatch(value) or re.search(r"[\x00-\x1f\x7f]", value):
        return json.dumps(value, ensure_ascii=False)
    plain = _PLAIN.fullmatch(value) and ": " not in value and " #" not in value and value[-1] not in ": " and not value.startswith("- ")
    return value if plain else "'" + value.replace("'", "''") + "'"


def _yaml(value: object, indent: int) -> list[str]:
    """Lines of a mapping or list, keys in order; a level begins at the next multiple of four, the keys of a list's mapping two behind its dash."""
    below, pad = 4 * ((indent + 4) // 4), " " * indent
    out: list[str] = []
    if isinstance(value, dict):
        for key, inner in sorted(value.items()):
            if isinstance(inner, (dict, list)) and inner:
                out += [f"{pad}{_scalar(key)}:", *_yaml(inner, below)]
            else:
                out.append(f"{pad}{_scalar(key)}: {'{}' if inner == {} else '[]' if inner == [] else _scalar(inner)}")
        return out
    for inner in value:
        lines = _yaml(inner, indent + 2) if isinstance(inner, (dict, list)) and inner else [f"{pad}  {_scalar(inner)}"]
        out += [f"{pad}- {lines[0][indent + 2:]}", *lines[1:]]
    return out


def yaml_text(text: Column, indent: int) -> Column:
    """JSON text as the lines of a YAML mapping at an indent."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(_yaml(json.loads(t), indent)) + "\n" if json.loads(t) else "")

    return shown(text)


def yaml_document(endpoints: DataFrame, target: str = "") -> DataFrame:
    """(yaml): the OpenAPI 3.0 document of deduplicated endpoints, in one canonical order of keys.

    Bodies of named schemas are references; servers are the primary origin and the others that traffic shows, the title is the primary's host. Items and schemas become
    text where they are; the document gathers a text for each path, whatever traffic there was.
    """
    held = with_operation(endpoints).checkpoint()
    rows = templated(places(endpoints)).checkpoint()
    roles = servers(rows, target).checkpoint()
    ops = resolve_collisions(operations(rows), roles).checkpoint()
    kept = ops.select(*OPERATION)
    requests = schemas.request_bodies(held).join(kept, OPERATION, "left_semi").checkpoint()
    responses = schemas.response_bodies(held).join(kept, OPERATION, "left_semi").checkpoint()
    named = schemas.components(requests, responses).checkpoint()
    sources = endpoints.agg(F.coalesce(F.bool_or(is_static_source()), F.lit(False)).alias("from_scripts"))  # without scripts, sources go without saying
    items = render_openapi(ops, query_parameters(endpoints), requests, responses, named, statuses(held).join(kept, OPERATION, "left_semi"), sources)
    gather = lambda rows, name: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "").alias(name))
    key = F.udf(_scalar, "string", useArrow=True)
    paths = gather(items.select(F.col("template").alias("name"), F.concat(F.lit("    "), key("template"), F.lit(":\n"), yaml_text(F.col("item"), 8)).alias("text")), "paths")
    shown = gather(component_schemas(named, requests, responses).select(F.col("component").alias("name"), F.concat(F.lit("        "), "component", F.lit(":\n"), yaml_text(F.col("schema"), 12)).alias("text")), "schemas")
    listed = roles.filter("role <> 'excluded'").select(F.struct(F.col("role") != "primary", "origin").alias("name"), F.concat(F.lit("    - url: "), key("origin"), F.lit("\n")).alias("text"))
    urls = gather(listed, "servers")
    title = roles.filter("role = 'primary'").agg(F.coalesce(F.concat(F.max(U.authority(F.col("origin"))), F.lit(" API")), F.lit("API")).alias("title"))
    one = paths.crossJoin(F.broadcast(shown)).crossJoin(F.broadcast(urls)).crossJoin(F.broadcast(title))  # a row each
    head = F.when(F.col("schemas") != "", F.concat(F.lit("components:\n    schemas:\n"), "schemas")).otherwise("")
    tail = F.when(F.col("servers") != "", F.concat(F.lit("servers:\n"), "servers")).otherwise("")
    return one.select(F.concat(head, F.lit("info:\n    title: "), key("title"), F.lit("\n    version: 1.0.0\nopenapi: 3.0.3\npaths:\n"), "paths", tail).alias("yaml"))
