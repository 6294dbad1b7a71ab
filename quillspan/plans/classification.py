"""Classification queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import classify
from quillspan.sources import views


def _verdict(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        verdict = classify.CLASSIFIERS[kind]().struct(kind)
        return classify.look(views.capture(spark, sf_dir)).select("seq", verdict.alias("v")).select("seq", "v.is_api", F.round("v.confidence", 4).alias("confidence"), "v.reason")

    return query


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = classify.classify(views.capture(spark, sf_dir), classify.FOR_TYPE["auto"])
    return kept.select("seq", "api_type", F.round("confidence", 4).alias("confidence"), "reason")


def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.detect_type(views.capture(spark, sf_dir))


QUERIES = {f"{k}_classify": _verdict(k) for k in classify.CLASSIFIERS} | {"best_match": best_match, "detect_type": detect_type}

#: The plain columns with what the classifiers look at, for the SQL below.
CTE = f"""
flat AS ({views.FLAT}),
seen AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '[?]([^#]*)', 1)) AS query,
  lower(trim(split_part(answer_type, ';', 1))) AS got, lower(trim(split_part(sent_type, ';', 1))) AS sent, upper(method) AS verb FROM flat),
rules AS (SELECT *,
  regexp_matches(path, '[.](js|css|png|jpg|jpeg|gif|ico|woff|woff2|ttf|eot|svg|map)$') AS file,
  regexp_matches(path, '/(static|assets|dist|bundle)/') AS folder,
  (regexp_matches(path, '/(api|rest|rpc)/') OR contains(path, '/graphql') OR regexp_matches(path, '/v[1-9][0-9]*/')) AS api,
  CASE WHEN got IN ('application/json', 'application/xml', 'text/xml', 'application/problem+json', 'application/vnd.api+json', 'application/hal+json') THEN got END AS kind,
  CASE WHEN sent IN ('application/json', 'application/xml', 'text/xml') THEN sent END AS sent_kind,
  CASE WHEN contains(accept, 'html') THEN NULL WHEN contains(accept, 'hal+json') THEN 'application/hal+json' WHEN contains(accept, 'application/json') THEN 'application/json' END AS asked,
  verb IN ('POST', 'PUT', 'PATCH', 'DELETE') AS changing,
  regexp_matches(answer, '^[ \\t\\n\\r]*[\\[{{]') AS json,
  contains(path, '/graphql') AS gpath, verb = 'POST' AND starts_with(body, '{{"query": "query') AS gbody, got = 'application/json' AND starts_with(answer, '{{"data"') AS gdata,
  soap_action <> '' AS action, contains(body, '<soap:Envelope') AS envelope, contains(query, 'wsdl') OR ends_with(path, '/wsdl') AS address, got IN ('text/xml', 'application/soap+xml') AS xml, contains(answer, '<rss') AS rss,
  starts_with(sent, 'application/grpc') AS gsent, NOT starts_with(sent, 'application/grpc') AND starts_with(got, 'application/grpc') AS ggot, grpc_status <> '' AS trailer,
  verb = 'POST' AND regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/[A-Za-z][A-Za-z0-9_.]*/[A-Z][A-Za-z0-9_]*$') AS shape
  FROM seen),
r1 AS (SELECT *, CASE WHEN kind IS NULL THEN 0::DOUBLE ELSE 0.8::DOUBLE END + CASE WHEN api THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS c1,
  CASE WHEN NOT api THEN NULL WHEN asked IS NOT NULL THEN concat('accept:', asked) WHEN sent_kind IS NOT NULL AND sent_kind IS DISTINCT FROM kind THEN concat('content-type:', sent_kind) END AS signal FROM rules),
r2 AS (SELECT *, greatest(c1, CASE WHEN changing THEN 0.7::DOUBLE ELSE 0 END, CASE WHEN json THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN signal IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END) AS c2 FROM r1),
r3 AS (SELECT *, api AND c2 < 0.5 AND source IN ('static:js', 'static:js-sourcemap', 'static:js-concat') AS candidate FROM r2),
v AS (SELECT *,
  CASE WHEN file OR folder THEN 0::DOUBLE WHEN candidate THEN 0.5::DOUBLE ELSE c2 END AS rest_c,
  concat_ws('+', 'content-type:' || kind, CASE WHEN api THEN 'path-heuristic' END, CASE WHEN changing THEN 'method:' || verb END, CASE WHEN json THEN 'response-structure:json' END, 'request-signal:' || signal, CASE WHEN candidate THEN 'static-js-candidate' END) AS rest_r,
  CASE WHEN file OR NOT (gpath OR gbody) THEN 0::DOUBLE ELSE greatest(CASE WHEN gpath AND gbody THEN 0.95::DOUBLE WHEN gbody THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END, CASE WHEN gdata THEN 0.8::DOUBLE ELSE 0 END) END AS graphql_c,
  concat_ws('+', CASE WHEN gpath THEN 'graphql-path' END, CASE WHEN gbody THEN 'graphql-body' END, CASE WHEN gdata AND (gpath OR gbody) THEN 'graphql-response' END) AS graphql_r,
  CASE WHEN file THEN 0::DOUBLE WHEN action THEN 0.95::DOUBLE WHEN envelope OR address THEN 0.9::DOUBLE WHEN xml AND rss THEN 0.3::DOUBLE WHEN xml THEN 0.85::DOUBLE ELSE 0::DOUBLE END AS wsdl_c,
  concat_ws('+', CASE WHEN action THEN 'soapaction-header' END, CASE WHEN envelope THEN 'soap-envelope' END, CASE WHEN address THEN 'wsdl-url' END, CASE WHEN xml THEN 'soap-content-type' END) AS wsdl_r,
  CASE WHEN (gsent OR ggot) AND trailer THEN 0.99::DOUBLE WHEN gsent OR ggot THEN 0.95::DOUBLE WHEN trailer THEN 0.8::DOUBLE WHEN shape THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS grpc_c,
  concat_ws('+', CASE WHEN gsent THEN 'grpc-content-type' END, CASE WHEN ggot THEN 'grpc-response-content-type' END, CASE WHEN trailer THEN 'grpc-trailer-header' END, CASE WHEN shape THEN 'grpc-path-shape' END) AS grpc_r
  FROM r3)
"""

ORACLES = {f"{k}_classify": f"WITH {CTE} SELECT seq, {k}_c > 0 AS is_api, round({k}_c, 4) AS confidence, CASE WHEN {k}_c > 0 THEN {k}_r ELSE '' END AS reason FROM v" for k in classify.CLASSIFIERS}
ORACLES["best_match"] = f"""WITH {CTE},
long AS (SELECT seq, 'rest' AS api_type, rest_c AS c, rest_r AS reason, 1 AS ord FROM v UNION ALL SELECT seq, 'graphql', graphql_c, graphql_r, 2 FROM v UNION ALL SELECT seq, 'wsdl', wsdl_c, wsdl_r, 3 FROM v UNION ALL SELECT seq, 'grpc', grpc_c, grpc_r, 4 FROM v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY c DESC, ord) AS n FROM long)
SELECT seq, api_type, round(c, 4) AS confidence, reason FROM ranked WHERE n = 1 AND c >= 0.5"""
ORACLES["detect_type"] = f"""WITH {CTE}, n AS (SELECT count(*) FILTER (rest_c >= 0.5) AS rest_rows, count(*) FILTER (wsdl_c >= 0.5) AS wsdl_rows, count(*) FILTER (graphql_c >= 0.5) AS graphql_rows FROM v)
SELECT *, CASE WHEN graphql_rows > 0 AND graphql_rows >= greatest(wsdl_rows, rest_rows) THEN 'graphql' WHEN wsdl_rows > 0 AND wsdl_rows >= rest_rows THEN 'wsdl' ELSE 'rest' END AS api_type FROM n"""
