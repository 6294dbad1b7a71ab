"""Deduplication and path-template queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.operators import classify, dedup, paths
from quillspan.plans.classification import CTE
from quillspan.sources import views
from quillspan.sources.shared import ensure_shared_dir


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(views.capture(spark, sf_dir), classify.FOR_TYPE["auto"])


def dedup_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.deduplicate(classified(spark, sf_dir))
    return rows.select("dedup_key", "seq", "url", "repeats", "api_type", F.round("confidence", 4).alias("confidence"), "reason")


def dedup_best_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.deduplicate(classified(spark, sf_dir))
    return rows.select("dedup_key", F.col("response.status_code").alias("status"), F.col("response.content_type").alias("content_type"), F.coalesce(F.col("response.body").cast("string"), F.lit("")).alias("body"))


def dedup_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.deduplicate(classified(spark, sf_dir)).select("dedup_key", "multi_value_query_keys", F.explode("query_params").alias("name", "values"))
    return rows.select("dedup_key", "name", F.array_join("values", "|").alias("values"), F.coalesce(F.try_element_at("multi_value_query_keys", F.col("name")), F.lit(False)).alias("several"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flat(spark, sf_dir, "url").select(U.path(F.col("url")).alias("path"))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.classify_paths(_paths(spark, sf_dir)).select("path", F.array_join("kinds", "/").alias("kinds"))


def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.normalize(_paths(spark, sf_dir))


def slug_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.varying_positions(paths.classify_paths(_paths(spark, sf_dir)), 3).withColumnRenamed("at", "place")


def slug_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    return paths.normalize(_paths(spark, sf_dir), merge_slugs=True, threshold=3)


QUERIES = {f.__name__: f for f in (dedup_endpoints, dedup_best_response, dedup_query_union, path_kinds, path_template, slug_positions, slug_template)}

_KEPT = f"""{CTE},
long AS (SELECT seq, 'rest' AS api_type, rest_c AS c, rest_r AS reason, 1 AS ord FROM v UNION ALL SELECT seq, 'graphql', graphql_c, graphql_r, 2 FROM v UNION ALL SELECT seq, 'wsdl', wsdl_c, wsdl_r, 3 FROM v UNION ALL SELECT seq, 'grpc', grpc_c, grpc_r, 4 FROM v),
kept AS (SELECT flat.*, b.api_type, b.c, b.reason FROM flat JOIN (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY c DESC, ord) AS n FROM long) b USING (seq) WHERE b.n = 1 AND b.c >= 0.5),
keyed AS (SELECT *, concat_ws(':', method, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), CASE WHEN soap_action <> '' THEN trim(soap_action, '"') END,
  CASE WHEN body <> '' AND sent_type <> '' THEN lower(trim(split_part(sent_type, ';', 1))) END, CASE WHEN body <> '' THEN left(sha256(body), 16) END) AS dedup_key FROM kept)"""

ORACLES = {
    "dedup_endpoints": f"""WITH {_KEPT}, best AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY c DESC, api_type DESC, reason DESC) AS n FROM keyed)
SELECT dedup_key, f.seq, f.url, f.repeats, b.api_type, round(b.c, 4) AS confidence, b.reason
FROM (SELECT dedup_key, min(seq) AS seq, arg_min(url, seq) AS url, count(*) AS repeats FROM keyed GROUP BY dedup_key) f JOIN best b USING (dedup_key) WHERE b.n = 1""",
    "dedup_best_response": f"""WITH {_KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY NOT (status > 0 OR answer <> '' OR answer_type <> ''), status, answer_type, answer, seq) AS n FROM keyed)
SELECT dedup_key, status::INTEGER AS status, answer_type AS content_type, answer AS body FROM r WHERE n = 1""",
    "dedup_query_union": f"""WITH {_KEPT}, parts AS (SELECT dedup_key, seq, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS part, generate_subscripts(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), 1) AS pos FROM keyed),
pairs AS (SELECT dedup_key, seq, pos, split_part(part, '=', 1) AS name, CASE WHEN contains(part, '=') THEN substr(part, strpos(part, '=') + 1) ELSE '' END AS value FROM parts WHERE part <> ''),
firsts AS (SELECT dedup_key, name, value, min(seq * 1000 + pos) AS place FROM pairs GROUP BY ALL),
sev AS (SELECT dedup_key, name, max(n) > 1 AS several FROM (SELECT dedup_key, seq, name, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL)
SELECT dedup_key, name, string_agg(value, '|' ORDER BY place) AS values, any_value(several) AS several FROM firsts JOIN sev USING (dedup_key, name) GROUP BY dedup_key, name""",
}
_SEGMENTS = f"""
paths AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM ({views.FLAT})),
segs AS (SELECT path, unnest(string_split(path, '/')) AS segment, generate_subscripts(string_split(path, '/'), 1) - 1 AS place, len(string_split(path, '/')) AS len FROM paths),
kinds AS (SELECT *, CASE WHEN segment IN ('me', 'current', 'self', 'new', 'list', 'search') THEN 'literal'
  WHEN regexp_matches(segment, '(?i)^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') THEN 'uuid' WHEN regexp_matches(segment, '^[0-9a-fA-F]{{24}}$') THEN 'objectid'
  WHEN regexp_matches(segment, '^[0-9]+$') THEN 'number' WHEN regexp_matches(segment, '^[0-9a-fA-F]{{6,12}}$') AND regexp_matches(segment, '[0-9A-F]') THEN 'hash'
  WHEN regexp_matches(segment, '^[A-Za-z0-9+/_-]{{16,}}={{0,2}}$') AND (regexp_matches(segment, '[+/=]') OR (regexp_matches(segment, '[A-Z]') AND regexp_matches(segment, '[a-z]') AND regexp_matches(segment, '[0-9]'))) THEN 'token' ELSE 'literal' END AS kind FROM segs)"""
_NAMES = """
withword AS (SELECT k.*, (SELECT arg_max(p.segment, p.place) FROM {k} p WHERE p.path = k.path AND p.place < k.place AND p.kind = 'literal' AND p.segment <> '') AS word FROM {k} k),
named AS (SELECT *, CASE WHEN kind = 'literal' THEN NULL WHEN word IS NULL THEN CASE kind WHEN 'token' THEN 'token' WHEN 'slug' THEN 'slug' ELSE 'id' END
  ELSE concat(CASE WHEN ends_with(word, 'ies') THEN concat(left(word, len(word) - 3), 'y') WHEN ends_with(word, 'sses') THEN left(word, len(word) - 2) WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN left(word, len(word) - 1) ELSE word END,
    CASE kind WHEN 'token' THEN 'Token' WHEN 'slug' THEN 'Slug' ELSE 'Id' END) END AS name FROM withword),
clean AS (SELECT *, regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(name, '[.-]', '-', 'g'), '-'), lambda p, i: CASE WHEN i = 1 THEN p ELSE concat(upper(left(p, 1)), substr(p, 2)) END), 'string_agg', ''), '[^A-Za-z0-9_]', '', 'g') AS shown FROM named),
numbered AS (SELECT *, CASE WHEN shown IS NULL THEN segment ELSE concat('{{', shown, CASE WHEN row_number() OVER (PARTITION BY path, shown ORDER BY place) > 1 THEN CAST(row_number() OVER (PARTITION BY path, shown ORDER BY place) AS STRING) ELSE '' END, '}}') END AS part FROM clean)
SELECT path, string_agg(part, '/' ORDER BY place) AS template FROM numbered GROUP BY path"""
_SHAPES = """
shapes AS (SELECT k.*, (SELECT coalesce(string_agg(CASE WHEN p.kind = 'literal' THEN p.segment ELSE '{{}}' END, '/' ORDER BY p.place), '') FROM {k} p WHERE p.path = k.path AND p.place < k.place) AS prefix,
  (SELECT coalesce(string_agg(CASE WHEN p.kind = 'literal' THEN p.segment ELSE '{{}}' END, '/' ORDER BY p.place), '') FROM {k} p WHERE p.path = k.path AND p.place > k.place) AS suffix,
  EXISTS (SELECT 1 FROM {k} p WHERE p.path = k.path AND p.place < k.place AND p.kind = 'literal' AND p.segment <> '' AND NOT regexp_matches(p.segment, '^(api|apis|rest|v[1-9][0-9]*)$')) AS led FROM {k} k),
varying AS (SELECT prefix, place, suffix, len, count(DISTINCT segment) AS literals FROM shapes WHERE kind = 'literal' AND segment <> '' AND led AND segment NOT IN ('me', 'current', 'self', 'new', 'list', 'search') GROUP BY ALL HAVING count(DISTINCT segment) >= 3)"""
ORACLES["path_kinds"] = f"WITH {_SEGMENTS} SELECT path, string_agg(kind, '/' ORDER BY place) AS kinds FROM kinds GROUP BY path"
ORACLES["path_template"] = f"WITH {_SEGMENTS}, {_NAMES.format(k='kinds')}"
ORACLES["slug_positions"] = f"WITH {_SEGMENTS}, {_SHAPES.format(k='kinds')} SELECT prefix, place::INTEGER AS place, suffix, len::INTEGER AS len, literals FROM varying"
