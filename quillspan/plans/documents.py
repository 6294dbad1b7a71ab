"""Queries of specification documents, forms and like types, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import classify, enrich, forms, specs
from quillspan.sources import views
from quillspan.sources.shared import ensure_shared_dir


def descriptor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by part: each imports that of half its number, and every tenth the next one, which closes cycles."""
    ensure_shared_dir(spark)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("file"))
    halves = parts.filter("file > 1").select("file", F.floor(F.col("file") / 2).alias("dependency"))
    imports = halves.union(parts.filter("file % 10 = 0").select("file", (F.col("file") + 1).alias("dependency")))
    return enrich.descriptor_closure(imports, parts.filter("file <= 100").select(F.col("file").alias("root"), "file"))


def grpc_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.grpc_services(classify.classify(views.capture(spark, sf_dir), ["grpc"]))


def proto_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.render_proto(grpc_services(spark, sf_dir))


def graphql_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.graphql_operations(views.capture(spark, sf_dir))


def type_unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.col("l_orderkey") % 40
    fields = lines.select(F.concat(F.lit("T"), F.lpad(kind.cast("string"), 2, "0")).alias("type"), F.concat(F.lit("f"), (kind % 9).cast("string"), F.lit("_"), (F.col("l_suppkey") % 10).cast("string")).alias("field"))
    return specs.like_types(fields)


def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    # "nonce" is no secret name, "jwt" is one
    made = F.concat(F.lit('<html><form action="/find?in='), (key % 3).cast("string"), F.lit('" method="'), F.when(F.col("o_orderstatus") == "F", "post").otherwise("get"), F.lit('"><input name="q" value="'), F.col("o_custkey").cast("string"), F.lit('"><input name="nonce" value="'), (key % 7).cast("string"), F.lit('"><input name="jwt" value="s"><input type="submit" name="go"></form></html>'))
    pages = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("https://shop.example.com/p/"), F.col("o_orderkey").cast("string")).alias("url"), F.struct(F.lit("text/html").alias("content_type"), made.cast("binary").alias("body")).alias("response"))
    return forms.extract_forms(pages).select("seq", "method", "url", F.coalesce("body", F.lit("")).alias("body"), "source")


QUERIES = {f.__name__: f for f in (descriptor_closure, grpc_services, proto_document, graphql_operations, type_unification, page_forms)}
ORACLES = {
    "descriptor_closure": """WITH RECURSIVE i AS (SELECT p_partkey AS file, p_partkey // 2 AS dependency FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 10 = 0),
r(root, file, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey <= 100 UNION SELECT root, dependency, depth + 1 FROM r JOIN i USING (file) WHERE depth < 40)
SELECT root, file, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""",
    "grpc_services": f"SELECT regexp_extract(url, '^[a-z]+://[^/]+/([A-Za-z][A-Za-z0-9_.]*)/([A-Z][A-Za-z0-9_]*)$', 1) AS service, regexp_extract(url, '/([A-Z][A-Za-z0-9_]*)$', 1) AS method, min(seq) AS first_seq FROM ({views.FLAT}) WHERE method ILIKE 'post' AND regexp_matches(url, '^[a-z]+://[^/]+/[A-Za-z][A-Za-z0-9_.]*/[A-Z][A-Za-z0-9_]*$') GROUP BY ALL",
    "proto_document": f"""WITH m AS (SELECT DISTINCT regexp_extract(url, '/([A-Z][A-Za-z]*)$', 1) AS method FROM ({views.FLAT}) WHERE starts_with(url, 'https://grpc.') AND regexp_matches(url, '/[A-Z][A-Za-z]*$'))
SELECT 'shop.v1' AS package, concat('syntax = "proto3";' || chr(10) || 'package shop.v1;' || chr(10) || 'service Catalog {{' || chr(10), string_agg('  rpc ' || method || ' (' || method || 'Request) returns (' || method || 'Response);' || chr(10), '' ORDER BY method), '}}' || chr(10),
  string_agg('message ' || method || 'Request {{}}' || chr(10) || 'message ' || method || 'Response {{}}' || chr(10), '' ORDER BY method)) AS proto FROM m""".replace("{{", "{").replace("}}", "}"),
    "graphql_operations": f"SELECT 'query' AS kind, 'Q' AS name, 'user' AS field, min(seq) AS first_seq, count(*) AS n FROM ({views.FLAT}) WHERE starts_with(body, '{{\"query\": \"query Q') HAVING count(*) > 0",
    "type_unification": """WITH RECURSIVE f AS (SELECT DISTINCT concat('T', lpad((l_orderkey % 40)::STRING, 2, '0')) AS type, concat('f', ((l_orderkey % 40) % 9)::STRING, '_', (l_suppkey % 10)::STRING) AS field FROM lineitem),
n AS (SELECT type, count(*) AS n FROM f GROUP BY type),
s AS (SELECT a.type AS a, b.type AS b, count(*) AS both_ FROM f a JOIN f b USING (field) WHERE a.type <> b.type GROUP BY ALL),
l AS (SELECT a, b FROM s JOIN n x ON x.type = a JOIN n y ON y.type = b WHERE both_ >= 3 AND both_ / (x.n + y.n - both_) >= 0.5),
r(type, reached) AS (SELECT type, type FROM n UNION SELECT r.type, l.b FROM r JOIN l ON l.a = r.reached)
SELECT type, min(reached) AS representative FROM r GROUP BY type""",
    "page_forms": """SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'POST' ELSE 'GET' END AS method, concat('https://shop.example.com/find?in=', o_orderkey % 3, CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat('&jwt=&nonce=', o_orderkey % 7, '&q=', o_custkey::STRING) END) AS url,
CASE WHEN o_orderstatus = 'F' THEN concat('jwt=&nonce=', o_orderkey % 7, '&q=', o_custkey::STRING) ELSE '' END AS body, 'static:html' AS source FROM orders""",
}
