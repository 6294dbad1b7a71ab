"""Recorded traffic made from the test tables: one SQL text that Spark and DuckDB both read.

``FLAT`` gives plain columns, one row for each exchange; :func:`capture` turns them into exchange records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.sources.schema import EXCHANGE

_TABLES = ("orders", "customer", "part", "supplier", "events", "pages")

FLAT = """
SELECT o_orderkey * 8 AS seq,
  CASE o_orderstatus WHEN 'O' THEN 'GET' WHEN 'F' THEN 'post' ELSE 'PUT' END AS method,
  concat(CASE o_custkey % 4 WHEN 0 THEN 'https://API.example.com:443' WHEN 1 THEN 'http://alt.example.com:8080' ELSE 'https://api.example.com' END,
    '/api/v1/orders/', CAST(o_orderkey % 400 AS STRING),
    CASE WHEN o_orderkey % 3 = 0 THEN concat('?page=', CAST(o_orderkey % 5 AS STRING), '&tag=', substr(o_orderpriority, 1, 1), '&tag=', CAST(o_custkey % 3 AS STRING))
         WHEN o_orderkey % 3 = 1 THEN concat('?page=', CAST(o_orderkey % 7 AS STRING), '&price=', CAST(o_custkey % 9 AS STRING), '.5&full=', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END) ELSE '' END) AS url,
  CASE WHEN o_orderkey % 6 = 0 THEN 'text/html, application/json' WHEN o_orderkey % 6 = 1 THEN 'application/hal+json;q=0.9, */*' ELSE '' END AS accept,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'application/json; charset=utf-8' END AS sent_type,
  '' AS soap_action,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('{"customer": ', CAST(o_custkey % 10 AS STRING), '}') END AS body,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Application/JSON; charset=utf-8' END AS answer_type,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' [{"id": ', CAST(o_orderkey AS STRING), '}]') END AS answer,
  '' AS grpc_status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'static:js-concat' ELSE 'browser' END AS source,
  'https://shop.example.com/' AS page_url
FROM orders
UNION ALL
SELECT c_custkey * 8 + 1, 'GET',
  concat('https://api.example.com/customers/', CAST(c_custkey AS STRING), '/segments/', lower(c_mktsegment)),
  '', '', '', '', CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 200 END, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'application/json' END, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '{"name": "x"}' END, '', 'http', 'https://shop.example.com/c'
FROM customer
UNION ALL
SELECT p_partkey * 8 + 2, CASE WHEN p_size % 5 = 0 THEN 'POST' ELSE 'GET' END,
  concat('https://shop.example.com/', CASE p_size % 7 WHEN 0 THEN 'static/app.js' WHEN 1 THEN 'img/logo.PNG' WHEN 2 THEN 'feed' WHEN 3 THEN 'StockService.asmx?WSDL' WHEN 4 THEN 'soap/stock' WHEN 5 THEN 'rpc/v2' ELSE concat('api/v12/parts/', CAST(p_partkey AS STRING)) END),
  CASE WHEN p_partkey % 2 = 0 THEN 'application/json' ELSE '' END, CASE WHEN p_size % 7 = 4 THEN 'text/xml' ELSE '' END,
  CASE WHEN p_size % 7 = 4 AND p_partkey % 2 = 0 THEN '"urn:stock#GetStock"' ELSE '' END,
  CASE WHEN p_size % 7 = 4 THEN concat('<soap:Envelope', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' xmlns:soap="http://schemas.xmlsoap.org/soap/envelope/"' END, '><soap:Body><GetStock><part>', CAST(p_partkey AS STRING), '</part></GetStock></soap:Body></soap:Envelope>') ELSE '' END,
  200, CASE WHEN p_size % 7 IN (2, 3, 4) THEN 'text/xml' WHEN p_size % 7 = 0 THEN 'application/javascript' ELSE 'text/plain' END,
  CASE p_size % 7 WHEN 2 THEN '<?xml version="1.0"?><rss></rss>' WHEN 3 THEN '<definitions/>' ELSE '' END, '', 'static:js', 'https://shop.example.com/p'
FROM part
UNION ALL
SELECT s_suppkey * 8 + 3, 'POST', concat('https://grpc.example.com/shop.v1.Catalog/', CASE WHEN s_nationkey % 3 = 0 THEN 'Get' WHEN s_nationkey % 3 = 1 THEN 'List' ELSE 'watch' END),
  '', CASE WHEN s_suppkey % 2 = 0 THEN 'application/grpc+proto' ELSE '' END, '', '', 200, CASE WHEN s_suppkey % 3 = 0 THEN 'application/grpc' ELSE '' END, '', CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE '' END, 'import:har', ''
FROM supplier
UNION ALL
SELECT event_id * 8 + 4, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END,
  concat('https://events.example.com/', CASE WHEN user_id % 3 = 0 THEN 'graphql' WHEN user_id % 3 = 1 THEN concat('v2/', event_type) ELSE event_type END),
  '', 'application/json', '',
  CASE WHEN user_id % 2 = 0 THEN concat('{"query": "', CASE WHEN user_id % 4 = 0 THEN 'query Q { user { id } }' ELSE 'show user' END, '", "variables": ', props, '}') ELSE props END,
  200, 'application/json', CASE WHEN user_id % 5 = 0 THEN '{"data": null}' WHEN user_id % 5 = 1 THEN '{"items": []}' ELSE '' END, '', 'browser', 'https://shop.example.com/e'
FROM events
UNION ALL
SELECT page_id * 8 + 5, 'GET', url, 'text/html', '', '', '', 200, 'text/html; charset=utf-8', html, '', 'browser', url
FROM pages
"""


def flat(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The plain columns of :data:`FLAT` (or those named) over the tables of a folder."""
    sql = FLAT
    for table in _TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"recorded_{table}")
        sql = sql.replace(f"\nFROM {table}\n", f"\nFROM recorded_{table}\n")
    rows = spark.sql(sql).select(*(columns or ["*"]))
    # a generator stands for the scan that recorded traffic would be: what is above sees columns, not the expressions that make them
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def as_exchanges(plain: DataFrame) -> DataFrame:
    """Exchange records of the plain columns."""

    def headers(**given: str):
        pairs = F.filter(F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), F.col(c).alias("value")) for k, c in given.items()]), lambda p: p["value"] != "")
        return F.map_from_entries(pairs)

    response = F.struct(
        F.col("status").cast("int").alias("status_code"),
        headers(Grpc_Status="grpc_status").alias("headers"),
        F.col("answer_type").alias("content_type"),
        F.when(F.col("answer") != "", F.col("answer").cast("binary")).alias("body"),
    )
    rows = plain.select(
        "seq",
        "method",
        "url",
        headers(Accept="accept", Content_Type="sent_type", SOAPAction="soap_action").alias("headers"),
        U.query_params(F.col("url")).alias("query_params"),
        F.when(F.col("body") != "", F.col("body").cast("binary")).alias("body"),
        response.alias("response"),
        "source",
        F.lit("").alias("tag"),
        F.lit("").alias("attribute"),
        "page_url",
    )
    return rows.select(*[F.col(name).cast(kind) for name, kind in EXCHANGE.items()])


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_exchanges(flat(spark, sf_dir))
