"""Queries of the importers, over one made document for each order, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import mitm, readers, views


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"), (F.col("o_orderkey") % 2 == 0).alias("even"))


def _shown(rows: DataFrame) -> DataFrame:
    text = lambda b: F.coalesce(b.cast("string"), F.lit(""))
    r = F.col("response")
    return rows.select("method", "url", F.coalesce(F.element_at("headers", F.lit("X-K")), F.lit("")).alias("header"), text(F.col("body")).alias("body"), F.coalesce(r["status_code"], F.lit(0)).alias("status"), F.coalesce(r["content_type"], F.lit("")).alias("content_type"), text(r["body"]).alias("answer"), F.array_join(F.element_at("query_params", F.lit("q")), "|").alias("q"), "source")


def import_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written and read back: records of the recorded traffic's view."""
    rows = readers.capture_records(views.capture(spark, sf_dir))
    texts = rows.select(F.concat(F.lit("["), F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])), F.lit("]")).alias("value"))
    back = readers.captures(texts)
    text = lambda b: F.coalesce(b.cast("string"), F.lit(""))
    return back.groupBy("method", "source").agg(F.count("*").alias("n"), F.sum(F.length(text(F.col("body")))).alias("sent"), F.sum(F.length(text(F.col("response.body")))).alias("told"), F.sum(F.col("response.status_code").cast("long")).alias("statuses"), F.sum(F.coalesce(F.size("query_params"), F.lit(0)).cast("long")).alias("names"))


def import_har(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(
        F.lit('{"request":{"method":"PUT","url":"https://h.example/a/'), "k", F.lit("?q=1&q="), "c", F.lit('","headers":[{"name":"X-K","value":"old"},{"name":"X-K","value":"'), "k", F.lit('"},{"name":"","value":"x"}],"postData":{"text":"b'), "c",
        F.lit('"}},"response":{"status":201,"headers":[{"name":"Content-Type","value":"text/x"}],"content":{'), F.when(F.col("even"), '"mimeType":"application/json",').otherwise(""), F.lit('"text":"t'), "k", F.lit('"}}}'),
    )
    return _shown(readers.har_documents(_orders(spark, sf_dir).select(F.concat(F.lit('{"log":{"entries":['), entry, F.lit("]}}")).alias("value"))))


def import_burp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with messages in base64 or as text; half of them with a status of their own."""
    asked = F.concat(F.lit("POST /a/"), "k", F.lit("?q="), "c", F.lit(" HTTP/1.1\r\nHost: h.example\r\nX-K: "), "k", F.lit("\r\nX-K: "), "c", F.lit("\r\n\r\nb: "), "c")
    told = F.concat(F.lit("HTTP/1.1 404 Not Found\nContent-Type: text/x\n\nt"), "k")
    coded = lambda text: F.struct(F.when(F.col("even"), F.base64(F.encode(text, "UTF-8"))).otherwise(text).alias("_VALUE"), F.when(F.col("even"), "TRUE").otherwise("false").alias("_base64"))
    items = _orders(spark, sf_dir).select(F.concat(F.lit(" https://h.example/a/"), "k", F.lit("?q="), "c").alias("url"), coded(asked).alias("request"), coded(told).alias("response"), F.when(F.col("even"), "200").alias("status"))
    return _shown(readers.burp_items(items))


def import_mitmproxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in JSON, an object or an array."""
    flow = F.concat(
        F.lit('{"request":{"method":"get","scheme":"'), F.when(F.col("even"), 'https","port":443').otherwise('http","port":8080'), F.lit(',"host":"h.example","path":"/a/'), "k", F.lit("?q="), "c", F.lit('","headers":[["X-K","'), "k", F.lit('"],["odd"]],"content":""}'),
        F.when(F.col("even"), F.concat(F.lit(',"response":{"status_code":200,"headers":[["content-type","text/x"]],"content":"t'), "k", F.lit('"}'))).otherwise(""), F.lit("}"),
    )
    return _shown(readers.mitmproxy_documents(_orders(spark, sf_dir).select(F.when(F.col("even"), flow).otherwise(F.concat(F.lit("["), flow, F.lit("]"))).alias("value"))))


def import_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native dumps of two flows, of which one is no HTTP flow."""

    def element(kind: str, *parts: Column | str) -> Column:
        payload = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.concat(F.length(payload).cast("string"), F.lit(":"), payload, F.lit(kind))

    text = lambda *parts: element(",", *parts)
    k, c = F.col("k"), F.col("c")
    headers = element("]", element("]", text("X-K"), text(k)))
    asked = element("}", text("method"), text("DELETE"), text("scheme"), text("https"), text("host"), text("h.example"), text("port"), element("#", "443"), text("path"), text("/a/", k, "?q=", c), text("headers"), headers, text("content"), element("~", ""))
    told = element("}", text("status_code"), element("#", "204"), text("headers"), element("]", element("]", text("Content-Type"), text("text/x"))), text("content"), text("t", k))
    dump = F.concat(element("}", text("type"), text("tcp")), element("}", text("type"), text("http"), text("request"), asked, text("response"), told))
    return _shown(mitm.native_dumps(_orders(spark, sf_dir).select(dump.cast("binary").alias("content"))))


QUERIES = {f.__name__: f for f in (import_capture, import_har, import_burp, import_mitmproxy, import_native)}
_O = "WITH o AS (SELECT o_orderkey::STRING AS k, o_custkey::STRING AS c, o_orderkey % 2 = 0 AS even FROM orders)"
ORACLES = {
    "import_capture": f"""WITH f AS ({views.FLAT}) SELECT method, source, count(*) AS n, sum(length(body))::BIGINT AS sent, sum(length(answer))::BIGINT AS told, sum(status)::BIGINT AS statuses,
  sum(len(list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1)))))::BIGINT AS names FROM f GROUP BY ALL""",
    "import_har": f"{_O} SELECT 'PUT' AS method, 'https://h.example/a/' || k || '?q=1&q=' || c AS url, k AS header, 'b' || c AS body, 201 AS status, CASE WHEN even THEN 'application/json' ELSE 'text/x' END AS content_type, 't' || k AS answer, '1|' || c AS q, 'import:har' AS source FROM o",
    "import_burp": f"{_O} SELECT 'POST' AS method, 'https://h.example/a/' || k || '?q=' || c AS url, c AS header, 'b: ' || c AS body, CASE WHEN even THEN 200 ELSE 404 END AS status, 'text/x' AS content_type, 't' || k AS answer, c AS q, 'import:burp' AS source FROM o",
    "import_mitmproxy": f"{_O} SELECT 'GET' AS method, CASE WHEN even THEN 'https://h.example/a/' ELSE 'http://h.example:8080/a/' END || k || '?q=' || c AS url, k AS header, '' AS body, CASE WHEN even THEN 200 ELSE 0 END AS status, CASE WHEN even THEN 'text/x' ELSE '' END AS content_type, CASE WHEN even THEN 't' || k ELSE '' END AS answer, c AS q, 'import:mitmproxy' AS source FROM o",
    "import_native": f"{_O} SELECT 'DELETE' AS method, 'https://h.example/a/' || k || '?q=' || c AS url, k AS header, '' AS body, 204 AS status, 'text/x' AS content_type, 't' || k AS answer, c AS q, 'import:mitmproxy' AS source FROM o",
}
