"""Queries of scripts, pages, headers, addresses, recorded probes and wire formats, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.functions.rows import dealt, settle
from quillspan.operators import bundles, classify, enrich, pages, wire
from quillspan.plans.classification import CTE
from quillspan.sources import views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundle_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in one made bundle for each order."""
    key, customer, odd = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 2
    script = F.concat(
        F.lit('fetch("/api/orders/'), customer, F.lit('",{method:"PUT",body:JSON.stringify({total:1,"at":f(1,2),items})});axios.get(`/api/customers/${c.id}/x/${g()}`);fetch("/logo.png");fetch(`${base}`);'),
        F.when(odd == 0, F.concat(F.lit('axios.post("//evil.example/api/x",{a:1});axios({url:"/api/cfg",data:{q:1}});'))).otherwise('p="/api/parts/"+id+"/stock";'),
        F.when(key % 3 == 0, F.lit("fetch('/api/form',{body:fd})")).otherwise(""),
    )
    rows = settle(dealt(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")), response=F.struct(F.lit("application/javascript").alias("content_type"), script.cast("binary").alias("body")))
    rows = rows.select(key.alias("seq"), F.lit("https://shop.example.com/static/app.js").alias("url"), F.when(odd == 0, "https://shop.example.com/cart").otherwise("").alias("page_url"), "response")
    return bundles.analyze(rows).select("seq", "nth", "method", "url", F.coalesce("body", F.lit("")).alias("body"), "source", "page_url")


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline scripts of pages and how long they are."""
    return pages.inline_scripts(_table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("scripts"), F.sum(F.length("script")).alias("chars"))


def page_script_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files of pages: their own, and three that are made, of which one is named twice and one is no script."""
    made = F.concat("html", F.lit('<script src="/a/main.JS?v=1"></script><script async src=\'lib.mjs\'></script><SCRIPT src="/a/main.JS?v=1"></SCRIPT><script type="importmap" src="/map.json"></script>'))
    return pages.script_urls(_table(spark, sf_dir, "pages").withColumn("html", made)).select("page_id", F.col("pos").cast("long").alias("pos"), "script")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sizes(views.capture(spark, sf_dir))


def explain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explain(classify.classify(views.capture(spark, sf_dir), ["rest"]))


def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal addresses made of order and customer keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    four = F.concat_ws(".", (k % 256).cast("string"), (c % 256).cast("string"), (k % 7).cast("string"), F.lit("9"))
    six = F.concat(F.element_at(F.array(*map(F.lit, ("fe80", "fd00", "2001:db8", "2002", "64:ff9b"))), (k % 5 + 1).cast("int")), F.lit("::"), F.lower(F.hex(c % 65536)))
    rows = _table(spark, sf_dir, "orders").select(F.when(k % 11 == 0, six).when(k % 13 == 0, "").when(k % 17 == 0, "host.example").otherwise(four).alias("address"))
    return rows.groupBy(U.is_private_ip(F.col("address")).alias("private")).agg(F.count("*").alias("n"))


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines made of orders, as names and values."""
    k = F.col("o_orderkey") % 6
    line = F.when(k == 0, F.concat(F.lit("X-Id :  "), F.col("o_custkey").cast("string"))).when(k == 1, "no colon").when(k == 2, " : empty").when(k == 3, "Bad Name: x").when(k == 4, F.concat(F.lit("A: b"), F.char(F.lit(13)), F.lit("c"))).otherwise("Via: a:b, c")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), H.parse_header(line).alias("h"))
    return rows.filter("h IS NOT NULL").select("id", "h.name", "h.value")


def cookie_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies of two headers that are one but for case."""
    key = F.col("o_orderkey").cast("string")
    headers = F.create_map(F.lit("cookie"), F.concat(F.lit("b="), key, F.lit("; flag; =x")), F.lit("Cookie"), F.concat(F.lit("a=1=2;c= "), key, F.lit(" ")), F.lit("Host"), F.lit("h"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), H.cookie_header(headers).alias("c"))
    return rows.select("id", F.size("c.rest").alias("others"), F.inline(H.cookies(F.col("c.cookie"))))


def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://u:p"), c, F.lit("@h.example/a?b="), c)).when(k == 1, F.concat(F.lit("https://h.example/@"), c)).when(k == 2, F.concat(F.lit("http:u:p@h/"), c)).otherwise(F.concat(F.lit("https://h.example/"), c))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), U.redact(url).alias("url"))


def schema_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flat(spark, sf_dir, "seq", "url", "method", "status", "answer_type", "answer")
    answers = rows.filter("upper(method) = 'GET'").select("seq", "url", "status", F.col("answer_type").alias("content_type"), F.col("answer").cast("binary").alias("body"))
    return enrich.with_schemas(rows.select("seq", "url"), answers).select("seq", F.coalesce("schema", F.lit("")).alias("schema"))


def wsdl_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' services with the WSDL that was recorded for them; some answers are none."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("https://shop.example.com/s"), (k % 20).cast("string"))
    url = F.when(k % 3 == 0, F.concat(base, F.lit("?z=1&wsdl&a=2"))).when(k % 3 == 1, F.concat(base, F.lit("/wsdl"))).otherwise(F.concat(base, F.lit("?wsdl=x")))
    rows = _table(spark, sf_dir, "part").select(k.alias("seq"), url.alias("url"))
    body = F.when(k % 2 == 0, F.concat(F.lit("<definitions><portType n='"), k.cast("string"), F.lit("'/></definitions>"))).otherwise("<html/>")
    documents = _table(spark, sf_dir, "part").filter(k <= 40).select(F.concat(base, F.when(k % 3 == 0, "?a=2&z=1").otherwise("")).alias("base_url"), k.alias("seq"), body.cast("binary").alias("body"))
    return enrich.with_wsdl(rows, documents).select("seq", F.coalesce(F.col("wsdl").cast("string"), F.lit("")).alias("wsdl"))


def introspection_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' GraphQL addresses with the answer of the lowest tier that held types."""
    s = F.col("s_suppkey")
    url = F.concat(F.lit("https://g"), (s % 10).cast("string"), F.lit(".example/graphql"))
    table = _table(spark, sf_dir, "supplier")
    body = F.when((s + F.col("tier")) % 3 == 0, '{"errors":[]}').otherwise(F.concat(F.lit('{"data":{"__schema":{"types":[{"name":"T'), F.col("tier").cast("string"), F.lit('"}]}}}')))
    answers = table.filter(s % 10 < 7).groupBy((s % 10).alias("g")).agg(F.min(s).alias("s_suppkey")).select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tier")).select(url.alias("url"), "tier", F.lit(200).alias("status"), body.cast("binary").alias("body"))
    return enrich.with_introspection(table.select(s.alias("seq"), url.alias("url")), answers).select("seq", F.coalesce(F.col("introspection").cast("string"), F.lit("")).alias("answer"))


def gateway_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of one made gateway document for each supplier: named by a tag, by the title or by operation ids."""
    s = F.col("s_suppkey").cast("string")
    k = F.col("s_suppkey") % 3
    tag, title = F.when(k == 0, F.concat(F.lit('"t","shop.v1.Tag'), s, F.lit('"'))).otherwise('"t"'), F.when(k == 1, F.concat(F.lit("shop.v1.Title"), s)).otherwise("Shop")
    body = F.concat(F.lit('{"info":{"title":"'), title, F.lit('"},"paths":{"/a":{"get":{"operationId":"Stock_Get'), s, F.lit('","tags":['), tag, F.lit(']},"post":{"operationId":"stock_put","tags":[]}},"/b":{"get":{"operationId":"x.Stock_List"}}}}'))
    return enrich.gateway_services(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")), "id")


def grpc_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that generated code declares: one made script for each supplier, in three shapes."""
    s = F.col("s_suppkey").cast("string")
    k = F.col("s_suppkey") % 3
    script = (
        F.when(k == 0, F.concat(F.lit("new grpc.web.MethodDescriptor('/shop.v1.A"), s, F.lit("/Get',grpc.web.MethodType.SERVER_STREAMING,proto.shop.GetRequest,proto.shop.GetReply,x)")))
        .when(k == 1, F.concat(F.lit('export const S={typeName:"shop.v1.B'), s, F.lit('",methods:{list:{name:"List",I:ListRequest,O:ListReply,kind:MethodKind.Unary},chat:{name:"Chat",I:Msg,O:Msg,kind:MethodKind.BiDiStreaming}}}')))
        .otherwise(F.concat(F.lit('var C=function(){};C.serviceName="shop.v1.C'), s, F.lit('";C.Put={methodName:"Put",service:C,requestStream:!0,responseStream:false,requestType:pb.PutRequest,responseType:pb.PutReply}')))
    )
    return enrich.grpc_bindings(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), script.alias("script")), "id", "script")


def host_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flat(spark, sf_dir, "url").withColumn("api_type", F.when(F.col("url").startswith("https://grpc."), "grpc").otherwise("rest"))
    return enrich.host_seeds(rows, most=1_000_000)


def name_only_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("service"), "p_size", "p_partkey")
    return enrich.name_only_services(of.filter("p_size < 30"), of.filter("p_size > 10 AND right(service, 1) <> '3'"), of.filter("right(service, 1) = '1'"))


def wire_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one made gRPC body for each supplier: a varint, a text and a second frame that is cut short."""
    k = (F.col("s_suppkey") % 100).cast("int")
    message = F.concat(F.lit("08"), F.lpad(F.hex(k), 2, "0"), F.lit("1203616263"))
    body = F.unhex(F.concat(F.lit("0000000007"), message, F.lit("00000000FF08")))
    found = wire.fields(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")), "id", "body")
    return found.select("id", "frame", "nth", "field", "kind", "number", F.col("data").cast("string").alias("data"))


QUERIES = {
    f.__name__: f
    for f in (bundle_endpoints, page_scripts, page_script_urls, page_sizes, explain_report, private_addresses, header_lines, cookie_values, redacted_urls, schema_enrichment, wsdl_enrichment, introspection_enrichment, gateway_services, grpc_bindings, host_seeds, name_only_services, wire_fields)
}

_ASSETS = "[.](css|js|map|png|jpg|jpeg|gif|svg|ico|webp|avif|woff|woff2|ttf|eot|otf|webmanifest|mp4|webm|mp3|ogg)$"
_PATH = "lower(regexp_extract({}, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
ORACLES = {
    "bundle_endpoints": """WITH o AS (SELECT o_orderkey AS seq, o_custkey::STRING AS c, o_orderkey % 2 = 0 AS even, o_orderkey % 3 = 0 AS third FROM orders),
r AS (SELECT seq, even, unnest([
  {'method': 'GET', 'url': 'https://shop.example.com/api/customers/{id}/x/{param}', 'body': '', 'source': 'static:js', 'fine': true},
  {'method': 'POST', 'url': 'https://evil.example/api/x', 'body': '{"a":null}', 'source': 'static:js', 'fine': even},
  {'method': 'GET', 'url': 'https://shop.example.com/api/cfg', 'body': '{"q":null}', 'source': 'static:js', 'fine': even},
  {'method': 'PUT', 'url': 'https://shop.example.com/api/orders/' || c, 'body': '{"at":null,"items":null,"total":null}', 'source': 'static:js', 'fine': true},
  {'method': 'POST', 'url': 'https://shop.example.com/api/form', 'body': '', 'source': 'static:js', 'fine': third},
  {'method': 'GET', 'url': 'https://shop.example.com/api/parts/0/stock', 'body': '', 'source': 'static:js-concat', 'fine': NOT even}]) AS e, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS place FROM o)
SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY place) - 1)::INTEGER AS nth, e.method, e.url, e.body, e.source, CASE WHEN even THEN 'https://shop.example.com/cart' ELSE 'https://shop.example.com/static/app.js' END AS page_url FROM r WHERE e.fine""",
    "page_scripts": r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b([^>]*)>.*?</script\s*>', 1)) AS tag, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1)) AS script FROM pages)
SELECT page_id, count(*) AS scripts, sum(length(script))::BIGINT AS chars FROM s WHERE NOT regexp_matches(tag, '(?i)\bsrc\s*=') AND trim(script) <> '' GROUP BY page_id""",
    "page_script_urls": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, 0::BIGINT AS pos, root || '/a/main.JS?v=1' AS script FROM p UNION ALL SELECT page_id, 1::BIGINT, root || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || 'lib.mjs' FROM p""",
    "page_sizes": f"""WITH f AS (SELECT *, CASE WHEN page_url = '' THEN url ELSE page_url END AS page FROM ({views.FLAT}) WHERE NOT regexp_matches({_PATH.format("url")}, '{_ASSETS}'))
SELECT page, min(seq) AS first_seq, count(*) AS exchanges, count(*) FILTER (status <> 0 OR answer <> '' OR grpc_status <> '') AS answered FROM f WHERE page = url OR NOT regexp_matches({_PATH.format("page")}, '{_ASSETS}') GROUP BY page""",
    "explain_report": f"""WITH {CTE}, l AS (SELECT format('  {{:<6}} {{}} [type=rest confidence={{:.2f}} reason={{}}]', verb, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), regexp_extract(url, '^[a-z]+://[^/?#]*')), rest_c, rest_r) AS line FROM v WHERE rest_c >= 0.5)
SELECT line, count(*) AS n FROM l GROUP BY line""",
    "private_addresses": """WITH o AS (SELECT *, o_orderkey % 256 AS a, o_custkey % 256 AS b, o_orderkey % 7 AS c FROM orders),
p AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 5 <> 2 WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 17 = 0 THEN NULL
  ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) END AS private FROM o)
SELECT private, count(*) AS n FROM p GROUP BY private""",
    "header_lines": "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'X-Id' ELSE 'Via' END AS name, CASE o_orderkey % 6 WHEN 0 THEN o_custkey::STRING ELSE 'a:b, c' END AS value FROM orders WHERE o_orderkey % 6 IN (0, 5)",
    "cookie_values": "SELECT o_orderkey AS id, 1 AS others, unnest(['a', 'c', 'b']) AS name, unnest(['1=2', o_orderkey::STRING, o_orderkey::STRING]) AS value FROM orders",
    "redacted_urls": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://h.example/a?b=' || o_custkey::STRING WHEN 3 THEN 'https://h.example/' || o_custkey::STRING ELSE '[redacted]' END AS url FROM orders""",
    "schema_enrichment": f"""WITH f AS ({views.FLAT}), g AS (SELECT url, arg_min(answer, seq) AS answer FROM f WHERE upper(method) = 'GET' AND status = 200 AND lower(trim(split_part(answer_type, ';', 1))) = 'application/json' GROUP BY url)
SELECT seq, CASE WHEN g.answer IS NULL OR NOT json_valid(g.answer) THEN '' WHEN starts_with(trim(g.answer), '[{{"id"') THEN '{{"items":{{"properties":{{"id":{{"type":"number"}}}},"type":"object"}},"type":"array"}}' WHEN starts_with(g.answer, '{{"name"') THEN '{{"properties":{{"name":{{"type":"string"}}}},"type":"object"}}'
  WHEN starts_with(g.answer, '{{"data"') THEN '{{"properties":{{"data":{{"type":"null"}}}},"type":"object"}}' WHEN starts_with(g.answer, '{{"items"') THEN '{{"properties":{{"items":{{"type":"array"}}}},"type":"object"}}' END AS schema FROM f LEFT JOIN g USING (url)""",
    "wsdl_enrichment": """WITH p AS (SELECT p_partkey AS k, concat('https://shop.example.com/s', p_partkey % 20, CASE WHEN p_partkey % 3 = 0 THEN '?a=2&z=1' ELSE '' END) AS base FROM part),
d AS (SELECT base, min(k) AS k FROM p WHERE k <= 40 AND k % 2 = 0 GROUP BY base)
SELECT p.k AS seq, CASE WHEN d.k IS NULL THEN '' ELSE concat('<definitions><portType n=''', d.k, '''/></definitions>') END AS wsdl FROM p LEFT JOIN d USING (base)""",
    "introspection_enrichment": """WITH g AS (SELECT s_suppkey % 10 AS g, min(s_suppkey) AS s FROM supplier WHERE s_suppkey % 10 < 7 GROUP BY ALL)
SELECT s_suppkey AS seq, CASE WHEN s IS NULL THEN '' ELSE concat('{"data":{"__schema":{"types":[{"name":"T', CASE WHEN (s + 1) % 3 <> 0 THEN 1 ELSE 2 END, '"}]}}}') END AS answer FROM supplier LEFT JOIN g ON g = s_suppkey % 10""",
    "gateway_services": """WITH s AS (SELECT s_suppkey AS id, s_suppkey::STRING AS t, s_suppkey % 3 AS k FROM supplier),
m AS (SELECT id, CASE k WHEN 0 THEN 'shop.v1.Tag' || t WHEN 1 THEN 'shop.v1.Title' || t ELSE 'Stock' END AS service, 'Get' || t AS method FROM s UNION ALL SELECT id, CASE k WHEN 1 THEN 'shop.v1.Title' || t ELSE 'x.Stock' END, 'List' FROM s)
SELECT *, method || 'Request' AS input_type, method || 'Response' AS output_type FROM m""",
    "grpc_bindings": """WITH s AS (SELECT s_suppkey AS first_seq, s_suppkey::STRING AS t, s_suppkey % 3 AS k FROM supplier)
SELECT 'shop.v1.A' || t AS service, 'Get' AS method, 'GetRequest' AS input_type, 'GetReply' AS output_type, false AS client_streaming, true AS server_streaming, first_seq FROM s WHERE k = 0
UNION ALL SELECT 'shop.v1.B' || t, 'List', 'ListRequest', 'ListReply', false, false, first_seq FROM s WHERE k = 1 UNION ALL SELECT 'shop.v1.B' || t, 'Chat', 'Msg', 'Msg', true, true, first_seq FROM s WHERE k = 1
UNION ALL SELECT 'shop.v1.C' || t, 'Put', 'PutRequest', 'PutReply', true, false, first_seq FROM s WHERE k = 2""",
    "host_seeds": f"""WITH o AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS o FROM ({views.FLAT}))
SELECT DISTINCT CASE WHEN starts_with(url, 'https') THEN regexp_replace(o, ':443$', '') ELSE regexp_replace(o, ':80$', '') END AS origin FROM o WHERE NOT starts_with(url, 'https://grpc.')""",
    "name_only_services": "SELECT DISTINCT p_brand AS service FROM part WHERE p_size < 30 AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 10 AND right(p_brand, 1) <> '3') AND right(p_brand, 1) <> '1'",
    "wire_fields": """SELECT s_suppkey AS id, 0 AS frame, unnest([0, 1]) AS nth, unnest([1, 2]) AS field, unnest([0, 2]) AS kind, unnest([s_suppkey % 100, 3])::BIGINT AS number, unnest(['', 'abc']) AS data FROM supplier""",
}
