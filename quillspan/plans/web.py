"""Queries of references, event correlation, service prefixes and endpoint budgets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import dealt, settle
from quillspan.operators import bundles, classify, dedup, document, links, mining
from quillspan.sources.shared import ensure_shared_dir
from quillspan.streaming import correlate

#: References and what they come to relative to /b/c/d;p?q: the examples of RFC 3986 (5.4), fragments left out, those that have no scheme or http's.
_REFERENCES = (
    ("g", "/b/c/g"), ("./g", "/b/c/g"), ("g/", "/b/c/g/"), ("/g", "/g"), ("?y", "/b/c/d;p?y"), ("g?y", "/b/c/g?y"), ("g#s", "/b/c/g"), ("g?y#s", "/b/c/g?y"), (";x", "/b/c/;x"), ("g;x", "/b/c/g;x"), ("g;x?y#s", "/b/c/g;x?y"), ("", "/b/c/d;p?q"),
    (".", "/b/c/"), ("./", "/b/c/"), ("..", "/b/"), ("../", "/b/"), ("../g", "/b/g"), ("../..", "/"), ("../../", "/"), ("../../g", "/g"), ("../../../g", "/g"), ("../../../../g", "/g"), ("/./g", "/g"), ("/../g", "/g"),
    ("g.", "/b/c/g."), (".g", "/b/c/.g"), ("g..", "/b/c/g.."), ("..g", "/b/c/..g"), ("./../g", "/b/g"), ("./g/.", "/b/c/g/"), ("g/./h", "/b/c/g/h"), ("g/../h", "/b/c/h"), ("g;x=1/./y", "/b/c/g;x=1/y"), ("g;x=1/../y", "/b/c/y"), ("g?y/./x", "/b/c/g?y/./x"), ("g?y/../x", "/b/c/g?y/../x"),
)


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's page resolves one reference."""
    refs = F.array(*[F.lit(r) for r, _ in _REFERENCES])
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key, F.concat(F.lit("https://H"), key.cast("string"), F.lit(".example:8443/b/c/d;p?q")).alias("base"), F.element_at(refs, (key % len(_REFERENCES) + 1).cast("int")).alias("ref"))
    rows = rows.select(F.inline(F.array(F.struct("c_custkey", "base", "ref"))))
    return rows.select("c_custkey", "ref", links.resolve(F.col("base"), F.col("ref")).alias("link"))


def event_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as network events of 20 pages with ids that come again: requests, responses, ends of loading, now and then a page's end."""
    e = F.col("event_id")
    kind = F.when(e % 97 == 0, "end").when(e % 5 < 2, "request").when(e % 5 == 2, "response").otherwise("finished")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("page"), e.alias("seq"), kind.alias("kind"), F.concat(F.lit("r"), (e % 7).cast("string")).alias("request_id"), F.current_timestamp().alias("at"),
        F.when(e % 2 == 0, "POST").alias("method"), F.col("event_type").alias("url"), F.lit(200).alias("status"), F.lit("json").alias("content_type"), e.cast("string").alias("body"),
    )
    return correlate.correlate_table(rows)


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script requests of suppliers, and what a crawler took from them as addresses: a segment below the script's folder, some too long, dotted, deep or of scripts nobody recorded."""
    s = F.col("s_suppkey")
    key = s.cast("string")
    host = F.concat(F.lit("https://s"), (s % 7).cast("string"), F.lit(".example"))
    script = F.concat(host, F.lit("/static/js/app"), (s % 3).cast("string"), F.lit(".js"))
    name = F.when(s % 6 == 0, F.concat(F.lit("svc-"), (s % 9).cast("string"), F.lit("/"))).when(s % 6 == 1, F.concat(F.lit("Upper"), key)).when(s % 6 == 2, F.concat(F.lit("a/b"), key)).when(s % 6 == 3, F.concat(F.lit("x.y"), key)).when(s % 6 == 4, F.lit("q")).otherwise(F.concat(F.lit("w_"), (s % 4).cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    own = rows.filter(s % 7 != 5).select((s * 2).alias("seq"), script.alias("url"), F.lit("browser").alias("source"))
    return own.union(rows.select((s * 2 + 1).alias("seq"), F.concat(host, F.when(s % 10 == 9, "/other/").otherwise("/static/js/"), name).alias("url"), script.alias("source")))


def recorded_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.recorded_prefixes(_scripts(spark, sf_dir))


def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of scripts under the prefixes that recorded requests show."""
    s = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    script = F.concat(F.lit("https://s"), (s % 7).cast("string"), F.lit(".example/static/js/app"), (s % 3).cast("string"), F.lit(".js"))
    text = F.concat(F.lit('get("api/v'), (s % 5).cast("string"), F.lit('/items"); get("svc-6/api/x"); get("/api/lead");'))
    return mining.mine_paths(rows.select(s, script.alias("url"), text.alias("text")), "s_suppkey", "text", mining.recorded_prefixes(_scripts(spark, sf_dir)), "url").select("s_suppkey", "path")


def bundle_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls and joined paths of bundles of many calls are kept: a bundle for each supplier, with 400 to 600 calls and up to 40 joined paths."""
    s = F.col("s_suppkey")
    n, m = (400 + s % 5 * 50).cast("int"), (s % 5 * 10).cast("int")
    call = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('fetch("/f/'), i.cast("string"), F.lit('");'))), "")
    joined = F.array_join(F.transform(F.sequence(F.lit(0), m), lambda i: F.concat(F.lit('x("/api/c'), i.cast("string"), F.lit('/"+id);'))), "")
    body = F.concat(call, joined, F.lit('axios.delete("/d",{data:{"why":1,who:2},headers:{a:1}})')).cast("binary")
    rows = settle(dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")), response=F.struct(F.lit("text/javascript").alias("content_type"), body.alias("body")))
    rows = rows.select(s.alias("seq"), F.lit("https://a.example/app.js").alias("url"), F.lit("").alias("page_url"), "response")
    found = bundles.analyze(rows)
    return found.groupBy("seq").agg(F.count_if(F.col("source") == bundles.SCRIPT).alias("calls"), F.count_if(F.col("source") == bundles.CONCAT).alias("joined"), F.max(F.when(F.col("method") == "DELETE", F.col("body"))).alias("deleted"))


#: Scripts whose addresses go through names, with @ for the key; and what they call: method, path, fields of the body.
_SCRIPTED = (
    ('var u="/api/y@";fetch(u)', [("GET", "/api/y@", None)]),
    ('const b="/api@";function f(b){fetch(b+"/x")}fetch(b+"/z")', [("GET", "/{b}/x", None), ("GET", "/api@/z", None)]),
    ('let w="/a@";w="/b";fetch(w);fetch("/c")', [("GET", "/c", None)]),
    ('const A="/v@",B=`${A}/o`;const o={method:"PUT",body:JSON.stringify({n:1,m:x})};fetch(`${B}/${i.id}?q=${q()}`,o)', [("PUT", "/v@/o/{id}?q={param}", '{"m":null,"n":null}')]),
    ('var r=new XMLHttpRequest();r.open("post",p,true);var p="/late@"', [("POST", "/late@", None)]),
    ('$.ajax({url:root+"/q",type:"DELETE",data:{why:1}});var root="/j@"', [("DELETE", "/j@/q", '{"why":null}')]),
    ('for(const u of us){fetch(u)}{let u="/in@";fetch(u)}location.href="/go@/"+n', [("GET", "/in@", None), ("GET", "/go@/{n}", None)]),
    ('axios.post(e,{a:1});const e="/x@";// fetch("/no")\nvar t=/fetch("no")/;[1].map(e=>fetch(e+"/d"))', [("POST", "/x@", '{"a":null}'), ("GET", "/{e}/d", None)]),
)


def script_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a script for each customer, through constants, shadowed names, options and loops."""
    key = F.col("c_custkey")
    text = F.element_at(F.array(*[F.lit(script) for script, _ in _SCRIPTED]), (key % len(_SCRIPTED) + 1).cast("int"))
    body = F.replace(text, F.lit("@"), key.cast("string")).cast("binary")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("seq"), F.lit("https://a.example/app.js").alias("url"), F.lit("").alias("page_url"), F.struct(F.lit("text/javascript").alias("content_type"), body.alias("body")).alias("response"))
    return bundles.analyze(rows).select("seq", "method", "url", "body")


def openapi_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of made endpoints: items of suppliers on two hosts, of which one is the target, and calls that make and remove them."""
    ensure_shared_dir(spark)
    s = F.col("s_suppkey")
    key = s.cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    host = F.concat(F.lit("https://h"), (s % 2).cast("string"), F.lit(".example"))
    none = F.lit(None).cast("binary")

    def exchange(n: int, method: str, url, body, status: int, answer):
        said = F.struct(F.lit(status).alias("status_code"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("application/json").alias("content_type"), answer.cast("binary").alias("body"))
        return F.struct((s * 4 + n).alias("seq"), F.lit(method).alias("method"), url.alias("url"), F.create_map().cast("map<string,string>").alias("headers"), body.cast("binary").alias("body"), said.alias("response"))

    items = F.concat(host, F.lit("/api/items/"), key)
    calls = F.array(
        exchange(0, "GET", items, none, 200, F.concat(F.lit('{"id":'), key, F.lit(',"name":"n","on":'), F.when(s % 2 == 0, "true").otherwise("false"), F.lit("}"))),
        exchange(1, "POST", F.lit("https://h0.example/api/items"), F.lit('{"name":"x","tags":["a"]}'), 201, F.concat(F.lit('{"id":'), key, F.lit("}"))),
        exchange(2, "DELETE", items, none, 204, none),
        exchange(3, "GET", F.concat(F.lit("https://h0.example/api/items?page="), (s % 5).cast("string")), none, 200, F.concat(F.lit('[{"id":'), key, F.lit("}]"))),
    )
    made = rows.select(F.explode(calls).alias("c")).select("c.*").select(
        "*", U.query_params(F.col("url")).alias("query_params"), F.lit("browser").alias("source"), F.lit("").alias("tag"), F.lit("").alias("attribute"), F.lit("").alias("page_url")
    )
    endpoints = dedup.deduplicate(classify.classify(made, ["rest"], 0.0)).checkpoint()
    return document.yaml_document(endpoints, "https://h0.example")


QUERIES = {f.__name__: f for f in (openapi_yaml, resolved_references, event_correlation, recorded_prefixes, prefixed_paths, bundle_budget, script_variables)}

_SCRIPTS = """
SELECT s_suppkey AS s, concat('https://s', s_suppkey % 7, '.example') AS host, concat('https://s', s_suppkey % 7, '.example/static/js/app', s_suppkey % 3, '.js') AS script,
  CASE WHEN s_suppkey % 6 = 0 THEN concat('svc-', s_suppkey % 9) WHEN s_suppkey % 6 = 5 THEN concat('w_', s_suppkey % 4) END AS name FROM supplier
"""
_YAML = """components:
    schemas:
        CreateItemRequest:
            properties:
                name:
                    type: string
                tags:
                    items:
                        type: string
                    type: array
            type: object
        ItemCreatedResponse:
            properties:
                id:
                    type: integer
            type: object
        ItemResponse:
            properties:
                id:
                    type: integer
                name:
                    type: string
                "on":
                    type: boolean
            type: object
info:
    title: h0.example API
    version: 1.0.0
openapi: 3.0.3
paths:
    /api/items:
        get:
            parameters:
                - explode: true
                  in: query
                  name: page
                  required: true
                  schema:
                    items:
                        type: integer
                    type: array
                  style: form
            responses:
                "200":
                    content:
                        application/json:
                            schema:
                                items:
                                    properties:
                                        id:
                                            type: integer
                                    type: object
                                type: array
                    description: OK
            summary: Get /api/items
        post:
            requestBody:
                content:
                    application/json:
                        schema:
                            $ref: ''#/components/schemas/CreateItemRequest''
            responses:
                "201":
                    content:
                        application/json:
                            schema:
                                $ref: ''#/components/schemas/ItemCreatedResponse''
                    description: Created
            summary: Post /api/items
    /api/items/{itemId}:
        delete:
            parameters:
                - in: path
                  name: itemId
                  required: true
                  schema:
                    type: string
            responses:
                "204":
                    description: No Content
            summary: Delete /api/items/{itemId}
            x-collision-origins: @
        get:
            parameters:
                - in: path
                  name: itemId
                  required: true
                  schema:
                    type: string
            responses:
                "200":
                    content:
                        application/json:
                            schema:
                                $ref: ''#/components/schemas/ItemResponse''
                    description: OK
            summary: Get /api/items/{itemId}
            x-collision-origins: @
servers:
"""
_PREFIXES = f"SELECT host AS origin, concat(name, '/') AS prefix, min(2 * s + 1) AS first_seq FROM ({_SCRIPTS}) WHERE name IS NOT NULL AND s % 10 <> 9 AND s % 7 <> 5 GROUP BY ALL"
ORACLES = {
    "resolved_references": "SELECT c_custkey, r[1] AS ref, concat('https://H', c_custkey, '.example:8443', r[2]) AS link FROM (SELECT c_custkey, ["
    + ", ".join(f"['{r}', '{t}']" for r, t in _REFERENCES)
    + f"][c_custkey % {len(_REFERENCES)} + 1] AS r FROM customer)",
    "event_correlation": """
WITH e AS (SELECT concat('p', user_id % 20) AS page, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'end' WHEN event_id % 5 < 2 THEN 'request' WHEN event_id % 5 = 2 THEN 'response' ELSE 'finished' END AS kind, concat('r', event_id % 7) AS request_id, CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, event_type AS url FROM events),
v AS (SELECT *, count(*) FILTER (kind = 'end') OVER (PARTITION BY page ORDER BY seq) AS visit FROM e),
q AS (SELECT *, lead(seq) OVER (PARTITION BY page, visit, request_id ORDER BY seq) AS next FROM v WHERE kind = 'request'),
o AS (SELECT * FROM q WHERE next IS NULL)
SELECT o.page, o.request_id, o.seq, o.method, o.url, CASE WHEN bool_or(coalesce(x.kind, '') = 'response') THEN 200 ELSE 0 END::INTEGER AS status, CASE WHEN bool_or(coalesce(x.kind, '') = 'response') THEN 'json' ELSE '' END AS content_type,
  min(x.seq) FILTER (x.kind = 'finished')::VARCHAR AS body, bool_or(coalesce(x.kind, '') = 'finished') AS complete
FROM o LEFT JOIN v x ON x.page = o.page AND x.visit = o.visit AND x.request_id = o.request_id AND x.seq > o.seq GROUP BY ALL
""",
    "recorded_prefixes": _PREFIXES,
    "prefixed_paths": f"""
WITH p AS ({_PREFIXES}), t AS (SELECT s, host, concat('api/v', s % 5, '/items') AS bare FROM ({_SCRIPTS}))
SELECT s AS s_suppkey, concat('/', prefix, bare) AS path FROM t JOIN p ON p.origin = t.host
UNION SELECT s, concat('/', bare) FROM t WHERE host NOT IN (SELECT origin FROM p)
UNION SELECT s, '/svc-6/api/x' FROM t
UNION SELECT s, concat('/', prefix, 'api/lead') FROM t JOIN p ON p.origin = t.host
UNION SELECT s, '/api/lead' FROM t WHERE host NOT IN (SELECT origin FROM p)
""",
    "bundle_budget": """
WITH b AS (SELECT s_suppkey AS seq, 400 + s_suppkey % 5 * 50 + 1 AS n, s_suppkey % 5 * 10 + 1 AS m FROM supplier), c AS (SELECT *, least(n, 500 - least(m, 16)) AS calls FROM b)
SELECT seq, calls::BIGINT AS calls, least(m, 500 - calls)::BIGINT AS joined, '{"who":null,"why":null}' AS deleted FROM c
""",
    "script_variables": "SELECT c_custkey AS seq, r.method, concat('https://a.example', replace(r.path, '@', c_custkey::VARCHAR)) AS url, r.body FROM (SELECT c_custkey, unnest(["
    + ", ".join("[" + ", ".join(f"{{'method': '{m}', 'path': '{p}', 'body': " + (f"'{b}'" if b else "NULL") + "}" for m, p, b in calls) + "]" for _, calls in _SCRIPTED)
    + f"][c_custkey % {len(_SCRIPTED)} + 1]) AS r FROM customer)",
    "openapi_yaml": f"""
WITH h AS (SELECT DISTINCT concat('https://h', s_suppkey % 2, '.example') AS host FROM supplier)
SELECT concat(replace('{_YAML}', '@', (SELECT string_agg(host, ',' ORDER BY host) FROM h WHERE host <> 'https://h0.example')), (SELECT string_agg(concat('    - url: ', host, chr(10)), '' ORDER BY host) FROM h)) AS yaml
""",
}
