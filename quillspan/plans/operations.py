"""Operation, server, parameter, link, enrichment and SOAP queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import dealt
from quillspan.operators import classify, dedup, links, mining, openapi, schemas, soap
from quillspan.plans.classification import CTE
from quillspan.plans.inventory import _NAMES, _SEGMENTS
from quillspan.sources import views
from quillspan.sources.shared import ensure_shared_dir


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openapi.templated(openapi.places(views.flat(spark, sf_dir, "seq", "method", "url", "source")))


def operation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openapi.operations(_places(spark, sf_dir))


def observed_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openapi.servers(openapi.places(views.flat(spark, sf_dir, "seq", "method", "url", "source")), "https://api.example.com:443/x")


def slot_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    kept = openapi.resolve_collisions(openapi.operations(rows), openapi.servers(rows, "https://api.example.com"))
    return kept.select("template", "method", "origin", "exchanges", "source_tag", "collision_origins")


def query_param_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flat(spark, sf_dir, "method", "url")
    return openapi.query_parameters(rows.withColumn("query_params", U.query_params(F.col("url"))))


def openapi_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    endpoints = dedup.deduplicate(classify.classify(views.capture(spark, sf_dir), ["rest"])).checkpoint()
    rows = openapi.templated(openapi.places(endpoints))
    ops = openapi.resolve_collisions(openapi.operations(rows), openapi.servers(rows))
    with_ops = openapi.with_operation(endpoints)
    return openapi.render_openapi(ops, openapi.query_parameters(endpoints), schemas.request_bodies(with_ops), schemas.response_bodies(with_ops))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openapi.with_operation(views.capture(spark, sf_dir))


def body_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.request_bodies(_observed(spark, sf_dir)).select(*openapi.OPERATION, "media", F.coalesce("name", F.lit("")).alias("name"), "type")


def response_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.response_bodies(_observed(spark, sf_dir)).select(*openapi.OPERATION, "status", F.coalesce("name", F.lit("")).alias("name"), "type")


def schema_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    rows = _observed(spark, sf_dir)
    # merged bodies are small and read several times
    return schemas.components(schemas.request_bodies(rows).checkpoint(), schemas.response_bodies(rows).checkpoint())


def api_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, deduplicate, normalise, group: the operations with their best confidence and its reason."""
    rows = openapi.with_operation(dedup.deduplicate(classify.classify(views.capture(spark, sf_dir), ["rest"])))
    best = F.max(F.struct("confidence", "reason"))
    return rows.groupBy(*openapi.OPERATION).agg(F.count("*").alias("endpoints"), F.sum("repeats").alias("exchanges"), best.alias("best")).select(*openapi.OPERATION, "endpoints", "exchanges", F.round("best.confidence", 4).alias("confidence"), "best.reason")


def origin_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = views.flat(spark, sf_dir, "url", "page_url")
    return rows.groupBy(U.origin(url).alias("origin"), U.canonical_origin(url).alias("canonical")).agg(F.count("*").alias("exchanges"), F.count_if(U.same_origin(url, F.col("page_url"))).alias("same_as_page"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "link", U.same_origin(F.col("link"), F.col("base")).alias("in_scope"))


def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edges = links.page_links(pages).select(U.normalized(F.col("base")).alias("source"), U.normalized(F.col("link")).alias("target"))
    seeds = pages.groupBy(U.host(F.col("url"))).agg(F.min(U.normalized(F.col("url"))).alias("url"))
    return links.crawl_depths(edges, seeds, max_depth=2)


def allow_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.flat(spark, sf_dir, "seq", "method", "url", "status")
    answers = flat.filter(F.col("status") == 200).select("seq", "url", mining.allowed_methods(F.concat(F.col("method"), F.lit(", head,,OPTIONS"))).alias("allowed"))
    rows = mining.enrich_by_url(flat.select("seq", "url"), answers, ["allowed"])
    return rows.select("seq", F.coalesce(F.array_join("allowed", ","), F.lit("")).alias("allowed"))


def refuted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.flat(spark, sf_dir, "seq", "url", "source", "status")
    return mining.drop_refuted(flat.select("seq", "url", "source"), flat.select("url", "status")).select("seq", "source")


def api_path_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.lower("o_orderstatus"), F.col("o_custkey").cast("string")
    made = F.concat(
        F.lit("fetch('/api/v1/"), status, F.lit("/"), key, F.lit("');x(\"rest/list/\");y('/api/logo.GIF');z('/api/page.htm');g('/graphql');r('/api/x:run');t(`/v2/items/${a.b(`n${1}`)}/p`);u(`v"), (F.col("o_orderkey") % 3).cast("string"),
        F.lit("/plain`);w('https://h.example/api/"), key, F.lit("/');p='/api/users/'+id(\"a+b\")+\"/posts\";q='/api/o/'.concat(f(1,2),'/c');"), F.when(F.col("o_orderkey") % 2 == 0, "k='pay/'+'api/charge'").otherwise(""),
    )
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"))
    scripts = orders.select(F.col("o_orderkey").alias("id"), made.alias("script"))
    return mining.mine_paths(scripts, "id", "script").select("id", F.col("pos").cast("long").alias("pos"), "path")


def service_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.concat(F.lit("'"), F.col("event_type"), F.lit("/'+'api/x';n('tail"), (F.col("user_id") % 5).cast("string"), F.lit("/');m('API/')"))
    scripts = spark.read.parquet(f"{sf_dir}/events.parquet").select(script.alias("script"))
    return mining.prefix_counts(scripts, "script")


def uncovered_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("shop."), F.regexp_replace("p_brand", "#", "")).alias("service"), "p_size")
    return mining.uncovered_services(parts, parts.filter(F.substring("service", -1, 1).isin("1", "2")))


def soap_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.capture(spark, sf_dir).select("seq", soap.operation_name().alias("operation"))
    return named.filter(F.col("operation").isNotNull())


def xsd_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".25"))).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, F.lit("true")).when(k == 4, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:02:03Z"))).otherwise(F.col("o_orderpriority"))
    return rows.select(soap.xsd_type(text).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (api_inventory, operation_groups, observed_servers, slot_collision, query_param_types, openapi_document, body_schemas, response_schemas, schema_components, origin_inventory, page_links, crawl_depth, allow_enrichment, refuted_candidates, api_path_mining, service_prefixes, uncovered_services, soap_operations, xsd_types)
}

_CANON = "CASE WHEN starts_with(url, 'https') THEN regexp_replace(o, ':443$', '') ELSE regexp_replace(o, ':80$', '') END"
_WEB = f"""{_SEGMENTS}, templates AS ({{names}}),
flat AS ({views.FLAT}),
origins AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS o, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM flat),
web AS (SELECT seq, template, lower(method) AS method, {_CANON} AS origin, source, starts_with(source, 'static:js') AS static, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM origins JOIN templates USING (path)),
ops AS (SELECT template, method, origin, count(*) AS exchanges, min(seq) AS first_seq, CASE WHEN bool_or(NOT static) THEN 'dynamic' WHEN bool_or(source = 'static:js-concat') THEN 'js-bundle-concat' ELSE 'js-bundle' END AS source_tag,
  array_to_string(regexp_extract_all(template, '[{{{{]([^}}}}]*)[}}}}]', 1), ',') AS path_params FROM web GROUP BY ALL),
servers AS (SELECT origin, CASE WHEN origin = 'https://api.example.com' THEN 'primary' WHEN bool_or(NOT static) THEN 'observed' ELSE 'excluded' END AS role FROM web GROUP BY origin)""".replace("{names}", "@NAMES@")
_WEB = _WEB.replace("{{", "{").replace("}}", "}").replace("@NAMES@", "WITH " + _NAMES.format(k="kinds").strip())

#: The properties of JSON bodies b by operation and {key}, objects alone unless the first body of all is none; name and kind of each, and its place.
_PROPERTIES = """d AS (SELECT template, method, origin, {key}, {text}::JSON AS j, min(({at})) AS place FROM b GROUP BY ALL),
base AS (SELECT template, method, origin, {key}, arg_min(json_type(j), place) AS root, arg_min(j, place) AS first, min(place) AS place FROM d GROUP BY ALL),
raw AS (SELECT d.template, d.method, d.origin, d.{key}, place, unnest(json_keys(j)) AS name, j FROM (SELECT d.* FROM d) d JOIN (SELECT * EXCLUDE (place) FROM base) base USING (template, method, origin, {key}) WHERE root = 'OBJECT' AND json_type(j) = 'OBJECT'
  UNION ALL SELECT template, method, origin, {key}, place, '', first FROM base WHERE root <> 'OBJECT'),
shown AS (SELECT *, CASE WHEN name = '' AND json_type(j) <> 'OBJECT' THEN json_type(j) ELSE json_type(j -> name) END AS t, j ->> name AS v FROM raw),
p AS (SELECT template, method, origin, {key}, name, place, CASE t WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN '' WHEN 'DOUBLE' THEN CASE WHEN v::DOUBLE = trunc(v::DOUBLE) THEN 'integer' ELSE 'number' END ELSE 'integer' END AS kind FROM shown)"""

ORACLES = {
    "api_inventory": f"""WITH {CTE}, {_SEGMENTS}, templates AS (WITH {_NAMES.format(k="kinds").strip()}),
kept AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS plain, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS o FROM v WHERE rest_c >= 0.5),
keyed AS (SELECT *, concat_ws(':', method, plain, CASE WHEN soap_action <> '' THEN trim(soap_action, '"') END,
  CASE WHEN body <> '' AND sent_type <> '' THEN sent END, CASE WHEN body <> '' THEN left(sha256(body), 16) END) AS dedup_key FROM kept),
firsts AS (SELECT dedup_key, arg_min(plain, seq) AS path, lower(arg_min(method, seq)) AS method, arg_min(o, seq) AS o, arg_min(url, seq) AS url, count(*) AS repeats FROM keyed GROUP BY dedup_key),
best AS (SELECT dedup_key, rest_c, rest_r FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY rest_c DESC, rest_r DESC) AS n FROM keyed) WHERE n = 1),
rows AS (SELECT template, method, {_CANON} AS origin, repeats, rest_c, rest_r FROM firsts JOIN best USING (dedup_key) JOIN templates USING (path)),
top AS (SELECT *, row_number() OVER (PARTITION BY template, method, origin ORDER BY rest_c DESC, rest_r DESC) AS n FROM rows)
SELECT template, method, origin, count(*) AS endpoints, sum(repeats)::BIGINT AS exchanges, round(max(rest_c), 4) AS confidence, max(rest_r) FILTER (n = 1) AS reason FROM top GROUP BY ALL""",
    "operation_groups": f"WITH {_WEB} SELECT * FROM ops",
    "observed_servers": f"WITH {_WEB} SELECT * FROM servers",
    "slot_collision": f"""WITH {_WEB}, ranked AS (SELECT ops.*, row_number() OVER (PARTITION BY template, method ORDER BY CASE role WHEN 'primary' THEN 0 WHEN 'excluded' THEN 2 ELSE 1 END, origin) AS n FROM ops JOIN servers USING (origin)),
others AS (SELECT template, method, string_agg(DISTINCT origin, ',' ORDER BY origin) AS collision_origins FROM ranked WHERE n > 1 GROUP BY ALL)
SELECT template, method, origin, exchanges, source_tag, coalesce(collision_origins, '') AS collision_origins FROM ranked LEFT JOIN others USING (template, method) WHERE n = 1""",
    "query_param_types": f"""WITH {_WEB}, parts AS (SELECT seq, template, method, origin, unnest(string_split(query, '&')) AS part FROM web WHERE query <> ''),
pairs AS (SELECT seq, template, method, origin, split_part(part, '=', 1) AS name, CASE WHEN contains(part, '=') THEN substr(part, strpos(part, '=') + 1) ELSE '' END AS value FROM parts WHERE part <> ''),
total AS (SELECT template, method, origin, count(DISTINCT seq) AS rows FROM pairs GROUP BY ALL),
each AS (SELECT seq, template, method, origin, name, count(*) AS k FROM pairs GROUP BY ALL),
seen AS (SELECT template, method, origin, name, count(*) AS n, max(k) > 1 AS several FROM each GROUP BY ALL),
typed AS (SELECT template, method, origin, name, CASE WHEN bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) THEN 'integer' WHEN bool_and(regexp_matches(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$')) THEN 'number' WHEN bool_and(value IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type FROM pairs GROUP BY ALL)
SELECT template, method, origin, name, type, several, n = rows AS required FROM seen JOIN total USING (template, method, origin) JOIN typed USING (template, method, origin, name)""",
    "body_schemas": f"""WITH {_WEB}, b AS (SELECT template, web.method, origin, f.url, f.body, coalesce(nullif(lower(trim(split_part(f.sent_type, ';', 1))), ''), 'application/json') AS media
  FROM web JOIN flat f USING (seq) WHERE web.method IN ('post', 'put', 'patch') AND f.body <> '' AND json_valid(f.body)),
{_PROPERTIES.format(key="media", text="body", at="url, body")}
SELECT template, method, origin, media, name, CASE WHEN count(DISTINCT nullif(kind, '')) > 1 AND arg_min(kind, place) <> '' THEN 'string' ELSE arg_min(kind, place) END AS type FROM p GROUP BY ALL""",
    "response_schemas": f"""WITH {_WEB}, b AS (SELECT template, web.method, origin, f.url, f.body, f.answer, CASE WHEN f.status > 0 THEN f.status ELSE 200 END::STRING AS status
  FROM web JOIN flat f USING (seq) WHERE f.answer <> '' AND (f.answer_type = '' OR contains(lower(f.answer_type), 'json')) AND json_valid(f.answer)),
{_PROPERTIES.format(key="status", text="answer", at="url, body, answer")}
SELECT template, method, origin, status, name, arg_min(kind, place) AS type FROM p GROUP BY ALL""",
    "origin_inventory": f"""WITH o AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS o, lower(regexp_extract(page_url, '^[a-z]+://[^/?#]*')) AS p FROM ({views.FLAT}))
SELECT o AS origin, {_CANON} AS canonical, count(*) AS exchanges, count(*) FILTER (o = p) AS same_as_page FROM o GROUP BY ALL""",
    "allow_enrichment": f"""WITH flat AS ({views.FLAT}), known AS (SELECT url, arg_min(method, seq) AS m FROM flat WHERE status = 200 GROUP BY url)
SELECT seq, CASE WHEN m IS NULL THEN '' ELSE concat(upper(m), ',HEAD,OPTIONS') END AS allowed FROM flat LEFT JOIN known USING (url)""",
    "refuted_candidates": f"""WITH flat AS ({views.FLAT}), n AS (SELECT *, concat(CASE WHEN starts_with(url, 'https') THEN regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*')), ':443$', '') ELSE lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) END, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)) AS address FROM flat)
SELECT seq, source FROM n WHERE source <> 'static:js-concat' OR address NOT IN (SELECT address FROM n WHERE status = 404)""",
    "api_path_mining": """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS pay, o_orderkey % 3 AS v FROM orders),
f AS (SELECT o_orderkey AS id, unnest([
  '/api/v1/' || lower(o_orderstatus) || '/' || o_custkey::STRING, '/rest/list', '/api/logo.GIF', '/graphql', '/api/x:run', '/api/users', '/api/o', CASE WHEN pay THEN '/api/charge' END,
  '/v2/items/{param}/p', CASE WHEN v > 0 THEN '/plain' END, CASE WHEN v > 0 THEN '/v' || v::STRING || '/plain' END, 'https://h.example/api/' || o_custkey::STRING, '/api/o/0/c', '/api/users/0/posts', CASE WHEN pay THEN '/pay/api/charge' END]) AS path, pay,
  generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15], 1) AS nth FROM o),
g AS (SELECT id, nth, CASE WHEN pay AND NOT starts_with(path, 'http') AND NOT starts_with(path, '/pay/') THEN '/pay' || path ELSE path END AS path FROM f WHERE path IS NOT NULL AND path <> '/plain')
SELECT id, row_number() OVER (PARTITION BY id ORDER BY min(nth)) - 1 AS pos, path FROM g GROUP BY id, path""",
    "service_prefixes": """SELECT prefix, count(*) AS scripts FROM (SELECT event_type || '/' AS prefix FROM events UNION ALL SELECT 'tail' || (user_id % 5)::STRING || '/' FROM events) GROUP BY prefix""",
    "uncovered_services": """WITH p AS (SELECT concat('shop.', replace(p_brand, '#', '')) AS service, p_size FROM part) SELECT DISTINCT service FROM p WHERE right(service, 1) NOT IN ('1', '2')""",
    "soap_operations": f"SELECT * FROM (SELECT seq, CASE WHEN soap_action <> '' THEN 'stock#GetStock' WHEN contains(body, 'xmlns:soap') THEN 'GetStock' END AS operation FROM ({views.FLAT})) WHERE operation IS NOT NULL",
    "xsd_types": """WITH t AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'xsd:int' WHEN 1 THEN 'xsd:decimal' WHEN 2 THEN 'xsd:date' WHEN 3 THEN 'xsd:boolean' WHEN 4 THEN 'xsd:dateTime' ELSE 'xsd:string' END AS type FROM orders) SELECT type, count(*) AS n FROM t GROUP BY type""",
    "page_links": r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), 1) - 1 AS pos FROM pages),
r AS (SELECT page_id, url, pos, regexp_replace(trim(replace(href, '&amp;', '&')), '#.*$', '') AS ref, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM h),
j AS (SELECT page_id, url, root, pos, CASE WHEN regexp_matches(ref, '(?i)^https?://') THEN ref WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(ref, '//') THEN concat(split_part(url, ':', 1), ':', ref) WHEN ref = '' THEN regexp_replace(url, '#.*$', '')
  WHEN starts_with(ref, '/') THEN concat(root, ref) WHEN starts_with(ref, '?') THEN concat(root, path, ref) ELSE concat(root, CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END, ref) END AS joined FROM r),
l AS (SELECT *, regexp_replace(regexp_replace(joined, '([^:])/[.]/', '\1/', 'g'), '/[^/?]+/[.][.]/', '/', 'g') AS link FROM j WHERE joined IS NOT NULL)
SELECT page_id, min(pos) AS pos, link, any_value(lower(root) = lower(regexp_extract(link, '^[a-z]+://[^/?#]*'))) AS in_scope FROM l
WHERE NOT regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[.](js|mjs|cjs|css|map|png|jpg|jpeg|gif|svg|webp|ico|bmp|avif|woff|woff2|ttf|otf|eot|mp3|mp4|webm|ogg|wav|avi|mov|pdf|zip|tar|gz|rar|7z)$') GROUP BY page_id, link""",
}

_PLAIN = "regexp_replace({}, '#.*$', '')"
ORACLES["crawl_depth"] = f"""WITH RECURSIVE links AS ({ORACLES["page_links"]}),
edges AS (SELECT DISTINCT {_PLAIN.format("url")} AS source, {_PLAIN.format("link")} AS target FROM links JOIN pages USING (page_id)),
seeds AS (SELECT min({_PLAIN.format("url")}) AS url FROM pages GROUP BY lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))),
reached(url, depth) AS (SELECT url, 0 FROM seeds UNION SELECT target, depth + 1 FROM reached JOIN edges ON source = url WHERE depth < 2)
SELECT url, min(depth)::INTEGER AS depth FROM reached GROUP BY url"""

_PAIR = "name || ':' || CASE WHEN type = '' THEN 'unknown' ELSE type END"
_MATCH = "[.](action|html|aspx|json|php|asp|jsp|mvc|htm|xml|do)$"
ORACLES["schema_components"] = f"""WITH f AS (SELECT template, method, origin, 'request' AS place, media AS key, string_agg({_PAIR}, ',' ORDER BY {_PAIR}) AS fp FROM ({ORACLES["body_schemas"]}) WHERE name <> '' GROUP BY ALL
  UNION ALL SELECT template, method, origin, 'response', status, string_agg({_PAIR}, ',' ORDER BY {_PAIR}) FROM ({ORACLES["response_schemas"]}) WHERE name <> '' AND status <> '204' GROUP BY ALL),
c AS (SELECT *, list_aggregate(list_transform(string_split_regex(regexp_replace(coalesce(list_filter(string_split(template, '/'), lambda s: s <> '' AND NOT starts_with(s, '{{'))[-1], ''), '{_MATCH}', '', 'i'), '[^A-Za-z0-9]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', '') AS camel FROM f),
r AS (SELECT *, CASE WHEN camel = '' THEN 'Resource' WHEN regexp_matches(camel, '^[0-9]') THEN 'Resource' || camel WHEN ends_with(camel, 'ies') THEN left(camel, len(camel) - 3) || 'y' WHEN ends_with(camel, 'sses') THEN left(camel, len(camel) - 2)
  WHEN regexp_matches(camel, '[^s]s$') THEN left(camel, len(camel) - 1) ELSE camel END AS resource, list_position(['post', 'put', 'patch', 'get', 'delete', 'head', 'options'], method) AS rank FROM c),
n AS (SELECT *, CASE WHEN place = 'request' THEN CASE method WHEN 'post' THEN 'Create' ELSE 'Update' END || resource || 'Request' ELSE resource || CASE key WHEN '200' THEN 'Response' WHEN '201' THEN 'CreatedResponse' WHEN '404' THEN 'NotFoundResponse' ELSE key || 'Response' END END AS name,
  (template, rank, place, key, origin) AS place_in_order FROM r),
firsts AS (SELECT place, fp, arg_min(name, place_in_order) AS name, min(place_in_order) AS o FROM n GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS k FROM firsts)
SELECT template, method, origin, n.place, n.key, numbered.name || CASE WHEN k > 1 THEN k::STRING ELSE '' END AS component FROM n JOIN numbered USING (place, fp)"""
