"""Queries of GraphQL traffic, and their SQL.

Each order makes a call of one of six shapes: in the URL, as JSON, as a form; with variables, aliases, fragments, unions and lists. Which call of a shape comes
first decides what it says, so the SQL looks up the first order of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import graphql
from quillspan.sources.shared import ensure_shared_dir


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    key = F.col("o_orderkey")
    k, text = key % 6, key.cast("string")
    price = F.when(key % 4 == 0, "2").otherwise("1.5")
    mutation = '{"query":"mutation M { addOrder(input: {a: 1, b: {c: true}}, flag: true) { ok order { id price note } } }"}'
    form = f'--zz\r\nContent-Disposition: form-data; name="map"\r\n\r\n{{}}\r\n--zz\r\nContent-Disposition: form-data; name="operations"\r\n\r\n{mutation}\r\n--zz--\r\n'
    body = (
        F.when(k == 1, F.concat(F.lit('{"query":"query B($id: ID!, $f: Filter, $s: [Status!]) { order(id: $id, filter: $f, status: $s) { note price items(first: 3) { sku qty } } } query Other { no }","operationName":"Other","variables":{"id":"'), text, F.lit('","f":{"min":1.5,"tags":["x"],"range":{"to":'), text, F.lit('}},"s":["OPEN","'), F.col("o_orderstatus"), F.lit('"]}}')))
        .when((k == 2) & (key % 12 == 2), form)
        .when(k == 2, mutation)
        .when(k == 3, '{"query":"{ search(q: \\"x\\") { __typename ... on Hit { id rank } ... on Miss { id why: reason } } } # by type"}')
        .when(k == 4, '{"query":"{ search(q: 5) { ... on Miss { why: reason id } ... on Hit { rank id } } }"}')
        .when(k == 5, '{"query":"query V($t: Zone) { viewer { ...P } count } fragment P on User { name when: createdAt(tz: $t) }"}')
    )
    answer = (
        F.when(k == 0, F.concat(F.lit('{"data":{"order":{"id":"a'), text, F.lit('","price":'), price, F.lit(',"note":null}}}')))
        .when(k == 1, '{"data":{"order":{"note":"n","price":null,"items":[{"sku":null},{"sku":"s","qty":2}]}}}')
        .when(k == 2, '{"data":{"addOrder":{"ok":true,"order":{"id":1,"price":3,"note":"x"}}}}')
        .when(k == 5, '{"data":{"viewer":{"name":"n","when":"2024"},"count":7.0}}')
        .otherwise('{"data":{"search":[{"id":5,"rank":1.5},{"id":6,"why":"no"}]}}')
    )
    url = F.when(k == 0, "https://g.example/graphql?query=%7B+order(id%3A+1)+%7B+id+price+note+%7D+%7D").otherwise("https://g.example/graphql")
    kind = F.when((k == 2) & (key % 12 == 2), "multipart/form-data; boundary=zz").otherwise("application/json")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(key.alias("seq"), url.alias("url"), F.create_map(F.lit("content-type"), kind).alias("headers"), body.cast("binary").alias("body"), F.struct(answer.cast("binary").alias("body")).alias("response"))


def _schema(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return graphql.schema(graphql.observe(_calls(spark, sf_dir)))


def graphql_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root fields and fields of types, with their arguments."""
    parts = _schema(spark, sf_dir)
    return parts["roots"].select("owner", "field", "of", "args").union(parts["fields"].select("owner", "field", "of", "args"))


def graphql_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema(spark, sf_dir)["inputs"].filter("field <> ''")


def graphql_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums with their values, scalars, and unions with their members."""
    parts = _schema(spark, sf_dir)
    return parts["others"].select(F.lit("other").alias("kind"), "owner", "values").union(parts["unions"].select(F.lit("union"), "owner", "members"))


def graphql_sdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphql.document(_schema(spark, sf_dir))


QUERIES = {f.__name__: f for f in (graphql_fields, graphql_inputs, graphql_others, graphql_sdl)}

#: The first order of each shape (4 says the same as 3), and what follows from that.
_FIRST = """
m AS (SELECT min(o_orderkey) FILTER (o_orderkey % 6 = 0) AS a, min(o_orderkey) FILTER (o_orderkey % 6 = 1) AS b, min(o_orderkey) FILTER (o_orderkey % 6 = 3) AS d, min(o_orderkey) FILTER (o_orderkey % 6 = 4) AS e,
  arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 6 = 1) AS status FROM orders),
roots AS (SELECT unnest([
  {'owner': 'Query', 'field': 'order', 'of': 'OrderResponse', 'args': concat('filter: Filter, id: ', CASE WHEN a < b THEN 'Int' ELSE 'ID!' END, ', status: [Status!]')},
  {'owner': 'Query', 'field': 'search', 'of': '[SearchResult]', 'args': CASE WHEN d < e THEN 'q: String' ELSE 'q: Int' END},
  {'owner': 'Query', 'field': 'viewer', 'of': 'ViewerResult', 'args': ''}, {'owner': 'Query', 'field': 'count', 'of': 'Int', 'args': ''},
  {'owner': 'Mutation', 'field': 'addOrder', 'of': 'AddOrderResponse', 'args': 'flag: Boolean, input: AddOrder_InputInput'}]) AS x FROM m),
fields AS (SELECT unnest([
  {'owner': 'OrderResponse', 'field': 'id', 'of': 'Int', 'args': ''}, {'owner': 'OrderResponse', 'field': 'note', 'of': 'String', 'args': ''},
  {'owner': 'OrderResponse', 'field': 'price', 'of': CASE WHEN a % 4 = 0 THEN 'Int' ELSE 'Float' END, 'args': ''}, {'owner': 'OrderResponse', 'field': 'items', 'of': '[Order_ItemsResponse]', 'args': 'first: Int'},
  {'owner': 'Order_ItemsResponse', 'field': 'sku', 'of': 'String', 'args': ''}, {'owner': 'Order_ItemsResponse', 'field': 'qty', 'of': 'Int', 'args': ''},
  {'owner': 'AddOrderResponse', 'field': 'ok', 'of': 'Boolean', 'args': ''}, {'owner': 'AddOrderResponse', 'field': 'order', 'of': 'AddOrder_OrderResponse', 'args': ''},
  {'owner': 'AddOrder_OrderResponse', 'field': 'id', 'of': 'Int', 'args': ''}, {'owner': 'AddOrder_OrderResponse', 'field': 'note', 'of': 'String', 'args': ''}, {'owner': 'AddOrder_OrderResponse', 'field': 'price', 'of': 'Int', 'args': ''},
  {'owner': 'Hit', 'field': 'id', 'of': 'Int', 'args': ''}, {'owner': 'Hit', 'field': 'rank', 'of': 'Float', 'args': ''}, {'owner': 'Miss', 'field': 'id', 'of': 'Int', 'args': ''}, {'owner': 'Miss', 'field': 'reason', 'of': 'String', 'args': ''},
  {'owner': 'User', 'field': 'name', 'of': 'String', 'args': ''}, {'owner': 'User', 'field': 'createdAt', 'of': 'String', 'args': 'tz: Zone'}]) AS x FROM m),
inputs AS (SELECT unnest([{'owner': 'Filter', 'field': 'min', 'of': 'Float'}, {'owner': 'Filter', 'field': 'tags', 'of': '[String]'}, {'owner': 'Filter', 'field': 'range', 'of': 'Filter_Range'}, {'owner': 'Filter_Range', 'field': 'to', 'of': 'Int'},
  {'owner': 'AddOrder_InputInput', 'field': 'a', 'of': 'Int'}, {'owner': 'AddOrder_InputInput', 'field': 'b', 'of': 'AddOrder_InputInput_B'}, {'owner': 'AddOrder_InputInput_B', 'field': 'c', 'of': 'Boolean'}]) AS x FROM m),
others AS (SELECT 'other' AS kind, 'Status' AS owner, list_sort(list_distinct(['OPEN', status])) AS values FROM m UNION ALL SELECT 'other', 'Zone', NULL FROM m
  UNION ALL SELECT 'union', 'SearchResult', CASE WHEN d < e THEN ['Hit', 'Miss'] ELSE ['Miss', 'Hit'] END FROM m UNION ALL SELECT 'union', 'ViewerResult', ['User'] FROM m)"""
_LINE = "concat('  ', x.field, CASE WHEN x.args = '' THEN '' ELSE concat('(', x.args, ')') END, ': ', x.of, chr(10))"
_BLOCK = "concat({word}, x.owner, ' {{', chr(10), string_agg({line}, '' ORDER BY x.field), '}}', chr(10))"
ORACLES = {
    "graphql_fields": f"WITH {_FIRST.strip()} SELECT x.* FROM roots UNION ALL SELECT x.* FROM fields",
    "graphql_inputs": f"WITH {_FIRST.strip()} SELECT x.* FROM inputs",
    "graphql_others": f"WITH {_FIRST.strip()} SELECT * FROM others",
    "graphql_sdl": f"""WITH {_FIRST.strip()},
blocks AS (
  SELECT CASE x.owner WHEN 'Query' THEN 0 ELSE 1 END AS place, x.owner AS name, {_BLOCK.format(word="'type '", line=_LINE)} AS sdl FROM roots GROUP BY x.owner
  UNION ALL SELECT 3, x.owner, {_BLOCK.format(word="'type '", line=_LINE)} FROM fields GROUP BY x.owner
  UNION ALL SELECT 4, x.owner, {_BLOCK.format(word="'input '", line="concat('  ', x.field, ': ', x.of, chr(10))")} FROM inputs GROUP BY x.owner
  UNION ALL SELECT 5, owner, concat('union ', owner, ' = ', array_to_string(values, ' | '), chr(10)) FROM others WHERE kind = 'union'
  UNION ALL SELECT 6, owner, CASE WHEN values IS NULL THEN concat('scalar ', owner, chr(10)) ELSE concat('enum ', owner, ' {{', chr(10), array_to_string(list_transform(values, lambda v: concat('  ', v, chr(10))), ''), '}}', chr(10)) END FROM others WHERE kind = 'other')
SELECT concat('# Inferred from observed traffic', chr(10), string_agg(chr(10) || sdl, '' ORDER BY place, name)) AS sdl FROM blocks
""".replace("{{", "{").replace("}}", "}"),
}
