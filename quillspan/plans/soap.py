"""Queries of SOAP traffic and WSDL documents, and their SQL.

The calls are made from parts by one SQL text, which Spark and DuckDB both read: two operations at two addresses, with empty, repeated, nested and
declared values, other prefixes and namespaces, comments, and bodies that are cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import wsdl
from quillspan.sources import views

#: What each call says about a path; ``rest`` is empty where the body is cut.
CALLS = """
SELECT p_partkey AS seq,
  concat('https://Shop.example.com/ws/', CASE WHEN p_partkey % 3 = 0 THEN 'prices.asmx?x=1' ELSE 'stock/' END) AS url,
  CASE WHEN p_partkey % 3 = 0 THEN 'prices.asmx' ELSE 'stock' END AS site,
  CASE WHEN p_partkey % 6 = 1 THEN 'urn:shop/Restock' WHEN p_partkey % 6 = 2 THEN '"http://shop/act#Stock"' ELSE '' END AS action,
  CASE WHEN p_partkey % 6 = 1 THEN 'shop/Restock' WHEN p_partkey % 2 = 0 AND p_partkey % 6 <> 2 THEN 'Price' ELSE 'Stock' END AS operation,
  CASE WHEN p_partkey % 15 = 0 THEN 'urn:old' ELSE 'urn:shop' END AS space,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '012' WHEN 3 THEN '<en>true</en><de/>' ELSE '<fr>x</fr><en>1.5</en>' END AS tag,
  CASE p_size % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '2024-02-29T10:00:00Z' ELSE '2024-02-29T99:00:00' END AS day,
  p_partkey % 7 = 0 AS cut, p_partkey % 4 = 1 AS bare
FROM part
"""
_BODY = """
SELECT *, concat('<?xml version="1.0"?><e:Envelope xmlns:e="http://www.w3.org/2003/05/soap-envelope" xmlns:i="http://www.w3.org/2001/XMLSchema-instance"><e:Header><no>1</no></e:Header><e:Body><!-- <x/> -->',
  CASE WHEN bare THEN concat('<Call xmlns="', space, '">') ELSE concat('<m:', operation_element, ' xmlns:m="', space, '">') END,
  '<item>', '<tag>', tag, '</tag>', '</item><item><late>1</late></item><day>', day, '</day>', CASE WHEN cut THEN '<code>7' ELSE '<code i:type="xs:long">7</code><kind i:type="m:Kind">1</kind>' END,
  CASE WHEN cut THEN '' WHEN bare THEN '</Call></e:Body></e:Envelope>' ELSE concat('</m:', operation_element, '></e:Body></e:Envelope>') END) AS body
FROM (SELECT *, CASE WHEN operation = 'shop/Restock' THEN 'Restock' ELSE operation END AS operation_element FROM ({calls}))
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("recorded_part")
    made = spark.sql(_BODY.replace("{calls}", CALLS.replace("FROM part", "FROM recorded_part")))
    made = made.select(F.inline(F.array(F.struct("seq", "url", "site", "action", "body"))))
    headers = F.when(F.col("action") == "", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("soapaction"), F.col("action")))
    return made.select("seq", "url", "site", headers.alias("headers"), F.col("body").cast("binary").alias("body"), F.struct(F.lit(None).cast("binary").alias("body")).alias("response"))


def soap_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in the view of all recorded traffic."""
    found = wsdl.parameters(wsdl.soap_calls(views.capture(spark, sf_dir)))
    return found.select("operation", F.array_join("path", "/").alias("name"), F.col("kind").alias("type"), F.element_at("place", -1)["seq"].alias("first_seq"))


def soap_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested parameters of the made calls, each with its place among all of its operation."""
    found = wsdl.parameters(wsdl.soap_calls(_calls(spark, sf_dir)))
    return found.select("operation", F.array_join("path", "/").alias("name"), "kind", F.transform("place", lambda p: F.concat_ws(".", p["seq"].cast("string"), p["place"].cast("string"))).alias("place"))


def soap_observed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = wsdl.soap_calls_with(_calls(spark, sf_dir), ["site"])
    return wsdl.operations(calls, "site").select("site", "operation", "first_seq", "action", "space")


def soap_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsdl.infer_wsdl(_calls(spark, sf_dir), "site").select("site", "service", "namespace")


def wsdl_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that the SOAP calls among all recorded traffic imply."""
    rows = views.capture(spark, sf_dir).filter(F.endswith("url", F.lit("/soap/stock")))
    return wsdl.infer_wsdl(rows)


def wsdl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each address of the made calls, nested types included."""
    return wsdl.infer_wsdl(_calls(spark, sf_dir), "site").select("site", "wsdl")


#: A made document for each part: parts of it in another order, prefixes that change, two services, references that lead nowhere, faults and encodings.
DOCUMENTS = """
SELECT p_partkey, concat(CASE WHEN p_partkey % 10 = 3 THEN '<?xml version="1.0" encoding="utf-16le"?>' WHEN p_partkey % 10 = 4 THEN '<?xml version="1.0" encoding="ISO-8859-1"?>' ELSE '' END,
  CASE WHEN p_partkey % 10 = 5 THEN '<html/>' ELSE concat('<w:definitions xmlns:w="http://schemas.xmlsoap.org/wsdl/" xmlns:s="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:t="urn:', p_brand, '" targetNamespace="urn:', p_brand, '"><!-- <w:portType name="P"/> -->',
    CASE WHEN p_partkey % 2 = 0 THEN concat({service}, {binding}, {port}, {message}) ELSE concat({message}, {port}, {binding}, {service}) END,
    CASE WHEN p_partkey % 10 = 6 THEN '<cut' ELSE '</w:definitions>' END) END) AS body
FROM part
""".format(
    service="""'<w:service name="One"><w:port name="A" binding="t:B1"><s:address location="https://a/', CAST(p_partkey AS STRING), '"/></w:port></w:service><w:service name="Two"><w:port name="A" binding="', CASE WHEN p_partkey % 3 = 0 THEN 't:Gone' WHEN p_partkey % 3 = 1 THEN 'u:B2" xmlns:u="urn:' ELSE 't:B1' END, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END, '"/></w:service>'""",
    binding="""'<w:binding name="B1" type="t:P"><s:binding style="document"/><w:operation name="Get"><s:operation soapAction="urn:get"/></w:operation><w:operation name="Bound"/></w:binding><w:binding name="B2" type="t:Q"/>'""",
    port="""'<w:portType name="P"><w:operation name="Get', CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) ELSE '' END, '"><w:input message="t:In"/><w:output message="t:Lost"/></w:operation></w:portType><w:portType name="Q"><w:operation name="List"><w:input message="t:In"/></w:operation></w:portType>'""",
    message="""'<w:message name="In"><w:part name="p" element="t:Get"/><w:part name="q" type="t:More"/></w:message>'""",
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("recorded_part")
    return spark.sql(DOCUMENTS.replace("FROM part", "FROM recorded_part")).select("p_partkey", F.encode("body", "UTF-8").alias("body"))


def wsdl_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the port types of each made document; those of bindings and in comments do not count."""
    parts = wsdl.wsdl_parts(_documents(spark, sf_dir), "p_partkey")
    return parts.filter("kind = 'operation'").select("p_partkey", F.col("name").alias("operation"))


def wsdl_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsdl.wsdl_endpoints(wsdl.wsdl_parts(_documents(spark, sf_dir), "p_partkey"), "p_partkey")


def wsdl_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each address of the made calls: the first recorded document that parses, verbatim, else the inferred one (its length)."""
    answers = _documents(spark, sf_dir).filter("p_partkey % 3 = 0 AND p_partkey > 2").select(F.col("p_partkey").alias("seq"), "body")
    rows = _calls(spark, sf_dir).drop("response").join(answers.withColumnRenamed("body", "answer"), "seq", "left").withColumn("response", F.struct(F.col("answer").alias("body"))).drop("answer")
    made = wsdl.generate_wsdl(rows, "site")
    return made.select("site", "inferred", F.when(~F.col("inferred"), F.col("wsdl")).alias("wsdl"))


QUERIES = {f.__name__: f for f in (soap_parameters, soap_types, soap_observed_operations, soap_services, wsdl_document, wsdl_text, wsdl_operations, wsdl_endpoints, wsdl_generated)}

#: (seq, operation, path, rank among siblings, kind) of every parameter of every call, the first of its name in the call.
_NODES = f"""
SELECT seq, site AS spot, operation, unnest([
  {{'path': ['item'], 'nth': 0, 'kind': 'nested'}},
  {{'path': ['item', 'tag'], 'nth': 0, 'kind': CASE tag WHEN '' THEN NULL WHEN ' 12 ' THEN 'xsd:int' WHEN '012' THEN 'xsd:string' ELSE 'nested' END}},
  CASE WHEN tag LIKE '<%' THEN {{'path': ['item', 'tag', 'en'], 'nth': CASE WHEN tag LIKE '<en>%' THEN 0 ELSE 1 END, 'kind': CASE WHEN tag LIKE '<en>%' THEN 'xsd:boolean' ELSE 'xsd:decimal' END}} END,
  CASE WHEN tag LIKE '<en>%' THEN {{'path': ['item', 'tag', 'de'], 'nth': 1, 'kind': NULL}} END,
  CASE WHEN tag LIKE '<fr>%' THEN {{'path': ['item', 'tag', 'fr'], 'nth': 0, 'kind': 'xsd:string'}} END,
  {{'path': ['day'], 'nth': 1, 'kind': CASE day WHEN '2024-02-29' THEN 'xsd:date' WHEN '2024-02-29T10:00:00Z' THEN 'xsd:dateTime' ELSE 'xsd:string' END}},
  {{'path': ['code'], 'nth': 2, 'kind': CASE WHEN cut THEN 'xsd:int' ELSE 'xsd:long' END}},
  CASE WHEN NOT cut THEN {{'path': ['kind'], 'nth': 3, 'kind': 'xsd:string'}} END]) AS n
FROM (SELECT * EXCLUDE (operation), CASE WHEN action = '' AND bare THEN 'Call' ELSE operation END AS operation FROM ({CALLS}))
"""


def _tree(*by: str) -> str:
    """Common table expressions up to ``tree``: parameters with the places of their ancestors, by operation and ``by``."""
    keys = ", ".join([*by, "operation"])
    return f"""
calls AS ({_NODES}),
seen AS (SELECT {keys}, seq, n.path AS path, n.nth AS nth, n.kind AS kind FROM calls WHERE n IS NOT NULL),
node AS (SELECT {keys}, path, arg_min(kind, seq) FILTER (kind IS NOT NULL) AS kind, min((seq, nth)) AS own FROM seen GROUP BY {keys}, path),
up AS (SELECT {keys}, path, kind, unnest(range(1, len(path) + 1)) AS k FROM node),
tree AS (
  SELECT {keys}, path, kind, list(n.own ORDER BY k) AS places
  FROM up JOIN (SELECT {keys}, path AS above, kind AS above_kind, own FROM node) n USING ({keys})
  WHERE n.above = path[1:k] GROUP BY {keys}, path, kind HAVING bool_and(k = len(path) OR coalesce(above_kind, '') = 'nested'))"""


_OPS = f"""
ops AS (
  SELECT site, CASE WHEN action = '' AND bare THEN 'Call' ELSE operation END AS operation, min(seq) AS first_seq,
    arg_min(replace(action, '"', ''), seq) FILTER (action <> '') AS action, arg_min(space, seq) AS space FROM ({CALLS}) GROUP BY ALL)"""
_SERVICES = f"""
services AS (
  SELECT o.site, CASE WHEN o.site = 'stock' THEN 'stock' ELSE 'prices' END AS service,
    CASE WHEN count(DISTINCT space) = 1 THEN any_value(space) ELSE 'https://Shop.example.com/' END AS namespace, any_value(url) AS location
  FROM ops o JOIN (SELECT site, arg_min(url, seq) AS url FROM ({CALLS}) GROUP BY site) u ON u.site = o.site GROUP BY o.site)"""


def _indent(depth: str, text: str) -> str:
    return f"repeat('  ', {depth}) || {text}"


#: The document of a place: each parameter's lines as text sorted by the places of its path, closing lines behind what they enclose.
_TEXT = f"""
WITH {_OPS.strip()}, {_SERVICES.strip()}, {_tree("spot").strip()},
lines AS (
  SELECT o.site, o.first_seq, t.places AS k, CASE WHEN kind = 'nested' THEN concat(repeat('  ', d), '<element name="', path[-1], '">', chr(10), repeat('  ', d + 1), '<complexType>', chr(10), repeat('  ', d + 2), '<sequence>')
    ELSE concat(repeat('  ', d), '<element name="', path[-1], '" type="', kind, '"></element>') END AS line
  FROM (SELECT *, (len(path) * 3 + 3)::INTEGER AS d FROM tree WHERE kind IS NOT NULL) t JOIN ops o ON o.site = t.spot AND o.operation = t.operation
  UNION ALL
  SELECT o.site, o.first_seq, list_append(t.places, (4611686018427387904::BIGINT, 0)), concat(repeat('  ', d + 2), '</sequence>', chr(10), repeat('  ', d + 1), '</complexType>', chr(10), repeat('  ', d), '</element>')
  FROM (SELECT *, (len(path) * 3 + 3)::INTEGER AS d FROM tree WHERE kind = 'nested') t JOIN ops o ON o.site = t.spot AND o.operation = t.operation),
types AS (SELECT site, first_seq, string_agg(line, chr(10) ORDER BY k) AS inner_lines FROM lines GROUP BY ALL),
o AS (SELECT ops.*, coalesce(inner_lines || chr(10), '') AS inner_lines FROM ops LEFT JOIN types USING (site, first_seq)),
parts AS (
  SELECT site,
    string_agg(concat('      <element name="', operation, '">', chr(10), '        <complexType>', chr(10), '          <sequence>', chr(10), inner_lines, '          </sequence>', chr(10), '        </complexType>', chr(10), '      </element>', chr(10)), '' ORDER BY first_seq) AS elements,
    string_agg(concat('  <message name="', operation, 'Request">', chr(10), '    <part name="parameters" element="tns:', operation, '"></part>', chr(10), '  </message>', chr(10), '  <message name="', operation, 'Response">', chr(10), '    <part name="parameters" element="tns:', operation, 'Response"></part>', chr(10), '  </message>', chr(10)), '' ORDER BY first_seq) AS messages,
    string_agg(concat('    <operation name="', operation, '">', chr(10), '      <input message="tns:', operation, 'Request"></input>', chr(10), '      <output message="tns:', operation, 'Response"></output>', chr(10), '    </operation>', chr(10)), '' ORDER BY first_seq) AS port,
    string_agg(concat('    <operation name="', operation, '">', CASE WHEN action IS NULL THEN '' ELSE concat(chr(10), '      <operation xmlns="http://schemas.xmlsoap.org/wsdl/soap/" soapAction="', action, '"></operation>', chr(10), '    ') END, '</operation>', chr(10)), '' ORDER BY first_seq) AS binding
  FROM o GROUP BY site)
SELECT site, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<definitions name="', service, '" targetNamespace="', namespace, '" xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:tns="', namespace, '" xmlns:xsd="http://www.w3.org/2001/XMLSchema">', chr(10),
  '  <types>', chr(10), '    <schema targetNamespace="', namespace, '" xmlns="http://www.w3.org/2001/XMLSchema">', chr(10), elements, '    </schema>', chr(10), '  </types>', chr(10), messages, '  <portType name="', service, 'PortType">', chr(10), port, '  </portType>', chr(10),
  '  <binding name="', service, 'Binding" type="tns:', service, 'PortType">', chr(10), '    <binding xmlns="http://schemas.xmlsoap.org/wsdl/soap/" style="document" transport="http://schemas.xmlsoap.org/soap/http"></binding>', chr(10), binding, '  </binding>', chr(10),
  '  <service name="', service, '">', chr(10), '    <port name="', service, 'Port" binding="tns:', service, 'Binding">', chr(10), '      <address xmlns="http://schemas.xmlsoap.org/wsdl/soap/" location="', location, '"></address>', chr(10), '    </port>', chr(10), '  </service>', chr(10), '</definitions>') AS wsdl
FROM services JOIN parts USING (site)
"""

#: Of the view of all traffic: an action's name is what stands behind "urn:"; without one the body's element counts where its prefix is declared.
_FLAT = f"SELECT seq, url, soap_action, CASE WHEN soap_action <> '' THEN 'stock#GetStock' WHEN contains(body, 'xmlns:soap') THEN 'GetStock' END AS operation, contains(body, 'xmlns:soap') AS fine FROM ({views.FLAT}) WHERE body LIKE '<soap:Envelope%'"
_FINE = "p_partkey % 10 NOT IN (3, 5, 6)"

ORACLES = {
    "soap_parameters": f"SELECT operation, 'part' AS name, 'xsd:int' AS type, min(seq) AS first_seq FROM ({_FLAT}) WHERE fine AND operation IS NOT NULL GROUP BY operation",
    "soap_types": f"WITH {_tree().strip()} SELECT operation, array_to_string(path, '/') AS name, kind, list_transform(places, lambda p: concat(p[1], '.', p[2])) AS place FROM tree",
    "soap_observed_operations": f"WITH {_OPS.strip()} SELECT * FROM ops",
    "soap_services": f"WITH {_OPS.strip()}, {_SERVICES.strip()} SELECT site, service, namespace FROM services",
    "wsdl_document": f"""
WITH c AS ({_FLAT}), o AS (SELECT operation AS op, min(seq) AS s, arg_min(replace(soap_action, '"', ''), seq) FILTER (soap_action <> '') AS action, bool_or(fine) AS fine FROM c WHERE operation IS NOT NULL GROUP BY 1),
h AS (SELECT arg_min(url, seq) AS url, 'https://shop.example.com/' AS ns FROM c)
SELECT 'stock' AS service, ns AS namespace, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<definitions name="stock" targetNamespace="', ns, '" xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:tns="', ns, '" xmlns:xsd="http://www.w3.org/2001/XMLSchema">', chr(10), '  <types>', chr(10), '    <schema targetNamespace="', ns, '" xmlns="http://www.w3.org/2001/XMLSchema">', chr(10),
  (SELECT string_agg(concat('      <element name="', op, '">', chr(10), '        <complexType>', chr(10), '          <sequence>', chr(10), '            <element name="part" type="xsd:int"></element>', chr(10), '          </sequence>', chr(10), '        </complexType>', chr(10), '      </element>', chr(10)), '' ORDER BY s) FROM o WHERE fine), '    </schema>', chr(10), '  </types>', chr(10),
  (SELECT string_agg(concat('  <message name="', op, 'Request">', chr(10), '    <part name="parameters" element="tns:', op, '"></part>', chr(10), '  </message>', chr(10), '  <message name="', op, 'Response">', chr(10), '    <part name="parameters" element="tns:', op, 'Response"></part>', chr(10), '  </message>', chr(10)), '' ORDER BY s) FROM o),
  '  <portType name="stockPortType">', chr(10), (SELECT string_agg(concat('    <operation name="', op, '">', chr(10), '      <input message="tns:', op, 'Request"></input>', chr(10), '      <output message="tns:', op, 'Response"></output>', chr(10), '    </operation>', chr(10)), '' ORDER BY s) FROM o), '  </portType>', chr(10),
  '  <binding name="stockBinding" type="tns:stockPortType">', chr(10), '    <binding xmlns="http://schemas.xmlsoap.org/wsdl/soap/" style="document" transport="http://schemas.xmlsoap.org/soap/http"></binding>', chr(10),
  (SELECT string_agg(concat('    <operation name="', op, '">', CASE WHEN action IS NULL THEN '' ELSE concat(chr(10), '      <operation xmlns="http://schemas.xmlsoap.org/wsdl/soap/" soapAction="', action, '"></operation>', chr(10), '    ') END, '</operation>', chr(10)), '' ORDER BY s) FROM o), '  </binding>', chr(10),
  '  <service name="stock">', chr(10), '    <port name="stockPort" binding="tns:stockBinding">', chr(10), '      <address xmlns="http://schemas.xmlsoap.org/wsdl/soap/" location="', url, '"></address>', chr(10), '    </port>', chr(10), '  </service>', chr(10), '</definitions>') AS wsdl FROM h
""",
    "wsdl_text": _TEXT,
    "wsdl_operations": f"SELECT p_partkey, unnest([concat('Get', CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR ELSE '' END), 'List']) AS operation FROM part WHERE {_FINE}",
    "wsdl_endpoints": f"""
WITH d AS (SELECT p_partkey, concat('{{urn:', p_brand, '}}') AS ns, p_partkey % 3 AS way, concat('Get', CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR ELSE '' END) AS op FROM part WHERE {_FINE})
SELECT p_partkey, 'One' AS service, 'A' AS port, concat('https://a/', p_partkey) AS location, op AS operation, CASE WHEN op = 'Get' THEN 'urn:get' END AS action, concat(ns, 'Get') AS input, NULL::VARCHAR AS output FROM d
UNION ALL
SELECT p_partkey, 'Two', 'A', NULL, CASE way WHEN 1 THEN 'List' WHEN 2 THEN op END, CASE WHEN way = 2 AND op = 'Get' THEN 'urn:get' END, CASE WHEN way > 0 THEN concat(ns, 'Get') END, NULL FROM d
""",
    "wsdl_generated": f"""
WITH d AS ({DOCUMENTS})
SELECT 'prices.asmx' AS site, false AS inferred, arg_min(body, p_partkey) AS wsdl FROM d WHERE p_partkey % 3 = 0 AND p_partkey > 2 AND {_FINE}
UNION ALL SELECT 'stock', true, NULL WHERE EXISTS (SELECT 1 FROM part)
""",
}
