"""Readers of recorded captures: JSON captures, Burp XML, HAR, and mitmproxy's JSON; each gives exchange records.

Files are read by Spark's own sources. A file with more than the size limit, or with an item that is no
exchange, fails the read with a message, as a capture must be whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import let
from quillspan.sources.schema import EXCHANGE, METHODS

# Limits on files, in bytes.
MAX_CAPTURE, MAX_IMPORT = 100 << 20, 500 << 20

_CAPTURE = """method string, url string, headers map<string,string>, query_params map<string,array<string>>, body string,
response struct<status_code:int,headers:map<string,string>,content_type:string,body:string>, source string, tag string, attribute string, page_url string"""
_HAR_PAIR = "array<struct<name:string,value:string>>"
_HAR = f"""log struct<entries:array<struct<
request:struct<method:string,url:string,headers:{_HAR_PAIR},postData:struct<text:string>>,
response:struct<status:int,headers:{_HAR_PAIR},content:struct<mimeType:string,text:string>>>>>"""
_MITM = """request struct<method:string,scheme:string,host:string,port:long,path:string,headers:array<array<string>>,content:string>,
response struct<status_code:int,headers:array<array<string>>,content:string>"""
_BURP = """url string, request struct<_VALUE:string,_base64:string>, response struct<_VALUE:string,_base64:string>, status string"""


def check_size(spark: SparkSession, path: str, limit: int) -> None:
    """Fail if a file of the path is larger than the limit; file contents are not read."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if largest is not None and largest > limit:
        raise ValueError(f"{path}: a file of {largest} bytes is over the limit of {limit}")


def _sure(value: Column, test: Column, message: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(F.left(value.cast("string"), F.lit(64)), F.lit("null")))))


def last_wins(pairs: Column) -> Column:
    """A map of (name, value) pairs without empty names; of a repeated name the last value stays."""

    def kept(named: Column) -> Column:
        value = lambda n: F.element_at(F.filter(named, lambda p: p["name"] == n), -1)["value"]
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda p: p["name"])), lambda n: F.struct(n, value(n))))

    given = F.coalesce(F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))), F.array().cast("array<struct<name:string,value:string>>"))
    return let(F.filter(given, lambda p: F.coalesce(p["name"], F.lit("")) != ""), kept)


def _records(rows: DataFrame, source: str | None = None) -> DataFrame:
    rows = rows if source is None else rows.withColumns({"source": F.lit(source), "tag": F.lit(""), "attribute": F.lit(""), "page_url": F.lit(""), "query_params": U.query_params(F.col("url"))})
    return rows.select(*[F.col(name).cast(kind) for name, kind in EXCHANGE.items()])


def _method(column: Column) -> Column:
    return _sure(column, column.isin(*METHODS), "not an HTTP method")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of exchanges, bodies in base64; ``seq`` follows the array."""
    check_size(spark, path, MAX_CAPTURE)
    return captures(spark.read.text(path, wholetext=True))


def captures(texts: DataFrame) -> DataFrame:
    """Exchanges of captures, one a row in the column ``value``."""
    rows = texts.select(F.posexplode(F.from_json("value", f"array<struct<{_ddl(_CAPTURE)}>>", {"mode": "FAILFAST"})).alias("seq", "x")).select("seq", "x.*")
    answer = F.struct(*[F.unbase64(F.col("response.body")).alias("body") if c == "body" else F.col(f"response.{c}").alias(c) for c in ("status_code", "headers", "content_type", "body")])
    return _records(rows.withColumn("body", F.unbase64("body")).withColumn("response", answer))


def _ddl(columns: str) -> str:
    """``name type`` pairs, as in a table's schema, in the form of a struct's."""
    out, depth, part = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def capture_records(exchanges: DataFrame) -> DataFrame:
    """Exchanges as a capture writes them: bodies in base64."""
    answer = F.struct(*[F.base64(F.col("response.body")).alias("body") if c == "body" else F.col(f"response.{c}").alias(c) for c in ("status_code", "headers", "content_type", "body")])
    return exchanges.withColumn("body", F.base64("body")).withColumn("response", answer)


def write_capture(exchanges: DataFrame, path: str, lines: bool = False) -> None:
    """A capture as a JSON array in the order of ``seq``, in one file, which its readers limit to 100 MB; or as JSON lines, in any number of files. Parquet is the format between stages."""
    ordered = capture_records(exchanges)
    if lines:
        ordered.sort("seq").drop("seq").write.json(path)
        return
    total = ordered.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            texts = [("[" if n + i == 0 else "") + t + ("," if n + i + 1 < total else "]") for i, t in enumerate(batch.column(0).to_pylist())]
            n += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(texts)], ["value"])

    text = F.to_json(F.struct(*[c for c in ordered.columns if c != "seq"])).alias("value")
    rows = ordered.coalesce(1).sortWithinPartitions("seq").select(text).mapInArrow(run, "value string") if total else ordered.sparkSession.createDataFrame([("[]",)], "value string")
    rows.coalesce(1).write.text(path)


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """HAR entries: bodies from the posted and the content text as they stand."""
    check_size(spark, path, MAX_IMPORT)
    return har_entries(spark.read.schema(_HAR).option("multiLine", True).option("mode", "FAILFAST").json(path))


def har_documents(texts: DataFrame) -> DataFrame:
    """Exchanges of HAR documents, one a row in the column ``value``."""
    return har_entries(texts.select(F.from_json("value", _HAR, {"mode": "FAILFAST"}).alias("d")).select("d.*"))


def har_entries(documents: DataFrame) -> DataFrame:
    """Exchanges of parsed HAR documents."""
    rows = documents.select(F.posexplode("log.entries").alias("seq", "e"))
    answer_headers = last_wins(F.col("e.response.headers"))
    kind = F.coalesce(F.nullif(F.col("e.response.content.mimeType"), F.lit("")), F.try_element_at(answer_headers, F.lit("Content-Type")), F.lit(""))
    return _records(
        rows.select(
            "seq",
            _method(F.col("e.request.method")).alias("method"),
            F.col("e.request.url").alias("url"),
            last_wins(F.col("e.request.headers")).alias("headers"),
            F.encode("e.request.postData.text", "UTF-8").alias("body"),
            F.struct(F.col("e.response.status").alias("status_code"), answer_headers.alias("headers"), kind.alias("content_type"), F.encode("e.response.content.text", "UTF-8").alias("body")).alias("response"),
        ),
        "import:har",
    )


def split_message(blob: Column) -> Column:
    """An HTTP message as (first, headers, body); null without a blank line. Headers are cut at the first colon, the last of equals stays."""
    text = F.decode(blob, "ISO-8859-1")
    cut = F.when(F.instr(text, "\r\n\r\n") > 0, F.struct(F.instr(text, "\r\n\r\n").alias("at"), F.lit(4).alias("n"))).when(F.instr(text, "\n\n") > 0, F.struct(F.instr(text, "\n\n").alias("at"), F.lit(2).alias("n")))
    lines = F.split(F.substring(text, F.lit(1), cut["at"] - 1), r"\r?\n")
    pair = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("name"), F.trim(F.regexp_replace(line, r"(?s)^[^:]*:", "")).alias("value"))
    headers = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.contains(":")), pair)
    body = F.substring(text, cut["at"] + cut["n"], F.length(text))
    return F.when(cut.isNotNull(), F.struct(F.element_at(lines, 1).alias("first"), last_wins(headers).alias("headers"), F.encode(body, "ISO-8859-1").alias("body")))


def read_burp(spark: SparkSession, path: str) -> DataFrame:
    """Burp's items: messages in base64 where flagged; an item's status wins over the status line's."""
    check_size(spark, path, MAX_IMPORT)
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreSurroundingSpaces", False).option("mode", "FAILFAST").schema(_BURP).load(path)
    return burp_items(rows)


def burp_items(rows: DataFrame) -> DataFrame:
    """Exchanges of Burp's items. A request line names a known method; a status line's second word is a number."""
    blob = lambda c: F.when(F.lower(f"{c}._base64") == "true", F.unbase64(F.trim(f"{c}._VALUE"))).otherwise(F.encode(f"{c}._VALUE", "ISO-8859-1"))
    rows = rows.withColumn("seq", F.monotonically_increasing_id()).withColumns({"asked": split_message(blob("request")), "told": split_message(blob("response"))})
    said = F.split_part(F.col("told.first"), F.lit(" "), F.lit(2))
    status = F.coalesce(F.nullif(F.col("status").try_cast("int"), F.lit(0)), F.when(F.col("told").isNotNull(), _sure(said.try_cast("int"), said.rlike("^[0-9]+$"), "no status line")), F.lit(0))
    words = F.split(F.col("asked.first"), " +")
    method = _sure(words[0], F.size(words) >= 2, "no request line")
    return _records(
        rows.select(
            "seq",
            _method(method).alias("method"),
            F.trim("url").alias("url"),
            F.col("asked.headers").alias("headers"),
            F.col("asked.body").alias("body"),
            F.struct(status.alias("status_code"), F.col("told.headers").alias("headers"), F.coalesce(F.try_element_at("told.headers", F.lit("Content-Type")), F.lit("")).alias("content_type"), F.col("told.body").alias("body")).alias("response"),
        ),
        "import:burp",
    )


def flow_url(scheme: Column, host: Column, port: Column, path: Column) -> Column:
    """The URL of a flow, its default port left out."""
    plain = ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80))
    bare, query = F.substring_index(path, "?", 1), F.regexp_replace(path, r"(?s)\A[^?]*", "")
    fine = F.when(U.unescape(bare).isNotNull(), bare).otherwise(F.replace(bare, F.lit("%"), F.lit("%25")))  # a path that cannot be decoded stands for itself
    return F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), F.when(bare.startswith("/"), fine).otherwise(F.concat(F.lit("/"), fine)), query)


def is_host(host: Column) -> Column:
    return (F.length(host) > 0) & (F.length(host) <= 253) & ~host.rlike(r"[@:/?#\[\]\\\x00-\x20\x7f]")


def flows_to_exchanges(flows: DataFrame) -> DataFrame:
    """Exchanges of flows (seq, request, response): checked method, scheme, host and port."""
    pairs = lambda h: last_wins(F.transform(F.filter(h, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("name"), p[1].alias("value"))))
    r = F.col("request")
    url = flow_url(r["scheme"], r["host"], r["port"], F.coalesce(F.nullif(r["path"], F.lit("")), F.lit("/")))
    fine = r["scheme"].isin("http", "https") & is_host(r["host"]) & r["port"].between(0, 65535)
    told = pairs(F.col("response.headers"))
    kind = F.element_at(F.concat(F.map_values(F.map_filter(told, lambda k, v: F.lower(k) == "content-type")), F.array(F.lit(""))), 1)
    return _records(
        flows.select(
            "seq",
            _method(F.upper(r["method"])).alias("method"),
            _sure(url, fine, "not a flow's address").alias("url"),
            pairs(r["headers"]).alias("headers"),
            F.encode(r["content"], "UTF-8").alias("body"),
            F.struct(F.col("response.status_code").alias("status_code"), told.alias("headers"), kind.alias("content_type"), F.encode("response.content", "UTF-8").alias("body")).alias("response"),
        ),
        "import:mitmproxy",
    )


def read_mitmproxy_json(spark: SparkSession, path: str) -> DataFrame:
    """Flows as a JSON array or a single object."""
    check_size(spark, path, MAX_IMPORT)
    return mitmproxy_documents(spark.read.text(path, wholetext=True))


def mitmproxy_documents(texts: DataFrame) -> DataFrame:
    """Exchanges of flows in JSON, an array or an object a row in the column ``value``."""
    text = F.trim("value")
    whole = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(_sure(text, text.startswith("["), "neither a JSON array nor an object"))
    rows = texts.select(F.posexplode(F.from_json(whole, f"array<struct<{_ddl(_MITM)}>>", {"mode": "FAILFAST"})).alias("seq", "x"))
    return flows_to_exchanges(rows.select("seq", "x.*"))


def read_mitmproxy(spark: SparkSession, path: str) -> DataFrame:
    """Flows in JSON or as native dumps, by the first byte of the files that is no white space; files of a path are of one kind."""
    from quillspan.sources.mitm import read_mitmproxy_native

    check_size(spark, path, MAX_IMPORT)
    head = F.ltrim(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), F.lit(" \t\r\n"))
    kinds = {r[0] for r in spark.read.format("binaryFile").load(path).select(F.left(head, F.lit(1))).distinct().limit(3).collect()}
    if kinds and kinds <= {"[", "{"}:
        return read_mitmproxy_json(spark, path)
    if kinds and all(k.isdigit() for k in kinds):
        return read_mitmproxy_native(spark, path)
    raise ValueError(f"{path}: neither JSON nor a native dump: {sorted(kinds)}")


def in_scope(url: Column, scope: str) -> Column:
    """Exactly the host, or ``*.domain`` with the domain itself; an empty scope takes all."""
    if not scope:
        return F.lit(True)
    if scope.startswith("*."):
        return (U.host(url) == scope[2:].lower()) | U.host(url).endswith(scope[1:].lower())
    return U.host(url) == scope.lower()


def read(spark: SparkSession, kind: str, path: str, scope: str = "", max_entries: int | None = None) -> DataFrame:
    """Exchanges of a file by the name of its format; too many entries fail before the scope is applied."""
    readers = {"capture": read_capture, "burp": read_burp, "har": read_har, "mitmproxy": read_mitmproxy}
    if kind not in readers:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(sorted(readers))}")
    rows = readers[kind](spark, path)
    if max_entries is not None and (n := rows.limit(max_entries + 1).count()) > max_entries:
        raise ValueError(f"more than {n - 1} entries")
    return rows.filter(in_scope(F.col("url"), scope))
