"""SOAP envelopes as trees, the WSDL that traffic implies, and recorded WSDL documents as tables.

One pass over bodies walks the XML (as far as it goes: what stands before a cut or a fault counts) and gives each parameter
as a path of names. Everything after that is relational: the first typed observation of each path wins, nested types are those whose
ancestors all won as nested, and a document's lines are put in order by the places of their paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.operators.soap import uri_tail

# Namespaces, how deep envelopes are read, the encodings that documents may declare, endings that are no part of a service's name.
ENVELOPES = ("http://schemas.xmlsoap.org/soap/envelope/", "http://www.w3.org/2003/05/soap-envelope")
INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
WSDL_SOAP = "http://schemas.xmlsoap.org/wsdl/soap/"
MAX_DEPTH = 32
CHARSETS = ("iso-8859-1", "latin-1", "us-ascii", "ascii", "utf-8")
ENDINGS = (".php", ".asmx", ".svc")

#: What a path holds that has children.
NESTED = "nested"


class _Stop(Exception):
    """Ends a walk: the document has been read as far as it counts."""


class Walk:
    """Elements of a document with names resolved; ``start(space, name, attributes)`` and ``end()`` are told of each, ``text`` of its characters.

    Prefixes that are not declared stand for themselves. Entities of the document's own are a fault.
    """

    def __init__(self, charsets: tuple[str, ...] = ("utf-8",)) -> None:
        self.scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
        self.parser = p = expat.ParserCreate()
        p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self.text
        p.XmlDeclHandler = lambda version, encoding, alone: self._declared(encoding, charsets)
        p.EntityDeclHandler = self._entity

    def _declared(self, encoding: str | None, charsets: tuple[str, ...]) -> None:
        if encoding and encoding.lower() not in charsets:
            raise _Stop

    def _entity(self, *_: object) -> None:
        raise _Stop

    def resolve(self, name: str, default: bool = True) -> tuple[str, str]:
        """(namespace, local name) of a prefixed name; without a prefix the default namespace, if that applies."""
        prefix, _, local = name.rpartition(":")
        if not prefix:
            return (self.scopes[-1].get("", "") if default else ""), local
        return self.scopes[-1].get(prefix, prefix), local

    def _start(self, name: str, attributes: list[str]) -> None:
        pairs = dict(zip(attributes[::2], attributes[1::2], strict=True))
        own = {k[6:]: v for k, v in pairs.items() if k == "xmlns" or k.startswith("xmlns:")}
        self.scopes.append(self.scopes[-1] | own if own else self.scopes[-1])
        self.start(*self.resolve(name), {self.resolve(k, default=False): v for k, v in pairs.items()})

    def _end(self, _: str) -> None:
        self.end()
        self.scopes.pop()

    def start(self, space: str, name: str, attributes: dict[tuple[str, str], str]) -> None: ...
    def end(self) -> None: ...
    def text(self, data: str) -> None: ...

    def read(self, document: bytes) -> bool:
        """Walks the document; whether it was well-formed to its end."""
        try:
            self.parser.Parse(document, True)
        except (expat.ExpatError, _Stop, ValueError, LookupError):
            return False
        return True


_SHAPES = (("xsd:boolean", r"true|false"), ("xsd:int", r"-?(0|[1-9][0-9]*)"), ("xsd:decimal", r"-?[0-9]+\.[0-9]+"), ("xsd:date", r"\d{4}-\d{2}-\d{2}"), ("xsd:dateTime", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?"))


def _real(kind: str, text: str) -> bool:
    """Whether a date or time exists in the calendar and on the clock."""
    try:
        datetime.strptime(text[:19], "%Y-%m-%d" if kind == "xsd:date" else "%Y-%m-%dT%H:%M:%S")
    except ValueError:
        return False
    zone = re.search(r"[+-](\d{2}):(\d{2})$", text) if kind == "xsd:dateTime" else None
    return zone is None or int(zone[1]) <= 24 and int(zone[2]) < 60


def value_type(text: str) -> str | None:
    """The XSD type that a text looks like; None for white space alone. Numbers with leading zeros are texts."""
    text = text.strip()
    if not text:
        return None
    for kind, shape in _SHAPES:
        if re.fullmatch(shape, text, re.ASCII) and ("date" not in kind or _real(kind, text)):
            return kind
    return "xsd:string"


def declared_type(value: str) -> str:
    """The XSD type of an ``xsi:type``: of the prefixes xsd and xs and of names without one; others count as texts."""
    prefix, colon, name = value.strip().partition(":")
    return "xsd:string" if not value.strip() or colon and prefix not in ("xsd", "xs") else f"xsd:{name if colon else prefix}"


class Envelope(Walk):
    """The first element of a SOAP body, and the parameters below it: path, place of its first mention, and type (None: never said)."""

    def __init__(self) -> None:
        super().__init__()
        self.in_body, self.space, self.operation = False, "", ""
        self.stack: list[list] = []  # of each open parameter: name, type that was declared, texts, children
        self.children: dict[str, list] | None = None

    def start(self, space: str, name: str, attributes: dict[tuple[str, str], str]) -> None:
        if self.children is None:
            if name.lower() == "body" and space in ENVELOPES:
                self.in_body = True
            elif self.in_body:
                self.space, self.operation, self.children = space, name, {}
            return
        self.stack.append([name, attributes.get((INSTANCE, "type")) or None, [], {}])

    def text(self, data: str) -> None:
        if self.stack:
            self.stack[-1][2].append(data)

    def end(self) -> None:
        if self.stack:
            self._close()
        elif self.children is not None:
            raise _Stop  # the operation is over

    def _close(self) -> None:
        name, declared, texts, children = self.stack.pop()
        depth = len(self.stack) + 2
        if declared is not None:
            kind, children = declared_type(declared), {}
        elif children and depth < MAX_DEPTH:
            kind = NESTED
        else:
            kind, children = value_type("".join(texts)), {}
        into = self.stack[-1][3] if self.stack else self.children
        if name not in into or into[name][0] is None and kind is not None:
            place = into[name][1] if name in into else len(into)
            into[name] = [kind, place, children]

    def finish(self, body: bytes) -> None:
        self.read(body)
        while self.stack:
            self._close()

    def nodes(self) -> list[tuple[list[str], int, str | None]]:
        """(path, place among siblings, type) of each parameter."""
        out, todo = [], [((), self.children or {})]
        while todo:
            path, level = todo.pop()
            for name, (kind, place, children) in level.items():
                out.append(([*path, name], place, kind))
                if children:
                    todo.append(((*path, name), children))
        return out


_NODES = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("place", pa.int32()), ("kind", pa.string())]))


def soap_calls(rows: DataFrame) -> DataFrame:
    """(seq, url, operation, action, space, nodes): exchanges that name a SOAP operation.

    The name comes from the SOAPAction, else from the request's first element, else from the response's without ``Response``. ``nodes`` (path, place, kind) are
    the request's parameters, null where no envelope is; ``space`` is the namespace of its first element.
    """
    action = F.btrim(H.header(F.col("headers"), "SOAPAction"), F.lit('"'))
    held = rows.select("seq", "url", action.alias("action"), F.col("body").alias("asked"), F.col("response.body").alias("told"))
    may = lambda c: F.when(F.lower(H.body_text(F.col(c))).contains("body"), F.col(c))
    held = held.withColumns({"asked": may("asked"), "told": F.when((F.coalesce("action", F.lit("")) == ""), may("told"))})
    held = held.filter("action <> '' OR asked IS NOT NULL OR told IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, told, space, nodes = [], [], [], []
            for request, response in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                envelope, answer = Envelope(), Envelope()
                envelope.finish(request or b"")
                if response and not envelope.operation:
                    answer.finish(response)
                asked.append(envelope.operation)
                told.append(answer.operation)
                space.append(envelope.space)
                nodes.append(envelope.nodes() if envelope.children is not None else None)
            parts = [pa.array([tuple_to_struct(n) for n in nodes], _NODES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(asked), pa.array(told), pa.array(space), *parts], ["seq", "url", "action", "asked", "told", "space", "nodes"])

    def tuple_to_struct(nodes: list[tuple] | None) -> list[dict] | None:
        return None if nodes is None else [{"path": p, "place": i, "kind": k} for p, i, k in nodes]

    read = held.select("seq", "url", "action", "asked", "told").mapInArrow(run, "seq long, url string, action string, asked string, told string, space string, nodes array<struct<path:array<string>,place:int,kind:string>>")
    named = F.coalesce(F.nullif(uri_tail(F.col("action")), F.lit("")), F.nullif(F.col("asked"), F.lit("")), F.nullif(F.regexp_replace("told", r"Response\z", ""), F.lit("")))
    by_action = F.coalesce(uri_tail(F.col("action")), F.lit("")) != ""
    return read.select("seq", "url", named.alias("operation"), F.when(by_action, F.col("action")).alias("action"), "space", "nodes").filter("operation IS NOT NULL")


def operations(calls: DataFrame, *by: str) -> DataFrame:
    """(``by``, operation, first_seq, action, space, described): each operation by its first mention; the first action and namespace that were seen."""
    first = lambda c: F.min_by(c, F.when((F.col(c).isNotNull()) & (F.col(c) != ""), F.col("seq")))
    return calls.groupBy(*by, "operation").agg(F.min("seq").alias("first_seq"), first("action").alias("action"), first("space").alias("space"), F.bool_or(F.col("nodes").isNotNull()).alias("described"))


def parameters(calls: DataFrame, *by: str) -> DataFrame:
    """(``by``, operation, path, kind, place): the parameters of all calls as one tree.

    Of each path the first typed observation counts, in the order of ``seq``; calls are combined before the shuffle. What lies below a path that is not nested is
    dropped. ``place`` is an array of the places of the path's ancestors and its own (first call, place there), by which parameters stand in order.
    ``kind`` is null for a parameter that was always empty.
    """
    seen = calls.select(*by, "operation", "seq", F.explode("nodes").alias("n")).select(*by, "operation", "seq", "n.*")
    node = seen.groupBy(*by, "operation", "path").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("kind"), F.min(F.struct("seq", "place")).alias("own"))
    keys = [*by, "operation"]
    up = node.select(*keys, "path", "kind", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("length"))
    up = up.withColumn("above", F.slice("path", F.lit(1), F.col("length")))
    over = node.select(*keys, F.col("path").alias("above"), F.col("kind").alias("above_kind"), F.col("own"))
    joined = up.join(over, [*keys, "above"])
    fits = F.bool_and((F.col("length") == F.size("path")) | (F.coalesce("above_kind", F.lit("")) == NESTED))
    placed = joined.groupBy(*keys, "path", "kind").agg(fits.alias("fits"), F.array_sort(F.collect_list(F.struct("length", "own"))).alias("places"))
    return placed.filter("fits").select(*keys, "path", "kind", F.transform("places", lambda p: p["own"]).alias("place"))


def service_name(url: Column) -> Column:
    """The last segment of a URL's path, without the endings of scripts; ``Service`` where there is none."""
    tail = F.substring_index(F.rtrim(U.path(url), F.lit("/")), "/", -1)
    for ending in ENDINGS:
        tail = F.when(F.endswith(tail, F.lit(ending)), F.left(tail, F.length(tail) - len(ending))).otherwise(tail)
    return F.when(tail == "", "Service").otherwise(tail)


def escaped(text: Column) -> Column:
    """As the value of an XML attribute."""
    for sign, entity in (("&", "&amp;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _line(depth: Column | int, *parts: Column | str) -> Column:
    """A line of a document, indented by two blanks for each level."""
    space = F.repeat(F.lit("  "), depth if isinstance(depth, Column) else F.lit(depth))
    return F.concat(space, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def infer_wsdl(rows: DataFrame, *by: str) -> DataFrame:
    """(``by``, service, namespace, wsdl): the WSDL that the SOAP calls of ``rows`` imply; one document, or one for each value of ``by``.

    Name, address and fallback namespace come from the first call's URL; the namespace is the one that all operations' elements declare, if they
    agree. Operations stand in the order of their first mention, with the first SOAPAction seen. A document gathers the lines of an interface's
    operations, however many calls there were. No SOAP calls give no document.
    """
    held = rows if by else rows.withColumn("__all", F.lit(0))
    keys = list(by) or ["__all"]
    first = held.groupBy(*keys).agg(F.min_by("url", "seq").alias("location"))
    calls = soap_calls_with(held, keys)
    ops = operations(calls, *keys)
    # the first URL of all endpoints names the service, as long as any operation was found
    spaces = F.array_distinct(F.filter(F.collect_list("space"), lambda s: s != ""))
    head = ops.groupBy(*keys).agg(spaces.alias("spaces"), F.bool_or("described").alias("described")).join(first, keys)
    origin = F.concat(F.lower(F.regexp_extract("location", r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), F.lit("://"), F.regexp_extract("location", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("/"))
    head = head.select(*keys, "location", "described", service_name(F.col("location")).alias("service"), F.when(F.size("spaces") == 1, F.col("spaces")[0]).otherwise(origin).alias("namespace"))
    s, ns, name, o = escaped(F.col("service")), escaped(F.col("namespace")), F.col("service"), escaped(F.col("operation"))

    # Lines are (section, operation's place, key within it, text); a closing line sorts behind all below it.
    top = F.struct(F.lit(1 << 62).cast("long").alias("seq"), F.lit(0).alias("place"))
    none = F.array().cast("array<struct<seq:bigint,place:int>>")
    row = lambda section, op, key, text: F.struct(F.lit(section).alias("section"), op.alias("op"), key.alias("key"), text.alias("line"))
    at = F.struct(F.col("first_seq").alias("seq"), F.col("operation").alias("name"))
    begin = F.struct(F.lit(-(1 << 62)).cast("long").alias("seq"), F.lit("").alias("name"))
    close = F.struct(F.lit(1 << 62).cast("long").alias("seq"), F.lit("").alias("name"))
    soap = f'xmlns="{WSDL_SOAP}"'
    fixed = head.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    row(0, begin, none, F.lit('<?xml version="1.0" encoding="UTF-8"?>')),
                    row(1, begin, none, _line(0, '<definitions name="', s, '" targetNamespace="', ns, f'" xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="{WSDL_SOAP}" xmlns:tns="', ns, '" xmlns:xsd="http://www.w3.org/2001/XMLSchema">')),
                    F.when(F.col("described"), row(2, begin, none, F.concat(_line(1, "<types>\n"), _line(2, '<schema targetNamespace="', ns, '" xmlns="http://www.w3.org/2001/XMLSchema">')))),
                    F.when(F.col("described"), row(2, close, none, F.concat(_line(2, "</schema>\n"), _line(1, "</types>")))),
                    row(4, begin, none, _line(1, '<portType name="', s, 'PortType">')),
                    row(4, close, none, _line(1, "</portType>")),
                    row(5, begin, none, F.concat(_line(1, '<binding name="', s, 'Binding" type="tns:', s, 'PortType">\n'), _line(2, f'<binding {soap} style="document" transport="http://schemas.xmlsoap.org/soap/http"></binding>'))),
                    row(5, close, none, _line(1, "</binding>")),
                    row(6, begin, none, F.concat(_line(1, '<service name="', s, '">\n'), _line(2, '<port name="', s, 'Port" binding="tns:', s, 'Binding">\n'), _line(3, f'<address {soap} location="', escaped(F.col("location")), '"></address>\n'), _line(2, "</port>\n"), _line(1, "</service>\n"), _line(0, "</definitions>"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("l"),
    )
    action = F.when(F.col("action").isNotNull(), F.concat(F.lit("\n"), _line(3, f'<operation {soap} soapAction="', escaped(F.col("action")), '"></operation>\n'), _line(2))).otherwise("")
    message = lambda which, element: F.concat(_line(1, '<message name="', o, f'{which}">\n'), _line(2, '<part name="parameters" element="tns:', o, f'{element}"></part>\n'), _line(1, "</message>"))
    opened, closed = F.concat(_line(3, '<element name="', o, '">\n'), _line(4, "<complexType>\n")), F.concat(_line(4, "</complexType>\n"), _line(3, "</element>"))
    of_ops = ops.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("described"), row(2, at, none, F.concat(opened, _line(5, "<sequence>")))),
                    F.when(F.col("described"), row(2, at, F.array(top), F.concat(_line(5, "</sequence>\n"), closed))),
                    row(3, at, none, F.concat(message("Request", ""), F.lit("\n"), message("Response", "Response"))),
                    row(4, at, none, F.concat(_line(2, '<operation name="', o, '">\n'), _line(3, '<input message="tns:', o, 'Request"></input>\n'), _line(3, '<output message="tns:', o, 'Response"></output>\n'), _line(2, "</operation>"))),
                    row(5, at, none, F.concat(_line(2, '<operation name="', o, '">'), action, F.lit("</operation>"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("l"),
    )
    p = F.element_at("path", -1)
    depth = F.size("path") * 3 + 3
    told = parameters(calls, *keys).filter("kind IS NOT NULL").join(ops.select(*keys, "operation", "first_seq"), [*keys, "operation"])
    nested = F.col("kind") == NESTED
    leaf = row(2, at, F.col("place"), _line(depth, '<element name="', escaped(p), '" type="', escaped(F.col("kind")), '"></element>'))
    start = row(2, at, F.col("place"), F.concat(_line(depth, '<element name="', escaped(p), '">\n'), _line(depth + 1, "<complexType>\n"), _line(depth + 2, "<sequence>")))
    stop = row(2, at, F.concat("place", F.array(top)), F.concat(_line(depth + 2, "</sequence>\n"), _line(depth + 1, "</complexType>\n"), _line(depth, "</element>")))
    of_params = told.select(*keys, F.explode(F.when(nested, F.array(start, stop)).otherwise(F.array(leaf))).alias("l"))
    lines = fixed.unionByName(of_ops).unionByName(of_params).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("wsdl"))
    # an element without children is one line in its parent's sequence, and an empty sequence is written on one line
    tidy = F.regexp_replace("wsdl", r"<sequence>\n *</sequence>", "<sequence></sequence>")
    return head.join(lines, keys).select(*by, name.alias("service"), "namespace", tidy.alias("wsdl"))


def soap_calls_with(rows: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`soap_calls` with the columns ``keys`` of each row, which follow by ``seq``."""
    return soap_calls(rows).join(rows.select("seq", *keys), "seq")


class _Document(Walk):
    """The parts of a WSDL document as flat records (kind, id, owner, name, ref, ref2, value); references are ``{namespace}name``."""

    def __init__(self) -> None:
        super().__init__(CHARSETS)
        self.open: list[tuple[str, int]] = []
        self.records: list[list] = []
        self.root, self.space = None, ""

    def _qualified(self, name: str | None) -> str | None:
        return None if name is None else "{%s}%s" % self.resolve(name.strip())

    def start(self, space: str, name: str, attributes: dict[tuple[str, str], str]) -> None:
        given = {k: v for (s, k), v in attributes.items() if not s}
        if self.root is None:
            self.root, self.space = name, given.get("targetNamespace", "")
            if name != "definitions":
                raise _Stop
        above = self.open[-1][0] if self.open else ""
        kind = {("definitions", "message"): "message", ("message", "part"): "part", ("definitions", "portType"): "portType", ("portType", "operation"): "operation", ("definitions", "binding"): "binding", ("binding", "operation"): "call", ("definitions", "service"): "service", ("service", "port"): "port"}.get((above, name)) if space != WSDL_SOAP else None
        owner = self.open[-1][1] if self.open else -1
        if kind:
            own = "{%s}%s" % (self.space, given.get("name", ""))
            ref = {"part": given.get("element") or given.get("type"), "binding": given.get("type"), "port": given.get("binding")}.get(kind)
            self.records.append([kind, len(self.records), owner, own if kind in ("message", "portType", "binding") else given.get("name", ""), self._qualified(ref), None, None])
            self.open.append((kind, len(self.records) - 1))
            return
        if owner >= 0 and self.records:
            record = self.records[owner]
            if above == "operation" and name in ("input", "output"):
                record[4 if name == "input" else 5] = self._qualified(given.get("message"))
            elif space == WSDL_SOAP and (above, name) in (("call", "operation"), ("port", "address")):
                record[6] = given.get("soapAction" if name == "operation" else "location")
        self.open.append(("definitions" if not self.open else f"?{name}", owner))

    def end(self) -> None:
        self.open.pop()


def wsdl_parts(documents: DataFrame, key: str, body_col: str = "body") -> DataFrame:
    """(key, kind, id, owner, name, ref, ref2, value): the parts of each recorded document that is a whole WSDL document, else none.

    A document must be well-formed, its root be ``definitions``, and its declared encoding one of :data:`CHARSETS`. Each has a row of kind ``definitions``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            at, out = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                document = _Document()
                if body and document.read(body) and document.root == "definitions":
                    found = [["definitions", -1, None, document.space, None, None, None], *document.records]
                    out += found
                    at += [i] * len(found)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "kind", "id", "owner", "name", "ref", "ref2", "value"])

    kind = documents.schema[key].dataType.simpleString()
    read = documents.select(key, F.col(body_col).cast("binary").alias("body")).filter(F.col("body").isNotNull()).mapInArrow(run, f"key {kind}, kind string, id int, owner int, name string, ref string, ref2 string, value string")
    return read.withColumnRenamed("key", key)


def wsdl_endpoints(parts: DataFrame, key: str) -> DataFrame:
    """(key, service, port, location, operation, action, input, output): what recorded WSDL documents offer, references followed by qualified name.

    A port's binding, the binding's port type, its operations, and their messages' first parts are found by name within the document, wherever they stand. A reference that
    leads nowhere leaves nulls, from the operation on (a port without a known port type has one row without operation).
    """
    of = lambda kind, **names: parts.filter(F.col("kind") == kind).select(key, *[F.col(c).alias(n) for n, c in names.items()])
    ports = of("port", owner="owner", port="name", binding="ref", location="value").join(of("service", owner="id", service="name"), [key, "owner"]).drop("owner")
    bound = ports.join(of("binding", binding="name", port_type="ref", binding_id="id"), [key, "binding"], "left")
    types = of("portType", port_type="name", type_id="id")
    offered = of("operation", type_id="owner", operation="name", asked="ref", told="ref2", place="id").join(types, [key, "type_id"]).drop("type_id")
    offered = bound.join(offered, [key, "port_type"], "left")
    actions = of("call", binding_id="owner", operation="name", action="value").groupBy(key, "binding_id", "operation").agg(F.max("action").alias("action"))
    offered = offered.join(actions, [key, "binding_id", "operation"], "left")
    first = of("part", owner="owner", element="ref", place="id").groupBy(key, "owner").agg(F.min_by("element", "place").alias("element"))
    messages = of("message", message="name", owner="id").join(first, [key, "owner"], "left").groupBy(key, "message").agg(F.min_by("element", "owner").alias("element"))
    for side, name in (("asked", "input"), ("told", "output")):
        offered = offered.join(messages.select(key, F.col("message").alias(side), F.col("element").alias(name)), [key, side], "left")
    return offered.select(key, "service", "port", "location", "operation", "action", "input", "output")


def generate_wsdl(rows: DataFrame, *by: str) -> DataFrame:
    """(``by``, wsdl, inferred): the first recorded document that is a WSDL document, verbatim, else what the traffic implies.

    A row's own ``wsdl_document``, if there is that column, goes before its response's body; rows count in the order of ``seq``.
    """
    held = rows if by else rows.withColumn("__all", F.lit(0))
    keys = list(by) or ["__all"]
    probed = [F.struct(F.lit(0).alias("nth"), F.col("wsdl_document").alias("body"))] if "wsdl_document" in rows.columns else []
    bodies = held.select("seq", *keys, F.explode(F.array(*probed, F.struct(F.lit(1).alias("nth"), F.col("response.body").alias("body")))).alias("b")).select("seq", *keys, "b.*")
    bodies = bodies.filter(F.contains(F.substring(H.body_text(F.col("body")), 1, 4096), F.lit("definitions"))).withColumn("at", F.struct("seq", "nth"))
    fine = wsdl_parts(bodies.withColumn("which", F.to_json("at")), "which").filter("kind = 'definitions'").select("which").distinct()
    found = bodies.withColumn("which", F.to_json("at")).join(fine, "which").groupBy(*keys).agg(H.body_text(F.min_by("body", "at")).alias("recorded"))
    made = infer_wsdl(held, *keys)
    both = found.join(made, keys, "full")
    return both.select(*by, F.coalesce("recorded", "wsdl").alias("wsdl"), F.col("recorded").isNull().alias("inferred"))
