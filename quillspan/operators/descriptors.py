"""Protobuf file descriptors as tables: union, graph of imports, name-only services beside them, and proto3 text.

Recorded descriptor bytes are walked once into rows, one for each element of a file. Which files can be built, which services need be made up and
how the text is put in order are joins and aggregates over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.wire import BYTES, walk_fields

# Bounds of a set of descriptors, names of scalar types by number, the folder of well-known files, and the name of made-up files.
MAX_FILES, MAX_BYTES = 1000, 64 << 20
SCALARS = {1: "double", 2: "float", 3: "int64", 4: "uint64", 5: "int32", 6: "fixed64", 7: "fixed32", 8: "bool", 9: "string", 12: "bytes", 13: "uint32", 15: "sfixed32", 16: "sfixed64", 17: "sint32", 18: "sint64"}
WELL_KNOWN, SYNTHETIC = "google/protobuf/", "synthetic.proto"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"

_ELEMENT = "kind string, path array<string>, name string, number int, type string, label string, client boolean, server boolean"


class _Malformed(ValueError):
    """Bytes that are no descriptor."""


def _grouped(message: bytes) -> dict[int, list]:
    """The values of each field of a message, bytes or numbers."""
    found = walk_fields(message)
    if found is None:
        raise _Malformed
    out: dict[int, list] = {}
    for field, kind, number, data in found:
        out.setdefault(field, []).append(data if kind == BYTES else number)
    return out


def _text(fields: dict[int, list], field: int) -> str:
    value = fields.get(field, [b""])[-1]
    if not isinstance(value, bytes):
        raise _Malformed
    return value.decode("utf-8")


def _number(fields: dict[int, list], field: int) -> int:
    value = fields.get(field, [0])[-1]
    return value if isinstance(value, int) else 0


def _signed(value: int) -> int:
    value &= (1 << 32) - 1
    return value - (1 << 32) if value >> 31 else value


def _enum(data: bytes, above: list[str]) -> Iterator[tuple]:
    fields = _grouped(data)
    path = [*above, _text(fields, 1)]
    yield "enum", path, path[-1], 0, None, None, None, None
    for value in map(_grouped, fields.get(2, [])):
        yield "value", path, _text(value, 1), _signed(_number(value, 2)), None, None, None, None


def _message(data: bytes, above: list[str], depth: int = 0) -> Iterator[tuple]:
    """Elements of a message and of what is nested in it; entries of maps become the types of the fields that hold them."""
    if depth > 64:
        raise _Malformed
    fields = _grouped(data)
    path = [*above, _text(fields, 1)]
    yield "message", path, path[-1], 0, None, None, None, None
    oneofs = [_text(_grouped(o), 1) for o in fields.get(8, [])]
    maps = {}
    for nested in fields.get(3, []):
        inner = _grouped(nested)
        if any(_number(_grouped(o), 7) for o in inner.get(7, [])):
            parts = {_number(f, 3): f for f in map(_grouped, inner.get(2, []))}
            maps[_text(inner, 1)] = [(SCALARS.get(_number(parts[k], 5)) or _text(parts[k], 6)) if k in parts else "" for k in (1, 2)]
        else:
            yield from _message(nested, path, depth + 1)
    for enum in fields.get(4, []):
        yield from _enum(enum, path)
    for f in map(_grouped, fields.get(2, [])):
        kind = SCALARS.get(_number(f, 5)) or _text(f, 6)
        label = "repeated " if _number(f, 4) == 3 else "optional " if _number(f, 17) else ""
        entry = maps.get(kind.rpartition(".")[2]) if label == "repeated " and not SCALARS.get(_number(f, 5)) else None
        if entry:
            kind, label = f"map<{entry[0]}, {entry[1]}>", ""
        at = _number(f, 9)
        yield "field", path, _text(f, 1), _number(f, 3), kind, label, None, None
        if 9 in f and not _number(f, 17) and at < len(oneofs):
            yield "oneof", path, oneofs[at], _number(f, 3), _text(f, 1), None, None, None


def elements_of(data: bytes) -> list[tuple] | None:
    """The elements of a file descriptor: (kind, path, name, number, type, label, client, server); None for what is none.

    The first is the file itself: its own name, and its package as type.
    """
    try:
        fields = _grouped(data)
        out = [("file", [], _text(fields, 1), 0, _text(fields, 2), _text(fields, 12) or "proto2", None, None)]
        public = set(fields.get(10, []))
        for n, name in enumerate(fields.get(3, [])):
            out.append(("import", [], name.decode("utf-8"), n, None, "public " if n in public else "", None, None))
        for message in fields.get(4, []):
            out += _message(message, [])
        for enum in fields.get(5, []):
            out += _enum(enum, [])
        for service in map(_grouped, fields.get(6, [])):
            path = [_text(service, 1)]
            out.append(("service", path, path[0], 0, None, None, None, None))
            for m in map(_grouped, service.get(2, [])):
                out.append(("method", path, _text(m, 1), 0, _text(m, 2), _text(m, 3), bool(_number(m, 5)), bool(_number(m, 6))))
    except (_Malformed, UnicodeDecodeError, AttributeError, TypeError):
        return None
    return out


def union_files(recorded: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, raw, conflict): the descriptors (seq, file, raw) of all endpoints, one of each file name, the first seen.

    ``conflict`` tells whether some endpoint has other bytes under the name. Bytes are combined before the shuffle.
    """
    digests = F.array_size(F.collect_set(F.sha2("raw", 256)))
    return recorded.filter("raw IS NOT NULL").groupBy(*by, "file").agg(F.min_by("raw", "seq").alias("raw"), (digests > 1).alias("conflict"))


def check_caps(files: DataFrame, *by: str) -> DataFrame:
    """(``by``, files, bytes, over): how many descriptors there are, their size, and whether that is more than a document may come from."""
    out = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(F.octet_length("raw")).alias("bytes"))
    return out.withColumn("over", (F.col("files") > MAX_FILES) | (F.col("bytes") > MAX_BYTES))


def elements(files: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, nth, kind, path, name, number, type, label, client, server): the elements of descriptors, in the order in which they stand.

    Bytes that are no descriptor have one row of kind ``malformed``.
    """
    names = [c.split()[0] for c in _ELEMENT.split(", ")]
    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nth, rows = [], [], []
            for i, raw in enumerate(batch.column(0).to_pylist()):
                found = elements_of(raw) or [("malformed", [], "", 0, None, None, None, None)]
                rows += found
                at += [i] * len(found)
                nth += range(len(found))
            taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*taken, pa.array(nth, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names[1:], "nth", *names])

    carried = [*by, "file"]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carried)
    return files.select("raw", *carried).mapInArrow(run, f"{schema}, nth int, {_ELEMENT}")


def _references(parts: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, full_name): the full names of types that fields and methods name."""
    named = F.regexp_extract_all("type", F.lit(r"(\.[A-Za-z0-9_.]+)"), F.lit(1))
    of_fields = parts.filter("kind = 'field'").select(*by, "file", F.explode(named).alias("full_name"))
    of_methods = parts.filter("kind = 'method'").select(*by, "file", F.explode(F.array("type", "label")).alias("full_name")).filter("full_name LIKE '.%'")
    return of_fields.union(of_methods).distinct()


def defined(parts: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, full_name): the full names of the messages and enums that files define."""
    package = parts.filter("kind = 'file'").select(*by, "file", F.col("type").alias("package"))
    own = parts.filter("kind IN ('message', 'enum')").select(*by, "file", "path").join(package, [*by, "file"])
    return own.select(*by, "file", F.concat(F.lit("."), F.array_join(F.concat(F.when(F.col("package") == "", F.array().cast("array<string>")).otherwise(F.array("package")), F.col("path")), ".")).alias("full_name"))


def buildable(parts: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, round): the files that can be built, and in which round: all imports are, and every type it names is in itself, an import, or what imports publish.

    Files are peeled: each round takes those whose imports have all been taken. What is left lies on a cycle, behind one, or behind a file that is missing or broken.
    There are as many rounds as the longest chain of imports; each reads the files of the last round alone and is written out.
    """
    keys = [*by, "file"]
    good = parts.groupBy(*keys).agg((~F.bool_or(F.col("kind") == "malformed")).alias("good")).filter("good").select(*keys)
    imports = parts.filter("kind = 'import'").select(*keys, F.col("name").alias("dependency"), (F.col("label") != "").alias("public")).distinct().checkpoint()
    missing = imports.join(good.withColumnRenamed("file", "dependency"), [*by, "dependency"], "left_anti").select(*keys).distinct()
    open_links = _unlinked(parts, imports, *by)
    left = good.join(missing.union(open_links).distinct(), keys, "left_anti").join(imports.groupBy(*keys).agg(F.count("*").alias("wait")), keys, "left").select(*keys, F.coalesce("wait", F.lit(0)).alias("wait")).checkpoint()
    done = level = left.filter("wait = 0").select(*keys, F.lit(0).alias("round"))
    number = 0
    while not level.isEmpty():
        number += 1
        met = imports.join(level.select(*by, F.col("file").alias("dependency")), [*by, "dependency"]).groupBy(*keys).agg(F.count("*").alias("met"))
        left = left.filter("wait > 0").join(met, keys, "left").select(*keys, (F.col("wait") - F.coalesce("met", F.lit(0))).alias("wait")).checkpoint()
        level = left.filter("wait = 0").select(*keys, F.lit(number).alias("round"))
        done = done.union(level)
    return done


def _unlinked(parts: DataFrame, imports: DataFrame, *by: str) -> DataFrame:
    """(``by``, file): the files that name a type which neither they nor their imports (and what those publish) define."""
    keys = [*by, "file"]
    public = imports.filter("public").select(*by, F.col("file").alias("dependency"), F.col("dependency").alias("beyond"))
    reach = level = imports.select(*keys, "dependency").checkpoint()
    while not level.isEmpty():
        further = level.join(public, [*by, "dependency"]).select(*keys, F.col("beyond").alias("dependency")).distinct()
        level = further.join(reach, [*keys, "dependency"], "left_anti").checkpoint()
        reach = reach.union(level)
    own = defined(parts, *by)
    seen = own.union(reach.join(own.withColumnRenamed("file", "dependency"), [*by, "dependency"]).select(*keys, "full_name")).distinct()
    return _references(parts, *by).join(seen, [*keys, "full_name"], "left_anti").select(*keys).distinct()


def recovered_methods(named: DataFrame, parts: DataFrame | None, *by: str) -> DataFrame:
    """(``by``, package, service, method, input, output, client, server): services known by name alone, as far as descriptors do not define them.

    named: (``by``, seq, service, method, input, output, client, server). The first mention of a method decides, a leading dot of a name is no part of it; names and types that are
    no proto identifiers are dropped, and with their last method services. Types without a package are of the service's.
    """
    full = named.withColumn("service", F.regexp_replace("service", r"^\.", ""))
    if parts is not None:
        package = parts.filter("kind = 'file'").select(*by, "file", F.col("type").alias("package"))
        reflected = parts.filter("kind = 'service'").join(package, [*by, "file"]).select(*by, F.concat(F.when(F.col("package") == "", "").otherwise(F.concat("package", F.lit("."))), "name").alias("service"))
        full = full.join(reflected.distinct(), [*by, "service"], "left_anti")
    first = full.groupBy(*by, "service", "method").agg(F.min_by(F.struct("input", "output", "client", "server"), "seq").alias("d")).select(*by, "service", "method", "d.*")
    package = F.when(F.col("service").contains("."), F.regexp_replace("service", r"\.[^.]*\z", "")).otherwise("")

    def typed(c: str) -> Column:
        bare = F.regexp_replace(F.col(c), r"^\.", "")
        return F.when(bare.contains("."), bare).otherwise(F.concat(F.when(F.col("package") == "", "").otherwise(F.concat("package", F.lit("."))), bare))

    out = first.withColumn("package", package).withColumns({"input": typed("input"), "output": typed("output")})
    dotted = rf"^{IDENTIFIER}(\.{IDENTIFIER})*\z"
    fine = F.col("method").rlike(rf"^{IDENTIFIER}\z") & F.col("service").rlike(dotted) & F.col("input").rlike(dotted) & F.col("output").rlike(dotted)
    return out.filter(fine).select(*by, "package", F.substring_index("service", ".", -1).alias("service"), "method", "input", "output", F.coalesce("client", F.lit(False)).alias("client"), F.coalesce("server", F.lit(False)).alias("server"))


def synthesized(methods: DataFrame, parts: DataFrame | None, *by: str) -> DataFrame:
    """Elements, as :func:`elements` gives them, of one made-up file for each package: its services, and empty messages for the types that no descriptor defines.

    A type of another package is imported from that package's file, a type that a descriptor defines from the descriptor's.
    """
    keys = list(by)
    name_of = lambda package: F.when(package == "", F.lit(SYNTHETIC)).otherwise(F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit(f"/{SYNTHETIC}")))
    held = methods.withColumn("file", name_of(F.col("package")))
    types = held.select(*keys, "file", "package", F.explode(F.array("input", "output")).alias("full")).distinct()
    types = types.withColumns({"full_name": F.concat(F.lit("."), "full"), "of": F.when(F.col("full").contains("."), F.regexp_replace("full", r"\.[^.]*\z", "")).otherwise("")})
    if parts is not None:
        known = defined(parts, *by).groupBy(*by, "full_name").agg(F.min("file").alias("known"))
        types = types.join(known, [*by, "full_name"], "left")
    else:
        types = types.withColumn("known", F.lit(None).cast("string"))
    stubs = types.filter("known IS NULL").select(*keys, name_of(F.col("of")).alias("file"), F.col("of").alias("package"), F.substring_index("full", ".", -1).alias("name")).distinct()
    imports = types.select(*keys, "file", F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("of") != F.col("package"), name_of(F.col("of"))).alias("name")).filter("name IS NOT NULL").distinct()
    none, no = F.array().cast("array<string>"), F.lit(None)
    row = lambda kind, path, name, type_, label, client=no, server=no: [F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), F.lit(0).alias("number"), type_.cast("string").alias("type"), label.cast("string").alias("label"), client.cast("boolean").alias("client"), server.cast("boolean").alias("server")]
    files = held.select(*keys, "file", "package").union(stubs.select(*keys, "file", "package")).distinct()
    out = files.select(*keys, "file", *row("file", none, F.col("file"), F.col("package"), F.lit("proto3")))
    out = out.union(imports.select(*keys, "file", *row("import", none, F.col("name"), no, F.lit(""))))
    out = out.union(stubs.select(*keys, "file", *row("message", F.array("name"), F.col("name"), no, no)))
    out = out.union(held.select(*keys, "file", "service").distinct().select(*keys, "file", *row("service", F.array("service"), F.col("service"), no, no)))
    return out.union(held.select(*keys, "file", *row("method", F.array("service"), F.col("method"), F.concat(F.lit("."), "input"), F.concat(F.lit("."), "output"), F.col("client"), F.col("server"))))


def render_files(parts: DataFrame, *by: str) -> DataFrame:
    """(``by``, file, proto): each file as proto3 text; messages, then enums, then services, each in the order of names, fields and values by number.

    Lines carry a key (for each level: kind, number and name) and are put in order by it; the line that closes a block sorts behind all in it. Types of the file's own package are
    named without it. A file's text gathers its own lines.
    """
    keys = [*by, "file"]
    package = parts.filter("kind = 'file'").select(*keys, F.col("type").alias("package"))
    held = parts.filter("kind <> 'malformed'").join(package, keys)
    short = lambda c: F.regexp_replace(F.when((F.col("package") != "") & c.contains(F.concat(F.lit("."), "package", F.lit("."))), F.replace(c, F.concat(F.lit("."), "package", F.lit(".")), F.lit(""))).otherwise(c), r"(^|[<, ])\.", "$1")
    step = lambda rank, number, name: F.struct(F.lit(rank).alias("rank"), number.cast("int").alias("number"), name.alias("name"))
    zero, text = F.lit(0), F.lit("")
    # ranks within a level: 0 opens, 1 fields and values, 2 messages, 3 enums, 4 services, 9 closes
    nested = F.transform("path", lambda n, i: F.struct(F.when((i == F.size("path") - 1) & F.col("kind").isin("enum", "value"), 3).when(F.col("kind").isin("service", "method"), 4).otherwise(2).alias("rank"), F.lit(0).alias("number"), n.alias("name")))
    depth = F.size("path")
    indent = lambda n: F.repeat(F.lit("  "), n)
    line = lambda key, value: F.struct(key.alias("key"), value.alias("line"))
    block = F.array(
        line(nested, F.concat(F.when(depth == 1, "\n").otherwise(""), indent(depth - 1), F.col("kind"), F.lit(" "), "name", F.lit(" {"))),
        line(F.concat(nested, F.array(step(9, zero, text))), F.concat(indent(depth - 1), F.lit("}"))),
    )
    oneof = F.col("oneof").isNotNull()
    field = line(F.concat(nested, F.array(step(1, F.col("place"), F.coalesce("oneof", text)), step(1, F.col("number"), F.col("name")))), F.concat(indent(depth + F.when(oneof, 1).otherwise(0)), "label", short(F.col("type")), F.lit(" "), "name", F.lit(" = "), F.col("number").cast("string"), F.lit(";")))
    value = line(F.concat(nested, F.array(step(1, F.col("number"), F.col("name")))), F.concat(indent(depth), "name", F.lit(" = "), F.col("number").cast("string"), F.lit(";")))
    stream = lambda c: F.when(F.col(c), "stream ").otherwise("")
    method = line(F.concat(nested, F.array(step(1, zero, F.col("name")))), F.concat(indent(depth), F.lit("rpc "), "name", F.lit(" ( "), stream("client"), short(F.col("type")), F.lit(" ) returns ( "), stream("server"), short(F.col("label")), F.lit(" );")))
    head = F.array(
        line(F.array(step(0, zero, text)), F.format_string('syntax = "%s";', "label")),
        line(F.array(step(0, F.lit(1), text)), F.when(F.col("type") != "", F.format_string("\npackage %s;", "type")).otherwise("")),
    )
    imported = line(F.array(step(1, zero, F.col("name"))), F.format_string('import %s"%s";', "label", "name"))
    oneofs = held.filter("kind = 'oneof'").select(*keys, "path", F.col("number"), F.col("name").alias("oneof"), F.col("type").alias("name"))
    first = oneofs.groupBy(*keys, "path", "oneof").agg(F.min("number").alias("first"))
    members = oneofs.join(first, [*keys, "path", "oneof"]).select(*keys, "path", "number", "name", "oneof", "first")
    fields = held.filter("kind = 'field'").join(members, [*keys, "path", "number", "name"], "left").withColumn("place", F.coalesce("first", "number"))
    of_fields = fields.select(*keys, field.alias("l"))
    around = first.select(*keys, F.col("path"), "oneof", "first", F.lit("field").alias("kind")).withColumn("package", F.lit(""))
    opened = line(F.concat(nested, F.array(step(1, F.col("first"), F.col("oneof")))), F.concat(indent(depth), F.lit("oneof "), "oneof", F.lit(" {")))
    closed = line(F.concat(nested, F.array(step(1, F.col("first"), F.col("oneof")), step(9, zero, text))), F.concat(indent(depth), F.lit("}")))
    rows = of_fields.union(around.select(*keys, F.explode(F.array(opened, closed)).alias("l")))
    for kind, lines in (("file", head), ("import", F.array(imported)), ("message", block), ("enum", block), ("service", block), ("value", F.array(value)), ("method", F.array(method))):
        rows = rows.union(held.filter(F.col("kind") == kind).select(*keys, F.explode(lines).alias("l")))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("l"))
    return listed.select(*keys, F.concat(F.array_join(F.filter(F.transform("l", lambda x: x["line"]), lambda x: x != ""), "\n"), F.lit("\n")).alias("proto"))


def generate_proto(recorded: DataFrame, named: DataFrame, *by: str, capped: bool = True) -> DataFrame:
    """(``by``, proto, error): one document for each value of ``by`` (at least one column), or why there is none.

    recorded: (``by``, seq, file, raw), descriptors that endpoints gave; named: see :func:`recovered_methods`. Files of one name with different bytes, bytes that are no descriptor, and sets beyond
    :func:`check_caps` (unless ``capped`` is false, as for recorded tables, which no server can inflate) are errors of their group. Files that cannot be built are named in a warning; well-known ones are not printed. A group without descriptors and names has no row.
    """
    keys = list(by)
    files = union_files(recorded, *by).checkpoint()
    parts = elements(files, *by).drop("nth").checkpoint()
    conflict = files.filter("conflict").groupBy(*keys).agg(F.concat(F.lit("conflicting file descriptors: "), F.array_join(F.array_sort(F.collect_list("file")), ", ")).alias("conflict"))
    broken = parts.filter("kind = 'malformed'").groupBy(*keys).agg(F.concat(F.lit("malformed file descriptors: "), F.array_join(F.array_sort(F.collect_list("file")), ", ")).alias("broken"))
    caps = check_caps(files, *by).filter(F.col("over") & F.lit(capped)).select(*keys, F.lit("too many or too large file descriptors").alias("caps"))
    built = buildable(parts, *by).select(*keys, "file")
    good = parts.join(built, [*keys, "file"])
    made = synthesized(recovered_methods(named, good, *by), good, *by)
    shown = render_files(good.unionByName(made), *by).filter(~F.startswith("file", F.lit(WELL_KNOWN)))
    texts = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "proto"))), lambda x: x["proto"]), "\n// ---\n\n").alias("text"))
    skipped = files.select(*keys, "file").join(built, [*keys, "file"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(F.regexp_replace("file", r"[\p{Cntrl}\p{Cf}  ]", ""))).alias("skipped"))
    warning = F.when(F.size("skipped") > 0, F.concat(F.format_string("// WARNING: %d .proto file(s) omitted due to unresolved imports or link errors:\n", F.size("skipped")), F.array_join(F.transform("skipped", lambda s: F.concat(F.lit("//   - "), s)), "\n"), F.lit("\n\n"))).otherwise("")
    groups = files.select(*keys).union(made.select(*keys)).distinct()
    out = groups
    for side in (conflict, broken, caps, skipped, texts):
        out = out.join(side, keys, "left")
    error = F.coalesce("conflict", "broken", "caps", F.when(F.col("text").isNull(), "no file of the group's own can be built"))
    return out.select(*keys, F.when(error.isNull(), F.concat(warning, "text")).alias("proto"), error.alias("error"))
