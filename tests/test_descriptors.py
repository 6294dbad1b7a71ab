"""File descriptors: elements, union, graph, made-up services and text."""

from quillspan.operators import descriptors


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _enc(*fields):
    """(number, value) pairs as protobuf bytes; strings and bytes with their length, numbers as varints."""
    out = b""
    for field, value in fields:
        if isinstance(value, int):
            out += _varint(field << 3) + _varint(value & (1 << 64) - 1)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += _varint(field << 3 | 2) + _varint(len(data)) + data
    return out


def _file(name, package="", imports=(), public=(), messages=(), extra=()):
    return _enc((1, name), *([(2, package)] if package else []), *((3, i) for i in imports), *((10, p) for p in public), *((4, m) for m in messages), *extra, (12, "proto3"))


ENTRY = _enc((1, "CountsEntry"), (2, _enc((1, "key"), (3, 1), (4, 1), (5, 9))), (2, _enc((1, "value"), (3, 2), (4, 1), (5, 5))), (7, _enc((7, 1))))
BIG = _enc(
    (1, "Big"), (2, _enc((1, "z"), (3, 9), (4, 1), (5, 9), (9, 0))), (2, _enc((1, "a"), (3, 4), (4, 1), (5, 11), (6, ".p.Big.In"), (9, 0))), (2, _enc((1, "counts"), (3, 5), (4, 3), (5, 11), (6, ".p.Big.CountsEntry"))),
    (2, _enc((1, "maybe"), (3, 6), (4, 1), (5, 13), (9, 1), (17, 1))), (2, _enc((1, "kind"), (3, 1), (4, 1), (5, 14), (6, ".p.Big.Kind"))), (3, ENTRY), (3, _enc((1, "In"))), (4, _enc((1, "Kind"), (2, _enc((1, "NO"), (2, 0))), (2, _enc((1, "MINUS"), (2, -1))))), (8, _enc((1, "way"))), (8, _enc((1, "_maybe"))),
)
TEXT = """syntax = "proto3";

package p;

message Big {
  Kind kind = 1;
  oneof way {
    Big.In a = 4;
    string z = 9;
  }
  map<string, int32> counts = 5;
  optional uint32 maybe = 6;
  message In {
  }
  enum Kind {
    MINUS = -1;
    NO = 0;
  }
}
"""


def _recorded(spark, *files, target="t"):
    return spark.createDataFrame([(target, i, n, r) for i, (n, r) in enumerate(files)], "app string, seq long, file string, raw binary")


def _parts(spark, *files):
    return descriptors.elements(descriptors.union_files(_recorded(spark, *files), "app"), "app").drop("nth")


def test_text_of_a_file(spark):
    shown = descriptors.render_files(_parts(spark, ("b.proto", _file("b.proto", "p", messages=[BIG]))), "app").collect()[0]["proto"]
    assert shown == TEXT.replace("  Kind kind", "  Big.Kind kind")


def test_graph_leaves_out_cycles_holes_and_loose_ends(spark):
    message = lambda name, kind=None: _enc((1, name), *([(2, _enc((1, "f"), (3, 1), (4, 1), (5, 11), (6, kind)))] if kind else []))
    files = [
        ("a", _file("a", "p", messages=[message("A")])),
        ("b", _file("b", "p", ["a"], [0], [message("B", ".p.A")])),
        ("c", _file("c", "p", ["b"], messages=[message("C", ".p.A")])),  # a is published by b
        ("d", _file("d", "p", ["c"], messages=[message("D", ".p.A")])),  # c publishes nothing
        ("e", _file("e", "p", ["f"])),
        ("f", _file("f", "p", ["e"])),
        ("g", _file("g", "p", ["e"])),
        ("h", _file("h", "p", ["gone"])),
        ("i", _file("i", "p", ["c", "a"])),
        ("j", b"\xff"),
        ("k", _file("k", "p", ["j"])),
    ]
    assert {r["file"]: r["round"] for r in descriptors.buildable(_parts(spark, *files), "app").collect()} == {"a": 0, "b": 1, "c": 2, "i": 3}


def test_union_conflict_caps_and_errors(spark, monkeypatch):
    same, other = _file("a", "p"), _file("a", "q")
    recorded = _recorded(spark, ("a", same), ("a", same)).union(_recorded(spark, ("a", same), ("a", other), target="u")).union(_recorded(spark, ("m", b"\x08"), target="v"))
    named = spark.createDataFrame([("w", 1, "S", "M", "I", "O", True, None), ("w", 0, ".S", "M", "I2", "O", False, True), ("x", 0, "1S", "M", "I", "O", None, None)], "app string, seq long, service string, method string, input string, output string, client boolean, server boolean")
    made = {r["app"]: (r["proto"], r["error"]) for r in descriptors.generate_proto(recorded, named, "app").collect()}
    assert made["t"] == ('syntax = "proto3";\n\npackage p;\n', None)
    assert made["u"] == (None, "conflicting file descriptors: a") and made["v"] == (None, "malformed file descriptors: m")
    assert made["w"][0] == 'syntax = "proto3";\n\nmessage I2 {\n}\n\nmessage O {\n}\n\nservice S {\n  rpc M ( I2 ) returns ( stream O );\n}\n'
    assert set(made) == {"t", "u", "v", "w"}
    monkeypatch.setattr(descriptors, "MAX_BYTES", 3)
    assert descriptors.generate_proto(recorded, named, "app").filter("app = 't'").collect()[0]["error"] == "too many or too large file descriptors"


def test_tables_of_many_descriptors_have_their_document(spark, monkeypatch, tmp_path):
    from quillspan.plans import protos

    monkeypatch.setattr(descriptors, "MAX_FILES", 3)
    spark.range(1, 9).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    made = {r["target"]: r for r in protos.proto_generated(spark, str(tmp_path)).collect()}
    assert made["a"]["error"] is None and (made["a"]["files"], made["a"]["skipped"], made["a"]["services"], made["a"]["messages"]) == (10, 3, 9, 15)  # as its SQL has it
    assert made["b"]["error"] == "conflicting file descriptors: f5.proto"
