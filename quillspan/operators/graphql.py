"""GraphQL schemas from recorded calls: fields, arguments and types of what was asked for and what came back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from email import message_from_bytes
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.operators.specs import SCALARS, like_types

_TOKEN = regex.compile(r'"""(?:\\"""|(?s:.))*?"""|"(?:\\.|[^"\\\n])*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|\.\.\.|[!$&()\[\]{}:=@|]')
_NOISE = regex.compile(r'("""(?:\\"""|(?s:.))*?"""|"(?:\\.|[^"\\\n])*")|#[^\n]*')
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}
#: Depth of selections; a document that is deeper is no document.
MAX_DEPTH = 64


class _Document:
    """A recursive reader of one executable document; ValueError for what is none."""

    def __init__(self, text: str) -> None:
        self.tokens = _TOKEN.findall(_NOISE.sub(lambda m: m[1] or " ", text))
        self.at = 0
        self.operations: list[dict] = []
        self.fragments: dict[str, tuple[str, list]] = {}
        while self.at < len(self.tokens):
            self._definition()

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _take(self, wanted: str = "") -> str:
        token = self._peek()
        if not token or wanted and token != wanted:
            raise ValueError(f"{wanted or 'more'} expected")
        self.at += 1
        return token

    def _definition(self) -> None:
        kind = self._take() if self._peek() != "{" else "query"
        if kind == "fragment":
            name = self._take()
            self._take("on")
            on = self._take()
            self._directives()
            self.fragments[name] = (on, self._selections(0))
            return
        if kind not in ROOTS:
            raise ValueError(kind)
        name = self._take() if self._peek() not in ("{", "(", "@") else ""
        variables = {}
        if self._peek() == "(":
            self._take("(")
            while self._peek() != ")":
                self._take("$")
                variable = self._take()
                self._take(":")
                variables[variable] = self._type()
                if self._peek() == "=":
                    self._take()
                    self._value()
                self._directives()
            self._take(")")
        self._directives()
        self.operations.append({"kind": kind, "name": name, "variables": variables, "selections": self._selections(0)})

    def _type(self) -> str:
        if self._peek() == "[":
            self._take()
            inner = f"[{self._type()}]"
            self._take("]")
        else:
            inner = self._take()
        return inner + (self._take() if self._peek() == "!" else "")

    def _value(self) -> tuple:
        """(kind, inner): a variable's name, the pairs of an object, the values of a list, or nothing."""
        token = self._take()
        if token == "$":
            return "variable", self._take()
        if token == "[":
            inner = []
            while self._peek() != "]":
                inner.append(self._value())
            self._take("]")
            return "list", inner
        if token == "{":
            pairs = []
            while self._peek() != "}":
                name = self._take()
                self._take(":")
                pairs.append((name, self._value()))
            self._take("}")
            return "object", pairs
        if token[0] == '"':
            return "String", None
        if token[0].isdigit() or token[0] == "-":
            return ("Int" if token.lstrip("-").isdigit() else "Float"), None
        return ("Boolean" if token in ("true", "false") else "name"), None

    def _arguments(self) -> list[tuple[str, tuple]]:
        out = []
        if self._peek() == "(":
            self._take()
            while self._peek() != ")":
                name = self._take()
                self._take(":")
                out.append((name, self._value()))
            self._take(")")
        return out

    def _directives(self) -> None:
        while self._peek() == "@":
            self._take()
            self._take()
            self._arguments()

    def _selections(self, depth: int) -> list[Selection]:
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        out = []
        self._take("{")
        while self._peek() != "}":
            first = self._take()
            if first == "...":
                if self._peek() not in ("on", "{", "@"):
                    out.append(Selection("spread", self._take()))
                    self._directives()
                    continue
                on = (self._take(), self._take())[1] if self._peek() == "on" else ""
                self._directives()
                out.append(Selection("inline", on, inner=self._selections(depth + 1)))
                continue
            key = first
            if self._peek() == ":":
                self._take()
                first = self._take()
            given = self._arguments()
            self._directives()
            out.append(Selection("field", first, key, given, self._selections(depth + 1) if self._peek() == "{" else []))
        self._take("}")
        if not out:
            raise ValueError("a selection expected")
        return out

    def flat(self, selections: list[Selection], using: tuple[str, ...] = ()) -> Iterator[Selection]:
        """The fields of a selection set, those of fragments in their place."""
        for s in selections:
            if s.kind == "field":
                yield s
            elif s.kind == "inline":
                yield from self.flat(s.inner, using)
            elif s.name in self.fragments and s.name not in using:
                yield from self.flat(self.fragments[s.name][1], (*using, s.name))

    def nodes(self, selections: list[Selection]) -> dict[str, Node]:
        """The fields of a selection set by name, what is selected twice put together; fields of the schema itself are left out."""
        out: dict[str, Node] = {}
        for s in self.flat(selections):
            if not s.name.startswith("__"):
                node = out.setdefault(s.name, Node(s.name))
                node.keys += [s.key] if s.key not in node.keys else []
                node.args = dict(s.args) | node.args
                node.inner += s.inner
        return out

    def members(self, selections: list[Selection], using: tuple[str, ...] = ()) -> dict[str, list[Selection]]:
        """What is selected of each type that a selection set tells apart: by fragments on it, named or not."""
        out: dict[str, list[Selection]] = {}
        for s in selections:
            if s.kind == "inline" and s.name:
                out.setdefault(s.name, []).extend(s.inner)
            elif s.kind == "spread" and s.name in self.fragments and s.name not in using:
                on, inner = self.fragments[s.name]
                within = self.members(inner, (*using, s.name))
                for name, some in within.items():
                    out.setdefault(name, []).extend(some)
                own = direct(inner) if within else inner
                if any(not f.name.startswith("__") for f in self.flat(own, (*using, s.name))) or within and own:
                    out.setdefault(on, []).extend(own)
        return out


@dataclass
class Selection:
    kind: str
    name: str
    key: str = ""
    args: list[tuple[str, tuple]] = field(default_factory=list)
    inner: list[Selection] = field(default_factory=list)


@dataclass
class Node:
    """A field with all that is selected of it: response keys, arguments, and selections."""

    name: str
    keys: list[str] = field(default_factory=list)
    args: dict[str, tuple] = field(default_factory=dict)
    inner: list[Selection] = field(default_factory=list)


def direct(selections: list[Selection]) -> list[Selection]:
    return [s for s in selections if s.kind == "field"]


def _upper(name: str) -> str:
    return name[:1].upper() + name[1:]


def kind_of(value: object) -> str:
    """The type that a JSON value says; whole numbers are Int, and what says nothing is String."""
    if isinstance(value, bool):
        return "Boolean"
    if isinstance(value, (int, float)):
        return "Int" if value == value and abs(value) != float("inf") and value == int(value) else "Float"
    return "String"


def _written(value: tuple) -> str:
    """The type that a value in a document says."""
    kind, inner = value
    if kind == "list":
        return f"[{_written(inner[0]) if inner else 'String'}]"
    return kind if kind in ("Int", "Float", "Boolean") else "String"


def _elements(values: list) -> dict | None:
    """The objects of a list as one, the first value of each key."""
    out: dict = {}
    for v in values:
        if isinstance(v, dict):
            out = v | out
    return out or None


def _richer(values: list) -> object:
    """Of a field's values under its several keys the first, unless a later one holds more."""
    best = values[0]
    for v in values[1:]:
        size = lambda x: (2, len(x)) if isinstance(x, (dict, list)) else (0, 0) if x is None else (1, 0)
        if size(v)[0] == 2 and (type(v) is not type(best) or len(v) > len(best)) or best is None and v is not None:
            best = v
    return best


class Call:
    """A recorded call: its document, variables and response data; ``None`` where there is no call."""

    def __init__(self, url: str, content_type: str, body: bytes, answer: bytes) -> None:
        said = _sent(body) or _in_url(url) or _in_form(body, content_type)
        if said is None:
            raise ValueError("no call")
        self.document = _Document(said["query"])
        if not self.document.operations:
            raise ValueError("no operation")
        self.operation = self.document.operations[0]
        self.variables = said.get("variables") if isinstance(said.get("variables"), dict) else {}
        try:
            told = json.loads(answer)
        except (ValueError, RecursionError):
            told = None
        data = told.get("data") if isinstance(told, dict) else None
        self.data = data if isinstance(data, dict) else {}
        self.roots: dict[str, Node] = {}
        for s in self.document.flat(self.operation["selections"]):
            node = self.roots.setdefault(s.name, Node(s.name))
            node.keys += [s.key] if not node.keys else []
            node.args = dict(s.args) | node.args
            node.inner += s.inner

    def key(self, root: Node) -> str:
        """What makes a root field's calls alike: operation, names, and the fields selected, in whatever order."""
        chosen = sorted(s.name for s in self.document.flat(root.inner) if not s.name.startswith("__"))
        return ":".join((self.operation["kind"], root.name, self.operation["name"], ",".join(chosen)))

    def facts(self, root: Node) -> list[dict]:
        """What a root field says: see :func:`observe`."""
        self.out: list[dict] = []
        value = _richer([self.data[k] for k in (root.name, *root.keys) if k in self.data][:1] or [None])
        listed, whole = isinstance(value, list), value
        if listed:
            whole = value[0] if value and isinstance(value[0], dict) else None
        owner, prefix, found = ROOTS[self.operation["kind"]], _upper(root.name), f"{_upper(root.name)}Response"
        members, own = self.document.members(root.inner), direct(root.inner)
        if members:
            found = f"{prefix}Result"
            self._members(found, members, own, (_elements(value) if listed else None) or (whole if isinstance(whole, dict) else None))
        elif nodes := self.document.nodes(root.inner):
            if not isinstance(whole, dict) and not listed and isinstance(value, (str, bool, int, float)):
                found = kind_of(value)
            else:
                self._fact("type", found)
                self._fields(nodes, whole if isinstance(whole, dict) else None, prefix, found)
        elif isinstance(value, (str, bool, int, float)):
            found = kind_of(value)
        else:
            self._fact("type", found)
            for name, inner in (whole if isinstance(whole, dict) else {}).items():
                if not name.startswith("__"):
                    self._fact("field", found, name, of=kind_of(inner))
        listed = listed and (bool(members) or bool(value) and isinstance(value[0], dict) or not root.inner)
        self._fact("root", owner, root.name, "list" if listed else "", found)
        self._arguments("rootarg", owner, root.name, root.args, prefix)
        self._inputs()
        return self.out

    def _fact(self, what: str, owner: str, field: str = "", name: str = "", of: str = "") -> None:
        self.out.append({"what": what, "owner": owner, "field": field, "name": name, "of": of})

    def _members(self, union: str, members: dict[str, list[Selection]], own: list[Selection], value: dict | None) -> None:
        for name, chosen in members.items():
            self._fact("member", union, name=name)
            self._fields(self.document.nodes([*chosen, *own]), value, name, name)

    def _fields(self, nodes: dict[str, Node], value: dict | None, prefix: str, owner: str) -> None:
        for node in nodes.values():
            below = f"{prefix}_{_upper(node.name)}"
            if node.args:
                self._arguments("arg", owner, node.name, node.args, below)
            held = [value[k] for k in dict.fromkeys((node.name, *node.keys)) if k in value] if value else []
            came = _richer(held) if held else None
            listed = isinstance(came, list)
            inner = _elements(came) if listed else came if isinstance(came, dict) else None
            wrap = lambda t, listed=listed: f"[{t}]" if listed else t
            if members := self.document.members(node.inner):
                self._members(f"{below}Result", members, direct(node.inner), inner)
                self._fact("field", owner, node.name, of=wrap(f"{below}Result"))
            elif below_nodes := self.document.nodes(node.inner):
                self._fields(below_nodes, inner, below, f"{below}Response")
                self._fact("field", owner, node.name, of=wrap(f"{below}Response"))
            else:
                self._fact("field", owner, node.name, of=kind_of(came))

    def _arguments(self, what: str, owner: str, field: str, args: dict[str, tuple], prefix: str) -> None:
        for name, (kind, inner) in args.items():
            if kind == "variable" and inner in self.operation["variables"]:
                of = self.operation["variables"][inner]
            elif kind == "variable" and what == "rootarg" and inner in self.variables:
                of = kind_of(self.variables[inner])
            elif kind == "object":
                of = f"{prefix}_{_upper(name)}Input"
                self._object(of, inner)
            else:
                of = _written((kind, inner))
            self._fact(what, owner, field, name, of)

    def _object(self, owner: str, pairs: list[tuple[str, tuple]]) -> None:
        self._fact("input", owner)
        for name, (kind, inner) in pairs:
            if kind == "object":
                of = f"{owner}_{_upper(name)}"
                self._object(of, inner)
            else:
                of = self.operation["variables"].get(inner, "String") if kind == "variable" else _written((kind, inner))
            self._fact("input", owner, name, of=of)

    def _inputs(self) -> None:
        """Objects among the variables by the types that they are declared to have, and the texts of other types, which may be enums."""
        for name, declared in self.operation["variables"].items():
            base, value = declared.strip("[]!"), self.variables.get(name)
            if base in SCALARS or value is None:
                continue
            some = value if isinstance(value, list) else [value]
            if some and isinstance(some[0], dict):
                self._sent(base, some[0])
            for text in some:
                if isinstance(text, str):
                    self._fact("enum", base, name=text)

    def _sent(self, owner: str, value: dict) -> None:
        self._fact("input", owner)
        for name, inner in value.items():
            first = inner[0] if isinstance(inner, list) and inner else inner
            if isinstance(first, dict):
                of = f"{owner}_{_upper(name)}"
                self._sent(of, first)
            else:
                of = "String" if isinstance(first, list) else kind_of(first)
            self._fact("input", owner, name, of=f"[{of}]" if isinstance(inner, list) else of)


def _sent(body: bytes) -> dict | None:
    try:
        said = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return said if isinstance(said, dict) and isinstance(said.get("query"), str) and said["query"] else None


def _in_url(url: str) -> dict | None:
    """A call in a URL's query."""
    pairs = parse_qs(urlsplit(url).query)
    if not pairs.get("query"):
        return None
    try:
        variables = json.loads(pairs.get("variables", ["{}"])[0])
    except (ValueError, RecursionError):
        variables = {}
    return {"query": pairs["query"][0], "variables": variables}


def _in_form(body: bytes, content_type: str) -> dict | None:
    """A call in the part ``operations`` of a multipart form."""
    if "multipart" not in content_type.lower():
        return None
    form = message_from_bytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    for part in form.get_payload() if form.is_multipart() else []:
        if part.get_param("name", header="content-disposition") == "operations":
            return _sent(part.get_payload(decode=True) or b"")
    return None


_FACTS = "what string, owner string, field string, name string, of string"


def _calls(exchanges: DataFrame) -> DataFrame:
    kind = H.header(F.col("headers"), "Content-Type") if "headers" in exchanges.columns else F.lit("")
    url = F.coalesce("url", F.lit("")) if "url" in exchanges.columns else F.lit("")
    return exchanges.select("seq", url.alias("url"), kind.alias("kind"), F.coalesce("body", F.lit(b"")).alias("body"), F.coalesce("response.body", F.lit(b"")).alias("answer"))


def _read(columns: list[pa.Array]) -> Iterator[Call | None]:
    for url, kind, body, answer in zip(*(c.to_pylist() for c in columns), strict=True):
        try:
            yield Call(url, kind, body, answer)
        except (ValueError, TypeError, AttributeError, RecursionError):
            yield None


def observe(exchanges: DataFrame) -> DataFrame:
    """(seq, pos, what, owner, field, name, of): what recorded calls say of a schema, from the first call of each kind.

    Calls are JSON bodies with a document, else the URL's ``query``, else the part ``operations`` of a form; of a document the first operation counts. Calls of one
    operation, name, root field and selection are alike, in whatever order they select: the first speaks for all, so that answers are read of few.
    ``what`` is a type, a field of one (``of`` its type), an argument of a root field or another, a root field (``name``: list), a member of a union, a field of
    an input, or a value of what may be an enum. What cannot be read says nothing.
    """
    calls = _calls(exchanges)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[c.key(r) for r in c.roots.values()] if c else [] for c in _read([batch.column(i) for i in (1, 2, 3)] + [pa.array([b""] * len(batch))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["seq", "keys"])

    alike = calls.select("seq", "url", "kind", "body").mapInArrow(keys, "seq long, keys array<string>").select("seq", F.explode("keys").alias("key"))
    first = alike.groupBy("key").agg(F.min("seq").alias("seq")).groupBy("seq").agg(F.collect_list("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(c.split()[0], pa.string()) for c in _FACTS.split(", ")]))
        for batch in batches:
            wanted = batch.column(5).to_pylist()
            found = [[f for r in c.roots.values() if c.key(r) in some for f in c.facts(r)] if c else [] for c, some in zip(_read(batch.columns[1:5]), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["seq", "facts"])

    schema = f"seq long, facts array<struct<{', '.join(c.replace(' ', ':') for c in _FACTS.split(', '))}>>"
    told = calls.join(first, "seq").select("seq", "url", "kind", "body", "answer", "keys").mapInArrow(run, schema)
    return told.select("seq", F.posexplode("facts").alias("pos", "f")).select("seq", "pos", "f.*")


def base(of: Column) -> Column:
    """A type without lists and exclamation marks."""
    return F.regexp_replace(of, r"[\[\]!]", "")


def most_specific(of: Column, order: Column) -> Column:
    """Of the types that are said of one thing the first by ``order`` that is more than a text, else the first; with an exclamation mark if it is also said with one.

    A mergeable aggregate: tasks combine what they have before the shuffle.
    """
    best = F.min_by(of, F.struct((base(of) == "String").alias("text"), order.alias("order")))
    sure = F.collect_set(F.when(F.endswith(of, F.lit("!")), F.rtrim(of, F.lit("!"))))
    return F.when(F.array_contains(sure, best), F.concat(best, F.lit("!"))).otherwise(best)


def schema(facts: DataFrame) -> dict[str, DataFrame]:
    """The inferred schema as tables, from :func:`observe`.

    roots (owner, field, of, args), fields (owner, field, of, args), types (owner), inputs (owner, field, of), unions (owner, members), others (owner, values: null for scalars).

    Of a field the most specific type counts; like types (three fields with scalar types in common, and half of all) tell each other what they know of common fields. Where a
    union and a plain type were seen for one place, the union stays, and its first member takes the plain type's fields. Names that are used but nowhere told are enums,
    if their values were seen, else scalars.
    """
    facts = facts.checkpoint()
    at = F.struct("seq", "pos")
    of = lambda what: facts.filter(F.col("what") == what)
    unions = of("member").groupBy("owner", "name").agg(F.min(at).alias("at")).groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda m: m["name"]).alias("members")).checkpoint()
    plain = F.concat(F.regexp_replace("owner", r"Result\z", ""), F.lit("Response"))
    replaced = unions.select(plain.alias("plain"), F.col("owner").alias("union"), F.col("members")[0].alias("first"), F.array_contains("members", plain).alias("own")).filter("NOT own").drop("own")

    def renamed(rows: DataFrame) -> DataFrame:
        """Rows with unions instead of the plain types that they replace."""
        found = rows.join(replaced.select(F.col("plain").alias("of_base"), "union"), base(F.col("of")) == F.col("of_base"), "left")
        return found.withColumn("of", F.when(F.col("union").isNotNull(), F.replace("of", "of_base", "union")).otherwise(F.col("of"))).drop("of_base", "union")

    fields = of("field").groupBy("owner", "field").agg(most_specific(F.col("of"), at).alias("of"))
    moved = fields.join(replaced, F.col("owner") == F.col("plain")).select(F.col("first").alias("owner"), "field", "of").join(fields, ["owner", "field"], "left_anti").dropDuplicates(["owner", "field"])
    fields = fields.join(replaced.select(F.col("plain").alias("owner")), "owner", "left_anti").union(moved).join(unions.select("owner"), "owner", "left_anti")
    fields = unified(renamed(fields).checkpoint())
    args = facts.filter(F.col("what").isin("arg", "rootarg")).groupBy("owner", "field", "name").agg(most_specific(F.col("of"), at).alias("of")).checkpoint()
    listed = args.groupBy("owner", "field").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "of"))), ", ").alias("args"))
    shown = lambda rows: rows.join(listed, ["owner", "field"], "left").withColumn("args", F.coalesce("args", F.lit("")))
    roots = of("root").groupBy("owner", "field").agg(F.min_by("of", at).alias("of"), F.max("name").alias("listed"))
    roots = renamed(roots).withColumn("of", F.when(F.col("listed") != "", F.concat(F.lit("["), "of", F.lit("]"))).otherwise(F.col("of"))).drop("listed")
    types = facts.filter(F.col("what").isin("type", "arg")).select("owner").union(fields.select("owner")).distinct().join(replaced.select(F.col("plain").alias("owner")), "owner", "left_anti").join(unions.select("owner"), "owner", "left_anti")
    inputs = of("input").groupBy("owner", "field").agg(F.min_by("of", at).alias("of"))
    known = types.union(inputs.select("owner")).union(unions.select("owner")).union(facts.sparkSession.createDataFrame([(s,) for s in SCALARS], "owner string"))
    used = fields.select("of").union(args.select("of")).union(inputs.filter("field <> ''").select("of")).select(base(F.col("of")).alias("owner")).filter("owner <> ''").distinct()
    values = of("enum").groupBy("owner").agg(F.array_sort(F.collect_set("name")).alias("values"))
    others = used.join(known, "owner", "left_anti").join(values, "owner", "left")
    return {"roots": shown(roots), "fields": shown(fields), "types": types, "inputs": inputs, "unions": unions, "others": others}


def unified(fields: DataFrame) -> DataFrame:
    """Fields (owner, field, of) of which like types have told each other: a text takes the more specific type that a like type knows of the field."""
    plain = F.rtrim(F.col("of"), F.lit("!")).isin(*SCALARS)
    scalar = fields.filter(plain)
    enough = scalar.groupBy("owner").agg(F.count("*").alias("n")).filter("n >= 3").select("owner")
    alike = like_types(scalar.join(enough, "owner").select(F.col("owner").alias("type"), "field")).withColumnRenamed("type", "owner")
    best = scalar.join(alike, "owner").groupBy("representative", "field").agg(most_specific(F.col("of"), F.col("owner")).alias("best"))
    told = fields.join(alike, "owner", "left").join(best, ["representative", "field"], "left")
    better = plain & ((base(F.col("of")) == "String") & (base(F.col("best")) != "String") | (F.col("best") == F.concat("of", F.lit("!"))))
    return told.select("owner", "field", F.when(F.coalesce(better, F.lit(False)), F.col("best")).otherwise(F.col("of")).alias("of"))


def render(parts: dict[str, DataFrame]) -> DataFrame:
    """(place, name, sdl): the blocks of a schema in order: roots, types, inputs, unions, then enums and scalars, each by name."""
    line = F.concat(F.lit("  "), "field", F.when(F.col("args") == "", "").otherwise(F.concat(F.lit("("), "args", F.lit(")"))), F.lit(": "), "of", F.lit("\n"))
    block = lambda rows, word, place: rows.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda x: x["line"]), "").alias("lines")).select(place.alias("place"), F.col("owner").alias("name"), F.concat(F.lit(f"{word} "), "owner", F.lit(" {\n"), "lines", F.lit("}\n")).alias("sdl"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(ROOTS.values()) for x in (name, i)]), F.col("owner"))
    bare = parts["types"].join(parts["fields"].select("owner"), "owner", "left_anti").select(F.lit(3).alias("place"), F.col("owner").alias("name"), F.concat(F.lit("type "), "owner", F.lit(" {\n}\n")).alias("sdl"))
    inputs = parts["inputs"].withColumn("args", F.lit(""))
    told = inputs.filter("field <> ''")
    none = inputs.select("owner").distinct().join(told.select("owner"), "owner", "left_anti").select(F.lit(4).alias("place"), F.col("owner").alias("name"), F.concat(F.lit("input "), "owner", F.lit(" {\n}\n")).alias("sdl"))
    unions = parts["unions"].select(F.lit(5).alias("place"), F.col("owner").alias("name"), F.concat(F.lit("union "), "owner", F.lit(" = "), F.array_join("members", " | "), F.lit("\n")).alias("sdl"))
    values = F.array_join(F.transform("values", lambda v: F.concat(F.lit("  "), v, F.lit("\n"))), "")
    others = parts["others"].select(F.lit(6).alias("place"), F.col("owner").alias("name"), F.when(F.col("values").isNotNull(), F.concat(F.lit("enum "), "owner", F.lit(" {\n"), values, F.lit("}\n"))).otherwise(F.concat(F.lit("scalar "), "owner", F.lit("\n"))).alias("sdl"))
    return block(parts["roots"], "type", order).union(block(parts["fields"], "type", F.lit(3))).union(bare).union(block(told, "input", F.lit(4))).union(none).union(unions).union(others)


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: the whole schema as text; it gathers the blocks of an interface. No calls give an empty one."""
    blocks = render(parts).agg(F.array_sort(F.collect_list(F.struct("place", "name", "sdl"))).alias("b"))
    return blocks.select(F.concat(F.lit("# Inferred from observed traffic\n"), F.array_join(F.transform("b", lambda x: F.concat(F.lit("\n"), x["sdl"])), "")).alias("sdl"))
