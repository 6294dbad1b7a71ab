"""Addresses in scripts that go through variables: tokens, scopes, and constants that are defined once.

A script becomes tokens; braces, functions and arrows make scopes; a name counts as a constant if its scope gives it a value once and changes it nowhere.
What calls are given (fetch, XMLHttpRequest, jQuery, axios, location, window.open) is followed through such names and put together at plus signs and in templates. What stays unknown becomes
a placeholder, as in literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

import regex

# Methods of HTTP, jQuery's short forms, and keywords after which a slash begins a pattern or a brace a block.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
SHORT_FORMS = {"get": "GET", "post": "POST", "getJSON": "GET", "getScript": "GET", "load": "GET"}
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
BEFORE_BLOCK = {"if", "for", "while", "switch", "with"}
CHANGES = {"+=", "-=", "*=", "++", "--", "&&=", "||=", "??="}
#: Names that may stand where a script goes to an address.
TOLD = {"fetch", "open", "ajax", "axios", "request", "assign", "replace", "href", "location", *SHORT_FORMS}
#: Definitions that are followed one after the other, and tokens of a script that are read.
MAX_STEPS, MAX_TOKENS = 12, 3_000_000

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<sign>=>|===|!==|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|\.\.\.|[-+*/%&|^~!<>=?:;,.(){}\[\]@#\\])",
    re.S,
)
_TEMPLATE = regex.compile(r"(?<template>`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?<inner>(?:[^{}`\"']|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?&template)|\{(?&inner)\})*)\})*`)", regex.S)
_PATTERN = regex.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_HOLE = regex.compile(r"\$\{((?:[^{}`\"']|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{(?:[^{}])*\}|`[^`]*`)*)\}")
_ANY = re.compile(r"\b(?:fetch|open|get|post|getJSON|getScript|load|ajax|put|patch|delete|head|options|assign|replace)\s*\(|\blocation\b")
_NAME = regex.compile(r"[A-Za-z_$][\w$]*")
_LAST_NAME = regex.compile(r"[\w$.?]*?([A-Za-z_$][\w$]*)")
_PARAM = re.compile(r"\{param\}")
_ESCAPE = regex.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]+)\}|(\n)|(.))", regex.S)


@dataclass
class Scope:
    parent: int
    whole: bool  # of a function, to which ``var`` belongs
    names: dict[str, list[int | None]] = field(default_factory=dict)  # where a name is given a value; None for what is unknown


def unescape(text: str) -> str:
    """A string literal's characters."""

    def one(m: regex.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(int(code, 16)) if int(code, 16) < 0x110000 else ""
        return "" if m[4] else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}.get(m[5], m[5])

    return _ESCAPE.sub(one, text) if "\\" in text else text


def tokens(script: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) of a script's tokens, without space and comments; what is none is skipped by the character."""
    out: list[tuple[str, str, int]] = []
    at, add = 0, out.append

    def template(end: int) -> regex.Match | None:
        """The first template that begins among the characters up to ``end``, which begin no other token."""
        tick = script.find("`", at, end)
        while tick >= 0:
            if m := _TEMPLATE.match(script, tick):
                return m
            tick = script.find("`", tick + 1, end)
        return None

    while at < len(script):
        for m in _TOKEN.finditer(script, at):  # again from behind each template and pattern
            start = m.start()
            if start > at and (t := template(start)):
                add(("template", t[0], t.start()))
                at = t.end()
                break
            kind, text = m.lastgroup, m[0]
            if kind == "space":
                at = m.end()
                continue
            if text == "/":
                last = out[-1] if out else ("sign", "(", 0)
                opens = last[0] == "sign" and last[1] not in (")", "]", "}") or last[0] == "name" and last[1] in BEFORE_PATTERN
                if opens and (p := _PATTERN.match(script, start)):
                    add(("pattern", p[0], start))
                    at = p.end()
                    break
            add((kind, text, start))
            at = m.end()
            if len(out) >= MAX_TOKENS:
                return out
        else:
            if (t := template(len(script))) is None:
                break
            add(("template", t[0], t.start()))
            at = t.end()
        if len(out) >= MAX_TOKENS:
            break
    return out


class Script:
    """A script's tokens, the scope of each, and what each scope's names are given."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, tokens(text)
        self.signs = [text if kind == "sign" else "" for kind, text, _ in self.tokens]
        self.closing = self._pairs()
        self.scopes = [Scope(-1, True)]
        self.of: list[int] = []
        self._assigned: list[tuple[int, str, int | None]] = []
        self._read()
        for scope, name, at in self._assigned:  # a value for a name that some scope around declares, else for a global
            here = scope
            while here > 0 and name not in self.scopes[here].names:
                here = self.scopes[here].parent
            self.scopes[here].names.setdefault(name, []).append(at)

    def _pairs(self) -> dict[int, int]:
        """The place of the closing bracket of each opening one, and the other way round."""
        out, stack = {}, []
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind == "sign" and text in "([{":
                stack.append((i, text))
            elif kind == "sign" and text in ")]}" and stack and stack[-1][1] == {")": "(", "]": "[", "}": "{"}[text]:
                j = stack.pop()[0]
                out[i], out[j] = j, i
        return out

    def _sign(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.signs) and self.signs[i] == text

    def _name(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] == "name" else ""

    def _parameters(self, start: int, end: int) -> list[str]:
        return [self.tokens[i][1] for i in range(start, end) if self.tokens[i][0] == "name" and not self._sign(i - 1, ".") and not self._sign(i - 1, "=")]

    def _function(self, i: int) -> list[str] | None:
        """The parameters of the function whose body begins with the brace at ``i``; None if it is no function's."""
        if self._sign(i - 1, "=>"):
            if self._sign(i - 2, ")"):
                return self._parameters(self.closing.get(i - 2, i), i - 2)
            return [self._name(i - 2)]
        if self._sign(i - 1, ")") and i - 1 in self.closing:
            start = self.closing[i - 1]
            if self._name(start - 1) not in BEFORE_BLOCK:
                return self._parameters(start, i - 1)
        return None

    def _read(self) -> None:
        signs, stack, ends = self.signs, [0], []  # open scopes; where those of arrows without braces end
        for i, (kind, text, _) in enumerate(self.tokens):
            while ends and ends[-1] <= i:
                ends.pop()
                stack.pop()
            self.of.append(stack[-1])
            if kind != "name" and (kind != "sign" or text not in ("{", "}", "=>")):
                continue
            if kind == "sign" and text == "{":
                given = self._function(i)
                self.scopes.append(Scope(stack[-1], given is not None))
                self.scopes[-1].names |= {p: [None] for p in given or []}
                stack.append(len(self.scopes) - 1)
            elif kind == "sign" and text == "}" and len(stack) > 1 and i in self.closing:
                stack.pop()
                self.of[i] = stack[-1]
            elif kind == "sign" and text == "=>" and not self._sign(i + 1, "{"):
                given = self._parameters(self.closing.get(i - 1, i), i - 1) if self._sign(i - 1, ")") else [self._name(i - 1)]
                self.scopes.append(Scope(stack[-1], False, {p: [None] for p in given}))
                stack.append(len(self.scopes) - 1)
                ends.append(self.end(i + 1))
            elif kind == "name" and text in ("var", "let", "const"):
                self._declaration(i, text, stack)
            elif kind == "name" and text in ("function", "class") and self._name(i + 1):
                self.scopes[stack[-1]].names.setdefault(self._name(i + 1), []).append(None)
            elif kind == "name" and text == "catch" and self._sign(i + 1, "("):
                self._assigned.append((stack[-1], self._name(i + 2), None))
            elif kind == "name":
                before, behind = signs[i - 1] if i else "", signs[i + 1] if i + 1 < len(signs) else ""
                if (behind == "=" or behind in CHANGES or before in ("++", "--")) and before != "." and not self._declared(i):
                    self._assigned.append((stack[-1], text, i + 2 if behind == "=" else None))

    def _declared(self, i: int) -> bool:
        return (i in self._own) if hasattr(self, "_own") else False

    def _declaration(self, i: int, word: str, stack: list[int]) -> None:
        """The names of a declaration, each with its value; those of patterns and loops are unknown."""
        here = stack[-1]
        while word == "var" and not self.scopes[here].whole:
            here = self.scopes[here].parent
        self._own = getattr(self, "_own", set())
        names, at = self.scopes[here].names, i + 1
        while True:
            if self._sign(at, "{") or self._sign(at, "["):
                close = self.closing.get(at, at)
                for p in self._parameters(at, close):
                    names.setdefault(p, []).append(None)
                at = close + 1
                value = None
            elif name := self._name(at):
                self._own.add(at)
                names.setdefault(name, [])
                value = at + 2 if self._sign(at + 1, "=") else None
                if value:
                    names[name].append(value)
                elif self._name(at + 1) in ("of", "in"):
                    names[name].append(None)
                at += 1
            else:
                return
            if self._sign(at, "="):
                at = self.end(at + 1)
            if not self._sign(at, ","):
                return
            at += 1

    def end(self, i: int) -> int:
        """Where the expression that begins at ``i`` ends: at a comma, semicolon or closing bracket of its own level."""
        while i < len(self.tokens):
            kind, text, _ = self.tokens[i]
            if kind == "sign":
                if text in "([{":
                    i = self.closing.get(i, len(self.tokens))
                elif text in ",;)]}":
                    return i
            i += 1
        return i

    def value(self, start: int, end: int, steps: int = 0) -> tuple[str, bool]:
        """(text, whether any of it is known) of an expression: literals, templates and constants put together; placeholders for the rest."""
        parts, at, known = [], start, False
        while at < end:
            stop = at
            while stop < end and not self._sign(stop, "+"):
                stop = self.closing.get(stop, stop) + 1 if self.tokens[stop][0] == "sign" and self.tokens[stop][1] in "([{" else stop + 1
            text, sure = self._term(at, min(stop, end), steps)
            parts.append(text)
            known |= sure
            at = stop + 1
        return "".join(parts), known

    def _term(self, start: int, end: int, steps: int) -> tuple[str, bool]:
        kind, text, _ = self.tokens[start] if start < end else ("", "", 0)
        if end - start == 1 and kind == "string":
            return unescape(text[1:-1]), True
        if end - start == 1 and kind == "template":
            return self._template(text[1:-1], self.of[start], steps)
        if end - start == 1 and kind == "number":
            return text, False
        if self._sign(start, "(") and self.closing.get(start) == end - 1:
            return self.value(start + 1, end - 1, steps)
        if end - start == 1 and kind == "name":
            return self.named(text, self.of[start], steps)
        last = next((self.tokens[i][1] for i in range(end - 1, start - 1, -1) if self.tokens[i][0] == "name"), "")
        return ("{%s}" % last if last and not self._sign(end - 1, ")") else "{param}"), False

    def named(self, name: str, scope: int, steps: int = 0) -> tuple[str, bool]:
        """The value of a name that is given one once, as seen from a scope; else a placeholder."""
        here = scope
        while here >= 0 and name not in self.scopes[here].names:
            here = self.scopes[here].parent
        given = self.scopes[here].names[name] if here >= 0 else []
        if len(given) == 1 and given[0] is not None and steps < MAX_STEPS:
            text, known = self.value(given[0], self.end(given[0]), steps + 1)
            if known:
                return text, True
        return "{%s}" % name, False

    def _template(self, text: str, scope: int, steps: int) -> tuple[str, bool]:
        known = bool(_HOLE.sub("", text))

        def shown(m: regex.Match) -> str:
            nonlocal known
            inner = m[1].strip()
            if _NAME.fullmatch(inner):
                told, sure = self.named(inner, scope, steps)
                known |= sure
                return told
            last = _LAST_NAME.fullmatch(inner)
            return "{%s}" % last[1] if last else "{param}"

        return unescape(_HOLE.sub(shown, text)), known

    def arguments(self, i: int) -> list[tuple[int, int]]:
        """The bounds of each argument behind the opening bracket at ``i``."""
        out, close, at = [], self.closing.get(i, i), i + 1
        while at < close:
            stop = self.end(at)
            out.append((at, stop))
            at = stop + 1
        return out

    def source(self, bounds: tuple[int, int]) -> str:
        """The text of an expression; that of a constant's object, if it is a name."""
        start, end = bounds
        if end - start == 1 and self.tokens[start][0] == "name":
            here = self.of[start]
            while here >= 0 and self.tokens[start][1] not in self.scopes[here].names:
                here = self.scopes[here].parent
            given = self.scopes[here].names[self.tokens[start][1]] if here >= 0 else []
            if len(given) == 1 and given[0] is not None and self._sign(given[0], "{"):
                start, end = given[0], self.closing.get(given[0], given[0]) + 1
        return self.text[self.tokens[start][2] : self.tokens[end - 1][2] + len(self.tokens[end - 1][1])] if start < end else ""

    def pairs(self, start: int) -> dict[str, tuple[int, int]]:
        """The bounds of the values of an object literal by name; a name alone stands for itself."""
        out = {}
        for a, b in self.arguments(start):
            kind, text, _ = self.tokens[a]
            if kind in ("name", "string"):
                key = text if kind == "name" else unescape(text[1:-1])
                out[key] = (a + 2, b) if self._sign(a + 1, ":") else (a, b)
        return out

    def _object(self, bounds: tuple[int, int]) -> int | None:
        """Where the object literal of an argument begins, itself or through a constant."""
        start, end = bounds
        if self._sign(start, "{"):
            return start
        if end - start == 1 and self.tokens[start][0] == "name":
            here = self.of[start]
            while here >= 0 and self.tokens[start][1] not in self.scopes[here].names:
                here = self.scopes[here].parent
            given = self.scopes[here].names[self.tokens[start][1]] if here >= 0 else []
            if len(given) == 1 and given[0] is not None and self._sign(given[0], "{"):
                return given[0]
        return None


def sinks(text: str) -> list[tuple[str, str, str, str]]:
    """(method, address, source of what is sent, kind) of each call in a script that goes to an address; kind is fetch, xhr, jquery, axios or location."""
    if not _ANY.search(text):
        return []
    s, out = Script(text), []

    def told(method: str, bounds: tuple[int, int] | None, sent: tuple[int, int] | None, kind: str) -> None:
        if bounds:
            address, known = s.value(*bounds)
            if known:
                nth = count()
                address = _PARAM.sub(lambda m: f"{{param{n}}}" if (n := next(nth)) else m[0], address)
                out.append((method, address, s.source(sent) if sent else "", kind))

    def configured(options: int, kind: str, address: tuple[int, int] | None, default: str = "GET") -> None:
        given = s.pairs(options)
        named = next((s.value(*given[k]) for k in ("method", "type") if k in given), ("", False))
        sent = next((given[k] for k in ("body", "data") if k in given), None)
        method = named[0].upper() if named[1] and named[0].upper() in METHODS else "POST" if default == "GET" and kind == "fetch" and sent else default
        if sent and s._name(sent[0]) == "JSON" and s._sign(sent[0] + 3, "("):
            sent = next(iter(s.arguments(sent[0] + 3)), None)
        told(method, address or given.get("url"), sent, kind)

    for i, (kind, name, _) in enumerate(s.tokens):
        if kind != "name" or name not in TOLD and name.upper() not in METHODS:
            continue
        owner = s._name(i - 2) if s._sign(i - 1, ".") or s._sign(i - 1, "?.") else ""
        called = s.arguments(i + 1) if s._sign(i + 1, "(") else None
        if name == "fetch" and called and (not s._sign(i - 1, ".") or owner in ("window", "self", "globalThis")):
            options = s._object(called[1]) if len(called) > 1 else None
            if options is None:
                told("GET", called[0], None, "fetch")
            else:
                configured(options, "fetch", called[0])
        elif name == "open" and called and s._sign(i - 1, "."):
            method = s.value(*called[0])
            if len(called) > 1 and method[1] and method[0].upper() in METHODS:
                told(method[0].upper(), called[1], None, "xhr")
            elif owner == "window":
                told("GET", called[0], None, "location")
        elif owner in ("$", "jQuery") and called and name in SHORT_FORMS:
            told(SHORT_FORMS[name], called[0], called[1] if len(called) > 1 and name == "post" and s._object(called[1]) is not None else None, "jquery")
        elif owner in ("$", "jQuery") and called and name == "ajax":
            options = s._object(called[-1])
            if options is not None:
                configured(options, "jquery", called[0] if len(called) > 1 else None)
            else:
                told("GET", called[0], None, "jquery")
        elif called and (name == "axios" and not s._sign(i - 1, ".") or owner == "axios" and name == "request"):
            options = s._object(called[-1])
            if options is not None:
                configured(options, "axios", called[0] if len(called) > 1 else None)
            elif name == "axios":
                told("GET", called[0], None, "axios")
        elif owner == "axios" and called and name.upper() in METHODS:
            sent = called[1] if len(called) > 1 and name in ("post", "put", "patch") and s._object(called[1]) is not None else None
            if name == "delete" and len(called) > 1 and (options := s._object(called[1])) is not None:
                sent = s.pairs(options).get("data")
            told(name.upper(), called[0], sent, "axios")
        elif name in ("assign", "replace") and owner == "location" and called:
            told("GET", called[0], None, "location")
        elif (name == "href" and owner == "location" or name == "location" and owner in ("", "window", "document", "self", "top")) and s._sign(i + 1, "="):
            told("GET", (i + 2, s.end(i + 2)), None, "location")
    return out
