"""Secret scans by a trigram index, with DataFrame functions alone.

From each rule's pattern a Boolean query over trigrams is derived (after Cox, "Regular expression matching with a
trigram index"): trigrams that every match holds, as alternatives of conjunctions. The index has posting lists of
texts for the trigrams that queries name, over texts with ASCII letters in lower case. Posting lists are intersected
and united block by block, and only texts that survive are searched with the pattern itself. A rule whose pattern has
no mandatory trigram is searched for in every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as _c
from re import _parser
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.store import written

#: Strings of which a part of a pattern may consist before it is no longer followed exactly.
EXACT = 64
#: Texts of a block of the index, about: a posting list is no longer than that.
BLOCK_TEXTS = 1 << 16
#: Candidates are sent to every task up to so many (16 bytes each), else texts are joined by their hash.
BROADCAST_ROWS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and without overlaps, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """The pattern ``words`` with each ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


ASSIGN = Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", 0, 16)
HEX = Rule("hex", "[0-9a-f]+", 0, 32)
#: The kinds that are always looked for, and further ones, found by well-known fixed prefixes.
BASE = (ASSIGN, ACCESS, HEX)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 24),
)

# A query is None (no condition), a trigram, or ("and" | "or", queries).
Query = Any


def _all(queries: list[Query]) -> Query:
    kept = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(queries: list[Query]) -> Query:
    """One of ``queries``; what asks for more than another alternative does is left out."""
    kept = list(dict.fromkeys(queries))
    if not kept or None in kept:
        return None
    asks = [frozenset([q]) if isinstance(q, str) else frozenset(q[1]) if q[0] == "and" else None for q in kept]
    kept = [q for q, a in zip(kept, asks, strict=True) if a is None or not any(b is not None and b < a for b in asks)]
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    """Whoever holds one of ``strings`` satisfies it."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list[tuple]) -> set[str] | None:
    """The lower-cased characters of a class, or None if there are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is _c.LITERAL:
            out.add(_fold(chr(value)))
        elif kind is _c.RANGE and value[1] - value[0] < 8:
            out |= {_fold(chr(i)) for i in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def _walk(parsed: list[tuple]) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few; what every match satisfies) of a sequence of parts."""
    queries: list[Query] = []
    run, whole = {""}, True

    def end() -> None:
        nonlocal run, whole
        queries.append(_of_strings(run))
        run, whole = {""}, False

    for kind, value in parsed:
        strings, query = None, None
        if kind is _c.LITERAL:
            strings = {_fold(chr(value))}
        elif kind is _c.IN:
            strings = _class(value)
        elif kind is _c.SUBPATTERN:
            strings, query = _walk(value[-1])
        elif kind is _c.BRANCH:
            ways = [_walk(way) for way in value[1]]
            strings = None if any(s is None for s, _ in ways) else set().union(*(s for s, _ in ways))
            query = _any([q for _, q in ways])
        elif kind is _c.AT:
            strings = {""}
        elif kind in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = value
            strings, query = _walk(inner)
            if strings is not None and high is not _c.MAXREPEAT and len(strings) ** high <= EXACT:
                strings = {s for n in range(low, high + 1) for s in reduce(lambda a, _: {x + y for x in a for y in strings}, range(n), {""})}
            else:
                strings, query = None, query if low else None
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = {a + b for a in run for b in strings}
            continue
        end()
        queries.append(_of_strings(strings) if strings is not None else query)
    strings = run if whole else None
    queries.append(_of_strings(run))
    return strings, _all(queries)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match of ``pattern`` satisfies: None, a trigram, or ("and" | "or", queries)."""
    return _walk(list(_parser.parse(pattern)))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _text_key(text: Column) -> Column:
    """Texts are indexed by a hash: equal texts once, and two texts of one hash as one that holds both's trigrams."""
    return F.xxhash64(text)


def index(docs: DataFrame, terms: set[str], text_col: str = "text") -> DataFrame:
    """(block, term, texts): the posting lists of the trigrams ``terms``, in blocks of bounded size by the hash of the text.

    A text's letters A-Z count as lower-case. Null texts are in no list. Copies are one entry, combined before the shuffle.
    """
    found = F.transform(F.array(F.lower(text_col)), lambda folded: F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in sorted(terms)])))
    blocks = -(-docs.count() // BLOCK_TEXTS) or 1
    held = docs.select(_text_key(F.col(text_col)).alias("key"), F.explode(found[0]).alias("term"))
    return held.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "term").agg(F.collect_set("key").alias("texts"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the texts that satisfy some of ``queries`` (by kind), by intersections and unions of posting lists in each block."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "texts"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def solve(q: Query) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("lists", F.lit(q)), none)
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, map(solve, q[1]))

    each = [F.struct(F.lit(kind).alias("kind"), solve(q).alias("texts")) for kind, q in queries.items()]
    solved = lists.select(F.explode(F.array(*each)).alias("s")).select("s.kind", F.explode("s.texts").alias("key"))
    return solved.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _search(rule: Rule) -> str:
    """The rule's pattern; where that is a class repeated once or more, runs that are too short are left out at once."""
    parsed = list(_parser.parse(rule.pattern))
    one_class = len(parsed) == 1 and parsed[0][0] is _c.MAX_REPEAT and parsed[0][1][1] is _c.MAXREPEAT and rule.group == 0 and rule.pattern.endswith("]+")
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if one_class else rule.pattern


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>>: the rule's spans in code points, ends exclusive.

    Positions are sums of the lengths of what lies between matches and of the matches themselves.
    """
    pattern = F.lit(_search(rule))
    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"), F.split(text, _search(rule), -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["length"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def sums(c: Column) -> Column:
        found = F.transform(c["whole"], lambda m, i: F.struct(F.length(c["gaps"][i]).alias("gap"), F.length(m).alias("length"), F.length(c["part"][i]).alias("part")))
        return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return F.transform(F.array(cut), sums)[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, spans: array<struct<start, kind_no, end>>): all spans of all rules, by start, then by the order of rules.

    One row for each row of ``docs``, whatever its id; null and empty texts have no spans; further columns are not carried.
    Repeated rows give equal rows. No documents give no rows. Texts are read twice: for the index and for the search. Where candidates are
    more than ``BROADCAST_ROWS`` texts are shuffled once to meet them, else nothing but the index is.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q is not None}
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__key", _text_key(F.col("__text")))
    if asked:
        terms = set().union(*map(trigrams, asked.values()))
        found = written(candidates(index(rows, terms, "__text"), asked)).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
        rows = rows.join(found, "__key", "left")
    else:
        rows = rows.withColumn("__kinds", F.lit(None).cast("array<string>"))
    none, every = F.array().cast("array<struct<start:int,kind_no:int,end:int>>"), []
    with_kind = lambda n: lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind_no"), s["end"].alias("end"))
    for number, rule in enumerate(rules):
        numbered = F.transform(rule_spans(F.col("__text"), rule), with_kind(number))
        if rule.kind in asked:
            may = F.array_contains("__kinds", F.lit(rule.kind))
        else:
            may = F.rlike("__text", F.lit(_search(rule)))
        every.append(F.when(may, numbered).otherwise(none))
    return rows.select(id_col, F.array_sort(F.concat(*every)).alias("spans"))
