"""Path templates: which segments of observed paths are parameters, and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.rows import let

# Words that are never parameters, words that only scaffold a path, and the bound of the fixed point.
KNOWN_LITERALS = ("me", "current", "self", "new", "list", "search")
SCAFFOLD = r"^(api|apis|rest|v[1-9][0-9]*)\z"
MAX_ROUNDS = 8

LITERAL, NUMBER, UUID, OBJECT_ID, HASH, TOKEN, SLUG = "literal", "number", "uuid", "objectid", "hash", "token", "slug"


def segment_kind(s: Column) -> Column:
    """literal, uuid, objectid (24 hex), number, hash (6 to 12 hex with a digit or capital), token (base64), in that order."""
    short = s.rlike(r"^[0-9a-fA-F]{6,12}\z") & s.rlike(r"[0-9A-F]")
    base = s.rlike(r"^[A-Za-z0-9+/_\-]{16,}={0,2}\z") & (s.rlike(r"[+/=]") | (s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")))
    return (
        F.when(s.isin(*KNOWN_LITERALS), LITERAL)
        .when(s.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), UUID)
        .when(s.rlike(r"^[0-9a-fA-F]{24}\z"), OBJECT_ID)
        .when(s.rlike(r"^[0-9]+\z"), NUMBER)
        .when(short, HASH)
        .when(base, TOKEN)
        .otherwise(LITERAL)
    )


def segments(path: Column) -> Column:
    return F.split(path, "/")


def singular(word: Column) -> Column:
    return F.when(word.rlike(r"ies\z"), F.regexp_replace(word, r"ies\z", "y")).when(word.rlike(r"sses\z"), F.regexp_replace(word, r"es\z", "")).when(word.rlike(r"[^s]s\z"), F.regexp_replace(word, r"s\z", "")).otherwise(word)


def camel(word: Column) -> Column:
    """Letters, digits and underscores; a small letter after a hyphen or dot becomes a capital."""
    parts = F.split(F.regexp_replace(word, r"[^A-Za-z0-9_.\-]", ""), r"[.\-]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))), "")


def named_template(parts: Column, kinds: Column) -> Column:
    """The path with parameters as ``{name}``: the nearest literal before, in the singular, and Id, Token or Slug; repeated names are numbered."""

    def name(kind: Column, i: Column) -> Column:
        before = F.filter(F.zip_with(F.slice(parts, F.lit(1), i), F.slice(kinds, F.lit(1), i), lambda p, k: F.when((k == LITERAL) & (p != ""), p)), lambda p: p.isNotNull())
        word = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))
        tail = F.when(kind == TOKEN, "Token").when(kind == SLUG, "Slug").otherwise("Id")
        return F.when(word == "", F.lower(tail)).otherwise(camel(F.concat(singular(word), tail)))

    def numbered(names: Column) -> Column:
        count = lambda n, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda m: m == n))
        return F.transform(names, lambda n, i: F.when(n.isNotNull(), let(count(n, i), lambda c: F.when(c > 1, F.concat(n, c.cast("string"))).otherwise(n))))

    shown = let(F.transform(kinds, lambda k, i: F.when(k != LITERAL, name(k, i))), numbered)
    return F.array_join(F.zip_with(parts, shown, lambda p, n: F.coalesce(F.concat(F.lit("{"), n, F.lit("}")), p)), "/")


def path_template(path: Column) -> Column:
    """The template of a path by itself."""
    return let(segments(path), lambda parts: let(F.transform(parts, segment_kind), lambda kinds: named_template(parts, kinds)))


def plain_template(path: Column) -> Column:
    """The template of a path by itself, with every parameter as ``{id}``."""
    return F.array_join(F.transform(segments(path), lambda s: F.when(segment_kind(s) == LITERAL, s).otherwise("{id}")), "/")


def classify_paths(paths: DataFrame) -> DataFrame:
    """(path, parts, kinds) of the distinct paths."""
    return paths.select("path").distinct().withColumn("parts", segments(F.col("path"))).withColumn("kinds", F.transform("parts", segment_kind))


def _positions(infos: DataFrame) -> DataFrame:
    """Every segment with the shape of its surroundings; shapes show parameters as ``{}``."""
    shape = F.zip_with("parts", "kinds", lambda p, k: F.when(k == LITERAL, p).otherwise("{}"))
    rows = infos.withColumn("shape", shape).select("path", "parts", "kinds", "shape", F.posexplode("parts").alias("at", "segment"))
    return rows.select(
        "path",
        "at",
        "segment",
        F.element_at("kinds", F.col("at") + 1).alias("kind"),
        F.array_join(F.slice("shape", F.lit(1), F.col("at")), "/").alias("prefix"),
        F.array_join(F.slice("shape", F.col("at") + 2, F.size("shape")), "/").alias("suffix"),
        F.size("parts").alias("len"),
        F.exists(F.zip_with(F.slice("parts", F.lit(1), F.col("at")), F.slice("kinds", F.lit(1), F.col("at")), lambda p, k: (k == LITERAL) & (p != "") & ~p.rlike(SCAFFOLD)), lambda x: x).alias("led"),
    )


POSITION = ["prefix", "at", "suffix", "len"]


def varying_positions(infos: DataFrame, threshold: int) -> DataFrame:
    """Positions at which at least ``threshold`` different literals were seen, after a literal that means something."""
    candidate = (F.col("kind") == LITERAL) & (F.col("segment") != "") & ~F.col("segment").isin(*KNOWN_LITERALS) & F.col("led")
    return _positions(infos).filter(candidate).groupBy(*POSITION).agg(F.count_distinct("segment").alias("literals")).filter(F.col("literals") >= threshold)


def _rebuild(rows: DataFrame) -> DataFrame:
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "segment", "kind"))).alias("all"))
    return whole.select("path", F.transform("all", lambda s: s["segment"]).alias("parts"), F.transform("all", lambda s: s["kind"]).alias("kinds"))


def promote(infos: DataFrame, varying: DataFrame) -> DataFrame:
    """Literals at varying positions become slugs."""
    rows = _positions(infos).join(varying.select(*POSITION, F.lit(True).alias("varies")), POSITION, "left")
    slug = F.col("varies") & (F.col("kind") == LITERAL) & (F.col("segment") != "") & ~F.col("segment").isin(*KNOWN_LITERALS) & F.col("led")
    return _rebuild(rows.withColumn("kind", F.when(slug, SLUG).otherwise(F.col("kind"))))


def unify(infos: DataFrame) -> DataFrame:
    """A position that holds slugs and other parameters holds slugs only."""
    rows = _positions(infos)
    mixed = rows.groupBy(*POSITION).agg(F.bool_or(F.col("kind") == SLUG).alias("slug"), F.bool_or(~F.col("kind").isin(SLUG, LITERAL)).alias("other")).filter("slug AND other")
    back = rows.join(mixed.select(*POSITION, F.lit(True).alias("mixed")), POSITION, "left")
    return _rebuild(back.withColumn("kind", F.when(F.col("mixed") & (F.col("kind") != LITERAL), SLUG).otherwise(F.col("kind"))))


def normalize(paths: DataFrame, merge_slugs: bool = False, threshold: int = 2) -> DataFrame:
    """(path, template) of distinct paths; with ``merge_slugs`` varying literals are promoted until none is left (at most 8 rounds).

    The loop is over distinct paths, never over traffic; each round is written out, so plans stay short.
    """
    infos = classify_paths(paths)
    if merge_slugs:
        if threshold < 2:
            raise ValueError("a slug threshold below 2 would make every literal a parameter")
        for _ in range(MAX_ROUNDS):
            varying = varying_positions(infos, threshold)
            if varying.isEmpty():
                break
            infos = promote(infos, varying).checkpoint()
        infos = unify(infos)
    return infos.select("path", named_template(F.col("parts"), F.col("kinds")).alias("template"))
