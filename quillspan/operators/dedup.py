"""One row for each distinct exchange: the first one seen, with what all its repetitions add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.sources.schema import MAX_VALUES_PER_KEY

FIRST = ("method", "url", "headers", "body", "source", "tag", "attribute", "page_url")


def dedup_key() -> Column:
    """Method, decoded path (neither host nor query), SOAPAction, and with a body its media type and hash.

    The boundary of a multipart body is not part of the hash. A malformed URL is its own key.
    """
    given = H.header(F.col("headers"), "content-type")
    boundary = F.regexp_extract(given, r'(?i)^\s*multipart/form-data\s*;.*boundary="?([^";]{4,})"?', 1)
    text = F.col("body").cast("string")
    neutral = F.when((boundary != "") & F.is_valid_utf8(text), F.replace(text, boundary, F.lit("BOUNDARY")).cast("binary")).otherwise(F.col("body"))
    has_body = F.coalesce(F.octet_length("body"), F.lit(0)) > 0
    action = F.trim(F.btrim(H.header(F.col("headers"), "SOAPAction"), F.lit('"')))
    parts = [
        F.col("method"),
        F.when(U.is_valid(F.col("url")), U.unescape(U.raw_path(F.col("url")))).otherwise(F.col("url")),
        F.when(action != "", action),
        F.when(has_body & (given != ""), H.media_base(given)),
        F.when(has_body, F.left(F.sha2(neutral, 256), F.lit(16))),
    ]
    return F.concat_ws(":", *parts)


def response_order() -> Column:
    """Populated responses first, then the least status, content type and body; the earliest of equals."""
    r = F.col("response")
    populated = (F.coalesce(r["status_code"], F.lit(0)) > 0) | (F.coalesce(F.octet_length(r["body"]), F.lit(0)) > 0) | (F.coalesce(r["content_type"], F.lit("")) != "")
    return F.struct((~populated).alias("empty"), r["status_code"].alias("status"), r["content_type"].alias("kind"), r["body"].alias("body"), F.col("seq").alias("seq"))


def union_values(rows: DataFrame, key: str, most: int = MAX_VALUES_PER_KEY) -> DataFrame:
    """(key, query_params, multi_value_query_keys): per parameter the distinct values of all rows in the order in which they were first seen, at most ``most``, and which parameters have several values in any row."""
    given = rows.filter(F.size("query_params") > 0).select(key, "seq", F.explode("query_params").alias("name", "values"))
    values = given.select(key, "seq", "name", (F.size("values") > 1).alias("several"), F.posexplode("values").alias("pos", "value"))
    first = values.groupBy(key, "name", "value").agg(F.min(F.struct("seq", "pos")).alias("at"), F.bool_or("several").alias("several"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(key, "name").orderBy("at")))
    shown = F.when(F.col("n") <= most, F.struct("n", "value"))
    listed = ranked.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda v: v["value"]).alias("values"), F.bool_or("several").alias("several"))
    all_names = F.array_sort(F.collect_list(F.struct("name", "values", "several"))).alias("all")
    whole = listed.groupBy(key).agg(all_names)
    flags = F.map_from_entries(F.transform(F.filter("all", lambda x: x["several"]), lambda x: F.struct(x["name"], x["several"])))
    return whole.select(key, F.map_from_entries(F.transform("all", lambda x: F.struct(x["name"], x["values"]))).alias("query_params"), flags.alias("multi_value_query_keys"))


def deduplicate(classified: DataFrame) -> DataFrame:
    """Classified exchanges, one for each key, with ``seq`` of the first and ``repeats``.

    The first row gives address, headers and body; the most confident verdict (then the greater type and
    reason) and the best response win by themselves; query values and names with several values are united.
    A key's repetitions are combined before the shuffle, so a hot key costs one row a task. Rows with a query are
    read a second time, without what they carry.
    """
    keyed = classified.withColumn("dedup_key", dedup_key())
    verdict = F.struct("confidence", "api_type", "reason", "is_api")
    merged = keyed.groupBy("dedup_key").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("repeats"),
        F.min_by(F.struct(*FIRST), "seq").alias("first"),
        F.max(verdict).alias("verdict"),
        F.min_by("response", response_order()).alias("response"),
    )
    joined = merged.join(union_values(keyed, "dedup_key"), "dedup_key", "left")
    flags = F.coalesce("multi_value_query_keys", F.create_map().cast("map<string,boolean>"))
    return joined.select(F.col("first_seq").alias("seq"), "first.*", "query_params", "response", "verdict.*", flags.alias("multi_value_query_keys"), "dedup_key", "repeats")


def distinct_scripts(exchanges: DataFrame) -> DataFrame:
    """Script addresses, each path and query of an origin once, in the order in which they were first seen."""
    address = F.struct(U.canonical_origin(F.col("url")).alias("origin"), U.raw_path(F.col("url")).alias("path"), U.raw_query(F.col("url")).alias("query"))
    return exchanges.groupBy(address.alias("address")).agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq")).select("seq", "url")
