"""Is an exchange an API call, and of which kind? Four classifiers as column expressions, and their best verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.sources.schema import STATIC_JS_SOURCES

# Fixed values of the classifiers.
STATIC_EXTENSIONS = (".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".svg", ".map")
STATIC_SEGMENTS = ("/static/", "/assets/", "/dist/", "/bundle/")
API_TYPES = ("application/json", "application/xml", "text/xml", "application/problem+json", "application/vnd.api+json", "application/hal+json")
GRAPHQL_TYPES = ("application/json", "application/graphql+json", "application/graphql-response+json")
DEFAULT_THRESHOLD = 0.5


@dataclass(frozen=True)
class Verdict:
    """A classifier's confidence (0: none) and its reasons, joined by plus signs; over the columns of :func:`look`."""

    confidence: Column
    reason: Column

    def struct(self, api_type: str) -> Column:
        return F.struct((self.confidence > 0).alias("is_api"), self.confidence.alias("confidence"), F.when(self.confidence > 0, self.reason).otherwise("").alias("reason"), F.lit(api_type).alias("api_type"))


def _any_end(path: Column, ends: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + r")\z")


def _accept_type(accept: Column) -> Column:
    """The first API type that Accept names, unless it asks for HTML anywhere."""
    kinds = F.transform(F.split(accept, ","), H.media_base)
    api = F.filter(kinds, lambda k: k.isin(*API_TYPES))
    return F.when(~F.exists(kinds, lambda k: k.isin("text/html", "application/xhtml+xml")) & (F.size(api) > 0), F.try_element_at(api, F.lit(1)))




def look(exchanges: DataFrame) -> DataFrame:
    """Exchanges with what the classifiers look at, each computed once, in columns that start with an underscore."""
    answer_type = F.coalesce(F.col("response.content_type"), F.lit(""))
    seen = exchanges.withColumns(
        {
            "_raw": U.path(F.col("url")),
            "_query": F.lower(U.raw_query(F.col("url"))),
            "_verb": F.upper("method"),
            "_own_answer_type": H.media_base(answer_type),
            "_answer_type": H.media_base(F.when(answer_type != "", answer_type).otherwise(H.header(F.col("response.headers"), "content-type"))),
            "_sent_type": H.media_base(H.header(F.col("headers"), "content-type")),
            "_accept": _accept_type(H.header(F.col("headers"), "accept")),
            "_body": H.body_text(F.col("body")),
            "_answer": H.body_text(F.col("response.body")),
        }
    )
    seen = seen.withColumns({"_path": F.lower(F.coalesce("_raw", F.lit(""))), "_valid": F.col("_raw").isNotNull()})
    path, query, verb, body, answer = (F.col(c) for c in ("_path", "_query", "_verb", "_body", "_answer"))
    sent = F.when(H.first_solid(body) == "{", F.try_parse_json(body))
    text = F.schema_of_variant(F.try_variant_get(sent, "$.query", "variant")) == "STRING"
    document = F.regexp_replace(F.lower(F.try_variant_get(sent, "$.query", "string")), r"^\s+", "")
    names = F.json_object_keys(F.when(H.first_solid(answer) == "{", answer))
    marked = seen.withColumns(
        {
            "_static_file": ~F.col("_valid") | _any_end(path, STATIC_EXTENSIONS),
            "_folder": path.rlike("|".join(STATIC_SEGMENTS)),
            "_api": path.rlike(r"/(api|rest|rpc)/|/graphql|/v[1-9][0-9]*/"),
            "_kind": F.when(F.col("_answer_type").isin(*API_TYPES), F.col("_answer_type")),
            "_sent_kind": F.when(F.col("_sent_type").isin(*API_TYPES), F.col("_sent_type")),
            "_changing": verb.isin("POST", "PUT", "PATCH", "DELETE"),
            "_json": H.first_solid(answer).isin("{", "["),
            "_candidate_source": F.coalesce(F.col("source").isin(*STATIC_JS_SOURCES), F.lit(False)),
            "_g_path": path.contains("/graphql"),
            "_g_body": (verb == "POST") & F.coalesce(text & document.rlike(r"^(\{|query|mutation|subscription|fragment)"), F.lit(False)),
            "_g_answer": F.col("_answer_type").isin(*GRAPHQL_TYPES) & F.coalesce(F.arrays_overlap(names, F.array(F.lit("data"), F.lit("errors"))), F.lit(False)),
            "_action": H.has_header(F.col("headers"), "soapaction"),
            "_envelope": body.contains("<soap:Envelope") | body.contains("<SOAP-ENV:Envelope") | body.contains("schemas.xmlsoap.org/soap/envelope"),
            "_address": query.contains("wsdl") | path.endswith("/wsdl"),
            "_xml": F.col("_own_answer_type").isin("text/xml", "application/soap+xml"),
            "_feed": answer.contains("<rss") | answer.contains("<feed") | answer.contains("<channel"),
            "_g_sent": F.col("_sent_type").startswith("application/grpc"),
            "_g_got": ~F.col("_sent_type").startswith("application/grpc") & F.col("_own_answer_type").startswith("application/grpc"),
            "_trailer": H.has_header(F.col("response.headers"), "grpc-status", "grpc-message"),
            "_shape": (verb == "POST") & F.coalesce(F.col("_raw").rlike(r"^/[A-Za-z][A-Za-z0-9_.]*/[A-Z][A-Za-z0-9_]*\z"), F.lit(False)),
        }
    )
    differs = F.when(~F.col("_sent_kind").eqNullSafe(F.col("_kind")), F.col("_sent_kind"))
    asked = F.when(F.col("_api"), F.coalesce(F.concat(F.lit("accept:"), "_accept"), F.concat(F.lit("content-type:"), differs)))
    marked = marked.withColumns({"_static": F.col("_static_file") | F.col("_folder"), "_asked": asked})
    at_least = [F.when(F.col(c) if c != "_asked" else F.col(c).isNotNull(), v).otherwise(0.0) for c, v in (("_changing", 0.7), ("_json", 0.85), ("_asked", 0.6))]
    first = F.when(F.col("_kind").isNotNull(), 0.8).otherwise(0.0) + F.when(F.col("_api"), 0.15).otherwise(0.0)
    marked = marked.withColumn("_rest", F.greatest(F.least(F.lit(1.0), first), *at_least))
    return marked.withColumn("_candidate", F.col("_api") & (F.col("_rest") < DEFAULT_THRESHOLD) & F.col("_candidate_source"))


def _tag(column: str, text: str) -> Column:
    return F.when(F.col(column), F.lit(text))


def rest() -> Verdict:
    """Content type, API path (a boost), method, JSON body, what the request asks for, static script candidates."""
    tags = [
        F.concat(F.lit("content-type:"), "_kind"),
        _tag("_api", "path-heuristic"),
        F.when(F.col("_changing"), F.concat(F.lit("method:"), "_verb")),
        _tag("_json", "response-structure:json"),
        F.concat(F.lit("request-signal:"), "_asked"),
        _tag("_candidate", "static-js-candidate"),
    ]
    return Verdict(F.when(F.col("_static"), 0.0).when(F.col("_candidate"), DEFAULT_THRESHOLD).otherwise(F.col("_rest")), F.concat_ws("+", *tags))


def graphql() -> Verdict:
    """A GraphQL path, a document in the body of a POST, and a response of GraphQL's shape."""
    on_path, asked = F.col("_g_path"), F.col("_g_body")
    shaped = F.col("_g_answer") & (on_path | asked)
    score = F.when(F.col("_static_file"), 0.0).when(on_path & asked, 0.95).when(asked, 0.85).when(shaped, 0.8).when(on_path, 0.7).otherwise(0.0)
    return Verdict(score, F.concat_ws("+", _tag("_g_path", "graphql-path"), _tag("_g_body", "graphql-body"), F.when(shaped, "graphql-response")))


def wsdl() -> Verdict:
    """A SOAPAction, an envelope, a WSDL address, an XML answer (less, if that is all and it is a feed)."""
    score = F.when(F.col("_static_file"), 0.0).when(F.col("_action"), 0.95).when(F.col("_envelope") | F.col("_address"), 0.9)
    score = score.when(F.col("_xml") & F.col("_feed"), 0.3).when(F.col("_xml"), 0.85).otherwise(0.0)
    return Verdict(score, F.concat_ws("+", _tag("_action", "soapaction-header"), _tag("_envelope", "soap-envelope"), _tag("_address", "wsdl-url"), _tag("_xml", "soap-content-type")))


def grpc() -> Verdict:
    """gRPC's content type, its trailers, and the shape of its paths."""
    typed = F.col("_g_sent") | F.col("_g_got")
    score = F.when(typed & F.col("_trailer"), 0.99).when(typed, 0.95).when(F.col("_trailer"), 0.8).when(F.col("_shape"), 0.6).otherwise(0.0)
    return Verdict(score, F.concat_ws("+", _tag("_g_sent", "grpc-content-type"), _tag("_g_got", "grpc-response-content-type"), _tag("_trailer", "grpc-trailer-header"), _tag("_shape", "grpc-path-shape")))


CLASSIFIERS = {"rest": rest, "graphql": graphql, "wsdl": wsdl, "grpc": grpc}
#: Which classifiers look at an API of each type, in the order in which ties are settled.
FOR_TYPE = {"rest": ["rest"], "graphql": ["graphql"], "wsdl": ["wsdl"], "grpc": ["grpc"], "auto": ["rest", "graphql", "wsdl", "grpc"]}


def classify(exchanges: DataFrame, kinds: list[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Exchanges with is_api, confidence, reason and api_type of the most confident classifier (the first of equals).

    Rows below the threshold go; a threshold of 0 keeps all. Names of query parameters with several values in
    the row are kept in ``multi_value_query_keys``.
    """
    rows = look(exchanges)
    verdicts = rows.withColumns({f"_{k}_verdict": CLASSIFIERS[k]().struct(k) for k in kinds})
    most = F.greatest(*[F.col(f"_{k}_verdict.confidence") for k in kinds], F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(f"_{k}_verdict.confidence") == F.col("_most"), F.col(f"_{k}_verdict")) for k in kinds])
    several = F.transform_values(F.map_filter("query_params", lambda k, v: F.size(v) > 1), lambda k, v: F.lit(True))
    marked = verdicts.withColumn("_most", most).withColumn("_best", best).withColumn("multi_value_query_keys", several)
    # a generator keeps the filter from being pushed into the scan as a copy of all the expressions above
    found = marked.select(*exchanges.columns, "multi_value_query_keys", F.inline(F.array("_best")))
    return found.filter(F.col("confidence") >= threshold)


def detect_type(exchanges: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: how many exchanges each classifier accepts, and the API's type. GraphQL wins ties, then SOAP; gRPC is never detected."""
    counts = look(exchanges).agg(*[F.count_if(CLASSIFIERS[k]().confidence >= threshold).alias(f"{k}_rows") for k in ("rest", "wsdl", "graphql")])
    found = F.when((F.col("graphql_rows") > 0) & (F.col("graphql_rows") >= F.greatest("wsdl_rows", "rest_rows")), "graphql").when((F.col("wsdl_rows") > 0) & (F.col("wsdl_rows") >= F.col("rest_rows")), "wsdl").otherwise("rest")
    return counts.withColumn("api_type", found)
