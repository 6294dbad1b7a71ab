"""SOAP operations and the types of their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import headers as H


def uri_tail(uri: Column) -> Column:
    """What an action's URI names: all behind ``urn:``, else what follows the last ``#``, else the last slash; the whole URI where nothing follows."""
    behind = lambda sign: F.nullif(F.substring_index(uri, sign, -1), F.lit(""))
    return F.when(uri.startswith("urn:"), F.substring(uri, F.lit(5), F.length(uri))).otherwise(F.coalesce(F.when(uri.contains("#"), behind("#")), F.when(uri.contains("/"), behind("/")), uri))


# The namespaces of SOAP 1.1 and 1.2 envelopes.
ENVELOPES = ("http://schemas.xmlsoap.org/soap/envelope/", "http://www.w3.org/2003/05/soap-envelope")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"


def body_child(body: Column) -> Column:
    """The local name of the first element in the body of an envelope; empty unless the body's prefix stands for SOAP's namespace.

    Prefixes are looked up in the document as a whole, and comments are left out.
    """
    text = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    prefix = F.regexp_extract(text, rf"<((?:{_NAME}:)?)Body(?:\s[^>]*)?>", 1)
    space = "|".join(ENVELOPES).replace(".", r"\.")
    named = F.concat(F.lit("xmlns"), F.when(prefix == "", "").otherwise(F.concat(F.lit(":"), F.rtrim(prefix, F.lit(":")))))
    declared = F.exists(F.regexp_extract_all(text, F.lit(rf"""(xmlns(?::{_NAME})?)\s*=\s*["'](?:{space})["']"""), F.lit(1)), lambda n: n == named)
    child = F.regexp_extract(text, rf"(?s)<(?:{_NAME}:)?Body(?:\s[^>]*)?>\s*<(?:{_NAME}:)?({_NAME})", 1)
    return F.when(declared, child).otherwise("")


def operation_name() -> Column:
    """From the SOAPAction, else the request's body, else the response's without ``Response``."""
    action = F.btrim(H.header(F.col("headers"), "SOAPAction"), F.lit('" '))
    asked, told = body_child(H.body_text(F.col("body"))), body_child(H.body_text(F.col("response.body")))
    return F.coalesce(F.nullif(uri_tail(action), F.lit("")), F.nullif(asked, F.lit("")), F.nullif(F.regexp_replace(told, r"Response\z", ""), F.lit("")))


def xsd_type(value: Column) -> Column:
    """boolean, int, decimal, date, dateTime or string, from the text of a value. Numbers with leading zeros, and dates and times that do not exist, are texts."""
    v = F.trim(value)
    exists = lambda form, size: F.try_to_timestamp(F.left(v, F.lit(size)), F.lit(form)).isNotNull()
    zone = r"(Z|[+-]([01][0-9]|2[0-4]):[0-5][0-9])?"
    return (
        F.when(v.isin("true", "false"), "xsd:boolean")
        .when(v.rlike(r"^-?(0|[1-9][0-9]*)\z"), "xsd:int")
        .when(v.rlike(r"^-?[0-9]+\.[0-9]+\z"), "xsd:decimal")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & exists("yyyy-MM-dd", 10), "xsd:date")
        .when(v.rlike(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?{zone}\z") & exists("yyyy-MM-dd'T'HH:mm:ss", 19), "xsd:dateTime")
        .otherwise("xsd:string")
    )
