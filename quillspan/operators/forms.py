"""HTML forms of recorded pages as exchanges that would submit them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.functions.rows import settle
from quillspan.operators.links import resolve

# Bounds on what a page may declare, and parts of names whose values are never kept ("_token" only as a whole name).
MAX_FORMS, MAX_FIELDS, MAX_TEXT, MAX_PAGE = 1000, 500, 4096, 8 << 20
SENSITIVE = (
    "csrf", "xsrf", "authenticity_token",
    "session", "access_token", "refresh_token",
    "bearer", "jwt", "oauth",
    "apikey", "api_key", "api-key",
    "samlrequest", "samlresponse", "relaystate",
)


def is_sensitive(name: Column) -> Column:
    """Does a field's name say that its value is a secret?"""
    return (F.lower(name) == "_token") | F.lower(name).rlike("|".join(SENSITIVE))


class _Forms(HTMLParser):
    """Forms of a page with their fields; a form that is never closed counts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.done: list[dict] = []
        self.pending: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "")[:MAX_TEXT] for k, v in reversed(attrs)}
        if tag == "form" and len(self.done) + len(self.stack) < MAX_FORMS:
            self.stack.append({"action": a.get("action", ""), "method": a.get("method", "get").upper(), "enctype": a.get("enctype", "").lower(), "fields": []})
        elif self.stack and tag in ("input", "textarea", "select") and a.get("name") and a.get("type", "").lower() not in ("submit", "button", "image", "file", "reset") and len(self.stack[-1]["fields"]) < MAX_FIELDS:
            hidden = a.get("type", "").lower() in ("hidden", "password")
            field = {"name": a["name"], "value": "" if hidden else a.get("value") or a.get("placeholder", "")}
            self.stack[-1]["fields"].append(field)
            self.pending = field if tag != "input" else None
        elif tag == "option" and self.pending is not None and (not self.pending["value"] or "selected" in a):
            self.pending["value"] = a.get("value", "")

    def handle_data(self, data: str) -> None:
        if self.pending is not None and self.lasttag == "textarea":
            self.pending["value"] = (self.pending["value"] + data)[:MAX_TEXT]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("textarea", "select"):
            self.pending = None
        if tag == "form" and self.stack:
            self.done.append(self.stack.pop())


def _forms(html: str) -> list[dict]:
    page = _Forms()
    page.feed(html)
    page.close()
    return page.done + page.stack[::-1]


def extract_forms(exchanges: DataFrame) -> DataFrame:
    """Synthetic exchanges (source ``static:html``) of the forms in HTML answers.

    Only http(s) actions of the page's own origin are kept. GET forms carry their fields in the query, others as
    a form body, names in order; values of sensitive and hidden fields are blank.
    """
    html = F.col("response.body").cast("string")
    is_html = F.lower(F.coalesce("response.content_type", F.lit(""))).startswith("text/html") | F.lower(F.left(F.ltrim(html), F.lit(50))).rlike(r"^(<!doctype|<html)")
    pages = exchanges.filter(is_html & (F.octet_length("response.body") <= MAX_PAGE)).filter(F.lower(html).contains("<form")).select("seq", "url", html.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [{"seq": seq, "url": url, "ord": i, "form": json.dumps(f)} for i, f in enumerate(_forms(text))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    found = pages.mapInArrow(run, "seq long, url string, ord long, form string")
    form = F.from_json("form", "action string, method string, enctype string, fields array<struct<name:string,value:string>>")
    rows = settle(found.withColumn("form", form), target=resolve(F.col("url"), F.col("form.action")))
    rows = rows.filter(U.same_origin(F.col("url"), F.col("target")) & U.is_admissible(F.col("target")))
    method = F.when(F.col("form.method").isin("GET", "POST", "PUT", "PATCH", "DELETE"), F.col("form.method")).otherwise("GET")
    pair = lambda f: F.concat(F.url_encode(f["name"]), F.lit("="), F.url_encode(F.when(is_sensitive(f["name"]), "").otherwise(f["value"])))
    rows = rows.withColumns({"method": method, "sent": F.array_join(F.array_sort(F.transform("form.fields", pair)), "&")})
    whole = F.concat("target", F.when(F.col("target").contains("?"), F.when(F.col("target").endswith("?"), "").otherwise("&")).otherwise("?"), "sent")
    url = F.when((F.col("method") == "GET") & (F.col("sent") != ""), whole).otherwise(F.col("target"))
    body = F.when(F.col("method") != "GET", F.col("sent"))
    return rows.select("seq", "ord", "method", url.alias("url"), body.alias("body"), F.lit("static:html").alias("source"), F.col("url").alias("page_url"))
