"""The record that passes between stages: one recorded HTTP exchange."""

from __future__ import annotations

RESPONSE = "struct<status_code:int,headers:map<string,string>,content_type:string,body:binary>"
#: Column names and types of an exchange.
EXCHANGE = {
    "seq": "bigint",
    "method": "string",
    "url": "string",
    "headers": "map<string,string>",
    "query_params": "map<string,array<string>>",
    "body": "binary",
    "response": RESPONSE,
    "source": "string",
    "tag": "string",
    "attribute": "string",
    "page_url": "string",
}

# Fixed values of the data model: provenance of rows, and limits that are part of the semantics.
STATIC_JS_SOURCES = ("static:js", "static:js-sourcemap", "static:js-concat")
MAX_VALUES_PER_KEY = 256
MAX_KEYS = 512
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT")
