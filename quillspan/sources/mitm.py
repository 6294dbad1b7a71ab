"""mitmproxy's native dumps: concatenated tnetstrings, one partition for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources.readers import MAX_IMPORT, check_size, flows_to_exchanges

# Fixed values of the format.
MAX_DEPTH, MAX_ELEMENT, MAX_ENTRIES, MAX_FLOWS = 64, 64 << 20, 1 << 20, 500_000
FLOW = "request struct<method:string,scheme:string,host:string,port:long,path:string,headers:array<array<string>>,content:string>, response struct<status_code:int,headers:array<array<string>>,content:string>"


def decode(data: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """One element from ``at`` (length, colon, payload, type) and where it ends."""
    if depth > MAX_DEPTH:
        raise ValueError("tnetstring nested too deeply")
    colon = data.find(b":", at, at + 12)
    if colon < 0 or not data[at:colon].isdigit():
        raise ValueError(f"tnetstring without a length: {data[at : at + 64]!r}")
    size = int(data[at:colon])
    end = colon + 1 + size
    if size > MAX_ELEMENT or end >= len(data):
        raise ValueError("tnetstring cut short or too long")
    payload, kind = data[colon + 1 : end], data[end : end + 1]
    if kind in (b"]", b"}"):
        items, pos = [], 0
        while pos < size:
            item, pos = decode(payload, pos, depth + 1)
            items.append(item)
            if len(items) > (MAX_ENTRIES if kind == b"]" else 2 * MAX_ENTRIES):
                raise ValueError("tnetstring list or dictionary of too many entries")
        if kind == b"]":
            return items, end + 1
        keys = [k.decode() if isinstance(k, bytes) else k for k in items[::2]]
        if len(items) % 2 or not all(isinstance(k, str) for k in keys):
            raise ValueError("tnetstring dictionary without a value or with an odd key")
        return dict(zip(keys, items[1::2], strict=True)), end + 1
    if kind == b"~" and not size:
        return None, end + 1
    if kind == b"!" and payload in (b"true", b"false"):
        return payload == b"true", end + 1
    plain = {b",": bytes, b";": bytes.decode, b"#": int, b"^": float}
    if kind not in plain:
        raise ValueError(f"tnetstring of unknown type {kind!r}")
    return plain[kind](payload), end + 1


def _text(v: object) -> str | None:
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else v if v is None or isinstance(v, str) else str(v)


def _side(state: dict, numbers: tuple[str, ...], words: tuple[str, ...]) -> dict:
    out = {k: _text(state.get(k)) for k in (*words, "content")} | {k: state.get(k) for k in numbers}
    return out | {"headers": [[_text(x) for x in pair] for pair in state.get("headers") or [] if len(pair) >= 2]}


def flows(data: bytes) -> Iterator[dict]:
    """The HTTP flows of a dump, in order."""
    at, n = 0, 0
    while at < len(data):
        state, at = decode(data, at)
        if not isinstance(state, dict) or _text(state.get("type")) != "http":
            continue
        n += 1
        if n > MAX_FLOWS or not isinstance(state.get("request"), dict) or "port" not in state["request"]:
            raise ValueError("too many flows, or a flow without a request or port")
        asked = _side(state["request"], ("port",), ("method", "scheme", "host", "path"))
        told = _side(state["response"], ("status_code",), ()) if isinstance(state.get("response"), dict) else None
        yield {"request": asked, "response": told}


def read_mitmproxy_native(spark: SparkSession, path: str) -> DataFrame:
    """Exchanges of native dumps. Spark reads the files, so they may lie in any store; a file is one task."""
    check_size(spark, path, MAX_IMPORT)
    return native_dumps(spark.read.format("binaryFile").load(path).select("content"))


def native_dumps(dumps: DataFrame) -> DataFrame:
    """Exchanges of native dumps, one a row in the column ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [{"seq": i} | f for i, f in enumerate(flows(data))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("seq", pa.int64()), ("request", _ASKED), ("response", _TOLD)]))

    return flows_to_exchanges(dumps.select("content").mapInArrow(run, f"seq long, {FLOW}").select(F.col("seq"), "request", "response"))


_PAIRS = pa.list_(pa.list_(pa.string()))
_ASKED = pa.struct([("method", pa.string()), ("scheme", pa.string()), ("host", pa.string()), ("port", pa.int64()), ("path", pa.string()), ("headers", _PAIRS), ("content", pa.string())])
_TOLD = pa.struct([("status_code", pa.int32()), ("headers", _PAIRS), ("content", pa.string())])
