"""gRPC frames and protobuf fields of recorded bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the wire formats: bytes before a message, of a varint, and the largest field number.
HEAD, MAX_VARINT, MAX_FIELD = 5, 10, (1 << 29) - 1
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def split_frames(body: bytes) -> list[tuple[bool, bytes]]:
    """(compressed, message) of each frame; a frame that is cut short ends the list."""
    out, at = [], 0
    while at + HEAD <= len(body):
        end = at + HEAD + int.from_bytes(body[at + 1 : at + HEAD], "big")
        if end > len(body) or body[at] > 1:
            break
        out.append((body[at] == 1, body[at + HEAD : end]))
        at = end
    return out


def read_varint(data: bytes, at: int) -> tuple[int, int] | None:
    """A varint's value and the place behind it; None if it is cut short or too long."""
    value = 0
    for i, b in enumerate(data[at : at + MAX_VARINT]):
        value |= (b & 0x7F) << 7 * i
        if b < 0x80:
            return (value, at + i + 1) if value < 1 << 64 else None
    return None


def walk_fields(message: bytes) -> list[tuple[int, int, int, bytes]] | None:
    """(field, kind, number, bytes) of each field, numbers for the three kinds of numbers and bytes for the fourth; None for what is no message."""
    out, at = [], 0
    while at < len(message):
        tag = read_varint(message, at)
        if tag is None or not 1 <= tag[0] >> 3 <= MAX_FIELD:
            return None
        field, kind, at = tag[0] >> 3, tag[0] & 7, tag[1]
        if kind == VARINT:
            if (read := read_varint(message, at)) is None:
                return None
            number, at, data = *read, b""
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            if at + size > len(message):
                return None
            number, at, data = int.from_bytes(message[at : at + size], "little"), at + size, b""
        elif kind == BYTES:
            if (read := read_varint(message, at)) is None or read[1] + read[0] > len(message):
                return None
            number, data, at = read[0], message[read[1] : read[1] + read[0]], read[1] + read[0]
        else:
            return None
        out.append((field, kind, number, data))
    return out


def fields(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, frame, nth, field, kind, number, data) of the messages in gRPC bodies; null, compressed and malformed ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for n, (packed, message) in enumerate(split_frames(body or b"")):
                    found = [] if packed else walk_fields(message) or []
                    rows += [(i, n, k, f, kind, number - (1 << 64) if number >> 63 else number, data) for k, (f, kind, number, data) in enumerate(found)]
            at, *others = map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(7))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(others, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "frame", "nth", "field", "kind", "number", "data"])

    kind = bodies.schema[id_col].dataType.simpleString()
    return bodies.select(id_col, body_col).mapInArrow(run, f"id {kind}, frame int, nth int, field int, kind int, number long, data binary").withColumnRenamed("id", id_col)
