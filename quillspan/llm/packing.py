"""Packing: documents' token ids into sequences of one length, balanced by attention cost.

A document is cut into whole sequences and a rest. Rests are dealt in descending order: each goes to
the sequence of lowest estimated cost among those with room for it. A rest that fits nowhere is cut to
fill the sequence with most room. There are as few sequences as the ids need, so a window of documents
leaves less than one sequence of padding, however its lengths are spread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspan.llm import batches as texts
from quillspan.llm import tokens

#: Ids that are packed together in a task.
WINDOW_TOKENS = 1 << 21


@dataclass(frozen=True)
class Cost:
    """Of a piece of n ids: linear layers by n, attention by n squared."""

    linear: float = 1.0
    quadratic: float = 1.0 / 1024

    def __call__(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


class _Room:
    """Open sequences by the room they have left; the cheapest with at least some room, or the roomiest."""

    def __init__(self, sequences: int, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.best = [(float("inf"), -1)] * (2 * self.leaves)
        self.heaps[capacity] = [(0.0, i) for i in range(sequences)]
        self._mend(capacity)

    def _mend(self, room: int) -> None:
        at = self.leaves + room
        self.best[at] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        while at > 1:
            at //= 2
            self.best[at] = min(self.best[2 * at], self.best[2 * at + 1])

    def cheapest(self, need: int) -> int | None:
        """The room of the cheapest sequence that has room for ``need`` ids."""
        low, high, found, where = self.leaves + need, 2 * self.leaves, (float("inf"), -1), None
        while low < high:
            if low & 1:
                if self.best[low] < found:
                    found, where = self.best[low], low
                low += 1
            if high & 1:
                high -= 1
                if self.best[high] < found:
                    found, where = self.best[high], high
            low, high = low // 2, high // 2
        if where is None:
            return None
        while where < self.leaves:
            where = 2 * where + (self.best[2 * where] != found)
        return where - self.leaves

    def roomiest(self) -> int:
        return max(r for r, heap in enumerate(self.heaps) if heap)

    def put(self, room: int, n: int, cost: float) -> int:
        """Put n ids into the cheapest sequence with just that room."""
        spent, sequence = heapq.heappop(self.heaps[room])
        self._mend(room)
        heapq.heappush(self.heaps[room - n], (spent + cost, sequence))
        self._mend(room - n)
        return sequence


def pack_lengths(lengths: list[int], capacity: int = 1024, cost: Cost | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every document of these lengths once."""
    cost = cost or Cost()
    pieces, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(doc, i * capacity, capacity) for i in range(whole)]
        if n % capacity:
            rests.append((n % capacity, doc, whole * capacity))
    out = [(doc, start, n, sequence, 0) for sequence, (doc, start, n) in enumerate(pieces)]
    base, rests = len(out), sorted(rests, key=lambda r: (-r[0], r[1]))
    used: dict[int, int] = {}
    room = _Room(-(-sum(n for n, _, _ in rests) // capacity), capacity)
    for n, doc, start in rests:
        while n:
            left = room.cheapest(n)
            part = n if left is not None else room.roomiest()
            sequence = room.put(left if left is not None else part, part, cost(part))
            out.append((doc, start, part, base + sequence, used.get(sequence, 0)))
            used[sequence] = used.get(sequence, 0) + part
            start, n = start + part, n - part
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, cost: Cost | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of a document.

    ``ids`` holds the piece's token ids as little-endian 32-bit integers; ``doc_tokens`` counts the
    document's ids with the closing ``end_id``. Null and empty texts are that one id. Every task packs its
    own rows, a window of ids at a time, so nothing is shuffled and memory is bounded; a sequence's id
    holds the task's partition, so a task that runs again gives the same rows. Null ids and repeated rows
    are packed like others; an empty table gives an empty result; other columns take no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        closing = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []
        window: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            pieces = pack_lengths([len(x) // 4 for x in window], capacity, cost)
            doc, start, length, place, offset = zip(*pieces, strict=True)
            ids = [window[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
            total = [len(window[d]) // 4 for d in doc]
            columns = [pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(total), pa.array([sequence + p for p in place]), pa.array(offset)]
            sequence += 1 + max(place)
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(names).take(pa.array(doc)), *columns], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            names.clear()
            window.clear()
            return out

        held = 0
        for batch in batches:
            at = 0
            for group in texts.text_groups(batch.column(1)):
                encoded = [x + closing for x in encoder.encode(group)]
                names.append(batch.column(0).slice(at, len(group)))
                window += encoded
                at += len(group)
                held += sum(map(len, encoded)) // 4
                if held >= WINDOW_TOKENS:
                    yield flush()
                    held = 0
            batch = group = encoded = None
            texts.release()
        if window:
            yield flush()
            texts.release()

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
