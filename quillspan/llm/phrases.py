"""Phrase mining: count-min sketches find what may be frequent, a second pass counts just that exactly.

The first pass adds every run of 1 to 4 words to a sketch of small counters, which never counts too little. Tasks' sketches are
merged block by block, and of a merged counter only one bit is kept: whether it reached the least count. The second pass
drops every run with a bit missing (its own, or one of a shorter run inside it) and counts the rest exactly. Scores and subsumption
are joins over the exact table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.batches import text_groups
from quillspan.llm.store import written

#: Words of the longest phrase.
LONGEST = 4
#: Rows of a sketch and counters of a row (a power of two, at most 2^32); a counter is a byte up to a least count of 255.
ROWS = 2
WIDTH = 1 << 25
#: Counters that travel and are merged together, and sketches that one task merges.
SKETCH_BLOCK = 1 << 19
FAN_IN = 64
#: Phrases that a task counts before it hands them on, and rows that it hands on at a time.
TABLE, HANDED = 800_000, 100_000
#: Marks the end of a piece; no text in UTF-8 has this byte.
_END = b"\xff"
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """The words of some texts of one language, as integers, and their runs of 1 to ``LONGEST`` words within pieces."""

    def __init__(self, lang: bytes, texts: list[bytes]) -> None:
        data = (b" " + _END + b" ").join(texts).lower().translate(_MARKS).replace(_END, b" " + _END + b" ")
        words = data.split(b" ")
        self.words = [w for w in dict.fromkeys(words) if w and w != _END]
        number = {w: i for i, w in enumerate(self.words)} | {b"": -2, _END: -1}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids = ids[ids != -2]
        piece = np.cumsum(ids == -1)
        self.ids, self.piece = ids[ids >= 0], piece[ids >= 0]
        seed = xxhash.xxh64_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def starts(self, n: int) -> np.ndarray:
        """For each word but the last n - 1: whether n words from there on are one run."""
        last = len(self.ids) - n + 1
        return self.piece[: max(0, last)] == self.piece[n - 1 :] if last > 0 else np.zeros(0, bool)

    def hashed(self) -> Iterator[np.ndarray]:
        """For n = 1, 2, ...: a hash of the n words from each place on (whether they are one run or not)."""
        own = self.hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        run = own
        for n in range(1, LONGEST + 1):
            if n > 1:
                run = (run[:-1] ^ (run[:-1] >> np.uint64(29))) * _MIX + own[n - 1 :]
            mixed = (run ^ (run >> np.uint64(32))) * _MIX
            yield mixed ^ (mixed >> np.uint64(29))


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Each hash's counter in a row: rows take bits of their own as far as there are any, then mix anew."""
    if row > 1:
        hashes = (hashes + np.uint64(row)) * _MIX
        hashes = hashes ^ (hashes >> np.uint64(32))
    return ((hashes >> np.uint64(32 * (row % 2))) & np.uint64(width - 1)).astype(np.uint32)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, Runs]]:
    """The texts of a partition in groups of bounded size, by language."""
    for batch in batches:
        at, langs = 0, batch.column(1).cast(pa.binary()).to_pylist()
        for group in text_groups(batch.column(0)):
            some: dict[bytes, list[bytes]] = {}
            for lang, text in zip(langs[at : at + len(group)], group, strict=True):
                some.setdefault(lang, []).append(text)
            at += len(group)
            for lang, texts in some.items():
                yield lang, Runs(lang, texts)


def _counter(least: int) -> type[np.unsignedinteger]:
    return np.uint8 if least <= 0xFF else np.uint16 if least <= 0xFFFF else np.uint32


def _few(docs: DataFrame) -> DataFrame:
    """Texts and languages in two tasks for each core: what a task sums up before the shuffle grows less than its input."""
    return docs.select("text", "lang").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def add(sketch: np.ndarray, hashes: np.ndarray, times: np.ndarray, least: int) -> None:
    """Adds distinct runs with their counts. A counter is raised no further than the runs that it stands for may have come (the least of a run's counters, and what is added), at most to ``least``.

    So the least of a run's counters never falls below its count, and the sums of several sketches' counters do not either; but rare runs that share a counter fill it less than by their sum.
    """
    cells = [_cells(hashes, row, sketch.shape[1]) for row in range(len(sketch))]
    may_be = np.minimum.reduce([sketch[row, cell] for row, cell in enumerate(cells)])
    now = np.minimum(may_be + times, least).astype(sketch.dtype)
    for row, cell in enumerate(cells):
        np.maximum.at(sketch[row], cell, now)


def width_for(docs: DataFrame) -> int:
    """Counters of a row by the size of the input's files as far as it is known: more runs need more, else all counters fill up and the second pass counts all runs. At most 2^27, which are 256 MB in a task."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return WIDTH << (0 if size < 3 << 29 or size >> 62 else 1 if size < 3 << 30 else 2)


def sketches(docs: DataFrame, least: int, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(part, block, counters): each task's sketch of all runs of its documents (text, lang), in compressed blocks.

    Counters stop at ``least``, since only whether they reach it is asked. Tasks are few (two for each core), because each has a whole sketch.
    """
    kind, size = _counter(least), min(SKETCH_BLOCK, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sketch = TaskContext.get().partitionId(), np.zeros((rows, width), kind)
        for _, runs in _by_lang(batches):
            for n, hashes in enumerate(runs.hashed(), 1):
                hashes, times = np.unique(hashes[runs.starts(n)], return_counts=True)
                add(sketch, hashes, times, least)
        flat, pack = sketch.reshape(-1), zstandard.ZstdCompressor(level=1).compress
        for block in range(0, len(flat), size):
            piece = flat[block : block + size]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block // size], pa.int32()), "counters": pa.array([pack(piece.tobytes())], pa.binary())})

    return _few(docs).mapInArrow(run, "part int, block int, counters binary")


def merged(parts: DataFrame, least: int) -> np.ndarray:
    """One bit for each counter, packed: whether the sum of all sketches reaches ``least``. A task merges at most ``FAN_IN`` blocks at a time."""
    kind = _counter(least)

    def merge(final: bool):
        def run(table: pa.Table) -> pa.Table:
            total, unpack = None, zstandard.ZstdDecompressor().decompress
            for value in table.column("counters"):
                one = np.frombuffer(unpack(value.as_py()), kind).astype(np.int64)
                total = one if total is None else np.minimum(total + one, least)
            out = np.packbits(total >= least).tobytes() if final else zstandard.ZstdCompressor(level=1).compress(total.astype(kind).tobytes())
            return table.select(["part", "block"]).slice(0, 1).append_column("counters", pa.array([out], pa.binary()))

        return run

    most = parts.sparkSession.sparkContext.defaultParallelism * 2
    while True:
        final = most <= FAN_IN
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "block")
        parts = grouped.applyInArrow(merge(final), "part int, block int, counters binary")
        if final:
            break
        most = -(-most // FAN_IN)
    return parts


def frequent(docs: DataFrame, least: int, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(lang, words, phrase, a): the runs of 1 to 4 words that occur ``least`` times or more in their language, with exact counts; all words under 0.

    The sketch's bits (``rows * width`` of them: 8 MB, whatever the input) pass through the driver to every task.
    """
    size, bits = min(SKETCH_BLOCK, width), np.zeros(rows * width // 8, np.uint8)
    for block, packed in merged(sketches(docs, least, width, rows), least).select("block", "counters").toLocalIterator():
        bits[block * size // 8 : block * size // 8 + len(packed)] = np.frombuffer(packed, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def may_be(hashes: np.ndarray) -> np.ndarray:
        known = shared.value
        out = np.ones(len(hashes), bool)
        for row in range(rows):
            cell = _cells(hashes, row, width).astype(np.int64) + row * width
            out &= (known[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def counted(runs: Runs) -> Iterator[tuple[bytes, int]]:
        """Exact counts of the runs that may be frequent: equal runs are told by the words' numbers, never by hashes."""
        before, key = None, runs.ids
        for n, hashes in enumerate(runs.hashed(), 1):
            good = runs.starts(n)
            if before is not None:
                good = good & before[: len(good)] & before[1 : len(good) + 1]
            good[good] = may_be(hashes[good])
            at = np.flatnonzero(good)
            # a run is the number of the run that lacks its last word, and that word
            pair = key[at] if n == 1 else key[at] << 32 | runs.ids[at + n - 1]
            distinct, first, inverse, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            for i, t in zip(at[first].tolist(), times.tolist(), strict=True):
                yield b" ".join(runs.words[w] for w in runs.ids[i : i + n].tolist()), t
            key = np.full(len(runs.ids), -1)
            key[at] = inverse
            before = good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bytes, dict[bytes, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                entries = iter(table.items())
                while some := list(islice(entries, HANDED)):
                    phrases, times = zip(*some, strict=True)
                    words = [p.count(b" ") + 1 if p else 0 for p in phrases]
                    text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": text([lang] * len(some)), "words": pa.array(words, pa.int32()), "phrase": text(phrases), "a": pa.array(times, pa.int64())})
            tables.clear()

        for lang, runs in _by_lang(batches):
            table = tables.setdefault(lang, {})
            table[b""] = table.get(b"", 0) + len(runs.ids)
            for phrase, times in counted(runs):
                table[phrase] = table.get(phrase, 0) + times
            if sum(map(len, tables.values())) >= TABLE:
                yield from out()
        yield from out()

    found = _few(docs).mapInArrow(run, "lang string, words int, phrase string, a long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("words") == 0))


def _words(n_words: Column) -> Column:
    return F.array_join(n_words, " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, lang_col: str = "lang", text_col: str = "text", width: int | None = None, rows: int = ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words of each language (null: ``und``).

    A phrase has words of one piece (between ``. , ; : ! ?`` and line ends), ASCII letters in lower case, and occurs ``least`` times or more. Its score is
    ``floor(2000000 a / (l + r))`` at its worst cut into a first part (l occurrences) and a rest (r), ties to the shorter first part. Phrases that lie in a longer
    one with at least ``cover`` percent of their occurrences are left out. Order: score, then occurrences, both descending, then the phrase's bytes. Null and empty texts
    have no words; repeated rows count each; ids are not read. No documents give no rows. All counts are exact, whatever the sketch's size.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    found = written(frequent(texts, least, width or width_for(docs), rows))
    known, totals = found.filter("words > 0"), found.filter("words = 0").select("lang", F.col("a").alias("n"))
    longer = known.filter("words >= 2").withColumn("split", F.split("phrase", " "))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _words(F.slice("split", F.lit(1), F.col("k"))).alias("first"), _words(F.slice("split", F.col("k") + 1, F.col("words"))).alias("rest"))
    counts = known.select("lang", "phrase", "a")
    part = lambda name, alias: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(alias))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) DIV (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    worst = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("worst"))
    inside = longer.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inside.groupBy("lang", _words(F.slice("split", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("above"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter(F.expr(f"above IS NULL OR cast(above as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(cover)}"))
    order = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
