"""Near copies by exact similarity: prefixes of rare word runs name candidates, the Jaccard similarity of word runs decides.

A text is the set of its five-word runs. All runs are put in one order, rare ones first. Two sets of which
one has n runs can only be similar by 0.8 if they share a run among the first n - 0.8 n + 1 of each: so texts
meet on these, and no pair is missed. The order rests on counts over all texts, kept in a table of fixed size by
hashes of runs: a passage that many texts share comes last in all of them and makes no candidates. Any order
would give the same result; this one makes it cheap.

Texts that share a run are compared if the places of the run allow it: the first run in order that two sets share
has all others behind it in both, so they share no more than the fewer runs that one of them has from there on.
If that is too few, either they share an earlier run and meet there, or they are not similar. Each text is
compared with the one that has the run at the earliest place (of a text and its edited copies that is the text) and with the
next one in the order of sizes, then with farther ones as long as the run still brings together texts of different
groups; so a group of copies costs a few comparisons a text, and no pair is left out. Before the runs of two texts are fetched, their sketches must allow the
similarity: maps of bits that their runs set, of a size that follows theirs. A bit that one has alone is a run that the other lacks, so
no similar pair fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.batches import map_texts, release, text_groups
from quillspan.llm.simhash import components, shingle_hashes, simhash
from quillspan.llm.store import dropped, few, forgotten, written

WORDS = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Each further comparison reaches so many times as far.
REACH = 8
#: Bits of the map of ids whose runs are fetched, as a power of two.
MAP_BITS = 23
#: Counts of runs are kept for so many bits of their hashes: two megabytes, whatever the input.
COUNT_BITS = 18


def runs(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word runs, in order."""
    return np.unique(shingle_hashes(text, WORDS))


def digest(words: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(words.tobytes())], np.uint64).view(np.int64)[0])


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def run_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many runs of all texts fall into each slot. Every task sums up its own; the slots come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for group in text_groups(batch.column(0)):
                total += np.bincount(_slot(np.concatenate([runs(t) for t in group])), minlength=len(total))
            batch = group = None
            release()
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    out = np.zeros(1 << COUNT_BITS, np.int64)
    found = docs.select(text_col).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of which a similar text must share one: the first in the order of counts and hashes."""
    n = len(words)
    order = np.argsort(counts[_slot(words)], kind="stable")  # the hashes are in order
    return words[order[: n - -(-NUM * n // DEN) + 1]] if n else words


def sketch(words: np.ndarray) -> bytes:
    """A map of bits that the runs set, four to eight for each run (64 at least)."""
    size = max(64, 4 << len(words).bit_length())
    out = np.zeros(size, bool)
    out[(words >> np.uint64(20)).astype(np.int64) & (size - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_be_similar(one: bytes, n: int, other: bytes, m: int) -> bool:
    """For the sketches of sets of n and m runs: is a similarity of 0.8 possible?

    A bit that only one of them has stands for a run at least that the other lacks. Of two sizes the larger map is folded,
    which can only hide differences. So no pair that is similar fails.
    """
    a, b, bits = _bits(one, len(other)), _bits(other, len(one)), NUM + DEN
    return bits * (a & ~b).bit_count() <= DEN * n - NUM * m and bits * (b & ~a).bit_count() <= DEN * m - NUM * n


def _bits(sketched: bytes, size: int) -> int:
    """A sketch as a number, folded to ``size`` bytes if it has more."""
    value, half = int.from_bytes(sketched, "little"), len(sketched) * 4
    while half >= size * 8:
        value, half = value >> half | value & (1 << half) - 1, half // 2
    return value


def mark(docs: DataFrame, carry: list[str], text_col: str, words: int) -> DataFrame:
    """(*carry, fp, d, n, sketch, keys): SimHash fingerprint, digest, number, sketch and prefix of the distinct runs (32 bits of each)."""
    counts = docs.sparkSession.sparkContext.broadcast(run_counts(docs, text_col))

    def make(group: list[bytes]) -> list[pa.Array]:
        sets = [runs(t) for t in group]
        keys = [prefix(s, counts.value) for s in sets]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        fps = np.array([simhash(t, words) for t in group], np.uint64).view(np.int64)
        short = (np.concatenate(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        return [pa.array(fps), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(short))]

    return map_texts(docs, text_col, carry, "fp long, d long, n int, sketch binary, keys array<int>", lambda: make)


def _sets(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(d, words): the distinct runs of the texts whose id may be among ``ids``, each text once.

    A map of 2^23 bits, which passes more than it need where it fills up, is all that goes around. Texts are not
    shuffled, and a task has one Python worker: a filter in Python before this would start another.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS))
    bits = ids.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table, found = np.zeros(1 << MAP_BITS - 6, np.int64), bits.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            asked = batch.column(1).filter(pa.array((held.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for group in text_groups(asked):
                sets = [runs(t) for t in group]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["d", "words"])
            batch = asked = group = sets = None
            release()

    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(1 << MAP_BITS)).alias("bit"), F.col(text_col).alias("run_text"))
    return rows.mapInArrow(run, "d long, words array<long>").dropDuplicates(["d"])


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (d1, a, d2, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [may_be_similar(*pair) for pair in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)]
            yield batch.filter(pa.array(fits, pa.bool_())).select(["d1", "a", "d2", "b"])

    side = lambda k: texts.select(F.col("d").alias(f"d{k}"), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    both = pairs.join(side(1), "d1").join(side(2), "d2")
    return both.select("d1", "a", "d2", "b", "s1", "n1", "s2", "n2").mapInArrow(run, "d1 long, a long, d2 long, b long")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of their fingerprint as ``label``, of those keys alone that bring together different labels."""
    whole = Window.partitionBy("key")
    named = rows.join(roots, rows["fp"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "fp").alias("label"))
    return named.withColumns({"lo": F.min("label").over(whole), "hi": F.max("label").over(whole)}).filter("lo <> hi").drop("lo", "hi")


def similar_roots(docs: DataFrame, marked: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, root) over fingerprints: the components of the links ``known`` (a, b) and of all texts similar by 0.8 or more."""
    full = marked.filter("n > 0")
    texts = written(few(full.groupBy("d").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min(id_col).alias("id"), F.first("sketch").alias("sketch"))))
    same = full.select(F.col("fp").alias("b"), "d").distinct().join(texts.select("d", F.col("fp").alias("a")), "d").filter("a <> b").select("a", "b")
    edges = written(few(known.union(same).distinct()))
    roots = written(few(components(edges)))
    key = Window.partitionBy("key")
    each = full.groupBy("d").agg(F.first("keys").alias("keys")).select("d", F.posexplode("keys").alias("at", "key"))
    met = each.withColumns({"lo": F.min("d").over(key), "hi": F.max("d").over(key)}).filter("lo <> hi").select("key", "d", "at")
    shared = written(few(_labelled(met.join(texts.select("d", "n", "fp"), "d"), roots).drop("label").withColumn("rest", F.col("n") - F.col("at"))))
    by_size, low, high = Window.partitionBy("key").orderBy("n", "d"), 1, 1
    while True:
        who = F.struct("at", "n", "d", "fp", "label", "rest")
        beside = F.collect_list(who).over(by_size.rowsBetween(low, high))
        if low == 1:
            beside = F.concat(beside, F.array(F.min(who).over(key)))
        seen = _labelled(shared, roots).select("d", "n", "fp", "label", "rest", beside.alias("beside"), F.lead("n", high + 1).over(by_size).alias("beyond"))
        others = F.filter("beside", lambda o: (o["label"] != F.col("label")) & ((NUM + DEN) * F.least("rest", o["rest"]) >= NUM * (F.col("n") + o["n"])))
        ahead = seen.select("d", "fp", F.transform(others, lambda o: F.struct(o["d"].alias("d"), o["fp"].alias("fp"))).alias("others"), F.coalesce((NUM + DEN) * F.col("rest") >= NUM * (F.col("n") + F.col("beyond")), F.lit(False)).alias("farther"))
        ahead = written(few(ahead.filter(F.col("farther") | (F.size("others") > 0))))
        pairs = ahead.select(F.col("d").alias("d1"), F.col("fp").alias("a"), F.explode("others").alias("o")).select("d1", "a", F.col("o.d").alias("d2"), F.col("o.fp").alias("b")).distinct()
        possible = written(few(_possible(pairs, texts)))
        asked = written(few(possible.select(F.col("d1").alias("d")).union(possible.select("d2")).distinct().join(texts.select("d", "id"), "d")))
        sets = written(few(_sets(docs, id_col, text_col, asked).join(asked.select("d"), "d", "left_semi")))
        both = possible.join(sets.select(F.col("d").alias("d1"), F.col("words").alias("w1")), "d1").join(sets.select(F.col("d").alias("d2"), F.col("words").alias("w2")), "d2")
        alike = (NUM + DEN) * F.size(F.array_intersect("w1", "w2")) >= NUM * (F.size("w1") + F.size("w2"))
        more = written(few(both.filter(alike).select("a", "b").distinct()))
        if not more.isEmpty():
            before, edges = (edges, roots), written(few(edges.union(more)))
            roots = written(few(components(edges)))
            dropped(*before)
        last = ahead.filter("farther").isEmpty()
        dropped(ahead, possible, asked, sets, more)
        del seen, pairs, both, alike, ahead, possible, asked, sets, more
        forgotten(docs)
        if last:
            dropped(texts, shared, edges)
            return roots
        low, high = high + 1, high * REACH
