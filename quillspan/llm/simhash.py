"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, components.

A fingerprint has 64 bits. It is split into six blocks; two fingerprints that differ in three bits or
fewer agree on at least three whole blocks, so they share one of the 20 keys made of three blocks.
Rows are joined on these keys and every candidate's Hamming distance is verified. A key that more than
``CROWD`` fingerprints share is split again by the same rule over its free bits (32, then 16, then 8 of
them), so no group is ever compared as a whole and none is cut: eight free bits hold 256 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.batches import map_texts
from quillspan.llm.store import cut, few, written

MAX_BITS = 3
BLOCKS = 6
CROWD = 512
LEVELS = 3
SEED = 42
_FOLD = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words (of all words, if fewer), repeats included; A-Z lower-cased."""
    folded = text.translate(_FOLD)
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    folded = folded.strip(b" ")
    if not folded:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(folded)]))
    n = max(1, len(starts) - words + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((digest(folded[a:b], SEED) for a, b in pairs), np.uint64, n)


def simhash(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes; zero without words."""
    hashes = shingle_hashes(text, words)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null and blank texts have 0."""

    def make(group: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([simhash(t, words) for t in group], np.uint64).view(np.int64))]

    return map_texts(docs, text_col, [id_col], "fp long", lambda: make)


def _split(mask: int) -> list[int]:
    """The masks that fix three of the six blocks into which the free bits of ``mask`` are dealt."""
    free = [i for i in range(64) if not mask >> i & 1]
    size, more = divmod(len(free), BLOCKS)
    starts = [i * size + min(i, more) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << i for i in free[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    return [mask | sum(c) for c in combinations(blocks, BLOCKS - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(level: int) -> list[int]:
    masks = [0]
    for _ in range(level):
        masks = [m for mask in masks for m in _split(mask)]
    return masks


def _linked(fp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each run: each fingerprint with the smallest of its class."""
    left, right = [], []
    i, d = np.arange(len(fp)), 1
    while (i := i[i + d < len(fp)]).size and (i := i[run[i] == run[i + d]]).size:
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
        left.append(near)
        right.append(near + d)
        d += 1
    label = np.arange(len(fp))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            least = np.minimum(label[a], label[b])
            after = label.copy()
            np.minimum.at(after, a, least)
            np.minimum.at(after, b, least)
            after = after[after]
            if (after == label).all():
                break
            label = after
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: links within each run of one key, or the rows of a crowded run, to be split again."""

    def out(kind: int, mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(mask.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "m", "a", "b"])

    def finish(m: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.concatenate(([True], (m[1:] != m[:-1]) | (value[1:] != value[:-1])))
        run = np.cumsum(first) - 1
        size = np.bincount(run)[run]
        if (hot := size > CROWD).any():
            yield out(1, m[hot], fp[hot], fp[hot])
        some = (size > 1) & ~hot
        a, b = _linked(fp[some], run[some])
        if len(a):
            yield out(0, np.zeros(len(a)), a, b)

    kept, crowded = None, None
    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        m, value, fp = cols
        if crowded is not None:  # the rest of a run already known as crowded
            more = (m == crowded[0]) & (value == crowded[1])
            n = int(more.argmin()) if not more.all() else len(more)
            if n:
                yield out(1, m[:n], fp[:n], fp[:n])
            m, value, fp = m[n:], value[n:], fp[n:]
            kept = None
            if not len(m):
                continue
            crowded = None
        last = (m == m[-1]) & (value == value[-1])
        n = len(m) - int(last[::-1].argmin()) if not last.all() else 0
        if n:
            yield from finish(m[:n], value[:n], fp[:n])
        if len(m) - n > CROWD:
            crowded, kept = (m[-1], value[-1]), None
            yield out(1, m[n:], fp[n:], fp[n:])
        else:
            kept = [m[n:], value[n:], fp[n:]]
    if kept is not None and len(kept[0]):
        yield from finish(*kept)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that connect all within three bits.

    A link joins two fingerprints that are connected by steps of three bits or fewer; together the links
    have the same components as all such pairs, without listing the pairs of a crowded group.
    """
    spark, found = fps.sparkSession, []
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value")) for i, mask in enumerate(_masks(1))])
    rows = fps.select("fp", F.explode(keys).alias("key")).select("key.m", "key.value", "fp")
    for level in range(1, LEVELS + 1):
        runs = cut(few(rows.repartition("m", "value").sortWithinPartitions("m", "value", "fp").mapInArrow(_scan_runs, "kind tinyint, m int, a long, b long")))
        found.append(runs.filter("kind = 0").select("a", "b"))
        crowded = runs.filter("kind = 1").select("m", F.col("a").alias("fp"))
        if level == LEVELS or crowded.isEmpty():
            break
        children = [(i // len(_masks(1)), i, _signed(mask)) for i, mask in enumerate(_masks(level + 1))]
        table = spark.createDataFrame(children, "m int, child int, mask long")  # at most 8,000 rows, whatever the input
        rows = crowded.join(F.broadcast(table), "m").select(F.col("child").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b) the smallest node reachable, by large-star and small-star steps.

    Each step groups by node, takes the least neighbour (combined before the shuffle) and joins it back on;
    both sides of the join are shuffled afresh, so that Spark can split a node of very many links.
    """

    def star(pairs: DataFrame) -> DataFrame:
        return cut(few(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))))

    def total(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = cut(few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()))
    state = total(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(star(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = cut(few(large.filter("u <> v").distinct()))
        least = star(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = cut(few(small.union(least.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()))
        state, before = total(now), state
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component): every document with its fingerprint and the smallest id of its component.

    Documents with one fingerprint are one node, so copies are grouped before anything is joined. Null and
    blank texts have fingerprint zero and link like any other; null ids and repeated rows keep their rows
    (a component of null ids alone is null). An empty table gives an empty result; other columns take no part.
    """
    marked = cut(few(fingerprints(docs, id_col, text_col, words)))
    nodes = _nodes(marked, id_col)
    return _placed(marked, nodes, cut(few(components(links(nodes.select("fp"))))), id_col)


def _nodes(marked: DataFrame, id_col: str) -> DataFrame:
    return cut(few(marked.groupBy("fp").agg(F.min(id_col).alias("least_id"))))


def _placed(marked: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    joined = roots.join(nodes, roots.node == nodes.fp).select("node", "root", "least_id")
    named = cut(few(joined.groupBy("root").agg(F.min("least_id").alias("component"))))
    placed = roots.join(named, "root").select(F.col("node").alias("fp"), "component")
    whole = cut(few(nodes.join(placed, "fp", "left").select("fp", F.coalesce("component", "least_id").alias("component"))))
    return marked.join(whole, "fp").select(id_col, "fp", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest id (of its several texts, that of the smallest hash).

    Texts are linked by fingerprints within three bits, as in ``near_groups``, and by a Jaccard similarity of
    their five-word runs of 0.8 or more. Rows without an id stay as they are; of rows alike in id and text one
    stays. Null and blank texts are copies of each other; an empty table gives an empty result.
    """
    from quillspan.llm import similar  # which builds on this module

    text = next(name for i in range(len(docs.columns) + 1) if (name := f"text_hash_{i}") not in docs.columns)
    known = docs.filter(F.col(id_col).isNotNull()).withColumn(text, F.xxhash64(text_col))
    marked = written(few(similar.mark(known, [id_col, text], text_col, words)))
    nodes = written(few(_nodes(marked, id_col)))
    roots = similar.similar_roots(known, marked, links(nodes.select("fp")), id_col, text_col)
    placed = marked.select(F.struct(F.col(id_col).alias("id"), F.col(text).alias("text")).alias("row"), "fp").join(roots, F.col("fp") == F.col("node"), "left")
    keep = placed.groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row")).select(F.col("row.id").alias(id_col), F.col("row.text").alias(text))
    one = known.join(keep, [id_col, text], "left_semi").dropDuplicates([id_col, text])
    return one.select(docs.columns).union(docs.filter(F.col(id_col).isNull()))
