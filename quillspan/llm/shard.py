"""Sharding: a keyed Feistel permutation of global row numbers.

Row r of n goes to place p = permute(r, n); its shard is ``p mod shards`` and its slot ``p div shards``.
So shard sizes differ by one row at most, slots have no gaps, the shuffle depends on nothing but the
order of the ids and the key, and both directions can be computed for any single row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.store import cut

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over x and the round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[int]:
    seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(k) for k in _mix(seeds, key % 2**64)]


def _once(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    """One pass of the Feistel network over ``2 * half`` bits."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, key: int = 0, back: bool = False) -> np.ndarray:
    """Places of the rows (or with ``back`` the rows of the places) under a permutation of ``0 .. n-1``.

    The network permutes a power of four not less than n (below ``4 n``). A value that leaves the range
    walks on along its cycle until it is back inside, which ends because the start is inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _round_keys(key)
    with np.errstate(over="ignore"):
        out = _once(rows.astype(np.uint64), half, keys, back)
        while (far := np.flatnonzero(out >= np.uint64(max(n, 1)))).size:
            out[far] = _once(out[far], half, keys, back)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Add gapless global row numbers from 0 in the order of the columns ``order`` (nulls first); also the row count.

    The rows are range-partitioned and sorted, and their place in their partition is written down once;
    only the partitions' counts pass through the driver. Rows that tie in ``order`` are numbered as they
    come: give enough columns to tell rows apart.
    """
    part, place = f"{name}_part", f"{name}_place"
    spread = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    fixed = cut(spread.withColumn(place, F.monotonically_increasing_id()))
    counts = fixed.groupBy(F.shiftright(place, 33).alias("part")).count().collect()
    before, total = {}, 0
    for part_id, count in sorted((r["part"], r["count"]) for r in counts):
        before[part_id], total = total, total + count
    offsets = fixed.sparkSession.createDataFrame([(int(k), v) for k, v in before.items()] or [(0, 0)], f"{part} long, {name}_before long")
    numbered = fixed.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part)  # a row for each partition
    return numbered.withColumn(name, F.col(f"{name}_before") + F.col(place).bitwiseAND((1 << 33) - 1)).drop(part, place, f"{name}_before"), total


def place_of(row: Column, n: int, key: int = 0) -> Column:
    """The permuted place of a row number, as a column."""

    @F.pandas_udf("long")
    def feistel(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, key))

    return feistel(row)


def shard(docs: DataFrame, shards: int, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards 0 .. shards-1: (id, size, text_crc32, shard, slot).

    ``size`` is the text's UTF-8 bytes plus 8 (null text: no bytes, checksum of nothing). Null ids come
    first; rows with one id are told apart by size and checksum, and rows alike in all of these are
    interchangeable, so the result is the same each time. An empty table gives an empty result, and
    further columns of ``docs`` take no part. Texts never leave the scan: what is shuffled is three
    numbers a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered, n = number_rows(facts, [id_col, "size", "text_crc32"], "feistel_row")
    place = numbered.withColumn("feistel_place", place_of(F.col("feistel_row"), n, key))
    return place.select(id_col, "size", "text_crc32", (F.col("feistel_place") % shards).cast("int").alias("shard"), F.floor(F.col("feistel_place") / F.lit(shards)).cast("long").alias("slot"))
