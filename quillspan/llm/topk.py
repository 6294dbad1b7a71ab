"""Exact top-k by inner product: an impact-ordered index, read score at a time.

Vectors are dealt into blocks. In a block every component is a list of postings, cut into segments of
one quantised impact (``x // STEP``). For a query each segment has a least contribution; what it adds to the
least one of its component is the segment's gain. Segments are read by descending gain, whole blocks of
postings at a time, into accumulators, which are lower bounds less a constant. What is still unread can add
at most the largest unread gain of each component plus the width of the quantisation, so a vector whose
accumulator lies further below the k-th best is proved out. Reading stops when few enough are left (or
all is read), and those are scored exactly. Nothing else is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import hardneg
from quillspan.llm.store import written

#: Width of a quantised impact, vectors of an index block, queries of a block.
STEP = 8
BLOCK = 8192
QUERIES = 1024
#: Reading stops once at most this many vectors (or an eighth of the block) may still be members.
FEW = 64
#: Segments that are read between two looks at the proof.
ROUND = 128


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): integer vectors floor(scale * x) as doubles, without those that have no id, are null or hold null or non-finite components."""
    return hardneg.vectors(vectors, id_col, vector_col, F.lit(0), scale).select("id", F.col("x").alias("v"))


class Block:
    """The postings of some vectors: for each component the rows by quantised impact, and the segments' bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.own, self.x = ids[order], rows[order], np.ascontiguousarray(x[order])
        level = (self.x // STEP).T
        self.rows = np.argsort(level, axis=1, kind="stable").astype(np.int32)
        component, first, low = [], [], []
        for d, (row, by) in enumerate(zip(level, self.rows, strict=True)):
            sorted_level = row[by]
            at = np.flatnonzero(np.concatenate(([True], sorted_level[1:] != sorted_level[:-1])))
            component.append(np.full(len(at), d))
            first.append(d * len(self.ids) + at)
            low.append(sorted_level[at] * STEP)
        self.component, self.first, self.low = map(np.concatenate, (component, first, low))
        self.end = np.append(self.first[1:], self.rows.size)
        self.rows = self.rows.reshape(-1)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than the row ``own`` (all, if fewer), ties to the smaller id."""
        n = len(self.ids)
        q = np.pad(q, (0, max(0, self.x.shape[1] - len(q))))[: self.x.shape[1]]
        mine = np.flatnonzero(self.own == own)
        want = min(k, n - len(mine))
        if want <= 0:
            return self.ids[:0], self.ids[:0]
        weight = q[self.component]
        least = np.where(weight >= 0, weight * self.low, weight * (self.low + STEP - 1))
        floor = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.component, least)
        gain = least - floor[self.component]
        width = int(np.abs(q).sum()) * (STEP - 1)
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        sums, members = np.zeros(n), np.arange(n)
        for at in range(0, len(order) + 1, ROUND):
            read = order[at : at + ROUND]
            if len(read):
                size = self.end[read] - self.first[read]
                where = np.repeat(self.first[read] - np.cumsum(size) + size, size) + np.arange(size.sum())
                sums += np.bincount(self.rows[where], np.repeat(gain[read], size), n)
                sums[mine] = -np.inf
            unread = order[at + ROUND :]
            best = np.zeros(len(q))
            np.maximum.at(best, self.component[unread], gain[unread])
            reach = best.sum() + width
            bar = np.partition(sums, n - want)[n - want]
            members = np.flatnonzero(sums >= bar - reach)
            if len(members) <= max(FEW, n // 8) or not len(unread):
                break
        members = members[self.own[members] != own]
        score = self.x[members] @ q
        top = np.lexsort((self.ids[members], -score))[:k]
        return self.ids[members][top], score[top]


def top_k(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (id, v) for which ``asked`` holds the k other rows of highest inner product.

    Every block of vectors meets every block of queries once; both block counts follow the row counts. Each
    meeting yields at most k rows a query, of which the best k are kept. Rows are numbered and written down
    once. A repeated id is several candidates and, if asked, several queries with k rows each (of equal ranks);
    only a query's own row is left out. Ties go to the smaller id. Vectors of unequal length are continued with
    zeros. Vectors with components so wide that a sum could pass 53 bits stay out of the index and are scored in Python's integers; a
    score beyond 64 bits counts as the nearest long. No vectors or no queries give no rows.
    """
    rows = written(vectors.select("id", "v", F.monotonically_increasing_id().alias("row")))
    queries = rows.filter(asked)
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "row", "v", deal(groups).alias("group"), each(blocks).alias("block"))
    right = rows.select("id", "row", "v", deal(blocks).alias("block"), each(groups).alias("group"))
    kinds = "query_row long, query_id long, vec_id long, score long"

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(asked) and len(held):
            width = max(1, *asked["v"].map(len), *held["v"].map(len))
            q, x = hardneg.matrix(asked["v"], width), hardneg.matrix(held["v"], width)
            ids, rows = held["id"].to_numpy(np.int64), held["row"].to_numpy(np.int64)
            narrow = (2.0**52 / width) ** 0.5
            wide = np.abs(x).max(axis=1) > narrow
            block = None if wide.all() else Block(ids[~wide], rows[~wide], x[~wide].astype(np.int64))
            for query_id, own, vector in zip(asked["id"], asked["row"], q, strict=True):
                if block is None or np.abs(vector).max() > narrow:
                    found, scores, apart = ids[:0], ids[:0], rows != own
                else:
                    found, scores = block.search(vector.astype(np.int64), own, k)
                    apart = wide & (rows != own)
                if apart.any():
                    found, scores = np.append(found, ids[apart]), np.append(scores, hardneg.scores(vector[None], x[apart])[0])
                    best = np.lexsort((found, ~scores))[:k]
                    found, scores = found[best], scores[best]
                yield pd.DataFrame({"query_row": own, "query_id": query_id, "vec_id": found, "score": scores})

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({c.split()[0]: [] for c in kinds.split(", ")}, dtype="int64"), *meet(asked, held)])

    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(run, kinds)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
