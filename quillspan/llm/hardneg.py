"""Hard negatives by distributed radix selection.

Each anchor asks for the k best rows whose scores lie in a window. Vectors and anchors meet in blocks, as often as there
are digits: a round counts, for each window, the scores by their leading digit (how far below the window's top they lie), the
counts of all blocks are added, and the digit that holds the k-th score becomes the new window. When a window is one score wide,
that is the k-th best, and a last meeting gathers the rows at or above it. Only counts travel before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.store import written

#: Vectors of a block, anchors of a block, and anchors that are scored together.
BLOCK = 4096
ANCHORS = 2048
TOGETHER = 64
#: Bits of a digit.
DIGIT = 11
#: Scores are exact; beyond 64 bits they count as the nearest long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def vectors(table: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, x): rows with integer components floor(scale * x), kept as doubles.

    Rows without an id or a label, and rows whose vector is null or holds null or non-finite components, are left out.
    Components that the scale would take out of the range of doubles count as its ends.
    """
    most = 1.7976931348623157e308
    held = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector_col, lambda c: c.cast("double")).alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor() of a double is a long, so it is taken only where that is exact; beyond 2^52 doubles are integers already.
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(F.least(F.greatest(c * scale, F.lit(-most)), F.lit(most)))
    kept = held.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    return kept.select("id", "label", F.transform("x", whole).alias("x"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as a matrix of doubles; shorter ones are continued with zeros."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs: by doubles where no sum can pass 53 bits, else by Python's integers."""
    most_q, most_x, width = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0), max(1, q.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        out = q @ x.T
        wide = np.argwhere(most_q[:, None] * most_x[None, :] >= 2.0**53 / width)
    out[tuple(wide.T)] = 0
    out = out.astype(np.int64)
    for i, j in wide:
        out[i, j] = min(max(sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)), LEAST), MOST)
    return out


_WINDOW = "array<struct<win:bigint,lo:bigint,hi:bigint,need:int>>"


def _meet(anchors: DataFrame, rows: DataFrame, same: bool, gather: bool) -> DataFrame:
    """Every block of anchors (row, label, x, windows) meets every block of rows once.

    Without ``gather``: (win, shift, digit, n), the scores of each window by digit; digits beyond the block's own ``need``-th best cannot
    hold the k-th of all, so they are not sent. With it: (win, id, score) of rows inside the windows, the ``need`` best of each block.
    """
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-anchors.count() // ANCHORS))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("row", "label", "x", "windows", deal(groups).alias("group"), each(blocks).alias("block"))
    right = rows.select("row", "id", "label", "x", deal(blocks).alias("block"), each(groups).alias("group"))
    schema = "win long, id long, score long" if gather else "win long, shift int, digit long, n long"
    names = [c.split()[0] for c in schema.split(", ")]

    def select(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
        width = max(max(map(len, asked["x"])), max(map(len, held["x"])))
        held = held.sort_values("id", kind="stable")
        x, ids, labels, own = matrix(held["x"], width), held["id"].to_numpy(), held["label"].to_numpy(), held["row"].to_numpy()
        for at in range(0, len(asked), TOGETHER):
            part = asked.iloc[at : at + TOGETHER]
            for score, row, label, windows in zip(scores(matrix(part["x"], width), x), part["row"], part["label"], part["windows"], strict=True):
                fits = ((labels == label) == same) & (own != row)
                score, fit_ids = score[fits], ids[fits]
                best = np.argsort(~score, kind="stable")  # descending, ties to the smaller id
                rising = score[best][::-1]
                for w in windows:
                    first, last = len(best) - np.searchsorted(rising, w["hi"], "right"), len(best) - np.searchsorted(rising, w["lo"], "left")
                    found = best[first : min(last, first + w["need"])]
                    if not len(found):
                        continue
                    win = np.full(len(found), w["win"])
                    if gather:
                        yield win, fit_ids[found], score[found]
                    else:
                        shift = max(0, (w["hi"] - w["lo"]).bit_length() - DIGIT)
                        below = np.uint64(w["hi"] & (1 << 64) - 1) - score[found].astype(np.uint64)
                        digit, n = np.unique((below >> np.uint64(shift)).astype(np.int64), return_counts=True)
                        yield win[: len(digit)], np.full(len(digit), shift), digit, n

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = list(select(asked, held)) if len(asked) and len(held) else []
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(run, schema)


def _narrowed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window shrunk to the digit that holds its ``need``-th score; where there are fewer, it stays and is done."""
    summed = counts.groupBy("win", "digit").agg(F.sum("n").alias("n"), F.max("shift").alias("shift"))
    order = Window.partitionBy("win").orderBy("digit")
    reached = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = summed.withColumn("reached", reached).join(windows.select("win", F.col("need").alias("wanted")), "win").filter("reached >= wanted")
    at = at.groupBy("win").agg(F.min("digit").alias("digit"), F.min("shift").alias("shift"), F.min("reached").alias("reached"), F.min_by("n", "digit").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    step = F.expr("shiftleft(1L, shift)").cast("decimal(20,0)")
    top = wide("hi") - F.col("digit").cast("decimal(12,0)") * step
    bottom = F.greatest(wide("lo").cast("decimal(38,0)"), (top - step + 1).cast("decimal(38,0)"))
    joined = windows.join(at, "win", "left")
    found = F.col("digit").isNotNull()
    return joined.select(
        "win",
        "row",
        F.when(found, bottom).otherwise(wide("lo")).cast("long").alias("lo"),
        F.when(found, top).otherwise(wide("hi")).cast("long").alias("hi"),
        "ceiling",
        F.when(found, F.col("need") - (F.col("reached") - F.col("n"))).otherwise(F.col("need")).cast("int").alias("need"),
        "k",
        (found & (F.col("shift") > 0)).alias("open"),
    )


def select_best(rows: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(win, id, score, rank): for each window (win, row, lo, hi) the k other rows of the anchor's label (or of other labels) with the best scores in [lo, hi].

    All, if they are fewer. Ties go to smaller ids. ``rows`` has (row, id, label, x); ``row`` names the anchor among them.
    """
    state = written(windows.filter("lo <= hi").select("win", "row", "lo", "hi", F.col("hi").alias("ceiling"), F.lit(k).alias("need"), F.lit(k).alias("k"), F.lit(True).alias("open")))

    def anchors(live: DataFrame, lo: str, hi: str, need: str) -> DataFrame:
        held = live.groupBy("row").agg(F.collect_list(F.struct("win", F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(need).alias("need"))).cast(_WINDOW).alias("windows"))
        return rows.select("row", "label", "x").join(held, "row")

    while not state.filter("open").isEmpty():
        live = state.filter("open")
        counts = _meet(written(anchors(live, "lo", "hi", "need")), rows, same, gather=False)
        state = written(_narrowed(live, counts).unionByName(state.filter("NOT open")))
    found = _meet(written(anchors(state, "lo", "ceiling", "k")), rows, same, gather=True)
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(table: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``table`` (id, label, x), see ``vectors``.

    Anchors are the rows for which ``asked`` holds; an anchor's positives are its best other rows of the same label, and the negatives of
    each are the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's, bounds included. A positive with a
    negative score has none. Every row of a repeated id is a row of its own (anchor, positive and negative); only the anchor's own row is left out.
    Vectors of unequal length are continued with zeros. No vectors or no anchors give no rows.
    """
    rows = written(table.select("id", "label", "x", F.monotonically_increasing_id().alias("row")))
    everything = rows.filter(asked).select(F.col("row").alias("win"), "row", F.lit(LEAST).cast("long").alias("lo"), F.lit(MOST).alias("hi"))
    spread = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))).alias("most"), F.max(F.size("x")).alias("width")).first()
    reach = (spread["width"] or 0) * (spread["most"] or 0.0) ** 2 if (spread["most"] or 0.0) < 2.0**31 else float("inf")
    if reach < 2.0**62:  # no score lies beyond, so fewer digits tell scores apart
        far = int(reach * (1 + 1e-9)) + 1
        everything = everything.withColumns({"lo": F.lit(-far).cast("long"), "hi": F.lit(far).cast("long")})
    best = select_best(rows, everything, positives, same=True)
    pairs = written(best.select(F.col("win").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank").withColumn("win", F.monotonically_increasing_id()))
    wide = F.col("positive_score").cast("decimal(38,0)")
    bound = lambda percent, up: F.floor((wide * percent + up) / F.lit(100).cast("decimal(5,0)")).cast("long")
    windows = pairs.filter("positive_score >= 0").select("win", "row", bound(low, 99).alias("lo"), bound(high, 0).alias("hi"))
    told = rows.select("row", F.col("id").alias("anchor_id"))
    chosen = select_best(rows, windows, negatives, same=False).select("win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(pairs.drop("rank"), "win").join(told, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
