"""Quality: a linear-chain conditional random field that labels every line of a document good or bad.

A line's features are its own and those of its neighbours. Only documents have labels, and a bad document
may hold good lines: so lines are first told apart by themselves, each taken to be as its document; then
the lines of good documents and those lines of bad ones that look good are the good lines that the field
is fitted on. Forward-backward gives each line's probability of being good; their mean, weighted by the
lines' lengths, is turned into a document's score by a logistic curve fitted on the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.batches import map_texts
from quillspan.llm.store import written

#: Labelled documents that the model is fitted on, and the lines of all of them together.
SAMPLE, SAMPLE_LINES = 6000, 200_000
STEPS, RATE, RIDGE = 250, 0.1, 1e-5
#: Bytes of texts that are scored together: while features are worked out, they take about 25 times as much.
GROUP_BYTES = 1 << 19

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BANG, _SIGN, _HIGH = range(8)
_CLASSES = [
    (range(65, 91), _UPPER),
    (range(97, 123), _LOWER),
    (range(48, 58), _DIGIT),
    (b" \t\n\v\f\r", _SPACE),
    (b".,;:?'\"()-", _STOP),
    (b"!", _BANG),
    (b"#$%&*+/<=>@[\\]^_`{|}~", _SIGN),
    (range(128, 256), _HIGH),
]
_KIND = np.full(256, _SIGN, np.uint8)
for _bytes, _kind in _CLASSES:
    _KIND[list(_bytes)] = _kind
_HASH = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
OWN = 10
FEATURES = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines that are not blank, and each text's number of lines.

    A text without any such line counts as one line of no length.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[joined]
    end = np.flatnonzero(joined == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    owner = np.searchsorted(text_end, start)

    def per_line(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
        return total[end] - total[start]

    count = [per_line(kind == k) for k in range(8)]
    size = end - start
    solid = size - count[_SPACE] + (kind[end] != _SPACE)
    filled = solid > 0
    bare = np.bincount(owner, filled, len(texts)) == 0
    keep = filled | (bare[owner] & (start == np.concatenate(([0], text_end[:-1] + 1))[owner]))

    blank = kind == _SPACE
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    last = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
    line = np.searchsorted(end, first)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_HASH[joined], dtype=np.uint64)))
    word = sums[last + 1] - sums[first]
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (line[1:] == line[:-1]) & ((last - first)[1:] == (last - first)[:-1])))
    lone_sign = (first == last) & (kind[first] == _SIGN)
    lines = len(end)
    words = np.maximum(np.bincount(line, minlength=lines), 1)
    chars = np.maximum(solid, 1)
    letters = np.maximum(count[_UPPER] + count[_LOWER] + count[_HIGH] // 2, 1)
    short = np.bincount(line, (last - first) < 3, lines)
    own = np.stack(
        [
            count[_UPPER] / letters,
            count[_SIGN] / chars * 4,
            count[_BANG] / words,
            count[_DIGIT] / chars,
            count[_STOP] / words,
            np.bincount(line, again, lines) / words,
            np.bincount(line, lone_sign, lines) / words,
            short / words,
            np.log1p(size) / 5,
            solid / words / 10,
        ],
        axis=1,
    )[keep]
    owner, size = owner[keep], size[keep]
    same = owner[1:] == owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate((own, before, after, np.ones((len(own), 1))), axis=1), size, np.bincount(owner, minlength=len(texts))


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Chain:
    """Weights of a line's being good, of the step from one label to the next (0 bad, 1 good), and of the curve over a document's mean."""

    line: np.ndarray
    step: np.ndarray
    curve: np.ndarray

    def means(self, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Each text's probability of a good line, weighted by length."""
        p, _ = self.marginals(x, count)
        owner = np.repeat(np.arange(len(count)), count)
        return np.bincount(owner, p * (size + 1), len(count)) / np.bincount(owner, size + 1, len(count))

    def scores(self, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _logistic(self.curve[0] + self.curve[1] * self.means(x, size, count))

    def marginals(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good, and the expected number of steps from label to label over all texts."""
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.line
        order = np.argsort(-count, kind="stable")
        first = (np.cumsum(count) - count)[order]
        length = count[order]
        active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length.max(initial=0)))]  # texts with over t lines
        forward, backward, expected = np.empty_like(score), np.zeros_like(score), np.zeros((2, 2))
        for t, n in enumerate(active):
            at = first[:n] + t
            forward[at] = score[at] + (np.logaddexp(forward[at - 1, :1] + self.step[0], forward[at - 1, 1:] + self.step[1]) if t else 0)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            ahead = score[at] + backward[at]
            backward[at - 1] = np.logaddexp(ahead[:, :1] + self.step[:, 0], ahead[:, 1:] + self.step[:, 1])
            pair = forward[at - 1][:, :, None] + self.step + ahead[:, None, :]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = forward + backward
        return _logistic(both[:, 1] - both[:, 0]), expected


def _ascend(slope, theta: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Adam on a mean log-likelihood's gradient, less a ridge."""
    slow, fast = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        g = slope(theta) - RIDGE * theta
        slow, fast = 0.9 * slow + 0.1 * g, 0.999 * fast + 0.001 * g**2
        theta = theta + RATE * (slow / (1 - 0.9**i)) / (np.sqrt(fast / (1 - 0.999**i)) + 1e-8)
    return theta


def untaught() -> Chain:
    """What there is without any labels: every score is one half."""
    return Chain(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))


def fit(x: np.ndarray, size: np.ndarray, count: np.ndarray, good: np.ndarray) -> Chain:
    """Weights of greatest conditional likelihood (less a ridge) for texts of ``count`` lines with labels ``good``."""
    of_text = np.repeat(good, count)
    alone = _ascend(lambda w: x.T @ (of_text - _logistic(x @ w)) / len(x), np.zeros(FEATURES))
    y = np.maximum(of_text, x @ alone > 0)
    last = np.zeros(len(y), bool)
    last[np.cumsum(count) - 1] = True
    seen = np.bincount(2 * y[:-1][~last[:-1]] + y[1:][~last[:-1]], minlength=4)

    def slope(theta: np.ndarray) -> np.ndarray:
        p, expected = Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), np.zeros(2)).marginals(x, count)
        return np.concatenate((x.T @ (y - p), seen - expected.reshape(-1))) / len(x)

    theta = _ascend(slope, np.concatenate((alone, np.zeros(4))))
    chain = Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), np.zeros(2))
    mean = np.stack((np.ones(len(count)), chain.means(x, size, count)), axis=1)
    chain.curve = _ascend(lambda c: mean.T @ (good - _logistic(mean @ c)) / len(good), np.zeros(2), 10 * STEPS)
    return chain


def learnable(id_col: str = "doc_id"):
    """Rows that may be learned from: those whose id's CRC-32 (as text) mod 4 is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Chain:
    """Fit on at most ``sample`` labelled documents, those of the least hashes of their ids, with all of their lines.

    In the order of the hashes a document is left out if with it there would be over ``lines`` lines, which bounds
    what comes to the driver (31 numbers a line, 25 MB by default). An id with several labels counts as bad if any
    of them is; of an id with several texts one is taken. Without labels all scores are one half.
    """
    known = labels.filter(learnable(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("good"))
    taken = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    texts = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("line_text")).join(F.broadcast(taken), id_col)
    picked = written(texts.groupBy(id_col).agg(F.min("good").alias("good"), F.min_by("line_text", F.xxhash64("line_text")).alias("line_text")).withColumn("place", F.xxhash64(id_col)))
    size = F.length("line_text") - F.length(F.replace("line_text", F.lit("\n"), F.lit(""))) + 1
    room, chosen = lines, []
    for r in picked.select(F.col(id_col).alias("id"), "place", size.alias("n")).orderBy("place", "id").collect():  # ``sample`` rows
        if r["n"] <= room:
            room -= r["n"]
            chosen.append(r["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, good, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, size, _ = line_features([text.encode()])
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([int(good)]), pa.array([x.astype("<f4").tobytes()]), pa.array([size.tolist()])], ["place", "good", "x", "size"])

    found = picked.filter(F.col(id_col).isin(chosen)).select("place", "good", "line_text").mapInArrow(run, "place long, good long, x binary, size array<long>")
    rows = sorted(found.collect(), key=lambda r: (r["place"], r["x"]))  # bounded by the two parameters
    if not rows:
        return untaught()
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in rows]
    size = np.concatenate([r["size"] for r in rows])
    return fit(np.concatenate(parts).astype(float), size, np.array([len(p) for p in parts]), np.array([r["good"] for r in rows]))


def score(docs: DataFrame, model: Chain, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and ``score``: the quality of every whole text, 0 to 1.

    Null, empty and blank texts are one line of no length. Null ids and repeated rows keep their rows; an
    empty table gives an empty result; columns that are not carried take no part. Nothing is shuffled.
    """
    return map_texts(docs, text_col, list(carry), "score double", lambda: lambda group: [pa.array(model.scores(*line_features(group)))], GROUP_BYTES)
