"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is read in windows of ``SPAN`` bytes that overlap nowhere and leave out nothing; in each window one
recurrent layer runs forward and one backward, and both states at a position give its label
probabilities. A document's probabilities are the mean of its positions' log-probabilities, weighted by
whether the position is a letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.batches import map_texts
from quillspan.llm.quality import learnable

#: Bytes of a window, units of a layer, windows that are run side by side.
SPAN, UNITS, LANES = 128, 8, 2048
#: Training windows of each language, their bytes, and the batches that are learned from.
SAMPLE, SAMPLE_SPAN, BATCHES, BATCH, RATE = 1500, 96, 600, 64, 0.015
UNKNOWN = "und"
#: More languages than this end the job: they are a row each on the driver and an output each of the network.
MAX_LANGUAGES = 1000
_LETTER = regex.compile(r"\p{L}")
_FLOAT = np.float32
#: Bytes that belong to no letter of ASCII; what is above 127 counts as part of letters.
_MUTE = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Layer:
    """One gated recurrent layer: what a byte brings [3 units, 256], recurrent weights [3 units, units], and its bias for the new state."""

    byte: np.ndarray
    state: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(rng: np.random.Generator) -> Layer:
        return Layer(rng.normal(0, 0.3, (3 * UNITS, 256)).astype(_FLOAT), rng.normal(0, UNITS**-0.5, (3 * UNITS, UNITS)).astype(_FLOAT), np.zeros((UNITS, 1), _FLOAT))

    def run(self, steps: np.ndarray) -> np.ndarray:
        """States [time, units, lanes] over bytes [time, lanes]. A step is (1 - z) n + z h with z, r, n from byte and state."""
        u = UNITS
        half = self.byte.copy()
        half[: 2 * u] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        weight = self.state.copy()
        weight[: 2 * u] *= 0.5
        h = np.zeros((u, steps.shape[1]), _FLOAT)
        out = np.empty((len(steps), u, steps.shape[1]), _FLOAT)
        inner = np.empty((3 * u, steps.shape[1]), _FLOAT)
        for t, b in enumerate(steps):
            given = half.take(b, axis=1)
            np.matmul(weight, h, out=inner)
            gates = given[: 2 * u]
            gates += inner[: 2 * u]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = inner[2 * u :]
            new += self.bias
            new *= gates[u:]
            new += given[2 * u :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=out[t])
            h *= gates[:u]
            h += new
        return out


def _forward(layer: Layer, steps: np.ndarray) -> tuple[np.ndarray, list]:
    """As :meth:`Layer.run`, keeping what the way back needs."""
    u, h, states, kept = UNITS, np.zeros((UNITS, steps.shape[1]), _FLOAT), [], []
    for b in steps:
        given, inner = layer.byte.take(b, axis=1), layer.state @ h
        z, r = _sigmoid(given[:u] + inner[:u]), _sigmoid(given[u : 2 * u] + inner[u : 2 * u])
        m = inner[2 * u :] + layer.bias
        n = np.tanh(given[2 * u :] + r * m)
        kept.append((b, h, z, r, m, n))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), kept


def _backward(layer: Layer, kept: list, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of byte, state and bias from those of the states, last step first."""
    u = UNITS
    byte, state, bias = np.zeros_like(layer.byte), np.zeros_like(layer.state), np.zeros_like(layer.bias)
    back = np.zeros_like(slope[0])
    for (b, h, z, r, m, n), s in zip(reversed(kept), slope[::-1], strict=True):
        back = back + s
        dn = back * (1 - z) * (1 - n * n)
        dz = back * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        of_inner = np.concatenate((dz, dr, dn * r))
        of_given = np.concatenate((dz, dr, dn))
        state += of_inner @ h.T
        bias += (dn * r).sum(axis=1, keepdims=True)
        np.add.at(byte.T, b, of_given.T)
        back = back * z + layer.state.T @ of_inner
    return [byte, state, bias]


@dataclass
class Network:
    """Both layers, the weights from their states to the languages, and the languages."""

    ahead: Layer
    behind: Layer
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Log-probabilities [time, language, lanes] of every position."""
        score = self.out[:, :UNITS] @ self.ahead.run(steps)
        score += self.out[:, UNITS:] @ self.behind.run(steps[::-1])[::-1]
        score += self.out_bias
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        return score

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities [text, language] of whole texts, from the mean over their positions that belong to letters."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        windows = -(-lengths // SPAN)
        first = np.cumsum(windows) - windows
        data = np.zeros((int(windows.sum()), SPAN), np.uint8)
        flat = data.reshape(-1)
        for text, at in zip(texts, (first * SPAN).tolist(), strict=True):
            flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        total = np.zeros((len(data), len(self.languages)))
        for at in range(0, len(data), LANES):
            steps = np.ascontiguousarray(data[at : at + LANES].T)
            score = self.positions(steps)
            score *= ~_MUTE[steps][:, None, :]
            total[at : at + LANES] = score.sum(axis=0).T
        owner = np.repeat(np.arange(len(texts)), windows)
        letters = np.bincount(owner, (~_MUTE[data]).sum(axis=1), len(texts))
        mean = np.stack([np.bincount(owner, total[:, k], len(texts)) for k in range(len(self.languages))], axis=1) / np.maximum(letters, 1)[:, None]
        weight = np.exp(mean - mean.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, language: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Train on windows of bytes [window, time], every position of which should have its window's language; Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    net = Network(Layer.new(rng), Layer.new(rng), rng.normal(0, 0.1, (len(languages), 2 * UNITS)).astype(_FLOAT), np.zeros((len(languages), 1), _FLOAT), languages)
    weights = [net.ahead.byte, net.ahead.state, net.ahead.bias, net.behind.byte, net.behind.state, net.behind.bias, net.out, net.out_bias]
    slow, fast = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-BATCHES * BATCH // len(windows)))])
    for i in range(1, BATCHES + 1):
        pick = order[(i - 1) * BATCH : i * BATCH]
        steps = np.ascontiguousarray(windows[pick].T)
        a, kept_a = _forward(net.ahead, steps)
        b, kept_b = _forward(net.behind, steps[::-1])
        both = np.concatenate((a, b[::-1]), axis=1)
        score = net.out @ both + net.out_bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, language[pick], np.arange(len(pick))] -= 1
        p *= ~_MUTE[steps][:, None, :] / steps.size
        p = p.astype(_FLOAT)
        slope = net.out.T @ p
        grads = [*_backward(net.ahead, kept_a, slope[:, :UNITS]), *_backward(net.behind, kept_b, slope[::-1, UNITS:]), np.einsum("tkl,tul->ku", p, both), p.sum(axis=(0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, m, v in zip(weights, grads, slow, fast, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (RATE * (1 - i / (BATCHES + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(_FLOAT)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Train on about ``sample`` windows of each language, one from an id, chosen by hashes of ids; None without labelled texts.

    The languages are those that occur (a row of each passes through the driver). A window is
    ``SAMPLE_SPAN`` bytes from a place in the text that depends on the id; of an id with several rows the least
    language and window is taken. The same rows give the same network, however they are dealt.
    """
    known = docs.filter(learnable(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counted = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not counted:
        return None
    languages = sorted(counted)
    hashed = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, sample / counted[lang]) * (1 << 30)))])
    place = F.floor(F.pmod(F.xxhash64(id_col, F.lit(1)), F.greatest(F.length(text_col) - SAMPLE_SPAN, F.lit(1)))).cast("int") + 1
    picked = known.filter(hashed <= F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.encode(F.substring(text_col, place, F.lit(SAMPLE_SPAN)), "UTF-8").alias("part"))
    one = picked.groupBy("id").agg(F.min(F.struct("lang", "part")).alias("said")).select("id", "said.*")
    rows = one.orderBy(F.xxhash64("id"), "id").limit(2 * sample * len(languages)).collect()  # the sample, bounded by its parameter
    rows.sort(key=lambda r: (r["id"], r["lang"]))
    windows = np.zeros((len(rows), SAMPLE_SPAN), np.uint8)
    for w, r in zip(windows, rows, strict=True):
        part = bytes(r["part"])[:SAMPLE_SPAN]
        w[: len(part)] = np.frombuffer(part, np.uint8)
    return fit(windows, np.array([languages.index(r["lang"]) for r in rows]), languages)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, ``lang_pred`` and ``score``: the likeliest language of every whole text and its probability.

    Null texts and texts without a letter (and all, without a network) are ``und`` with score 0. Of languages
    that are equally likely the first by name is given. Null ids and
    repeated rows keep their rows; an empty table gives an empty result; columns that are not carried take
    no part. Nothing is shuffled.
    """

    def make(group: list[bytes]) -> list[pa.Array]:
        if net is None:
            return [pa.array([UNKNOWN] * len(group)), pa.array([0.0] * len(group))]
        spoken = np.array([bool(_LETTER.search(t.decode())) for t in group])
        p = net.pooled(group)
        best = p.argmax(axis=1)
        names = [net.languages[k] if s else UNKNOWN for k, s in zip(best, spoken, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(spoken, p[np.arange(len(group)), best], 0.0))]

    return map_texts(docs, text_col, list(carry), "lang_pred string, score double", lambda: make)
