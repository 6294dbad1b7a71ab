"""Token counts by finite-state transducers, without making the tokens.

Two deterministic transducers are compiled from the tokenizer's file. The first reads classes of
characters and marks where pre-tokens begin. The second reads the bytes of pre-tokens, from its first state
in each; every transition is annotated with the number of tokens that the byte adds to (or takes from) what
has been emitted, so that the sum is the count of tokens. Both run over chunks of text side by side. What a
chunk does is a map from the state in which it is entered to the state in which it is left (and, for the
second, to a count); a parallel prefix scan composes these maps, and so every chunk's true entry state and
count are known without reading the text in order.

The splitter has a dozen states, so its maps hold them all. The states of the second are made as they are
met; a chunk's map holds those in which the chunk before it can be left: first the state left by a run from
the first state, then the states left by runs from those, until no map leads to a state that the next
one lacks. Pre-tokens that begin in a chunk make its exit the same for all entries, and long ones bring runs
together within a few bytes, so maps are small.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm import pretokens
from quillspan.llm.batches import map_texts
from quillspan.llm.tokens import ByteLevelFile

#: Characters of a splitter's chunk, bytes of a counter's chunk, and chunks that are run together.
CHUNK, COUNTED, LANES = 256, 64, 4096
#: States that a worker keeps; beyond this it starts afresh from those in use.
STATES = 1 << 18
#: Fields of a transition: the state it leads to, and the change of the count plus the middle of its range.
GAIN_BITS, GAIN_ZERO = 8, 128
#: Multiplier of the hash of a transition's key.
_SPREAD = 0x9E3779B97F4A7C15
#: What stands in a chunk behind the end of a text: it changes nothing.
_PAD = 256

# Classes of the splitter: letters that can end a contraction apart from the rest.
_ANY, _STMD, _RV, _ELL, _E, _NUMBER, _OTHER, _QUOTE, _BLANK, _WHITE, _BREAK = range(11)
_LETTERS = (_ANY, _STMD, _RV, _ELL, _E)
# States: what has been read of the current pre-token. One or more blanks end in U+0020 or in another.
_BEGIN, _IN_L, _IN_N, _IN_O, _ONE_B, _ONE_W, _MORE_B, _MORE_W, _QUOTED, _QUOTED_RV, _QUOTED_ELL, _CONTRACTED = range(12)
#: A transition's marks: a pre-token begins at the character read, or at the one before.
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables [class, state] of the next state and of the marks.

    Whether a blank leads the next pre-token, stands alone or belongs to a run, and whether a quote begins
    a contraction, is only known from what follows; so those transitions mark the character before.
    """

    def solid(c: int) -> int:
        return _IN_L if c in _LETTERS else _IN_N if c == _NUMBER else _IN_O

    def fresh(c: int) -> int:
        """The state after a character that begins a pre-token."""
        return {_BLANK: _ONE_B, _WHITE: _ONE_W, _QUOTE: _QUOTED, _BREAK: _BEGIN}.get(c, solid(c))

    def step(state: int, c: int) -> tuple[int, int]:
        white = c in (_BLANK, _WHITE)
        if c == _BREAK:
            return _BEGIN, BEFORE if state in (_QUOTED_RV, _QUOTED_ELL) else 0
        if state in (_IN_L, _IN_N, _IN_O) and not white and solid(c) == state:
            return state, 0
        if state in (_ONE_B, _ONE_W, _MORE_B, _MORE_W):
            if white:
                return (_MORE_B if c == _BLANK else _MORE_W), 0
            split = BEFORE if state in (_MORE_B, _MORE_W) else 0
            return (solid(c), split) if state in (_ONE_B, _MORE_B) else (fresh(c), split | HERE)
        if state == _QUOTED:
            if c in (_OTHER, _QUOTE):
                return _IN_O, 0
            if c in (_STMD, _RV, _ELL):
                return {_STMD: _CONTRACTED, _RV: _QUOTED_RV, _ELL: _QUOTED_ELL}[c], 0
        if state in (_QUOTED_RV, _QUOTED_ELL):
            if c == (_E if state == _QUOTED_RV else _ELL):
                return _CONTRACTED, 0
            after, mark = step(_IN_L, c)  # no contraction: a letter run began at the character before
            return after, mark | BEFORE
        return fresh(c), HERE

    table = np.array([[step(state, c) for state in range(12)] for c in range(11)], np.uint8)
    return np.ascontiguousarray(table[..., 0]), np.ascontiguousarray(table[..., 1])


NEXT, MARK = compile_splitter()
_CLASS = np.array([_ANY, _NUMBER, _OTHER, _WHITE, _BREAK], np.uint8)
_APART = {32: _BLANK, 39: _QUOTE} | {ord(c): k for k, letters in ((_STMD, "stmd"), (_RV, "rv"), (_ELL, "l"), (_E, "e")) for c in letters}


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [chunk, state]: row k is the map of chunks 0 to k, first to last."""
    out, d = maps.copy(), 1
    while d < len(out):
        after = out.copy()
        after[d:] = np.take_along_axis(out[d:], out[:-d], axis=1)
        out, d = after, 2 * d
    return out


def marks(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as :func:`quillspan.llm.pretokens.starts`, by the splitter over chunks."""
    n = len(chars)
    classes = _CLASS[kinds]
    for c, k in _APART.items():
        classes[(chars == c) & (classes != _BREAK)] = k
    chunks = -(-n // CHUNK)
    grid = np.full((chunks, CHUNK), _BREAK, np.uint8)
    grid.reshape(-1)[:n] = classes
    columns = np.ascontiguousarray(grid.T).astype(np.intp) * 12
    flat_next, flat_mark = NEXT.reshape(-1), MARK.reshape(-1)
    maps = np.tile(np.arange(12, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = flat_next[column[:, None] + maps]
    entry = np.concatenate(([_BEGIN], scan_maps(maps)[:-1, _BEGIN])).astype(np.uint8)
    said = np.empty((CHUNK, chunks), np.uint8)
    for column, row in zip(columns, said, strict=True):
        at = column + entry
        row[:] = flat_mark[at]
        entry = flat_next[at]
    said = said.T.reshape(-1)
    begin = (said & HERE).astype(bool)
    begin[:-1] |= (said[1:] & BEFORE).astype(bool)
    return begin[:n]


class Moves:
    """Transitions in arrays: values by keys of state and byte, found by hash and the next free place."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values of many keys; -1 for a key that is not there."""
        at = ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], -1)
        look = np.flatnonzero((there != key) & (there >= 0))
        while look.size:
            at[look] = (at[look] + 1) & (1 << self.bits) - 1
            there = self.keys[at[look]]
            hit = there == key[look]
            out[look[hit]] = self.values[at[look[hit]]]
            look = look[~hit & (there >= 0)]
        return out

    def put(self, key: int, value: int) -> None:
        if 2 * self.held >= len(self.keys):
            keys, values = self.keys, self.values
            self.__init__(self.bits + 1)
            for k, v in zip(keys[keys >= 0].tolist(), values[keys >= 0].tolist(), strict=True):
                self.put(k, v)
        at = (key * _SPREAD % 2**64) >> (64 - self.bits)
        while self.keys[at] >= 0:
            at = (at + 1) & (1 << self.bits) - 1
        self.keys[at], self.values[at] = key, value
        self.held += 1


class WordTransducer:
    """Bytes of a word in, changes of its token count out.

    The tokens of a word's prefix are the prefix's own tokenization, so each prefix has a last token, and a
    token t may follow a prefix just if t and the prefix's last token stay apart when tokenized together. What
    is still to come can only depend on the places from which a token may yet be completed: a state is the
    longest open suffix and, for each open place, the last token before it and the count of tokens there.
    """

    def __init__(self, file: ByteLevelFile) -> None:
        self.pair = {pair: i for i, pair in enumerate(file.merges)}
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(file.merges)))}
        self.tokens = set(file.ranks)
        self.whole: dict[bytes, bool] = {}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves = Moves()
        self.start = self._number(((0, None, 0),), b"")

    def _number(self, opened: tuple, suffix: bytes) -> int:
        key = (suffix, opened)
        if key not in self.numbers:
            n = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.put(n * 257 + _PAD, n << GAIN_BITS | GAIN_ZERO)
        return self.numbers[key]

    def forget(self, kept: int) -> int:
        """Start afresh from one state; its new number."""
        suffix, opened = self.states[kept]
        self._clear()
        return self._number(opened, suffix)

    def merge(self, word: bytes) -> list[bytes]:
        """The tokens of a few bytes by their definition: merge the pair of least rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda i: self.pair.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[least], parts[least + 1]) not in self.pair:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        return parts

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Do two tokens stay apart when they are tokenized together?

        Going back in time, whichever of the two parts that face each other was merged last is opened. If the
        facing parts have a merge of their own of lower rank than that, they would have been merged instead.
        """
        byte = (-1, b"", b"")
        limit = len(self.pair)
        while self.pair.get((left, right), limit) >= limit:
            (i, _, inner), (j, outer, _) = self.made.get(left, byte), self.made.get(right, byte)
            if i < 0 and j < 0:
                return True
            if i > j:
                left, limit = inner, i
            else:  # the left one of two equal merges comes first
                right, limit = outer, j + 1
        return False

    def _follows(self, last: bytes | None, token: bytes) -> bool:
        if last is None:
            if token not in self.whole:
                self.whole[token] = self.merge(token) == [token]
            return self.whole[token]
        return self._apart(last, token)

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        suffix, opened = self.states[state]
        text = suffix + bytes([byte])
        n, found, open_still = len(suffix), None, []
        for length, before, count in opened:
            end = text[n - length :]
            if found is None and end in self.tokens and self._follows(before, end):
                found = (end, count + 1)
            if end in self.prefixes:
                open_still.append((length + 1, before, count))
        last, change = found
        still = [(length, before, count - change) for length, before, count in open_still]
        longest = still[0][0] if still else 0
        return self._number((*still, (0, last, 0)), text[len(text) - longest :]), change

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the changes of the counts, for many states and bytes at once."""
        key = state * 257 + byte
        said = self.moves.get(key)
        if (new := said < 0).any():
            for k in np.unique(key[new]).tolist():
                after, change = self._move(*divmod(k, 257))
                if abs(change) >= GAIN_ZERO:
                    raise OverflowError("a byte changes the count by more than a transition holds")
                self.moves.put(k, after << GAIN_BITS | change + GAIN_ZERO)
            said[new] = self.moves.get(key[new])
        return said >> GAIN_BITS, (said & (1 << GAIN_BITS) - 1) - GAIN_ZERO

    def run(self, data: np.ndarray, begin: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What chunks (columns of ``data``; ``begin`` marks first bytes of pre-tokens) do from their entry states: exit states and counts."""
        state, total = entry.astype(np.int64), np.zeros(len(entry), np.int64)
        for byte, fresh in zip(data, begin, strict=True):
            state, gain = self.step(np.where(fresh, self.start, state), byte)
            total += gain
        return state, total


def scan_counts(maps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`scan_maps`, with the counts [chunk, state] that go with the maps added up on the way."""
    maps, counts, d = maps.copy(), counts.copy(), 1
    while d < len(maps):
        after, more = maps.copy(), counts.copy()
        after[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
        more[d:] = counts[:-d] + np.take_along_axis(counts[d:], maps[:-d], axis=1)
        maps, counts, d = after, more, 2 * d
    return maps, counts


def chunk_maps(machine: WordTransducer, data: np.ndarray, begin: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maps and counts [chunk, place] of consecutive chunks, the first entered in ``entry``; and the states [chunk, place] in which each may be left.

    Place j of chunk k is the j-th of the states in which chunk k - 1 may be left; the map gives the place among
    those of chunk k. Unused places are never reached. From its first pre-token on, a chunk is run once for all
    entries, and what stands before it (the chunk, if none begins in it) once for each.
    """
    size, chunks = data.shape
    head = np.where(begin.any(axis=0), begin.argmax(axis=0), size)
    ahead = np.arange(size)[:, None] < head
    body, body_total = machine.run(np.where(ahead & (head < size), _PAD, data), begin, np.full(chunks, machine.start))
    domain: list[dict[int, int]] = [{entry: 0}, *({s: 0} for s in body.tolist())]
    done: list[list[tuple[int, int]]] = [[] for _ in range(chunks)]
    ask = [(k, s) for k in range(chunks) for s in domain[k]]
    while ask:
        where, states = (np.array(x) for x in zip(*ask, strict=True))
        upto = int(head[where].max())
        exits, totals = machine.run(np.where(ahead[:upto, where], data[:upto, where], _PAD), np.zeros((upto, len(where)), bool), states)
        whole = head[where] == size
        exits, totals = np.where(whole, exits, body[where]), np.where(whole, totals, totals + body_total[where])
        found = []
        for (k, _), after, total in zip(ask, exits.tolist(), totals.tolist(), strict=True):
            if after not in domain[k + 1]:
                domain[k + 1][after] = len(domain[k + 1])
                found.append((k + 1, after))
            done[k].append((domain[k + 1][after], total))
        ask = [(k, s) for k, s in found if k < chunks]
    width = max(map(len, domain))
    maps, counts, left = np.zeros((chunks, width), np.int64), np.zeros((chunks, width), np.int64), np.zeros((chunks, width), np.int64)
    for k, row in enumerate(done):
        for j, (place, total) in enumerate(row):
            maps[k, j], counts[k, j] = place, total
        left[k, : len(domain[k + 1])] = list(domain[k + 1])
    return maps, counts, left


class Counter:
    """Token counts of whole texts; special strings count as one token each."""

    def __init__(self, path: str) -> None:
        self.file = ByteLevelFile(path)
        self.machine = WordTransducer(self.file)

    def count(self, texts: list[bytes]) -> np.ndarray:
        parts, first, special = self.file.parts(texts)
        joined, begins, _, _ = pretokens.places(parts, marks)
        fresh = np.zeros(len(joined) + 1, bool)
        fresh[begins] = True
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        chunks = -(-length // COUNTED)
        # every part begins a chunk, and the rest of its last chunk is padding
        row = np.repeat(np.cumsum(length + 1) - length - 1 - np.concatenate(([0], np.cumsum(chunks)[:-1])) * COUNTED, chunks) + np.arange(chunks.sum()) * COUNTED
        end = np.repeat(np.cumsum(length + 1) - 1, chunks)
        at = row[:, None] + np.arange(COUNTED)
        inside = at < end[:, None]
        at = np.where(inside, at, len(joined))
        data = np.where(inside, np.frombuffer(joined + b"\n", np.uint8).astype(np.int16)[at], np.int16(_PAD))
        total = np.zeros(len(row) + 1, np.int64)
        state = self.machine.start
        for k in range(0, len(row), LANES):
            if len(self.machine.states) > STATES:
                state = self.machine.forget(state)
            maps, counts, left = chunk_maps(self.machine, np.ascontiguousarray(data[k : k + LANES].T), np.ascontiguousarray(fresh[at[k : k + LANES]].T), state)
            maps, counts = scan_counts(maps, counts)
            total[k + 1 : k + 1 + len(maps)] = total[k] + counts[:, 0]
            state = int(left[-1, maps[-1, 0]])
        upto = total[np.cumsum(chunks)]
        return np.add.reduceat(np.diff(upto, prepend=0), first) + np.fromiter(map(len, special), np.int64, len(special))


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text.

    Null and empty texts have none. Null ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns take no part. Memory is bounded by a group of texts (or one longer text) and
    by ``STATES`` and what ``LANES`` chunks may add to them; nothing is shuffled.
    """
    def start():
        made = counter(tokenizer_path)
        return lambda group: [pa.array([len(t) for t in group], pa.int64()), pa.array(made.count(group))]

    return map_texts(docs, text_col, [id_col], "n_bytes long, n_tokens long", start)
