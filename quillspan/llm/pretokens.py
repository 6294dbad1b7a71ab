"""Pre-tokens of the byte-level tokenizers' common pattern, found for a whole batch of texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches cover
every text without gaps, so it is enough to know where matches begin, and that depends on the classes
of neighbouring characters alone: a few array operations over the characters of all texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            at = np.arange(*m.span())
            table[at + 0x800 * (at >= 0xD800)] = kind
    return table


def starts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. chars: code points; kinds: their classes, BREAK between texts."""
    n = len(chars)
    before = np.concatenate(([BREAK], kinds[:-1])).astype(np.uint8)
    after = np.concatenate((kinds[1:], [BREAK])).astype(np.uint8)
    begin = kinds != before
    blank = kinds == SPACE
    solid_next = (after != SPACE) & (after != BREAK)
    begin |= blank & solid_next  # the last blank of a run stands alone or leads what follows
    led = np.zeros(n, bool)
    led[1:] = (chars[:-1] == 32) & (kinds[:-1] == SPACE)
    begin &= ~(led & ~blank & (kinds != BREAK))
    quote = np.flatnonzero((chars == 39) & begin & (kinds == OTHER) & (after == LETTER))
    if quote.size:
        one = chars[np.minimum(quote + 1, n - 1)]
        two = chars[np.minimum(quote + 2, n - 1)]
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        length[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
        length[(one == ord("l")) & (two == ord("l"))] = 2
        length[(length == 2) & (quote + 2 >= n)] = 0
        quote, length = quote[length > 0], length[length > 0]
        begin[quote + 1] = False
        end = quote + length + 1
        begin[end[end < n]] = True
    return begin


def _begun(texts: list[bytes], find: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a byte between them, first byte of each pre-token and of each byte between, which are pre-tokens, and how many each text has."""
    joined = b"\n".join(texts)  # the line feeds between texts are marked as breaks
    chars = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    offset = np.flatnonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
    kinds = classes()[chars]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    edge = np.searchsorted(offset, ends[:-1])
    kinds[edge] = BREAK
    begin = find(chars, kinds)
    begin[edge] = True
    at = np.flatnonzero(begin)
    first = offset[at]
    real = kinds[at] != BREAK
    return joined, first, real, np.diff(np.searchsorted(first[real], ends), prepend=0)


def places(texts: list[bytes], find: Callable[[np.ndarray, np.ndarray], np.ndarray] = starts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Where pre-tokens stand: all texts with a byte between them, first byte and end of each pre-token, and how many each text has.

    find: says where pre-tokens begin, as :func:`starts`.
    """
    joined, first, real, count = _begun(texts, find)
    last = np.concatenate((first[1:], [len(joined)]))
    return joined, first[real], last[real], count


def split(texts: list[bytes], find: Callable[[np.ndarray, np.ndarray], np.ndarray] = starts) -> tuple[list[bytes], np.ndarray]:
    """The pre-tokens of all texts in a row, and how many each text has."""
    joined, first, last, count = places(texts, find)
    return [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], count


def distinct(texts: list[bytes], find: Callable[[np.ndarray, np.ndarray], np.ndarray] = starts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pre-tokens of all texts, which of them stands at each place, and how many places each text has."""
    joined, first, real, count = _begun(texts, find)
    edges = np.append(first, len(joined)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(joined)])
    coded = column.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), count
