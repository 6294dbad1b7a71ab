"""Ids of byte-level BPE tokenizer files (tokenizers' JSON), as that library gives them by default."""

from __future__ import annotations

import json
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

from quillspan.llm import pretokens

#: Words whose ids are remembered in a worker; beyond this the memory starts afresh.
REMEMBERED = 1 << 17


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevelFile:
    """What a tokenizer's JSON file says: ranks (bytes to id), merges (pairs of bytes, by rank), special strings (bytes to id)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["model"]["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"]:
            raise ValueError(f"{path} is not a byte-level BPE tokenizer")
        table = byte_of_char()
        plain = lambda s: bytes(table[c] for c in s)
        self.special = {a["content"].encode(): a["id"] for a in said["added_tokens"]}
        self.ranks = {plain(s): i for s, i in said["model"]["vocab"].items() if s.encode() not in self.special}
        self.merges = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in said["model"]["merges"]]

    def parts(self, texts: list[bytes]) -> tuple[list[bytes], list[int], list[list[int]]]:
        """Texts cut at special strings (longest first, as they stand): parts, first part of each text, special ids of each text."""
        if not self.special:
            return texts, list(range(len(texts))), [[]] * len(texts)
        rule = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        parts: list[bytes] = []
        first, found = [], []
        for t in texts:
            first.append(len(parts))
            hits = list(rule.finditer(t)) if any(s in t for s in self.special) else []
            edges = [0, *(x for m in hits for x in m.span()), len(t)]
            parts += [t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            found.append([self.special[m[0]] for m in hits])
        return parts, first, found


class Words(dict):
    """The ids of words, found when a word is first asked for: one look-up for each word of a text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.find = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # the pattern takes a word as it is

    def __missing__(self, word: bytes) -> bytes:
        ids = array("I", self.find(word.decode()))
        if sys.byteorder == "big":
            ids.byteswap()
        out = self[word] = ids.tobytes()
        return out


class Encoder:
    """Ids of whole texts, as bytes of little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.file = ByteLevelFile(path)
        self.known = Words(self.file.ranks)

    def _words(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts, first, special = self.file.parts(texts)
        words, count = pretokens.split(parts)
        ids, end = self._words(words), np.cumsum(count).tolist()
        start = [0, *end[:-1]]
        out = []
        for k, marks in zip(first, special, strict=True):
            if not marks:
                out.append(b"".join(ids[start[k] : end[k]]))
                continue
            text = [b"".join(ids[start[k] : end[k]])]
            for i, mark in enumerate(marks, k + 1):
                text += [mark.to_bytes(4, "little"), *ids[start[i] : end[i]]]
            out.append(b"".join(text))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
