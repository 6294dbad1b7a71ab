"""Byte-level BPE by recursive queries: each task runs DuckDB over the words and ids of its own rows.

Encoding: every distinct word becomes rows of (word, position, token), one byte each. A round joins each
row and its right neighbour to the merge table and contracts, in every word, the leftmost pair of least
rank, together with every other pair of which the tables prove that it comes to be the leftmost pair of
least rank before anything else can touch it. Words without a pair in the table drop out, and the rounds
end when all have. Decoding joins ids to the vocabulary and aggregates the bytes in the order of positions,
once for each distinct run of ids as long as the worker remembers it; a document is put together from these.

The proof. Let a pair (t, u) of rank r stand between q, p and n, o. Only a merge of some token that ends in p and
of t, or of u and some token that begins with n, can take t or u away: p itself and t, or a token that ends in
q and p together (``lefts`` holds the least rank of these), and likewise on the right (``rights``). If none on the
left has a rank of r or less and none on the right one below r, (t, u) is still there when r is the least
rank. If moreover no merge of the new token with what may come to stand beside it has a rank below r (``before``
and ``behind`` hold the pairs that have one), contracting early changes nothing that comes before. A run of one
token is dealt with as a whole: its ends are looked at, and every other pair is contracted, as from the left.
All places of the least rank are contracted together under the same condition on the new token; else the
leftmost alone is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm import pretokens
from quillspan.llm.batches import map_texts

#: Positions that go into one recursive query (one word at least), and rounds after which a query starts afresh from the words that are left.
BLOCK, ROUNDS = 300_000, 8
#: Words of more bytes are cut where two bytes meet that stand side by side in no token, into segments of about so many.
LONG = 1 << 16
#: Bytes of texts whose new words are encoded together: the more, the less often the tables are read.
GROUP_BYTES = 4 << 20
#: Bits of a token's id within a key of two or three.
SHIFT = 21
NONE = (1 << SHIFT) - 1
#: Words whose ids a worker remembers; beyond this it keeps those that it met in several groups, half as many at most.
REMEMBERED = 3 << 17

_ROUNDS = f"""
WITH RECURSIVE t(step, word, pos, tok) AS (
  SELECT 0 AS step, word, pos, tok FROM start
  UNION ALL
  (WITH near AS (SELECT *, row_number() OVER w AS place, lag(tok, 2) OVER w AS prv2, lag(tok) OVER w AS prv, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS far, lead(tok, 3) OVER w AS far2
                 FROM t WHERE step < {ROUNDS} WINDOW w AS (ORDER BY pos)),
        pairs AS (SELECT s.word, s.place, m.rank, s.tok = s.nxt AS twin, coalesce(ml.rank = m.rank, false) OR coalesce(mr.rank = m.rank, false) AS beside,
                    coalesce(ml.rank > m.rank, true) AND coalesce(l.rank > m.rank, true) AS free_left, coalesce(mr.rank >= m.rank, true) AND coalesce(r.rank >= m.rank, true) AS free_right,
                    be.pair IS NULL AND af.pair IS NULL AS closed
                  FROM near s JOIN merges m ON m.pair = (s.tok::BIGINT << {SHIFT}) + s.nxt
                  LEFT JOIN merges ml ON ml.pair = (s.prv::BIGINT << {SHIFT}) + s.tok LEFT JOIN merges mr ON mr.pair = (s.nxt::BIGINT << {SHIFT}) + s.far
                  LEFT JOIN lefts l ON l.three = (((s.prv2::BIGINT << {SHIFT}) + s.prv) << {SHIFT}) + s.tok
                  LEFT JOIN rights r ON r.three = (((s.nxt::BIGINT << {SHIFT}) + s.far) << {SHIFT}) + s.far2
                  LEFT JOIN before be ON be.pair = CASE WHEN m.lower THEN (s.prv::BIGINT << {SHIFT}) + m.rank END
                  LEFT JOIN behind af ON af.pair = CASE WHEN m.lower THEN (m.rank::BIGINT << {SHIFT}) + s.far END),
        firsts AS (SELECT word, min((rank::BIGINT << 32) + place) AS first FROM pairs GROUP BY word),
        least AS (SELECT word, first >> 32 AS rank, first & 4294967295 AS first FROM firsts),
        undone AS (SELECT DISTINCT word, rank FROM pairs WHERE NOT closed),
        runs AS (SELECT *, place - row_number() OVER (PARTITION BY word, rank ORDER BY place) AS run FROM pairs WHERE beside),
        whole AS (SELECT word, rank, run, min(place) AS head, arg_min(free_left, place) AND arg_max(free_right, place) AND bool_and(closed) AND bool_and(twin) AS sure FROM runs GROUP BY word, rank, run),
        due AS (SELECT word, place, rank, place AS head, free_left AND free_right AND closed AS sure FROM pairs WHERE NOT beside
                UNION ALL SELECT word, place, rank, head, sure FROM runs JOIN whole USING (word, rank, run) WHERE (place - head) % 2 = 0),
        taken AS (SELECT d.word, d.place, d.rank FROM due d JOIN least l ON l.word = d.word LEFT JOIN undone u ON u.word = d.word AND u.rank = d.rank
                  WHERE d.sure OR (d.rank = l.rank AND (u.word IS NULL OR d.place = l.first)))
   SELECT s.step + 1, s.word, s.pos, coalesce(a.rank, s.tok) FROM near s SEMI JOIN taken ON taken.word = s.word LEFT JOIN taken a ON a.place = s.place ANTI JOIN taken b ON b.place + 1 = s.place))
"""

_LAST = "SELECT word, pos, tok, step FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step)"

_DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS text FROM ids JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _key(*tokens: int) -> int:
    out = 0
    for t in tokens:
        out = (out << SHIFT) + t
    return out


def _bounds(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes, int]]) -> tuple[dict[int, int], dict[int, int], set[int], set[int]]:
    """lefts, rights, before and behind of the proof above, by keys of tokens.

    What a neighbouring pair's own rank forbids already, or what lies above every rank that it could forbid, is left out.
    """
    pair: dict[tuple[int, int], int] = {}
    most_left: dict[int, int] = {}
    most_right: dict[int, int] = {}
    for left, right, rank in merges:
        a, b = ranks[left], ranks[right]
        pair[a, b] = rank
        most_left[a], most_right[b] = max(rank, most_left.get(a, 0)), max(rank, most_right.get(b, 0))
    lefts: dict[int, int] = {}
    rights: dict[int, int] = {}
    before, behind = set(), set()
    for left, right, rank in merges:
        a, b = ranks[left], ranks[right]
        for i in range(len(left)):
            if (u := ranks.get(left[i:])) is not None:
                if rank < b:
                    before.add(_key(u, b))
                if rank <= most_left.get(b, -1) and pair.get((u, b), rank + 1) > rank:
                    for j in range(i):
                        if (v := ranks.get(left[j:i])) is not None:
                            key = _key(v, u, b)
                            lefts[key] = min(rank, lefts.get(key, rank))
        for i in range(1, len(right) + 1):
            if (u := ranks.get(right[:i])) is not None:
                if rank < a:
                    behind.add(_key(a, u))
                if rank < most_right.get(a, -1) and pair.get((a, u), rank + 1) > rank:
                    for j in range(i + 1, len(right) + 1):
                        if (v := ranks.get(right[i:j])) is not None:
                            key = _key(a, u, v)
                            rights[key] = min(rank, rights.get(key, rank))
    return lefts, rights, before, behind


class Tables:
    """The merge table, the bounds and the vocabulary of one file in a DuckDB connection of one thread, which writes no files."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.known: dict[bytes, bytes] = {}
        self.said: dict[bytes, bytes] = {}
        self.met: set[bytes] = set()
        merges = [(t[:i], t[i:], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        ends = np.array([(self.ranks[a], self.ranks[b]) for a, b, _ in merges], np.int64)
        rank = np.array([r for _, _, r in merges], np.int64)
        lower = np.isin(rank, np.concatenate((ends[:, 0][ends[:, 0] > rank], ends[:, 1][ends[:, 1] > rank])))  # some merge of the new token has a lower rank
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.together = np.zeros(1 << 16, bool)  # which two bytes stand side by side in some token
        for t in self.ranks:
            for pair in zip(t, t[1:], strict=False):
                self.together[pair[0] << 8 | pair[1]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        given = {"merges": pa.table({"pair": (ends[:, 0] << SHIFT) + ends[:, 1], "rank": rank.astype(np.int32), "lower": lower}), "vocabulary": vocabulary}
        lefts, rights, before, behind = _bounds(self.ranks, merges)
        given |= {name: pa.table({"three": pa.array(x, pa.int64()), "rank": pa.array(x.values(), pa.int32())}) for name, x in (("lefts", lefts), ("rights", rights))}
        given |= {name: pa.table({"pair": pa.array(x, pa.int64())}) for name, x in (("before", before), ("behind", behind))}
        for name, table in given.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def forget(self) -> None:
        """Of what is remembered, keeps the words (at most half of ``REMEMBERED``) that several groups have had since this was last done."""
        kept = set(islice(self.met, REMEMBERED // 2))
        self.known = {word: ids for word, ids in self.known.items() if ids in kept}
        self.said = {ids: text for ids, text in self.said.items() if ids in kept}
        self.met = set()

    def _query(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) for distinct words, ids as bytes of little-endian 32-bit integers. A word that is a token is that token, as the library has it."""
        hard = []
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                yield w, r.to_bytes(4, "little")
            else:
                hard.append(w)
        parts = [(w, self._segments(w)) for w in hard if len(w) > LONG]
        pieces = sorted({*(w for w in hard if len(w) <= LONG), *(s for _, segments in parts for s in segments)}, key=len)
        ids: dict[bytes, bytes] = {}
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BLOCK):
                size += len(pieces[end])
                end += 1
            ids.update(zip(pieces[at:end], self._block(pieces[at:end]), strict=True))
            at = end
        yield from ((w, ids[w]) for w in hard if len(w) <= LONG)
        for w, segments in parts:
            yield w, b"".join(map(ids.__getitem__, segments))

    def _segments(self, word: bytes) -> list[bytes]:
        """A word in segments of about ``LONG`` bytes that no merge can join: no token has the two bytes at a cut side by side."""
        if len(word) <= LONG:
            return [word]
        b = np.frombuffer(word, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(~self.together[b[:-1] << 8 | b[1:]]) + 1
        at = np.searchsorted(cuts, np.arange(LONG, len(word), LONG))
        ends = np.unique(cuts[at[at < len(cuts)]]).tolist()
        return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)], strict=True)]

    def _block(self, words: list[bytes]) -> list[bytes]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), length + 1)  # behind each word stands what merges with nothing
        tok = np.full(len(word), NONE, np.int32)
        tok[np.diff(word, append=-1) == 0] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table({"word": word, "pos": np.arange(len(word), dtype=np.int32), "tok": tok})
        out = [b""] * len(words)
        while len(rows):
            now = self._query("start", rows, _ROUNDS + _LAST)
            open_still = now["step"].to_numpy() == ROUNDS
            word, pos, tok = (now[c].to_numpy()[~open_still] for c in ("word", "pos", "tok"))
            order = np.argsort(pos)
            order = order[tok[order] != NONE]
            word, ids = word[order], tok[order].astype("<u4").tobytes()
            edges = np.flatnonzero(np.diff(word, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                out[word[a]] = ids[4 * a : 4 * b]
            rows = now.filter(pa.array(open_still)).select(["word", "pos", "tok"])
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind each row of ids."""
        if not ids:
            return []
        count = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        tok = np.frombuffer(b"".join(ids), "<i4")
        rows = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), count), "pos": np.arange(len(tok), dtype=np.int32), "tok": tok})
        found = self._query("ids", rows, _DECODE)
        out = [b""] * len(ids)
        for doc, text in zip(found["doc"].to_pylist(), found["text"].to_pylist(), strict=True):
            out[doc] = text
        return out


@lru_cache(maxsize=1)
def tables(path: str) -> Tables:
    return Tables(path)


def _in_a_row(pieces: list[bytes], at: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The texts of ``count`` pieces each, put together; ``at``: which piece stands at each place."""
    if not len(at):
        return [b""] * len(count)
    row = pa.array(pieces, pa.large_binary()).take(pa.array(at))
    _, edges, data = row.buffers()
    end = np.frombuffer(edges, np.int64)[np.concatenate(([0], np.cumsum(count)))].tolist()
    whole = memoryview(data)
    return [bytes(whole[a:b]) for a, b in zip(end, end[1:], strict=False)]


def code(made: Tables, group: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The ids of each text of a group and the bytes that they decode to."""
    words, at, count = pretokens.distinct(group)
    if len(made.known) > REMEMBERED:
        made.forget()
    known, said = made.known, made.said
    found = list(map(known.get, words))
    made.met.update(found)
    made.met.discard(None)
    new = dict(made.words([w for w, ids in zip(words, found, strict=True) if ids is None]))
    known.update(new)
    runs = {ids: w for w, ids in new.items() if ids not in said}  # what ids decode to does not depend on their neighbours
    decoded = zip(runs.items(), made.decode(list(runs)), strict=True)
    said.update((ids, w if text == w else text) for (ids, w), text in decoded)  # one object for a word and its equal
    ids = list(map(known.__getitem__, words))
    return _in_a_row(ids, at, count), _in_a_row(list(map(said.__getitem__, ids)), at, count)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): token ids of every whole text (bytes of little-endian 32-bit integers) and the bytes they decode to.

    Null and empty texts have no ids. Every match of the tokenizers' pattern is encoded by itself, without
    special tokens. Null ids and repeated rows keep their rows; an empty table gives an empty result; other
    columns take no part. A worker holds a few megabytes of text and at most ``REMEMBERED`` words with their
    ids and bytes. Words of more than ``LONG`` bytes are encoded in segments that no merge can join; what has no place for a cut (two bytes that stand side by side in no
    token) must fit, with a few hundred bytes for each of its own.
    """

    def start():
        made = tables(ranks_path)

        def make(group: list[bytes]) -> list[pa.Array]:
            return [pa.array(x, pa.binary()) for x in code(made, group)]

        return make

    return map_texts(docs, text_col, [id_col], "ids binary, decoded binary", start, GROUP_BYTES)
