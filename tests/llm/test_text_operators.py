"""Fingerprints, BPE, counts, packing and SimHash against the libraries and brute force."""

import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import batches, bpe, counts, minhash, packing, pretokens, shard, similar, simhash, tokens

from .conftest import TEXTS, prose

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["'", "s", "t", "re", "ve", "l", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "²", "a", "é", "!", "..", "𝒳", "漢", "'S", "\x1c", "<|endoftext|>", "aaa", "=="]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def odd_texts(n, most=60):
    r = random.Random(4)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_pretokens_match_the_pattern():
    import regex

    rule = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    texts = odd_texts(400, 12)
    for find in (pretokens.starts, counts.marks):
        words, count = pretokens.split([t.encode() for t in texts], find)
        expected = [[w.encode() for w in rule.findall(t)] for t in texts]
        assert count.tolist() == [len(e) for e in expected]
        assert words == [w for e in expected for w in e]


def test_ids_and_counts_match_the_library(library):
    texts = odd_texts(200) + [t or "" for t in TEXTS]
    ids = tokens.Encoder(JSON).encode([t.encode() for t in texts])
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == expected
    assert counts.Counter(JSON).count([t.encode() for t in texts]).tolist() == [len(e) for e in expected]


def long_words():
    """Unbroken words of 100,000 bytes and texts that end at, before and behind a chunk's border."""
    r = random.Random(9)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    return [letters, "=" * 100_000, ("the" * 40_000)[:100_000], "漢字" * 16_000, *(letters[:n] for n in range(60, 70)), *("ab cd " * 40)[:130].split("x"), *(" " * n + "x" for n in (63, 64, 65, 128))]


def test_counts_of_long_words_and_at_borders(library):
    texts = long_words()
    assert counts.Counter(JSON).count([t.encode() for t in texts]).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("states", "lanes", "size"), [(20, 3, 64), (1 << 18, 4096, 1), (1 << 18, 2, 5)])
def test_counts_do_not_depend_on_chunks_or_memory(library, monkeypatch, states, lanes, size):
    monkeypatch.setattr(counts, "STATES", states)
    monkeypatch.setattr(counts, "LANES", lanes)
    monkeypatch.setattr(counts, "COUNTED", size)
    made = counts.Counter(JSON)
    for t in [*odd_texts(30), *[t or "" for t in TEXTS if len(t or "") < 3000]]:
        assert made.count([t.encode()]).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_counts_of_chunks_add_up():
    """Maps and counts of chunks, composed by the scan, against the machine run from the start byte by byte."""
    machine = counts.Counter(JSON).machine
    r = random.Random(3)
    data = np.frombuffer("".join(r.choice("ainstother") for _ in range(37 * 8)).encode(), np.uint8).astype(np.int64)
    begin = np.zeros(len(data), bool)
    begin[[0, 20, 21, 200]] = True
    maps, total, left = counts.chunk_maps(machine, data.reshape(37, 8).T, begin.reshape(37, 8).T, machine.start)
    maps, total = counts.scan_counts(maps, total)
    state, n = np.array([machine.start]), 0
    for i, (byte, fresh) in enumerate(zip(data, begin, strict=True)):
        state, gain = machine.step(np.array([machine.start]) if fresh else state, np.array([byte]))
        n += int(gain[0])
        if i % 8 == 7:
            assert (left[i // 8, maps[i // 8, 0]], total[i // 8, 0]) == (state[0], n)


def test_count_tokens(docs, empty):
    rows = {(r.doc_id, r.n_bytes): r.n_tokens for r in counts.count_tokens(docs, JSON).collect()}
    assert rows[(0, 0)] == rows[(1, 0)] == 0 and rows[(3, 3)] == 1
    assert counts.count_tokens(docs, JSON).count() == docs.count()
    assert counts.count_tokens(empty, JSON).count() == 0


def test_state_maps_compose():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 12, (37, 12)).astype(np.uint8)
    scanned, at = counts.scan_maps(maps), np.arange(12)
    for m, s in zip(maps, scanned, strict=True):
        at = m[at]
        assert (s == at).all()


def test_bpe_words_match_tiktoken():
    made = bpe.tables(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    r = random.Random(6)
    words = sorted({"".join(r.choice("aabcdeé=漢") for _ in range(r.randint(1, 120))).encode() for _ in range(300)} | {b"=" * 999, b"a" * 500})
    found = dict(made.words(words))
    assert all(np.frombuffer(found[w], "<u4").tolist() == library._encode_single_piece(w) for w in words)


def test_bpe_long_words_match_tiktoken():
    made = bpe.tables(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    r = random.Random(2)
    parts = list(made.ranks)
    words = sorted({*(t.encode() for t in long_words()), *(b"".join(r.choice(parts) for _ in range(r.randint(2, 6))) for _ in range(3000)), *(bytes(r.choice(b"thein g") for _ in range(300)) for _ in range(50))} - {b""})
    found = dict(made.words(words))
    assert all(np.frombuffer(found[w], "<u4").tolist() == library._encode_single_piece(w) for w in words)


def test_bpe_words_of_a_million_bytes_match_tiktoken():
    """Letters at random are cut where no token can reach across; a run of one letter has no such place."""
    made = bpe.tables(MULTI)
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, 1_000_000, dtype=np.uint8)), b"a" * 300_000, "é".encode() * 100_000]
    assert [len(made._segments(w)) > 1 for w in words[:2]] == [True, False]
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=made.ranks, special_tokens={})
    for word, ids in made.words(words):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word.decode()), word[:20]


def test_sketches_never_lose_a_similar_pair():
    rng = np.random.default_rng(1)
    unrelated = 0
    for _ in range(500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000)), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 4 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert similar.may_be_similar(similar.sketch(a), len(a), similar.sketch(b), len(b))
        c = np.unique(rng.integers(0, 2**63, len(a), dtype=np.uint64))
        unrelated += similar.may_be_similar(similar.sketch(a), len(a), similar.sketch(c), len(c))
    assert unrelated < 25


def test_bpe_documents(docs, empty):
    """All rows: null ids, repeated rows, null, empty and long texts."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tables(MULTI).ranks, special_tokens={})
    rows = bpe.encode(docs, MULTI).collect()
    assert Counter((r.doc_id, r.decoded.decode()) for r in rows) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.decoded.decode()) for r in rows)
    assert bpe.encode(empty, MULTI).count() == 0


def test_bpe_decodes_each_run_of_ids_once(monkeypatch):
    made, asked = bpe.tables(MULTI), []
    decode = made.decode
    monkeypatch.setattr(made, "decode", lambda ids: asked.append(sum(map(len, ids)) // 4) or decode(ids))
    group = [b"", "the word naïve 東京 ".encode() * 500, b"the word", b"   \n"]
    ids, decoded = bpe.code(made, group)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t.decode()) for t in group]
    assert decoded == group and sum(asked) < 100


def test_packing_covers_every_id_once(docs, empty, library):
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), JSON).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= 1024
    for i, t in enumerate(TEXTS):
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        whole = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(x for _, x in own) == whole
        assert zlib.crc32(whole) == zlib.crc32(b"".join(x for _, x in own))
    assert packing.pack(empty, JSON).count() == 0


def test_packing_wastes_little_and_balances():
    r = random.Random(2)
    lengths = [r.randint(1, 3000) for _ in range(2000)]
    pieces = packing.pack_lengths(lengths)
    sequences = {}
    for doc, start, n, sequence, offset in pieces:
        sequences.setdefault(sequence, []).append(n)
    assert sum(lengths) > (len(sequences) - 1) * 1024
    cost = packing.Cost()
    mixed = [sum(map(cost, x)) for x in sequences.values() if len(x) > 1]
    assert np.std(mixed) < 0.25 * np.mean(mixed)
    assert packing.pack_lengths([]) == []


def plain_packing(lengths, capacity=1024):
    """Descending rests, each to the cheapest sequence with room, else cut to fill the roomiest."""
    cost = packing.Cost()
    out, rests = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((doc, start, capacity, len(out), 0))
        if n % capacity:
            rests.append((n % capacity, doc, n - n % capacity))
    base = len(out)
    open_ = [[0.0, i, capacity] for i in range(-(-sum(n for n, _, _ in rests) // capacity))]
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = [s for s in open_ if s[2] >= n]
            s = min(fits) if fits else min(open_, key=lambda s: (-s[2], s[0], s[1]))
            part = min(n, s[2])
            out.append((doc, start, part, base + s[1], capacity - s[2]))
            s[0], s[2], start, n = s[0] + cost(part), s[2] - part, start + part, n - part
    return out


def test_packing_matches_a_plain_greedy():
    r = random.Random(7)
    for _ in range(30):
        lengths = [r.choice([r.randint(1, 2500), r.randint(1, 40), 1024, 512]) for _ in range(r.randint(1, 80))]
        assert packing.pack_lengths(lengths) == plain_packing(lengths)


def test_packing_keeps_repeated_and_null_ids(docs, library):
    """Every row is packed whole: the pieces of each id hold as many ids as all its rows have."""
    packed, expected = Counter(), Counter()
    for r in packing.pack(docs, JSON).collect():
        packed[r.doc_id] += r.length
    for r in docs.collect():
        expected[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packed == expected


def brute_simhash(text, words=3):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    parts = [w for w in folded.split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))] if parts else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force():
    for t in TEXTS[:14]:
        assert simhash.simhash((t or "").encode()) == brute_simhash(t or "")


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_links_connect_all_within_three_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)  # so that small groups are split again, to the last level
    r = random.Random(8)
    centre = r.getrandbits(63)
    values = {centre ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 5))) for _ in range(120)} | {r.getrandbits(63) for _ in range(60)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(frame).collect()
    expected = brute_components(sorted(values))
    got = {v: v for v in values}
    got |= {x.node: x.root for x in simhash.components(spark.createDataFrame([(e.a, e.b) for e in edges], "a long, b long")).collect()}
    groups = lambda m: sorted(sorted(v for v in m if m[v] == k) for k in set(m.values()))
    assert groups(got) == groups(expected)


def test_components_are_written_from_few_tasks(spark, monkeypatch):
    """Files of a step follow the cores, however many shuffle partitions there are."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut, parts = simhash.cut, []
    monkeypatch.setattr(simhash, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    try:
        found = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.root for r in found} == {0} and len(found) == 41
    assert max(parts) <= 2 * spark.sparkContext.defaultParallelism


def test_near_groups_and_dedup(docs, empty):
    rows = [(r.doc_id, r.component) for r in simhash.near_groups(docs).collect()]
    assert len(rows) == docs.count() and dict(rows)[11] == 10 and dict(rows)[2] == 0 == dict(rows)[1]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 11 not in ids and 10 in ids and ids.count(3) == 1 and None in ids
    assert simhash.near_groups(empty).count() == 0 == simhash.near_dedup(empty).count()


def test_near_dedup_keeps_one_row_under_repeated_ids(spark):
    text, other = prose(5, 60), prose(6, 60)
    rows = [(1, text, "a", 1), (2, other, "b", 2), (2, text, "c", 3), (3, other, None, 4), (3, text + " more", None, 5), (None, text, "d", 6), (7, None, "e", 7), (8, "", "e", 8), (7, None, "e", 7)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string, text_hash_0 long"))
    assert kept.columns == ["doc_id", "text", "fp", "text_hash_0"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, text, "a", 1), (2, other, "b", 2), (None, text, "d", 6), (7, None, "e", 7)], key=repr)


def test_ids_of_a_word_are_found_once_and_as_little_endian_integers():
    encoder = tokens.Encoder(JSON)
    asked, find = [], encoder.known.find
    encoder.known.find = lambda word: (asked.append(word), find(word))[1]
    one, two = encoder.encode([b"stone river", b"stone river stone river"])
    assert two[: len(one)] == one and asked == ["stone", " river", " stone"]
    assert encoder.known[b" river"] == b"".join(i.to_bytes(4, "little") for i in find(" river"))


def test_runs_of_ids_are_decoded_once_for_a_worker(monkeypatch):
    made = bpe.Tables(MULTI)
    decoded, real = [], made.decode
    monkeypatch.setattr(made, "decode", lambda ids: (decoded.extend(ids), real(ids))[1])
    text = b"Anblewh sttible athawh anblewh"
    assert bpe.code(made, [text, b""])[1] == [text, b""] and len(decoded) == 4
    first, again = bpe.code(made, [text]), bpe.code(made, [b"", text])
    assert first[1] == [text] and again[1] == [b"", text] and first[0] == again[0][1:] and len(decoded) == 4
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    assert bpe.code(made, [text]) == first and len(decoded) == 8


def test_near_copies_of_one_text_are_compared_a_few_times_each(spark, monkeypatch):
    """Copies edited too much for the similarity make no pairs, those edited little meet the text itself; none is lost."""
    compared, real = [], similar._possible
    monkeypatch.setattr(similar, "_possible", lambda pairs, texts: (compared.append(pairs.count()), real(pairs, texts))[1])
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]

    def edited(n):
        places = {3 + 140 // n * i + r.randint(0, 9) for i in range(n)}
        return " ".join(f"x{r.random()}" if i in places else w for i, w in enumerate(base))

    texts = [" ".join(base)] + [edited(2 + i % 2) for i in range(30)] + [edited(5) for _ in range(60)]
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    runs = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    marks = [simhash.simhash(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and (5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b]) or (marks[a] ^ marks[b]).bit_count() <= 3):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(root)) and len(set(root)) > 40
    assert sum(compared) < 3 * len(texts)


def test_near_dedup_finds_every_similar_text(spark, monkeypatch):
    """Edits that move a fingerprint by more than three bits: similarity of five-word runs decides, in crowded groups too."""
    monkeypatch.setattr(similar, "REACH", 2)
    r = random.Random(5)

    def edited(words, k):
        places = set(r.sample(range(len(words)), k))
        return [f"x{r.random()}" if i in places else w for i, w in enumerate(words)]

    base = [[f"w{k}_{r.randint(0, 400)}" for _ in range(200)] for k in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(edited(b, k)) for b in base for k in (2, 3, 4, 9)]
    texts += [" ".join(edited(base[0], 3)) for _ in range(20)] + ["", " \n ", "a b", "a b"]
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    marks, parent = [simhash.simhash(t.encode()) for t in texts], list(range(len(texts)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            alike = 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])
            close = (marks[a] ^ marks[b]).bit_count() <= 3
            far += alike and not close
            if alike or close:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert far > 20
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({root(v) for v in range(len(texts))})


def test_fingerprints(spark, docs, empty):
    rows = sorted(minhash.fingerprint_with_next(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS)
    texts = [t or "" for t in TEXTS]
    for i, r in enumerate(rows):
        half, after = len(texts[i]) // 2, texts[(i + 1) % len(texts)]
        assert r.edited == texts[i][: len(texts[i]) - half] + after[:half] and r.n_chars == len(texts[i])
    assert rows[10].fingerprint == rows[11].fingerprint and rows[10].near_next == 1.0
    assert rows[0].fingerprint == rows[1].fingerprint == rows[2].fingerprint
    assert minhash.fingerprint_with_next(empty).count() == 0
    assert minhash.fingerprint_with_next(docs).count() == docs.count()


def spark_hash(*values, seed=42):
    """xxhash64 of Spark: XXH64 of each value in turn, the last result being the next seed."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text, words=5):
    """One hash a shingle, the least of each bin, walks for empty bins, four bits of each."""
    each = [spark_hash(w) for w in text.lower().split()]
    hashes = [spark_hash(*each[i : i + words]) for i in range(max(1, len(each) - words + 1))] if each else []
    if not hashes:
        return minhash.NO_WORDS
    bins = {}
    for h in hashes:
        b = (h >> minhash.SHIFT) + minhash.BINS // 2
        bins[b] = min(h, bins.get(b, h))
    digits = []
    for b, (start, stride) in enumerate(zip(*minhash._walks(), strict=True)):
        t = 0
        value = bins.get(b)
        while value is None:
            value, t = bins.get((start + t * stride) % minhash.BINS), t + 1
        digits.append(f"{spark_hash(value, np.int32(b)) & 15:x}")
    return "".join(digits)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if minhash.NO_WORDS in (a, b):
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / minhash.BINS - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_match_brute_force(docs):
    """All rows, null ids and repeated rows too: the next document is the next in the order of ids and texts, after the last the first."""
    rows = sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.text or "", r.doc_id) for r in docs.collect())
    expected = Counter()
    for i, (_, text, doc) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, beside = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        expected[doc, len(text), edited, own, changed, round(plain_likeness(own, changed), 9), round(plain_likeness(own, beside), 9)] += 1
    got = minhash.fingerprint_with_next(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected


def test_likeness_is_near_jaccard(spark):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    pairs = []
    for k in range(40):
        a = prose(k, 200 + 10 * k).split()
        pairs.append((" ".join(a), " ".join(a[: len(a) // 2 + 5 * (k % 7)] + prose(k + 500, 40 + k).split())))
    pairs += [("one two", "three four"), ("a b c d e f", "a b c d e g"), ("x", "x")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("near")).collect()
    errors = [r.near - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in got]
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.02


def test_feistel_permutes():
    for n in (1, 2, 3, 64, 65, 1000):
        places = shard.permute(np.arange(n), n, key=5)
        assert sorted(places) == list(range(n)) and (shard.permute(places, n, key=5, back=True) == np.arange(n)).all()
    assert (shard.permute(np.arange(1000), 1000, 1) != shard.permute(np.arange(1000), 1000, 2)).any()


def plain_place(row, n, key):
    """The Feistel network and the walk for one row, in plain integers."""
    mask64 = (1 << 64) - 1

    def mix(x, k):
        x = (x + k) & mask64
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask64
        return x ^ (x >> 31)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = row >> half, row & ((1 << half) - 1)
        for i in range(1, shard.ROUNDS + 1):
            left, right = right, left ^ (mix(right, mix(i * 0x9E3779B97F4A7C15 & mask64, key)) & ((1 << half) - 1))
        row = left << half | right
        if row < n:
            return row


def test_shards_match_brute_force(docs):
    facts = sorted(((r.doc_id is not None, r.doc_id or 0, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())), r.doc_id) for r in docs.collect())
    for shards, key in ((4, 0), (24, 9)):
        expected = Counter()
        for row, ((_, _, size, crc), doc) in enumerate(facts):
            place = plain_place(row, len(facts), key)
            expected[doc, size, crc, place % shards, place // shards] += 1
        assert Counter(map(tuple, shard.shard(docs, shards, key).collect())) == expected


def test_shards(docs, empty):
    rows = shard.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id in (0, 3)} == {(0, 8, 0), (3, 11, zlib.crc32(b"one"))}
    assert sorted(map(tuple, shard.shard(docs.repartition(5), 4).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert shard.shard(empty, 4).count() == 0


def test_groups_hold_few_texts_at_a_time():
    column = pa.array([f"{i} " * 400 for i in range(10_000)])
    tracemalloc.start()
    try:
        assert sum(map(len, batches.text_groups(column, 1 << 16))) == 10_000
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


class Sent:
    """Stands for a table: holds what is selected and the function that batches go through."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        self.columns = columns
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_carried_texts_go_to_python_once_and_batches_leave_no_memory_behind(spark):
    from pyspark.sql import types as T

    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
    sent = batches.map_texts(Sent(T.StructType.fromDDL("doc_id long, text string")), "text", ["doc_id", "text"], "n long", lambda: lambda group: [pa.array([len(pretokens.split([t])[0]) for t in group])])
    assert sent.columns == ("text", "doc_id")
    texts = [None, "", *(prose(i, 400) for i in range(1000)), *["one two " * 2000] * 2000]

    def given():
        for _ in range(2):
            columns = {"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in sent.columns], list(sent.columns))

    before, seen = held(), 0
    for out in sent.run(given()):
        rows = out.to_pydict()
        assert [texts[i] for i in rows["doc_id"]] == rows["text"]
        seen += out.num_rows
    del out, rows
    assert seen == 2 * len(texts) and held() - before < 24


def test_words_of_several_groups_are_remembered_when_others_are_forgotten(monkeypatch):
    made, asked = bpe.Tables(MULTI), []
    real = made.words
    monkeypatch.setattr(made, "words", lambda words: (asked.extend(words), real(words))[1])
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    often, once = b"Anblewh sttible athawh", b"Zu auxle Ststat edlyea reanpa achver trechle"
    first = bpe.code(made, [often])
    bpe.code(made, [once, often])
    assert len(made.known) > 8 and len(asked) == 10
    assert bpe.code(made, [often, b"", once]) == tuple([a[0], b"", b[0]] for a, b in zip(first, bpe.code(bpe.Tables(MULTI), [once]), strict=True))
    assert sorted(asked[10:]) == sorted(w for w in pretokens.split([once])[0])
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    assert bpe.code(made, [often]) == first and asked[17:] == pretokens.split([often])[0]


def test_distinct_pretokens_stand_where_split_has_them():
    texts = [t.encode() for t in [*odd_texts(300, 20), "", "\n", "", "\n\n", *(t or "" for t in TEXTS)]]
    for find in (pretokens.starts, counts.marks):
        words, at, count = pretokens.distinct(texts, find)
        assert ([words[i] for i in at], count.tolist()) == (lambda w, n: (w, n.tolist()))(*pretokens.split(texts, find)) and len(set(words)) == len(words)
    for none in ([b""], [b"", b""]):
        words, at, count = pretokens.distinct(none)
        assert not words and not len(at) and count.tolist() == [0] * len(none)
        assert bpe.code(bpe.tables(MULTI), none) == (none, none)
