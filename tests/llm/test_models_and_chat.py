"""Chat round trips, top-k, the trained models and the pipeline."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspan.llm import chat, langid, queries, quality, simhash, topk

from .conftest import TEXTS, prose

SF = "/root/testdata/sf0.001"


def test_chats_come_back(spark):
    r = random.Random(3)
    parts = ["<", "[", "s>", "/", "INST]", "␛", "</s>", "[INST]", "[/INST]", "<s>", "<␛s>", "[␛␛/INST]", " ok", "\n", "é", "𝒳"]
    rows = [(i // 3, i % 3, r.choice(["user", "assistant", "x[INST]", ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 9))), "more") for i in range(600)] + [(1000, 0, "user", "plain", "more")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    said = F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    turns = {}
    for c, _, role, text, _ in rows:
        turns.setdefault(c, []).append((role, text))
    out = made.select("conv_id", chat.parse(F.col("formatted")).alias("back"), said.alias("loss"), "rounds").collect()
    assert len(out) == len(turns) and {x.rounds for x in out} == {1, 2}
    for x in out:
        assert [tuple(t) for t in x.back] == turns[x.conv_id]
        assert x.loss == [t for role, t in turns[x.conv_id] if role == "assistant"]


def test_chat_edge_cases(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "user", None), (1, 0, "user", "b"), (1, None, "assistant", "a" * 200_000), (2, 5, None, "</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {x.conv_id: [tuple(t) for t in x.back] for x in chat.format_chats(frame).select("conv_id", chat.parse(F.col("formatted")).alias("back")).collect()}
    assert out == {None: [("", "")], 1: [("assistant", "a" * 200_000), ("user", ""), ("user", "b")], 2: [("", "</s>")]}
    assert chat.format_chats(frame).filter("conv_id IS NULL").count() == 2
    assert chat.format_chats(frame.filter("1 = 0")).count() == 0
    broken = spark.createDataFrame([("<s>user[INST]x[/INST]",), ("<s>user[INST][INST]x[/INST]</s>",)], "f string")
    assert [r[0] for r in broken.select(chat.parse(F.col("f"))).collect()] == [None, None]


def test_chat_query(spark):
    out = {r.conv_id: r for r in queries.op2_chat_round_trip(spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert out[-1].loss_chars == len(text) and out[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def brute_top(vectors, queries_, k):
    out = {}
    for q, v in queries_:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize(("block", "group"), [(8192, 1024), (17, 3)])
def test_top_k_is_exact(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", group)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(150)] + [(i, [0.5] * 12) for i in range(150, 190)]
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan")] * 12), (203, [math.inf] * 12), (204, []), (205, [0.3]), (None, [0.1] * 12)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 256.0)
    held = [(r.id, list(r.v)) for r in vectors.collect()]
    assert {i for i, _ in held} == {*range(190), 204, 205}
    asked = [(i, v) for i, v in held if i % 10 == 0]
    got = {}
    for r in sorted(topk.top_k(vectors, F.col("id") % 10 == 0, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(held, asked, 5)
    assert topk.top_k(vectors.filter("1 = 0"), F.col("id") % 10 == 0, 5).count() == 0


@pytest.mark.parametrize(("block", "group"), [(8192, 1024), (3, 1)])
def test_top_k_of_repeated_ids(spark, monkeypatch, tmp_path, block, group):
    """A repeated id is a query a row and a candidate a row; columns of clashing names take no part."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", group)
    rng = np.random.default_rng(8)
    rows = [(i % 60, [float(x) for x in rng.normal(0, 0.2, 6)], 1, 2, 3) for i in range(100)] + [(50, [0.25] * 6, 1, 2, 3), (50, [0.25] * 6, 1, 2, 3), (None, [0.25] * 6, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int, id int, block int")
    vectors = topk.quantise(frame, "vec_id", "embedding", 256.0)
    held = [(r.id, list(r.v)) for r in vectors.collect()]
    expected = []
    for n, (q, v) in enumerate(held):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(held) if m != n)[:5]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = sorted(map(tuple, topk.top_k(vectors, F.col("id") % 50 == 0, 5).collect()))
    assert got == sorted(expected)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(queries.oracle_sql()["op6_impact_ordered_top5"]).fetchall()) == got


@pytest.mark.parametrize("wide", [[(1, [1e30, 1.0]), (50, [1e300, -1e300])], [(7, [2.0**33, 0.5])], [(50, [2.0**20, 2.0**20]), (2, [2.0**20, -(2.0**20)])]])
def test_top_k_of_wide_components_is_exact(spark, wide):
    """Beyond 53 bits Python's integers score; beyond 64 bits the nearest long counts."""
    rng = np.random.default_rng(4)
    rows = wide + [(i, [float(x) for x in rng.normal(0, 2, 2)]) for i in (0, 3, 4, 5, 100, 101)]
    got = sorted(map(tuple, topk.top_k(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256.0), F.col("id") % 50 == 0, 3).collect()))
    whole = [(i, [math.floor(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308)) for x in v]) for i, v in rows]
    expected = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for m, (i, w) in enumerate(whole) if m != n)[:3]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)


def test_top_k_reads_less_than_all_only_on_proof():
    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (600, 8))
    block = topk.Block(np.arange(600), np.arange(600), x)
    for i in range(0, 600, 60):
        ids, scores = block.search(x[i], i, 5)
        expected = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == expected


def test_features_of_lines():
    x, size, count = quality.line_features([b"one two two\n\n  \nABC DEF!", b"", b" \n ", "É | é | x".encode()])
    assert count.tolist() == [2, 1, 1, 1] and size.tolist() == [11, 8, 0, 1, 11]
    assert x.shape == (5, quality.FEATURES) and x[0, 5] == pytest.approx(1 / 3) and x[1, 0] == 1.0
    assert (x[0, 2 * quality.OWN : 3 * quality.OWN] == x[1, : quality.OWN]).all()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    chain = quality.Chain(rng.normal(0, 1, quality.FEATURES), rng.normal(0, 1, (2, 2)), np.zeros(2))
    count = np.array([1, 4, 3])
    x = rng.normal(0, 0.3, (8, quality.FEATURES))
    got, expected_steps = chain.marginals(x, count)
    at, want, steps = 0, [], np.zeros((2, 2))
    for n in count:
        score = x[at : at + n] @ chain.line
        paths = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            paths[tuple(y)] = math.exp(sum(s for s, v in zip(score, y) if v) + sum(chain.step[a, b] for a, b in zip(y, y[1:])))
        total = sum(paths.values())
        want += [sum(w for y, w in paths.items() if y[i]) / total for i in range(n)]
        for y, w in paths.items():
            for a, b in zip(y, y[1:]):
                steps[a, b] += w / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected_steps, steps)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = "\n".join(prose(i + k, 12) if good or k == 0 else " | ".join(prose(i + k, 14).split()) for k in range(4))
        rows.append((i, text, ("en", "xx")[i % 2], "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns(spark, labelled, docs, empty):
    texts, labels = labelled
    model = quality.train(texts, labels)
    scores = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    out = [i for i in scores if held_out(i)]
    assert np.mean([(scores[i] >= 0.7) == (i % 4 != 0) for i in out]) > 0.95
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.score(texts, quality.train(texts, wrong)).collect()} == scores
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect()) and quality.score(docs, model).count() == docs.count()
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.train(docs, labels.filter("1 = 0"))).first().score == 0.5


def plain_quality(model, text):
    """A document's score by forward and backward sums over its lines, one at a time."""
    x, size, _ = quality.line_features([text.encode()])
    local = [[1.0, math.exp(row @ model.line)] for row in x]
    step = [[math.exp(model.step[a, b]) for b in (0, 1)] for a in (0, 1)]
    forward, backward = [local[0]], [[1.0, 1.0]]
    for now in local[1:]:
        forward.append([now[b] * sum(forward[-1][a] * step[a][b] for a in (0, 1)) for b in (0, 1)])
    for after in reversed(local[1:]):
        backward.insert(0, [sum(step[a][b] * after[b] * backward[0][b] for b in (0, 1)) for a in (0, 1)])
    good = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
    mean = sum(g * (n + 1) for g, n in zip(good, size)) / sum(n + 1 for n in size)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * mean)))


def test_quality_reads_every_line_and_takes_fewer_rows(spark):
    """Bad lines behind the first 300 still teach; a bound on lines leaves out whole documents."""
    rows = []
    for i in range(160):
        bad = i % 2 == 0
        rows.append((i, "\n".join([prose(i + k, 8) for k in range(300)] + [("| = | " * 30 if bad else prose(i, 30)) for _ in range(300)])))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(texts, quality.train(texts, labels)).collect()}
    assert np.mean([(s >= 0.7) == (i % 2 == 1) for i, s in scores.items() if held_out(i)]) > 0.9
    assert quality.train(texts, labels, lines=599).curve.tolist() == [0.0, 0.0]
    some = quality.train(texts, labels, lines=12_000)
    repeated = texts.union(texts.filter("doc_id < 5")).union(texts.filter("doc_id = 1")).repartition(7)
    assert (quality.train(repeated, labels, lines=12_000).line == some.line).all()


def plain_language(net, text):
    """Pooled probabilities of a text, window by window and byte by byte, states one at a time."""

    def states(layer, data):
        u, h, out = langid.UNITS, np.zeros(langid.UNITS), []
        for b in data:
            given, inner = layer.byte[:, b].astype(float), layer.state.astype(float) @ h
            z, r = 1 / (1 + np.exp(-(given[:u] + inner[:u]))), 1 / (1 + np.exp(-(given[u : 2 * u] + inner[u : 2 * u])))
            h = (1 - z) * np.tanh(given[2 * u :] + r * (inner[2 * u :] + layer.bias[:, 0])) + z * h
            out.append(h)
        return out

    total, letters = np.zeros(len(net.languages)), 0
    for at in range(0, len(text), langid.SPAN):
        window = text[at : at + langid.SPAN].ljust(langid.SPAN, b"\0")
        for b, f, g in zip(window, states(net.ahead, window), states(net.behind, window[::-1])[::-1], strict=True):
            if b >= 128 or chr(b).isalpha():
                score = net.out.astype(float) @ np.concatenate((f, g)) + net.out_bias[:, 0]
                total += score - score.max() - math.log(np.exp(score - score.max()).sum())
                letters += 1
    mean = total / max(letters, 1)
    return np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()


def test_pooling_matches_a_plain_loop():
    rng = np.random.default_rng(6)
    net = langid.Network(langid.Layer.new(rng), langid.Layer.new(rng), rng.normal(0, 1, (3, 2 * langid.UNITS)).astype(np.float32), rng.normal(0, 1, (3, 1)).astype(np.float32), ["a", "b", "c"])
    texts = [b"", b"12 !", b"one", prose(1, 60).encode(), "naïve 東京 𝒳 ".encode() * 30, b"x" * 128, b"y" * 129]
    assert np.allclose(net.pooled(texts), [plain_language(net, t) for t in texts], atol=1e-4)


def test_training_rows_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(langid, "BATCHES", 3)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i % 40, prose(i % 40, 20), ("de", "en")[i % 2]) for i in range(400)] + [(3, prose(3, 20), "en")] * 300
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = langid.train(texts, sample=10), langid.train(texts.repartition(9), sample=10)
    assert (one.out == two.out).all()
    with pytest.raises(ValueError, match="languages"):
        langid.train(texts.union(spark.createDataFrame([(1000, "x", "fr"), (1001, "x", "fr"), (1003, "x", "fr")], texts.schema)))


def test_gradient_of_the_network():
    rng = np.random.default_rng(5)
    layer = langid.Layer.new(rng)
    steps = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    aim = rng.normal(0, 1, (7, langid.UNITS, 3)).astype(np.float32)
    states, kept = langid._forward(layer, steps)
    assert np.allclose(states, layer.run(steps), atol=1e-5)
    grads = langid._backward(layer, kept, aim)
    for w, g in zip((layer.byte, layer.state, layer.bias), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, e = w[at], 1e-2
        w[at] = before + e
        up = (langid._forward(layer, steps)[0] * aim).sum()
        w[at] = before - e
        down = (langid._forward(layer, steps)[0] * aim).sum()
        w[at] = before
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.05, abs=0.02)


def test_languages(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(langid, "BATCHES", 250)
    rows = [(i, " ".join(("der ist nicht und", "the of and with")[i % 2].split()[(i * 7 + k * k * k + k // 3) % 4] for k in range(30)), ("de", "en")[i % 2] if i % 9 else None) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(texts)
    said = {r.doc_id: r.lang_pred for r in langid.predict(texts, net).collect()}
    assert net.languages == ["de", "en"]
    assert np.mean([said[i] == ("de", "en")[i % 2] for i in said if held_out(i)]) > 0.95
    out = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 15)] == ["und"] * 4 and out[14].lang_pred != "und" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.predict(empty, net).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"} and langid.train(empty) is None


def test_pipeline_stages_act(spark, labelled, tmp_path):
    texts, labels = labelled
    texts.union(texts.filter("doc_id = 1").withColumn("doc_id", F.lit(900))).union(spark.createDataFrame([(901, "12 34", None, None, None)], texts.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.DOCUMENTS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.collect()}
        if k == 0:
            assert not [i for i in after if i < 900 and i % 4 == 0] and len([i for i in after if i < 900]) == 180
        if k == 1:
            assert 901 not in after
        if k == 2:
            assert 900 not in after and 1 in after
        assert after <= before
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= after | {901}


def plain_near_dedup(rows):
    """The smallest id of each group of texts within three bits or of five-word similarity 0.8, by looking at all pairs."""
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows.items()}
    marks = {i: simhash.simhash((t or "").encode()) for i, t in rows.items()}
    root = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and ((marks[a] ^ marks[b]).bit_count() <= 3 or 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b]) > 0):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_pipeline_matches_brute_force(spark, labelled, tmp_path):
    """Each stage against a plain version on its own input; documents with further columns, null ids, null, empty and long texts."""
    texts, labels = labelled
    more = [(None, prose(3, 40), "en", None, None), (None, None, None, None, None), (901, "12 34", None, None, None), (902, "", "en", "s", 0), (903, None, None, None, None), (904, prose(8, 9000), "en", "s", 1), (905, prose(8, 8990) + " end", "en", "s", 1)]
    texts.union(texts.filter("doc_id % 9 = 1").withColumn("doc_id", F.col("doc_id") + 1000)).union(spark.createDataFrame(more, texts.schema)).withColumns({"score": F.lit("x"), "id": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda rows: sorted(rows, key=repr)

    def stage(k):
        nonlocal docs
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        return docs.collect()

    model = quality.train(docs, labels)
    held = [(i, t) for i, t in held if plain_quality(model, t or "") >= corpus_pipeline.MIN_QUALITY]
    assert key((r.doc_id, r.text) for r in stage(0)) == key(held)
    net = langid.train(docs)
    held = [(i, t) for i, t in held if any(c.isalpha() for c in t or "") and plain_language(net, t.encode()).max() >= corpus_pipeline.MIN_LANGUAGE]
    assert key((r.doc_id, r.text) for r in stage(1)) == key(held)
    kept = plain_near_dedup({i: t for i, t in held if i is not None})
    held = [(i, t) for i, t in held if i is None or i in kept]
    assert key((r.doc_id, r.text) for r in stage(2)) == key(held)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(stage(3), key=lambda r: r.start):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in pieces.items() if i is not None} == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in held if i is not None}


def test_pipeline_of_nothing(spark, labelled, tmp_path):
    texts, labels = labelled
    texts.filter("1 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    labels.filter("1 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_of_top5(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(con.sql(queries.oracle_sql()["op6_impact_ordered_top5"]).fetchall())
    assert sorted(tuple(r) for r in queries.op6_impact_ordered_top5(spark, SF).select("query_id", "rank", "vec_id", "score").collect()) == expected


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert len(TEXTS) == 17
