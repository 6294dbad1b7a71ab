"""The subpackage's queries by name, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, chat, counts, hardneg, langid, minhash, packing, phrases, quality, secrets, shard, simhash, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = minhash.fingerprint_with_next(_documents(spark, sf_dir))
    sha = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    return marked.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.format_chats(rows).withColumn("turns", chat.parse(F.col("formatted")))
    trained = F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    read = read.withColumn("loss", F.array_join(trained, "")).withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha("said").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha("loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard.shard(_documents(spark, sf_dir), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    said = langid.predict(docs, langid.train(docs))
    return said.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op6_impact_ordered_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256.0)
    return topk.top_k(vectors, F.col("id") % 50 == 0, k=5)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_radix_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = hardneg.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label, 256.0)
    return hardneg.mine(table, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in secrets.BASE + secrets.MORE]
    found = secrets.scan(_documents(spark, sf_dir))
    of = lambda n: F.size(F.filter("spans", lambda s: s["kind_no"] == n)).cast("long").alias(f"n_{kinds[n]}")
    named = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, kinds)), s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = named(F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE)))
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op13_sketched_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir), least=30, top=2000, cover=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_fingerprints, op2_chat_round_trip, op3_feistel_shards, op4_duckdb_bpe, op5_gru_language, op6_impact_ordered_top5, op7_cost_balanced_packing, op8_crf_quality, op9_transducer_counts, op10_simhash_groups, op11_radix_hard_negatives, op12_trigram_secrets, op13_sketched_phrases)}


_TOP5 = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
p AS (
  SELECT row_number() OVER () AS pair, * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY pair ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM r WHERE rank <= 3
"""


def _secrets_sql() -> str:
    """Spans by kind from the pieces between matches and the matches themselves, as lists."""
    rules, lists = secrets.BASE + secrets.MORE, []
    for n, rule in enumerate(rules):
        p = rule.pattern.replace("'", "''")
        lists.append(
            f"list_filter(list_transform(range(1, len(w{n}) + 1), lambda i: {{'start': (list_sum(list_transform(g{n}[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(w{n}[1:i-1], lambda x: length(x))), 0))::BIGINT, 'kind': {n}, 'size': length(w{n}[i])::BIGINT, 'part': length(p{n}[i])}}), lambda s: s.part >= {rule.least})"
        )
        there = f"regexp_matches(t, '{p[:-1]}{{{rule.least}}}')" if rule is secrets.HEX else f"regexp_matches(t, '{p}')"
        found = (f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {rule.group})", f"regexp_split_to_array(t, '{p}')")
        rules_columns = ", ".join(f"CASE WHEN {there} THEN {what} ELSE [] END AS {name}{n}" for name, what in zip("wpg", found, strict=True))
        lists[-1] = (lists[-1], rules_columns)
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = f"list_transform(all_spans, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.size))"
    base = f"list_transform(list_filter(all_spans, lambda s: s.kind < {len(secrets.BASE)}), lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.size))"
    counted = ", ".join(f"len(list_filter(all_spans, lambda s: s.kind = {n}))::BIGINT AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(c for _, c in lists)} FROM d),
f AS (SELECT doc_id, list_sort({" || ".join(x for x, _ in lists)}) AS all_spans FROM m)
SELECT doc_id, {counted}, sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({text}, ',') AS spans FROM f
"""


_PHRASES = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
parts AS (
  SELECT f.*, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rest
  FROM f, range(1, 4) s(cut) WHERE k > cut),
c AS (
  SELECT p.lang, p.k, p.phrase, p.a, l.a AS l, r.a AS r, (2000000::HUGEINT * p.a // (l.a + r.a))::BIGINT AS score, cut
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.first JOIN f r ON r.lang = p.lang AND r.phrase = p.rest),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase, max(a) AS above
  FROM f, range(2, 4) s(size), range(1, 4) t(i) WHERE size < k AND i + size - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE above IS NULL OR 100::HUGEINT * above < 80::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_impact_ordered_top5": _TOP5, "op11_radix_hard_negatives": _NEGATIVES, "op12_trigram_secrets": _secrets_sql(), "op13_sketched_phrases": _PHRASES}
