"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.llm import bpe, chat, decontamination, jaccard, language, merkle, packing, prefix_trie, quality_model, quality_rules, sharding, token_spans, toxicity
from trialkit.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, table(spark, folder, "benchmark"), "found", keep_text=False)
    found = F.col("found")
    return marked.select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"), decontamination.contaminated(found).alias("contaminated"),
    )


SQL["op1_decontamination"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
  windows AS (SELECT item_id, least(13, len(w)) AS size, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, greatest(2, len(w) - 11))]) AS window
      FROM b WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT size FROM windows),
  places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d JOIN sizes ON len(w) >= size),
  parts AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS window FROM places),
  hits AS (SELECT p.doc_id, p.size, p.i, item_id FROM parts p JOIN windows v ON p.window = v.window AND p.size = v.size),
  hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op4_risk_controlled_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge(docs, table(spark, folder, "labels"))
    m = F.col("metrics")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


#: vocabulary of the encoding queries
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def bpe_digest(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, vocabulary(), "coded", keep_text=False, decoded=True)
    ids = F.col("coded")["ids"]
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("coded")["decoded"], 256).alias("decoded_sha256"),
    )


@query
def op10_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digest(table(spark, folder, "documents").select("doc_id", "text"))


def chat_digest(rows: DataFrame) -> DataFrame:
    done = chat.format_records(chat.records_of(rows), given="given").select("conv_id", "formatted", "mask")
    done = done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("mask")))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op9_chat_layouts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]").alias("text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    return chat_digest(rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles, tricky)))


SQL["op9_chat_layouts"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  p AS (SELECT *, CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'OUT' WHEN 'system' THEN 'SYS' ELSE 'X:' || hex(role) END AS mark,
      regexp_replace(text, '([\[<])(\\*)(/?(?:(?:INST|OUT|SYS|X:[0-9A-F]*)\]|s>))', '\1\2\\\3', 'g') AS body FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(7 + sum(7 + 2 * length(mark) + length(body)) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


@query
def op6_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def remainder(n: int) -> Column:
    """Fold of a document: CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op5_centroid_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(remainder(3) != 1), "doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), model, "found", keep_text=False)
    return found.select(
        "doc_id", (remainder(3) == 1).alias("held_out"), F.col("found")["lang"].alias("lang_pred"), F.col("found")["score"].alias("score"),
        F.col("found")["rejected"].alias("rejected"),
    )


def scored(found: DataFrame, folds: int, held: int) -> DataFrame:
    s = F.col("found")["score"]
    return found.select("doc_id", (remainder(folds) == held).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


@query
def op2_boosted_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels").filter(remainder(5) != 0))
    return scored(toxicity.score(docs, model, "found", keep_text=False), 5, 0)


@query
def op7_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, folder, "labels").filter(remainder(3) != 1))
    return scored(quality_model.score(docs, model, "found", keep_text=False), 3, 1)


@query
def op8_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    counted = token_spans.attribute(docs, vocabulary(), ["source", "lang", "text"], by_line=["text"]).select("doc_id", "tokens")
    parts = counted.select("doc_id", F.col("tokens")["n_tokens"].alias("doc_tokens"), F.col("tokens")["n_outside"].alias("n_outside"), F.explode("tokens.parts").alias("p"))
    return parts.select("doc_id", "doc_tokens", "n_outside", "p.*")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents; claims are rows as somebody hands them back, every fifth of them with lower-cased text."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(remainder(5) == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    claim = F.when(tampered, merkle.leaf_digest([*fields[:-1], lowered]))
    found = merkle.proofs(merkle.build(table(spark, folder, "documents"), fields, carry={"claim": claim}))
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: vocabulary of the packing query
WORD_VOCABULARY = "word_bpe_49k.json"


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_VOCABULARY)


@query
def op12_least_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), word_vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def branched(turns: DataFrame, families: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: the first h turns of the family's first conversation, then the conversation's own turns after its first h.

    h is CRC-32 of the id modulo 4. Returns the turns and the lengths. Turns meet the length of their branch by id and block of 4,096 turns, so a very long
    conversation is spread.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h")
    turns = cut(turns.withColumn("h", h))
    sizes = cut(turns.groupBy("conv", "h").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("conv") - F.col("conv") % families))
    heads = turns.filter((F.col("conv") % families == 0) & (F.col("place") < 3)).select(F.col("conv").alias("base"), "place", "x", "y", "words")
    copied = cut(sizes.select("conv", "h", "base").join(heads, "base").filter("place < h").select("conv", "place", "x", "y", "words"))
    taken = copied.groupBy("conv").agg(F.count(F.lit(1)).alias("taken"))
    lengths = cut(sizes.join(taken, "conv", "left").select("conv", "h", "n", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))
    block = F.floor(F.col("place") / prefix_trie.CHUNK).alias("block")
    spread = lengths.select("conv", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / prefix_trie.CHUNK))).alias("block"))
    own = turns.filter("place >= h").withColumn("block", block).join(spread, ["conv", "block"])
    kept = own.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "x", "y", "words")
    return kept.unionByName(copied), lengths.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(*branched(prefix_trie.turns_of(rows))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
