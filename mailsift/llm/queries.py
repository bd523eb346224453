"""Registered queries of the llm operators: thin, whole-table applications
with production parameters. Each returns the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.tables import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts and equal mixture of sources."""
    from mailsift.llm.sharding import shard

    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard(rows, 40, tie=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every whole document, and the checksum of its text after decoding."""
    from mailsift.llm.piece_sampling import encode

    ids = encode(read_table(spark, sf_dir, "documents"), check=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into few sequences."""
    from mailsift.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at Jaccard >= 0.85 of their 4-word shingles."""
    from mailsift.llm.jaccard_join import groups

    return groups(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the ids is held out of the fit."""
    from mailsift.llm.compression_classifier import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict after frequent lines of their source are removed."""
    from mailsift.llm.quality_rules import rules

    out = rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    from mailsift.llm.pii import find

    joined = lambda kinds: F.expr(f"array_join(transform(filter(spans, s -> {kinds}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    out = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(joined("s.kind IN ('email', 'ip', 'card', 'phone')"), 256).alias("base_sha256"), joined("true").alias("spans"))


def op8_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and canonical turns of all conversations, recovered from raw
    transcripts; the model learns from four fifths of the conversations."""
    from mailsift.llm.chat_hmm import as_transcript, fit, parse

    raw = as_transcript(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    model = fit(raw.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 5 != 0))
    return parse(raw, model)


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings linked at cosine >= 0.9."""
    from mailsift.llm.epsilon_grid import groups

    out = groups(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier document also holds."""
    from mailsift.llm.substring_dedup import dedup

    out = dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle proof of every document by its language's tree and the tree of
    all languages, and what the proof says of a copy in which some rows are changed."""
    from mailsift.llm.merkle import fold, leaf, proofs, siblings

    docs = read_table(spark, sf_dir, "documents")
    digest = lambda n_chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(changed, digest(F.try_add(F.col("n_chars"), F.lit(1)))).alias("changed"))
    out = proofs(rows, "lang", "doc_id", "leaf").withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all whole documents; a seventh of the ids is held out of the counts."""
    from mailsift.llm.backoff_lm import score

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt from the first turns of
    the first of its twenty ids."""
    from mailsift.llm.prefix_trie import rebuilt, trie

    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(conversations, F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string")) % 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    from mailsift.llm import oracles

    return dict(oracles.SQL)
