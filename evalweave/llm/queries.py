"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import chat, jaccard, lexical, minhash, mixing, packing, phrases, quality, secrets, shards, tokens, vafile, warc
from evalweave.llm.common import Scratch
from evalweave.llm.sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two increments over one ledger; the second holds copies of blobs of the first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.counts(secrets.findings(docs, spark, increments=2))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.fingerprints(docs, spark, groups=minhash.near_groups(docs, spark))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, spark, public_tokenizers.path("piece_bpe_32k.model"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.array(F.lit("user"), F.lit("assistant"))
    hostile = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(roles).alias("turn", "role"), F.lit(chat.HOSTILE).alias("text"))
    everything = said.unionByName(hostile.withColumn("turn", F.col("turn").cast("long")))
    return chat.digests(chat.read_back(chat.examples(everything)))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, spark).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents").select("doc_id", "text"), spark)


def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, spark, public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = Scratch(spark, "archive").base
    back = warc.read(spark, out, warc.write(pages, spark, out))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def compacted(spark: SparkSession, docs: DataFrame, store: shards.ShardStore) -> dict:
    """Every document is in one arrival; there are as many arrivals as a merge takes, so that each size of table compacts."""
    for i in range(store.fanout):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(store.fanout)) == i), rows=2000)
    return store.compact()


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    store = shards.ShardStore(spark, Scratch(spark, "shards").base)
    compacted(spark, docs, store)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs).select("row.doc_id", *measures, "base_failed", "kept")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"), spark)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), spark, k=5, every=50)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.ranked(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"), spark, k=20)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_fingerprints, op3_token_counts, op4_chat_format, op5_source_mix, op6_ngram_jaccard, op7_sequence_packing, op8_warc_archive, op9_size_tiered_shards, op10_quality_rules, op11_phrase_mining, op12_exact_top_k, op13_lexical_search)}
__all__ = ["QUERIES", "SQL", "F"]
