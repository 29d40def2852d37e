"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctide.llm import license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_model, quality_rules, sharding, suffix_dedup, topk
from doctide.llm.oracles import ORACLES  # noqa: F401
from doctide.sources.documents import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return suffix_dedup.dedup(rows).select(
        "doc_id", (F.octet_length("_kept") + F.col("_n_removed")).cast("long").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = quality_model.train(rows, labels, label="quality")
    return quality_model.score(rows, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(rows, n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_line_dedup, op3_suffix_dedup, op4_quality_model, op5_ngram_join, op6_piece_codec, op7_sharding, op8_quality_rules, op9_topk_search, op10_mixing)}

