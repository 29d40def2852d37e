"""A corpus pipeline of five operators: each stage's result is written and read by the next.

quality rules drop the documents they reject; line deduplication drops repeated
lines; the n-gram join keeps one document of each group of near copies; mixing takes
each document as often as its source's weight asks, once at least, and deals them into
blocks of the target weights, whose order the rows are written in; the codec encodes.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctide.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from doctide.llm.queries import tokenizer
from doctide.llm.work import Work, recorded, sweep


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select("text", "lang", "source", F.struct("*").alias("_row"))
    return quality_rules.judge(rows, keep=("_row",)).filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat elsewhere; n_chars follows the text; a null text becomes empty."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    out = line_dedup.dedup(rows, keep=("_row",))

    def column(name):
        if name == "text":
            return F.col("_kept").alias(name)
        own = F.col("_row")[name]
        if name == "n_chars":
            own = F.when(F.col("_n_dropped") > 0, F.length("_kept").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return out.select(*[column(c) for c in docs.columns])


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8), the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, n=5, percent=80).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, in the mixture's order."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, and digests of the ids and of what they decode to."""
    return piece_codec.digests(docs, tokenizer("piece_bpe_32k.model"), keep=("doc_id", "source"))


class _Made(threading.local):
    """Working folders of stages whose results may not be written yet; of each thread's pipeline its own."""

    def __init__(self):
        self.works: list[Work] = []


_made = _Made()


def _stage(step):
    """The step; before it, what earlier stages worked with is deleted, as docs are their written results."""
    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(_made.works, docs)
        with recorded(_made.works):
            return step(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _stage(rules)),
    ("line dedup", _stage(lines)),
    ("n-gram Jaccard join", _stage(copies)),
    ("mixing", _stage(mixture)),
    ("SentencePiece encoding and decoding", _stage(encoded)),
]

#: The join, the mixture and the codec have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read by the next."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.put(docs, f"stage-{k}")
    return docs
