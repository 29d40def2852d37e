"""Line deduplication with two Bloom filters.

Pass 1 gives each task a pair of filters: keys seen once, and keys seen twice or
more.  Pairs merge exactly as their keys would (what two "once" filters share goes
to "twice"), piece by piece, in two steps of which each folds one row after the other
into a piece of fixed size; the driver holds the final filter, whose size has a fixed
bound (``bloom.MAX_BITS``).  Pass 2 probes "twice": only suspected repeats are shuffled, as
128-bit digests, and counted exactly, with the document to keep (the largest id).  A
full filter would only let more lines through to the exact count.  Pass 3 drops the
lines: documents that lose none, by a filter of the ids that do, pass as they are and
are not shuffled.

Cases: a null text is one empty line; a null id counts as one document, older than
any other; rows that repeat an id are one document and lose the same lines; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.bloom import BITS_A_KEY, MAX_BITS, MIN_BITS, PIECES, Filters, among, merged
from doctide.llm.work import Work, carried, sliced, with_carried

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    if n < least:
        return False
    if n >= 4 * least or key.isascii():
        return True
    return len(key.decode("utf-8", "replace")) >= least


def _doc_keys(text: bytes | None, least: int) -> set[bytes]:
    if not text:
        return set()
    return {k for k in map(line_key, text.split(b"\n")) if long_enough(k, least)}


def _build(n_bits: int, least: int):
    def run(batches):
        f = Filters(n_bits)
        for batch in sliced(batches):
            hashes = [xxhash.xxh3_64_intdigest(k) for t in batch.column("text").to_pylist() for k in _doc_keys(t, least)]
            f.add(np.array(hashes, np.uint64))
        yield from f.pieces()
    return run


def _suspects(shared, n_bits: int, least: int):
    def run(batches):
        table = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in sliced(batches):
            keys, ids = [], []
            for t, i in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist()):
                found = _doc_keys(t, least)
                keys += found
                ids += [i] * len(found)
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            hit = np.flatnonzero(Filters.has(table, hashes)) if keys else []
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([digest(keys[j]) for j in hit], pa.binary()),
                "id": pa.array([ids[j] for j in hit], pa.int64()),
            })
    return run


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _drop(least: int):
    def run(batches):
        for batch in sliced(batches):
            texts, counts, dropped = [], [], []
            for t, gone in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist()):
                lines = (t or b"").split(b"\n")
                counts.append(len(lines))
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if not (long_enough(k := line_key(x), least) and digest(k) in gone)]
                    dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(t or b"")
            columns = {
                "_keep": batch.column("_keep"), "_kept": pa.array(texts, pa.binary()), "_n_lines": pa.array(counts, pa.int64()),
                "_n_dropped": pa.array(dropped, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)
    return run


def filter_size(df: DataFrame, text: str, least: int) -> int:
    """Bits for every line that could be a key, as a power of two within fixed bounds."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    want = BITS_A_KEY * total // (least + 1)
    n = MIN_BITS
    while n < min(want, MAX_BITS):
        n *= 2
    return n


def twice_filter(rows: DataFrame, n_bits: int, least: int) -> bytes:
    """The merged filter of keys seen twice or more (its size is bounded by MAX_BITS)."""
    return merged(rows.select("text").mapInArrow(_build(n_bits, least), PIECES), n_bits, "twice")


def repeated_lines(df: DataFrame, work: Work, text: str = "text", id_col: str = "doc_id",
                   min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, gone) for each document that must lose lines: the digests of their keys."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                     F.col(text).cast("binary").alias("text"))
    n_bits = filter_size(df, text, min_chars)
    shared = spark.sparkContext.broadcast(twice_filter(rows, n_bits, min_chars))
    suspects = work.put(rows.mapInArrow(_suspects(shared, n_bits, min_chars), "key binary, id long"), "suspects")
    # as a table, so that both sides of the join are plain exchanges and Spark can split a frequent key
    confirmed = work.put(
        suspects.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("key", "keeper"), "confirmed")
    gone = work.put(suspects.join(confirmed, "key").filter(F.col("id") != F.col("keeper"))
                    .groupBy("id").agg(F.collect_set("key").alias("gone")), "gone")
    work.drop("suspects", "confirmed")
    work.free()
    return gone


def dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] | None = None,
          min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """keep's columns (default: all but text), then _kept (text without the dropped lines), _n_lines, _n_dropped."""
    keep = tuple(c for c in df.columns if c != text) if keep is None else keep
    gone = repeated_lines(df, Work(df.sparkSession, "line-dedup"), text, id_col, min_docs, min_chars)
    loses = among(gone, gone.count())
    rows = df.select(carried(keep), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_loses", loses("_id"))
    whole = rows.filter(~F.col("_loses")).select(
        "_keep", F.col("_text").alias("_kept"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_n_lines"),
        F.lit(0).cast("long").alias("_n_dropped"))
    some = rows.filter("_loses").select("_keep", "_id", F.col("_text").cast("binary").alias("_text"))
    joined = some.join(gone.withColumnsRenamed({"id": "_id", "gone": "_gone"}).hint("shuffle_hash"), "_id", "left").drop("_id")
    cut = joined.mapInArrow(_drop(min_chars), with_carried(rows, "_kept binary, _n_lines long, _n_dropped long"))
    return whole.union(cut.withColumn("_kept", F.col("_kept").cast("string"))).select("_keep.*", "_kept", "_n_lines", "_n_dropped")
