"""Uniform sharding by a hypergeometric communication matrix.

A uniformly random way to deal N rows into shards of fixed sizes can be drawn in
three steps, none of which brings the rows together:

1. draw how many rows each partition sends to each shard, exactly, from the
   multivariate hypergeometric law (row sums: partition sizes; column sums: shard
   sizes).  Only this matrix of counts is on the driver;
2. permute each partition and cut it at those counts; exchange;
3. permute each shard.  This is again done in many tasks: rows of a shard are spread
   over buckets by a random key, buckets are counted, and each bucket is sorted and
   placed after the rows of the buckets before it.

Shard sizes are exact: they differ by one at most.  Rows are written once before
they are counted, so that a lost executor cannot change a partition's rows between
the steps.  All draws follow from ``seed`` and the rows' places in that table.

Cases: a null text has size 1 (no bytes, plus 1) and the crc of the empty text; equal
rows are still dealt one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctide.llm.work import Work, carried

#: Rows a bucket of the last permutation holds, about.
BUCKET_ROWS = 4096
#: Below numpy's limit on each part of a population.
LIMIT = 1_000_000_000


def communication_matrix(parts: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """counts[p, s], uniform over all ways to deal rows: sums are parts and shards."""
    rng = np.random.default_rng(seed)
    left = shards.astype(np.int64).copy()
    out = np.zeros((len(parts), len(shards)), np.int64)
    for p, n in enumerate(parts):
        rest, total = int(n), int(left.sum())
        for s in range(len(shards)):
            if s == len(shards) - 1:
                x = rest
            else:
                total -= int(left[s])
                x = _draw(rng, int(left[s]), total, rest)
            out[p, s] = x
            left[s] -= x
            rest -= x
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw: how many good ones are among the first n of good + bad in random order.

    Beyond numpy's limit on populations the order is split: the middle good one's place is that of an
    order statistic of uniforms, the bad ones before it are binomial given that place, and either it is
    among the first n, with all before it, or the draw lies before it.  Each split halves the good ones.
    """
    found = 0
    while n and good and bad and max(good, bad) >= LIMIT:
        if n >= good + bad:
            return found + good
        if good < bad and good < LIMIT // 2:  # the bad ones are halved instead
            return found + n - _draw(rng, bad, good, n)
        k = (good + 1) // 2
        before = int(rng.binomial(bad, rng.beta(k, good + 1 - k)))
        if k + before <= n:
            found, good, bad, n = found + k, good - k, bad - before, n - k - before
        else:
            good, bad = k - 1, before
    if n == 0 or good == 0:
        return found
    if bad == 0 or n >= good + bad:
        return found + min(n, good)
    return found + int(rng.hypergeometric(good, bad, n))


def shard(df: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """All columns of df, with _shard (int) and _slot (long, gapless from 0 in each shard), which replace any of df's own."""
    spark = df.sparkSession
    work = Work(spark, "sharding")
    own = [c for c in df.columns if c.lower() not in ("_shard", "_slot")]
    table = work.put(df.select(carried(own), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "rows")
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total = sum(r["n"] for r in sizes)
    shards = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)])
    counts = communication_matrix(np.array([r["n"] for r in sizes]), shards, seed)
    cuts = spark.createDataFrame(
        [(r["_part"], [int(x) for x in np.cumsum(c)]) for r, c in zip(sizes, counts)] or [(-1, [0])],
        "_part int, _cuts array<bigint>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    # few partitions' cuts are broadcast by Spark under its own size threshold, else joined on _part
    dealt = (
        table.withColumn("_q", F.row_number().over(local) - 1).join(cuts, "_part")
        .withColumn("_shard", F.expr("size(filter(_cuts, c -> c <= _q))").cast("int"))
        .withColumn("_key", F.xxhash64(F.lit(seed + 1), "_row"))
    )
    n_buckets = max(1, total // n_shards // BUCKET_ROWS)
    # the key is a signed 64-bit number; its upper bits choose the bucket, in the key's order
    dealt = dealt.withColumn(
        "_bucket", F.least(F.floor((F.shiftright("_key", 32) + F.lit(1 << 31)) * n_buckets / (1 << 32)), F.lit(n_buckets - 1)))
    dealt = work.put(dealt.select("_keep", "_shard", "_bucket", "_key", "_row"), "dealt")
    filled = dealt.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_key", "_row")
    return (
        dealt.withColumn("_k", F.row_number().over(inside) - 1).join(starts, ["_shard", "_bucket"])
        .select("_keep.*", "_shard", (F.col("_start") + F.col("_k")).cast("long").alias("_slot"))
    )
