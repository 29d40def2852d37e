"""Mixing sources to target weights by temperature.

With token shares ``p`` the weights are ``p ** exponent``, normalised.  An exponent of
1 keeps the corpus as it is, 0 makes sources equal.  It is bisected until the weights
reach a target entropy (a fraction of the largest possible) without repeating any
source more than ``max_epochs`` times while every source is seen once at least; where
both bind, the repetition limit wins.

The weights are realised as block permutations under a token budget (the caller's, or
the least that takes every document once): each source's documents are permuted anew
for each epoch, full epochs take every document and the last one the longest run of its
permutation that fits what is left of the source's part of the budget.  A document's
place in its source's stream of tokens gives its block: each block draws from each source
its weight's share of ``block_tokens``, and its rows stand in the order of ``place``, a
random key.

Running sums are made in many tasks (bucket totals, then places inside a bucket), so
one source may hold any part of all rows.  The driver gets a row for each distinct token
total that sources have: with T tokens in all these are fewer than sqrt(2 T), however many
sources there are.

Tokens are words between blanks, one at least.  Cases: null or empty text: one token;
a null source is a source of its own; rows equal in id and text share their key and
so their decision; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctide.llm.work import Work

SPACE = r"[\x20\x09-\x0D]+"
TARGET_ENTROPY, MAX_EPOCHS, BLOCK_TOKENS, SEED = 0.95, 2.0, 1 << 20, 11
BUCKET_ROWS = 4096
#: Sources up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
STEPS = 60


def n_tokens(text: str) -> Column:
    found = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""))
    return F.greatest(found, F.lit(1)).cast("long")


def weights_at(shares: np.ndarray, many: np.ndarray, exponent: float) -> np.ndarray:
    """A source's weight, where many[j] sources have shares[j] each."""
    raised = shares ** exponent
    return raised / math.fsum(raised * many)


def entropy(weights: np.ndarray, many: np.ndarray) -> float:
    w = np.where(weights > 0, weights, 1.0)
    return -math.fsum(many * weights * np.log(w))


def epochs_at(shares: np.ndarray, weights: np.ndarray) -> float:
    """Largest number of epochs of a source while each is seen once at least."""
    ratios = weights / shares
    return float(ratios.max() / ratios.min())


def fit_exponent(shares, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, many=None) -> float:
    """The largest exponent that reaches the entropy, or the smallest that the limit allows."""
    shares = np.asarray(shares, np.float64)
    many = np.ones(len(shares)) if many is None else np.asarray(many, np.float64)
    if many.sum() < 2:
        return 1.0
    goal = target_entropy * math.log(many.sum())
    weights = lambda a: weights_at(shares, many, a)

    def smallest(good) -> float:
        """Smallest exponent in [0, 1] from which good holds (it holds at 1)."""
        low, high = (0.0, 0.0) if good(0.0) else (0.0, 1.0)
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return high

    if entropy(weights(1.0), many) >= goal:
        return 1.0
    at_limit = smallest(lambda a: epochs_at(shares, weights(a)) <= max_epochs)
    low, high = 0.0, 1.0  # entropy falls from low to high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(mid), many) >= goal else (low, mid)
    return max(low, at_limit)


def decide(totals, many, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS,
           budget: int | None = None) -> list[tuple[int, float, int]]:
    """(total, weight, tokens to take) for each distinct total, which many[j] sources have.

    Without a budget the scarcest source is taken just once; with one, a source gets its weight's
    part of it, max_epochs times its total at most.
    """
    totals, many = np.asarray(totals, np.float64), np.asarray(many, np.float64)
    if not len(totals):
        return []
    shares = totals / math.fsum(totals * many)
    weights = weights_at(shares, many, fit_exponent(shares, target_entropy, max_epochs, many))
    tokens = max(totals / weights) if budget is None else budget
    out = []
    for t, w in zip(totals.astype(np.int64).tolist(), weights.tolist()):
        take = min(round(w * tokens), math.floor(max_epochs * t + 1e-6))
        out.append((t, w, max(t, take) if budget is None else take))
    return out


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _row_key(id_col: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def _placed(copies: DataFrame) -> DataFrame:
    """Adds _before: tokens of the (_src, _copy) stream before this row's key; rows with one key share it and _tied."""
    copies = copies.withColumn("_bucket", F.least(
        F.floor((F.shiftright("_order", 32) + F.lit(1 << 31)) * F.col("_buckets") / (1 << 32)), F.col("_buckets") - 1))
    filled = copies.groupBy("_src", "_copy", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_src", "_copy").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("_src", "_copy", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # equal keys are summed first: a window never holds more than one row a key
    tied = copies.groupBy("_src", "_copy", "_bucket", "_order").agg(F.sum("_tokens").alias("_tied"))
    inside = Window.partitionBy("_src", "_copy", "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tied.withColumn("_in", F.coalesce(F.sum("_tied").over(inside), F.lit(0)))
        .join(starts, ["_src", "_copy", "_bucket"])
        .select("_src", "_copy", "_order", "_tied", (F.col("_start") + F.col("_in")).alias("_before"))
    )


class _Mixture:
    """What a mixture takes of each source, and which copies of its rows: tables of one run."""

    def __init__(self, df: DataFrame, text: str, id_col: str, source: str, target_entropy: float, max_epochs: float,
                 budget: int | None, block_tokens: int, seed: int):
        spark, self.seed, self.block_tokens = df.sparkSession, seed, block_tokens
        work = Work(spark, "mixing")
        self.rows = work.put(df.select(
            F.col(id_col).alias("_id"), F.col(source).alias("_source"), _source_key(source).alias("_src"),
            n_tokens(text).alias("_tokens"), _row_key(id_col, text, seed).alias("_key")), "rows")
        sources = work.put(self.rows.groupBy("_src").agg(F.sum("_tokens").alias("_total"), F.count(F.lit(1)).alias("_n")), "sources")
        totals = sources.groupBy("_total").agg(F.count(F.lit(1)).alias("many")).orderBy("_total").toArrow()
        many = totals.column("many").to_pylist()
        chosen = decide(totals.column("_total").to_pylist(), many, target_entropy, max_epochs, budget)
        decided = spark.createDataFrame([(t, w, take // t, take % t) for t, w, take in chosen] or [(0, 0.0, 0, 0)],
                                        "_total long, _weight double, _full long, _rest long")
        self.plan = work.put(sources.join(decided, "_total").withColumn(
            "_buckets", F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / BUCKET_ROWS))), "plan")
        self.few = sum(many) <= BROADCAST_SOURCES
        self.placed = work.put(_placed(self.copies(self.rows).select("_src", "_copy", "_order", "_tokens", "_buckets")), "placed")

    def copies(self, rows: DataFrame) -> DataFrame:
        """A row for each document and epoch, the last one too; _order permutes each epoch anew."""
        return (
            rows.join(F.broadcast(self.plan) if self.few else self.plan, "_src")
            .withColumn("_copy", F.explode(F.expr(
                "filter(sequence(0L, _full), c -> c < _full OR _rest > 0)")))
            .withColumn("_order", F.xxhash64(F.lit(self.seed), "_copy", "_key"))
        )

    def taken(self, rows: DataFrame) -> DataFrame:
        """The copies that are taken, with _block and _place; rows has _src and _key."""
        return (
            self.copies(rows).join(self.placed, ["_src", "_copy", "_order"])
            .filter((F.col("_copy") < F.col("_full")) | (F.col("_before") + F.col("_tied") <= F.col("_rest")))
            .withColumn("_block", F.floor((F.col("_copy") * F.col("_total") + F.col("_before")) / (F.col("_weight") * self.block_tokens)).cast("long"))
            .withColumn("_place", F.xxhash64(F.lit(self.seed + 1), "_copy", "_key"))
        )


def mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source",
        target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None,
        block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """A row for each time a document is taken: id, source, n_tokens, copy, block, place (in it), weight (of its source)."""
    mixture = _Mixture(df, text, id_col, source, target_entropy, max_epochs, budget, block_tokens, seed)
    return mixture.taken(mixture.rows).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source), F.col("_tokens").alias("n_tokens"),
        F.col("_copy").cast("int").alias("copy"), F.col("_block").alias("block"), F.col("_place").alias("place"),
        F.col("_weight").alias("weight"))


def take(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source",
         target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None,
         block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """df's own columns, each row as often as the mixture takes it, block after block and permuted in each."""
    mixture = _Mixture(df, text, id_col, source, target_entropy, max_epochs, budget, block_tokens, seed)
    rows = df.select(F.struct("*").alias("_row"), _source_key(source).alias("_src"), _row_key(id_col, text, seed).alias("_key"))
    taken = mixture.taken(rows).select("_row", "_block", "_place")
    return taken.repartitionByRange("_block", "_place").sortWithinPartitions("_block", "_place").select("_row.*")
