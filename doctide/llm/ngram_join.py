"""Exact Jaccard join on word n-grams, with set-relation skipping.

Sets are put into an order that is the same everywhere: rare n-grams first, frequent
ones last, by hash within.  Two sets can only meet the threshold if they share one of
the first few (the prefix), so the index has a list of (set, size, position) for each
prefix n-gram.  Relations between sets then spare work in two ways:

* in the index: sets equal to another are one entry.  An entry's position gives the
  largest partner it can still have; entries whose partners would have to be smaller
  or larger than every set in the list are skipped as a block, and lists with a single
  component are skipped whole;
* in the answers: each list's leader (the set in which the n-gram comes first, so
  one with few n-grams of its own) is compared with all its members first.  Members
  that prove similar share its answers: they are in one component and are not
  compared again.  For the others, the computed distances to the same leader bound
  their distance to each other (Jaccard distance is a metric), and only pairs within
  the bound, of different components, are compared.

Both rounds compare exact sets, and no pair that could link two components is left
out.  Which n-grams are frequent only affects the order, not the result: they are
those seen repeatedly within a task's rows, summed, and the ``FREQUENT`` most frequent
are broadcast (a fixed bound).

Cases: null or empty text: an empty set, linked with nothing, its own component; fewer
words than ``n`` make one n-gram of them all; rows that repeat an id are one document
whose links are those of all its rows (where these differ, distances to a leader do not
bound others, and its pairs are all compared); a null id gets a null component; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.components import components
from doctide.llm.work import Work, sliced

N, PERCENT = 4, 85
FREQUENT, OFTEN = 500_000, 8
#: n-grams that are counted together in a task, and words whose hash a task remembers.
COUNT_AT_ONCE, WORDS_KEPT = 1 << 21, 200_000
#: Bytes of text whose words, and pairs of texts that, are in a task's memory together.
AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 256

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of n-gram hashes of texts; words are what stands between ASCII blanks, A-Z lower-cased."""

    def __init__(self, n: int):
        self.n, self.words = n, _Words()

    def sets(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hashes of all texts, sorted and distinct within a text; how many each text has).

        Words of about AT_ONCE bytes are in memory at once.
        """
        flat, sizes, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or b"")
                end += 1
            for out, part in zip((flat, sizes), self._sets(texts[at:end])):
                out.append(part)
            at = end
        if not flat:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(sizes)

    def _sets(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        n = self.n
        split = [t.lower().split() if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        total = int(counts.sum())
        flat = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.uint64, total)
        grams = flat[:max(total - n + 1, 0)].copy()
        for j in range(1, n):
            grams = mix(grams * _A + flat[j:j + len(grams)])
        grams = np.append(mix(grams ^ _C), np.zeros(total - len(grams), np.uint64))
        begin = np.cumsum(counts) - counts
        for k in np.flatnonzero((counts > 0) & (counts < n)):  # all words as one
            c, at = int(counts[k]), int(begin[k])
            x = flat[at:at + 1] + np.uint64(c)
            for j in range(1, c):
                x = mix(x * _C + flat[at + j:at + j + 1])
            grams[at] = mix(x ^ _A)[0]
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        for a, c in zip(begin.tolist(), sizes.tolist()):
            if c > 1:
                grams[a:a + c].sort()
        row = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        grams = grams[at]
        new = np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1]))[:len(grams)]
        return grams[new], np.bincount(row[new], minlength=len(texts))


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each set's values, modulo 2**64."""
    total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def prefix_length(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1


def _scan(n: int):
    """Kind 0: id, size and two hashes of the set; kind 1: an n-gram and how often these rows hold it, if twice."""
    def run(batches):
        shingler, held, size = Shingler(n), [], 0

        def counted():
            grams = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(grams)))
            grams, counts = grams[first[counts > 1]], counts[counts > 1]
            zero = np.zeros(len(grams), np.int64)
            return _record(1, _signed(grams), counts, zero, zero)

        for batch in sliced(batches, 2048):
            grams, sizes = shingler.sets(batch.column("text").to_pylist())
            yield _record(0, batch.column("id"), sizes, _signed(sums(mix(grams + _A), sizes)), _signed(sums(mix(grams ^ _B), sizes)))
            held.append(grams)
            size += len(grams)
            if size > COUNT_AT_ONCE:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()
    return run


def _record(kind: int, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), kind, np.int32)), *arrays], ["kind", "id", "n", "h1", "h2"])


def _prefixes(n: int, percent: int, shared):
    def run(batches):
        shingler = Shingler(n)
        grams, often = (np.frombuffer(x, np.uint64) for x in shared.value)
        for batch in sliced(batches, 2048):
            every, sizes = shingler.sets(batch.column("text").to_pylist())
            begin = np.cumsum(sizes) - sizes
            if len(grams):  # frequent ones go last: only sets that hold some need another order
                at = np.minimum(np.searchsorted(grams, every), len(grams) - 1)
                weight = np.where(grams[at] == every, often[at], np.uint64(0))
                row = np.repeat(np.arange(len(sizes)), sizes)
                for k in np.unique(row[weight > 0]).tolist():
                    a, b = begin[k], begin[k] + sizes[k]
                    every[a:b] = every[a:b][np.argsort(weight[a:b], kind="stable")]
            takes = np.where(sizes > 0, prefix_length(sizes, percent), 0)
            row = np.repeat(np.arange(len(sizes)), takes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(takes) - takes, takes)
            h1 = sums(mix(every + _A), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(every[begin[row] + pos])), batch.column("id").take(pa.array(row)),
                 pa.array(_signed(h1)[row]), pa.array(sizes[row].astype(np.int32)), pa.array(pos.astype(np.int32))],
                ["token", "id", "h1", "n", "pos"])
    return run


def _verify(n: int):
    def run(batches):
        shingler = Shingler(n)
        for batch in sliced(batches, PAIRS_AT_ONCE):
            sides = [list(zip(batch.column(i).to_pylist(), batch.column(t).to_pylist())) for i, t in (("a", "ta"), ("b", "tb"))]
            texts = list(dict.fromkeys(sides[0] + sides[1]))
            flat, sizes = shingler.sets([t for _, t in texts])
            known = dict(zip(texts, np.split(flat, np.cumsum(sizes)[:-1])))
            inter, union = [], []
            for x, y in zip(*sides):
                x, y = known[x], known[y]
                both = np.concatenate([x, y])
                both.sort()
                inter.append(int((both[1:] == both[:-1]).sum()))
                union.append(len(x) + len(y) - inter[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(inter, pa.int32()), pa.array(union, pa.int32())],
                ["a", "b", "inter", "uni"])
    return run


def _rows(df: DataFrame, text: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))


def _compare(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b, inter, uni for distinct pairs of ids."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(
        _verify(n), "a long, b long, inter int, uni int")


def classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id that links lead to), a row for each row of df."""
    spark = df.sparkSession
    work = Work(spark, "ngram-join")
    rows = _rows(df, text, id_col)
    scan = work.put(rows.mapInArrow(_scan(n), "kind int, id long, n long, h1 long, h2 long"), "scan")
    info = scan.filter("kind = 0")
    often = (scan.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).filter(F.col("c") >= OFTEN)
             .orderBy(F.desc("c"), "id").limit(FREQUENT).toArrow())
    grams = often.column("id").combine_chunks().to_numpy().view(np.uint64) if often.num_rows else np.zeros(0, np.uint64)
    counts = often.column("c").combine_chunks().to_numpy().astype(np.uint64) if often.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(grams)
    shared = spark.sparkContext.broadcast((grams[order].tobytes(), counts[order].tobytes()))

    # equal sets are one class, which stands under its smallest id
    key = ["h1", "h2", "n"]
    # as a table, so that both sides of the join are plain exchanges and Spark can split a frequent set
    same = work.put(info.filter("id IS NOT NULL AND n > 0").groupBy(*key).agg(F.min("id").alias("rep")), "same")
    member = work.put(info.join(same, key, "left").select("id", F.col("n").alias("n_shingles"), "rep"), "member")

    # ids whose rows differ: all their classes are one component
    several = work.put(info.filter("id IS NOT NULL").groupBy("id").agg(
        F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x <> y").select("id"), "several")
    differ, ties = several.limit(1).count() > 0, None
    if differ:
        tied = work.put(member.join(several, "id", "left_semi").groupBy("id").agg(F.min("rep").alias("a")), "tied")
        ties = work.put(member.join(tied, "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "ties")

    # the index: only n-grams that two classes share
    index = work.put(rows.filter("id IS NOT NULL").mapInArrow(
        _prefixes(n, percent, shared), "token long, id long, h1 long, n int, pos int"), "index")
    lists = work.put(index.groupBy("token").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("token"), "shared")
    work.free()  # the exchange of all tokens is not kept beside the next one
    reps = member.filter("rep IS NOT NULL").select("id", "rep").distinct()
    entries = (index.join(lists.hint("shuffle_hash"), "token").join(reps.filter("id = rep").select("id"), "id")
               .withColumn("most", (F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")).cast("int"))
               .select("token", "id", "n", "pos", "most"))
    entries = work.put(entries, "entries")
    work.drop("index")
    entries = _skip_blocks(entries, "id", percent)
    entries = work.put(entries, "lists")
    work.free()
    texts = work.put(rows.join(entries.select("id").distinct(), "id", "left_semi"), "texts")
    work.free()

    # first answers: the leader of each list against its members
    leaders = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "id", "most")).alias("l")).select("token", "l.*")
    led = entries.alias("x").join(leaders.alias("l"), "token").filter("x.id <> l.id AND x.n <= l.most AND l.n <= x.most")
    stars = work.put(led.select(F.least("x.id", "l.id").alias("a"), F.greatest("x.id", "l.id").alias("b")).distinct(), "stars")
    first = work.put(_compare(stars, texts, n).groupBy("a", "b").agg(
        F.max(F.struct(F.col("inter") / F.col("uni"), "inter", "uni")).alias("s")).select("a", "b", "s.inter", "s.uni"), "first")
    work.free()
    links = first.filter(f"100 * inter >= {percent} * uni").select("a", "b")
    if differ:
        links = links.union(ties)
    comps = components(links, work, "first-round")

    # derived answers: pairs of other components, within the bound that the leader's distances leave
    placed = (entries.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
              .join(leaders.select("token", F.col("id").alias("leader")), "token"))
    known = first
    if differ:  # a pair's best similarity is that of one pair of its texts only
        for side in ("a", "b"):
            known = known.join(several.withColumnRenamed("id", side), side, "left_anti")
    distance = known.select(F.col("a").alias("p"), F.col("b").alias("q"), (1 - F.col("inter") / F.col("uni")).alias("d"))
    placed = (placed.withColumn("p", F.least("id", "leader")).withColumn("q", F.greatest("id", "leader"))
              .join(distance, ["p", "q"], "left").filter("id <> leader")
              .select("token", "id", "n", "pos", "most", "comp", "d"))
    open_lists = work.put(_skip_blocks(placed, "comp", percent), "open")
    near = F.lit(1 - percent / 100 + 1e-9)
    x, y = open_lists.alias("x"), open_lists.alias("y")
    pairs = x.join(y, F.expr("x.token = y.token AND x.id < y.id AND x.comp <> y.comp AND x.n <= y.most AND y.n <= x.most")
                   & F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= near, F.lit(True))
                   ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = work.put(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    second = _compare(pairs, texts, n).filter(f"100 * inter >= {percent} * uni").select("a", "b").distinct()
    links = work.put(links.union(second), "links")
    comps = components(links, work, "second-round")
    if differ:
        member = member.join(tied, "id", "left").select("id", "n_shingles", F.coalesce("rep", "a").alias("rep"))
    return member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).alias("component_id"))


def _skip_blocks(entries: DataFrame, other: str, percent: int) -> DataFrame:
    """Entries that can have a partner by the sizes their list holds, of lists with two values of other at least."""
    for _ in range(2):
        stats = entries.groupBy("token").agg(
            F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min(other).alias("u"), F.max(other).alias("v"),
        ).filter("u <> v").select("token", "least_n", "most_n")
        entries = (entries.join(stats, "token")
                   .filter(f"most >= least_n AND 100 * most_n >= {percent} * n")
                   .drop("least_n", "most_n"))
    return entries


def one_of_each(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """df's rows whose document has the smallest id of its component; rows without an id stay."""
    found = classes(df, text, id_col, n, percent).filter(f"`{id_col}` <> component_id").select(F.col(id_col).alias("_gone")).distinct()
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(found.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
