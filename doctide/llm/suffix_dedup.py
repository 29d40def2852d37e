"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every string of ``LENGTH`` bytes contains an anchor that its own bytes choose: the
least of its ``GRAM``-byte substrings, by hash.  Only suffixes at anchors are indexed
(about one in eighty), which is enough, as equal strings have equal anchors.  A suffix
array is a sorted run of such suffixes with their places: ordered by the fingerprint of
their leading ``GRAM`` bytes, then by that of the segment around the anchor (the strings
between one anchor and the next), then by place.  Order by fingerprints is not that of the
alphabet, but brings equal prefixes together just as well, in 8 bytes.

Documents come in batches.  A batch gets its own array, which is merge-scanned against
those of the levels that exist (each has a directory of its prefixes): an equal prefix is
a match of ``GRAM`` bytes at least, an equal segment a match of all its strings.  The
batch then becomes a level itself, and levels of equal size merge into one of twice the
size, so there are never more than log2(batches).  An ``IndexFamily`` kept by the caller
takes later batches: only these are scanned, against all that came before.

What matches by prefix but not by segment is then decided:

* segments that occur once, beside others of the same anchor, are opened in blocks
  of ``BLOCK`` strings, which are looked for among those blocks that have the same core
  (the bytes that all strings of a block share);
* where a core has several kinds of blocks, string by string.

Equality of prefixes, segments and blocks is that of 64-bit fingerprints, each within an
equal prefix or core; that of single strings of two independent 64-bit fingerprints.  No
step brings the rows of an anchor together: counts are summed before the shuffle, sorted
runs are dealt by all their columns, and joins are of a kind that Spark splits where a key
is frequent.  Texts are shuffled only of documents that have something to decide or to lose.

Cases: null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing;
equal rows are repeats of each other; rows that repeat an id, or have none, are told
apart by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.bloom import among
from doctide.llm.work import Work, carried, sliced, with_carried

LENGTH, GRAM, BATCHES = 200, 40, 2
#: Strings of a segment that are compared as one.
BLOCK = 8
#: Bytes that are scanned at once.
CHUNK = 1 << 18
NO_ID = -(1 << 63)
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


TABLES = (_table(1), _table(2))


class Prints:
    """Fingerprints of all substrings of one length, from those of powers of two."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.base = _B if which == 0 else 0xD6E8FEB86659FD93
        self.by = {1: TABLES[which][data]}

    def of(self, n: int) -> np.ndarray:
        if n in self.by:
            return self.by[n]
        low = 1 << (n.bit_length() - 1)
        if low == n:
            low >>= 1
        left, right = self.of(low), self.of(n - low)
        size = len(self.by[1]) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        factor = np.uint64(pow(self.base, n - low, 1 << 64))
        out = left[:size] * factor + right[low:low + size]
        self.by[n] = out
        return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Of texts that stand at [start, end) in data, for each segment: text, first string, number of strings,
    anchor, fingerprint, and whether the anchor stands in it twice (then its strings may repeat within it)."""
    empty = np.zeros(0, np.int64)
    width = LENGTH - GRAM + 1
    sizes = np.maximum(ends - starts - LENGTH + 1, 0)
    if len(data) < LENGTH or not sizes.sum():
        return empty, empty, empty, empty, empty, empty
    prints = Prints(data)
    grams = mix(prints.of(GRAM))
    least = sliding_least(grams, width)
    whole = prints.of(LENGTH)
    text = np.repeat(np.arange(len(starts)), sizes)
    total = np.cumsum(sizes)
    place = np.arange(total[-1]) - np.repeat(total - sizes, sizes)
    at = place + starts[text]
    anchor = least[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    if count.max() > width:  # the same bytes again and again: cut into pieces of equal length
        pieces = -(-count // width)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + inner * width, np.minimum(np.repeat(count, pieces) - inner * width, width)
    last = first + count - 1
    print_ = mix(whole[at[first]] + mix(whole[at[last]] + count.astype(np.uint64)))
    span = count + width - 1
    begin = np.cumsum(span) - span
    inside = grams[np.arange(span.sum()) + np.repeat(at[first] - begin, span)] == np.repeat(anchor[first], span)
    again = np.add.reduceat(inside.astype(np.int32), begin) > 1
    return text[first], place[first], count, anchor[first].view(np.int64), print_.view(np.int64), again.astype(np.int64)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, without copies."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _pieces(offsets: np.ndarray):
    """(rows, starts, ends, shift) of scans of about CHUNK bytes; long texts are cut with an overlap."""
    rows, starts, ends, shift, size = [], [], [], [], 0
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        at = a
        while b - at >= LENGTH:
            to = min(b, at + CHUNK + LENGTH - 1)
            rows.append(k)
            starts.append(at)
            ends.append(to)
            shift.append(at - a)
            size += to - at
            at += CHUNK
            if size >= CHUNK:
                yield rows, starts, ends, shift
                rows, starts, ends, shift, size = [], [], [], [], 0
    if rows:
        yield rows, starts, ends, shift


def _index(n_batches: int):
    def run(batches):
        for batch in sliced(batches, 1 << 30):
            data, offsets = _binary(batch.column("text"))
            for rows, starts, ends, shift in _pieces(offsets):
                rows, starts, ends, shift = (np.array(x, np.int64) for x in (rows, starts, ends, shift))
                low = starts.min()
                text, place, count, anchor, print_, again = segments(data[low:ends.max()], starts - low, ends - low)
                if not len(text):
                    continue
                own = pa.array(rows[text])
                ids = batch.column("d1").take(own)
                number = (mix(ids.to_numpy().view(np.uint64)) % np.uint64(n_batches)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(anchor), pa.array(print_), ids, batch.column("d2").take(own),
                     pa.array((place + shift[text]).astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(again.astype(np.int32))],
                    ["batch", "key", "seg", "d1", "d2", "s", "n", "again"])
    return run


def _parts(batch: pa.RecordBatch, most: int = 4096):
    """Listed stretches of the texts, some at a time: (row, stretch as dict, bytes one after the other, where each begins)."""
    rows, found, parts = [], [], []
    for k, (text, listed) in enumerate(zip(batch.column("text").to_pylist(), batch.column("listed").to_pylist())):
        for x in listed:
            rows.append(k)
            found.append(x)
            parts.append(text[x["s"]:x["s"] + x["n"] + LENGTH - 1])
            if len(parts) == most:
                yield rows, found, parts
                rows, found, parts = [], [], []
    if parts:
        yield rows, found, parts


def _laid_out(found: list[dict], parts: list[bytes]):
    """(data, part of each string, place of each string in data, first string of each part)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in parts], np.int64)
    base = np.cumsum(size) - size
    n = np.array([x["n"] for x in found], np.int64)
    part = np.repeat(np.arange(len(parts)), n)
    at = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + base[part]
    return data, part, at, base


def _blocks(batches):
    """Strings of a segment in blocks of BLOCK by their distance from the anchor: fingerprints of what all
    strings of the block share (core) and of the strings that are there (whole)."""
    for batch in sliced(batches):
        for rows, found, parts in _parts(batch):
            data, part, at, base = _laid_out(found, parts)
            key = np.array([x["key"] for x in found], np.int64).view(np.uint64)
            prints = Prints(data)
            grams = mix(prints.of(GRAM))
            size = np.array([len(x) for x in parts], np.int64) - GRAM + 1
            own = np.repeat(np.arange(len(parts)), size)
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + base[own]
            hits = place[grams[place] == key[own]]
            anchor = hits[np.searchsorted(hits, at)]
            block = (anchor - at) // BLOCK
            new = np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            last = first + n - 1
            core = prints.of(LENGTH - BLOCK + 1)[anchor[first] - block[first] * BLOCK]
            whole = prints.of(LENGTH)
            whole = mix(whole[at[first]] + mix(whole[at[last]] + n.astype(np.uint64)))
            core = mix(core + mix(block[first].astype(np.uint64)))
            owner = part[first]
            doc = pa.array(np.array(rows, np.int64)[owner])
            pick = lambda name, kind: pa.array(np.array([x[name] for x in found], kind)[owner])
            start = np.array([x["s"] for x in found], np.int64)[owner] + at[first] - base[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("d1").take(doc), batch.column("d2").take(doc),
                 pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pick("c", np.int64), pick("again", np.int32)],
                ["core", "whole", "d1", "d2", "s", "n", "c", "again"])


def _strings(batches):
    """Two fingerprints of each string of the listed blocks."""
    for batch in sliced(batches):
        for rows, found, parts in _parts(batch):
            data, part, at, base = _laid_out(found, parts)
            doc = pa.array(np.array(rows, np.int64)[part])
            start = np.array([x["s"] for x in found], np.int64)[part] + at - base[part]
            w1, w2 = (mix(Prints(data, k).of(LENGTH))[at].view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1), pa.array(w2), batch.column("d1").take(doc), batch.column("d2").take(doc), pa.array(start.astype(np.int32)),
                 pa.array(np.array([x["c"] for x in found], np.int64)[part])],
                ["w1", "w2", "d1", "d2", "s", "c"])


def covered(runs, size: int) -> list[tuple[int, int]]:
    """Maximal [start, end) that the strings starting at s .. s + n - 1 of each run (s, n) cover."""
    out: list[list[int]] = []
    for s, n in sorted(runs):
        end = min(s + n - 1 + LENGTH, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([s, end])
    return [(a, b) for a, b in out]


def _cut(batches):
    for batch in sliced(batches):
        kept, removed, spans = [], [], []
        for text, runs in zip(batch.column("_text").to_pylist(), batch.column("_runs").to_pylist()):
            text = text or b""
            gone = covered([(x["s"], x["n"]) for x in runs], len(text)) if runs else []
            parts, at = [], 0
            for a, b in gone:
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(gone))
        yield pa.RecordBatch.from_pydict({
            "_keep": batch.column("_keep"), "_kept": pa.array(kept, pa.binary()), "_n_removed": pa.array(removed, pa.int64()),
            "_n_spans": pa.array(spans, pa.int64())})


ENTRY = "key long, seg long, d1 long, d2 long, s int, n int, again int"
DIRECTORY = "key long, n long"


class IndexFamily:
    """Levels of sorted suffix entries, each with a directory (key, n) of its prefixes, as tables of one folder.

    levels: (batches, name) of each level, the oldest first.
    """

    def __init__(self, work: Work, levels: list[tuple[int, str]] | None = None):
        self.work, self.levels = work, list(levels or [])
        self.made = max((int(name) for _, name in self.levels), default=-1) + 1

    def entries(self) -> DataFrame | None:
        """All suffixes that are indexed."""
        out = None
        for _, name in self.levels:
            run = self.work.get(f"run-{name}", ENTRY)
            out = run if out is None else out.union(run)
        return out

    def directory(self, name: str) -> DataFrame:
        return self.work.get(f"directory-{name}", DIRECTORY)

    def _put(self, size: int, entries: DataFrame, directory: DataFrame) -> None:
        name = str(self.made)
        self.made += 1
        order = ["key", "seg", "d1", "d2", "s"]
        self.work.put(entries.repartitionByRange(*order).sortWithinPartitions(*order), f"run-{name}")
        self.work.put(directory.groupBy("key").agg(F.sum("n").alias("n")), f"directory-{name}")
        self.levels.append((size, name))

    def add(self, entries: DataFrame, found_in: Work) -> DataFrame:
        """Index a batch; the prefixes that it holds and that are there twice or more."""
        before = list(self.levels)
        self._put(1, entries, entries.select("key", (1 + F.col("again")).cast("long").alias("n")))
        new = self.directory(self.levels[-1][1])
        found = new.filter("n > 1").select("key")
        for _, name in before:
            found = found.union(new.select("key").join(self.directory(name).select("key"), "key", "left_semi"))
        found = found_in.put(found, f"found-{self.levels[-1][1]}")
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            runs = [self.work.get(f"run-{name}", ENTRY) for name in (a, b)]
            self._put(2 * size, runs[0].union(runs[1]), self.directory(a).union(self.directory(b)))
            self.work.drop(*[f"{kind}-{name}" for kind in ("run", "directory") for name in (a, b)])
        return found


def repeats(df: DataFrame, text: str = "text", id_col: str = "doc_id", n_batches: int = BATCHES,
            family: IndexFamily | None = None, known: DataFrame | None = None) -> DataFrame:
    """d1, d2 (a digest of the row), runs: array of (s, n), the starts s .. s + n - 1 of strings that start elsewhere too.

    family: an index that has the rows of known, and gets those of df; else one is made for df, and deleted.
    """
    work = Work(df.sparkSession, "suffix-dedup")
    rows = _rows(df, text, id_col)
    entries = work.put(rows.mapInArrow(_index(n_batches), f"batch int, {ENTRY}"), "entries", partition_by="batch")
    own = family is None
    family, found = IndexFamily(work) if own else family, None
    for k in range(n_batches):
        got = family.add(entries.filter(F.col("batch") == k).drop("batch"), work)
        work.drop(f"entries/batch={k}")
        found = got if found is None else found.union(got)
    work.drop("entries")
    keys = work.put(found.distinct(), "keys")
    candidates = work.put(family.entries().join(keys, "key", "left_semi"), "candidates")
    if own:
        work.drop(*[f"{kind}-{name}" for kind in ("run", "directory") for _, name in family.levels])
    if known is not None:
        rows = rows.union(_rows(known, text, id_col))
    counts = work.put(candidates.groupBy("key", "seg").agg(
        F.count(F.lit(1)).alias("c"), F.max("again").alias("again"),
        F.min(F.struct("d1", "d2", "s", "n")).alias("one")), "segments")
    # segments that occur twice repeat in whole
    whole = candidates.join(counts.filter("c > 1").select("key", "seg"), ["key", "seg"], "left_semi").select("d1", "d2", "s", "n")
    whole = work.put(whole, "whole")
    work.drop("candidates", "keys", *[f"found-{k}" for k in range(family.made)])
    work.free()

    # segments that occur once, beside others of their anchor or with strings that may repeat within: by blocks
    blocks = work.put(_listed(work, rows, _undecided(work, counts, "key"), "key").mapInArrow(
        _blocks, "core long, whole long, d1 long, d2 long, s int, n int, c long, again int"), "blocks")
    work.drop("segments", "listed-key")
    kinds = work.put(blocks.groupBy("core", "whole").agg(
        F.sum("c").alias("c"), F.max("again").alias("again"), F.min(F.struct("d1", "d2", "s", "n")).alias("one")), "kinds")
    same = blocks.filter("c = 1").join(kinds.filter("c > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    same = work.put(same.select("d1", "d2", "s", "n"), "same")
    work.drop("blocks")
    work.free()

    # blocks that occur once, beside others with their core: string by string
    strings = work.put(_listed(work, rows, _undecided(work, kinds, "core"), "core").mapInArrow(
        _strings, "w1 long, w2 long, d1 long, d2 long, s int, c long"), "strings")
    work.drop("kinds", "listed-core")
    twice = work.put(strings.groupBy("w1", "w2").agg(F.sum("c").alias("total")).filter("total > 1").select("w1", "w2"), "twice")
    single = strings.filter("c = 1").join(twice, ["w1", "w2"], "left_semi").select("d1", "d2", "s", F.lit(1).alias("n"))
    runs = whole.union(same).union(single).groupBy("d1", "d2").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    runs = work.put(runs, "runs")
    work.drop("whole", "same", "strings", "twice", "mixed-key", "mixed-core")
    work.free()
    return runs


def _undecided(work: Work, kinds: DataFrame, key: str) -> DataFrame:
    """Kinds (c, again, one) of the keys that have a kind that occurs once, and another or a repeat within."""
    mixed = kinds.groupBy(key).agg(
        F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least"), F.max("again").alias("again")).filter(
        "(kinds > 1 OR again = 1) AND least = 1").select(key)
    # as a table, so that both sides of the join are plain exchanges and Spark can split a frequent key
    mixed = work.put(mixed, f"mixed-{key}")
    return kinds.join(mixed, key, "left_semi")


def _listed(work: Work, rows: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """text, d1, d2, listed: one place of each kind, collected for the text that holds it (bounded by its length)."""
    listed = work.put(kinds.groupBy(F.col("one.d1").alias("d1"), F.col("one.d2").alias("d2")).agg(
        F.collect_list(F.struct("one.s", "one.n", "c", "again", *(["key"] if key == "key" else []))).alias("listed")), f"listed-{key}")
    return _among(rows, listed, "d1").join(listed.hint("shuffle_hash"), ["d1", "d2"]).select("text", "d1", "d2", "listed")


def _among(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """rows without most of those that are not among some."""
    return rows.filter(among(some.select(F.col("d1").alias("id")), some.count())(key))


def _digests(data, row_id) -> list:
    """A row's 128-bit digest, by id and text: equal rows share it."""
    return [F.xxhash64(F.lit(1), row_id, data).alias("d1"), F.xxhash64(F.lit(2), data, row_id).alias("d2")]


def _rows(df: DataFrame, text: str, id_col: str) -> DataFrame:
    data, row_id = F.coalesce(F.col(text), F.lit("")).cast("binary"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return df.select(*_digests(data, row_id), data.alias("text"))


def dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
          n_batches: int = BATCHES, family: IndexFamily | None = None, known: DataFrame | None = None) -> DataFrame:
    """keep's columns, _kept (binary), _n_removed, _n_spans for each row of df; family and known as in repeats."""
    found = repeats(df, text, id_col, n_batches, family, known)
    data, row_id = F.coalesce(F.col(text), F.lit("")).cast("binary"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = df.select(carried(keep), data.alias("_text"), *[c.alias(f"_{n}") for c, n in zip(_digests(data, row_id), ("d1", "d2"))])
    rows = rows.withColumn("_some", among(found.select(F.col("d1").alias("id")), found.count())("_d1"))
    zero = F.lit(0).cast("long")
    clean = rows.filter(~F.col("_some")).select("_keep", F.col("_text").alias("_kept"), zero.alias("_n_removed"), zero.alias("_n_spans"))
    runs = found.withColumnsRenamed({"d1": "_d1", "d2": "_d2", "runs": "_runs"}).hint("shuffle_hash")
    joined = rows.filter("_some").drop("_some").join(runs, ["_d1", "_d2"], "left").drop("_d1", "_d2")
    cut = joined.mapInArrow(_cut, with_carried(rows, "_kept binary, _n_removed long, _n_spans long"))
    return clean.union(cut).select("_keep.*", "_kept", "_n_removed", "_n_spans")
