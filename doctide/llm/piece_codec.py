"""SentencePiece (BPE) encoding and decoding in vectorised merge rounds.

A text is cut into units in which merges cannot reach across the cut; distinct units
of a batch are encoded together and remembered.  All their symbols lie in one flat
numpy array.  A round finds each adjacent pair's rank, takes the least rank of each
unit (a segmented minimum), merges that pair at its leftmost places in all units at
once, and compacts the arrays; units in which no pair is left are done.

The library merges one pair at a time.  Merging several places of a unit in one round
gives the same result where no piece that the new one is part of ranks at or before
it; the model's table says so for each piece (``many``), and where it does not, only
the leftmost place is merged.

Characters without a piece become their UTF-8 bytes (byte pieces) or the unknown id.

Only models of type BPE without a normalisation table are taken, others are refused.
Nothing is read from the library but the model file's own fields.

Cases: null and empty texts have the end id alone and decode to the empty text;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.work import carried, sliced, with_carried

SPACE = "▁"
NEVER = np.int64(1 << 40)
#: Units that a task remembers, about; then it starts anew.
CACHE = 150_000
#: Characters whose units are merged together at once.
ROUND_CHARS = 1 << 20


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at:at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            value = data[at:at + n]
            at += n
        yield tag >> 3, value


#: Numbers of the model file's fields and of its kinds of piece, fixed by its format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, UNK_ID, BOS_ID, EOS_ID, UNK_SURFACE, MODEL_BPE = 3, 40, 41, 42, 44, 2
CHARSMAP, DUMMY_PREFIX, EXTRA_WHITESPACE = 2, 3, 4


#: Slots of the pair table: a power of two, some times the number of pairs.
SLOTS = 1 << 20


def _slot(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(44)).astype(np.int64)


class Table:
    """Byte strings by number, joined many at a time."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.array([len(x) for x in items], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all items one after the other, where each ends)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], ends


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == PIECES:
                m = dict(_fields(value))
                pieces.append((m[1].decode(), float(np.frombuffer(m.get(2, b"\0\0\0\0"), "<f4")[0]), m.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_TYPE) != MODEL_BPE or normalizer.get(CHARSMAP) or normalizer.get(EXTRA_WHITESPACE, 1):
            raise ValueError("only BPE models that keep the text as it is are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.unk, self.eos = trainer.get(UNK_ID, 0), trainer.get(EOS_ID, 2)
        self.unk_surface = trainer.get(UNK_SURFACE, b" \xe2\x81\x87 ")
        self.size = len(pieces)
        self.kind = np.array([k for _, _, k in pieces], np.int8)
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = np.zeros(256, np.int32) + self.unk
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.has_bytes = bool((self.kind == BYTE).any())
        # ranks: equal scores share a rank, and then the place decides
        scores = {i: pieces[i][1] for i in ids.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # symbols: ids of pieces; characters without a piece follow after them
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        table: dict[tuple[int, int], int] = {}
        inside: dict[str, int] = {}
        for p, i in ids.items():
            for a in range(1, len(p)):
                left, right = self._symbol(p[:a], ids), self._symbol(p[a:], ids)
                if left is not None and right is not None:
                    table[left, right] = i
            rank = rank_of[scores[i]]
            for a in range(len(p)):
                for b in range(a + 1, len(p) + (a > 0)):
                    part = p[a:b]
                    if part in ids and rank < inside.get(part, 1 << 40):
                        inside[part] = rank
        self.rank = np.array([rank_of.get(scores.get(i), 1 << 40) for i in range(self.size)], np.int64)
        self.many = np.zeros(self.size, bool)
        for p, i in ids.items():
            self.many[i] = inside.get(p, 1 << 40) > rank_of[scores[i]]
        keys = np.array([(a << 24) | b for a, b in table], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.merged = np.append(np.array(list(table.values()), np.int32)[order], np.int32(0))
        # pairs by hash, the next slot where one is taken
        self.none = len(table)
        self.slots = np.full(SLOTS, self.none, np.int64)
        for k, slot in enumerate(_slot(self.keys[:-1]).tolist()):
            while self.slots[slot] != self.none:
                slot = (slot + 1) & (SLOTS - 1)
            self.slots[slot] = k
        self.pair_rank = np.append(self.rank[self.merged[:-1]], NEVER)
        joined = {c for p in ids if len(p) > 1 for c in p}
        # a unit: a run of spaces with what follows it; characters that no longer piece has stand alone
        alone = sorted({c for c in "\n\r\t" if c not in joined})
        cut = "".join(map(re.escape, alone))
        cross = any(SPACE in p.lstrip(SPACE) for p in ids)
        self.unit = re.compile("[\\s\\S]+") if cross else re.compile(
            f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else ""))
        surfaces = [
            b"" if kind == CONTROL else self.unk_surface if kind == UNKNOWN
            else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        self.surfaces = surfaces
        self.surface_table = Table(surfaces)
        self.number_table = Table([b"%d " % i for i in range(self.size)])
        self.cache: dict[str, int] = {}
        self._reset()

    def _symbol(self, part: str, ids: dict[str, int]) -> int | None:
        if part in ids:
            return ids[part]
        if len(part) == 1:
            return self.char.setdefault(part, self.size + len(self.char))
        return None

    def _reset(self) -> None:
        self.cache.clear()
        self.flat, self.starts, self.lengths, self.n_flat, self.n_units = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    # -- merging ---------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into merged and pair_rank, the last one where the pair makes no piece."""
        keys = (left.astype(np.int64) << 24) | right
        slot = _slot(keys)
        at = self.slots[slot]
        open_ = np.flatnonzero((self.keys[at] != keys) & (at != self.none))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            at[open_] = self.slots[slot[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (at[open_] != self.none)]
        return at

    def merge(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat symbols, of which unit (ascending) says where each belongs, until no pair is left."""
        done_symbols, done_order = [], []
        order = np.arange(len(symbols))
        pair = self._pairs(symbols, unit)
        while len(symbols):
            ranks = self.pair_rank[pair]
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            lengths = np.diff(np.append(first, len(unit)))
            least = np.minimum.reduceat(ranks, first)
            busy = least < NEVER
            if not busy.all():
                out = np.repeat(~busy, lengths)
                done_symbols.append(symbols[out])
                done_order.append(order[out])
                stay = ~out
                symbols, unit, order, pair, ranks = symbols[stay], unit[stay], order[stay], pair[stay], ranks[stay]
                least, lengths = least[busy], lengths[busy]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, lengths))
            # the leftmost place of each unit; further ones where that cannot change the order of merges
            lead = np.append(True, unit[hit[1:]] != unit[hit[:-1]])
            if len(hit) > lead.sum():
                same = hit[lead][np.cumsum(lead) - 1]
                also = self.many[self.merged[pair[hit]]] & (pair[hit] == pair[same])
                hit = hit[lead | also]
                # of places that touch (a a a), every second one of a run merges
                starts = np.append(True, np.diff(hit) != 1)
                run = np.arange(len(hit)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
                hit = hit[run % 2 == 0]
            symbols[hit] = self.merged[pair[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            moved = np.zeros(len(symbols), bool)
            moved[hit] = True
            symbols, unit, order, pair, moved = symbols[stay], unit[stay], order[stay], pair[stay], moved[stay]
            # only pairs with a new symbol have a new rank
            moved[:-1] |= moved[1:]
            fresh = np.flatnonzero(moved)
            pair[fresh] = self._pairs(symbols, unit, fresh)
        if not done_symbols:
            return symbols, order
        symbols, order = np.concatenate(done_symbols), np.concatenate(done_order)
        back = np.argsort(order, kind="stable")
        return symbols[back], order[back]

    def _pairs(self, symbols: np.ndarray, unit: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Of the pair that starts at each place (of at): its index; the last index where there is none."""
        at = np.arange(len(symbols)) if at is None else at
        out = np.full(len(at), len(self.keys) - 1, np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[unit[at[inner]] == unit[at[inner] + 1]]
        out[inner] = self._look_up(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    # -- units -----------------------------------------------------------------

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each unit) of distinct units."""
        lengths = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, place = np.unique(points, return_inverse=True)
        # characters that no piece holds share a symbol that no pair has
        known = np.array([self.char.get(chr(c), 1 << 23) for c in distinct], np.int64)
        lost = known >= self.size  # no piece of their own
        symbols = known[place]
        unit = np.repeat(np.arange(len(units)), lengths)
        symbols, order = self.merge(symbols.copy(), unit)
        unit = unit[order]
        raw = symbols >= self.size
        if not raw.any():
            return symbols.astype(np.int32), np.bincount(unit, minlength=len(units))
        width = np.ones(len(symbols), np.int64)
        tails = {}
        for k in np.flatnonzero(lost):
            if self.has_bytes:
                tails[int(distinct[k])] = self.byte_ids[list(chr(distinct[k]).encode("utf-8", "replace"))]
            else:
                tails[int(distinct[k])] = np.array([self.unk], np.int32)
        chars = points[order[raw]]
        width[raw] = [len(tails[int(c)]) for c in chars]
        flat = np.repeat(symbols, width).astype(np.int64)
        spread = np.repeat(raw, width)
        flat[spread] = np.concatenate([tails[int(c)] for c in chars])
        return flat.astype(np.int32), np.bincount(np.repeat(unit, width), minlength=len(units))

    def _learn(self, units: list[str]) -> None:
        """Encode distinct units that are not in the cache, at most ROUND_CHARS characters at once."""
        at = 0
        while at < len(units):
            n, chars = at, 0
            while n < len(units) and (n == at or chars + len(units[n]) <= ROUND_CHARS):
                chars += len(units[n])
                n += 1
            part = units[at:n]
            flat, lengths = self._encode_units(part)
            need, have = self.n_flat + len(flat), len(self.flat)
            if need > have:
                self.flat = np.concatenate([self.flat, np.zeros(max(need - have, have), np.int32)])
            self.flat[self.n_flat:need] = flat
            m = self.n_units + len(part)
            if m > len(self.starts):
                grow = np.zeros(max(m - len(self.starts), len(self.starts)), np.int64)
                self.starts, self.lengths = np.concatenate([self.starts, grow]), np.concatenate([self.lengths, grow])
            self.starts[self.n_units:m] = self.n_flat + np.cumsum(lengths) - lengths
            self.lengths[self.n_units:m] = lengths
            self.cache.update(zip(part, range(self.n_units, m)))
            self.n_flat, self.n_units = need, m
            at = n

    def encode(self, texts: list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, number of ids of each text), with the end id last."""
        lead = SPACE if self.prefix else ""
        units, counts = [], []
        for t in texts:
            found = self.unit.findall(lead + t.replace(" ", SPACE)) if t else []
            counts.append(len(found))
            units += found
        if self.n_units > CACHE or self.n_flat > 8 * CACHE:
            self._reset()
        self._learn([u for u in dict.fromkeys(units) if u not in self.cache])
        which = np.fromiter(map(self.cache.__getitem__, units), np.int64, len(units))
        starts, lengths = self.starts[which], self.lengths[which]
        total = np.cumsum(lengths)
        flat = self.flat[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        ends = np.append(0, total)[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(0, ends))
        if end:
            flat = np.insert(flat, ends, self.eos)
            sizes = sizes + 1
        return flat, sizes

    def decode(self, ids) -> str:
        """The text of a sequence of ids, as the library's decode(ids) gives it."""
        ids = np.asarray(ids)
        out, surfaces = [], self.surfaces
        raw = self.kind[ids] == BYTE if len(ids) else np.zeros(0, bool)
        if not raw.any():
            text = b"".join([surfaces[i] for i in ids.tolist()]).decode("utf-8", "replace")
        else:
            edges = np.flatnonzero(np.diff(raw.astype(np.int8))) + 1
            for part, is_raw in zip(np.split(ids, edges), raw[np.append(0, edges)]):
                joined = b"".join([surfaces[i] for i in part.tolist()])
                out.append(_lenient(joined) if is_raw else joined.decode("utf-8", "replace"))
            text = "".join(out)
        # the first visible piece gives up one leading space, if it is no byte
        if self.prefix and text.startswith(" "):
            first = next((i for i in ids.tolist() if self.surfaces[i]), None)
            if first is not None and self.kind[first] == NORMAL:
                return text[1:]
        return text

    def decode_all(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each of several sequences of ids that lie one after the other."""
        joined, ends = self.surface_table.join(flat)
        last = np.cumsum(sizes)
        edges = np.append(0, ends)[np.append(0, last)].tolist()
        data = joined.tobytes()
        raw = np.append(0, np.cumsum(self.kind[flat] == BYTE))
        odd = (raw[last] - raw[last - sizes]) > 0
        out = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            own = data[a:b]
            ids = flat[last[k] - sizes[k]:last[k]]
            # a piece without a surface parts the bytes before it from those after it
            if odd[k] and (not _whole(own) or (self.kind[ids[:-1]] == CONTROL).any()):
                own = self.decode(ids).encode()
            elif self.prefix and own.startswith(b" ") and self._first_is_piece(ids):
                own = own[1:]
            out.append(own)
        return out

    def _first_is_piece(self, ids: np.ndarray) -> bool:
        for i in ids:
            if self.surfaces[i]:
                return self.kind[i] == NORMAL
        return False

    def numbers(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of each sequence in decimal, with a space between."""
        joined, ends = self.number_table.join(flat)
        edges = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        data = joined.tobytes()
        return [data[a:max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def _whole(data: bytes) -> bool:
    """Whether the bytes are UTF-8."""
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at:at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Characters of the texts that are encoded at once.
BATCH_CHARS = 1 << 20


def slices(texts: list[str | None], most: int = BATCH_CHARS):
    """Ranges of texts of about so many characters, one text at least."""
    at = 0
    while at < len(texts):
        n, chars = at, 0
        while n < len(texts) and (n == at or chars + len(texts[n] or "") <= most):
            chars += len(texts[n] or "")
            n += 1
        yield at, n
        at = n


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and ids (array of int), the end id last."""

    def run(batches):
        c = codec(path)
        for batch in sliced(batches):
            texts = batch.column("_text").to_pylist()
            for a, b in slices(texts):
                flat, sizes = c.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_pydict({"_keep": batch.column("_keep").slice(a, b - a), "ids": lists})

    rows = df.select(carried(keep), F.col(text).alias("_text"))
    return rows.mapInArrow(run, with_carried(rows, "ids array<int>")).select("_keep.*", "ids")


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and decoded (string) from a column of ids; null ids: the empty text."""

    def run(batches):
        c = codec(path)
        for batch in sliced(batches):
            out = [c.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_keep": batch.column("_keep"), "decoded": pa.array(out, pa.string())})

    rows = df.select(carried(keep), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, with_carried(rows, "decoded string")).select("_keep.*", "decoded")


def digests(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: keep's columns, n_tokens, ids_sha256, decoded_sha256."""
    import hashlib


    def run(batches):
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in sliced(batches):
            texts = batch.column("_text").to_pylist()
            for a, b in slices(texts):
                flat, sizes = c.encode(texts[a:b])
                ids = [sha(x) for x in c.numbers(flat, sizes)]
                decoded = [sha(x) for x in c.decode_all(flat, sizes)]
                yield pa.RecordBatch.from_pydict({
                    "_keep": batch.column("_keep").slice(a, b - a), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)})

    rows = df.select(carried(keep), F.col(text).alias("_text"))
    return rows.mapInArrow(run, with_carried(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")).select(
        "_keep.*", "n_tokens", "ids_sha256", "decoded_sha256")
