"""Removal of repeated passages of words with an FM-index per shard; the first place of a passage keeps it.

A window is `length` consecutive words. Each window selects its least hashed run of `gram` words as its anchor, so equal
windows lie around equal anchors, at equal offsets; the windows of one place of an anchor are its context.

1. Contexts meet by anchor in one exchange, in order. Of equal contexts the first in document order stays and every
   later one is marked whole; equal contexts of one batch are combined before they are sent. Anchors with one context
   need nothing else.
2. Anchors with several different contexts are shards of the index: whole anchors in blocks of about `block` words. A
   block is an FM-index: the Burrows-Wheeler transform of its contexts as a wavelet matrix, with a bit per row where a
   class of suffixes with `length` equal words begins. All contexts of the block are streamed through it backwards:
   backward search gives the interval of the longest match up to `length` words at each place, that is the matching
   statistics, and windows whose match reaches `length` are reported with their class. All but the first are marked.
3. The contexts of an anchor with more than `hot` different ones are cut into single windows, whose anchor is the window
   itself, and these go through step 1: then equal windows are equal contexts. So no task gets more of an anchor than
   `hot` contexts and a row per batch.

No step drops a window: the result is exact up to 128-bit hash collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import map_batches, materialise, text_of

LENGTH, GRAM, BLOCK, HOT = 20, 6, 600_000, 512
# An odd multiplier, its inverse modulo 2^64, and two more for mixing.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
MIX = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
MARK, INDEX, CROWD = 0, 1, 2
SPAN, PART = 1_000_000, 4096  # words scanned at a time, contexts sent at a time


# ---- the index


class Bits:
    """A bit vector with counts of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.uint32)[:-1])).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix: ranks of symbols below 2^levels in a sequence."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for level in range(max(int(symbols.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            zeros = len(now) - int(bits.sum())
            self.levels.append((level, Bits(bits), zeros))
            now = np.concatenate((now[~bits], now[bits]))
        values, begins = np.unique(now, return_index=True)  # every symbol's places are together now
        self.begin = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
        self.begin[values] = begins

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(at).astype(np.int64)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at - self.begin[symbol]


class FMIndex:
    """An FM-index of sequences of words (numbers from 1), for matches of up to `length` words. No match crosses sequences."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, length: int):
        self.length = length
        ends = np.cumsum(sizes + 1) - 1  # place of each separator
        n = int(sizes.sum()) + len(sizes)
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = words
        own = symbols + len(sizes)
        own[ends] = np.arange(len(sizes))  # separators differ, so all suffixes do
        rank, levels = np.unique(own, return_inverse=True)[1], []
        width = 1
        while True:
            levels.append((width, rank))
            if width >= length and int(rank.max(initial=-1)) == n - 1:
                break
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            rank = np.unique(key, return_inverse=True)[1]
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        same, off = np.ones(max(n - 1, 0), bool), 0  # rows that share `length` words with the row before
        for width, level in reversed(levels):
            while off + width <= length:
                p, q = order[:-1] + off, order[1:] + off
                fits = (p < n) & (q < n)
                same &= fits
                same[fits] &= level[p[fits]] == level[q[fits]]
                off += width
        self.starts = np.flatnonzero(np.concatenate(([True], ~same))) if n else np.zeros(0, np.int64)
        self.starts = np.concatenate((self.starts, [n]))
        self.bwt = Wavelet(symbols[order - 1])
        counts = np.bincount(symbols, minlength=2)
        self.first = np.cumsum(counts) - counts  # first row of each symbol
        self.size = n

    def search(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stream, start, class row, count) of every window of `length` words of the streams that stands in the index.

        All streams step backwards together. A stream's state is the interval of rows that begin with its words from the
        current place on, at most `length` of them. Where no row goes on with the word before, every window over the
        match and that word is out, and the search begins anew before the match's last word.
        """
        begin = np.cumsum(sizes) - sizes
        stream = np.flatnonzero(sizes >= self.length)
        at, end = sizes[stream].copy(), sizes[stream].copy()  # the match is words at .. end
        lo, hi = np.zeros(len(stream), np.int64), np.full(len(stream), self.size)
        found: list[tuple[np.ndarray, ...]] = []
        while len(stream):
            word = words[begin[stream] + at - 1]
            known = (word > 0) & (word < len(self.first))
            word = np.where(known, word, 0)
            lo2 = self.first[word] + self.bwt.rank(word, lo)
            hi2 = self.first[word] + self.bwt.rank(word, hi)
            fits = known & (lo2 < hi2)
            lo, hi = np.where(fits, lo2, 0), np.where(fits, hi2, self.size)
            # a failed match starts again one word before its end; before the word, where that is unknown or there is no match
            end = np.where(fits, end, np.where(known, np.maximum(end, at) - 1, at - 1))
            at = np.where(fits, at - 1, end)
            full = fits & (end - at >= self.length)
            if full.any():
                row = np.searchsorted(self.starts, lo[full], "right") - 1
                lo[full], hi[full] = self.starts[row], self.starts[row + 1]
                end[full] = at[full] + self.length
                found.append((stream[full], at[full], lo[full], (hi - lo)[full]))
            live = (at > 0) & (end >= self.length)
            stream, at, end, lo, hi = (x[live] for x in (stream, at, end, lo, hi))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)


# ---- anchors


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(m)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Hashes of any runs of a sequence of hashed words, from its weighted running sums."""

    def __init__(self, words: np.ndarray):
        power, self.back = (np.full(len(words) + 1, x, np.uint64) for x in (STEP, BACK))
        power[0] = self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power)[:-1])))

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        of = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mixed(of + np.asarray(salt, np.uint64) * np.uint64(MIX[1]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (runs of anything but blanks and the control characters 9 to 13), and each text's count."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    at = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), np.bincount(at[real.to_numpy(zero_copy_only=False)], minlength=len(split))


def word_hashes(words: pa.Array) -> np.ndarray:
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return each[coded.indices.to_numpy()]


def anchors(of: Sums, text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context of hashed words, given each word's text: its first and last window and its anchor's place."""
    n, width, none = len(text), length - gram + 1, np.zeros(0, np.int64)
    whole = np.flatnonzero(text[: max(n - length + 1, 0)] == text[length - 1 :])  # windows inside one text
    if len(whole) == 0:
        return none, none, none
    begin = np.arange(n - gram + 1)
    h = of(begin, begin + gram)
    best, reach = begin, 1  # place of the least run, the leftmost of equal ones, among the next `reach` runs
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[a] <= h[b], a, b)
        reach += step
    place = best[whole]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(whole) != 1) | (np.diff(text[whole]) != 0))))
    last = np.concatenate((first[1:], [len(whole)])) - 1
    return whole[first], whole[last], place[first]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [a, b), as disjoint intervals that don't touch."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))
    return a[new], b[ends]


# ---- Spark

# kind, anchor, context, place; n counts the windows of a context, the words of a mark
PLACE = "kind int, h long, c long, id {id}, k long, lo long, n long"
NAMES = ["kind", "h", "c", "id", "k", "lo", "n"]
BY = [("id", "ascending"), ("k", "ascending"), ("lo", "ascending")]
LOW = (1 << 40) - 1  # positions of several texts or contexts stand in one number


def _rows(kind: int, h: np.ndarray, c: np.ndarray, ids: pa.Array, k: pa.Array, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), ids, k, pa.array(lo), pa.array(n)], NAMES)


def _mark_rows(ids: pa.Array, k: pa.Array, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marks for words [lo, hi) of the texts (ids, k)[row], those that touch as one. Their h only spreads them."""
    if len(row):
        a, b = merged((row << 40) + lo, (row << 40) + hi)
        take = pa.array(a >> 40)
        yield _rows(MARK, a * np.int64(2654435761), a, ids.take(take), k.take(take), a & LOW, b - a)


def _twins(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b are the same place: rows repeated with id and text count once."""
    k, lo, ids = table.column("k").to_numpy(), table.column("lo").to_numpy(), table.column("id").combine_chunks()
    x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
    same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
    return (k[a] == k[b]) & (lo[a] == lo[b]) & same.to_numpy(zero_copy_only=False)


def _contexts(ids: pa.Array, k: pa.Array, rows: tuple[np.ndarray, ...], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts (h, c, text, lo, n) of a batch: the first of equal ones as rows, the others as marks."""
    h, c, text, lo, n = rows
    place = pa.table({"id": ids.take(pa.array(text)), "k": k.take(pa.array(text)), "lo": lo})
    rank = np.empty(len(h), np.int64)
    rank[pc.sort_indices(place, sort_keys=BY, null_placement="at_start").to_numpy()] = np.arange(len(h))
    by = np.lexsort((rank, c, h))
    new = np.concatenate(([True], (np.diff(h[by]) != 0) | (np.diff(c[by]) != 0)))
    lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    first, later = by[new], by[~new]
    later = later[~_twins(place, later, lead[~new])]
    yield from _mark_rows(ids, k, text[later], lo[later], lo[later] + n[later] + length - 1)
    take = pa.array(text[first])
    yield _rows(INDEX, h[first], c[first], ids.take(take), k.take(take), lo[first], n[first])


def _scan(length: int, gram: int):
    """id, k, text -> contexts and marks (PLACE)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = words_of(batch.column(2))
            hashes, base = word_hashes(words), np.cumsum(sizes) - sizes
            text, found = np.repeat(np.arange(len(sizes)), sizes), []
            for s in range(0, len(hashes) - length + 1, SPAN):  # a context cut here is two, each with its own windows
                part = text[s : s + SPAN + length - 1]
                of = Sums(hashes[s : s + SPAN + length - 1])
                lo, hi, place = anchors(of, part, length, gram)
                t = part[lo]
                found.append((of(place, place + gram), of(lo, hi + length, place - lo + 1), t, lo + s - base[t], hi - lo + 1))
            if any(len(x[0]) for x in found):
                yield from _contexts(batch.column(0), batch.column(1), tuple(np.concatenate(x) for x in zip(*found, strict=True)), length)

    return scan


def _meet(length: int, hot: int):
    """PLACE rows in order, those of an anchor together -> marks for contexts that stood before; contexts of anchors that have several."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: pa.Table | None = None  # the first place of the last context
        waiting: pa.Table | None = None  # different contexts of the last anchor, `hot` at most
        crowded = None  # the last anchor, if it has more

        def told(pool: pa.Table, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, crowded
            h = pool.column("h").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1, [len(h)]))
            count = np.diff(edge)
            many = (count > hot) | (h[edge[:-1]] == crowded if crowded is not None else False)
            several = (count > 1) | many
            wait = not ended and not many[-1]
            if wait:
                several[-1] = False
            for kind, which in ((INDEX, several & ~many), (CROWD, several & many)):
                rows = pool.filter(pa.array(np.repeat(which, count))).combine_chunks()
                for part in rows.to_batches():
                    yield part.set_column(0, "kind", pa.array(np.full(part.num_rows, kind, np.int32)))
            crowded = h[-1] if many[-1] else None
            waiting = pool.slice(edge[-2]).combine_chunks() if wait else None

        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == MARK).any():
                yield batch.filter(pa.array(kinds == MARK))
            table = pa.Table.from_batches([batch]).filter(pa.array(kinds != MARK))
            if table.num_rows == 0:
                continue
            old = lead is not None
            table = (pa.concat_tables([lead, table]) if old else table).combine_chunks()
            h, c = table.column("h").to_numpy(), table.column("c").to_numpy()
            new = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(c) != 0)))
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = np.flatnonzero(~new)
            later = later[~_twins(table, later, first[later])]
            lo, n = table.column("lo").to_numpy()[later], table.column("n").to_numpy()[later]
            take = pa.array(later)
            yield _rows(MARK, h[later], c[later], table.column("id").combine_chunks().take(take), table.column("k").combine_chunks().take(take), lo, n + length - 1)
            lead = table.slice(first[-1], 1).combine_chunks()
            new[0] &= not old
            fresh = table.filter(pa.array(new))
            if fresh.num_rows:
                yield from told(pa.concat_tables([waiting, fresh]).combine_chunks() if waiting is not None else fresh.combine_chunks(), False)
        if waiting is not None:
            yield from told(waiting, True)

    return scan


CUT = PLACE + ", words string"


def _cut(length: int):
    """id, k, text, want (kind, h, lo, n) -> contexts with their words for the index; the windows of crowded ones, each a context."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy(zero_copy_only=False))
            kind, h, lo, n = (want.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("kind", "h", "lo", "n"))
            ids, k, texts = (batch.column(i) for i in range(3))
            own = np.flatnonzero(kind == INDEX)
            words, of_row = [], -1
            for i in range(0, len(own), PART):
                part, cut = own[i : i + PART], []
                for r, a, b in zip(row[part].tolist(), lo[part].tolist(), (lo[part] + n[part] + length - 1).tolist(), strict=True):
                    if r != of_row:
                        words, of_row = texts[r].as_py().encode().split(), r
                    cut.append(b" ".join(words[a:b]))
                take = pa.array(row[part])
                rows = _rows(INDEX, h[part], np.zeros(len(part), np.int64), ids.take(take), k.take(take), lo[part], n[part])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cut, pa.binary()).cast(pa.string())], [*NAMES, "words"])
            many = np.flatnonzero(kind == CROWD)
            if len(many):
                all_words, sizes = words_of(texts)
                of, base = Sums(word_hashes(all_words)), np.cumsum(sizes) - sizes
                for i in range(0, len(many), PART):
                    part = many[i : i + PART]
                    r = np.repeat(row[part], n[part])
                    at = np.repeat(lo[part] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(len(r))
                    begin = base[r] + at
                    take = pa.array(r)
                    rows = _rows(CROWD, of(begin, begin + length), of(begin, begin + length, 1), ids.take(take), k.take(take), at, np.ones(len(r), np.int64))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(len(r), pa.string())], [*NAMES, "words"])

    return scan


def _index(length: int, block: int):
    """CUT rows sorted by anchor -> marks for windows that the index of their block finds earlier too."""

    def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, sort_keys=BY, null_placement="at_start")).combine_chunks()
        at = np.arange(table.num_rows)
        table = table.filter(pa.array(np.concatenate(([True], ~_twins(table, at[1:], at[:-1]))))).combine_chunks()
        words = pc.split_pattern(table.column("words").combine_chunks(), " ").flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        sizes = table.column("n").to_numpy() + length - 1
        stream, start, row, count = FMIndex(words, sizes, length).search(words, sizes)
        more = count > 1
        stream, start, row = stream[more], start[more], row[more]
        by = np.lexsort((stream, row))
        later = by[1:][row[by[1:]] == row[by[:-1]]]  # streams are in order of their places
        lo = table.column("lo").to_numpy()[stream[later]] + start[later]
        yield from _mark_rows(table.column("id").combine_chunks(), table.column("k").combine_chunks(), stream[later], lo, lo + length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            parts.append(batch)
            held += int(batch.column("n").to_numpy().sum()) + batch.num_rows * (length - 1)
            if held >= block:
                table = pa.Table.from_batches(parts).combine_chunks()
                edges = np.flatnonzero(np.diff(table.column("h").to_numpy())) + 1
                if len(edges):
                    yield from marks(table.slice(0, edges[-1]))
                    rest = table.slice(edges[-1]).combine_chunks()
                    parts, held = rest.to_batches(), 0
        if parts:
            yield from marks(pa.Table.from_batches(parts))

    return scan


def repeat_marks(rows: DataFrame, length: int, gram: int, block: int, hot: int) -> DataFrame:
    """(id, k, lo, n): runs of words of rows (id, k, text) that windows found earlier too cover; they may overlap."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = PLACE.format(id=rows.schema["id"].dataType.simpleString())

    def met(contexts: DataFrame, name: str) -> DataFrame:
        dealt = contexts.repartition(tasks, "h").sortWithinPartitions("kind", "h", "c", "id", "k", "lo")
        return materialise(map_batches(dealt, _meet(length, hot), place), name)

    found = met(map_batches(rows, _scan(length, gram), place), "contexts")
    wanted = found.filter(F.col("kind") != MARK).groupBy("id", "k").agg(F.collect_list(F.struct("kind", "h", "lo", "n")).alias("want"))
    wanted = wanted.select(F.col("id").alias("wid"), F.col("k").alias("wk"), "want")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["wid"]) & (rows["k"] == wanted["wk"])).select("id", "k", "text", "want")
    cut = materialise(map_batches(texts, _cut(length), CUT.format(id=rows.schema["id"].dataType.simpleString())), "cut")
    shards = cut.filter(F.col("kind") == INDEX).repartition(tasks, "h").sortWithinPartitions("h")
    marks = found.filter(F.col("kind") == MARK).unionByName(map_batches(shards, _index(length, block), place))
    crowd = cut.filter(F.col("kind") == CROWD).drop("words")
    if not crowd.isEmpty():
        marks = marks.unionByName(met(crowd, "windows").filter(F.col("kind") == MARK))
    return marks.select("id", "k", "lo", "n")


def passage_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    block: int = BLOCK, hot: int = HOT, with_text: bool = False,
) -> DataFrame:
    """Per row: the id, n_words, n_removed, spans (the removed runs of words), kept_sha256, and the kept text if asked for.

    Words are compared unchanged; kept words are joined by one space. Null counts as no words; texts of fewer than
    `length` words keep everything. Documents are in order of their ids, null first, and of a hash of the text where ids
    are equal; rows that repeat both id and text count as one and get the same result. Windows never cross rows. An
    empty table gives no rows; other columns of docs are ignored. Long texts are scanned in parts of SPAN words.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("k"), "text")
    found = repeat_marks(rows, length, gram, block, hot)
    per_row = found.groupBy("id", "k").agg(F.collect_list(F.struct("lo", "n")).alias("marks")).select(F.col("id").alias("rid"), F.col("k").alias("rk"), "marks")
    joined = rows.join(per_row, rows["id"].eqNullSafe(per_row["rid"]) & (rows["k"] == per_row["rk"]), "left").select("id", "text", "marks")
    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("kept_sha256", StringType())]
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), *fields, *[StructField("kept", StringType())] * with_text])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            marks = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words, spans = text.encode().split(), []
                if marks[i].is_valid:
                    lo, n = (marks[i].values.field(x).to_numpy() for x in ("lo", "n"))
                    spans = np.stack(merged(lo, lo + n), 1).tolist()
                edges = [0, *(x for s in spans for x in s), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), spans, hashlib.sha256(joined).hexdigest(), *[joined.decode()] * with_text))
            types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), *[pa.string()] * with_text]
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return map_batches(joined, cut, schema)
