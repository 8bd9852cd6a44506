"""Removal of long repeats with a run-length compressed BWT index.

Every window of `length` bytes selects its least hashed k-mer as its anchor, so equal windows lie around equal anchors
at equal offsets, and each window belongs to one anchor. The bytes of an anchor's windows are its context.

1. Contexts that are equal (same anchor hash, offset and bytes) are repeated outright. They are counted by hash with
   partial sums, so a hot passage leaves a task as one row, and joined back to their places.
2. Contexts that share an anchor but differ go to the index, those of one anchor together: a run-length compressed BWT
   of the contexts with, at the run ends, samples of the LF mapping, the suffix array and the (irreducible) LCP values.
   Streaming a context backwards through the runs keeps its row and its longest match above and below, that is its
   matching statistics against all other places in the index; a window whose match reaches `length` is repeated.
3. The contexts of an anchor with more than `hot` of them are split before they are indexed: their windows are dealt
   into PARTS by how far they reach to the left, and the bytes beside the anchor that all windows of a part hold lengthen
   it. Equal windows fall into the same part and meet again. Only parts that meet others are cut out and go on. Anchors
   grow until they are not crowded; one as long as a window has a single context. So no task gets more of an anchor
   than a block.

Nothing is compared outside these steps, and none drops a window: the result is exact up to 128-bit hash collisions.
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
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .shared import map_batches, materialise, text_of

LENGTH, KMER, BLOCK, HOT = 400, 128, 750_000, 1024
CUT = 2048  # contexts sent at a time
PARTS = 17  # of a crowded anchor's windows; two turns bring parts of one window at the usual widths
# Odd multipliers, one for each doubling of the hashed width from 1 byte to 128.
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
PLACE = 20  # low bits of a k-mer's sort key hold its position, so the leftmost of equal ones wins


# ---- anchors


def kmer_hashes(raw: np.ndarray, kmer: int) -> np.ndarray:
    """64-bit hashes of all k-mers; kmer is a power of two up to 128."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    n = 1
    for step in STEPS:
        if n == kmer:
            break
        h = h[:-n] * np.uint64(step) + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def anchors(text: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: its k-mer's hash, its position, and the first and last start of the windows that select it."""
    raw, width, found = np.frombuffer(text, np.uint8), length - kmer + 1, []
    windows, block = len(raw) - length + 1, (1 << PLACE) - width
    for at in range(0, windows, block):
        h = kmer_hashes(raw[at : min(len(raw), at + block + length - 1)], kmer)
        least = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
        place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        found.append((h[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def context_hashes(text: bytes, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """A hash of each anchor's context and of the anchor's offset in it."""
    spans = zip(first.tolist(), (last + length).tolist(), (place - first).tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(text[a:b], off) for a, b, off in spans], np.uint64).view(np.int64)


# ---- the run-length index


class RunIndex:
    """Run-length compressed BWT of contexts, each ended by a separator of its own; samples are kept at run ends only."""

    def __init__(self, contexts: list[bytes]):
        sizes = np.array([len(c) for c in contexts], np.int64)
        m = len(contexts)
        self.ends = np.cumsum(sizes + 1) - 1  # place of each separator
        joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + m
        joined[self.ends] = np.arange(m)
        self.n = n = len(joined)
        levels, widths = self._ranks(joined, m)
        rank = levels[-1]
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)

        def lce(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Longest common extension of the suffixes at p and q, from the ranks of every doubling."""
            found = np.zeros(len(p), np.int64)
            for level, width in zip(reversed(levels), reversed(widths), strict=True):
                a, b = p + found, q + found
                inside = (a < n) & (b < n)
                same = np.zeros(len(p), bool)
                same[inside] = level[a[inside]] == level[b[inside]]
                found[same] += width
            for _ in range(widths[0] - 1):
                a, b = p + found, q + found
                inside = (a < n) & (b < n)
                same = np.zeros(len(p), bool)
                same[inside] = joined[a[inside]] == joined[b[inside]]
                if not same.any():
                    break
                found[same] += 1
            return found

        bwt = joined[order - 1]
        self.start = np.concatenate(([0], np.flatnonzero(np.diff(bwt)) + 1))  # first row of each run
        self.end = np.concatenate((self.start[1:] - 1, [n - 1]))
        self.sampled = order[self.end]  # suffix array at run ends
        self.lf = rank[(order[self.start] - 1) % n].astype(np.int64)
        last = self.lf + self.end - self.start
        at, up, down = np.arange(len(self.lf)), np.zeros(len(self.lf), np.int64), np.zeros(len(self.lf), np.int64)
        above, below = at[self.lf > 0], at[last < n - 1]
        up[above] = lce(order[self.lf[above]], order[self.lf[above] - 1])
        down[below] = lce(order[last[below]], order[last[below] + 1])
        self.up, self.down = up, down
        self.first = rank[self.ends].astype(np.int64)  # row of each separator's suffix

    @staticmethod
    def _ranks(joined: np.ndarray, m: int) -> tuple[list[np.ndarray], list[int]]:
        """Ranks of suffixes by their first `width` symbols (places of their groups in suffix order), width doubling until all differ.

        A suffix that meets its separator is told apart at once, so only groups still open are sorted again.
        """
        n, width = len(joined), 7
        padded = np.concatenate((joined, np.zeros(width, np.int64)))
        symbol = np.where(padded >= m, padded - m + 1, 0)  # nine bits; separators are 0
        key, inside = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            inside &= symbol[i : i + n] != 0
            key = (key << 9) | np.where(inside, symbol[i : i + n], 0)
        del padded, symbol
        order = np.argsort(key)
        slots = np.arange(n)
        start = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(key[order]) != 0)), slots, 0))
        # equal keys with a separator hold it at the same place, and later separators are larger
        closed = np.flatnonzero(~inside[order])
        ends = order[closed]
        order[closed] = ends[np.lexsort((ends, key[ends]))]
        start[closed] = closed
        rank = np.empty(n, np.int64)
        rank[order] = start
        levels, widths = [rank.astype(np.int32)], [width]
        while True:
            twin = start[1:] == start[:-1]
            open_ = np.flatnonzero(np.concatenate((twin, [False])) | np.concatenate(([False], twin)))
            if len(open_) == 0:
                return levels, widths
            place = order[open_]
            key = start[open_] * n + rank[place + width]
            by = np.argsort(key)
            key = key[by]
            order[open_] = place[by]
            first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(open_)), 0))
            start[open_] = open_[first]
            rank[order[open_]] = start[open_]
            width *= 2
            levels.append(rank.astype(np.int32))
            widths.append(width)

    def repeats(self, length: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(context, start) of every window of `length` bytes that starts anywhere else in the index, for the contexts `of`.

        All contexts step backwards together: a row's run gives the next row; a match above or below grows by one within
        a run and is a sample at its ends.
        """
        of = np.arange(len(self.ends)) if of is None else of
        begins = np.concatenate(([0], self.ends[:-1] + 1))[of]
        left = self.ends[of] - begins
        order = np.argsort(-left)
        of, left = of[order], left[order]
        row, up, down = self.first[of], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        which, starts = [], []
        for step in range(1, int(left.max(initial=0)) + 1):
            live = int(np.searchsorted(-left, -step, "right"))  # contexts of at least `step` bytes stand in front
            row, up, down = row[:live], up[:live], down[:live]
            run = np.searchsorted(self.start, row, "right") - 1
            up = np.where(row == self.start[run], self.up[run], up + 1)
            down = np.where(row == self.end[run], self.down[run], down + 1)
            row = self.lf[run] + row - self.start[run]
            if step >= length:
                hit = np.flatnonzero(np.maximum(up, down) >= length)
                which.append(of[hit])
                starts.append(left[hit] - step)
        none = np.zeros(0, np.int64)
        return (np.concatenate(which), np.concatenate(starts)) if which else (none, none)


# ---- Spark

ROW = "kind int, id {id}, k long, h long, c long, off long, lo long, hi long, multi boolean"
MARK, ANCHOR = 0, 1
NAMES = ["kind", "id", "k", "h", "c", "off", "lo", "hi", "multi"]
ROOM = 40  # bits of a byte position where positions of several texts stand in one number


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and k, a hash of the text: with the id it names a row or rows that are equal anyway."""
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("k", F.xxhash64("text"))


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [a, b), as disjoint intervals that don't touch."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))
    return a[new], b[ends]


def _emit_anchors(length: int, kmer: int):
    """Per batch: its places of contexts that it holds more than once as marks, merged, and a row per different context."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if len(text) >= length:
                    h, place, lo, hi = anchors(text, length, kmer)
                    found.append((h, context_hashes(text, place, lo, hi, length), place - lo, lo, hi))
                    at.append(np.full(len(h), i))
            if not found:
                continue
            h, c, off, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            at = np.concatenate(at)
            order = np.lexsort((c, h))
            h, c, off, lo, hi, at = (x[order] for x in (h, c, off, lo, hi, at))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            counts = np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
            multi = np.repeat(counts > 1, counts)
            ids, k = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)

            def rows(kind: int, w: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), ids.take(pa.array(w)), pa.array(k[w]), *map(pa.array, rest)], NAMES)

            if multi.any():
                base = at[multi] << ROOM
                a, b = _merged(base + lo[multi], base + hi[multi] + length)
                none, low = np.zeros(len(a), np.int64), (1 << ROOM) - 1
                yield rows(MARK, a >> ROOM, none, none, none, a & low, b & low, np.ones(len(a), bool))
            yield rows(ANCHOR, at[new], h[new], c[new], off[new], lo[new], hi[new], multi[new])

    return scan


CONTEXT = "h long, c long, multi boolean, id {id}, k long, lo long, bytes binary, a long, b long"
FIELDS = ["h", "c", "multi", "id", "k", "lo", "bytes", "a", "b"]


def _cut_contexts(kmer: int):
    """id, text, k, reps -> a row per representative with its bytes and, in them, the anchor [a, b)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            reps = batch.column(3)
            counts = reps.value_lengths().to_numpy(zero_copy_only=False)
            flat = reps.flatten()
            lo, end, off = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "end", "off"))
            at = np.repeat(np.arange(len(texts)), counts)
            for i in range(0, len(at), CUT):
                part = slice(i, i + CUT)
                mine = flat.slice(i, CUT)
                raw = [texts[t][x:y] for t, x, y in zip(at[part].tolist(), lo[part].tolist(), end[part].tolist(), strict=True)]
                take = pa.array(at[part])
                yield pa.RecordBatch.from_arrays(
                    [mine.field("h"), mine.field("c"), mine.field("multi"), batch.column(0).take(take), batch.column(2).take(take), mine.field("lo"), pa.array(raw, pa.binary()), pa.array(off[part]), pa.array(off[part] + kmer), mine.field("n")],
                    [*FIELDS, "n"],
                )

    return scan


def split_context(size: int, a: int, b: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, a, b) of the parts of a context of `size` bytes around [a, b): each has the windows that reach about as far left.

    The longer anchor [a, b) is relative to the part.
    """
    rest = length - (b - a)  # bytes of a window beside the anchor
    step = -(-(rest + 1) // PARTS)
    out = []
    for left in range(0, rest + 1, step):
        most = min(left + step - 1, rest)  # the part's windows hold left to most bytes before the anchor
        start, last = max(0, a - most), min(size - length, a - left)
        if start <= last:
            out.append((start, last + length, a - left - start, b + rest - most - start))
    return out


PART = "h long, c long, multi boolean, id {id}, k long, lo long, a long, b long, start long, size long, ph long, pc long"
PART_FIELDS = [x.split()[0] for x in PART.split(", ")]


def _split(length: int):
    """Contexts (FIELDS) -> a row per part, without its bytes; ph and pc name the context that it is part of."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h, c, numbers = [], [], [], []
            for i, (first, text, a, b) in enumerate(zip(*(batch.column(x).to_pylist() for x in (5, 6, 7, 8)), strict=True)):
                for start, end, x, y in split_context(len(text), a, b, length):
                    part = text[start:end]
                    at.append(i)
                    h.append(xxhash.xxh64_intdigest(part[x:y], a - start - x))  # the side differs with the bytes taken in on the left
                    c.append(xxhash.xxh64_intdigest(part, x))
                    numbers.append((first + start, x, y, start, end - start))
            take = pa.array(at, pa.int64())
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, c)]
            found = np.array(numbers, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([*hashes, *(batch.column(x).take(take) for x in (2, 3, 4)), *map(pa.array, found), *(batch.column(x).take(take) for x in (0, 1))], PART_FIELDS)

    return scan


def _index_blocks(length: int, block: int):
    """Rows sorted by (h, c), whole anchors together: marks for the windows of single contexts that the index finds elsewhere."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0

        def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            h, c = (table.column(x).to_numpy() for x in ("h", "c"))
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))  # rows repeated with id and text are one context
            table = table.filter(pa.array(fresh))
            single = np.flatnonzero(~table.column("multi").to_numpy())
            if len(single) == 0 or table.num_rows < 2:
                return
            which, at = RunIndex(table.column("bytes").to_pylist()).repeats(length, single)
            if len(which) == 0:
                return
            order = np.lexsort((at, which))
            which, at = which[order], at[order]
            new = np.concatenate(([True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)))
            last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))
            w = which[new]
            lo = table.column("lo").to_numpy()[w]
            ids, k = table.column("id").combine_chunks().take(pa.array(w)), table.column("k").to_numpy()[w]
            yield pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else ids.combine_chunks(), pa.array(k), pa.array(lo + at[new]), pa.array(lo + at[last] + length)], ["id", "k", "lo", "hi"])

        def cut(table: pa.Table) -> tuple[list[pa.Table], pa.Table]:
            """Pieces of whole anchors of about `block` bytes each, and what is left; the last anchor may go on and is left."""
            h = table.column("h").to_numpy()
            size = np.concatenate(([0], np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())))
            found, at = [], 0
            for end in (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist():
                if size[end] - size[at] >= block:
                    found.append(table.slice(at, end - at))
                    at = end
            return found, table.take(pa.array(np.arange(at, table.num_rows))) if at else table

        for batch in batches:
            parts.append(batch)
            held += batch.nbytes
            if held >= block:
                found, left = cut(pa.Table.from_batches(parts))
                for piece in found:
                    yield from marks(piece)
                # an anchor longer than a block waits for its end, and is looked at again only after as much has come again
                parts, held = left.to_batches(), 0 if not found else left.nbytes
        if parts:
            yield from marks(pa.Table.from_batches(parts))

    return scan


def _with_sizes(contexts: DataFrame) -> DataFrame:
    """The contexts of anchors that have several, and n, how many."""
    return contexts.join(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "h")


def _combined(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row per (h, c): its columns from one of the rows, and whether the context is repeated."""
    each = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("_n"), F.max("multi").alias("_multi"), *[F.first(x).alias(x) for x in columns])
    return each.withColumn("multi", F.col("_multi") | (F.col("_n") > 1)).drop("_n", "_multi")


def repeat_marks(rows: DataFrame, length: int, kmer: int, block: int, hot: int) -> DataFrame:
    """(id, k, lo, hi): byte ranges of rows (id, text, k) that strings of `length` bytes found elsewhere cover; they may overlap."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, k long, lo long, hi long"
    found = materialise(map_batches(rows, _emit_anchors(length, kmer), ROW.format(id=kind)), "anchors")
    here = found.filter(F.col("kind") == ANCHOR)
    # most anchors stand once and go here; the join's large partitions can be split, whatever an anchor's share
    shared = here.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    here = materialise(here.join(shared, "h", "left_semi").select(NAMES), "shared")
    contexts = materialise(_combined(here, ["id", "k", "off", "lo", "hi"]), "contexts")
    fresh = here.filter("not multi").join(contexts.filter("multi").select("h", "c"), ["h", "c"], "left_semi")  # the others are marked
    marks = found.filter(F.col("kind") == MARK).select("id", "k", "lo", "hi").unionByName(fresh.select("id", "k", "lo", (F.col("hi") + length).alias("hi")))

    def indexed(part: DataFrame) -> DataFrame:
        dealt = part.select("h", "c", "multi", "id", "k", "lo", "bytes").repartition(n, "h").sortWithinPartitions("h", "c")
        return map_batches(dealt, _index_blocks(length, block), out)

    reps = _with_sizes(contexts).withColumn("end", F.col("hi") + length)
    per_row = reps.groupBy("id", "k").agg(F.collect_list(F.struct("h", "c", "multi", "off", "lo", "end", "n")).alias("reps")).select(F.col("id").alias("rid"), F.col("k").alias("rk"), "reps")
    mine = rows["id"].eqNullSafe(per_row["rid"]) & (rows["k"] == per_row["rk"])
    texts = rows.join(per_row, mine).select("id", "text", "k", "reps")
    cut = materialise(map_batches(texts, _cut_contexts(kmer), f"{CONTEXT.format(id=kind)}, n long"), "cut")
    while True:
        marks = marks.unionByName(indexed(cut.filter(F.col("n") <= hot)))
        many = cut.filter(F.col("n") > hot)
        if many.isEmpty():
            return marks
        parts = materialise(map_batches(many.select(FIELDS), _split(length), PART.format(id=kind)), "parts")
        each = materialise(_combined(parts, [x for x in PART_FIELDS if x not in ("h", "c", "multi")]), "split")
        fresh = parts.filter("not multi").join(each.filter("multi").select("h", "c"), ["h", "c"], "left_semi")
        marks = marks.unionByName(fresh.select("id", "k", "lo", (F.col("lo") + F.col("size")).alias("hi")))
        met = _with_sizes(each).select(*[F.col(x) for x in PART_FIELDS], "n")
        whole = many.select(F.col("h").alias("ph"), F.col("c").alias("pc"), F.col("bytes").alias("whole"))
        bytes_ = F.expr("substring(whole, cast(start as int) + 1, cast(size as int))").alias("bytes")
        cut = materialise(met.join(whole, ["ph", "pc"]).select("h", "c", "multi", "id", "k", "lo", bytes_, "a", "b", "n"), "cut")


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER,
    block: int = BLOCK, hot: int = HOT, with_bytes: bool = False,
) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, spans (the removed byte ranges), kept_sha256, and the kept bytes if asked for.

    Texts count as UTF-8, null as empty; texts of fewer than `length` bytes keep everything. Matches never cross rows;
    rows equal in id and text are repeats of each other like any others. Time is linear in the input but for contexts
    that share an anchor, which are sorted block by block.
    """
    rows = _rows(docs, id_col, text_col)
    found = repeat_marks(rows, length, kmer, block, hot).distinct()
    per_row = found.groupBy("id", "k").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).select(F.col("id").alias("rid"), F.col("k").alias("rk"), "marks")
    joined = rows.join(per_row, rows["id"].eqNullSafe(per_row["rid"]) & (rows["k"] == per_row["rk"]), "left").select("id", "text", "marks")
    fields = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("kept_sha256", StringType())]
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), *fields, *[StructField("kept", BinaryType())] * with_bytes])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            marks = batch.column(2)
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                spans: list[list[int]] = []
                if marks[i].is_valid:
                    own = marks[i].values
                    a, b = _merged(own.field("lo").to_numpy(), own.field("hi").to_numpy())
                    spans = np.stack([a, b], 1).tolist()
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
            types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), *[pa.binary()] * with_bytes]
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return map_batches(joined, cut, schema)
