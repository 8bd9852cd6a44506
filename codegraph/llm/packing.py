"""Packing documents into token windows by non-negative least squares over shallow length combinations.

Documents are cut at multiples of the window, so each leaves one remainder. The histogram of piece lengths (at most
`window` bins, whatever the corpus) goes to the driver, which enumerates combinations of a few lengths that fill a
window, solves how often to use each by non-negative least squares, rounds down and packs the residual counts greedily.
The plan speaks of ranks within a length, so a join on length and rank range places every piece.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialise, text_of

WINDOW, EOS, SLACK, DEPTH, SWEEPS = 2048, 1, 4, 4, 60
# Text in which both tokenizer libraries split words alike beyond doubt: Latin letters, punctuation, plain white space.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ–—‘-„•…€]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's word pattern


class Encoder:
    """ids of the tokenizer file. Plain text goes through a faster library with the same vocabulary, the rest through the file's own."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._slow = path, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        # bytes are written as printable characters in the file: printable Latin-1 stands for itself, the others follow from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        code = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        """The file's own library, loaded once it is needed."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    held: list[Encoder] = []

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Encoder(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(held[0](text), np.uint32(eos)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.tolist()] * with_ids)))
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return map_batches(bare, pieces, ", ".join(f"{n} long" for n in names[:5]) + ", ids array<long>" * with_ids)


# ---- the plan, over the histogram alone


def combinations(lengths: list[int], window: int = WINDOW, slack: int = SLACK, depth: int = DEPTH) -> list[dict[int, int]]:
    """Shallow combinations {length: times} whose sum lies within slack below the window.

    For each length a: as many copies as fit or fewer, closed by the length that fills the rest; and a with one of a few
    others spread over the lengths, closed likewise.
    """
    found: dict[tuple, dict[int, int]] = {}

    def close(parts: list[int]) -> None:
        rest = window - sum(parts)
        if rest > slack:
            at = bisect_right(lengths, rest) - 1
            if at < 0 or rest - lengths[at] > slack:
                return
            parts = [*parts, lengths[at]]
        if rest >= 0:
            found.setdefault(key := tuple(sorted(parts)), {x: key.count(x) for x in set(key)})

    spread = lengths[:: max(1, len(lengths) // 12)]
    for a in lengths:
        most = window // a
        for times in {1, 2, 3, most // 2, most - 1, most}:
            if 0 < times <= most:
                close([a] * times)
        for b in spread:
            if a + b <= window:
                close([a, b])
                if depth > 3 and a + 2 * b <= window:
                    close([a, b, b])
    return list(found.values())


def nnls(combos: list[dict[int, int]], counts: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """Counts x >= 0 of combinations that bring sum of x * combination closest to the histogram: coordinate descent, exact in each step."""
    rest = {k: float(v) for k, v in counts.items()}
    x = [0.0] * len(combos)
    columns = [(list(c.items()), 1.0 / sum(m * m for m in c.values())) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, scale) in enumerate(columns):
            step = sum(m * rest[k] for k, m in items) * scale
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, m in items:
                    rest[k] -= m * step
        if moved < 0.01:
            break
    return np.array(x)


def greedy(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """Residual patterns: the longest length first, closed by the longest that still fit; each is repeated while its counts last."""
    left = {k: v for k, v in counts.items() if v}
    lengths = sorted(left)
    while lengths:
        pattern, room, at = {}, window, len(lengths)
        while room and at:
            at = bisect_right(lengths, room, 0, at) - 1
            if at < 0:
                break
            k = lengths[at]
            pattern[k] = min(left[k], room // k)
            room -= k * pattern[k]
        times = min(left[k] // m for k, m in pattern.items())
        yield pattern, times
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
                lengths.remove(k)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, sequence, offset, times): ranks lo..hi-1 of a length go, `times` to a sequence, from `sequence` and `offset` on."""
    used = dict.fromkeys(counts, 0)
    out, sequence = [], 0

    def place(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for k, m in sorted(pattern.items(), reverse=True):
            out.append((k, used[k], used[k] + m * times, sequence, offset, m))
            used[k] += m * times
            offset += k * m
        sequence += times

    if counts.get(window):
        place({window: 1}, counts[window])
    short = {k: v for k, v in counts.items() if k < window}
    combos = combinations(sorted(short), window)
    for combo, x in zip(combos, nnls(combos, short), strict=True):
        times = min([int(x), *((short[k] - used[k]) // m for k, m in combo.items())])
        if times > 0:
            place(combo, times)
    for pattern, times in greedy({k: v - used[k] for k, v in short.items()}, window):
        place(pattern, times)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end token alone. Documents are independent, so repeated rows and null ids make pieces of
    their own; an empty table gives no pieces. No piece is longer than the window and none is split further, so each id
    lies in one piece. A length with n pieces is ranked in about sqrt(n) parts of about sqrt(n) pieces, so neither a
    part nor the list of parts grows large where most pieces share a length, as the full ones do.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer, id_col, text_col, window, eos, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    salts = spark.createDataFrame([(k, math.isqrt(n - 1) + 1) for k, n in counts.items()], "_of long, _salts long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_of")).drop("_of")
    pieces = salted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_salts"))).drop("_salts")
    sizes = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_length = Window.partitionBy("length").orderBy("_salt")
    before = sizes.select("length", "_salt", (F.sum("_n").over(by_length) - F.col("_n")).alias("_before"))
    slots = plan(counts, window)
    table = spark.createDataFrame(slots, "_length long, _lo long, _hi long, _sequence long, _offset long, _times long")
    in_part = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(in_part) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(table), here)  # the plan has a few rows per length, whatever the corpus
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(at / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_times")) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
