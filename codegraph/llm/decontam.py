"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Training words stream through the automaton, which keeps the length of the longest item passage that ends at each word.
Where that length reaches a window, the words of the window are hit, and the automaton's state tells which items hold
it. The automaton is built from a bounded block of items; a larger benchmark takes several. Tasks build them and write
them to the shared folder, and scanning tasks load them from there one at a time, each once for a group of texts.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .shared import filesystem, map_batches, materialise, named, with_text, work_path

WINDOW, BLOCK_CHARS = 13, 1_000_000
GROUP_BYTES = 64 << 20  # texts held while the blocks of a large benchmark pass
COVERAGE = 20  # a document is contaminated when COVERAGE * hit words reach its words

# One table lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes of other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(utf8: bytes) -> list[bytes]:
    return utf8.translate(TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; matching never runs from one item into the next."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._owners(coded)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, cut off so that its longest string is one word longer than p's."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _owners(self, coded: list[list[int]]) -> None:
        """full: items by the state whose strings of window words they hold; short: (words, item) of whole short items by state."""
        self.full: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, codes in enumerate(coded):
            v = 0
            for at, c in enumerate(codes):
                v = self.step[v][c]
                if at + 1 >= self.window:
                    owners = self.full.setdefault(self.top(v), [])
                    if not owners or owners[-1] != item:
                        owners.append(item)
            if 0 < len(codes) < self.window:
                while self.length[self.link[v]] >= len(codes):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(codes), item))
        self.least = min([self.window, *(n for s in self.short.values() for n, _ in s)])
        self.chain = [0] * len(self.link)  # nearest state along the links, itself included, at which a short item ends
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.chain[v] = v if v in self.short else self.chain[self.link[v]]

    def top(self, v: int) -> int:
        """The state on v's links that holds its suffix of window words."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Mark the hit words and add the indices of items with windows here."""
        n = len(words)
        if n < self.least:
            return
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        longest = ends - starts >= self.least  # only runs of known words can hold a window
        step, link, length, full = self.step, self.link, self.length, self.full
        for a, b in zip(starts[longest].tolist(), ends[longest].tolist(), strict=True):
            v = matched = 0
            for at, c in enumerate(codes[a:b].tolist(), a + 1):
                while v and c not in step[v]:
                    v = link[v]
                    matched = length[v]
                if c in step[v]:
                    v = step[v][c]
                    matched += 1
                if matched >= self.window:
                    hit[at - self.window : at] = b"\1" * self.window
                    items.update(full.get(self.top(v), ()))
                if s := self.chain[v]:
                    while s:
                        for size, item in self.short[s]:
                            if size <= matched:
                                hit[at - size : at] = b"\1" * size
                                items.add(item)
                        s = self.chain[link[s]]


def build_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int) -> list[str]:
    """Paths in the shared folder of pickled automata, each of the items of one hash block of about block_chars characters.

    A task builds a block and writes it under a name of its own; the written list, committed by Spark, says which count.
    Nothing but the paths reaches the driver.
    """
    spark = benchmark.sparkSession
    text = named([text_col])[0]
    bare = benchmark.select(named([id_col])[0].cast("string").alias("id"), text.alias("text")).filter("text is not null").distinct()
    chars = bare.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    folder = work_path(spark, "automata")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, list[bytes]]] = []
        at, done = None, []

        def put() -> None:
            if held:
                store, top = filesystem(folder)
                store.create_dir(top, recursive=True)
                path = f"{folder}/{uuid.uuid4().hex}"
                with store.open_output_stream(filesystem(path)[1], compression=None) as f:
                    f.write(cloudpickle.dumps(Automaton(sorted(held, key=lambda x: (x[0] or "", x[1])), window)))
                done.append(path)
                held.clear()

        for batch in batches:
            for block, item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(words_of, batch.column(2).cast(pa.binary()).to_pylist()), strict=True):
                if block != at:
                    put()
                    at = block
                if words:
                    held.append((item, words))
        put()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    dealt = bare.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).select("block", "id", "text")
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block")
    return sorted(r.path for r in materialise(map_batches(dealt, build, "path string"), "blocks").collect())


RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("item_ids", ArrayType(StringType())),
        StructField("hits", ArrayType(ArrayType(LongType()))),
        StructField("contaminated", BooleanType()),
    ]
)


def judged(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, block_chars: int, keep: list[str], drop: bool
) -> DataFrame:
    """A struct `row` of the kept columns and the struct `found`, as contamination says."""
    blocks = build_blocks(benchmark, item_col, item_text, window, block_chars)
    source, parts = with_text(docs, text_col, keep)
    schema = StructType([source.schema["row"], StructField("found", RESULT)])
    shape = to_arrow_schema(StructType([StructField("found", RESULT)])).field("found").type

    def load(path: str) -> Automaton:
        store, at = filesystem(path)
        with store.open_input_stream(at, compression=None) as f:
            return pickle.loads(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = load(blocks[0]) if len(blocks) == 1 else None
        group: list[tuple[pa.Array, list[bytes | None]]] = []
        held = 0

        def finish() -> Iterator[pa.RecordBatch]:
            """Each block in turn over the texts held, so that one automaton is in memory and is loaded once for them all."""
            hits: dict[tuple[int, int], bytearray] = {}
            owners: dict[tuple[int, int], set] = {}
            for turn, path in enumerate(blocks or [None]):
                own = only or (load(path) if path else None)
                for g, (_, texts) in enumerate(group):
                    for i, text in enumerate(texts):
                        words = words_of(text or b"")
                        if not turn:
                            hits[g, i], owners[g, i] = bytearray(len(words)), set()
                        if own:
                            items: set[int] = set()
                            own.scan(words, hits[g, i], items)
                            owners[g, i].update(own.ids[x] for x in items)
            for g, (row, texts) in enumerate(group):
                found = []
                for hit, ids in ((hits[g, i], owners[g, i]) for i in range(len(texts))):
                    n, n_hit = len(hit), hit.count(1)
                    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + hit + b"\0", np.int8))).reshape(-1, 2).tolist() if n_hit else []
                    found.append({"n_words": n, "n_hit": n_hit, "item_ids": sorted(ids - {None}), "hits": edges, "contaminated": n_hit > 0 and COVERAGE * n_hit >= n})
                out = pa.RecordBatch.from_arrays([row, pa.array(found, shape)], ["row", "found"])
                yield out.filter(pa.array([not x["contaminated"] for x in found], pa.bool_())) if drop else out
            group.clear()

        for batch in batches:
            texts, row = parts(batch)
            group.append((row, texts.cast(pa.binary()).to_pylist()))
            held += batch.nbytes
            if len(blocks) <= 1 or held >= GROUP_BYTES:
                yield from finish()
                held = 0
        yield from finish()

    return map_batches(source, scan, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None, drop: bool = False,
) -> DataFrame:
    """The kept columns of docs and a struct `found`: n_words, n_hit, item_ids (sorted as strings), hits (word ranges), contaminated.

    Null or empty text has no words and no hits and is not contaminated; null or wordless items have no windows; items
    that repeat an id count once, and an item with a null id can hit words but is not listed. With drop, contaminated
    rows are left out. An empty benchmark or table gives no hits or no rows. A column named `found` gives way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "found"]
    return judged(docs, benchmark, text_col, item_col, item_text, window, block_chars, keep, drop).select("row.*", "found")


def cut_words(text: str, ranges: list[list[int]]) -> str:
    """text without the words in the given ranges and what stands between them; each cut leaves one blank between its neighbours."""
    raw = text.encode()
    flags = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : edges[a][0]].rstrip())
        at = int(edges[b - 1][1])
    return b" ".join([*out, raw[at:].lstrip()] if out else [raw]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", cut: bool = False, item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs without the contaminated rows, all columns as they are; with cut, hit passages below that coverage leave the others' texts too.

    Null, empty and wordless texts stay, as does every row if the benchmark is empty; repeated rows fare alike; an empty
    table stays empty.
    """
    kept = judged(docs, benchmark, text_col, item_col, item_text, window, block_chars, docs.columns, drop=True)
    if not cut:
        return kept.select("row.*")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ranges = batch.column(0), batch.column(1).to_pylist()
            names = [row.type.field(i).name for i in range(row.type.num_fields)]
            done = [cut_words(t, r) if r else t for t, r in zip(row.field(text_col).to_pylist(), ranges, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if n == text_col else row.field(n) for n in names], names)

    return map_batches(kept.select("row", "found.hits"), clean, docs.schema)
