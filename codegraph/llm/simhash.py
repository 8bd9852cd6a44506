"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each short of the 23 bits of the perfect binary
Golay code. Decoding a segment and its neighbours at one flipped bit gives the indices of a few nearby codewords; two
segments within two bits share an index, since a word half way between them decodes to one that both have.

With at most four differing bits over three segments, sorted errors are (0, <=2, ..) or (1, 1, 1 or 2). The first sort
shares one segment exactly and an index of another. In the second, two segments differ in exactly one bit: one of the
pair has even parity and gives the index of itself, the other gives those of its neighbours; and of the third segment,
cut in three parts, one part is equal. Joining on these keys therefore loses no link; every candidate is verified.

Keys are 31 to 34 bits wide, so chance candidates stay rare. A bucket never gives all its pairs: it gives spanning
forests of the links within it, which leave the components as they are. Members of a large bucket are dealt again and
meet only in parts, in other tasks: four differing bits leave two of six groups of bits equal, so those that share two
groups are compared, fifteen times over. No task holds a large bucket; a bucket holds distinct fingerprints, so copies
and a tight cluster of any number of documents are few of them, and a crowd far apart is cut small by the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .shared import key_of, map_batches, materialise, named, text_of

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
FEW = 8  # buckets up to this size compare all members at once
LARGE, GROUPS = 2048, 6  # buckets beyond this size meet in parts, by pairs of so many groups of bits
MIX = 0x9E3779B97F4A7C15  # an odd number that spreads keys over 64 bits


# ---- fingerprints


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> list[int]:
    """The hash of each run of `shingle` words; fewer words are one run, no words none."""
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(text[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(utf8: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of word shingles: words end at ASCII white space, A-Z are lower-cased; no words give 0."""
    return majority(shingle_hashes(utf8.lower().split(), shingle, seed))


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; none of no hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id alone by default) as a struct `row`, and `fp`, the fingerprint as a signed long."""
    source = docs.select(text_of(text_col).alias("text"), F.struct(*(keep or [id_col])).alias("row"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], ["row", "fp"])

    return map_batches(source, scan, StructType([source.schema["row"], StructField("fp", LongType())]))


# ---- Golay keys


class Golay:
    """Decoding of 23-bit words to the index of the one codeword within three bits."""

    def __init__(self) -> None:
        def rest(word: int) -> int:
            for i in range(22, 10, -1):
                if word >> i & 1:
                    word ^= GENERATOR << (i - 11)
            return word

        self.high = np.array([rest(i << 11) for i in range(1 << 12)], np.int64)
        self.leader = np.zeros(1 << 11, np.int64)
        for n in range(4):
            for bits in combinations(range(23), n):
                error = sum(1 << b for b in bits)
                self.leader[rest(error)] = error

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[self.high[words >> 11] ^ (words & 0x7FF)]) >> 11

    def around(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Indices of words with one of the lowest `bits` bits flipped: a row for each word."""
        return self.index(words[:, None] ^ (1 << np.arange(bits)))


def _few(keys: np.ndarray) -> np.ndarray:
    """Each row's distinct keys in front, -1 behind."""
    keys = np.sort(keys, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = 1 << 40
    keys.sort(axis=1)
    keys[keys == 1 << 40] = -1
    return keys[:, : max(1, int((keys >= 0).sum(1).max(initial=1)))]


def bucket_keys(golay: Golay, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) such that fingerprints within RADIUS bits share a key."""
    fp = fp.view(np.uint64)
    segments = [(fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near, once = [], []
    for words, (_, bits) in zip(segments, SEGMENTS, strict=True):
        own, flipped = golay.index(words)[:, None], golay.around(words, bits)
        near.append(_few(np.hstack([own, flipped])))
        odd = (np.bitwise_count(words) & 1).astype(bool)
        once.append(_few(np.where(odd[:, None], flipped, own)))
    keys, rows = [], []

    def put(tag: int, found: np.ndarray, valid: np.ndarray) -> None:
        keys.append((tag << 44) + found[valid])
        rows.append(np.broadcast_to(np.arange(len(fp)).reshape(-1, *[1] * (found.ndim - 1)), found.shape)[valid])

    tag = 0
    for i in range(3):
        for j in {0, 1, 2} - {i}:
            put(tag, (segments[i][:, None] << 12) + near[j], near[j] >= 0)
            tag += 1
    for r in range(3):
        p, q = (k for k in range(3) if k != r)
        pair = (once[p][:, :, None] << 12) + once[q][:, None, :]
        valid = (once[p][:, :, None] >= 0) & (once[q][:, None, :] >= 0)
        for part in range(3):
            put(tag, ((segments[r] >> 7 * part & (0xFF if part == 2 else 0x7F))[:, None, None] << 24) + pair, valid)
            tag += 1
    return np.concatenate(keys), np.concatenate(rows)


# ---- links


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the members of one bucket, found from each member once against those not yet reached."""
    left = fp.view(np.uint64).copy()
    a, b = [], []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            at, wave = wave[0], wave[1:]
            linked = np.bitwise_count(left ^ at) <= radius
            if linked.any():
                new, left = left[linked], left[~linked]
                a.append(np.full(len(new), at))
                b.append(new)
                wave = np.concatenate([wave, new])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none).view(np.int64), (np.concatenate(b) if b else none).view(np.int64)


def parts(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of groups of bits, the members under a key of their bucket and these bits. Those within RADIUS bits agree in one such pair; keys that clash by chance only make more meet."""
    groups = [sum(1 << bit for bit in range(first, 64, GROUPS)) for first in range(GROUPS)]
    own, bits = keys.view(np.uint64) * np.uint64(MIX), fp.view(np.uint64)
    found = [(bits & np.uint64(a | b)) ^ own ^ np.uint64(n * MIX % 2**64) for n, (a, b) in enumerate(combinations(groups, 2))]
    return np.concatenate(found).view(np.int64), np.tile(fp, len(found))


def bucket_links(keys: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; keys are sorted."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    a, b = [], []
    few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    k, x = keys[few], fp.view(np.uint64)[few]
    for lag in range(1, FEW):
        hit = np.flatnonzero((k[lag:] == k[:-lag]) & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= radius)) if len(k) > lag else np.zeros(0, int)
        a.append(x[hit].view(np.int64))
        b.append(x[hit + lag].view(np.int64))
    for at, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        one, two = forest(fp[at : at + n], radius)
        a.append(one)
        b.append(two)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp: every link lies within a component of them."""
    if radius > RADIUS:
        raise ValueError("the keys are proven for four differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                fp = np.ascontiguousarray(all_fp[at : at + 4096])
                keys, rows = bucket_keys(golay, fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    def rows(a: np.ndarray, b: np.ndarray, part: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), part))], ["a", "b", "part"])

    def meet(batches: Iterator[pa.RecordBatch], large: int | None) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of the buckets of up to `large` members; (part's key, fp) of those of larger ones, which are never held."""
        keys, fp, passed = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(n: int) -> Iterator[pa.RecordBatch]:
            crowded = np.zeros(n, bool)
            if large is not None:
                sizes = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(keys[:n])) + 1, [n])))
                crowded = np.repeat(sizes > large, sizes)
            if crowded.any():
                yield rows(*parts(keys[:n][crowded], fp[:n][crowded]), True)
            if not crowded.all():
                yield rows(*bucket_links(keys[:n][~crowded], fp[:n][~crowded], radius), False)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if passed is not None and len(keys):  # more of a large bucket
                n = int(np.searchsorted(keys, passed, "right"))
                yield rows(*parts(keys[:n], fp[:n]), True)
                keys, fp, passed = keys[n:], fp[n:], None if n < len(keys) else passed
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole:
                yield from out(whole)
                keys, fp = keys[whole:], fp[whole:]
            if large is not None and len(keys) > large:
                yield rows(*parts(keys, fp), True)
                passed, keys, fp = keys[-1], keys[:0], fp[:0]
        if len(keys):
            yield from out(len(keys))

    spread = map_batches(distinct.select("fp"), emit, "key long, fp long")
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)

    def met(members: DataFrame, large: int | None) -> DataFrame:
        buckets = members.select("key", "fp").repartition(n, "key").sortWithinPartitions("key")
        return map_batches(buckets, lambda batches: meet(batches, large), "a long, b long, part boolean")

    first = materialise(met(spread, LARGE), "links")
    found, again = first.filter("not part").select("a", "b"), first.filter("part").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return found if again.isEmpty() else found.unionByName(met(again, None).select("a", "b"))


def classes(marked: DataFrame, id_col: str) -> DataFrame:
    """marked with root (the component's fingerprint) and component_id, the smallest id reachable (null if all ids there are null)."""
    own = materialise(marked.groupBy("fp").agg(F.min(F.col("row")[id_col]).alias("least")), "fingerprints")
    joined = materialise(components(links(own), "a", "b"), "linked")
    rooted = own.join(joined, own.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows and null ids are members of
    their component; a component of null ids alone has a null component_id. An empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, id_col, text_col), "marked")
    return classes(marked, id_col).select(F.col("row")[id_col].alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id, null ids last, ties going by text hash.

    Of rows equal in id and text, that with the least hash over all columns stays. Null and wordless texts are near
    each other; an empty table stays empty. Extra columns, whatever their names, stay as they are.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *key_of(text_of(text_col)))
    marked = materialise(fingerprints(keyed, "_id", "_text", ["_id", "_k1", "_k2"]), "marked")
    return survivors(docs, classes(marked, "_id").select("root", "row"), id_col, text_col)


def survivors(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of rooted (root, row of _id, _k1 and _k2), chosen as near_dedup says."""
    found = rooted.groupBy("root", "row").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("row._id").isNull().alias("absent"), F.col("row._id").alias("id"), F.col("row._k1").alias("k1"), F.col("row._k2").alias("k2"), F.col("n").alias("n"))
    winners = materialise(found.groupBy("root").agg(F.min(order).alias("w")).select("w.*"), "winners")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*named(docs.columns)).alias("row"), *key_of(text_of(text_col)))
    mine = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    kept = rows.join(winners, mine)
    one = kept.filter("n = 1").select("row")
    if winners.filter("n > 1").isEmpty():
        return one.select("row.*")
    many = kept.filter("n > 1").groupBy("id", "k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return one.unionByName(many).select("row.*")
