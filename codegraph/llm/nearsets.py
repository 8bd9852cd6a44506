"""Near duplicates by Jaccard similarity of word 5-gram sets: every pair at or above 0.8 lies within a component.

Pairs are looked for twice. First by SimHash: fingerprints of the 5-grams within four bits meet under Golay-code keys
(`simhash.links`), and those that pass the exact comparison link their sets. Four bits reach the closest copies only, so
what is similar but further apart is then found by a prefix join.

Two sets with similarity 0.8 or more share an item among the first |A| - ceil(0.8 |A|) + 1 items of each, whatever the
common order of items (the prefix filter). Items of frequent slots of a counted table come last in that order, so
common passages rarely make candidates; the counts only order and never leave anything out.

Candidates are first compared by parity sketches: a bit for each class of items tells whether the set has an odd number
of them. Where two sketches differ an item stands in one set alone, so their distance bounds the sets' difference from
below, and no similar pair is lost. With about as many bits as items (two hundredths of the set's bytes) nearly all
others are. The rest are compared on their whole sets.

A bucket of a few members gives all its pairs. A larger one first gives stars around two members in turn. Then its
members' sketches meet there, of those that are not in one component yet, and a pair that passes is given once, in the
first bucket that has both. So no bucket gives all its pairs, and the components are what all pairs would give. Buckets
of more than CROWD members are cut into parts by hash, and each two parts meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .components import components
from .shared import delete, key_of, map_batches, materialise, text_of, work_path
from .simhash import links, majority, shingle_hashes, survivors

WORDS = 5
SIMILAR = (4, 5)  # 0.8, as a fraction of integers so that no rounding decides
SLOTS, PARTS = 1 << 20, 16  # of the table of item counts, and the pieces in which it is added up
BITS = 1 << 26  # of the map of candidate nodes
FEW = 8  # buckets up to this size give all their pairs at once
CROWD = 4096  # members of a large bucket in one part; each two parts meet in a task of their own


def items_and_print(utf8: bytes) -> tuple[np.ndarray, int]:
    """item_set, and the SimHash fingerprint of the same 5-grams, repeats included."""
    hashes = shingle_hashes(utf8.lower().split(), WORDS)
    return np.unique(np.array(hashes, np.uint64)), majority(hashes)


def item_set(utf8: bytes) -> np.ndarray:
    """Sorted hashes of the distinct word 5-grams; a text of fewer words is one item, one without words is empty."""
    return np.unique(np.array(shingle_hashes(utf8.lower().split(), WORDS), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard similarity SIMILAR or more."""
    over, under = SIMILAR
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * under >= (len(both) - shared) * over


def sketch(items: np.ndarray) -> bytes:
    """Parities of the numbers of items in 2^k classes by their low bits, at least as many classes as items."""
    bits = 1 << max(6, (len(items) - 1).bit_length())
    return np.packbits(np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_be_similar(x: bytes, a: int, y: bytes, b: int) -> bool:
    """Whether sets of a and b items with these sketches can have similarity SIMILAR or more."""
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    over, under = SIMILAR
    return int(np.bitwise_count(one ^ two).sum()) * (under + over) <= (a + b) * (under - over)


def prefix(n: int) -> int:
    over, under = SIMILAR
    return n - -(-n * over // under) + 1 if n else 0


def sets(docs: DataFrame) -> DataFrame:
    """row (_id, _k1, _k2), node (a hash of the set), fp (the fingerprint), size, items and sketch of columns _id, _text, _k1 and _k2; a task gives items and sketch of a node once, then null."""
    source = docs.select(text_of("_text").alias("text"), F.struct("_id", "_k1", "_k2").alias("row"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            both = [items_and_print(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            found = [x for x, _ in both]
            digests = [xxhash.xxh64_intdigest(x.tobytes()) for x in found]
            once = [None if n in seen or seen.add(n) else x for n, x in zip(digests, found, strict=True)]
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digests, [fp for _, fp in both])]
            columns.append(pa.array([len(x) for x in found], pa.int32()))
            columns += [pa.array([None if x is None else f(x) for x in once], pa.binary()) for f in (np.ndarray.tobytes, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["row", "node", "fp", "size", "items", "sketch"])

    fields = [StructField("node", LongType()), StructField("fp", LongType()), StructField("size", IntegerType()), StructField("items", BinaryType()), StructField("sketch", BinaryType())]
    return map_batches(source, scan, StructType([source.schema["row"], *fields]))


def _slot(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def slot_counts(marked: DataFrame) -> np.ndarray:
    """How many items fall in each slot: a table of SLOTS numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            total += np.bincount(_slot(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=SLOTS).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in np.split(total, PARTS)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    each = map_batches(marked.select("items").filter("items is not null"), count, schema)
    # the tasks' tables are added up in two turns, so that none reads a row of every task
    salts = math.isqrt(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    salted = each.withColumn("salt", F.spark_partition_id() % salts).repartition(PARTS * salts, "part", "salt").select("part", "counts")
    some = map_batches(salted, add, schema)
    out = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for part, counts in map_batches(some.repartition(PARTS, "part"), add, schema).collect():
        out[part] = np.frombuffer(counts, np.int64)
    return out.reshape(-1).astype(np.uint32)


def postings(marked: DataFrame) -> DataFrame:
    """(token, node, size): the prefix of each set under the order by slot count and hash."""
    shared = marked.sparkSession.sparkContext.broadcast(slot_counts(marked))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            tokens, sizes = [np.zeros(0, np.uint64)], []
            for raw in batch.column(1).to_pylist():
                items = np.frombuffer(raw, np.uint64)
                tokens.append(items[np.argsort(counts[_slot(items)], kind="stable")[: prefix(len(items))]])
                sizes.append(len(items))
            each = [len(t) for t in tokens[1:]]
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(nodes), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["token", "node", "size"]
            )

    return map_batches(marked.select("node", "items").filter("items is not null"), emit, "token long, node long, size int")


# ---- candidates


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).astype(np.int64) * SIMILAR[1] >= np.maximum(a, b).astype(np.int64) * SIMILAR[0]


def few_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within buckets of up to FEW members that may be linked."""
    for lag in range(1, FEW):
        if len(token) > lag:
            at = np.flatnonzero((token[lag:] == token[:-lag]) & _fits(size[lag:], size[:-lag]))
            yield np.minimum(node[at], node[at + lag]), np.maximum(node[at], node[at + lag])


def star(node: np.ndarray, size: np.ndarray, root: np.ndarray, pivot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's member that may be linked and aren't in one component."""
    at = np.flatnonzero(_fits(size, size[pivot]) & (root != root[pivot]))
    if len(at):
        yield np.minimum(node[at], node[pivot]), np.maximum(node[at], node[pivot])


def crowd(size: np.ndarray, root: np.ndarray, second: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, members): pairs in different components whose sketches allow that they are similar; where some are of the second part, those between the parts."""
    within = not second.any()
    over, under = SIMILAR
    widths = np.array([len(x) for x in sketches])
    groups = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    tables = {w: np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), w // 8) for w, at in groups.items()}
    for w, at in groups.items():
        for k, i in enumerate(at.tolist()):
            own = tables[w][k]
            # sizes that fit lie within a factor that makes sketches equally long, or one twice as long as the other
            for others, table, mine in ((at[k + 1 :], tables[w][k + 1 :], own), *(((groups[w // 2], tables[w // 2], own[: len(own) // 2] ^ own[len(own) // 2 :]),) if w // 2 in groups else ())):
                left = np.flatnonzero(_fits(size[others], size[i]) & (root[others] != root[i]) & (within | (second[others] != second[i])))
                if len(left):
                    apart = np.bitwise_count(table[left] ^ mine).sum(1, dtype=np.int64)
                    left = left[apart * (under + over) <= (size[others[left]].astype(np.int64) + int(size[i])) * (under - over)]
                    if len(left):
                        yield i, others[left]


def crowd_parts(posts: DataFrame) -> DataFrame:
    """posts with their bucket cut into parts of about CROWD members: a row for each part that a member's own meets, i <= j, and whether its own is the second."""
    counts = posts.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("other")
    met = posts.join(counts, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(*posts.columns, F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), (F.col("own") > other).alias("second"))


def crowd_pairs(posts: DataFrame) -> DataFrame:
    """(a, b): pairs of large buckets, of posts (token, node, size, root, sketch, tokens), each in the bucket of the first token that both have in `tokens`."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def key(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
            return np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("token", "i", "j")])

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = key(table)
            token, node, size, root = (table.column(x).to_numpy() for x in ("token", "node", "size", "root"))
            second = table.column("second").to_numpy().astype(bool)
            sketches, lists = (table.column(x).to_pylist() for x in ("sketch", "tokens"))
            starts = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0).any(0)) + 1)).tolist()
            a: list[int] = []
            b: list[int] = []
            for at, end in zip(starts, [*starts[1:], len(token)], strict=True):
                own = int(token[at])
                sets = [set(x) for x in lists[at:end]]
                for i, others in crowd(size[at:end], root[at:end], second[at:end], sketches[at:end]):
                    for j in others.tolist():
                        if min(sets[i] & sets[j]) == own:
                            a.append(int(min(node[at + i], node[at + j])))
                            b.append(int(max(node[at + i], node[at + j])))
                    if len(a) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                        a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if batch.num_rows:
                keys = key(batch)
                before = np.flatnonzero((keys != keys[:, -1:]).any(0))  # the last bucket may go on
                cut = int(before[-1]) + 1 if len(before) else 0
                if cut or (len(held) > 1 and held[-2].num_rows and (key(held[-2])[:, -1] != keys[:, 0]).any()):
                    held[-1] = batch.slice(0, cut)
                    yield from whole(pa.Table.from_batches(held).combine_chunks())
                    held = [batch.slice(cut)]
        if sum(x.num_rows for x in held):
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    n = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    columns = ("token", "i", "j", "node", "size", "root", "second", "sketch", "tokens")
    buckets = crowd_parts(posts).select(*columns).repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return map_batches(buckets, meet, "a long, b long")


def candidates(posts: DataFrame, step: int) -> DataFrame:
    """(a, b, size) of posts (token, node, size, root): pairs a, b where size is null, else the posting (token a, node b) of a large bucket.

    Step 0 gives all pairs of small buckets, and stars and postings of large ones; step 1 other stars.
    """
    schema = "a long, b long, size int"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        s: list[np.ndarray] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, a)) >= least and a:
                size, one, two = np.concatenate(s), np.concatenate(a), np.concatenate(b)
                pair = size < 0
                distinct = np.unique(np.stack([one[pair], two[pair]], 1), axis=0)
                size = np.concatenate([np.full(len(distinct), -1, np.int32), size[~pair]])
                columns = [np.concatenate([x, y[~pair]]) for x, y in ((distinct[:, 0], one), (distinct[:, 1], two))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(size, pa.int32(), mask=size < 0)], ["a", "b", "size"])
                for x in (a, b, s):
                    x.clear()

        def put(one: np.ndarray, two: np.ndarray, size: np.ndarray | None = None) -> None:
            a.append(one)
            b.append(two)
            s.append(np.full(len(one), -1, np.int32) if size is None else size.astype(np.int32))

        def whole(token: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate(([True], (np.diff(token) != 0) | (np.diff(node) != 0)))  # copies from several tasks
            token, node, size, root = (x[new] for x in (token, node, size, root))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1))
            sizes = np.diff(np.concatenate((starts, [len(token)])))
            least = 1
            if step == 0:
                least, few = FEW, np.repeat((sizes > 1) & (sizes <= FEW), sizes)
                for pair in few_pairs(token[few], node[few], size[few]):
                    put(*pair)
                yield from flush(1 << 16)
            for at, n in zip(starts[sizes > least].tolist(), sizes[sizes > least].tolist(), strict=True):
                part = slice(at, at + n)
                for pair in star(node[part], size[part], root[part], (0, n - 1)[step]):
                    put(*pair)
                    yield from flush(1 << 16)
                if step == 0:
                    put(token[part], node[part], size[part])

        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns, strict=True)]
            n = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if n:
                yield from whole(*(x[:n] for x in held))
                held = [x[n:] for x in held]
        if len(held[0]):
            yield from whole(*held)
        yield from flush(0)

    n = max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    buckets = posts.select("token", "node", "size", "root").repartition(n, "token").sortWithinPartitions("token", "node")
    return map_batches(buckets, meet, schema)


def maybe(marked: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, items) of the nodes in ends and of few others, found by a bit map of BITS bits (eight megabytes): the sets of the others needn't be dealt."""
    at = F.pmod("node", F.lit(BITS))
    parts = ends.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros((BITS // 8 // 4096, 4096), np.uint8)
    for r in parts:
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = marked.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) % BITS
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return map_batches(marked.select("node", "items").filter("items is not null"), sift, "node long, items binary")


def near(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow that they are similar."""
    known = marked.filter("sketch is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    left = pairs.join(known.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "m", "y", "n")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = [may_be_similar(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(sound, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return materialise(map_batches(both, check, "a long, b long"), "near")


def verified(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    known = maybe(marked, ends).groupBy("node").agg(F.first("items").alias("items"))  # dealt by node once, for both joins
    left = pairs.join(known.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(sound, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return materialise(map_batches(both, check, "a long, b long"), "similar")


def keyed_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by Golay keys: each with the first of its fingerprint, and the firsts of linked ones."""
    known = marked.select("fp", "node").distinct()
    own = materialise(known.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    far = materialise(links(own), "fingerprint-links")
    ends = [own.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_node")) for n in ("a", "b")]
    between = far.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    within = known.join(own, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(within).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(marked: DataFrame) -> DataFrame:
    """(node, root) for every node with a similar other one, but for roots themselves."""
    keyed = verified(near(keyed_pairs(marked), marked), marked)
    posts = postings(marked).withColumn("root", F.col("node"))
    first = materialise(candidates(posts, 0), "candidates")
    pairs = materialise(first.filter("size is null").select("a", "b").distinct(), "pairs")
    linked = verified(near(pairs.join(keyed, ["a", "b"], "left_anti"), marked), marked).unionByName(keyed)
    found = materialise(components(linked, "a", "b"), "linked")
    large = first.filter("size is not null").select(F.col("a").alias("token"), F.col("b").alias("node"), "size")
    if large.isEmpty():
        return found
    for step in (1, 2):
        posts = large.join(found, "node", "left").select("token", "node", "size", F.coalesce("root", "node").alias("root"))
        if step == 1:
            more = candidates(posts, step).select("a", "b").distinct()
            pairs = near(more.join(pairs, ["a", "b"], "left_anti"), marked)
        else:
            known = marked.filter("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"))
            tokens = large.groupBy("node").agg(F.collect_set("token").alias("tokens"))  # at most a set's prefix
            pairs = materialise(crowd_pairs(posts.join(tokens, "node").join(known, "node")).distinct(), "pairs")
        if pairs.isEmpty():
            continue
        linked = verified(pairs, marked).unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = materialise(components(linked, "a", "b"), "linked")
    return found


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar texts, with all its columns, chosen as near_dedup chooses.

    Texts are linked where their sets of word 5-grams have Jaccard similarity 0.8 or more. Null and wordless texts have
    the empty set and are one component; an empty table stays empty. Items and sets stand for themselves by 64-bit
    hashes. Extra columns, whatever their names, stay as they are.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *key_of(text_of(text_col)))
    spark, path = docs.sparkSession, work_path(docs.sparkSession, "sets")
    made = sets(keyed)
    made.write.parquet(path)
    marked = spark.read.schema(made.schema).parquet(path)
    rows = materialise(marked.select("row", "node"), "nodes")
    found = joined(marked)
    delete(spark, path)  # the largest table; what follows needs the nodes only
    rooted = rows.join(found, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    return survivors(docs, rooted, id_col, text_col)
