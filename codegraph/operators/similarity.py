"""Set-similarity joins over shingle sets, with a prefix filter on the references' rare items; no pairs but those that share one.

Items travel as 64-bit hashes. Sets are compared whole, so a hash only matters where two of its few hundred items collide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round2
from .graph import cut_lineage

BROADCAST_ROWS = 500_000  # of two numbers and an id: some tens of megabytes
SLOTS, BITS = 1 << 20, 1 << 28  # of the tables that tell rarity and rule items out: 8 and 32 MB


def hashed(sets: DataFrame, items: str) -> DataFrame:
    """(id, size, hs): each set's items as hashes."""
    return sets.select("id", F.size(items).alias("size"), F.transform(items, lambda x: F.xxhash64(x)).alias("hs"))


def sized(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut, to be broadcast if a count shows that they are few; else the join shuffles."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many items fall in each slot: a table of SLOTS numbers, whatever the input."""
    slot = F.shiftrightunsigned("item", 64 - SLOTS.bit_length() + 1).cast("int").alias("slot")
    found = sets.select(F.explode("hs").alias("item")).groupBy(slot).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def bit_map(items: DataFrame) -> np.ndarray:
    """A map of BITS bits (32 MB), whatever the input, with those of the items set."""
    at = F.pmod("item", F.lit(BITS))
    parts = items.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).toLocalIterator()
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def item_rows(sets: DataFrame, name: str, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(name, name_size, item) of the items of sets (id, size, hs) whose places in a batch `chosen` gives, from all items and where each set's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            items, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            at = chosen(items, ends)
            of = pa.array(np.searchsorted(ends, at, "right"))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(items[at], pa.int64())], [name, f"{name}_size", "item"])

    return sets.select("id", "size", "hs").mapInArrow(run, f"{name} {sets.schema['id'].dataType.simpleString()}, {name}_size int, item long")


def prefix_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """(b, b_size, item): as `prefixes`, with rarity told by slot counts among these sets, so no item is dealt for it."""
    counts = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def rarest(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slots, found, at = (items.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), [np.zeros(0, np.int64)], 0
        for end in ends.tolist():
            n = end - at
            found.append(at + np.argsort(counts.value[slots[at:end]], kind="stable")[: n - math.ceil(n * threshold - 1e-9) + 1])
            at = end
        return np.concatenate(found)

    return item_rows(sets, "b", rarest)


def sifted(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, a_size, item) of the items that are among the wanted ones, and of some others, which a bit map can't tell from them."""
    bits = sets.sparkSession.sparkContext.broadcast(bit_map(wanted))

    def held(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = items % BITS
        return np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    return item_rows(sets, "a", held)


def prefixes(sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(id, size, item): the rarest items of each set, as many as decide: what reaches the threshold with a set holds one of these.

    A set that reaches it holds at least ceil(threshold * n) of the n items, so one of any n - ceil(threshold * n) + 1.
    """
    ranked = sets.select("id", "size", F.explode("hs").alias("item")).join(counts, "item", "left").groupBy("id", "size")
    order = ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))).alias("order"))
    return order.select("id", "size", F.explode(F.slice("order", 1, F.col("size") - least_shared(F.col("size"), threshold) + 1)).alias("o")).select("id", "size", "o.item")


def least_shared(size: Column, threshold: float) -> Column:
    """How many of a set's items a set must hold to reach the threshold with it."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def overlaps(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, a_size, b, b_size, shared) of pairs of sets (id, items) that share an item and may reach threshold.

    Sizes that differ by more than the threshold's factor can't reach it, so they never meet. With a threshold only the
    rarest items of the right sets meet the left ones, so an item that nearly all sets hold makes no pairs. How many of
    those a pair shares bounds what it can share in all; pairs that may still reach the threshold are compared as
    wholes. With threshold 0 every shared item counts, and all items meet. The right sets are the fewer ones: only they
    are ranked. While their items are few, the left ones are not dealt, else those alone that a bit map doesn't rule out.
    Ids travel with items: numbers are best. Both sides are read more than once: cut their lineage where they are dear.
    """
    a, b = hashed(left, "items"), hashed(right, "items")
    one = a.select(F.col("id").alias("a"), F.col("size").alias("a_size"), F.explode("hs").alias("item"))
    if threshold <= 0:
        two = b.select(F.col("id").alias("b"), F.col("size").alias("b_size"), F.explode("hs").alias("item"))
        return one.join(two, "item").groupBy("a", "a_size", "b", "b_size").agg(F.count(F.lit(1)).alias("shared"))
    if (b.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_ROWS:
        asked = F.broadcast(cut_lineage(b.select(F.explode("hs").alias("item")).distinct()))
        counts = one.select("item").join(asked, "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        two = F.broadcast(cut_lineage(prefixes(b, counts, threshold).select(F.col("id").alias("b"), F.col("size").alias("b_size"), "item")))
    else:
        two = prefix_rows(b, threshold)
        one = sifted(a, two)
        two = two.hint("merge")
    pairs = sized(near(one, two, threshold))
    # while the pairs are few, the sets that none of them has stay where they are
    sides = [x.select(F.col("id").alias(n), F.col("hs").alias(f"{n}_hs")).join(pairs.select(n), n, "left_semi") for x, n in ((a, "a"), (b, "b"))]
    whole = pairs.join(sides[0], "a").join(sides[1], "b")
    return whole.select("a", "a_size", "b", "b_size", F.size(F.array_intersect("a_hs", "b_hs")).cast("long").alias("shared"))


def near(one: DataFrame, two: DataFrame, threshold: float) -> DataFrame:
    """(a, a_size, b, b_size) of pairs of one (a, a_size, item) and two (b, b_size, item: prefixes) that may reach threshold.

    Beyond the items of b's prefix that a holds it can hold the rest of b at most, and the pair needs
    threshold / (1 + threshold) of both sizes in common.
    """
    fits = (F.col("a_size") >= threshold * F.col("b_size")) & (F.col("b_size") >= threshold * F.col("a_size"))
    met = one.join(two, "item").filter(fits).groupBy("a", "a_size", "b", "b_size").agg(F.count(F.lit(1)).alias("n"))
    most = F.col("n") + least_shared(F.col("b_size"), threshold) - 1
    needed = (F.col("a_size") + F.col("b_size")) * (threshold / (1 + threshold))
    return met.filter(most >= needed - 1e-6).select("a", "a_size", "b", "b_size")


def score() -> Column:
    return F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))


def best_matches(functions: DataFrame, references: DataFrame, threshold: float) -> DataFrame:
    """(a, score, ref) of every function (id, shingles) that reaches threshold with a reference (id, name, ref_ord, shingles): its best one.

    Similarity is Jaccard; of equally similar references that with the lowest ref_ord counts.
    """
    items = F.col("shingles").alias("items")
    pairs = overlaps(functions.select("id", items), references.select("id", items), threshold)
    named = pairs.withColumn("score", score()).filter(F.col("score") >= threshold).join(references.select(F.col("id").alias("b"), F.col("name").alias("ref"), "ref_ord"), "b")
    return named.groupBy("a").agg(F.max_by(F.struct("score", "ref"), F.struct("score", -F.col("ref_ord"))).alias("m")).select("a", "m.*")


def best_reference(functions: DataFrame, references: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Functions most like any reference: (file, name, line, score, resembles), best first.

    functions and references: id, file, name, line, shingles; references also ref_ord, the lowest of which wins ties.
    Functions in reference files are left out first. Similarity is Jaccard, compared before rounding; with threshold 0
    functions that resemble nothing are listed with score 0 and empty resembles.
    """
    if not 0 <= threshold <= 1 or not 1 <= limit <= 50:
        raise ValueError("threshold lies in 0..1 and limit in 1..50")
    # the references' files are few or counted: while few, the functions stay where they are, however many share a file
    others = functions.join(sized(references.select("file").distinct()), "file", "left_anti")
    named = references.select("id", "shingles", "ref_ord", F.concat_ws("#", "file", "name").alias("name"))
    best = best_matches(others.select("id", "shingles"), named, threshold)
    own = others.select("id", "file", "name", "line").join(best, F.col("id") == F.col("a"), "left" if threshold == 0 else "inner")
    rounded = round2(F.coalesce(best["score"], F.lit(0.0))).alias("score")
    return own.select("file", "name", "line", rounded, F.coalesce("ref", F.lit("")).alias("resembles")).orderBy(F.desc("score"), "file", "line").limit(limit)


def flag_violations(candidates: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """candidates with `violates`: whether the file lies outside the invariant's files; null without an invariant."""
    if allowed is None:
        return candidates.withColumn("violates", F.lit(None).cast("boolean"))
    marked = allowed.select("file").distinct().withColumn("_in", F.lit(True))
    return candidates.join(marked, "file", "left").withColumn("violates", F.col("_in").isNull()).drop("_in")
