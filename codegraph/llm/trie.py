"""A prefix trie over conversations: what they share from the first turn on, and what that sharing saves.

1. Turns are placed in their conversation: rows are sorted by range, counted in each part and moved by the parts before,
   so a conversation with most of the rows is spread over many tasks. A prefix is named by the exclusive or of the
   hashes of its placed turns (128 bits), which is added up the same way, in stretches of STRETCH turns.
2. Every task combines the prefixes of its own rows into a partial table of nodes; tables are merged by hash of the node
   in FANS turns of ever fewer salts. Member counts add up; end lists are pieces of PIECE ids of one range, so none grows
   with the number of members, and their hash is taken piece by piece in order.
3. Nodes with the same members form a chain, named by (smallest member, member count). Chains are rolled up from the
   bottom, one round for every depth at which chains begin; a prefix of a single conversation takes no round at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialise, text_of

FANS = (64, 8, 1)  # salts of a node in each turn of merging
PIECE = 16  # low bits of an id that one piece of an end list holds: 65,536 ids at most
STRETCH = 4096
NODE = ["k1", "k2", "depth"]
CHAIN = ["conv_id", "n_convs"]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place(turns: DataFrame) -> DataFrame:
    """(conv, role, text, at): each turn's place in its conversation, from 0: by turn (null first), then role and text."""
    n = _tasks(turns)
    sorted_ = materialise(turns.repartitionByRange(n, "conv", "turn", "role", "text").withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    parts = sorted_.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = sorted_.withColumn("here", F.row_number().over(inside) - 1)
    return local.join(before.select("conv", "part", "before"), ["conv", "part"]).select("conv", "role", "text", (F.col("here") + F.col("before")).alias("at"))


def _running(df: DataFrame, group: list[str], at: str, total: dict[str, Column], add) -> DataFrame:
    """df with, per name, the running total of a column over the rows of a group up to and with its own, by `at` from 0 on.

    A group is summed in stretches and then over its stretches, so no task needs a long group whole.
    """
    cut = df.withColumn("_cut", F.floor(F.col(at) / STRETCH))
    for name, column in total.items():
        cut = cut.withColumn(name, column)
    inside = Window.partitionBy(*group, "_cut").orderBy(at)
    names = list(total)
    local = cut.select("*", *[add(n).over(inside).alias(f"_in_{n}") for n in names])
    sums = cut.groupBy(*group, "_cut").agg(*[add(n).alias(n) for n in names])
    earlier = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "_cut", *[F.coalesce(add(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    both = local.drop(*names).join(before, [*group, "_cut"])
    return both.select(*df.columns, *[F.expr(f"_in_{n} {'^' if add is F.bit_xor else '+'} _before_{n}").alias(n) for n in names])


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed turns (conv, at, role, text) and lengths (conv, n) of the rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % 100, where h is the crc32 of c's decimals modulo
    6, and goes on with its own turns after its first h. Rows without a conv_id belong to none and are left out.
    """
    bare = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text")
    )
    placed = materialise(place(bare), "placed")
    own = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    plan = own.select("conv", "own", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string")) % 6).alias("h"))
    bases = own.filter("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = plan.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = materialise(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "plan")
    heads = placed.filter("conv % 100 = 0 and at < 6").withColumnRenamed("conv", "base")
    first = plan.filter("taken > 0").join(heads, "base").filter("at < taken").select("conv", "at", "role", "text")
    rest = placed.join(plan.select("conv", "h", "taken"), "conv").filter("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "role", "text")
    return first.unionByName(rest), plan.select("conv", "n")


def _merge(rows: DataFrame, key: list[str], total: list[Column], again: list[Column]) -> DataFrame:
    """Partial tables of a task's own rows, merged by key in turns of ever fewer salts."""
    salted = rows.withColumn("_salt", F.spark_partition_id())
    for i, fan in enumerate(FANS):
        salted = salted.groupBy(*key, (F.col("_salt") % fan).alias("_salt")).agg(*(again if i else total))
    return salted.drop("_salt")


def partial_tries(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged table of nodes (k1, k2, depth, p1, p2, conv_id, n_convs, chars) and that of their end pieces (k1, k2, depth, piece, ends)."""
    hashed = turns.select("conv", "at", F.xxhash64("at", "role", "text").alias("t1"), F.xxhash64(F.lit(1), "at", "role", "text").alias("t2"), F.length("text").cast("long").alias("chars"))
    keyed = _running(hashed, ["conv"], "at", {"k1": F.col("t1"), "k2": F.col("t2")}, F.bit_xor)
    below = keyed.select("conv", "k1", "k2", (F.col("at") + 1).alias("depth"), F.expr("k1 ^ t1").alias("p1"), F.expr("k2 ^ t2").alias("p2"), "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.select("conv", zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    members = materialise(below.unionByName(root), "members")
    same = [F.first(x).alias(x) for x in ("p1", "p2", "chars")]  # equal in all rows of a node
    nodes = _merge(members, NODE, [F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *same], [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *same])
    last = members.join(lengths.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select(*NODE, "conv", F.shiftright("conv", PIECE).alias("piece"))
    ends = _merge(last, [*NODE, "piece"], [F.collect_list("conv").alias("ends")], [F.flatten(F.collect_list("ends")).alias("ends")])
    return materialise(nodes, "nodes"), ends


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, depth, piece, ids) in order -> a hash per node, of its pieces joined by commas."""
    names = [*NODE, "ends_sha256"]
    now, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if node == now:
                digest.update(b",")
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of nodes at which conversations end; a task holds one piece at a time."""
    joined = F.array_join(F.transform(F.array_sort("ends"), lambda x: x.cast("string")), ",").alias("ids")
    dealt = ends.select(*NODE, "piece", joined).repartition(_tasks(ends), *NODE).sortWithinPartitions(*NODE, "piece")
    return map_batches(dealt, _hash_pieces, "k1 long, k2 long, depth long, ends_sha256 string")


def roll_up(nodes: DataFrame) -> DataFrame:
    """Chains of shared nodes with what hangs below them: conv_id, n_convs, leaves, saved (without the chain's own).

    nodes: conv_id, depth, n_convs, n_children, chars, parent_conv_id, parent_n.
    """
    spark = nodes.sparkSession
    up = [F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")]
    one = nodes.filter("n_convs = 1 and (parent_n > 1)").groupBy(*up).agg(F.count(F.lit(1)).alias("leaves")).withColumn("saved", F.lit(0).cast("long"))
    shared = nodes.filter("n_convs > 1")
    chains = shared.groupBy(*CHAIN).agg(
        F.min("depth").alias("top"),
        F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("parent"),
        F.max_by("n_children", "depth").alias("below"),
        F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("own"),
    )
    chains = materialise(chains.select(*CHAIN, "top", "parent.*", "below", "own"), "chains")
    tops = chains.select(*CHAIN, "top")
    over = tops.select(F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.col("top").alias("parent_top"))
    chains = materialise(chains.join(over, ["parent_conv_id", "parent_n"], "left"), "chains")
    given = [materialise(one.join(tops, CHAIN), "given")]  # what chains get from below, each with the depth where it is due
    done: list[DataFrame] = []
    for top in sorted((r.top for r in tops.select("top").distinct().collect()), reverse=True):  # one small number a depth
        due = given[0]
        for more in given[1:]:
            due = due.unionByName(more)
        sums = due.filter(F.col("top") == top).groupBy(*CHAIN).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        here = chains.filter(F.col("top") == top).join(sums, CHAIN, "left")
        leaves = F.coalesce("leaves", F.lit(0)) + F.when(F.col("below") == 0, 1).otherwise(0)
        done.append(materialise(here.select(*CHAIN, "own", "parent_conv_id", "parent_n", "parent_top", leaves.alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")), "rolled"))
        up_rows = done[-1].filter("parent_top is not null")
        given.append(up_rows.groupBy(*up, F.col("parent_top").alias("top")).agg(F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + F.col("own")).alias("saved")))
    if not done:
        return spark.createDataFrame([], "conv_id long, n_convs long, leaves long, saved long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*CHAIN, "leaves", "saved")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of a trie over placed turns (conv, at, role, text) of conversations of known lengths (conv, n).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. conv_id and depth together name a node. Role and text are never null here (rebuild() takes null as
    empty); ids are integers, each with one row in lengths. A conversation without turns ends at the root. No
    conversations give no rows, not even a root. Rows repeated in full are turns of their own, one after the other.
    """
    nodes, ends = partial_tries(turns, lengths)
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    children = nodes.filter("depth > 0").groupBy("p1", "p2", (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(above, ["p1", "p2", "depth"], "left").select(*NODE, "conv_id", "n_convs", "chars", "parent_conv_id", "parent_n")
    known = known.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "depth", "n_children"), NODE, "left")
    known = known.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = materialise(known.join(end_hashes(ends), NODE, "left").drop("k1", "k2"), "known")
    rolled = roll_up(known)
    # saved below a node of a chain: what hangs below the chain, and the chain's own from its last node up to this one
    shared = known.filter("n_convs > 1")
    own = _running(shared.select(*CHAIN, "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own")), CHAIN, "depth", {"upto": F.col("own")}, F.sum)
    whole = shared.groupBy(*CHAIN).agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("whole")).join(rolled, CHAIN)
    sums = own.join(whole, CHAIN).select("conv_id", "depth", "leaves", (F.col("saved") + F.col("whole") - F.col("upto") + F.col("own")).alias("saved"))
    return known.join(sums, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
