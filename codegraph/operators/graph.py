"""Graph operators over edge tables (src, dst): degrees, neighbourhoods, closures, cycles.

Loops run on the driver, one DataFrame round each; every round is written to the session's checkpoint folder, so plans
stay short and a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STEPS = 3  # of colours to neighbours between checkpoints


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir, or in a temporary folder where none is set and all runs in one process.

    What is joined with it is merged, not broadcast: the planner takes a checkpoint for as large as it guessed the plan
    before it to be, by default widths of texts and arrays, and so would send tables through the driver that grow with
    the input. F.broadcast around the result still counts. What is joined or united loses this: see merged.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="codegraph-"))
    return df.checkpoint().hint("merge")


def merged(df: DataFrame) -> DataFrame:
    """df, to be merged in the join it goes into. For a join neither side of which comes from a checkpoint by selections
    and aggregates alone: unions and joins keep no hint, but their parts' small guesses."""
    return df.hint("merge")


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree and out_degree over distinct edges: one aggregation over each edge's two ends, no join."""
    flat = edges.select("src", "dst").distinct()
    ends = flat.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def hubs(edges: DataFrame) -> DataFrame:
    """Degrees, most depended-on first."""
    return degrees(edges).orderBy(F.desc("in_degree"), "id")


def neighborhood(edges: DataFrame, focus: DataFrame, depth: int = 1) -> DataFrame:
    """Distinct edges within depth hops of the focus ids (column id), both ways."""
    if not 1 <= depth <= 2:
        raise ValueError("depth is 1 or 2")
    flat = edges.select("src", "dst").distinct()
    seen, found = focus.select("id").distinct(), None
    for _ in range(depth):
        ids = seen.select("id")
        out = flat.join(ids, flat.src == ids.id, "left_semi")
        into = flat.join(ids, flat.dst == ids.id, "left_semi")
        found = out.unionByName(into).distinct()
        seen = found.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(ids).distinct()
    return found


def closure(edges: DataFrame, start: DataFrame, depth: int, nodes: int | None = None) -> DataFrame:
    """(id, depth): ids reachable from start (column id) within depth hops, each at its least depth.

    With nodes, the search stops at the first level at which that many ids were reached; the level itself is kept whole.
    """
    flat = edges.select("src", "dst").distinct()
    seen = cut_lineage(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        ids = frontier.select(F.col("id").alias("at"))
        step = flat.join(ids, flat.src == ids.at).select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if nodes is not None and seen.count() >= nodes:
            break
    return seen


def trim(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: ids without incoming or outgoing edges go, round by round."""
    now = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    count = now.count()
    while count:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        now = cut_lineage(kept.select("src", "dst"))
        left = now.count()
        if left == count:
            break
        count = left
    return now


def cycles(edges: DataFrame) -> DataFrame:
    """(group_id, id): groups of ids that reach each other, named by their least id; ids on no cycle are absent.

    Forward-backward colouring: each round spreads the least id forward to a fixed point, then collects, for every colour,
    the ids of that colour that reach the colour's own id. Those are strongly connected and go; the rest repeats. Work is
    linear in the edges per round, and no table of pairs is built. Each round takes out a group at least, so it ends. A
    self-loop alone is no group.
    """
    left = trim(edges)
    found = None
    while not left.isEmpty():
        ids = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        color = cut_lineage(ids.withColumn("c", F.col("id")))
        while True:
            new = color
            for _ in range(STEPS):
                new = left.join(new, left.src == new.id).select(F.col("dst").alias("id"), "c").unionByName(new).groupBy("id").agg(F.min("c").alias("c"))
            new = cut_lineage(new)
            moved = not new.join(color, ["id", "c"], "left_anti").isEmpty()
            color = new
            if not moved:
                break
        a, b = color.select(F.col("id").alias("src"), F.col("c").alias("cs")), color.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = cut_lineage(left.join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        reached = cut_lineage(inside.select(F.col("c").alias("id"), "c").distinct())
        frontier = reached
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = cut_lineage(back.join(reached, ["id", "c"], "left_anti"))
            reached = cut_lineage(reached.unionByName(frontier))
        size = reached.groupBy("c").count().filter("count > 1").select("c")
        groups = reached.join(size, "c").groupBy("c", "id").agg(F.lit(1).alias("_")).select(F.col("c").alias("group_id"), "id")
        found = groups if found is None else found.unionByName(groups)
        gone = reached.select("id")
        rest = inside.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = trim(rest)
    if found is None:
        return edges.select(F.col("src").alias("group_id"), F.col("src").alias("id")).limit(0)
    # the colour of a group is the least id that reaches it, which may lie outside; name groups by their own least id
    own = found.groupBy("group_id").agg(F.min("id").alias("least"))
    return found.join(own, "group_id").select(F.col("least").alias("group_id"), "id")


def rollup(reached: DataFrame, counters: DataFrame, names: list[str]) -> DataFrame:
    """Sums of counters over distinct reached ids (one row)."""
    own = counters.dropDuplicates(["id"]).join(reached.select("id").distinct(), "id", "left_semi")
    return own.agg(F.count(F.lit(1)).alias("functions"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
