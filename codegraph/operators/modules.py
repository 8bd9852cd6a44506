"""Module resolution and importers, as joins of ordered candidates with the file list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dirname, normalize

# Extensions tried in this order.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx"]


def bare_name(base: Column) -> Column:
    return F.regexp_replace(base, r"\.[cm]?jsx?\z", "")


def names_of(path: Column) -> Column:
    """What a file can be imported as, an array of (key, exact, prio): its own path; its path without a script extension; an index file's folder.

    prio tells the order in which a specifier tries them: the path itself, the extensions in order, then those of the index.
    """
    ends = [path.endswith(e) for e in EXTENSIONS]
    rank, stem = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (hit, e) in reversed(list(enumerate(zip(ends, EXTENSIONS, strict=True), 1))):
        rank = F.when(hit, F.lit(i)).otherwise(rank)
        stem = F.when(hit, F.expr(f"substring(path, 1, length(path) - {len(e)})")).otherwise(stem)
    folder = F.when(stem == "index", F.lit("")).when(stem.endswith("/index"), F.regexp_replace(stem, r"/index\z", ""))
    name = lambda key, exact, prio: F.struct(key.alias("key"), F.lit(exact).alias("exact"), prio.cast("int").alias("prio"))
    return F.filter(F.array(name(path, True, F.lit(0)), name(stem, False, rank), name(folder, False, rank + len(EXTENSIONS))), lambda x: x["key"].isNotNull())


def bases(edges: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """edges with `bases`, the paths (no extension yet) each specifier may mean, in order; null for a module outside.

    Relative specifiers give one. Otherwise the first alias in configuration order that matches gives its targets; the
    alias table is configuration, bounded by one file, so it goes to every edge as one array.
    """
    relative = F.col("specifier").startswith(".")
    near = F.when(relative, F.array(normalize(F.concat(dirname(F.col("file")), F.lit("/"), F.col("specifier")))))
    if aliases is None:
        return edges.select("*", near.alias("bases"))
    one = aliases.agg(F.array_sort(F.collect_list(F.struct("alias_ord", "prefix", "wildcard", "targets"))).alias("_aliases"))
    match = lambda a: F.when(a["wildcard"], F.col("specifier").startswith(a["prefix"])).otherwise(F.col("specifier") == a["prefix"])
    first = edges.crossJoin(F.broadcast(one)).select(*edges.columns, F.explode(F.array(F.get(F.filter("_aliases", match), F.lit(0)))).alias("_a"))
    tail = F.substring("specifier", F.length("_a.prefix") + 1, F.length("specifier"))

    def filled(target: Column) -> Column:
        star = F.locate("*", target)
        whole = F.concat(F.substring(target, F.lit(1), star - 1), tail, F.substring(target, star + 1, F.length(target)))
        return normalize(F.when(F.col("_a.wildcard") & (star > 0), whole).otherwise(target))

    return first.select(*edges.columns, F.when(relative, F.get(near, F.lit(0))).alias("_near"), F.transform("_a.targets", filled).alias("_far")).select(
        *edges.columns, F.when(relative, F.array("_near")).otherwise(F.col("_far")).alias("bases")
    )


def resolve(edges: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """edges with `target`, the file the specifier means; null where none is indexed (external).

    edges: edge_id, file, specifier and more; files: path. Edges and files meet once, under the path without a script
    extension: there a file's own path and the best of the names it goes by stand in one row, so an edge is dealt once,
    with its columns, and is neither sorted nor joined back. Only edges whose alias has several targets are grouped.
    """
    # paths are folded together once per edge: generators keep the planner from repeating that
    based = bases(edges, aliases).select("*", F.explode_outer(F.array("bases")).alias("_bases")).drop("bases")
    own = F.col("exact")
    named = files.select("path", F.inline(names_of(F.col("path")))).withColumn("_key", F.when(own, bare_name(F.col("key"))).otherwise(F.col("key")))
    # dealt before they are grouped: hardly any names repeat within a task, so a table of them there would only take memory
    known = named.repartition("_key").groupBy("_key").agg(F.collect_set(F.when(own, F.col("path"))).alias("_own"), F.min(F.when(~own, F.struct("prio", "path"))).alias("_named"))

    def met(rows: DataFrame) -> DataFrame:
        keyed = rows.select("*", bare_name(F.col("_base")).alias("_at"))
        target = F.when(F.array_contains("_own", F.col("_base")), F.col("_base")).otherwise(F.col("_named.path"))
        return keyed.join(known.hint("shuffle_hash"), F.col("_at") == F.col("_key"), "left").withColumn("target", target)

    one = met(based.filter("coalesce(size(_bases), 0) <= 1").select(*edges.columns, F.get("_bases", F.lit(0)).alias("_base"))).select(*edges.columns, "target")
    if aliases is None:
        return one
    several = based.filter("size(_bases) > 1")
    tried = met(several.select("edge_id", F.posexplode("_bases").alias("_ord", "_base"))).filter("target is not null")
    hits = tried.groupBy("edge_id").agg(F.min(F.struct("_ord", "target")).alias("_hit"))
    return one.unionByName(several.select(*edges.columns).join(hits, "edge_id", "left").select(*edges.columns, F.col("_hit.target").alias("target")))


def importers(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that import a symbol: (symbol, def_file, file, local), for targets (symbol, file).

    Named imports that resolve to the defining file, and those of a barrel that re-exports it, one hop: `export *` or
    under the same name. Default, namespace and renamed re-exports are not followed.
    """
    wanted = targets.select("symbol", F.col("file").alias("def_file")).distinct()
    flat = resolved.filter("target is not null").select("file", "kind", "star", "target", F.explode_outer("names").alias("n"))
    named = flat.filter("kind = 'import' and n is not null").select("file", "target", F.col("n.imported").alias("imported"), F.col("n.local").alias("local"))
    direct = named.join(wanted, (F.col("imported") == F.col("symbol")) & (F.col("target") == F.col("def_file"))).select("symbol", "def_file", "file", "local")
    again = flat.filter("kind = 're-export'").select(F.col("file").alias("barrel"), F.col("target").alias("def_file"), (F.col("star") & F.col("n").isNull()).alias("all"), F.col("n.imported").alias("i"), F.col("n.local").alias("l"))
    barrels = again.join(wanted, "def_file").filter("all or (i = symbol and l = symbol)").select("symbol", "def_file", "barrel").distinct()
    through = named.join(barrels, (F.col("target") == F.col("barrel")) & (F.col("imported") == F.col("symbol"))).select("symbol", "def_file", "file", "local")
    return direct.unionByName(through).distinct()


def first_target(scans: DataFrame) -> DataFrame:
    """One row per (file, local): that of the first definition, by def_ord, that reaches the file."""
    rest = [c for c in scans.columns if c not in ("file", "local", "def_ord")]
    return scans.groupBy("file", "local").agg(F.min(F.struct("def_ord", *rest)).alias("_s")).select("file", "local", "_s.*")
