"""Concepts: locators compiled to predicates, drift against baselines, conformance, candidates.

A locator is data (kind, query, glob, of, in); it compiles to Columns and is never evaluated as code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash16, matches_glob

TIER = "syntactic"
LOCATION = ["file", "line", "kind", "symbol", "signature", "stage", "stage_ord", "locator_ord", "ord", "via", "tier"]


class LocatorError(ValueError):
    pass


@dataclass(frozen=True)
class Locator:
    kind: str  # symbol, path or import
    query: str = ""  # symbol: "<kind> <name glob> [= <substring of the signature>]"
    glob: str = ""  # path
    of: str = ""  # import
    within: str | None = None  # file glob
    title: str | None = None  # of a stage


@dataclass(frozen=True)
class Flow:
    entry: str
    path_glob: str | None = None


@dataclass(frozen=True)
class Invariant:
    locators: tuple[Locator, ...]
    title: str | None = None


@dataclass(frozen=True)
class Concept:
    id: str
    title: str
    description: str | None = None
    note: str | None = None
    locators: tuple[Locator, ...] = ()
    stages: tuple[Locator, ...] = ()
    flow: Flow | None = None
    must: Invariant | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def parts(self) -> tuple[Locator, ...]:
        return self.stages or self.locators


def parse_symbol_query(query: str) -> tuple[str, str, str | None]:
    """(kind, name glob, substring): split at the first = and then at the first blank; const means constant."""
    head, _, tail = query.partition("=")
    kind, _, name = head.strip().partition(" ")
    if not kind or not name.strip():
        raise LocatorError(f"expected '<kind> <name> [= <text>]', not {query!r}")
    return ("constant" if kind == "const" else kind), name.strip(), tail.strip() or None


def symbol_predicate(query: str, within: str | None = None) -> Column:
    kind, name, text = parse_symbol_query(query)
    held = F.col("signature").contains(text) if text else F.lit(True)
    return (F.col("kind") == kind) & matches_glob(F.col("symbol"), name) & matches_glob(F.col("file"), within) & held


def import_predicate(of: str, within: str | None = None) -> Column:
    """The module itself or anything below it, by the specifier as written."""
    return ((F.col("specifier") == of) | F.col("specifier").startswith(of + "/")) & matches_glob(F.col("file"), within)


def locate(locator: Locator, defs: DataFrame, edges: DataFrame, files: DataFrame, at: int = 0) -> DataFrame:
    """The locations of one locator, in the columns of LOCATION."""
    none = {c: F.lit(None).cast(t) for c, t in (("line", "int"), ("symbol", "string"), ("signature", "string"), ("ord", "int"))}
    if locator.kind == "symbol":
        rows = defs.filter(symbol_predicate(locator.query, locator.within)).select("file", "line", "kind", "symbol", "signature", "ord")
    elif locator.kind == "path":
        hit = matches_glob(F.col("path"), locator.glob) & matches_glob(F.col("path"), locator.within)
        rows = files.filter(hit).select(F.col("path").alias("file")).distinct().withColumns(none | {"kind": F.lit("file")})
    elif locator.kind == "import":
        rows = edges.filter(import_predicate(locator.of, locator.within)).select("file").distinct().withColumns(none | {"kind": F.lit("import")})
    else:
        raise LocatorError(f"unknown locator kind {locator.kind!r}")
    return rows.withColumns({"stage": F.lit(locator.title).cast("string"), "stage_ord": F.lit(at), "locator_ord": F.lit(at), "via": F.lit(locator.kind), "tier": F.lit(TIER)}).select(LOCATION)


def resolve(concept: Concept, defs: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """All locations of a concept: locators one after another, duplicates kept, stages in order."""
    if not concept.parts:
        raise LocatorError(f"concept {concept.id!r} has no locators")
    found = None
    for i, locator in enumerate(concept.parts):
        part = locate(locator, defs, edges, files, i)
        found = part if found is None else found.unionByName(part)
    return found


def anchors(locations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(key, hash) of locations; of locations with one key the last counts.

    Symbols hash kind and signature, paths hash their content (files.content), imports have a constant hash, so only
    their membership drifts.
    """
    rows = locations
    content = F.lit(None).cast("string")
    if files is not None and "content" in files.columns:
        rows = rows.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
        content = F.col("content")
    symbol = F.col("via") == "symbol"
    key = F.when(symbol, F.concat_ws("#", "file", "symbol")).otherwise(F.concat_ws(":", "via", "file"))
    value = F.when(symbol, hash16(F.concat_ws(" ", "kind", "signature"))).when(F.col("via") == "path", hash16(content)).otherwise("present")
    order = F.struct("locator_ord", F.coalesce("line", F.lit(0)), F.coalesce("ord", F.lit(0)), value)
    return rows.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("hash"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key, change): added, removed or changed between two anchor tables."""
    a, b = before.select("key", F.col("hash").alias("old")), now.select("key", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "key", "full_outer").withColumn("change", change).filter("change is not null").select("key", "change")


def membership_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key, change): keys that entered or left."""
    entered = now.select("key").join(before.select("key"), "key", "left_anti").distinct().withColumn("change", F.lit("entered"))
    gone = before.select("key").join(now.select("key"), "key", "left_anti").distinct().withColumn("change", F.lit("left"))
    return entered.unionByName(gone)


def member_files(locations: DataFrame) -> DataFrame:
    """The first location of each file."""
    order = F.struct("stage_ord", "locator_ord", F.coalesce("line", F.lit(0)), F.coalesce("ord", F.lit(0)))
    return locations.groupBy("file").agg(F.min_by("symbol", order).alias("symbol"), F.min_by("line", order).alias("line"))


def violations(members: DataFrame, allowed: DataFrame) -> DataFrame:
    """Members whose file the invariant's locations don't include."""
    return members.join(allowed.select("file").distinct(), "file", "left_anti")


def conformance(members: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row: total, conforming, violating."""
    flags = members.join(allowed.select("file").distinct().withColumn("_ok", F.lit(1)), "file", "left")
    total, good = F.count(F.lit(1)), F.count("_ok")
    return flags.agg(total.alias("total"), good.alias("conforming"), (total - good).alias("violating"))
