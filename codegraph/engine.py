"""The public API: an index over a source tree or a table of sources, and the questions asked of it."""

from __future__ import annotations

import datetime
import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions.exprs import matches_glob
from .operators import graph, knowledge, lookup, modules, similarity, trace, types_tier, usage
from .operators.knowledge import Concept, LocatorError
from .sources import files as listing
from .sources import logs, snapshot, vocab
from .sources.index import TIER, SavedTables, Tables, member_uses, occurrences, parse_files, save, tasks

log = logging.getLogger("codegraph")
HOME, OWN_PREFIX, HUBS = ".codegraph", "mcp__codegraph__", 15
ANCHORS = "concept_id string, key string, hash string, captured_at timestamp"


@dataclass
class Answer:
    """text for people; rows for programs."""

    text: str
    rows: list = field(default_factory=list)
    data: dict = field(default_factory=dict)


class Listing(Answer):
    """An answer that lists as many rows as the tree has: they are fetched, and the text made of them, when first asked for."""

    def __init__(self, fetch: Callable[[], list], say: Callable[[list], str], data: dict):
        self._fetch, self._say, self.data = fetch, say, data

    @cached_property
    def rows(self) -> list:
        return self._fetch()

    @cached_property
    def text(self) -> str:
        return self._say(self.rows)


def _check(value, name: str, least, most) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} lies in {least}..{most}")


class Engine:
    """Index of one tree. Every question first brings the index up to date; only changed files are parsed again.

    With index, a folder written by save(), the tables are read from there as they are and nothing is parsed. Without
    watch, the index is brought up to date by sync() alone. A table's files are told apart by its columns mtime_ms and
    size, or by version; without those each sync reads the contents to hash them.
    """

    def __init__(
        self, spark: SparkSession, root: str | None = None, files: DataFrame | None = None, home: str | None = None, aliases: DataFrame | None = None,
        index: str | None = None, watch: bool = True, baselines: str | None = None,
    ):
        if (root is None) == (files is None):
            raise ValueError("give a root folder or a table of files (path, content)")
        self.spark, self.root, self._table = spark, root, files
        self.home = home or os.path.join(root or ".", HOME)
        self._store = baselines  # a folder that Spark reads and writes, where home is no path that all executors share
        self.parsed: DataFrame | None = None
        self.listed: DataFrame | None = None
        self._aliases, self._version, self._cache, self._watch, self._problems, self._files = aliases, 0, {}, watch, 0, 0
        self._saved = SavedTables(spark, index) if index else None

    # ---- index

    def sync(self) -> dict:
        """Parse what is new or changed, drop what is gone: file_count, symbol_count, changed, removed, elapsed_ms."""
        began = time.monotonic()
        if self._saved is not None:
            counts = self._saved.counts().first()
            self._files = counts.file_count
            return {"file_count": counts.file_count, "symbol_count": counts.symbol_count, "changed": 0, "removed": 0, "elapsed_ms": int((time.monotonic() - began) * 1000)}
        if self.root is not None:
            now = listing.listing(self.spark, self.root)
        else:
            now = listing.sources(self._stamped()).drop("grammar")
        if self.parsed is None:
            changed = gone = None
            due, n_removed = now, 0
        else:
            changed = snapshot.changed(self.listed, now, "path", ["mtime_ms", "size"]).persist()
            gone = snapshot.removed(self.listed, now, "path").persist()
            due, n_removed = now.join(changed, "path", "left_semi"), gone.count()
        n_changed, size = due.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n_changed or n_removed or self.parsed is None:
            whole = changed is None and self.root is None  # a table read for the first time needs no join with its own listing
            fresh = parse_files(self._table.select("path", "content") if whole else self._contents(due), tasks(n_changed, size))
            if self.parsed is not None:
                touched = changed.unionByName(gone).select(F.col("path").alias("file"))
                fresh = snapshot.replace_rows(self.parsed, touched, "file", fresh)
            self.parsed, old = graph.cut_lineage(fresh), self.parsed
            read = self.parsed.select(F.col("file").alias("path"))
            self.listed = graph.cut_lineage(now.join(read, "path", "left_semi"))  # files that could not be read stay due
            self._version += 1
            self._cache = {}
            del old
        for held in (changed, gone):
            if held is not None:
                held.unpersist()
        counts = Tables(self.parsed).counts().first()
        self._problems, self._files = counts.problem_count, counts.file_count
        return {
            "file_count": counts.file_count, "symbol_count": counts.symbol_count, "problem_count": counts.problem_count, "changed": n_changed, "removed": n_removed,
            "elapsed_ms": int((time.monotonic() - began) * 1000),
        }

    def _stamped(self) -> DataFrame:
        """path and two stamps of every row of the table: its own, or else hash and length of the content."""
        t = self._table
        if {"mtime_ms", "size"} <= set(t.columns):
            return t.select("path", F.col("mtime_ms").cast("double").alias("mtime_ms"), F.col("size").cast("long").alias("size"))
        if "version" in t.columns:
            return t.select("path", F.xxhash64("version").cast("double").alias("mtime_ms"), F.lit(0).cast("long").alias("size"))
        return t.select("path", F.xxhash64("content").cast("double").alias("mtime_ms"), F.length("content").cast("long").alias("size"))

    def _contents(self, listed: DataFrame) -> DataFrame:
        if self.root is not None:
            return listing.contents(listed, self.root)
        return self._table.join(listed.select("path"), "path", "left_semi").select("path", "content")

    @property
    def files(self) -> DataFrame:
        if self._saved is not None:
            return self._contents(self._saved.files) if self.root is not None else self._table.select("path", "content")
        return self._contents(self.listed)

    @property
    def parts(self) -> int:
        """Into how many tasks a search of all files is dealt."""
        return tasks(self._files)

    def save(self, path: str) -> None:
        """Write the index for Engine(index=path)."""
        save(self.tables, path)

    @property
    def tables(self) -> Tables:
        if self._saved is not None:
            return self._saved
        if self.parsed is None:
            self.sync()
        return Tables(self.parsed)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    @property
    def resolved(self) -> DataFrame:
        """Imports and re-exports with the files they mean."""
        alias = self._aliases if self._aliases is not None or self.root is None else listing.aliases(self.spark, self.root)
        return self._once("resolved", lambda: graph.cut_lineage(modules.resolve(self.tables.edges, self.tables.files.select("path"), alias)))

    @property
    def scoped(self) -> DataFrame:
        t = self.tables
        make = lambda: graph.cut_lineage(types_tier.scope(self.resolved, types_tier.exports(self.resolved, t.functions, t.table("types"), t.table("exports")), t.functions, t.table("types")))
        return self._once("scoped", make)

    @property
    def ancestry(self) -> DataFrame:
        return self._once("ancestry", lambda: graph.cut_lineage(types_tier.ancestry(self.tables.table("types"), self.tables.table("heritage"), self.scoped)))

    @property
    def typed(self) -> DataFrame:
        """Bindings whose class is known."""
        t = self.tables
        return self._once("typed", lambda: types_tier.typed_bindings(t.table("bindings"), t.functions, t.table("types"), self.scoped, t.table("heritage"), self.ancestry))

    @property
    def call_edges(self) -> DataFrame:
        t = self.tables
        make = lambda: graph.cut_lineage(types_tier.call_edges(t.calls, t.functions, t.table("bindings"), self.typed, t.table("types"), self.resolved, self.scoped, t.table("heritage"), self.ancestry))
        return self._once("calls", make)

    def _record(self, tool: str, args: dict) -> None:
        """One line in the usage log; failures are only logged."""
        try:
            os.makedirs(self.home, exist_ok=True)
            line = {"ts": datetime.datetime.now(datetime.UTC).isoformat(), "tool": tool, "args": {k: v for k, v in args.items() if v is not None}}
            with open(os.path.join(self.home, "usage.jsonl"), "a", encoding="utf-8") as f:
                f.write(json.dumps(line) + "\n")
        except OSError as e:
            log.warning("usage not recorded: %s", e)

    def _begin(self, tool: str, **args) -> None:
        self._record(tool, args)
        if self._watch or self.parsed is None:
            self.sync()

    # ---- lookup

    def find_def(self, symbol: str, path_glob: str | None = None) -> Answer:
        """Definitions of a name, or suggestions where there are none."""
        if not symbol:
            raise ValueError("symbol is empty")
        self._begin("find_def", symbol=symbol, pathGlob=path_glob)
        rows = lookup.find(self.tables.defs, symbol, path_glob).collect()
        if rows:
            return Answer("\n".join(f"{r.kind} {r.symbol}  {r.file}:{r.line}  {r.signature}" for r in rows), rows)
        near = lookup.find_fuzzy(self.tables.defs, symbol, path_glob).collect() if len(symbol) >= lookup.LEAST_QUERY else []
        text = f"No definition of {symbol}." + (" Close: " + ", ".join(f"{r.symbol} ({r.file}:{r.line})" for r in near) if near else "")
        return Answer(text, [], {"suggestions": near})

    def find_refs(self, symbol: str, path_glob: str | None = None) -> Answer:
        """References to a name, each resolved to its definition: by imports, or by receiver types for methods."""
        if not symbol:
            raise ValueError("symbol is empty")
        self._begin("find_refs", symbol=symbol, pathGlob=path_glob)
        known = lookup.find(self.tables.defs, symbol)
        if known.isEmpty():
            return Answer(f"No definition of {symbol}.")
        if self._typed() and not known.filter("kind = 'method'").isEmpty():
            refs, unread = self.member_refs(symbol, path_glob)
            rows = refs.orderBy("file", "line", "column").collect()
            if rows:
                return self._refs_answer(symbol, rows, types_tier.TIER, [r.file for r in unread.collect()])
        defs = known.collect()
        d = self.spark.createDataFrame([(symbol, r.file, r.line, i) for i, r in enumerate(defs)], "symbol string, file string, def_line int, def_ord int")
        own = d.select("file", F.col("symbol").alias("local"), "def_ord", F.col("file").alias("def_file"), "def_line")
        users = modules.importers(self.resolved, d.select("symbol", "file"))
        lines = d.groupBy("file").agg(F.min(F.struct("def_ord", "def_line")).alias("m")).select(F.col("file").alias("def_file"), "m.*")
        taken = users.join(lines, "def_file").select("file", "local", "def_ord", "def_file", "def_line")
        wanted = modules.first_target(own.unionByName(taken).filter(matches_glob(F.col("file"), path_glob)))
        rows = occurrences(self.files, wanted.select("file", "local", "def_file", "def_line"), self.parts).orderBy("file", "line", "column").collect()
        found = [r for r in rows if r.line is not None]
        text = self._refs_answer(symbol, found, TIER, [r.file for r in rows if r.line is None])
        text.data["importer_count"] = users.join(d.select("file").distinct(), "file", "left_anti").count()
        if not found and any(r.kind == "method" for r in defs):
            text.text += " It is a method: uses through a receiver need the type-resolved tier (a tsconfig)."
        return text

    def _typed(self) -> bool:
        """Whether the typed tier applies: always for tables, else where a project configuration exists."""
        return self.root is None or any(os.path.exists(os.path.join(self.root, c)) for c in (*listing.CONFIGS, "tsconfig.base.json"))

    def member_refs(self, symbol: str, path_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The references to a method through receivers of known types, as a table, and the files nested too deeply to be read."""
        t = self.tables
        uses = member_uses(self.files.filter(matches_glob(F.col("path"), path_glob)), symbol, self.parts)
        uses = graph.cut_lineage(uses.withColumn("use_id", F.concat_ws(":", "file", "line", "column")))
        unread = uses.filter("line is null").select("file")
        uses = uses.filter("line is not null")
        located = types_tier.receivers(uses, t.table("bindings"), self.typed, t.table("types"), self.scoped, t.table("heritage"), self.ancestry).filter("r_cls is not null")
        # the receiver's class may inherit the member or declare it: the nearest class with it counts
        m = t.functions.filter((F.col("name") == symbol) & F.col("cls").isNotNull()).select(F.col("file").alias("m_file"), F.col("cls").alias("m_cls"), F.col("line").alias("def_line"))
        up = located.join(self.ancestry.withColumnsRenamed({"file": "x_file", "cls": "x_cls"}), (F.col("r_file") == F.col("x_file")) & (F.col("r_cls") == F.col("x_cls")))
        hit = up.join(m, (F.col("a_file") == F.col("m_file")) & (F.col("a_cls") == F.col("m_cls")))
        best = hit.groupBy("file", "line", "column", "snippet", F.col("kind").alias("ref_kind")).agg(F.min_by(F.struct(F.col("m_file").alias("def_file"), "def_line"), F.struct("distance", "def_line")).alias("d"))
        return best.select("file", "line", "column", "snippet", "ref_kind", "d.def_file", "d.def_line"), unread

    def _refs_answer(self, symbol: str, rows: list[Row], tier: str, unread: list[str]) -> Answer:
        lines = [f"{r.file}:{r.line}:{r.column}  {r.ref_kind}  -> {r.def_file}:{r.def_line}  {r.snippet}" for r in rows]
        text = f"{len(rows)} references to {symbol} ({tier})." + "".join("\n" + x for x in lines)
        if unread:
            text += f"\nNot searched, nested too deeply: {', '.join(sorted(set(unread)))}"
        return Answer(text, rows, {"tier": tier, "unread": sorted(set(unread)), "problems": self._problems})

    # ---- graphs

    @property
    def dep_edges(self) -> DataFrame:
        return self.resolved.filter("target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()

    def dep_graph(self, focus: str | None = None, depth: int = 1, cycles: bool = False) -> Answer:
        """File dependencies: the most depended-on files, the surroundings of a file or folder, or the import cycles."""
        _check(depth, "depth", 1, 2)
        self._begin("dep_graph", focus=focus, depth=depth, cycles=cycles or None)
        edges = self.dep_edges
        if cycles:
            groups: dict[str, list[str]] = {}
            for r in graph.cycles(edges).orderBy("group_id", "id").collect():
                groups.setdefault(r.group_id, []).append(r.id)
            found = list(groups.values())
            said = "Dependencies are acyclic." if not found else f"{len(found)} circular dependency group{'s' * (len(found) > 1)}:" + "".join("\n" + " <-> ".join(g) for g in found)
            return Answer(said, found, {"cycles": found})
        if focus:
            inside = (F.col("id") == focus) | F.col("id").startswith(focus.rstrip("/") + "/")
            ids = self.tables.files.select(F.col("path").alias("id")).filter(inside)
            found = graph.neighborhood(edges, ids, depth).orderBy("src", "dst").collect()
            out = [f"  imports {r.dst}" for r in found if r.src == focus or r.src.startswith(focus.rstrip("/") + "/")]
            into = [f"  imported by {r.src}" for r in found if r.dst == focus or r.dst.startswith(focus.rstrip("/") + "/")]
            return Answer("\n".join([f"Neighborhood of {focus}", *out, *into]), found, {"edges": found})
        hubs = graph.hubs(edges)
        rows = hubs.limit(HUBS).collect()
        folders = edges.select(F.regexp_replace("src", "/?[^/]*$", "").alias("a"), F.regexp_replace("dst", "/?[^/]*$", "").alias("b")).filter("a <> b")
        between = folders.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(HUBS).collect()
        text = ["Most depended-on files:", *[f"  {r.id}  in {r.in_degree}, out {r.out_degree}" for r in rows]]
        text += ["Between folders:", *[f"  {r.a or '.'} -> {r.b or '.'}: {r.n}" for r in between]] if between else []
        return Answer("\n".join(text), rows, {"nodes": hubs, "modules": between, "problems": self._problems})

    def _entry(self, symbol: str, path_glob: str | None) -> tuple[Row | None, list[Row]]:
        defs = lookup.find(self.tables.defs, symbol, path_glob).filter("kind in ('function', 'method')").collect()
        return (defs[0] if defs else None), defs[1:]

    def _trace(self, symbol: str, path_glob: str | None, depth: int, limit: int) -> tuple[trace.CallNode | None, str, list[Row]]:
        first, rest = self._entry(symbol, path_glob)
        if first is None:
            return None, f"No function {symbol}.", []
        if not self._typed():
            return None, "No project configuration covers this tree, so calls cannot be resolved.", []
        functions = self.tables.functions
        name = symbol.rsplit(".", 1)[-1]
        start = functions.filter((F.col("file") == first.file) & (F.col("name") == name) & F.col("has_body")).orderBy(F.abs(F.col("line") - first.line), "start").limit(1).collect()
        if not start:
            return None, f"{symbol} has no body at {first.file}:{first.line}.", []
        edges = self.call_edges
        inner = edges.filter("outcome = 'in-repo'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        ids = graph.closure(inner, self.spark.createDataFrame([(start[0].id,)], "id string"), depth, limit).select("id")
        nodes = {r.id: r.asDict() for r in functions.join(ids, "id", "left_semi").collect()}
        ids = ids.withColumnRenamed("id", "caller")
        calls: dict[str, dict] = {}
        for r in edges.filter("outcome = 'in-repo'").join(ids, "caller", "left_semi").orderBy("caller", "call_ord", "impl_ord").collect():
            calls.setdefault(r.caller, {}).setdefault(r.call_ord, []).append(r.callee)
        count = lambda o: F.count_distinct(F.when(F.col("outcome") == o, F.col("text")))
        outside = {r.caller: (r.e, r.u) for r in edges.join(ids, "caller", "left_semi").groupBy("caller").agg(count("external").alias("e"), count("unresolved").alias("u")).collect()}
        root = trace.tree(start[0].id, nodes, {k: list(v.values()) for k, v in calls.items()}, outside, depth, limit)
        return root, "", rest

    def call_graph(self, symbol: str, path_glob: str | None = None, depth: int = 5) -> Answer:
        """What a function calls, and what those call in turn."""
        _check(depth, "depth", 1, 8)
        self._begin("call_graph", symbol=symbol, pathGlob=path_glob, depth=depth)
        root, why, rest = self._trace(symbol, path_glob, depth, 120)
        if root is None:
            return Answer(why)
        also = "".join(f"\nAlso defined at {r.file}:{r.line}" for r in rest)
        return Answer(f"Calls from {symbol} (precision tier: {types_tier.TIER})\n{trace.render(root)}{also}", trace.members(root), {"tree": root})

    def flow(self, symbol: str, path_glob: str | None = None, depth: int = 6) -> Answer:
        """A call tree with its branches, error handling and asynchronous points, and their sums."""
        _check(depth, "depth", 1, 8)
        self._begin("flow", symbol=symbol, pathGlob=path_glob, depth=depth)
        root, why, rest = self._trace(symbol, path_glob, depth, 150)
        if root is None:
            return Answer(why)
        total = trace.rollup(root)
        head = f"Flow of {symbol} (precision tier: {types_tier.TIER}): {total['functions']} functions, {total['branches']} branches, {total['errors']} error sites, {total['awaits']} async points"
        also = "".join(f"\nAlso defined at {r.file}:{r.line}" for r in rest)
        return Answer(f"{head}\n{trace.render(root, True)}{also}", trace.members(root), {"tree": root, "rollup": total})

    # ---- concepts

    @property
    def _vocab(self) -> str:
        return os.path.join(self.home, "assertions.yaml")

    @property
    def _baselines(self) -> str:
        return self._store or os.path.join(self.home, "anchors.parquet")

    def concepts(self) -> dict[str, Concept]:
        return vocab.load(self._vocab)

    def _anchor_rows(self) -> DataFrame:
        """All baselines; a missing or unreadable store is empty."""
        try:
            return self.spark.read.schema(ANCHORS).parquet(self._baselines)
        except Exception as e:  # noqa: BLE001
            if self._store or Path(self._baselines).exists():
                log.warning("baselines not read: %s", e)
            return self.spark.createDataFrame([], ANCHORS)

    def baseline(self, id_: str) -> DataFrame:
        """(key, hash) of a concept's baseline; one row of nulls where the concept was empty, none where nothing was captured."""
        return self._anchor_rows().filter(F.col("concept_id") == id_).select("key", "hash")

    def capture(self, id_: str, anchors: DataFrame) -> None:
        """Replace one concept's baseline, the others' partitions untouched. The rows are made before the store is written."""
        now = graph.cut_lineage(anchors.select("key", "hash"))
        if now.isEmpty():
            now = self.spark.createDataFrame([(None, None)], "key string, hash string")
        rows = now.select(F.lit(id_).alias("concept_id"), "key", "hash", F.current_timestamp().alias("captured_at"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("concept_id").parquet(self._baselines)

    def resolve(self, concept: Concept) -> DataFrame:
        t = self.tables
        return knowledge.resolve(concept, t.defs, t.edges, t.files)

    def _anchors(self, concept: Concept, found: DataFrame) -> DataFrame:
        """knowledge.anchors; contents, which only those of paths hash, are joined where the concept has such locators."""
        return knowledge.anchors(found, self.files if any(p.kind == "path" for p in concept.parts) else None)

    def _flow_anchors(self, concept: Concept) -> tuple[DataFrame | None, trace.CallNode | None, str]:
        root, why, _ = self._trace(concept.flow.entry, concept.flow.path_glob, 6, 150)
        if root is None:
            return None, None, why
        keys = [(f"{n.file}#{n.symbol}" if n.symbol != "(anonymous)" else f"{n.file}:{n.line}", "member") for n in trace.members(root)]
        return self.spark.createDataFrame(keys, "key string, hash string"), root, ""

    def _state(self, id_: str, anchors: DataFrame) -> tuple[str, list[Row]]:
        before = self.baseline(id_)
        if before.isEmpty():
            return "unverified", []
        rows = knowledge.drift(before.filter("key is not null"), anchors).orderBy("change", "key").collect()
        return ("drifted" if rows else "fresh"), rows

    def arch_list(self) -> Answer:
        """Every concept with its size and freshness; baselines are never captured here."""
        self._begin("arch_list")
        rows = []
        for id_, c in self.concepts().items():
            if c.flow:
                rows.append((id_, c.title, None, "unverified" if self.baseline(id_).isEmpty() else "recorded"))
                continue
            try:
                found = self.resolve(c)
                rows.append((id_, c.title, found.count(), self._state(id_, self._anchors(c, found))[0]))
            except LocatorError as e:
                rows.append((id_, c.title, 0, f"error: {e}"))
        return Answer("\n".join(f"{i}: {t} ({n if n is not None else 'flow'}, {s})" for i, t, n, s in rows) or "No concepts.", rows)

    def arch_query(self, concept: str, reaccept: bool = False) -> Answer:
        """Where a concept lives now, what drifted since its baseline, and whether its rule holds. The first query captures the baseline."""
        self._begin("arch_query", concept=concept, reaccept=reaccept or None)
        known = self.concepts()
        if concept not in known:
            return Answer(f"No concept {concept}. Known: {', '.join(sorted(known)) or 'none'}.")
        c = known[concept]
        if c.flow:
            anchors, root, why = self._flow_anchors(c)
            if anchors is None:
                return Answer(why)
            head, lines = [f"{c.title} ({types_tier.TIER})", trace.render(root, True)], []
        else:
            try:
                found = graph.cut_lineage(self.resolve(c))
            except LocatorError as e:
                return Answer(f"{concept}: {e}", [], {"error": str(e)})
            anchors = self._anchors(c, found)
            head, lines = [c.title + (f": {c.description}" if c.description else "")], []
        state, changes = self._state(concept, anchors)
        if state == "unverified" or reaccept:
            self.capture(concept, anchors)
            state = "accepted" if reaccept and state != "unverified" else "captured"
            changes = [] if reaccept else changes
        lines.append(f"Baseline: {state}")
        shown = 8 if c.flow else 5
        for kind in ("added", "removed", "changed"):
            keys = [r.key for r in changes if r.change == kind]
            if keys:
                lines.append(f"  {kind}: {', '.join(keys[:shown])}" + (f" and {len(keys) - shown} more" if len(keys) > shown else ""))
        data = {"state": state, "drift": changes}
        if c.must and not c.flow:
            data["conformance"] = self._conformance(c, found, lines)
        if c.flow:
            return Answer("\n".join(head + lines), trace.members(root), data)
        fetch = lambda: found.orderBy("stage_ord", "file", F.col("line").asc_nulls_first(), "ord").collect()
        return Listing(fetch, lambda rows: "\n".join(head + self._member_lines(c, rows) + lines), data)

    @staticmethod
    def _member_lines(c: Concept, rows: list[Row]) -> list[str]:
        lines = []
        for i, part in enumerate(c.parts):
            own = [r for r in rows if r.stage_ord == i]
            lines += [f"[{part.title}]"] * bool(c.stages) + [f"  {r.file}" + (f":{r.line}" if r.line else "") + (f"  {r.symbol}" if r.symbol else "") for r in own]
        return lines

    def _allowed(self, c: Concept) -> DataFrame:
        return self.resolve(Concept("must", "must", locators=c.must.locators))

    def _conformance(self, c: Concept, found: DataFrame, lines: list[str]) -> dict:
        try:
            allowed = graph.cut_lineage(self._allowed(c).select("file").distinct())
        except LocatorError as e:
            lines.append(f"Rule: error: {e}")
            return {"error": str(e)}
        members = knowledge.member_files(found)
        row = knowledge.conformance(members, allowed).first()
        bad = [r.file for r in knowledge.violations(members, allowed).orderBy("file").limit(10).collect()]
        lines.append(f"Rule{f' ({c.must.title})' if c.must.title else ''}: {row.conforming} of {row.total} conform" + (f"; not: {', '.join(bad)}" if bad else ""))
        return {"total": row.total, "conforming": row.conforming, "violations": bad}

    def arch_assert(self, id: str, title: str, description: str | None = None, locators: list[dict] | None = None, flow: dict | None = None, must: dict | None = None) -> Answer:  # noqa: A002
        """Record a concept, replacing any of that id; it needs locators or a flow."""
        self._record("arch_assert", {"concept": id})
        if not id or not title:
            raise ValueError("id and title are needed")
        if not locators and not flow:
            return Answer(f"{id}: give locators or a flow; nothing was written.")
        entry = {"title": title, "description": description, "locators": locators or None, "flow": flow, "must": must}
        vocab.concept(id, {k: v for k, v in entry.items() if v is not None})
        vocab.save(self._vocab, id, entry)
        return self.arch_query(id)

    def arch_candidates(self, concept: str, threshold: float = 0.5, limit: int = 10) -> Answer:
        """Functions that look like a concept's own but lie outside it."""
        _check(threshold, "threshold", 0, 1)
        _check(limit, "limit", 1, 50)
        self._begin("arch_candidates", concept=concept, threshold=threshold, limit=limit)
        known = self.concepts()
        if concept not in known:
            return Answer(f"No concept {concept}. Known: {', '.join(sorted(known)) or 'none'}.")
        c = known[concept]
        if not c.parts:
            return Answer(f"{concept} has no locators, so there is nothing to compare.")
        t = self.tables
        try:
            seeds = self.resolve(c).select("file")
        except LocatorError as e:
            return Answer(f"{concept}: {e}", [], {"error": str(e)})
        for part in c.parts:
            if part.kind == "import":
                used = t.edges.filter(knowledge.import_predicate(part.of, part.within)).select(F.explode("names").alias("n")).select(F.col("n.imported").alias("symbol")).filter("symbol not in ('default', '*')").distinct()
                seeds = seeds.unionByName(t.defs.join(used, "symbol", "left_semi").select("file"))
        prints = graph.cut_lineage(t.fingerprints)
        references = prints.join(seeds.distinct(), "file", "left_semi")
        order = F.row_number().over(Window.orderBy("file", "line", "name"))
        references = references.withColumn("ref_ord", order)  # references are one concept's functions
        if references.isEmpty():
            return Answer(f"{concept} has no functions to compare with.")
        found = similarity.best_reference(prints, references, threshold, limit)
        note = ""
        allowed = None
        if c.must:
            try:
                allowed = self._allowed(c)
            except LocatorError as e:
                note = f" (rule not applied: {e})"
        rows = similarity.flag_violations(found, allowed).orderBy(F.desc("score"), "file", "line").collect()
        lines = [f"{r.score:.2f}  {r.name}  {r.file}:{r.line}  like {r.resembles}" + ("  [outside the rule]" if r.violates else "") for r in rows]
        return Answer(f"{len(rows)} candidates for {concept} (structural-similarity){note}" + "".join("\n" + x for x in lines), rows)

    # ---- reports

    def stats(self, transcript: str | None = None) -> Answer:
        """Usage, concepts, baselines and adoption."""
        path = os.path.join(self.home, "usage.jsonl")
        data: dict = {}
        if os.path.exists(path):
            u = graph.cut_lineage(logs.usage(logs.lines(self.spark, path)).select("line_no", "ts", "tool", usage.string_arg(F.col("args"), "symbol").alias("symbol"), usage.string_arg(F.col("args"), "concept").alias("concept"), usage.string_arg(F.col("args"), "entry").alias("entry")))
            data["by_tool"] = usage.by_tool(u).collect()
            for name in ("symbol", "concept", "entry"):
                data[f"top_{name}s"] = usage.top_values(u, F.col(name)).collect()
            data["span"] = usage.first_last(u, "line_no").first()
        known = self.concepts()
        data["concepts"] = {"total": len(known), "with_must": sum(c.must is not None for c in known.values()), "flows": sum(c.flow is not None for c in known.values())}
        data["baselines"] = [r.concept_id for r in self._anchor_rows().select("concept_id").distinct().orderBy("concept_id").collect()]
        if transcript and os.path.exists(transcript):
            data["adoption"] = usage.adoption(logs.timeline(logs.lines(self.spark, transcript), OWN_PREFIX)).first()
        calls = data["span"].calls if "span" in data else 0
        lines = [f"Usage: {calls} calls", *[f"  {r.tool}: {r.calls}" for r in data.get("by_tool", [])]]
        lines += [f"Concepts: {data['concepts']['total']} ({data['concepts']['with_must']} with rules, {data['concepts']['flows']} flows)", f"Baselines: {len(data['baselines'])}"]
        if "adoption" in data:
            a = data["adoption"]
            lines.append(f"Adoption: {a.own} own calls, {a.grep} text searches, {a.share_pct} % own")
        return Answer("\n".join(lines), [], data)

    def precision_report(self, symbol: str) -> Answer:
        """Files a plain word search finds that find_refs excludes, and files it finds that the word search misses."""
        refs = sorted({r.file for r in self.find_refs(symbol).rows} | {r.file for r in lookup.find(self.tables.defs, symbol).collect()})
        word = rf"(?<![\w$])\Q{symbol}\E(?![\w$])"
        hits = self.files.filter(F.col("content").rlike(word)).select("path")
        known = self.spark.createDataFrame([(x,) for x in refs], "path string")
        excluded = sorted(r.path for r in hits.join(known, "path", "left_anti").collect())
        missed = sorted(r.path for r in known.join(hits, "path", "left_anti").collect())
        return Answer(f"{symbol}: {len(excluded)} files excluded, {len(missed)} missed by the word search", [], {"excluded": excluded, "missed": missed})


def latest_transcript(folder: str, cwd: str) -> str | None:
    """The newest JSON-lines file in the folder named after cwd, else in folders whose names hold its last part."""
    top = Path(folder)
    exact = top / cwd.replace("/", "-").replace(".", "-")
    where = [exact] if exact.is_dir() else [p for p in top.glob("*") if p.is_dir() and os.path.basename(cwd) in p.name] if top.is_dir() else []
    found = [f for p in where for f in p.glob("*.jsonl")]
    return str(max(found, key=lambda f: f.stat().st_mtime)) if found else None
