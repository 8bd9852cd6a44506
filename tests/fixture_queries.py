"""Queries over a small fixed source tree and fixed log lines: the parts of the engine that the driver's tables cannot feed.

Their SQL states the expected rows, worked out by reading the sources below.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph.engine import Engine
from codegraph.functions import exprs as X
from codegraph.operators import graph, knowledge, modules, similarity, types_tier, usage
from codegraph.sources import logs
from codegraph.sources.files import sources as only_sources
from codegraph.sources.index import member_uses, occurrences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = {
    "src/store.ts": """export interface Store { put(key: string): void; }
export class MemoryStore implements Store {
  private items = new Map<string, number>();
  put(key: string): void { this.items.set(key, tally(key)); }
}
export function tally(key: string): number { return key ? key.length : again(key); }
function again(key: string): number { return again(key + "x"); }
export const LIMIT = 10;
""",
    "src/index.ts": "export * from './store';\nexport { tally as count } from './store';\n",
    "src/service.ts": """import { Store } from './store';
import type { Options } from 'toolkit/options';
export class Service {
  constructor(private store: Store) {}
  async save(key: string) {
    if (!key) { throw new Error('empty'); }
    try { await this.store.put(key); } catch (e) { report(e); }
    return key ? 1 : 2;
  }
}
""",
    "src/main.ts": """import { tally } from './index';
import { Service } from './service.js';
import * as all from './store';
export const main = () => tally('a') + all.tally('b') + new Service(null as any).save('c').length;
""",
    "src/left.ts": "import { right } from './right';\nexport type Left = typeof right;\nexport const left = () => right;\n",
    "src/right.ts": "import { left } from './left';\nexport enum Side { A, B }\nexport const right = () => left;\n",
    "src/sum.ts": """export function total(items: number[]) {
  let sum = 0;
  for (const item of items) { if (item > 3) { sum += item * 2; } else { sum -= item; } }
  return sum;
}
""",
    "lib/copy.js": """export function grand(rows) {
  let acc = 0;
  for (const row of rows) { if (row > 3) { acc += row * 2; } else { acc -= row; } }
  return acc;
}
""",
    "src/types.d.ts": "declare const hidden: number;\n",
}
USAGE = ['{"ts":"1","tool":"find_def","args":{"symbol":"A"}}', "", "no json", '{"ts":1,"tool":"x"}', '{"ts":"0","tool":"flow","args":3}', '{"ts":"2","tool":"find_def","args":{"symbol":7}}', '{"ts":"3","tool":"find_refs","args":{"symbol":"A"}}']
CALLS = [("own__find", ""), ("Grep", ""), ("Bash", "ls | rg x"), ("Bash", "echo grep"), ("Glob", ""), ("ToolSearch", ""), ("Read", "")]


def checked(columns: str, *rows: tuple):
    def put(f):
        QUERIES[f.__name__] = f
        one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
        names = [c.removesuffix(":long") for c in columns.split()]
        picked = ", ".join(f'"{n}"::BIGINT AS "{n}"' if c.endswith(":long") else f'"{n}"' for n, c in zip(names, columns.split(), strict=True))
        values = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
        SQL[f.__name__] = f"SELECT {picked} FROM (VALUES {values}) AS t ({', '.join(chr(34) + n + chr(34) for n in names)})"
        return f

    return put


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FILES.items()), "path string, content string")


def engine(spark: SparkSession) -> Engine:
    made = Engine(spark, files=files(spark), home=tempfile.mkdtemp(prefix="codegraph-"))
    made.sync()
    return made


@checked("path grammar", *[(p, "javascript" if p.endswith("js") else "typescript") for p in FILES if not p.endswith(".d.ts")])
def src_listing(spark, sf_dir):
    return only_sources(files(spark)).select("path", "grammar")


@checked(
    "file line kind symbol signature",
    ("lib/copy.js", 1, "function", "grand", "function grand(rows)"),
    ("src/left.ts", 2, "type", "Left", "type Left = typeof right;"),
    ("src/left.ts", 3, "function", "left", "left = () => right"),
    ("src/main.ts", 4, "function", "main", "main = () => tally('a') + all.tally('b') + new Service(null as any).save('c').length"),
    ("src/right.ts", 2, "enum", "Side", "enum Side"),
    ("src/right.ts", 3, "function", "right", "right = () => left"),
    ("src/service.ts", 3, "class", "Service", "class Service"),
    ("src/service.ts", 5, "method", "save", "async save(key: string)"),
    ("src/store.ts", 1, "interface", "Store", "interface Store"),
    ("src/store.ts", 1, "method", "put", "put(key: string): void;"),
    ("src/store.ts", 2, "class", "MemoryStore", "class MemoryStore implements Store"),
    ("src/store.ts", 4, "method", "put", "put(key: string): void"),
    ("src/store.ts", 6, "function", "tally", "function tally(key: string): number"),
    ("src/store.ts", 7, "function", "again", "function again(key: string): number"),
    ("src/store.ts", 8, "constant", "LIMIT", "export const LIMIT = 10;"),
    ("src/sum.ts", 1, "function", "total", "function total(items: number[])"),
)
def src_defs(spark, sf_dir):
    return engine(spark).tables.defs.select("file", "line", "kind", "symbol", "signature")


@checked(
    "file line kind star specifier names target",
    ("src/index.ts", 1, "re-export", True, "./store", "", "src/store.ts"),
    ("src/index.ts", 2, "re-export", False, "./store", "tally>count", "src/store.ts"),
    ("src/left.ts", 1, "import", False, "./right", "right>right", "src/right.ts"),
    ("src/main.ts", 1, "import", False, "./index", "tally>tally", "src/index.ts"),
    ("src/main.ts", 2, "import", False, "./service.js", "Service>Service", "src/service.ts"),
    ("src/main.ts", 3, "import", True, "./store", "*>all", "src/store.ts"),
    ("src/right.ts", 1, "import", False, "./left", "left>left", "src/left.ts"),
    ("src/service.ts", 1, "import", False, "./store", "Store>Store", "src/store.ts"),
    ("src/service.ts", 2, "import", False, "toolkit/options", "Options>Options", None),
)
def src_imports(spark, sf_dir):
    names = F.array_join(F.transform("names", lambda n: F.concat_ws(">", n["imported"], n["local"])), ",")
    return engine(spark).resolved.select("file", "line", "kind", "star", "specifier", names.alias("names"), "target")


@checked("def_file file local", ("src/store.ts", "src/main.ts", "tally"))
def src_importers(spark, sf_dir):
    targets = spark.createDataFrame([("tally", "src/store.ts")], "symbol string, file string")
    return modules.importers(engine(spark).resolved, targets).select("def_file", "file", "local")


@checked(
    "file line col ref_kind",
    ("src/main.ts", 1, 10, "import"),
    ("src/main.ts", 4, 27, "call"),
    ("src/store.ts", 4, 48, "call"),
)
def src_references(spark, sf_dir):
    wanted = spark.createDataFrame([("src/main.ts", "tally"), ("src/store.ts", "tally")], "file string, local string")
    return occurrences(files(spark), wanted).select("file", "line", F.col("column").alias("col"), "ref_kind")


@checked("file line form receiver cls", ("src/service.ts", 7, "field", "store", "Service"))
def src_member_uses(spark, sf_dir):
    return member_uses(files(spark), "put").select("file", "line", "form", "receiver", "cls")


@checked(
    "file cls a_file a_cls distance",
    ("src/service.ts", "Service", "src/service.ts", "Service", 0),
    ("src/store.ts", "Store", "src/store.ts", "Store", 0),
    ("src/store.ts", "MemoryStore", "src/store.ts", "MemoryStore", 0),
    ("src/store.ts", "MemoryStore", "src/store.ts", "Store", 1),
)
def src_heritage(spark, sf_dir):
    return engine(spark).ancestry.select("file", "cls", "a_file", "a_cls", "distance")


@checked(
    "caller outcome callee text",
    ("main", "in-repo", "tally", "tally"),
    ("main", "in-repo", "tally", "all.tally"),
    ("main", "in-repo", "constructor", "Service"),
    ("main", "in-repo", "save", "new Service(null as any).save"),
    ("put", "external", None, "this.items.set"),
    ("put", "in-repo", "tally", "tally"),
    ("tally", "in-repo", "again", "again"),
    ("again", "in-repo", "again", "again"),
    ("save", "external", None, "Error"),
    ("save", "in-repo", "put", "this.store.put"),
    ("save", "external", None, "report"),
)
def src_call_edges(spark, sf_dir):
    e = engine(spark)
    name = e.tables.functions.select("id", "name")
    edges = e.call_edges.join(name.withColumnsRenamed({"id": "caller", "name": "by"}), "caller")
    return edges.join(name.withColumnsRenamed({"id": "callee", "name": "to"}), "callee", "left").select(F.col("by").alias("caller"), "outcome", F.col("to").alias("callee"), "text")


@checked("name branches errors awaits", ("save", 2, 2, 1), ("tally", 1, 0, 0), ("grand", 1, 0, 0), ("total", 1, 0, 0))
def src_edge_cases(spark, sf_dir):
    return engine(spark).tables.functions.filter("branches + errors + awaits > 0").select("name", "branches", "errors", "awaits")


@checked("name depth", ("save", 0), ("put", 1), ("tally", 2), ("again", 3))
def src_call_closure(spark, sf_dir):
    e = engine(spark)
    edges = e.call_edges.filter("outcome = 'in-repo'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    f = e.tables.functions
    return graph.closure(edges, f.filter("name = 'save'").select("id"), 5).join(f.select("id", "name"), "id").select("name", "depth")


@checked("group_id id", ("src/left.ts", "src/left.ts"), ("src/left.ts", "src/right.ts"))
def src_cycles(spark, sf_dir):
    return graph.cycles(engine(spark).dep_edges)


@checked("file name score resembles", ("lib/copy.js", "grand", 0.72, "src/sum.ts#total"))
def src_clones(spark, sf_dir):
    prints = engine(spark).tables.fingerprints.withColumn("ref_ord", F.lit(0))
    found = similarity.best_reference(prints, prints.filter("file = 'src/sum.ts'"), 0.5, 10)
    return found.select("file", "name", "score", "resembles")


@checked("file symbol via", ("src/store.ts", "MemoryStore", "symbol"), ("src/service.ts", None, "import"), ("lib/copy.js", None, "path"))
def src_concept(spark, sf_dir):
    L = knowledge.Locator
    parts = (L("symbol", query="class *Store = implements"), L("import", of="toolkit"), L("path", glob="**/*.js"))
    return engine(spark).resolve(knowledge.Concept("c", "c", locators=parts)).select("file", "symbol", "via")


@checked("def_file def_name", ("src/store.ts", "tally"))
def src_export_names(spark, sf_dir):
    t = engine(spark)
    known = types_tier.exports(t.resolved, t.tables.functions, t.tables.table("types"), t.tables.table("exports"))
    return known.filter("file = 'src/index.ts' and name = 'count'").select("def_file", "def_name")


@checked("tool calls:long", ("find_def", 2), ("find_refs", 1), ("flow", 1))
def log_usage(spark, sf_dir):
    raw = spark.createDataFrame(list(enumerate(USAGE)), "line_no long, value string")
    return usage.by_tool(logs.usage(raw))


@checked("value calls:long", ("A", 2))
def log_top_symbols(spark, sf_dir):
    raw = spark.createDataFrame(list(enumerate(USAGE)), "line_no long, value string")
    return usage.top_values(logs.usage(raw), usage.string_arg(F.col("args"), "symbol"))


@checked("first_ts last_ts calls:long", ("1", "3", 4))
def log_span(spark, sf_dir):
    raw = spark.createDataFrame(list(enumerate(USAGE)), "line_no long, value string")
    return usage.first_last(logs.usage(raw), "line_no")


@checked("own:long grep:long search:long share_pct:long", (1, 3, 1, 25))
def log_adoption(spark, sf_dir):
    item = F.struct(F.lit("tool_use").alias("type"), F.col("name"), F.struct(F.col("command")).alias("input"))
    line = F.to_json(F.struct(F.struct(F.array(item).alias("content")).alias("message")))
    raw = spark.createDataFrame(CALLS, "name string, command string").select(F.monotonically_increasing_id().alias("line_no"), line.alias("value"))
    return usage.adoption(logs.timeline(raw, "own__"))


@checked("path glob hit", ("a/b.ts", "a/*.ts", True), ("a/b/c.ts", "a/*.ts", False), ("a/b/c.ts", "a/**", True), ("a/my-x.ts", "a/**x.ts", True), ("ab.ts", "a?.ts", True), ("a+b.ts", "a+b.ts", True))
def glob_matches(spark, sf_dir):
    cases = [("a/b.ts", "a/*.ts"), ("a/b/c.ts", "a/*.ts"), ("a/b/c.ts", "a/**"), ("a/my-x.ts", "a/**x.ts"), ("ab.ts", "a?.ts"), ("a+b.ts", "a+b.ts")]
    rows = [spark.createDataFrame([c], "path string, glob string").withColumn("hit", X.matches_glob(F.col("path"), c[1])) for c in cases]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
