"""Queries over a source tree written from the driver's part table: four files for some parts, one for every part.

A part's file imports the next part's function and class, by a relative path, one with a script extension, or an alias.
The SQL builds its rows from the table alone, by the rules of the language; it knows nothing of the parser.
"""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import OWN_PREFIX, Engine
from ..operators import graph, knowledge, modules, similarity, usage
from ..sources import logs
from ..sources.files import sources as only_sources
from ..sources.index import occurrences
from .relations import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PART_FILE = """import {{ work{t}, Unit{t} as Next }} from '{spec}';
export interface Shape{p} {{ area(): number; }}
export class Unit{p} implements Shape{p} {{
  constructor(private next: Next) {{}}
  area(): number {{ return work{p}({s}) + this.next.area(); }}
}}
export function work{p}(n: number): number {{
  if (n > {s}) {{ throw new Error('big'); }}
  return {body};
}}
export const LIMIT{p} = {s};
"""
ALIASES = [(0, "@parts/", True, ["src/parts/*"])]

# The parts, each with the next one's key (t) and whether that exists (n).
PARTS = """v AS (SELECT p.p_partkey AS p, p.p_partkey + 1 AS t, p.p_size AS s, q.p_partkey IS NOT NULL AS n, 'src/parts/p' || p.p_partkey || '.ts' AS file
  FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1)"""
FIRST = "(SELECT min(p_partkey) FROM part)"


def checked(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {sql}" if sql.startswith("t AS") else f"WITH {PARTS} {sql}"
        return f

    return put


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one where all runs in one process."""
    sc = spark.sparkContext
    shared_ = spark.conf.get("spark.checkpoint.dir", None)
    if not shared_ and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared_ or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filled(text: str, known: dict[str, F.Column]) -> F.Column:
    """A template with columns in the place of its names."""
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(text):
        pieces += [F.lit(literal)] * bool(literal) + ([known[name]] if name else [])
    return F.concat(*pieces)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the whole tree, by string expressions."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") + 1).alias("t"), F.col("p_size").alias("s"))
    spec = F.when(F.col("s") % 3 == 0, "./p").when(F.col("s") % 3 == 1, "./p").otherwise("@parts/p")
    spec = F.concat(spec, F.col("t").cast("string"), F.when(F.col("s") % 3 == 1, ".js").otherwise(""))
    known = {"p": F.col("p").cast("string"), "t": F.col("t").cast("string"), "s": F.col("s").cast("string"), "spec": spec}
    known["body"] = F.when(F.col("s") % 2 == 0, F.concat(F.lit("n > 1 ? work"), known["t"], F.lit("(n - 1) : missing"), known["p"], F.lit(".go()"))).otherwise(F.concat(F.lit("work"), known["t"], F.lit("(n - 1)")))

    def file(path: str, content: str, where: str = "true") -> DataFrame:
        return parts.filter(where).select(_filled(path, known).alias("path"), _filled(content, known).alias("content"))

    own = file("src/parts/p{p}.ts", PART_FILE)
    barrels = file("src/barrels/b{p}.ts", "export * from '../parts/p{p}';\nexport {{ work{p} as job{p} }} from '../parts/p{p}';\n", "p % 10 = 0")
    users = file("src/use/u{p}.ts", "import {{ work{p} }} from '../barrels/b{p}';\nexport const go{p} = () => work{p}({s});\n", "p % 10 = 0")
    skipped = file("src/types/p{p}.d.ts", "declare const hidden{p}: number;\n", "p % 7 = 0")
    return own.unionByName(barrels).unionByName(users).unionByName(skipped)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    aliases = spark.createDataFrame(ALIASES, "alias_ord int, prefix string, wildcard boolean, targets array<string>")
    # the concept file and the usage log are the driver's own; baselines are Spark's
    made = Engine(spark, files=tree(spark, sf_dir), home=tempfile.mkdtemp(prefix="codegraph-"), aliases=aliases, watch=False, baselines=folder(spark, "baselines"))
    made.sync()
    return made


_SHARED: dict[tuple[str, str, str], Engine] = {}


def shared(spark: SparkSession, sf_dir: str, make: Callable[[SparkSession, str], Engine] | None = None) -> Engine:
    """One engine per session and folder for all queries that only read it; its index and derived tables are made once."""
    make = make or engine
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _SHARED:
        _SHARED[key] = make(spark, sf_dir)
    return _SHARED[key]


def first_key(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0] or 0


# ---- the index


@checked("""SELECT file AS path, 'typescript' AS grammar FROM v UNION ALL SELECT 'src/barrels/b' || p || '.ts', 'typescript' FROM v WHERE p % 10 = 0 UNION ALL SELECT 'src/use/u' || p || '.ts', 'typescript' FROM v WHERE p % 10 = 0""")
def tree_listing(spark, sf_dir):
    return only_sources(tree(spark, sf_dir)).select("path", "grammar")


@checked("""SELECT file, 2 AS line, 'interface' AS kind, 'Shape' || p AS symbol, 'interface Shape' || p AS signature FROM v
UNION ALL SELECT file, 2, 'method', 'area', 'area(): number;' FROM v
UNION ALL SELECT file, 3, 'class', 'Unit' || p, 'class Unit' || p || ' implements Shape' || p FROM v
UNION ALL SELECT file, 5, 'method', 'area', 'area(): number' FROM v
UNION ALL SELECT file, 7, 'function', 'work' || p, 'function work' || p || '(n: number): number' FROM v
UNION ALL SELECT file, 11, 'constant', 'LIMIT' || p, 'export const LIMIT' || p || ' = ' || s || ';' FROM v
UNION ALL SELECT 'src/use/u' || p || '.ts', 2, 'function', 'go' || p, 'go' || p || ' = () => work' || p || '(' || s || ')' FROM v WHERE p % 10 = 0""")
def tree_defs(spark, sf_dir):
    return shared(spark, sf_dir).tables.defs.select("file", "line", "kind", "symbol", "signature")


@checked("""SELECT file, 'import' AS kind, CASE s % 3 WHEN 0 THEN './p' || t WHEN 1 THEN './p' || t || '.js' ELSE '@parts/p' || t END AS specifier, false AS star,
  'work' || t || '>work' || t || ',Unit' || t || '>Next' AS names, CASE WHEN n THEN 'src/parts/p' || t || '.ts' END AS target FROM v
UNION ALL SELECT 'src/barrels/b' || p || '.ts', 're-export', '../parts/p' || p, true, '', file FROM v WHERE p % 10 = 0
UNION ALL SELECT 'src/barrels/b' || p || '.ts', 're-export', '../parts/p' || p, false, 'work' || p || '>job' || p, file FROM v WHERE p % 10 = 0
UNION ALL SELECT 'src/use/u' || p || '.ts', 'import', '../barrels/b' || p, false, 'work' || p || '>work' || p, 'src/barrels/b' || p || '.ts' FROM v WHERE p % 10 = 0""")
def tree_imports(spark, sf_dir):
    """Imports and re-exports, resolved by relative paths, script extensions and a wildcard alias."""
    names = F.array_join(F.transform("names", lambda n: F.concat_ws(">", n["imported"], n["local"])), ",")
    return shared(spark, sf_dir).resolved.select("file", "kind", "specifier", "star", names.alias("names"), "target")


@checked("""SELECT 'work' || t AS symbol, 'src/parts/p' || t || '.ts' AS def_file, file FROM v WHERE n AND t % 10 = 0
UNION ALL SELECT 'work' || p, file, 'src/use/u' || p || '.ts' FROM v WHERE p % 10 = 0""")
def tree_importers(spark, sf_dir):
    e = shared(spark, sf_dir)
    targets = e.tables.defs.filter(r"symbol rlike '^work\\d*0$'").select("symbol", "file")
    return modules.importers(e.resolved, targets).select("symbol", "def_file", "file")


@checked("""SELECT 'area' AS caller, file, 'in-repo' AS outcome, 'work' || p AS callee, 'work' || p AS text FROM v
UNION ALL SELECT 'area', file, CASE WHEN n THEN 'in-repo' ELSE 'external' END, CASE WHEN n THEN 'area' END, 'this.next.area' FROM v
UNION ALL SELECT 'work' || p, file, 'external', NULL, 'Error' FROM v
UNION ALL SELECT 'work' || p, file, CASE WHEN n THEN 'in-repo' ELSE 'external' END, CASE WHEN n THEN 'work' || t END, 'work' || t FROM v
UNION ALL SELECT 'work' || p, file, 'unresolved', NULL, 'missing' || p || '.go' FROM v WHERE s % 2 = 0
UNION ALL SELECT 'go' || p, 'src/use/u' || p || '.ts', 'in-repo', 'work' || p, 'work' || p FROM v WHERE p % 10 = 0""")
def tree_calls(spark, sf_dir):
    e = shared(spark, sf_dir)
    f = e.tables.functions
    edges = e.call_edges.join(f.select(F.col("id").alias("caller"), F.col("name").alias("by"), "file"), "caller")
    named = edges.join(f.select(F.col("id").alias("callee"), F.col("name").alias("to")), "callee", "left")
    return named.select(F.col("by").alias("caller"), "file", "outcome", F.col("to").alias("callee"), "text")


@checked("SELECT 'work' || p AS name, 1 + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS branches, 1 AS errors, 0 AS awaits FROM v")
def tree_edge_cases(spark, sf_dir):
    return shared(spark, sf_dir).tables.functions.filter("branches + errors + awaits > 0").select("name", "branches", "errors", "awaits")


@checked("""SELECT file, 'Unit' || p AS cls, 'Unit' || p AS a_cls, 0 AS distance FROM v UNION ALL SELECT file, 'Shape' || p, 'Shape' || p, 0 FROM v
UNION ALL SELECT file, 'Unit' || p, 'Shape' || p, 1 FROM v""")
def tree_heritage(spark, sf_dir):
    return shared(spark, sf_dir).ancestry.select("file", "cls", "a_cls", "distance")


@checked("""SELECT file, line, ref_kind FROM (SELECT file, 5 AS line, 'call' AS ref_kind, p AS q FROM v UNION ALL SELECT file, 1, 'import', t FROM v WHERE n UNION ALL SELECT file, 9, 'call', t FROM v WHERE n
UNION ALL SELECT 'src/use/u' || p || '.ts', 1, 'import', p FROM v WHERE p % 10 = 0 UNION ALL SELECT 'src/use/u' || p || '.ts', 2, 'call', p FROM v WHERE p % 10 = 0) r""")
def tree_references(spark, sf_dir):
    """All references to all work functions, each in the files that can mean it."""
    e = shared(spark, sf_dir)
    d = e.tables.defs.filter("symbol like 'work%'").select("symbol", "file")
    users = modules.importers(e.resolved, d).select("file", "local")
    return occurrences(e.files, d.select("file", F.col("symbol").alias("local")).unionByName(users).distinct(), e.parts).select("file", "line", "ref_kind")


@checked("""SELECT 'src/parts/p' || p || '.ts' AS id, (CASE WHEN EXISTS (SELECT 1 FROM v w WHERE w.t = v.p) THEN 1 ELSE 0 END + CASE WHEN p % 10 = 0 THEN 1 ELSE 0 END) AS in_degree, CASE WHEN n THEN 1 ELSE 0 END AS out_degree FROM v
WHERE n OR p % 10 = 0 OR EXISTS (SELECT 1 FROM v w WHERE w.t = v.p)
UNION ALL SELECT 'src/barrels/b' || p || '.ts', 1, 1 FROM v WHERE p % 10 = 0 UNION ALL SELECT 'src/use/u' || p || '.ts', 0, 1 FROM v WHERE p % 10 = 0""")
def tree_hubs(spark, sf_dir):
    return graph.hubs(shared(spark, sf_dir).dep_edges).select("id", F.col("in_degree").cast("int").alias("in_degree"), F.col("out_degree").cast("int").alias("out_degree"))


@checked("SELECT file, 'work' || p AS name, 7 AS line, s % 2 = 0 AS even FROM v")
def tree_fingerprints(spark, sf_dir):
    """Functions over the size floor and whether they have the shape of the even ones: a body's names and numbers don't matter, its form does."""
    p = shared(spark, sf_dir).tables.fingerprints.filter("name like 'work%'")
    longest = p.agg(F.max("token_count")).first()[0]
    return p.select("file", "name", "line", (F.col("token_count") == longest).alias("even"))


@checked(f"""SELECT w.file, 'work' || w.p AS name, 1.0::DOUBLE AS score, 'src/parts/p' || m.p || '.ts#work' || m.p AS resembles FROM v w, v m
WHERE m.p = {FIRST} AND w.p <> m.p AND w.s % 2 = m.s % 2 ORDER BY w.file LIMIT 20""")
def tree_clones(spark, sf_dir):
    """The first twenty functions that are built like the first part's."""
    p = shared(spark, sf_dir).tables.fingerprints.filter("name like 'work%'").withColumn("ref_ord", F.lit(0))
    file = f"src/parts/p{first_key(spark, sf_dir)}.ts"
    return similarity.best_reference(p, p.filter(F.col("file") == file), 1.0, 20).select("file", "name", "score", "resembles")


# ---- receivers: one file for every part, whose types depend on its size

TYPED_FILE = """export class A{p} {{ save() {{ return 1; }} }}
export class B{p} {{ save() {{ return 2; }} }}
export class Box{p}<T> {{ constructor(private held: T) {{}} get(): T {{ return this.held; }} all(): T[] {{ return [this.held]; }} }}
export class Crate{p} extends Box{p}<{kind}{p}> {{ first() {{ this.get().save(); }} }}
export function pick{p}(x: number): A{p};
export function pick{p}(x: string): B{p};
export function pick{p}(x: any): any {{ return x; }}
export function same{p}<T>(x: T): T {{ return x; }}
export function shadow{p}(r: A{p}, list: {kind}{p}[], by: Map<string, B{p}>) {{
  r.save();
  for (const r of list) {{ r.save(); }}
  list.forEach(r => r.save());
  {{ const r = outside(); r.save(); }}
  by.forEach((r, key) => r['save']());
  try {{ r.save(); }} catch (r) {{ r.save(); }}
}}
export function loose{p}(r) {{ r.save(); }}
export function boxed{p}(b: Box{p}<{kind}{p}>, c: Crate{p}, d: Box{p}<Box{p}<A{p}>>) {{ b.get().save(); c.get().save(); d.all()[0].get().save(); }}
export function chosen{p}() {{ pick{p}({value}).save(); same{p}(new {kind}{p}()).save(); }}
"""


def typed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p"), F.col("p_size").alias("s"))
    known = {"p": F.col("p"), "kind": F.when(F.col("s") % 2 == 0, "A").otherwise("B"), "value": F.when(F.col("s") % 3 == 0, F.lit("'x'")).otherwise(F.col("s").cast("string"))}
    return parts.select(_filled("src/typed/t{p}.ts", known).alias("path"), _filled(TYPED_FILE, known).alias("content"))


def typed_engine(spark: SparkSession, sf_dir: str) -> Engine:
    made = Engine(spark, files=typed_tree(spark, sf_dir), home=tempfile.mkdtemp(prefix="codegraph-"), watch=False)
    made.sync()
    return made


def saves(*callers: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, caller, call_ord, outcome, callee): the calls of save in functions of these names."""
    e = shared(spark, sf_dir, typed_engine)
    f = e.tables.functions
    edges = e.call_edges.join(f.select(F.col("id").alias("caller"), F.regexp_replace("name", r"\d+$", "").alias("by"), "file"), "caller").filter(F.col("by").isin(*callers) & F.col("text").rlike(r"save('\])?$"))
    named = edges.join(f.select(F.col("id").alias("callee"), F.concat_ws(".", F.regexp_replace("cls", r"\d+$", ""), "name").alias("to")), "callee", "left")
    return named.select("file", F.col("by").alias("caller"), "call_ord", "outcome", F.col("to").alias("callee"))


TYPED = "t AS (SELECT 'src/typed/t' || p_partkey || '.ts' AS file, CASE WHEN p_size % 2 = 0 THEN 'A.save' ELSE 'B.save' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'B.save' ELSE 'A.save' END AS picked FROM part)"
IN, OUT = "'in-repo' AS outcome", "'unresolved' AS outcome, NULL AS callee"


@checked(f"""{TYPED} SELECT file, 'shadow' AS caller, o AS call_ord, CASE WHEN what = 'none' THEN 'unresolved' ELSE 'in-repo' END AS outcome,
  CASE what WHEN 'kind' THEN kind WHEN 'A' THEN 'A.save' WHEN 'B' THEN 'B.save' END AS callee
FROM t, (VALUES (0, 'A'), (1, 'kind'), (3, 'kind'), (5, 'none'), (7, 'B'), (8, 'A'), (9, 'none')) x (o, what) UNION ALL SELECT file, 'loose', 0, {OUT} FROM t""")
def tree_scopes(spark, sf_dir):
    """One name declared in seven places: each use means the nearest, and nothing where that has no type."""
    return saves("shadow", "loose", spark=spark, sf_dir=sf_dir)


@checked(f"""{TYPED} SELECT file, 'boxed' AS caller, 0 AS call_ord, {IN}, kind AS callee FROM t UNION ALL SELECT file, 'boxed', 2, {IN}, kind FROM t
UNION ALL SELECT file, 'boxed', 4, {IN}, 'A.save' FROM t UNION ALL SELECT file, 'first', 0, {IN}, kind FROM t""")
def tree_generics(spark, sf_dir):
    """Members of type parameters: of a type with arguments, of a class that extends one, and nested."""
    return saves("boxed", "first", spark=spark, sf_dir=sf_dir)


@checked(f"""{TYPED} SELECT file, 'chosen' AS caller, 0 AS call_ord, {IN}, picked AS callee FROM t UNION ALL SELECT file, 'chosen', 2, {IN}, kind FROM t""")
def tree_overloads(spark, sf_dir):
    """Results of the first signature that takes the argument, and of a function's own type parameter."""
    return saves("chosen", spark=spark, sf_dir=sf_dir)


# ---- the tools


def _rows(spark: SparkSession, rows: list, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], columns)


@checked(f"SELECT file, 7 AS line, 'function' AS kind, 'work' || p AS symbol FROM v WHERE p = {FIRST}")
def tool_find_def(spark, sf_dir):
    return _rows(spark, shared(spark, sf_dir).find_def(f"work{first_key(spark, sf_dir)}").rows, "file string, line int, kind string, symbol string")


@checked(f"""SELECT file, 5 AS line, 'call' AS ref_kind, file AS def_file, 7 AS def_line FROM v WHERE p = {FIRST} + 1
UNION ALL SELECT file, 1, 'import', 'src/parts/p' || t || '.ts', 7 FROM v WHERE p = {FIRST} AND n UNION ALL SELECT file, 9, 'call', 'src/parts/p' || t || '.ts', 7 FROM v WHERE p = {FIRST} AND n""")
def tool_find_refs(spark, sf_dir):
    found = shared(spark, sf_dir).find_refs(f"work{first_key(spark, sf_dir) + 1}").rows
    return _rows(spark, found, "file string, line int, ref_kind string, def_file string, def_line int")


@checked("""SELECT file, 5 AS line, 'call' AS ref_kind, 'src/parts/p' || t || '.ts' AS def_file, 5 AS def_line FROM v WHERE n""")
def tool_find_member_refs(spark, sf_dir):
    """References to a method through receivers of declared types."""
    refs, _ = shared(spark, sf_dir).member_refs("area")
    return refs.select("file", "line", "ref_kind", "def_file", "def_line")


@checked("""SELECT id, in_degree FROM (SELECT file AS id, CASE WHEN EXISTS (SELECT 1 FROM v w WHERE w.t = v.p) THEN 1 ELSE 0 END + CASE WHEN p % 10 = 0 THEN 1 ELSE 0 END AS in_degree FROM v
  UNION ALL SELECT 'src/barrels/b' || p || '.ts', 1 FROM v WHERE p % 10 = 0) d ORDER BY in_degree DESC, id LIMIT 15""")
def tool_dep_graph(spark, sf_dir):
    return _rows(spark, shared(spark, sf_dir).dep_graph().rows, "id string, in_degree long").withColumn("in_degree", F.col("in_degree").cast("int"))


@checked(f"SELECT 'work' || p AS symbol FROM v WHERE p BETWEEN {FIRST} AND {FIRST} + 5")
def tool_call_graph(spark, sf_dir):
    """Five levels of calls from the first part's function: a chain through the parts."""
    found = shared(spark, sf_dir).call_graph(f"work{first_key(spark, sf_dir)}").rows
    return spark.createDataFrame([(n.symbol,) for n in found], "symbol string")


@checked(f"""SELECT count(*) AS functions, (sum(1 + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) FILTER (WHERE p < {FIRST} + 5))::BIGINT AS branches,
  count(*) FILTER (WHERE p < {FIRST} + 5) AS errors, 0::BIGINT AS awaits FROM v WHERE p BETWEEN {FIRST} AND {FIRST} + 5""")
def tool_flow(spark, sf_dir):
    """The sums of a flow five calls deep; the function at the cut is counted, its body is not read."""
    total = shared(spark, sf_dir).flow(f"work{first_key(spark, sf_dir)}", depth=5).data["rollup"]
    return spark.createDataFrame([tuple(total[k] for k in ("functions", "branches", "errors", "awaits"))], "functions long, branches long, errors long, awaits long")


def _concept(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    rule = {"title": "in parts ending in one", "locators": [{"kind": "path", "glob": "**/p*1.ts"}]}
    e.arch_assert("shapes", "Shapes", locators=[{"kind": "symbol", "query": "interface Shape*"}], must=rule)
    return e


@checked("SELECT count(*) AS total, count(*) FILTER (WHERE p % 10 = 1) AS conforming FROM v")
def tool_arch_query(spark, sf_dir):
    """A concept asserted, kept in its file, read again and checked against its rule."""
    rule = _concept(spark, sf_dir).arch_query("shapes").data["conformance"]
    return spark.createDataFrame([(rule["total"], rule["conforming"])], "total long, conforming long")


@checked("SELECT 'symbol' AS via, 'src/parts/p' || p || '.ts' AS file, 'Shape' || p AS symbol FROM v")
def tool_arch_members(spark, sf_dir):
    e = _concept(spark, sf_dir)
    return e.resolve(e.concepts()["shapes"]).select("via", "file", "symbol")


@checked("""SELECT 'src/parts/p' || p || '.ts#Shape' || p AS key, CASE WHEN p % 4 = 0 THEN 'removed' ELSE 'changed' END AS change FROM v WHERE p % 4 = 0 OR p % 4 = 1
UNION ALL SELECT 'src/parts/p' || p || '.ts#ShapeNew' || p, 'added' FROM v WHERE p % 4 = 0""")
def tool_drift(spark, sf_dir):
    """A baseline captured in its store, the tree edited, and the drift of the concept's members since."""
    e = _concept(spark, sf_dir)
    c = e.concepts()["shapes"]
    e.capture("shapes", knowledge.anchors(e.resolve(c)))
    before = graph.cut_lineage(e.baseline("shapes"))
    key = F.regexp_extract("path", r"p(\d+)\.ts$", 1).try_cast("int")
    renamed = F.regexp_replace("content", "interface Shape", "interface ShapeNew")
    longer = F.regexp_replace("content", r"interface (Shape\d+) ", "interface $1 extends Base ")
    e._table = e._table.withColumn("content", F.when(key % 4 == 0, renamed).when(key % 4 == 1, longer).otherwise(F.col("content")))
    e.sync()
    return knowledge.drift(before, knowledge.anchors(e.resolve(c)))


@checked("SELECT * FROM (VALUES ('find_def', 2::BIGINT), ('dep_graph', 1::BIGINT)) x (tool, calls)")
def tool_stats(spark, sf_dir):
    """Calls recorded in the usage log, read back by the report."""
    e = engine(spark, sf_dir)
    e.find_def("work1")
    e.find_def("work2")
    e.dep_graph()
    return _rows(spark, e.stats().data["by_tool"], "tool string, calls long")


@checked("SELECT 'src/barrels/b' || p || '.ts' AS path FROM v WHERE p = (SELECT min(p_partkey) FROM part WHERE p_partkey % 10 = 0)")
def tool_precision(spark, sf_dir):
    """Files that a word search finds and the reference search leaves out: the barrel only hands the name on."""
    q = read(spark, sf_dir, "part").filter("p_partkey % 10 = 0").agg(F.min("p_partkey")).first()[0] or 0
    return spark.createDataFrame([(x,) for x in shared(spark, sf_dir).precision_report(f"work{q}").data["excluded"]], "path string")


@checked("SELECT 'shapes' AS id, 'Shapes' AS title, count(*) AS members, 'fresh' AS state FROM v")
def tool_arch_list(spark, sf_dir):
    """A concept that was asserted, with its size and how it stands to its baseline."""
    return spark.createDataFrame(_concept(spark, sf_dir).arch_list().rows, "id string, title string, members long, state string")


@checked(f"""SELECT w.file, 'work' || w.p AS name, 1.0::DOUBLE AS score, m.file || '#work' || m.p AS resembles, w.p % 10 <> 1 AS violates FROM v w, v m
WHERE m.p = {FIRST} AND w.p <> m.p AND w.s % 2 = m.s % 2 ORDER BY w.file LIMIT 20""")
def tool_arch_candidates(spark, sf_dir):
    """Functions built like the one of a concept, the first twenty of the best, and whether they lie outside its rule."""
    e = engine(spark, sf_dir)
    p = first_key(spark, sf_dir)
    rule = {"title": "in parts ending in one", "locators": [{"kind": "path", "glob": "**/p*1.ts"}]}
    e.arch_assert("worker", "Worker", locators=[{"kind": "symbol", "query": f"function work{p}"}], must=rule)
    found = [r for r in e.arch_candidates("worker", 1.0, 50).rows if r.name.startswith("work")][:20]
    return _rows(spark, found, "file string, name string, score double, resembles string, violates boolean")


# ---- logs, written from the events


def _logged(spark: SparkSession, sf_dir: str, line: F.Column) -> DataFrame:
    """Lines of a log file, in order of the events, among them a blank and a broken one for every seventh."""
    events = read(spark, sf_dir, "events").select("event_id", line.alias("value"))
    odd = events.filter("event_id % 7 = 0").select("event_id", F.explode(F.array(F.lit(""), F.lit("{broken"), F.lit("[1]"))).alias("value"))
    at = folder(spark, "log")
    events.unionByName(odd).orderBy("event_id", "value").select("value").write.text(at)
    return logs.lines(spark, at)


@checked("""SELECT event_type AS tool, count(*) AS calls, min(event_id) AS least, max(event_id) AS most FROM events GROUP BY 1""")
def log_usage(spark, sf_dir):
    """Calls by tool from a usage log of one line an event; lines that are no calls are passed over."""
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("tool"), F.struct(F.col("event_id").alias("id")).alias("args")))
    calls = logs.usage(_logged(spark, sf_dir, line)).withColumn("id", F.try_variant_get("args", "$.id", "long"))
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.min("id").alias("least"), F.max("id").alias("most"))


@checked("""SELECT count(*) FILTER (WHERE event_id % 4 = 0) AS own, count(*) FILTER (WHERE event_id % 4 = 1) AS grep,
  floor(100.0 * count(*) FILTER (WHERE event_id % 4 = 0) / count(*) FILTER (WHERE event_id % 4 < 2) + 0.5)::INT AS share_pct FROM events""")
def log_adoption(spark, sf_dir):
    """Own calls and text searches in a transcript of one tool call an event."""
    e = F.col("event_id") % 4
    name = F.when(e == 0, OWN_PREFIX + "find_refs").when(e == 1, "Grep").when(e == 2, "Bash").otherwise("Read")
    use = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), F.struct(F.lit("ls -l").alias("command")).alias("input"))
    line = F.to_json(F.struct(F.struct(F.array(use).alias("content")).alias("message")))
    found = usage.adoption(logs.timeline(_logged(spark, sf_dir, line), OWN_PREFIX))
    return found.select("own", "grep", F.col("share_pct").cast("int").alias("share_pct"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
