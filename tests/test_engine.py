"""The engine over small source trees: lookup, references, graphs, concepts, incremental sync."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codegraph.engine import Engine, latest_transcript
from codegraph.functions.exprs import shingles
from codegraph.operators.knowledge import LocatorError, parse_symbol_query
from codegraph.sources import files, vocab
from codegraph.sources.frontend import File
from codegraph.sources.index import Tables, parse_files
from codegraph.sources.lexer import Lexer

TREE = {
    "tsconfig.json": '{ // config\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"], "@core": ["src/core.ts"],}}, "include": ["src"] }',
    "src/repo.ts": "export interface IRepo { save(n: number): number; }\nexport class Repo implements IRepo {\n  save(n: number): number { return helper(n); }\n}\nexport function helper(n: number): number { return n > 0 ? n : recur(n); }\nfunction recur(n: number): number { return recur(n - 1); }\n",
    "src/index.ts": "export * from './repo';\n",
    "src/service.ts": "import { IRepo } from './repo';\nexport class Service {\n  constructor(private repo: IRepo) {}\n  async run(x: number) {\n    if (x) { throw new Error('x'); }\n    try { await this.repo.save(Math.max(x, 0)); } catch (e) { mystery.go(); }\n    return x ? 1 : 2;\n  }\n}\n",
    "src/app.ts": "import { helper as h } from '@app/index';\nimport { Service } from './service.js';\nexport const app = () => h(1) + new Service(null as any).run(2);\n",
    "src/other.ts": "class Repo {}\nexport const made = new Repo();\n",
    "src/x.ts": "import { y } from './y';\nexport const x = () => y;\n",
    "src/y.ts": "import { x } from './x';\nexport const y = () => x;\n",
    "src/legacy.js": "import { helper } from './repo.js';\nexport function old() { return helper(3); }\n",
    "src/types.d.ts": "declare const z: number;\n",
    "node_modules/lib/a.ts": "export const lib = 1;\n",
    ".hidden/b.ts": "export const b = 1;\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    return root


def write(root, contents):
    for path, text in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine(spark, str(tree))


def test_discovery_skips_declarations_packages_and_dotted_folders(tree):
    assert [p for p, _, _ in files.discover(str(tree))] == ["src/app.ts", "src/index.ts", "src/legacy.js", "src/other.ts", "src/repo.ts", "src/service.ts", "src/x.ts", "src/y.ts"]


def test_configuration(tree):
    assert files.alias_rows(str(tree)) == [(0, "@app/", True, ["src/*"]), (1, "@core", False, ["src/core.ts"])]
    assert files.project_of(str(tree), "src/app.ts") == "tsconfig.json" and files.project_of(str(tree), "lib/a.ts") is None
    assert json.loads(files.strip_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // d\n}')) == {"a": "//x", "b": [1, 2]}


def test_find_def_and_suggestions(engine):
    assert [(r.file, r.line, r.kind) for r in engine.find_def("Repo").rows] == [("src/other.ts", 1, "class"), ("src/repo.ts", 2, "class")]
    assert [r.file for r in engine.find_def("Repo", "**/repo.ts").rows] == ["src/repo.ts"]
    assert [r.symbol for r in engine.find_def("serv").data["suggestions"]] == ["Service"]
    assert engine.find_def("zz").data["suggestions"] == []
    assert engine.find_def("run").rows[0].signature == "async run(x: number)"


def test_find_refs_follows_barrels_aliases_and_scripts(engine):
    refs = {(r.file, r.ref_kind) for r in engine.find_refs("helper").rows}
    assert refs == {("src/app.ts", "import"), ("src/app.ts", "call"), ("src/legacy.js", "import"), ("src/legacy.js", "call"), ("src/repo.ts", "call")}
    own = {(r.file, r.line, r.def_file) for r in engine.find_refs("Repo").rows}
    assert own == {("src/other.ts", 2, "src/other.ts")}
    assert engine.find_refs("nothing").text.startswith("No definition")


def test_method_refs_use_receiver_types(engine):
    a = engine.find_refs("save")
    assert a.data["tier"] == "type-resolved" and [(r.file, r.ref_kind, r.def_file) for r in a.rows] == [("src/service.ts", "call", "src/repo.ts")]


def test_dep_graph(engine):
    nodes = {r.id: (r.in_degree, r.out_degree) for r in engine.dep_graph().data["nodes"].collect()}
    assert nodes["src/repo.ts"] == (3, 0) and nodes["src/app.ts"] == (0, 2)
    assert engine.dep_graph(cycles=True).data["cycles"] == [["src/x.ts", "src/y.ts"]]
    near = engine.dep_graph(focus="src/service.ts")
    assert {(e.src, e.dst) for e in near.data["edges"]} == {("src/service.ts", "src/repo.ts"), ("src/app.ts", "src/service.ts")}
    assert "imported by src/app.ts" in near.text
    with pytest.raises(ValueError):
        engine.dep_graph(depth=3)


def test_call_graph_dispatches_to_implementations(engine):
    a = engine.call_graph("run")
    names = [n.symbol for n in a.rows]
    assert names == ["run", "save", "helper", "recur"]
    root = a.data["tree"]
    assert (root.external, root.unresolved) == (2, 1)
    assert root.children[0].children[0].children[0].children[0].recursion
    shallow = engine.call_graph("run", depth=1)
    assert [n.symbol for n in shallow.rows] == ["run", "save"] and shallow.data["tree"].children[0].truncated


def test_flow_counts_edge_cases(engine):
    a = engine.flow("run")
    root = a.data["tree"]
    assert (root.branches, root.errors, root.awaits) == (2, 2, 1)
    assert a.data["rollup"]["branches"] == 3 and a.data["rollup"]["awaits"] == 1


def test_calls_through_defaults_and_renamed_exports(spark, tmp_path):
    rows = [
        ("d.ts", "export default class Job { run() { return step(); } }\nfunction step() { return 1; }\nfunction inner() { return step(); }\nexport { inner as outer };\n"),
        ("m.ts", "import Task, { outer } from './d';\nexport function main() { new Task().run(); return outer(); }\n"),
        ("e.js", "const f = () => 1;\nexport default f;\n"), ("g.js", "import any from './e';\nexport function go() { return any(); }\n"),
    ]
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    assert [n.symbol for n in e.call_graph("main").rows] == ["main", "run", "step", "inner"]
    assert [n.symbol for n in e.call_graph("go").rows] == ["go", "f"]


def test_no_project_means_no_call_graph(spark, tmp_path):
    write(tmp_path, {"a.ts": "export function f() { g(); }\nfunction g() {}\n"})
    e = Engine(spark, str(tmp_path))
    assert "configuration" in e.call_graph("f").text
    assert e.call_graph("nope").text == "No function nope."


def test_sync_is_incremental_and_equals_a_rebuild(spark, tmp_path):
    write(tmp_path, {"a.ts": "export class A {}\n", "b.ts": "export class A {}\nexport class B {}\n"})
    e = Engine(spark, str(tmp_path))
    s = e.sync()
    assert (s["file_count"], s["symbol_count"], s["changed"], s["removed"]) == (2, 3, 2, 0)
    (tmp_path / "a.ts").unlink()
    (tmp_path / "b.ts").write_text("export class Changed {}\n")
    os.utime(tmp_path / "b.ts", (1, 1))
    s = e.sync()
    assert (s["file_count"], s["symbol_count"], s["changed"], s["removed"]) == (1, 1, 1, 1)
    assert e.sync()["changed"] == 0
    assert e.tables.defs.collect() == Engine(spark, str(tmp_path)).tables.defs.collect()


def test_engine_over_a_table(spark, tmp_path):
    rows = [(p, t) for p, t in TREE.items() if p.endswith(("ts", "js"))]
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    assert {r.file for r in e.find_refs("helper").rows} >= {"src/legacy.js", "src/repo.ts"}
    assert [n.symbol for n in e.call_graph("run").rows][:2] == ["run", "save"]


def test_saved_index_answers_alike(spark, tree, engine, tmp_path):
    engine.sync()
    engine.save(str(tmp_path / "index"))
    saved = Engine(spark, str(tree), home=str(tmp_path), index=str(tmp_path / "index"))
    assert saved.sync()["symbol_count"] == engine.sync()["symbol_count"]
    for ask in (lambda e: e.find_def("Repo"), lambda e: e.find_refs("helper"), lambda e: e.dep_graph(), lambda e: e.call_graph("run")):
        assert ask(saved).text == ask(engine).text
    plan = saved.tables.defs.filter("symbol = 'Repo'")._jdf.queryExecution().toString()
    assert "EqualTo(symbol,Repo)" in plan


CLONE = "export function total(items: number[]) {\n  let sum = 0;\n  for (const item of items) {\n    if (item > 3) { sum += item * 2; } else { sum -= item; }\n  }\n  return sum;\n}\n"


def test_concepts_drift_conformance_and_candidates(spark, tmp_path):
    other = CLONE.replace("total", "grand").replace("item", "row").replace("sum", "acc")
    write(tmp_path, {"lib/sum.ts": CLONE, "a/one.ts": "import { total } from '@lib/sum';\nexport interface IOne {}\n", "a/two.ts": "import { total } from '@lib/sum/x';\nexport interface ITwo {}\n", "b/copy.ts": other, "b/three.ts": "export interface IThree {}\n"})
    e = Engine(spark, str(tmp_path))
    assert "nothing was written" in e.arch_assert("empty", "Empty").text
    must = {"title": "imports sum", "locators": [{"kind": "import", "of": "@lib/sum"}]}
    a = e.arch_assert("ifaces", "Interfaces", locators=[{"kind": "symbol", "query": "interface I*"}], must=must)
    assert a.data["state"] == "captured" and a.data["conformance"] == {"total": 3, "conforming": 2, "violations": ["b/three.ts"]}
    assert e.arch_query("ifaces").data["state"] == "fresh"
    write(tmp_path, {"b/four.ts": "export interface IFour {}\n", "a/two.ts": "import { total } from '@lib/sum/x';\nexport interface ITwo<T> {}\n"})
    d = e.arch_query("ifaces")
    assert {(r.key, r.change) for r in d.data["drift"]} == {("b/four.ts#IFour", "added"), ("a/two.ts#ITwo", "changed")}
    assert e.arch_list().rows[0][3] == "drifted"
    assert e.arch_query("ifaces", reaccept=True).data["state"] == "accepted"
    assert e.arch_query("ifaces").data["state"] == "fresh"
    e.arch_assert("sums", "Sums", locators=[{"kind": "import", "of": "@lib/sum"}])
    c = e.arch_candidates("sums")
    assert [(r.file, r.name, r.score) for r in c.rows] == [("b/copy.ts", "grand", 1.0)]
    e.arch_assert("sums", "Sums", locators=[{"kind": "import", "of": "@lib/sum"}, {"kind": "path", "glob": "b/**"}])
    assert e.arch_candidates("sums").rows == []
    assert e.arch_query("missing").text == "No concept missing. Known: ifaces, sums."
    e.arch_assert("bad", "Bad", locators=[{"kind": "symbol", "query": "nonsense"}])
    assert "error" in e.arch_query("bad").data and "error" in e.arch_list().rows[2][3]
    s = e.stats()
    assert s.data["concepts"] == {"total": 3, "with_must": 1, "flows": 0} and s.data["baselines"] == ["ifaces", "sums"]
    assert {r.tool for r in s.data["by_tool"]} >= {"arch_query", "arch_assert"} and s.data["top_concepts"][0].value == "ifaces"


def test_flow_concepts_drift_by_membership(spark, tmp_path):
    write(tmp_path, {"tsconfig.json": "{}", "m.ts": "export function a() { b(); }\nfunction b() { c(); }\nfunction c() {}\nfunction d() {}\n"})
    e = Engine(spark, str(tmp_path))
    assert e.arch_assert("f", "F", flow={"entry": "a"}).data["state"] == "captured"
    assert e.arch_list().rows == [("f", "F", None, "recorded")]
    write(tmp_path, {"m.ts": "export function a() { b(); }\nfunction b() { c(); d(); }\nfunction c() {}\nfunction d() {}\n"})
    assert [(r.key, r.change) for r in e.arch_query("f").data["drift"]] == [("m.ts#d", "added")]


def test_vocabulary(tmp_path):
    path = tmp_path / "v.yaml"
    assert vocab.load(str(path)) == {}
    path.write_text("concepts:\n  on:\n    stages: [{kind: path, glob: 'a/**', title: yes}]\n    note: n\n")
    c = vocab.load(str(path))["on"]
    assert c.title == "on" and c.stages[0].title == "yes" and c.note == "n"
    for bad in ("concepts: 3\n", "concepts: {a: {locators: [{kind: shell}]}}\n", "concepts: {a: {flow: {}}}\n", "concepts: {a: {locators: [{kind: path}]}}\n"):
        path.write_text(bad)
        with pytest.raises(LocatorError):
            vocab.load(str(path))
    assert parse_symbol_query("const A* = x = y") == ("constant", "A*", "x = y")
    with pytest.raises(LocatorError):
        parse_symbol_query("class")


def test_extraction_of_forms():
    f = File("a.ts", "export function p<T extends { id: string }>(x: { a: number }): void {}\nexport const c = { a: 1 };\nexport type R<T> = { ok: true };\nexport abstract class K { abstract r(): void; constructor() {} }\nexport namespace G { export const PI = 3; }\ndeclare function amb(x: number): void;\n", "typescript")
    assert {d["symbol"]: d["kind"] for d in f.defs()} == {"p": "function", "c": "constant", "R": "type", "K": "class", "r": "method", "G": "module", "PI": "constant", "amb": "function"}
    assert f.defs()[0]["signature"] == "function p<T extends { id: string }>(x: { a: number }): void" and f.errors == 0
    broken = File("b.ts", "const = ;;; ) } function ok() {} class { \n export class Fine {}\n", "typescript")
    assert "ok" in {d["symbol"] for d in broken.defs()} and broken.errors
    jsx = File("c.tsx", "export const V = () => <A b={1}>don't {xs.map(x => <i key={x}/>)} <></></A>;\nexport const after = 1;\n", "tsx")
    assert {d["symbol"] for d in jsx.defs()} == {"V", "after"} and jsx.errors == 0


def test_transcripts(tmp_path):
    (tmp_path / "-w-proj").mkdir()
    (tmp_path / "-w-proj" / "a.jsonl").write_text("{}")
    assert latest_transcript(str(tmp_path), "/w/proj").endswith("a.jsonl")
    assert latest_transcript(str(tmp_path), "/else/proj").endswith("a.jsonl") and latest_transcript(str(tmp_path), "/q/none") is None


def test_chains_of_re_exports_and_heritage_have_no_limit(spark, tmp_path):
    rows = [("b0.ts", "export function deep() { return 1; }\n"), *[(f"b{i}.ts", f"export * from './b{i - 1}';\n") for i in range(1, 8)], ("use.ts", "import { deep } from './b7';\nexport function go() { return deep(); }\n")]
    classes = ["class C0 { low() { return 1; } }"] + [f"class C{i} extends C{i - 1} {{}}" for i in range(1, 17)]
    rows.append(("tower.ts", "\n".join(classes) + "\nexport function top(c: C16) { return c.low(); }\n"))
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    assert [n.symbol for n in e.call_graph("go").rows] == ["go", "deep"]
    assert [n.symbol for n in e.call_graph("top").rows] == ["top", "low"]
    assert e.ancestry.filter("cls = 'C16'").count() == 17


def test_receivers_known_by_returns_casts_and_chains(spark, tmp_path):
    rows = [
        ("repo.ts", "export class Row { drop() {} }\nexport class Repo {\n  save(): this { return this; }\n  first(): Promise<Row> { return null as any; }\n  all() { return new Row(); }\n}\n"),
        ("ctx.ts", "import { Repo } from './repo';\nexport interface Ctx { repo: Repo }\nexport class Base { protected repo: Repo; }\nexport const open = (): Repo => new Repo();\n"),
        ("use.ts", "import { open, Ctx, Base } from './ctx';\nimport { Repo } from './repo';\n"
         "export async function a() { const r = open(); const row = await r.save().first(); row.drop(); }\n"
         "export function b(x: unknown) { (x as Repo).all().drop(); }\n"
         "export function c(ctx: Ctx) { ctx.repo.save(); const k = ctx.repo; k.all(); }\n"
         "export class D extends Base { go() { this.repo.save(); return other().save(); } }\n"
         "function other() { const r = new Repo(); return r; }\n"),
    ]
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    assert [n.symbol for n in e.call_graph("a").rows] == ["a", "open", "first", "save", "drop"]
    assert [n.symbol for n in e.call_graph("b").rows] == ["b", "drop", "all"]
    assert [n.symbol for n in e.call_graph("c").rows] == ["c", "save", "all"]
    assert [(r.file, r.line) for r in e.find_refs("drop").rows] == [("use.ts", 3), ("use.ts", 4)]
    d = e.call_graph("go")
    assert [n.symbol for n in d.rows] == ["go", "save", "other"] and d.data["tree"].unresolved == 1


def test_receivers_mean_the_nearest_declaration(spark, tmp_path):
    """Shadowed names, elements, callbacks, type arguments, overloads, brackets and default imports."""
    rows = [
        ("repo.ts", "export default class Repo { save() {} }\nexport class Other { save() {} }\nexport class Box<T> { get(): T { return null as any; } each(): T[] { return []; } }\nexport class Pair<A, B> extends Box<B> { left(): A { return null as any; } }\n"),
        ("use.ts", "import Repo, { Other, Box, Pair } from './repo';\n"
         "function typed(r: Repo) { r.save(); }\n"
         "function loop(list: Other[]) { for (const r of list) r.save(); }\n"
         "function bare(r) { r.save(); }\n"
         "function back(xs: Other[], bag: Set<Repo>) { xs.forEach(r => r.save()); bag.forEach(function (r) { r.save(); }); xs.filter(x => x).find(o => o.save()).save(); }\n"
         "function boxed(b: Box<Repo>, p: Pair<Repo, Box<Other>>, q: Box) { b.get().save(); p.left().save(); p.get().get().save(); p.each()[0].get().save(); q.get().save(); }\n"
         "function pick(x: number): Repo;\nfunction pick(x: string, y?: number): Other;\nfunction pick(x: any): any { return x; }\n"
         "function same<T>(x: T): T { return x; }\n"
         "function chosen() { pick(5).save(); pick('x').save(); pick('x', 1).save(); pick(1, 2).save(); same(new Other()).save(); const k = new Box<Other>(); k.get().save(); }\n"
         "function held(r: Repo, m: Map<string, Other>) { r['save'](); m.get('a').save(); { let r: Other; r.save(); } r.save(); }\n"),
    ]
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    f = e.tables.functions
    calls = e.call_edges.join(f.select(f.id.alias("caller"), f.name.alias("by")), "caller").join(f.select(f.id.alias("callee"), f.cls.alias("to")), "callee", "left")
    got = {}
    for r in calls.filter("text like '%save%' and by <> '(anonymous)'").orderBy("by", "call_ord").collect():
        got.setdefault(r.by, []).append(r.to or r.outcome)
    assert got == {
        "typed": ["Repo"], "loop": ["Other"], "bare": ["unresolved"], "back": ["Other", "Repo", "Other", "Other"],
        "boxed": ["Repo", "Repo", "Other", "Other", "unresolved"], "chosen": ["Repo", "Other", "Other", "unresolved", "Other", "Other"],
        "held": ["Repo", "Other", "Other", "Repo"],
    }
    assert [(r.line, r.def_line) for r in e.find_refs("save").rows if r.line in (2, 3, 4)] == [(2, 1), (3, 2)]


def test_importer_count_leaves_out_defining_files_at_any_number(spark, tmp_path):
    rows = [(f"d{i}.ts", f"import {{ same }} from './d{(i + 1) % 1001}';\nexport function same() {{ return 1; }}\n") for i in range(1001)]
    rows.append(("use.ts", "import { same } from './d5';\nexport const x = same();\n"))
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string"), home=str(tmp_path))
    assert e.find_refs("same", "use.ts").data["importer_count"] == 1


def test_files_nested_too_deeply_are_named(spark, tmp_path, monkeypatch):
    deep = "export function f() { return 1; }\nexport const x = " + "[" * 900 + "f()" + "]" * 900 + ";\n"
    e = Engine(spark, files=spark.createDataFrame([("a.ts", deep), ("b.ts", "export function g() {}\n")], "path string, content string"), home=str(tmp_path))
    assert e.sync()["problem_count"] == 1
    a = e.find_refs("f")
    assert a.data["problems"] == 1 and isinstance(a.data["unread"], list)


def test_a_table_is_read_again_only_where_stamps_say_so(spark, tmp_path):
    rows = [("a.ts", "export class A {}\n", 1), ("b.ts", "export class B {}\n", 1)]
    e = Engine(spark, files=spark.createDataFrame(rows, "path string, content string, version int"), home=str(tmp_path))
    assert e.sync()["changed"] == 2 and e.sync()["changed"] == 0
    e._table.write.parquet(str(tmp_path / "t"))
    e._table = spark.read.parquet(str(tmp_path / "t"))
    assert "content" not in e._stamped()._jdf.queryExecution().executedPlan().toString()
    e._table = spark.createDataFrame([rows[0], ("b.ts", "export class C {}\n", 2)], "path string, content string, version int")
    assert e.sync()["changed"] == 1 and [r.symbol for r in e.find_def("C").rows] == ["C"]
    quiet = Engine(spark, files=e._table, home=str(tmp_path), watch=False)
    assert quiet.find_def("C").rows
    quiet._table = e._table.limit(0)
    assert quiet.find_def("C").rows and not quiet.sync()["file_count"] and not quiet.find_def("C").rows


def test_parsing_is_dealt_over_tasks_however_the_table_is_stored(spark, monkeypatch):
    from codegraph.sources import index

    monkeypatch.setattr(index, "FILES_A_TASK", 2)
    files = spark.createDataFrame([(f"a{i}.ts", f"export const x{i} = {i};") for i in range(18)], "path string, content string").coalesce(1)
    e = Engine(spark, files=files, watch=False)
    assert e.sync()["file_count"] == 18
    assert e.parsed.rdd.getNumPartitions() == 9 == e.parts
    assert index.tasks(0) == 1 and index.tasks(1, 5 * index.BYTES_A_TASK) == 5


def test_checkpoints_are_not_broadcast_by_guessed_sizes(spark):
    from codegraph.operators.graph import cut_lineage

    one = cut_lineage(spark.range(9))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(one.withColumn("x", F.lit(1)).join(spark.range(5), "id"))
    assert "BroadcastHashJoin" in plan(spark.range(5).join(F.broadcast(one), "id"))


def test_long_listings_stay_out_of_the_driver(spark, tmp_path):
    files = spark.createDataFrame([("a.ts", "export class A { run() { return 1; } }\nexport function go(a: A) { a.run(); }\n")], "path string, content string")
    e = Engine(spark, files=files, home=str(tmp_path), watch=False)
    refs, unread = e.member_refs("run")
    assert [(r.file, r.line, r.def_line) for r in refs.collect()] == [("a.ts", 2, 1)] == [(r.file, r.line, r.def_line) for r in e.find_refs("run").rows] and unread.isEmpty()
    said = e.arch_assert("c", "C", locators=[{"kind": "symbol", "query": "class *"}])
    assert not {"rows", "text"} & set(vars(said))
    assert "A" in said.text and [r.symbol for r in said.rows] == ["A"]


def test_fingerprints_come_with_the_hashes_of_the_expression(spark):
    """Runs of node types are hashed where they are found, once each, as exprs.shingles hashes them."""
    assert all("shingles" in f for f in File("a.ts", CLONE, "typescript").fingerprints())
    files = spark.createDataFrame([("a.ts", CLONE), ("b.tsx", CLONE + "const C = () => { return <a b={[1, 2, 3].map(x => x + 1)}>text</a>; };\n")], "path string, content string")
    rows = Tables(parse_files(files))._rows("fingerprints").select("shingles", shingles(F.col("types")).alias("want")).collect()
    assert len(rows) >= 2 and all(r.shingles == r.want for r in rows)


def test_anchors_of_symbols_read_no_contents(spark, tmp_path):
    files = spark.createDataFrame([("a.ts", "export interface IOne {}\n")], "path string, content string")
    e = Engine(spark, files=files, home=str(tmp_path), watch=False)
    e.arch_assert("i", "I", locators=[{"kind": "symbol", "query": "interface I*"}])
    e.arch_assert("p", "P", locators=[{"kind": "path", "glob": "*.ts"}])
    held = lambda c: "content" in e._anchors(c, e.resolve(c))._jdf.queryExecution().optimizedPlan().toString()
    assert [held(e.concepts()[x]) for x in "ip"] == [False, True]


def test_tokens_are_told_by_their_first_character_only_where_that_decides():
    """What a blank, a comment or a line break before a token means, with and without the quick way."""
    text = "a <!-- x\n b /* */ => c  ?.d\n.5 #e @f $g _h ?? `i${j}` / 2 <k> '}' <= >>>= \\u0061l ém"
    lexer, pos, before, found = Lexer(text), 0, None, []
    while (t := lexer.at(pos, before)).kind != "end":
        found.append((t.kind[0], t.text, t.newline))
        pos, before = t.end, t
    want = [("n", "a", True), ("n", "b", True), ("p", "=>", False), ("n", "c", False), ("p", "?.", False), ("n", "d", False), ("n", ".5", True), ("n", "#e", False), ("p", "@", False), ("n", "f", False), ("n", "$g", False), ("n", "_h", False)]
    want += [("p", "??", False), ("t", "`i${j}`", False), ("p", "/", False), ("n", "2", False), ("p", "<", False), ("n", "k", False), ("p", ">", False), ("s", "'}'", False), ("p", "<=", False), ("p", ">>>=", False), ("n", "\\u0061l", False), ("n", "ém", False)]
    assert found == want


def test_a_task_holds_the_rows_of_few_files_at_a_time(spark, monkeypatch):
    """However many files come in one batch, a worker parses and holds ROWS_A_FRAME of them before it hands their rows on."""
    import pyarrow as pa

    from codegraph.sources import index

    held, parsed, extract = {}, [], index.extract
    files = spark.createDataFrame([("a.ts", "const a = 1;")], "path string, content string")
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: held.setdefault("run", f))
    monkeypatch.setattr(index, "extract", lambda path, *rest: parsed.append(path) or extract(path, *rest))
    index.parse_files(files)
    many = 2 * index.ROWS_A_FRAME + 50
    batch = pa.RecordBatch.from_pylist([{"path": f"f{i}.ts", "content": f"const c{i} = {i};", "grammar": "typescript"} for i in range(many)])
    sizes = []
    for frame in held["run"]([batch]):
        sizes.append(frame.num_rows)
        assert len(parsed) == sum(sizes)
    assert sizes == [index.ROWS_A_FRAME] * 2 + [50]
