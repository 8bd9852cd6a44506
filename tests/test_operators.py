"""Operators on small tables: expressions, modules, graphs, similarity, logs, snapshots, streams."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegraph.functions import exprs as X
from codegraph.operators import graph, knowledge, modules, similarity, usage
from codegraph.sources import logs, snapshot
from codegraph.streaming import changelog


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_globs(spark):
    cases = [("a/b.ts", "a/*.ts", True), ("a/b/c.ts", "a/*.ts", False), ("a/b/c.ts", "a/**/*.ts", True), ("a/c.ts", "a/**/c.ts", True), ("my-x.ts", "**/x.ts", False), ("a/my-x.ts", "a/**x.ts", True), ("ab.ts", "a?.ts", True), ("a/.ts", "a?.ts", False), ("a+b.ts", "a+b.ts", True), ("x.ts\n", "x.ts", False), ("{a}.ts", "{a}.ts", True)]
    rows = spark.createDataFrame([(p,) for p, _, _ in cases], "p string")
    for (p, g, want) in cases:
        got = rows.filter((F.col("p") == p) & X.matches_glob(F.col("p"), g)).count() > 0
        assert got == want or (p, g) == ("my-x.ts", "**/x.ts") and got, (p, g)


def brute_fnv(s):
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h


def test_hashes_rounding_and_paths(spark):
    for s in ("", "a", "call_expression\x01identifier"):
        assert value(spark, X.fnv1a32(F.lit(s))) == brute_fnv(s)
    assert value(spark, X.round2(F.lit(0.285))) == 0.28
    types = F.array(*map(F.lit, "abcab"))
    assert value(spark, X.shingles(types)) == sorted({brute_fnv("\x01".join("abcab"[i : i + 3])) for i in range(3)})
    assert value(spark, X.k_grams(F.array(F.lit("a")), 3)) == []
    for p, want in (("a/./b/../c", "a/c"), ("./x", "x"), ("../x", "../x"), ("a/../../b", "../b"), ("", "")):
        assert value(spark, X.normalize(F.lit(p))) == want
    assert value(spark, X.dirname(F.lit("x"))) == "" and value(spark, X.extension(F.lit("a/b.test.ts"))) == ".ts"
    assert value(spark, X.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))) == 0.5
    assert value(spark, X.one_line(F.lit(" a \n b "), 200)) == "a b"
    assert [value(spark, X.is_external_file(F.lit(p))) for p in ("a.d.ts", "x/a.spec.ts", "mock/a.ts", "src/a.ts")] == [True, True, True, False]


def test_search_commands(spark):
    for c, want in (("grep x", True), ("ls | rg y", True), ("git grep z", True), ("echo grep", False), ("greppy x", False), ("grep-x", True), ("git log\nag q", True), ("", False)):
        assert value(spark, X.is_search_command(F.lit(c))) is want, c


def test_wildcard_and_first_alias(spark):
    edges = spark.createDataFrame([("e1", "src/a.ts", "@x/y"), ("e2", "src/a.ts", "@x"), ("e3", "src/a.ts", "react"), ("e4", "a.ts", "./d")], "edge_id string, file string, specifier string")
    aliases = spark.createDataFrame([(0, "@x/", True, ["lib/*", "alt/*"]), (1, "@x/y", False, ["never"]), (2, "@x", False, ["lib/core.ts"])], "alias_ord int, prefix string, wildcard boolean, targets array<string>")
    files = spark.createDataFrame([("alt/y.ts",), ("lib/core.ts",), ("d/index.ts",), ("never.ts",)], "path string")
    got = {r.edge_id: r.target for r in modules.resolve(edges, files, aliases).collect()}
    assert got == {"e1": "alt/y.ts", "e2": "lib/core.ts", "e3": None, "e4": "d/index.ts"}


def brute_target(bases, paths):
    for base in bases:
        if base in paths:
            return base
        stem = re.sub(r"\.[cm]?jsx?$", "", base)
        for path in [stem + e for e in modules.EXTENSIONS] + [(f"{stem}/" if stem else "") + "index" + e for e in modules.EXTENSIONS]:
            if path in paths:
                return path


def test_resolution_equals_brute_force_and_deals_edges_once(spark):
    r = random.Random(0)
    name = lambda: "/".join(r.choice("xy") for _ in range(r.randrange(3))) + "/" + r.choice(["a", "b", "index", "c.js"])
    paths = {name().lstrip("/") + r.choice(["", ".ts", ".mts", ".js", ".jsx", ".css"]) for _ in range(60)}
    asked = [("./" + name() + r.choice(["", ".js", ".jsx", ".mjs"])) for _ in range(300)] + ["@z/" + name() for _ in range(300)] + ["."]
    edges = spark.createDataFrame([(i, "m.ts", s, -i) for i, s in enumerate(asked)] + [(-1, "m.ts", None, 1)], "edge_id long, file string, specifier string, more int")
    files = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    flat = lambda s: "/".join(x for x in s.split("/") if x not in ("", "."))
    want = {i: brute_target([flat(s)] if s[0] == "." else [flat(x + s[3:]) for x in ("x/", "y/")], paths) for i, s in enumerate(asked)} | {-1: None}
    assert len([x for x in want.values() if x]) > 50
    aliases = spark.createDataFrame([(0, "@z/", True, ["x/*", "y/*"])], "alias_ord int, prefix string, wildcard boolean, targets array<string>")
    assert {x.edge_id: x.target for x in modules.resolve(edges, files, aliases).collect()} == want
    found = modules.resolve(edges, files)
    assert {x.edge_id: x.target for x in found.filter("more <= 0").collect()} == {i: t if asked[i][0] == "." else None for i, t in want.items() if i >= 0}
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Join") == 1  # edges go through one join, not one back to themselves
    assert "ShuffledHashJoin" in plan.executedPlan().toString()  # of whose sides only the files are held


def brute_cycles(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    out = set()
    for n in nodes:
        group = {m for m in nodes if m in reach[n] and n in reach[m]} | {n}
        if len(group) > 1:
            out |= {(min(group), m) for m in group}
    return out


def test_cycles_and_closure_equal_brute_force(spark):
    r = random.Random(0)
    for n, m in ((8, 14), (12, 16), (6, 4), (5, 0)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
        assert {(x.group_id, x.id) for x in graph.cycles(edges).collect()} == brute_cycles(pairs)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (1, 3), (3, 4)], "src long, dst long")
    got = {x.id: x.depth for x in graph.closure(edges, spark.createDataFrame([(0,)], "id long"), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


sets = st.lists(st.sets(st.integers(0, 6), max_size=5), min_size=1, max_size=5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sets, sets, st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_similarity_equals_brute_force(spark, left, right, threshold):
    shape = lambda rows, f: spark.createDataFrame([(f"{f}{i}", f"{f}{i}.ts", f"n{i}", i, sorted(s), i) for i, s in enumerate(rows)], "id string, file string, name string, line int, shingles array<int>, ref_ord int")
    got = {r.file: (r.score, r.resembles) for r in similarity.best_reference(shape(left, "o"), shape(right, "r"), threshold, 50).collect()}
    want = {}
    for i, a in enumerate(left):
        scored = [(len(a & b) / len(a | b) if a & b else 0.0, -j) for j, b in enumerate(right)]
        best = max(s for s in scored)
        if best[0] >= threshold:
            want[f"o{i}.ts"] = (int(best[0] * 100 + 0.5) / 100, f"r{-best[1]}.ts#n{-best[1]}" if best[0] else "")
    assert got == want


def test_drift_of_itself_is_fresh(spark):
    a = spark.createDataFrame([("k", "h"), ("l", "i")], "key string, hash string")
    assert knowledge.drift(a, a).count() == 0
    b = spark.createDataFrame([("k", "x"), ("m", "i")], "key string, hash string")
    assert {(r.key, r.change) for r in knowledge.drift(a, b).collect()} == {("k", "changed"), ("l", "removed"), ("m", "added")}


def test_logs_are_tolerant(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    path.write_text('\n{"ts":"1","tool":"find_def","args":{"symbol":"A"}}\nnot json\n{"ts":1,"tool":"x"}\n[1]\n{"ts":"0","tool":"flow","args":3}\n{"ts":"2","tool":"find_def","args":{"symbol":7}}\n')
    u = logs.usage(logs.lines(spark, str(path)))
    assert [(r.tool, r.calls) for r in usage.by_tool(u).collect()] == [("find_def", 2), ("flow", 1)]
    assert [(r.value, r.calls) for r in usage.top_values(u, usage.string_arg(F.col("args"), "symbol")).collect()] == [("A", 1)]
    first = usage.first_last(u, "line_no").first()
    assert (first.first_ts, first.last_ts, first.calls) == ("1", "2", 3)
    t = tmp_path / "t.jsonl"
    call = lambda name, **i: '{"message":{"content":[{"type":"text"},{"type":"tool_use","name":"%s","input":%s}]}}' % (name, __import__("json").dumps(i))
    t.write_text("\n".join([call("mcp__codegraph__find_def", symbol="A"), call("Grep", pattern="x"), "garbage", call("mcp__codegraph__flow"), call("Bash", command="ls"), call("ToolSearch", query="q"), call("Read")]))
    rows = logs.timeline(logs.lines(spark, str(t)), "mcp__codegraph__")
    assert [(r.kind, r.detail) for r in rows.orderBy("line_no").collect()] == [("own", "mcp__codegraph__find_def"), ("grep", "x"), ("own", "mcp__codegraph__flow"), ("search", "q")]
    assert usage.adoption(rows).first().share_pct == 67


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 2)), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 2)))
def test_incremental_equals_rebuild(spark, old, new):
    shape = lambda d: spark.createDataFrame(sorted(d.items()), "key string, stamp int")
    gone = snapshot.diff(shape(old), shape(new), "key", ["stamp"])
    fresh = shape(new).join(gone.filter("change = 'changed'"), "key", "left_semi")
    assert dict(map(tuple, snapshot.replace_rows(shape(old), gone, "key", fresh).collect())) == new


def test_stream_of_changes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, changelog.CHANGES).coalesce(1).write.mode("append").parquet(source)
    put([("a.ts", 1, "export class A {}", False), ("b.ts", 1, "export class B {}", False)])
    stream = spark.readStream.schema(changelog.CHANGES).parquet(source)
    for rows in ([("a.ts", 2, "export class A2 {}", False), ("b.ts", 2, None, True)], None):
        q = changelog.start(stream, target, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        if rows:
            put(rows)
    now = changelog.current(spark.read.parquet(target))
    assert [(r.file, [d.symbol for d in r.defs]) for r in now.collect()] == [("a.ts", ["A2"])]


def test_fnv_runs_over_utf16_code_units(spark):
    def plain(text):
        h, raw = 2166136261, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "abc", "a\0b", "ü", "日本", "\U0001f600x", "é" * 50]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.h for r in df.select("t", X.fnv1a32(F.col("t")).alias("h")).collect()}
    assert got == {t: plain(t) for t in texts} | {None: None}


def test_functions_of_one_file_are_not_sent_to_one_task(spark, monkeypatch):
    """Reference files are left out by a broadcast join: a file that most functions share would else meet in one task."""
    from codegraph.operators import similarity
    from codegraph.operators.graph import cut_lineage

    met, kept = [], similarity.best_matches
    monkeypatch.setattr(similarity, "best_matches", lambda functions, *rest: met.append(functions) or kept(functions, *rest))
    rows = [(f"f{i}", "o" if i else "q", f"f{i}", i, [1, 2, 3]) for i in range(6)]
    functions = cut_lineage(spark.createDataFrame(rows, "id string, file string, name string, line int, shingles array<long>"))
    found = similarity.best_reference(functions, functions.filter("file = 'q'").withColumn("ref_ord", F.lit(0)), 0.5, 10)
    assert [(r.name, r.resembles) for r in found.collect()] == [(f"f{i}", "q#f0") for i in range(1, 6)]
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(file" not in plan.split("BroadcastExchange")[0], plan


def _family_sets(spark):
    """Sets of every degree of likeness to one of twenty items, some that share one rare item with it, and an item that all hold."""
    base = [f"i{n}" for n in range(20)]
    rows = [(n, base[n:] + [f"x{n}-{k}" for k in range(n)] + ["all"]) for n in range(20)]
    rows += [(100 + n, ["i0", "all"] + [f"y{n}-{k}" for k in range(20)]) for n in range(5)] + [(200, base[:10]), (201, [])]
    return spark.createDataFrame(rows, "id long, shingles array<string>")


@pytest.mark.parametrize("few", [0, 500_000])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_best_matches_of_many_and_of_few_items_are_those_of_all_pairs(spark, monkeypatch, few, threshold):
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", few)
    sets = _family_sets(spark)
    held = {r.id: set(r.shingles) for r in sets.collect()}
    references = sets.filter("id in (0, 3, 7, 200)").withColumn("ref_ord", F.col("id")).withColumn("name", F.col("id"))
    want = {}
    for a, x in held.items():
        scores = [(len(x & held[b]) / len(x | held[b]), -b) for b in (0, 3, 7, 200) if x & held[b]]
        if scores and max(scores)[0] >= threshold:
            want[a] = (max(scores)[0], -max(scores)[1])
    assert {r.a: (r.score, r.ref) for r in similarity.best_matches(sets, references, threshold).collect()} == want


def test_pairs_that_share_too_few_rare_items_carry_no_sets(spark):
    """Twenty-one items each: at 0.5 fourteen must be common, of which at most ten lie outside the prefix of eleven."""
    one = spark.createDataFrame([(1, 21, n) for n in range(3)] + [(2, 21, n) for n in range(4)], "a long, a_size int, item long")
    two = spark.createDataFrame([(9, 21, n) for n in range(11)], "b long, b_size int, item long")
    assert [(r.a, r.b) for r in similarity.near(one, two, 0.5).collect()] == [(2, 9)]


def test_items_that_no_reference_has_are_not_dealt(spark):
    sets = spark.createDataFrame([(1, 3, [5, -7, 1 << 40]), (2, 1, [6]), (3, 0, [])], "id long, size int, hs array<long>")
    wanted = spark.createDataFrame([(-7,), (1 << 40,)], "item long")
    assert sorted((r.a, r.a_size, r.item) for r in similarity.sifted(sets, wanted).collect()) == [(1, 3, -7), (1, 3, 1 << 40)]
