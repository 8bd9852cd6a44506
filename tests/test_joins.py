"""Joins of the typed tier: none sends a table that grows with the tree to the driver to be broadcast.

At any size: the planner's guesses of what comes from a checkpoint don't grow with it, so these small trees are joined
as large ones are.
"""

import pytest
from pyspark.sql import functions as F

from codegraph.engine import Engine
from codegraph.operators import graph, types_tier

FILES = {
    "a/base.ts": "export class Base<T> { held: T; get(): T { return this.held; } area() { return 1; } }\nclass Hidden {}\nexport { Hidden as Shown };\n",
    "a/mid.ts": "import { Base } from './base';\nexport class Mid extends Base<Leaf> {}\nexport class Leaf extends Mid { area() { return 2; } }\n",
    "a/index.ts": "export * from './mid';\nexport { Base as Root } from './base';\n",
    "b/use.ts": """import { Mid, Leaf, Root } from '../a';
export function pick(x: number): Mid;
export function pick(x: string): Leaf;
export function pick(x: any): any { return x; }
export class User {
  constructor(private leaf: Leaf, private mids: Mid[]) {}
  run() { this.leaf.area(); const l = this.leaf; l.area(); const h = this.leaf.held; h.area(); for (const m of this.mids) { m.get().area(); } nowhere.area(); Leaf.area(); }
}
export function go(u: User) { const p = pick('x'); p.area(); u.run(); unknown(); new Root(); }
""",
}


@pytest.fixture
def broadcasts(monkeypatch):
    """The broadcast joins of all plans that ran up to a checkpoint."""
    found, cut = [], graph.cut_lineage

    def spied(df):
        out = cut(df)
        found.extend(line.strip() for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "BroadcastHashJoin" in line)
        return out

    for module in (graph, types_tier):
        monkeypatch.setattr(module, "cut_lineage", spied)
    return found


@pytest.fixture(scope="module")
def synced(spark):
    made = Engine(spark, files=spark.createDataFrame(list(FILES.items()), "path string, content string"), watch=False)
    made.sync()
    return made


def test_exports_and_ancestry_are_merged(synced, broadcasts):
    """names known so far were broadcast to tell which are new."""
    assert synced.scoped.filter("file = 'b/use.ts' and local = 'Leaf' and def_file = 'a/mid.ts'").count() == 1
    assert synced.ancestry.filter("cls = 'Leaf' and a_cls = 'Base' and distance = 2").count() == 1
    assert broadcasts == []


def test_typed_bindings_are_merged(synced, broadcasts):
    """F6, F7, F8: signatures, members and what was found before."""
    assert {r.name for r in synced.typed.collect()} >= {"leaf", "l", "h", "m", "p", "u"}
    assert broadcasts == []


def test_call_edges_are_merged(synced, broadcasts):
    """F3, and F2 and F4, which ask for them."""
    named = synced.call_edges.join(synced.tables.functions.select(F.col("id").alias("callee"), "cls"), "callee")
    assert {(r.text, r.cls) for r in named.collect()} >= {("this.leaf.area", "Leaf"), ("l.area", "Leaf"), ("p.area", "Leaf")}
    assert broadcasts == []


def test_member_references_are_merged(synced, broadcasts):
    """fields and variables met the bindings."""
    refs, _ = synced.member_refs("area")
    assert {(r.line, r.def_file, r.def_line) for r in graph.cut_lineage(refs).collect()} == {(line, "a/mid.ts", 3) for line in (7, 9)}
    assert broadcasts == []
