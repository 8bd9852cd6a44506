"""The jobs: over copies of small tables, run again, and over growing input."""

import re
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import clone_review, common, reference_index

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def words(*spans):
    return " ".join(f"w{i}" for a, b in spans for i in range(a, b))


def grams(text):
    w = (text or "").split(" ")
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if text is not None and len(w) >= 20 else set()


REVIEW = [
    (1, words((0, 60)), "a"),
    (2, words((0, 55), (100, 105)), "a"),  # like 1
    (3, words((0, 60)), "b"),  # a copy of a reference
    (4, words((200, 260)), "b"),
    (5, words((200, 245), (300, 315)), None),  # like 4, and in no source
    (6, words((0, 19)), "a"),  # too short
    (7, None, "a"),
    (8, "", "c"),
    (9, words((400, 460)), "c"),  # like nothing
    (10, words((0, 60)), "c"),  # as good as 1, but a reference itself
    (11, words((0, 58), (210, 212)), "src=x/y"),
    (None, words((0, 60)), "a"),
]
JUDGED = [(1, 1, 0), (10, 1, 0), (4, 0, 1), (4, 1, 0), (9, None, None), (2, 0, 0), (5, 0, 1), (77, 1, 0), (None, 1, 0)]


def review(spark, folder, rows, judged, **config):
    spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).write.mode("overwrite").parquet(f"{folder}/documents")
    spark.createDataFrame(judged, LABELS).write.mode("overwrite").parquet(f"{folder}/labels")
    return lambda: clone_review.run(spark, f"{folder}/documents", f"{folder}/labels", f"{folder}/out", config)


def brute_review(rows, judged, threshold=0.5):
    good = {d for d, q, _ in judged if q == 1} - {d for d, _, t in judged if t == 1}
    toxic = {d for d, _, t in judged if t == 1}
    known = {d for d, *_ in judged}
    good.discard(None)
    out = set()
    for d, text, source in rows:
        if d is None or d in good or not grams(text):
            continue
        best = max(((len(grams(text) & grams(t)) / len(grams(text) | grams(t)), -r) for r, t, _ in rows if r in good and grams(t)), default=(0, 0))
        if best[0] >= threshold:
            out.add((d, int(best[0] * 100 + 0.5) / 100, -best[1], d in toxic or d not in known, source))
    return out


def test_clone_review_equals_brute_force_and_reruns_alike(spark, tmp_path):
    run = review(spark, tmp_path, REVIEW, JUDGED)
    want = brute_review(REVIEW, JUDGED)
    assert {x[0] for x in want} == {2, 3, 11}  # 4 is called good once and toxic once, so it is no reference
    for _ in range(2):
        told = run()
        assert {tuple(r) for r in clone_review.result(spark, f"{tmp_path}/out").collect()} == want
        assert told == {"documents": len(REVIEW), "labels": len(JUDGED), "listed": len(want)}
    smaller = [r for r in REVIEW if r[2] != "b"]  # what is gone from the input goes from the list, its source's folder too
    review(spark, tmp_path, smaller, JUDGED)()
    assert {tuple(r) for r in clone_review.result(spark, f"{tmp_path}/out").collect()} == brute_review(smaller, JUDGED)


def test_clone_review_leaves_no_shuffles_and_no_sets(spark, tmp_path, monkeypatch):
    """what the first of two runs shuffled, and its sets, lay on the disk beside the second's."""
    top = Path(tempfile.gettempdir())
    shuffled = lambda: {f for d in top.glob("blockmgr-*") for f in d.rglob("shuffle_*.data")}
    folders = []
    monkeypatch.setattr(common, "fresh_folder", lambda *_: folders.append(f"{tmp_path}/held{len(folders)}") or folders[-1])
    run, before = review(spark, tmp_path, REVIEW, JUDGED), shuffled()
    run()
    until = time.monotonic() + 20  # they are removed in the background
    while (left := shuffled() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert left == set()
    assert folders and all(spark.read.parquet(f).isEmpty() for f in folders)
    assert spark.conf.get(common.CLEANUP, None) is None  # as it was
    monkeypatch.setattr(clone_review, "candidates", lambda *_, hold, **__: hold(spark.range(3)).select(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        run()
    assert spark.read.parquet(folders[-1]).isEmpty() and spark.conf.get(common.CLEANUP, None) is None


def test_clone_review_settings(spark, tmp_path):
    review(spark, tmp_path, REVIEW, JUDGED, threshold=0.9)()
    assert {tuple(r) for r in clone_review.result(spark, f"{tmp_path}/out").collect()} == brute_review(REVIEW, JUDGED, 0.9)
    with pytest.raises(ValueError, match="unknown settings: limit"):
        review(spark, tmp_path, REVIEW, JUDGED, limit=3)()


def test_clone_review_of_empty_tables(spark, tmp_path):
    assert review(spark, tmp_path, [], [])()["listed"] == 0
    assert review(spark, tmp_path, REVIEW, [])()["listed"] == 0


# ---- the index

TEXT = "doc_id long, text string, extra string"


def feed(spark, folder, name, rows):
    """A new file in the watched folder."""
    spark.createDataFrame(rows, TEXT).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    part = next((folder / f"tmp-{name}").glob("part-*.parquet"))
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


def brute_index(texts):
    out = set()
    for d, text in texts.items():
        at = {}
        for n, line in enumerate((text or "").split("\n"), 1):
            for s in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", line):
                at.setdefault(s, []).append(n)
        out |= {(s, d, len(x), x[0], x[-1]) for s, x in at.items()}
    return out


def stands(spark, out):
    return {tuple(r) for r in reference_index.current(spark, out).drop("bucket").collect()}


def test_index_takes_only_what_is_new(spark, tmp_path):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    run = lambda **c: reference_index.run(spark, f"{tmp_path}/in", out, mark, {"buckets": 4} | c)
    feed(spark, tmp_path, "one", [(1, "let a = b;\nb(a)", ""), (2, "x\n\n$y_1 9z é", ""), (3, None, ""), (4, "", ""), (None, "lost", ""), (5, "same same", "")])
    assert run() == {"taken": 5, "documents": 5, "symbols": 7}
    assert stands(spark, out) == brute_index({1: "let a = b;\nb(a)", 2: "x\n\n$y_1 9z é", 5: "same same"})
    assert run() == {"taken": 0, "documents": 5, "symbols": 7}  # nothing is new
    # 1 changes, 5 loses its text, 6 is new, and 2 comes twice in one file: the larger text counts
    feed(spark, tmp_path, "two", [(1, "c", ""), (5, None, ""), (6, "b b\nb", ""), (2, "p", ""), (2, "q", ""), (2, None, "")])
    feed(spark, tmp_path, "three", [(7, "c c", "")])
    assert run(files_per_batch=1)["taken"] == 5
    want = brute_index({1: "c", 2: "q", 6: "b b\nb", 7: "c c"})
    assert stands(spark, out) == want
    assert {tuple(r) for r in reference_index.lookup(spark, out, "c").collect()} == {(1, 1, 1, 1), (7, 2, 1, 1)}
    assert reference_index.lookup(spark, out, "let").collect() == []
    summary = {r.symbol: (r.docs, r.refs) for r in spark.read.schema(reference_index.SUMMARY).parquet(f"{out}/summary").collect()}
    assert summary == {"c": (2, 3), "q": (1, 1), "b": (1, 3)}
    with pytest.raises(ValueError, match="was made with"):
        run(buckets=5)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = f"{tmp_path}/out"
    batch = spark.createDataFrame([(1, "a b\na"), (2, "c")], "doc_id long, text string").withColumn("modified", F.current_timestamp())
    write = reference_index.writer(out, "[a-z]+", 4)
    for _ in range(2):
        write(batch, 0)
        assert stands(spark, out) == brute_index({1: "a b\na", 2: "c"})
    write(batch.filter("doc_id = 1").withColumn("text", F.lit("d")), 1)
    write(batch, 0)  # an older batch again does not bring back what a newer one replaced
    assert stands(spark, out) == brute_index({1: "d", 2: "c"})


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    feed(spark, tmp_path, "one", [(i, " ".join(f"s{i}_{j}" for j in range(20)), "") for i in range(20)])
    reference_index.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"buckets": 8})
    hit = reference_index.lookup(spark, f"{tmp_path}/out", "s3_4")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", plan)
    assert [tuple(r) for r in hit.collect()] == [(3, 1, 1, 1)]


def test_an_empty_folder_gives_an_empty_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert reference_index.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint") == {"taken": 0, "documents": 0, "symbols": 0}


@pytest.mark.parametrize("module,paths", [(clone_review, ["documents", "labels", "out"]), (reference_index, ["documents", "out", "checkpoint"])])
def test_command_line(spark, tmp_path, monkeypatch, module, paths):
    """The command line reads its settings with Spark, runs once and stops the session it made."""
    (tmp_path / "own.json").write_text('{"threshold": 0.7}' if module is clone_review else '{"buckets": 3}')
    seen = {}
    monkeypatch.setattr(module, "session", lambda name: type("S", (), {"stop": lambda self: seen.setdefault("stopped", True), "read": spark.read})())
    monkeypatch.setattr(module, "run", lambda s, *at: seen.update(at=at))
    monkeypatch.setattr("sys.argv", ["job", *(x for p in paths for x in (f"--{p}", f"/at/{p}")), "--config", str(tmp_path / "own.json")])
    module.main()
    assert seen["stopped"] and seen["at"][:-1] == tuple(f"/at/{p}" for p in paths)
    assert common.settings(module.__name__.split(".")[-1], seen["at"][-1])


def test_a_larger_batch_is_dealt_to_more_tasks_not_larger_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reference_index, "CHARS_A_TASK", 100)
    texts = {n: f"a{n} b\nb" for n in range(300)}
    batch = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("modified", F.current_timestamp())
    parts = reference_index.tasks(batch)
    assert parts == 1 + sum(map(len, texts.values())) // 100
    assert reference_index.newest(batch, parts).rdd.getNumPartitions() == parts
    assert reference_index.tasks(batch.limit(0)) == 1
    reference_index.writer(f"{tmp_path}/out", "[a-z]+[0-9]*", 2)(batch, 0)
    assert stands(spark, f"{tmp_path}/out") == brute_index(texts)
