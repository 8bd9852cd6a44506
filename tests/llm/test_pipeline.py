"""The stages one after another on a small table, each against what it should keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from codegraph.llm.decontam import decontaminate
from codegraph.llm.langid import keep_identified
from codegraph.llm.lines import line_dedup
from codegraph.llm.shared import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, folder):
    r = random.Random(7)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    sentence = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, sentence(20)) for i in range(5)]
    line = "subscribe to our newsletter right now"
    rows = [(i, f"{sentence(60)}\n{line}", "en", f"s{i}", 0) for i in range(12)]
    rows += [(20 + i, rows[0][1].split("\n")[0], "en", "s1", 0) for i in range(3)]  # near copies of 0 once its line is gone, or not
    rows += [(30, f"{sentence(30)} {items[2][1]} {sentence(30)}", "en", "s2", 0), (40, None, "en", "s3", 0), (41, "123", "en", "s3", 0), (42, "", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return line


def test_stages(spark, tmp_path):
    line = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {x.doc_id: x for x in docs.collect()}
    assert set(kept["language_id"]) == {*range(12), 20, 21, 22, 30}
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    assert [i for i, x in kept["line_dedup"].items() if line in x.text] == [0]
    assert all(x.n_chars == len(x.text) for x in kept["line_dedup"].values())
    assert 20 in kept["simhash"] or 0 in kept["simhash"]
    assert not {21, 22} & set(kept["simhash"]) and set(range(1, 12)) <= set(kept["simhash"])
    assert set(kept["decontaminate"]) == set(kept["simhash"]) - {30}
    assert {x.doc_id for x in docs.collect()} == set(kept["decontaminate"])
    assert sorted(P.run(spark, str(tmp_path)).collect()) == sorted(docs.collect())


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Extra columns, with names that the operators use inside, names with dots and quotes, go through every stage with their values."""
    build(spark, str(tmp_path))
    extra = ["found", "hits", "n_lines", "n_removed", "a.b", "c`d", "row", "lang_pred", "score", "_id", "_text", "node", "root", "label", "h"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in extra])
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[-len(extra) :] == extra
        for r in docs.collect():
            assert list(r)[-len(extra) :] == [f"{c} {r.doc_id}" for c in extra]
    assert stage is P.STAGES[3][1] and docs.count() > 10
    assert P.STAGES[4][1](spark, docs, str(tmp_path)).count() >= docs.count()
    cut = decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), cut=True)
    assert cut.columns == docs.columns and all(r.found == f"found {r.doc_id}" for r in cut.collect())
    counted = line_dedup(docs)
    assert counted.columns.count("n_lines") == 1 and all(r.n_lines >= 1 and r.found for r in counted.collect())


def test_stages_on_an_empty_table(spark, tmp_path):
    build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_language_stage_uses_the_prediction(spark):
    texts = ["the cat sat on the mat and then it ran", "der hund lief durch den wald und schlief"]
    rows = [(i, f"{texts[i % 2]} {texts[i % 2][i % 20:]}", ("en", "de")[i % 2], "s", 0) for i in range(60)] + [(90, "\u4e2d\u6587\u5b57", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id for r in keep_identified(docs).collect()} == set(range(60))
    assert {r.doc_id for r in keep_identified(docs, languages=["de"]).collect()} == set(range(1, 60, 2))
    assert {r.doc_id for r in keep_identified(docs, least_score=1.01).collect()} == set()
    assert {r.doc_id for r in keep_identified(docs, least_likeness=0.0).collect()} == {*range(60), 90}


def test_language_stage_rejects_what_is_like_no_learned_language(spark):
    """Other scripts and random letters go; all of the four languages stay, those held out from learning too."""
    r = random.Random(3)
    drawn = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n))
    unlike = ["\u4e2d\u6587\u5b57\u7b26\u6d4b\u8bd5\u8fd9\u662f\u4e00\u4e2a\u53e5\u5b50", "\u042d\u0442\u043e \u043f\u0440\u0435\u0434\u043b\u043e\u0436\u0435\u043d\u0438\u0435 \u043d\u0430 \u0440\u0443\u0441\u0441\u043a\u043e\u043c \u044f\u0437\u044b\u043a\u0435"]
    unlike += [drawn("abcdefghijklmnopqrstuvwxyz", n) for n in (40, 200, 2000)] + [drawn("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a", n) for n in (20, 800)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", 0) for i, t in enumerate(unlike)], DOCS)
    kept = {x.doc_id for x in keep_identified(given.unionByName(more)).select("doc_id").collect()}
    clean = {x.doc_id for x in given.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000_000}
    assert len(clean) > 900
    assert len(clean - kept) <= 0.001 * len(clean)  # a text of one short word may go
