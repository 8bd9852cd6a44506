"""Near duplicates at similarity 0.8 against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline as P
from codegraph.llm import nearsets
from codegraph.llm.nearsets import item_set, similar, similar_dedup

from .test_simhash import DOCS, roots


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


def corpus(r):
    """Families of edited copies, one of them large, and unlike texts around one common passage."""
    vocab = [f"w{i}" for i in range(300)]
    passage = r.choices(vocab, k=30)
    texts = [None, "", "a b", "a b", "a b c"]
    for n in [3] * 12 + [40]:
        words = r.choices(vocab, k=r.randrange(60, 200))
        for _ in range(n):
            copy = list(words)
            for _ in range(r.randrange(7)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(r.choices(vocab, k=20) + passage + r.choices(vocab, k=20)) for _ in range(30)]
    return texts


def test_similarity_is_exact():
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 40, r.integers(0, 60)).astype(np.uint64)) for _ in range(2))
        one, two = set(a.tolist()), set(b.tolist())
        assert similar(a, b) == (len(one & two) * 5 >= len(one | two) * 4)
    assert [len(item_set(t)) for t in (b"", b" \n", b"a b", b"a b c d e f", b"x " * 50)] == [0, 0, 1, 2, 1]


def test_components_at_four_fifths(spark):
    texts = corpus(random.Random(11))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[7], None, None, None)], DOCS)
    own = [grams(t) for t in [*texts, texts[7]]]
    root = roots(range(len(own)), [(i, j) for i in range(len(own)) for j in range(i) if near(own[i], own[j])])
    want = {min(i for i in root if root[i] == x) for x in set(root.values())}
    kept = similar_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(want)
    assert similar_dedup(docs.limit(0)).count() == 0


def test_stage_links_edited_copies(spark, tmp_path):
    """Four single words changed in 200 (similarity over 0.8, more than four bits apart): one document stays."""
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(words), "en", "s", 0)]
    for i in range(1, 9):
        copy = list(words)
        for at in (20, 70, 120, 170):
            copy[at + i] = f"new{i}x{at}"
        rows.append((i, " ".join(copy), "en", "s", 0))
    assert all(near(grams(rows[0][1]), grams(x[1])) for x in rows)
    docs = spark.createDataFrame(rows, DOCS)
    assert [x.doc_id for x in P.simhash(spark, docs, str(tmp_path)).collect()] == [0]


def test_hash_order_of_items_decides_nothing():
    assert all(nearsets.prefix(n) == n - -(-4 * n // 5) + 1 for n in range(1, 100)) and nearsets.prefix(0) == 0


def test_sketches_lose_no_similar_pair_and_most_others():
    r = np.random.default_rng(4)
    kept = 0
    for _ in range(2000):
        n, shared = int(r.integers(1, 400)), r.random()
        both = r.integers(0, 1 << 63, max(1, int(n * shared)), np.int64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, int(r.integers(0, max(1, n - len(both)) + 1)), np.int64)])).astype(np.uint64) for _ in range(2))
        may = nearsets.may_be_similar(nearsets.sketch(a), len(a), nearsets.sketch(b), len(b))
        assert may or not nearsets.similar(a, b)
        kept += may and not nearsets.similar(a, b)
    assert kept < 300
    empty = np.zeros(0, np.uint64)
    assert nearsets.may_be_similar(nearsets.sketch(empty), 0, nearsets.sketch(empty), 0)


def test_crowds_meet_in_parts(spark, monkeypatch):
    """Unlike texts around one passage, and similar ones among them: parts of a few members give what all pairs give."""
    monkeypatch.setattr(nearsets, "CROWD", 4)
    test_components_at_four_fifths(spark)


def test_every_two_members_of_a_crowd_meet_once(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "CROWD", 10)
    posts = spark.createDataFrame([(t, n) for t, size in ((1, 57), (2, 3)) for n in range(size)], "token long, node long")
    met = {}
    for r in nearsets.crowd_parts(posts).collect():
        met.setdefault((r.token, r.i, r.j), []).append((r.node, r.second))
    seen = []
    for (token, i, j), rows in met.items():
        assert len(rows) < 57 and any(s for _, s in rows) == (i < j and any(s for _, s in rows))
        within = i == j
        seen += [(token, *sorted((a, b))) for k, (a, s) in enumerate(rows) for b, t in rows[:k] if within or s != t]
    assert sorted(seen) == sorted((t, a, b) for t, size in ((1, 57), (2, 3)) for a in range(size) for b in range(a + 1, size))
    assert len(met) > 10


def test_golay_keys_pair_close_copies_before_the_prefix_join(spark, monkeypatch):
    """Copies within four bits come from the keys alone; what is similar but further apart still comes from the join."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1500], "other", *words[1501:]]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").withColumns({"_k1": F.col("_id"), "_k2": F.col("_id")})
    marked = nearsets.sets(docs).cache()
    nodes = {r.row._id: r.node for r in marked.collect()}
    assert {(r.a, r.b) for r in nearsets.keyed_pairs(marked).collect()} == {tuple(sorted((nodes[0], nodes[1])))}
    monkeypatch.setattr(nearsets, "candidates", lambda posts, step: spark.createDataFrame([], "a long, b long, size int"))
    found = nearsets.joined(marked).collect()
    assert {x for r in found for x in (r.node, r.root)} == {nodes[0], nodes[1]}
