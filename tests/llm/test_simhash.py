"""SimHash fingerprints, Golay keys, buckets and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from codegraph.llm import simhash
from codegraph.llm.components import components
from codegraph.llm.simhash import Golay, bucket_keys, bucket_links, fingerprint, forest, near_dedup, simhash_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ["", " \n", "One", "a b c", "a b c d", "A b\tc\x0bd é f g " * 9, "x " * 40_000, "İ I \x1c j k l"]:
        assert fingerprint(t.encode()) == brute_fingerprint(t)


def test_golay_decoding_is_perfect():
    g = Golay()
    assert len(set(g.leader.tolist())) == 1 << 11
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    code = words ^ g.leader[g.high[words >> 11] ^ (words & 0x7FF)]
    assert (g.high[code >> 11] == (code & 0x7FF)).all() and (np.bitwise_count(code ^ words) <= 3).all()


def test_all_within_four_bits_share_a_key():
    r = random.Random(5)
    g = Golay()
    for _ in range(40):
        base = r.getrandbits(64)
        others = [base ^ sum(1 << b for b in r.sample(range(64), n)) for n in (1, 2, 3, 4, 4, 4, 4) for _ in range(8)]
        others += [base ^ (1 << r.randrange(22)) ^ (1 << r.randrange(22, 43)) ^ sum(1 << b for b in r.sample(range(43, 64), 2)) for _ in range(8)]
        fp = np.array([base, *others], np.uint64).view(np.int64)
        keys, rows = bucket_keys(g, fp)
        mine = set(keys[rows == 0].tolist())
        for i in range(1, len(fp)):
            assert mine & set(keys[rows == i].tolist()), bin(base ^ others[i - 1])


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_forest_and_buckets_keep_components():
    r = np.random.default_rng(2)
    ball = np.unique(r.integers(0, 1 << 12, 400)).astype(np.int64)
    far = r.integers(0, 1 << 62, 50)
    fp = np.concatenate([ball, far])
    brute = [(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and bin(a ^ b).count("1") <= 4]
    a, b = forest(fp)
    assert roots(fp.tolist(), zip(a.tolist(), b.tolist())) == roots(fp.tolist(), brute) and len(a) < len(fp)
    keys, rows = bucket_keys(Golay(), fp)
    order = np.argsort(keys, kind="stable")
    a, b = bucket_links(keys[order], fp[rows[order]])
    assert roots(fp.tolist(), zip(a.tolist(), b.tolist())) == roots(fp.tolist(), brute)


def test_components_of_chains_hubs_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1), (5, 6), (6, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(edges.limit(0), "a", "b").count() == 0


def corpus():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "a b", "a b"]
    for _ in range(25):
        words = r.choices(vocab, k=r.randrange(3, 200))
        texts.append(" ".join(words))
        for _ in range(r.randrange(6)):
            copy = list(words)
            copy[r.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    return texts


def test_components_of_documents(spark):
    texts = corpus()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a b", None, None, None), (None, "only here without id", None, None, None), (3, "a b", "x", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash_components(docs).collect()
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    root = roots(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    want = sorted((str(r[0]), f"{fps[i]:016x}", str(least.get(root[i]))) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(root.values()))
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(least.get(x)) for x in set(root.values()))
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def in_parts(fp):
    keys, members = simhash.parts(np.zeros(len(fp), np.int64), fp)
    order = np.argsort(keys, kind="stable")
    assert np.unique(keys, return_counts=True)[1].max() < len(fp)
    return bucket_links(keys[order], members[order])


def test_large_bucket_meets_in_parts():
    """A bucket of 100,000 distinct fingerprints, far apart but for planted neighbours: all links, without comparing all pairs."""
    r = np.random.default_rng(3)
    fp = np.unique(r.integers(0, 1 << 63, 100_000, np.int64) | 0x3FFFFF).view(np.uint64)
    base = fp[:3000]
    near = base.copy()
    for k in range(len(near)):
        for bit in r.choice(np.arange(22, 63), r.integers(1, 5), replace=False):
            near[k] ^= np.uint64(1 << int(bit))
    everyone = np.unique(np.concatenate([fp, near])).view(np.int64)
    a, b = in_parts(everyone)
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 4).all()
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    planted = {(min(x, y), max(x, y)) for x, y in zip(base.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True)}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in found:
        root[top(x)] = top(y)
    assert all(top(x) == top(y) for x, y in planted) and len(found) < 4 * len(planted)
    cluster = np.unique(np.uint64(5) ^ sum((np.uint64(1) << r.integers(0, 64, 6000).astype(np.uint64)) for _ in range(2))).view(np.int64)
    a, b = in_parts(cluster)
    want = simhash.forest(cluster)
    assert len(np.unique(np.concatenate([a, b]))) == len(np.unique(np.concatenate(want)))


@pytest.mark.parametrize("large", [1, 3, 1000])
def test_links_of_large_buckets_are_dealt_again(spark, monkeypatch, large):
    """Whatever counts as large, and however batches cut a bucket, components are those of all pairs."""
    monkeypatch.setattr(simhash, "LARGE", large)
    r = np.random.default_rng(9)
    fp = np.unique(np.concatenate([r.integers(0, 1 << 11, 150), r.integers(0, 1 << 62, 40)]))
    brute = [(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and (a ^ b).bit_count() <= 4]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = [(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in fp.tolist()], "fp long")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert roots(fp.tolist(), found) == roots(fp.tolist(), brute)
