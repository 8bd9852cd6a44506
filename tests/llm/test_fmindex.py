"""Passage dedup and its index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from codegraph.llm import fmindex
from codegraph.llm.fmindex import FMIndex, Wavelet, passage_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """rows (id, text) in document order, without repeats -> {(id, text): (n_words, n_removed, kept_sha256)}."""
    seen, out = set(), {}
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for a in range(len(words) - length + 1):
            window = tuple(words[a : a + length])
            if window in seen:
                gone.update(range(a, a + length))
            seen.add(window)
        kept = " ".join(w for a, w in enumerate(words) if a not in gone)
        out[i, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(spark, rows, length, parts=3, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for name in ("id", "k", "want", "a.b"):
        df = df.withColumn(name, df["text"])
    if not rows:
        return []
    keys = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()): r for r in rows}
    got = passage_dedup(df, length=length, with_text=True, **kw).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed for r in got)
    assert len(keys) == len({*rows})
    return [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in got]


def texts(seed, n, size, words):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 14))) for _ in range(8)]
    return [(i, rng.choice(" \n\t") .join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randrange(size)))) for i in range(n)]


@pytest.mark.parametrize("seed,hot,block,span,words", [(1, 512, 10**6, 10**6, "abcdefgh"), (2, 2, 40, 7, "ab"), (3, 3, 1, 50, ["é", "x", "\U0001f600y", "a b"])])
def test_equals_brute_force(spark, monkeypatch, seed, hot, block, span, words):
    """Crowded anchors, blocks of one anchor and scans of a few words give the same rows."""
    monkeypatch.setattr(fmindex, "SPAN", span)
    rows = texts(seed, 40, 30, words)
    want = brute(rows, 6)
    got = run(spark, rows, 6, gram=3, hot=hot, block=block)
    assert sorted(got) == sorted((i, want[i, t]) for i, t in rows)


def test_hard_rows(spark):
    """Nulls, blanks, ids that repeat, long and periodic texts; rows that repeat id and text count once."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5000), (5, passage), (6, f"x {passage} y"), (7, " ".join(f"w{i}" for i in range(19))), (8, passage.upper()), (9, "z" * 50_000), (10, "a " * 30 + passage)]
    want = brute(rows, 20)
    got = run(spark, rows, 20)
    assert sorted(got) == sorted((i, want[i, t]) for i, t in rows)
    twice = dict(run(spark, [(5, passage), (5, passage), (6, passage)], 20))
    assert twice == {5: want[5, passage], 6: (60, 60, hashlib.sha256(b"").hexdigest())}
    assert sorted(x[1][1] for x in run(spark, [(None, passage), (3, passage), (3, passage + " more")], 20)) == [0, 60, 60]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passage_dedup(df).collect() == []


def test_string_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("b", passage), ("a", passage)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in passage_dedup(df).collect()} == {"a": 0, "b": 30}


def test_a_crowded_passage_in_many_documents(spark):
    """One short passage between words of their own in 300 documents: over `hot` contexts an anchor."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join([*(f"u{rng.random()}" for _ in range(30)), passage, *(f"v{rng.random()}" for _ in range(30))])) for i in range(300)]
    assert dict(run(spark, rows, 20, hot=16)) == {i: v for (i, _), v in brute(rows, 20).items()}


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 37, 1000)
    w = Wavelet(x)
    symbol, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert w.rank(symbol, at).tolist() == [int((x[:a] == s).sum()) for s, a in zip(symbol, at, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_every_window_of_streams_outside_the_index(seed):
    rng = np.random.default_rng(seed)
    length = 5
    index = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(20)]
    streams = [rng.integers(1, 5, rng.integers(0, 60)) for _ in range(15)] + [index[3]]
    there: dict = {}
    for s in index:
        for i in range(len(s) - length + 1):
            there[tuple(s[i : i + length])] = there.get(tuple(s[i : i + length]), 0) + 1
    flat = lambda x: (np.concatenate(x).astype(np.int64), np.array([len(s) for s in x], np.int64))
    stream, start, row, count = FMIndex(*flat(index), length).search(*flat(streams))
    got = sorted(zip(stream.tolist(), start.tolist(), count.tolist(), strict=True))
    want = [(k, i, there[w]) for k, s in enumerate(streams) for i in range(len(s) - length + 1) if (w := tuple(s[i : i + length])) in there]
    assert got == sorted(want)
    named = {tuple(streams[k][i : i + length]): r for k, i, r in zip(stream, start, row, strict=True)}
    assert len(set(named.values())) == len(named)
