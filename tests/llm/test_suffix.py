"""Run-length index and repeat removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codegraph.llm.suffix import RunIndex, _emit_anchors, anchors, split_context, suffix_dedup

DOCS = "doc_id long, text string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, hit) if not x)
        spans = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_index_finds_exactly_the_repeated_windows():
    r = random.Random(4)
    for length in (3, 8, 20):
        base = bytes(r.choices(b"ab\x00\xff", k=120))
        contexts = []
        for _ in range(30):
            c = bytearray(base[(a := r.randrange(60)) : a + r.randrange(60)])
            for _ in range(r.randrange(3)):
                if c:
                    c[r.randrange(len(c))] = r.choice(b"abc")
            contexts.append(bytes(c))
        contexts += [b"", b"a", b"a" * 40]
        index = RunIndex(contexts)
        assert len(index.start) < index.n
        got = sorted(zip(*(x.tolist() for x in index.repeats(length)), strict=True))
        seen = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        assert got == [(w, i) for w, c in enumerate(contexts) for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1]
        some = np.array([5, 2, 9])
        assert sorted(set(index.repeats(length, some)[0].tolist())) == sorted({w for w, _ in got} & {2, 5, 9})


def test_windows_are_dealt_to_anchors_once_and_alike():
    r = random.Random(1)
    shared = bytes(r.choices(b"abcdef", k=300))
    a, b = bytes(r.choices(b"abcdef", k=777)) + shared + b"zz", shared + b"y" * 400
    picked = []
    for text in (a, b):
        h, place, lo, hi = anchors(text, 64, 16)
        assert lo[0] == 0 and hi[-1] == len(text) - 64 and (lo[1:] == hi[:-1] + 1).all()
        picked.append({text[s : s + 64]: int(p) - s for p, x, y in zip(place, lo, hi) for s in range(x, y + 1)})
    common = set(picked[0]) & set(picked[1])
    assert len(common) >= 237 and all(picked[0][w] == picked[1][w] for w in common)
    assert len(anchors(b"x" * 63, 64, 16)[0]) == 0


def test_long_texts_are_taken_in_blocks(monkeypatch):
    text = bytes(random.Random(3).choices(range(256), k=3000))

    def dealt():
        h, place, lo, hi = anchors(text, 64, 16)
        return {s: (int(a), int(p)) for a, p, x, y in zip(h, place, lo, hi) for s in range(x, y + 1)}

    whole = dealt()
    monkeypatch.setattr("codegraph.llm.suffix.PLACE", 8)
    assert dealt() == whole and sorted(whole) == list(range(3000 - 63))


def corpus(seed):
    r = random.Random(seed)
    para = ["".join(r.choices("abcdeé \n", k=r.randrange(20, 200))) for _ in range(12)]
    texts = [None, "", "short", "a" * 500, "é" * 300]
    for _ in range(40):
        t = "".join(r.choices(para, k=r.randrange(1, 6))) if r.random() < 0.6 else "".join(r.choices("abcdeé \n", k=r.randrange(400)))
        if r.random() < 0.5 and t:
            i = r.randrange(len(t))
            t = t[:i] + "#" + t[i + 1 :]
        texts.append(t)
    return [*texts, texts[-1], para[0] * 3]


@pytest.mark.parametrize("hot,block,cut", [(4096, 1_500_000, 2048), (1, 1_500_000, 2048), (4096, 2_000, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, block, cut):
    monkeypatch.setattr("codegraph.llm.suffix.CUT", cut)
    texts = corpus(hot)
    rows = list(enumerate(texts)) + [(None, texts[9]), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame(rows, DOCS)
    got = suffix_dedup(docs, length=64, kmer=16, hot=hot, block=block, with_bytes=True).collect()
    want = brute([t for _, t in rows], 64)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_at_full_length_and_empty(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = word(700)
    texts = [word(300) + passage + word(200), passage[:650] + word(900), word(500), word(10) + passage[100:499], word(2000) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in suffix_dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_crowded_anchors_are_split_and_found_again(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    middle, sides = word(60), [(word(30), word(30)) for _ in range(6)]
    texts = [word(40) + middle + word(40) for _ in range(60)]
    texts += [word(20) + r.choice(sides)[0][r.randrange(25) :] + middle + r.choice(sides)[1][: r.randrange(30)] + word(20) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = brute(texts, 64)
    assert sum(w[1] > 0 for w in want) > 30
    for hot in (1, 5, 40):
        got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in suffix_dedup(docs, length=64, kmer=16, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_parts_of_a_context_share_its_windows_out():
    r = random.Random(2)
    for _ in range(300):
        length, a = r.randrange(20, 60), r.randrange(30)
        b = a + r.randrange(4, 20)
        first, last = max(0, b - length), a
        raw = bytes(r.choices(b"abc", k=length + r.randrange(max(b - length, 0), a + 1)))
        if first > len(raw) - length:
            continue
        windows = set()
        for start, end, x, y in split_context(len(raw), a, b, length):
            assert y - x > b - a and 0 <= x
            for s in range(start, end - length + 1):
                if first <= s <= last:
                    assert s <= start + x and start + y <= s + length and s not in windows
                    windows.add(s)
        assert windows == {s for s in range(len(raw) - length + 1) if first <= s <= last}


def test_repeated_places_of_a_periodic_text_leave_a_task_merged():
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["ab" * 50_000, "ab" * 500]), pa.array([5, 6])], ["id", "text", "k"])
    marks = [(r["id"], r["lo"], r["hi"]) for b in _emit_anchors(400, 128)(iter([docs])) for r in b.to_pylist() if r["kind"] == 0]
    assert marks == [(1, 0, 100_000), (2, 0, 1000)]
