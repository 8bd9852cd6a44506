"""The conversation trie against brute force."""

import hashlib
import random
import zlib

import pytest

from codegraph.llm import trie
from codegraph.llm.trie import prefix_trie, rebuild

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        kids = {p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path}
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.append(
            (
                min(members),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                len(kids),
                sum(not any(len(q) > len(p) and q[: len(p)] == p for q in nodes) for p, _ in below),
                sum((len(m) - 1) * len(p[-1][1]) for p, m in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def run(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, df["text"])
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(*rebuild(df)).collect()), key=repr)


HARD = [
    (0, 0, "user", "hi"),
    (0, 1, None, "there"),
    (0, 1, None, None),
    (0, None, "user", "first"),
    (0, 2, "user", "\U0001f600 é"),
    (0, 3, "user", ""),
    (7, 0, "user", "only"),  # shorter than what it borrows
    (150, 0, "user", "no base"),  # conversation 100 is absent
    (-150, 0, "a", "b"),
    (-100, 0, "a", "b"),
    (-100, 0, "a", "b"),
    (None, 0, "user", "of no conversation"),
    (3, 0, "ab", "c"),
    (4, 0, "a", "bc"),
]


def test_hard_cases_equal_brute_force(spark):
    assert run(spark, HARD, extra=["conv", "k1", "part", "a.b"]) == brute(HARD)


def test_empty_table_has_no_nodes(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations_in_small_pieces(spark, monkeypatch, seed):
    """Long, repeated and branching conversations, with stretches of three turns and end pieces of two ids."""
    monkeypatch.setattr(trie, "STRETCH", 3)
    monkeypatch.setattr(trie, "PIECE", 1)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(230), 60):
        rows += [(c, t, rng.choice("ua"), rng.choice(["", "x", "yy"])) for t in range(rng.choice([1, 2, 5, 9]))]
    long = [(t, "u", "ab"[t % 2] * (t % 4)) for t in range(40)]
    for c in (300, 301, 302, 400):
        rows += [(c, *x) for x in long[: 40 - c % 100]]
    rows += [(500 + i, 0, "u", "the same") for i in range(40)]  # many end at one node
    assert run(spark, rows) == brute(rows)
