"""PII, decontamination, license scan, exact and line dedup against brute force, with hard inputs."""

import hashlib
import re

import pytest

from codegraph.llm import decontam, license, pii
from codegraph.llm.exact import exact_dedup, text_classes
from codegraph.llm.license import license_scan
from codegraph.llm.lines import line_dedup
from codegraph.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def docs(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, DOCS)


HARD = [None, "", " ", "a" * 50_000, "x@y.z " * 3, "é ü \U0001f600 x@a.b", "same", "same", "1" * 30_000, "+" + "1-" * 20_000]


def brute_spans(text):
    text = text or ""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            good = {
                "email": True,
                "ip": all(int(x or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and doubled % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PII = [
    "write a.b+c@d.e.f@g.hh now, @no.local and x@y, u@v.w.",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 41111111111111119999999",
    "host 1.2.3.4.5.6.7.8 and 300.1.1.1 and 0001.002.3.255",
    "call +1 (743) 555-3824 or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "IBAN GB82 WEST 1234 5698 7654 32 bad GB83 WEST 1234 5698 7654 32",
    "social security 078-05-1120 and 078-05-1121" + "z" * 80 + " 123-45-6789",
]


def test_pii_base_spans_equal_plain_patterns():
    for text in [*PII, *[t for t in HARD if t and len(t) < 1000]]:
        found = [x for x in pii.spans(text) if x[0] in pii.BASE]
        assert pii._written(found) == brute_spans(text)


def test_pii_added_kinds_need_checksum_or_context():
    assert [x[0] for x in pii.spans(PII[4])] == ["iban"]
    assert [x[0] for x in pii.spans(PII[5])] == ["ssn", "ssn"]
    assert pii.redact("to a@b.c and 1.2.3.4") == "to <email> and <ip>"


def test_pii_hard_rows(spark):
    rows = pii.pii_scan(docs(spark, HARD, [(None, "a@b.c", None, None, None)])).collect()
    assert len(rows) == len(HARD) + 1
    by = {r.doc_id: r for r in rows}
    assert by[0].spans == "" and by[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].n_email == 3 and by[None].n_email == 1
    assert by[5].spans == "email:6:11"
    assert pii.pii_scan(docs(spark, [])).count() == 0


def brute_contamination(text, items, window=13):
    w = WORD.findall(lower(text or ""))
    hit, ids = set(), set()
    for i, t in items:
        v = WORD.findall(lower(t or ""))
        n = min(window, len(v))
        if not n:
            continue
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_equals_brute_force(spark):
    import random

    r = random.Random(3)
    alphabet = "a b c É".split()
    items = [(i, " ".join(r.choices(alphabet, k=r.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t.split()) not in (1, 2)] + [(99, None), (98, "...")]
    texts = [" ".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(60)]
    texts += [f"zz {items[k][1].upper()} yy," * 2 for k in range(10)] + HARD
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10_000, 150):
        got = decontam.contamination(docs(spark, texts), bench, block_chars=block, keep=["doc_id"]).collect()
        assert len(got) == len(texts)
        for row in got:
            f = row.found
            assert (f.n_words, f.n_hit, f.item_ids, f.contaminated) == brute_contamination(texts[row.doc_id], items), texts[row.doc_id]
    kept = decontam.decontaminate(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.found.contaminated}
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs(spark, texts), bench, cut=True).collect()}
    for row in got:
        f = row.found
        if not f.contaminated:
            words = WORD.findall(texts[row.doc_id] or "")
            gone = {k for a, b in f.hits for k in range(a, b)}
            assert WORD.findall(cut[row.doc_id] or "") == [w for k, w in enumerate(words) if k not in gone]
    assert decontam.cut_words("One, two three. Four!", [[1, 3]]) == "One, . Four!" and decontam.cut_words("é a", [[0, 2]]) == " "
    assert decontam.contamination(docs(spark, texts), bench.limit(0)).filter("found.n_hit > 0").count() == 0


LICENSED = [
    "CC BY cc-by, cc  by", "the General Public License. general public license all rights", "All Rights Reserved all rights all rights reserved",
    "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, totally free of charge, to any person obtaining a copy of this software and associated documentation files", "cc",
]


def test_license_base_places_and_spans(spark):
    texts = LICENSED + LICENSED[:2] + HARD
    got = {r.doc_id: r for r in license_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        places = [(k, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert got[3].labels == "apache-2.0" and got[3].score == 1.0
    assert got[4].labels == "mit" and 0.75 <= got[4].score < 1
    assert license_scan(docs(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = {r.doc_id: r for r in exact_dedup(docs(spark, HARD, [(None, "same", None, None, None)])).collect()}
    assert rows[0].keep_id == rows[1].keep_id == 1 and rows[0].group_size == 2
    assert rows[None].keep_id == 7 and rows[None].group_size == 3 and not rows[None].kept and rows[7].kept
    assert exact_dedup(docs(spark, [])).count() == 0
    hot = docs(spark, ["h"] * 500 + ["u"])
    assert sorted((r["_n"], r["_keep"]) for r in text_classes(hot, "doc_id", hot.text, 4).collect()) == [(1, 500), (500, 499)]


def test_line_dedup_keeps_first_and_spares_short(spark):
    line = "this line stands on very many sites"
    rows = [(i, f"own line number {i} of its document\n  {line} \nshort", "en", f"s{i}", 0) for i in range(12)]
    rows += [(20, None, "en", None, 0), (21, "", "en", "s1", 0), (22, f"{line}\n{line}", None, None, None)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].n_removed == 0 and out[0].text == rows[0][1]
    assert all(out[i].n_removed == 1 and out[i].text == f"own line number {i} of its document\nshort" for i in range(1, 12))
    assert out[20].text is None and out[20].n_lines == 1
    assert out[21].text == "" and out[22].text == "" and out[22].n_removed == 2
    few = spark.createDataFrame([r for r in rows if r[0] < 9], DOCS)
    assert line_dedup(few).filter("n_removed > 0").count() == 0
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", [n for n in queries() if n.startswith("op")])
def test_queries_ignore_extra_columns_and_keep_rows(spark, tmp_path, name):
    """Every registered query runs over tables with nulls, repeats and clashing extra columns, and over empty ones."""
    names = "n_words text_sha256 _k1 _id _text id row found start length rank lo".split()
    full = docs(spark, HARD, [(3, "again", None, None, None), (3, "again", None, None, None)])
    pages = spark.createDataFrame([(1, "http://a", "<p>" * 500), (2, None, "<p>" * 500), (None, "u", None), (4, "u\r\nx", "")], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, "some item words"), (None, None)], "item_id long, text string")
    from pyspark.sql import functions as F

    for kind, cut in (("full", 1000), ("empty", 0)):
        d = tmp_path / kind
        for label, df in (("documents", full), ("pages", pages), ("benchmark", bench)):
            df.limit(cut).withColumns({c: F.lit(1) for c in names if c not in df.columns}).write.parquet(str(d / f"{label}.parquet"))
        out = queries()[name](spark, str(d)).collect()
        assert (len(out) > 0) == (kind == "full")


def test_iban_ends_at_its_countrys_length():
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    for text, want in [
        (f"{gb} BIC WESTGB2L", [gb]), (f"{de} EUR 100", [de]), (f"{gb} {de}", [gb, de]), (f"AB12 {de} X", [de]), (de.replace(" ", "") + "EUR", []),
        (f"{de[:-1]}1 EUR 100", []), (f"x {gb}.", [gb]), (gb.replace(" ", ""), [gb.replace(" ", "")]),
    ]:
        assert [text[a:b] for kind, a, b, _ in pii.spans(text) if kind == "iban"] == want


def test_license_votes_count_on_the_merged_run(spark):
    texts = ["released under the permissive MIT License", "licensed under the apache license version number 2 0", "under the license", "released under a permissive license"]
    got = {r.doc_id: r.labels for r in license_scan(docs(spark, texts)).collect()}
    assert got == {0: "mit", 1: "apache-2.0", 2: "", 3: ""}


def brute_labels(text):
    """Labels and score by the rule, pair by pair: positions that stand on a diagonal or up to DRIFT beside it."""
    w = WORD.findall(lower(text or ""))
    labels, score = set(), 0.0
    for phrase, label in license.PHRASES:
        p = phrase.split()
        if any(w[k : k + len(p)] == p for k in range(len(w))):
            labels.add(label)
            score = 1.0
    for phrase, label in license.TEMPLATES:
        said = phrase.split()
        p = [x.lower() for x in said]
        pairs = list(zip(p, p[1:]))
        decides = [x.isupper() or x.isdigit() for x in said] + [False]
        must = [{i} if decides[i + 1] else {i - 1, i} for i in range(len(said)) if decides[i] and (decides[i + 1] or not (i and decides[i - 1]))]
        seen = {}
        for pos, pair in enumerate(zip(w, w[1:])):
            for i, q in enumerate(pairs):
                if pair == q:
                    seen.setdefault(pos - i, set()).add(i)
        for d in seen:
            near = set().union(*(s for e, s in seen.items() if abs(e - d) <= license.DRIFT))
            if len(near) >= -(-3 * len(pairs) // 4) and all(m & near for m in must):
                labels.add(label)
                score = max(score, len(near) / len(pairs))
    return ",".join(sorted(labels)), score


def test_license_labels_and_score_equal_brute_force(spark):
    import random

    r = random.Random(5)
    texts = ["Licensed under the GNU General Public License, version 2", "licensed under the gnu general public license version 3", "GNU Lesser General Public License, licensed under the version 3"]
    for phrase, _ in license.TEMPLATES * 4:
        w = phrase.split()
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [w[i], "really"], ["other"], [w[i], w[i]]])
        texts.append(" ".join(["so"] * r.randrange(5) + w + ["and"] + r.choice(license.TEMPLATES)[0].split()[: r.randrange(9)]))
    texts.append("the software of the license to the version " * 200)
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in license_scan(docs(spark, texts)).collect()}
    assert got == {i: (a, round(b, 9)) for i, (a, b) in enumerate(map(brute_labels, texts))}
    assert got[0][0].split(",") == ["gpl", "gpl-2.0"] and "gpl-3.0" in got[1][0] and "gpl-3.0" not in got[2][0].split(",")
    assert max(len(t.split()) for t, _ in license.TEMPLATES) > 64  # votes are not bound to the bits of a word
