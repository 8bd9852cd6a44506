"""WARC round trip and salvage, packing layouts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codegraph.llm import packing, warc

TOK = public_tokenizers.path("byte_bpe_50k.json")


def read(raw):
    return list(warc.salvage(lambda at, n: raw[at : at + n], len(raw)))


def records(n=5, plain=False):
    out = []
    for i in range(n):
        body = f"<p>{i}</p>".encode() * 50
        one = warc.record("response", i, "http://x/ü", warc.payload_digest(body), len(body), body)
        out.append(one if plain else warc.member(one))
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_sound_archive_has_no_gaps(plain):
    found = read(b"".join(records(plain=plain)))
    assert [x[0] for x in found] == ["record"] * 5
    assert [x[3][0]["warc-record-id"] for x in found] == [f"<urn:page:{i}>" for i in range(5)]


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_recovers_after_damage_and_logs_exact_gaps(plain):
    parts = records(plain=plain)
    at = [0, *np.cumsum([len(x) for x in parts]).tolist()]
    raw = bytearray(b"".join(parts))
    raw[at[1] + 200] ^= 0xFF  # a payload or member byte
    raw[at[3] : at[3] + 3] = b"xxx"  # a start
    found = read(bytes(raw))
    assert [(x[0], x[1], x[2]) for x in found] == [
        ("record", at[0], at[1]), ("gap", at[1], at[2]), ("record", at[2], at[3]), ("gap", at[3], at[4]), ("record", at[4], at[5])
    ]
    cut = read(bytes(raw[:-10]))
    assert [x[0] for x in cut] == ["record", "gap", "record", "gap"] and cut[-1][1:3] == (at[3], len(raw) - 10)
    junk = read(b"\x1f\x8b\x08 junk WARC/1. more" + b"".join(parts[:1]) + b"tail")
    assert [x[0] for x in junk] == ["gap", "record", "gap"]
    assert read(b"") == []


@pytest.mark.parametrize("cut", [0, 20])
def test_records_inside_a_damaged_member_are_kept(cut):
    """Ten records in one member: one damaged before packing, or the member cut short, loses that one record alone."""
    parts = records(10, plain=True)
    if not cut:
        parts[4] = parts[4].replace(b"<p>4</p>", b"<p>x</p>", 1)
    raw = warc.member(b"".join(parts))
    found = read(raw[: len(raw) - cut] if cut else raw)
    ids = [x[3][0]["warc-record-id"] for x in found if x[0] == "record"]
    gaps = [x for x in found if x[0] == "gap"]
    assert ids == [f"<urn:page:{i}>" for i in range(10) if i != (9 if cut else 4)] and len(gaps) == 1
    at = np.cumsum([0, *map(len, parts)]).tolist()
    assert gaps[0][4] == ((at[9], at[9]) if cut else (at[4], at[5])) and (gaps[0][1], gaps[0][2]) == (0, len(raw) - cut)
    tail = warc.member(parts[0])
    assert [x[0] for x in read((raw[: len(raw) - cut] if cut else raw) + tail)].count("record") == 10


def test_damage_in_packed_bytes_keeps_what_inflated_before(monkeypatch):
    import random

    monkeypatch.setattr(warc, "PIECE", 64)
    r = random.Random(1)
    parts = []
    for i in range(40):
        body = bytes(r.choices(range(256), k=2000))
        parts.append(warc.record("response", i, "u", warc.payload_digest(body), len(body), body))
    raw = bytearray(warc.member(b"".join(parts)))
    raw[len(raw) // 2] ^= 0x55
    found = read(bytes(raw))
    ids = [int(x[3][0]["warc-record-id"][10:-1]) for x in found if x[0] == "record"]
    assert ids[:19] == list(range(19)) and len(ids) < 40 and any(x[0] == "gap" for x in found)
    assert len(set(ids)) == len(ids)


def test_a_long_tail_without_header_end_is_read_in_bounds():
    asked = []
    raw = b"WARC/1.1\r\nx: y\r\n" * 300_000

    def read_at(at, n):
        asked.append(n)
        return raw[at : at + n]

    import itertools

    assert len(list(itertools.islice(warc.salvage(read_at, len(raw[:200_000])), 5))) == 1
    assert max(asked) <= max(warc.CHUNK, warc.HEADER)


@pytest.mark.parametrize("plain", [False, True])
def test_a_false_length_holds_no_more_than_a_record(monkeypatch, plain):
    """One false length near the start of a long run of records: that record alone is lost, and little is held."""
    monkeypatch.setattr(warc, "HOLD", 1 << 16)
    parts = records(4000, plain=True)
    false = b"Content-Length: 2000000" if plain else b"Content-Length: 9000000"
    parts[3] = parts[3].replace(b"Content-Length: ", b"X-Length: ", 1).replace(b"Content-Type: application", false + b"\r\nContent-Type: application", 1)
    parts[3] = parts[3].replace(b"\r\nX-Length: " + parts[3].split(b"X-Length: ")[1].split(b"\r\n")[0], b"", 1)
    raw = b"".join(parts) if plain else warc.member(b"".join(parts))
    held, more = [], warc.Member.more

    def watched(self):
        out = more(self)
        held.append(len(self.held))
        return out

    monkeypatch.setattr(warc.Member, "more", watched)
    found = [x for x in read(raw)]
    ids = [x[3][0]["warc-record-id"] for x in found if x[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in range(4000) if i != 3]
    assert [x[0] for x in found].count("gap") == 1
    assert max(held, default=0) < 1_500_000 or plain


def test_long_records_pass_the_same_checks(monkeypatch):
    """Blocks above HOLD, in members and plain: sound ones are read, one with a changed byte is quarantined."""
    monkeypatch.setattr(warc, "HOLD", 1000)
    monkeypatch.setattr(warc, "CHUNK", 700)
    monkeypatch.setattr(warc, "PIECE", 50)
    body = b"".join(b"<p>%d</p>" % (i * i) for i in range(900))
    sound = warc.record("response", 1, "u", warc.payload_digest(body), len(body), body)
    bad = sound.replace(b"<p>81</p>", b"<p>18</p>", 1).replace(b"page:1", b"page:2", 1)
    tail = warc.record("response", 3, "u", warc.payload_digest(b"x"), 1, b"x")
    for raw in (sound + bad + tail, warc.member(sound + bad + tail), b"".join(map(warc.member, (sound, bad, tail)))):
        found = read(raw)
        assert [x[0] for x in found] == ["record", "gap", "record"]
        assert found[0][3][1].endswith(body) and found[2][3][0]["warc-record-id"] == "<urn:page:3>"


def test_round_trip(spark, tmp_path):
    same = "<p>" * 400
    rows = [(1, "http://a", same), (7, "http://b", same), (3, None, same), (4, "u\r\nx", "short"), (5, "u", "short"), (6, "u", None), (None, "u", same), (7, "http://b", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=200)
    assert listed.count() > 1
    out = [r.asDict() for r in warc.read_archives(listed, payloads=True).collect()]
    assert len(out) == len(rows) and {r["kind"] for r in out} == {"record"}
    for r in out:
        html = {1: same, 7: same, 3: same, 4: "short", 5: "short", 6: "", None: same}[r["page_id"]].encode()
        revisit = r["page_id"] in (1, 3, None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else html)
    assert warc.roundtrip(pages.limit(0)).count() == 0


def check_layout(rows, window=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq, by_doc


def test_packing(spark):
    texts = ["hello world " * 3000, "", None, "<|endoftext|> x", "日本語 text", "a" * 9000] + ["one two three"] * 300 + [f"word {i} " * (i % 37 * 8) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, TOK, with_ids=True).collect()
    seqs, by_doc = check_layout(rows)
    own = Tokenizer.from_file(TOK)
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id]) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert got == ids
    total = sum(map(len, ids.values()))
    assert len(seqs) * 2048 < total * 1.02 + 2048
    assert packing.pack(docs.limit(0), TOK).count() == 0


def test_plan_places_every_rank_once_and_fills():
    r = np.random.default_rng(1)
    lengths = np.minimum(2047, r.lognormal(6, 1, 50_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)) | {7: 30_000, 2048: 10}
    slots = packing.plan(counts)
    for k, n in counts.items():
        own = sorted((lo, hi) for length, lo, hi, *_ in slots if length == k)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    used = sum(k * n for k, n in counts.items())
    assert max(s + (hi - lo) // m for _, lo, hi, s, _, m in slots) * 2048 < used * 1.01
    assert packing.plan({}) == [] and packing.plan({5: 1}) == [(5, 0, 1, 0, 0, 1)]


def test_fast_and_slow_encoders_agree():
    e = packing.Encoder(TOK)
    for t in ["It's a  test\n\n\tof: things… “quoted” 12,345.67€ éàü ñ¿?", " lead", "trail  ", "\r\n x", "a" * 300, "it'll 'VE 've"]:
        assert not packing.PLAIN.search(t), t
        assert e(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids, t


def test_full_windows_are_ranked_in_many_parts(spark, monkeypatch):
    """A million full pieces: every one in a sequence of its own, in about a thousand parts."""
    from pyspark.sql import functions as F

    made = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(2048).cast("long").alias("length"), F.xxhash64("id").alias("ids_crc32"), F.lit(2048).cast("long").alias("doc_tokens"))
    monkeypatch.setattr(packing, "cut", lambda *a, **k: made)
    out = packing.pack(spark.createDataFrame([(1, "x")], "doc_id long, text string"), TOK)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence_id").alias("s"), F.max("sequence_id").alias("m"), F.max("offset").alias("o")).first()
    assert (r.n, r.s, r.m, r.o) == (1_000_000, 1_000_000, 999_999, 0)
    parts = made.groupBy(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1000))).count()
    assert parts.agg(F.max("count")).first()[0] < 1300
