"""Language identification: kernel values, held-out accuracy, hard inputs."""

import random
import zlib

import numpy as np

from codegraph.llm import langid

DOCS = "doc_id long, text string, lang string"
SYLLABLES = {"xa": "ka lo mi tu".split(), "xb": "sch ein gen ver".split(), "xc": "né eau ou ç".split()}


def corpus(n=240):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(1, 60))]
        out.append((i, " ".join(words).capitalize(), lang))
    return out


def test_product_is_the_blended_presence_kernel():
    texts = ["Abc abd", "abd é", "x", "zz" * 3000]
    bits = langid.presence(texts)
    k = langid.spectra(bits) @ langid.spectra(bits).T
    at = np.cumsum([0, *langid.BITS])
    for i in range(len(texts)):
        for j in range(len(texts)):
            want = 0
            for a, b in zip(at[:-1], at[1:]):
                x, y = set(np.flatnonzero(bits[i, a:b])), set(np.flatnonzero(bits[j, a:b]))
                want += len(x & y) / max(1, len(x) * len(y)) ** 0.5 / len(langid.BITS)
            assert abs(k[i, j] - want) < 1e-5
    assert bits[0].sum() == len(set("abc abd")) + len({"ab", "bc", "c ", " a", "bd"}) + len({"abc", "bc ", "c a", " ab", "abd"})


def test_long_texts_are_read_to_their_end():
    end = langid.presence(["bcd"])[0]
    long = langid.presence(["a" * langid.CHARS + "bcd"])[0]
    assert (long[end == 1] == 1).all() and long[: langid.BITS[0]].sum() == 4


def test_letters():
    assert langid.has_letter("1 ² é") and not langid.has_letter("1 ² _ -") and not langid.has_letter("") and langid.has_letter("ª")


def test_held_out_accuracy_and_rows(spark):
    rows = corpus() + [(900, None, "xa"), (901, "", "xa"), (902, "12 34!", "xb"), (None, "ka lo", None), (903, "schein" * 20_000, None), (5, "ka lo mi", "xa")]
    got = langid.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[None].lang_pred == "xa" and not by[None].held_out and by[903].lang_pred == "xb"
    want = {i: (lang, zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang in corpus() if i != 5}
    assert all(by[i].held_out == h for i, (_, h) in want.items())
    held = [by[i].lang_pred == lang for i, (lang, h) in want.items() if h]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.language_id(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    out = langid.language_id(spark.createDataFrame([(2, "text", None)], DOCS)).collect()
    assert (out[0].lang_pred, out[0].score) == ("und", 0.0)
    docs = spark.createDataFrame(corpus(40) + [(99, "..", "xa")], DOCS)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40))


def test_stage_keeps_texts_where_nothing_can_be_learned_from(spark):
    rows = [(2, "text", None), (3, "12 34", None), (4, None, None), (None, "more text", None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}


def test_model_equals_dense_kernel_ridge():
    """With every training text a landmark, the folded matrix gives what weighted kernel ridge regression on the dense kernel gives."""
    rows = corpus(90)
    texts, labels = [t for _, t, _ in rows[:60]], [x for _, _, x in rows[:60]]
    bits = langid.presence(texts)
    model = langid.Model(np.packbits(bits, axis=1), labels, landmarks=60, ridge=0.05)
    languages = sorted(set(labels))
    target = np.array([[x == y for y in languages] for x in labels], float)
    weight = np.array([len(labels) / len(languages) / labels.count(x) for x in labels])
    train = langid.spectra(bits).astype(float)
    kernel = train @ train.T
    alpha = np.linalg.solve(weight[:, None] * kernel + 0.05 * len(labels) * np.eye(60), weight[:, None] * target)
    fresh = [t for _, t, _ in rows[60:]]
    want = langid.spectra(langid.presence(fresh)).astype(float) @ train.T @ alpha
    assert np.abs(model.outputs(fresh) - want).max() < 1e-3


def test_nystroem_approximates_the_dense_solution():
    rows = corpus(400)
    bits = np.packbits(langid.presence([t for _, t, _ in rows[:300]]), axis=1)
    labels = [x for _, _, x in rows[:300]]
    fresh = [t for _, t, _ in rows[300:]]
    dense, few = langid.Model(bits, labels, landmarks=300), langid.Model(bits, labels, landmarks=100)
    assert np.mean(dense.outputs(fresh).argmax(1) == few.outputs(fresh).argmax(1)) > 0.95
