"""Language identification with string kernels.

The kernel of two texts blends presence spectra: for n of 1, 2 and 3, the share of n-grams of lower-cased characters
that both hold, sum over n of |A n B| / sqrt(|A| |B|) / 3, n-grams being hashed to bits. A bounded, stratified sample
of labelled texts is the training set; some of it serves as Nystroem landmarks, and one-versus-rest ridge regression in
the landmarks' feature space gives weights per language. Texts are scored a batch at a time by matrix products. Since
presence vectors are explicit, landmarks and weights fold into one matrix, and the product with it equals scoring
against every landmark.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import map_batches, materialise, named, with_text

BITS = (512, 2048, 4096)  # of the presence vectors of 1-, 2- and 3-grams
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 400, 20_000, 256, 1e-3
LOW, MARGIN = 0.001, 0.6  # a text is like none of the languages below MARGIN times what all but LOW of the sample's texts of its size reach
UNKNOWN = "und"
ROWS = 256  # texts scored in one product
CHARS = 1 << 20  # characters hashed at a time
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode categories L*)."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 per text: which hashed n-grams it holds, whole text included."""
    out = np.zeros((len(texts), sum(BITS)), np.uint8)
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), CHARS):
            c = np.frombuffer(low[at : at + CHARS + 2].encode("utf-32-le"), np.uint32)
            grams, offset = c * np.uint32(0x9E3779B1), 0
            for n, bits in enumerate(BITS):
                if n:
                    if len(c) <= n:
                        break
                    grams = (grams[:-1] ^ grams[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA77) + c[n:]
                    grams = grams * np.uint32(0xC2B2AE3D)
                out[i, offset + (grams >> np.uint32(32 - bits.bit_length() + 1))] = 1
                offset += bits
    return out


def spectra(bits: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their inner product is the blended kernel."""
    out, at = bits.astype(np.float32), 0
    for size in BITS:
        part = out[:, at : at + size]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(BITS))
        at += size
    return out


class Model:
    """languages and one matrix: presence spectra times it are the one-versus-rest outputs."""

    def __init__(self, packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """packed: a row of packed presence bits per label; they are unpacked ROWS at a time."""
        self.languages = sorted(set(labels))

        def unpacked(rows: np.ndarray) -> np.ndarray:
            return spectra(np.unpackbits(rows, axis=1)).astype(np.float64)

        # landmarks in turn from each language, in the sample's order
        turn = {}
        order = sorted(range(len(labels)), key=lambda i: (turn.setdefault(labels[i], []).append(i) or len(turn[labels[i]]), labels[i]))
        marks = unpacked(packed[order[:landmarks]])
        value, vector = np.linalg.eigh(marks @ marks.T)
        sound = value > 1e-6 * value[-1]
        root = vector[:, sound] / np.sqrt(value[sound])  # K_mm ** -1/2 on its range
        onto = marks.T @ root
        feature = np.concatenate([unpacked(packed[i : i + ROWS]) @ onto for i in range(0, len(labels), ROWS)])
        target = (np.array(labels)[:, None] == np.array(self.languages)[None, :]).astype(np.float64)
        count = target.sum(0)
        weight = (target / np.maximum(count, 1)).sum(1) * len(labels) / max(1, len(self.languages))  # languages count alike
        gram = feature.T @ (feature * weight[:, None]) + ridge * len(labels) * np.eye(feature.shape[1])
        solved = np.linalg.solve(gram, feature.T @ (target * weight[:, None]))
        self.matrix = (onto @ solved).astype(np.float32)
        self.least = self.limits(np.bitwise_count(packed).sum(1), (feature @ solved).max(1))

    @staticmethod
    def limits(bits: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The least output of a text by its size class (the digits of its number of n-gram bits): the least of its own and the two next classes. One that the sample lacks has that of the next smaller one; below the smallest the limit halves with the size."""
        classes = np.array([int(b).bit_length() for b in bits])
        found = {c: MARGIN * float(np.quantile(most[classes == c], LOW)) for c in sorted(set(classes.tolist()))}
        out, least = np.zeros(sum(BITS).bit_length() + 1), min(found)
        for c in range(least, len(out)):
            out[c] = min((found[k] for k in (c - 1, c, c + 1) if k in found), default=out[c - 1])
        out[:least] = out[least] / 2.0 ** np.arange(least, 0, -1)
        return out

    def outputs(self, texts: list[str]) -> np.ndarray:
        return spectra(presence(texts)) @ self.matrix

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, likeness): the language of the largest output, its share of all positive outputs, and the output over the limit of the text's size; `und` and zeros without a letter.

        The output nears 1 for texts like the language's sample and 0 for texts that share no n-grams with the landmarks.
        """
        found: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        judged = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for at in range(0, len(judged), ROWS):
            part = judged[at : at + ROWS]
            bits = presence([texts[i] for i in part])
            out = np.maximum(spectra(bits) @ self.matrix, 1e-6)
            best = out.argmax(1)
            most = out[np.arange(len(part)), best]
            least = self.least[[int(b).bit_length() for b in bits.sum(1, dtype=np.int64)]]
            for i, b, s, o in zip(part, best.tolist(), (most / out.sum(1)).tolist(), (most / least).tolist(), strict=True):
                found[i] = (self.languages[b], min(1.0, s), o)
        return found


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most per_language labelled texts of each language, `sample` in all: those with the least text hash.

    Learns from rows with an id that is not held out, a language and a letter in the text. Only presence bits reach the
    driver, under a kilobyte a text. None if there is no such row.
    """
    own = F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    rows = docs.filter(own).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    # one read for the hashes, a few bytes a row, and one for the texts below a language's limit
    hashes = materialise(rows.select("lang", "h").distinct(), "hashes")
    counts = materialise(hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample), "languages")
    languages = counts.count()
    each = max(1, min(per_language, sample // max(1, languages)))
    # hashes are spread evenly, so the least `each` lie below a share of their range; twice that share leaves a task few rows to rank
    share = F.least(F.lit(1.0), (2 * each + 100) / F.col("n"))
    bounds = counts.select("lang", (share * 2.0**64 - 2.0**63).alias("bound"))  # at most `sample` rows
    low = hashes.join(F.broadcast(bounds), "lang").filter(F.col("h").cast("double") <= F.col("bound"))
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    limits = ranked.filter(F.col("rank") <= each).groupBy("lang").agg(F.max("h").alias("limit"))
    below = rows.join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("limit"))
    once = below.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies of a text become one before they meet
    chosen = once.select("lang", "text", F.col("h").alias("rank"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence([t])).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], ["lang", "rank", "bits"])

    packed = map_batches(chosen.select("lang", "text", "rank"), pack, "lang string, rank long, bits binary").collect()
    if not packed:
        return None
    packed.sort(key=lambda r: (r.lang, r.rank))
    return Model(np.stack([np.frombuffer(r.bits, np.uint8) for r in packed]), [r.lang for r in packed], landmarks)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A struct `row` of the kept columns, and lang_pred, score and likeness of each whole text; only the text is read."""
    source, parts = with_text(docs, text_col, docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # with its code: workers need not import it
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            texts, row = parts(batch)
            texts = texts.to_pylist()
            found = own.predict(texts) if own else [(UNKNOWN, 0.0, 0.0)] * len(texts)
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([row, *columns], ["row", "lang_pred", "score", "likeness"])

    return map_batches(source, score, StructType([source.schema["row"], StructField("lang_pred", StringType()), *[StructField(x, DoubleType()) for x in ("score", "likeness")]]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the id, held_out, lang_pred and score (0 to 1).

    A null or letterless text is `und` with score 0.0, as is every text if no row can be learned from; a null id is not
    held out and not learned from. Repeated rows get equal results; an empty table gives an empty result.
    """
    found = identify(docs, fit(docs, id_col, text_col, lang_col), text_col, [id_col])
    own = F.col("row")[id_col]
    return found.select(own.alias(id_col), held_out(own).alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    languages: list[str] | None = None, least_score: float = 0.0, least_likeness: float = 1.0,
) -> DataFrame:
    """The rows of docs, with all their columns, whose text the model places in a language.

    That is, in one of `languages` (any learned one by default), with a score of least_score or more and a likeness of
    least_likeness or more. Likeness is the ridge output over a limit that is fitted with the model, for each size of
    text: MARGIN times the output that all but LOW of the sample's texts of that size reach. Texts of other languages, or
    of no words at all, miss it. Null and letterless texts go. Where no row can be learned from (an unlabelled corpus)
    there is no prediction: every text with a letter stays, or none if languages are named. Repeated rows fare alike; an
    empty table stays empty.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.filter(named([text_col])[0].rlike(r"\p{L}") & F.lit(languages is None))
    like = (F.col("score") >= least_score) & (F.col("likeness") >= least_likeness)
    known = F.col("lang_pred") != UNKNOWN if languages is None else F.col("lang_pred").isin(languages)
    return identify(docs, model, text_col).filter(known & like & (F.col("lang_pred") != UNKNOWN)).select("row.*")
