"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a slot is a row of bits, one per language, and
the AND of an n-gram's slots is the set of languages that contain it. A text's popcount per
language, corrected for that language's rate of false positives, decides.

Fit: documents with a language and fold other than 2, at most TRAIN_DOCS of each language (the
smallest by seeded hash; a documented bound on the fit alone). An n-gram counts for a language if
at least MIN_SHARE of its training documents hold it, so mislabelled documents teach nothing.
N-grams are set as bits by Spark; the driver gets the filter's rows that have a bit, FILTER_BYTES
together at most, and one row a language. The filter has SPARE slots for each n-gram of the richest
language, within FILTER_BYTES; beyond that it gets denser and its correction larger, nothing is left
out. Of more than MAX_LANGUAGES values of lang, the most frequent ones are learned (then the first in
code-point order): a bound on the fit, like TRAIN_DOCS; documents of the others are predicted like all.

N-grams of NGRAM letters decide. A text of which none is known is decided by shorter ones, of
SHORTER letters, in the same filter; one of which nothing is known gets the language with the most
training documents, with score and known 0.

Results at the edges: null text or text without a letter is `und` with score 0; ties go to the
first language in code-point order; repeated rows count as rows; an empty table, or none with
labels, makes every text `und`, since no value was learned; null or repeated doc_ids are judged as
rows; extra columns are ignored by identify and come back in the struct row from attach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, read

NGRAM, SHORTER = 4, (3, 2, 1)
TRAIN_DOCS, MIN_SHARE, MIN_DOCS = 2000, 0.01, 2
HASHES, SPARE = 2, 16
MIN_SLOTS, FILTER_BYTES = 1 << 16, 64 << 20
MAX_LANGUAGES = 4096
#: Classes of hash that a language's candidates for training fall into.
CLASSES = 1024
SEED = 7
UNKNOWN = "und"
_BLOCK = 1 << 20


def letters_of(text: str) -> np.ndarray:
    """Code points of the letters of a text in lower case; other characters become one space, with one at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter(codes), codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint64)


def ngram_hashes(letters: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hashes of the n-grams, those of other lengths apart."""
    if len(letters) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(letters) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out << np.uint64(21)) ^ (out >> np.uint64(43)) ^ letters[j : len(letters) - n + 1 + j]
    return mix64(out)


_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0][codes]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n, gram), each n-gram once per document."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            letters = letters_of(text or "")
            for n in (NGRAM, *SHORTER):
                found = np.unique(ngram_hashes(letters, n)).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([n] * len(found), pa.int32()), pa.array(found)], names=["lang", "n", "gram"])


def slots_of(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for j in range(HASHES):
        yield ((grams + np.uint64(j) * step) % np.uint64(slots)).astype(np.int64)


class BitSlicedFilter:
    """words[slot, w] holds bits of languages 64 w to 64 w + 63; usual is the place of the language with the most training documents."""

    def __init__(self, langs: list[str], words: np.ndarray, usual: int = 0):
        self.langs, self.words, self.usual = langs, words, usual
        # rates of false positives: the share of set bits in a language's slice, once per hash
        self.rates = np.array([float(((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES for i in range(len(langs))])

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for slot in slots_of(grams, len(self.words)):
            out = self.words[slot] if out is None else out & self.words[slot]
        return out

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Popcounts per language, less what false positives add."""
        found = self.masks(grams)
        if len(self.langs) <= 64:
            raw = np.array([np.count_nonzero(found[:, 0] & (np.uint64(1) << np.uint64(i))) for i in range(len(self.langs))], float)
        else:
            raw = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[: len(self.langs)].astype(float)
        return np.clip((raw - len(grams) * self.rates) / np.maximum(1 - self.rates, 1e-9), 0, len(grams))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of all languages' hits, and the share of the NGRAM-grams that it knows."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        letters = letters_of(text)
        for n in (NGRAM, *SHORTER):
            grams = ngram_hashes(letters, n)
            block = _BLOCK // self.words.shape[1]
            hits = sum((self.hits(grams[i : i + block]) for i in range(0, len(grams), block)), np.zeros(len(self.langs)))
            if hits.sum():
                best = int(hits.argmax())
                return self.langs[best], float(hits[best] / hits.sum()), float(hits[best] / len(grams)) if n == NGRAM else 0.0
        return self.langs[self.usual], 0.0, 0.0


def training_rows(labelled: DataFrame) -> DataFrame:
    """(lang, text) of TRAIN_DOCS rows of each language at most, those of the smallest hashes of id and text.

    Counts leave about four times the bound of each language. These fall into CLASSES by hash; whole classes are taken while the
    bound lasts, and only rows of the class where it ends are ranked, so that no task holds a language.
    """
    labelled = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text").alias("_h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    # MAX_LANGUAGES rows at most, so texts never move by language
    sizes = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * TRAIN_DOCS / r["n"])) for r in counts], "lang string, _share double")
    at = F.shiftrightunsigned("_h", 1) / F.lit(float(1 << 63))
    near = labelled.join(F.broadcast(sizes), "lang").where(at < F.col("_share")).withColumn("_class", F.floor(at / F.col("_share") * CLASSES)).drop("_share")
    near = materialize(near, "candidates")
    classes = near.groupBy("lang", "_class").agg(F.count(F.lit(1)).alias("_in"))
    classes = classes.withColumn("_left", F.lit(TRAIN_DOCS) - F.sum("_in").over(Window.partitionBy("lang").orderBy("_class")) + F.col("_in")).where("_left > 0")
    joined = near.join(classes, ["lang", "_class"])
    order = Window.partitionBy("lang", "_class").orderBy("_h")
    last = joined.where("_in > _left").withColumn("_r", F.row_number().over(order)).where("_r <= _left")
    return joined.where("_in <= _left").select("lang", "text").unionByName(last.select("lang", "text"))


def train(labelled: DataFrame) -> BitSlicedFilter:
    """(doc_id, lang, text) to the filter."""
    chosen = materialize(training_rows(labelled), "training")
    sizes = sorted((r["lang"], r["n"]) for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    langs = [lang for lang, _ in sizes]
    if not langs:
        return BitSlicedFilter([], np.zeros((MIN_SLOTS, 1), np.uint64))
    grams = chosen.select("lang", "text").mapInArrow(_grams, "lang string, n int, gram long").groupBy("lang", "n", "gram").agg(F.count(F.lit(1)).alias("held"))
    places = chosen.sparkSession.createDataFrame([(lang, i, float(max(min(MIN_DOCS, n), MIN_SHARE * n))) for i, (lang, n) in enumerate(sizes)], "lang string, at int, least double")
    grams = materialize(grams.join(F.broadcast(places), "lang").where("held >= least").select("at", "gram"), "grams")
    most = grams.groupBy("at").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    slots = min(max(MIN_SLOTS, 1 << (SPARE * most - 1).bit_length()), FILTER_BYTES // (8 * -(-len(langs) // 64)))
    bits = grams.mapInArrow(_bits_of(slots), "slot int, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((slots, -(-len(langs) // 64)), np.uint64)
    words[bits.column("slot").to_numpy(), bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return BitSlicedFilter(langs, words, max(range(len(sizes)), key=lambda i: (sizes[i][1], -i)))


def _bits_of(slots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            grams = batch.column("gram").to_numpy().view(np.uint64)
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for slot in slots_of(grams, slots):
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array((at // 64).astype(np.int32)), pa.array(bits)], names=["slot", "word", "bits"])

    return run


def _predictor(shared) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BitSlicedFilter(*shared.value)
        for batch in batches:
            got = [model.predict(x) for x in batch.column("_text").to_pylist()]
            lang, score, known = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=["row", "lang_pred", "score", "known"])

    return predict


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def attach(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(row, lang_pred, score, known), row with all columns of docs; learns from labelled, or docs themselves, outside the held-out fold."""
    source = docs if labelled is None else labelled
    model = train(source.where(~F.coalesce(fold(F.col("doc_id")), F.lit(False))).select("doc_id", "lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.usual))
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    return ready.mapInArrow(_predictor(shared), f"row {ready.schema['row'].dataType.simpleString()}, lang_pred string, score double, known double")


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, lang) to (doc_id, held_out, lang_pred, score, known)."""
    ready = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    found = attach(ready, docs if labelled is None else labelled)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "known")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
