"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in each slot. Looking up an n-gram's
slots and intersecting them gives at once every language that holds the n-gram. A text is
decided by its languages' counts of held n-grams, less the false positives expected from
how full each language's slice is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .shared import crc_mod, named, others

#: Bytes of an n-gram; multipliers of the filter's hash functions.
GRAM, MULTIPLIERS = 4, (1640531527, 2024237689)
#: log2 of the filter's slots, at least and at most, and slots for each n-gram of the language with the most.
BITS, MOST_BITS, ROOM = 20, 26, 16
#: Documents that a model is fitted on, in expectation, where there are more.
SAMPLE = 8000
#: A language holds an n-gram that it has this often, at this share of the rate of the language that has it most.
LEAST, SHARE = 3, 0.2

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def gram_codes(text: str) -> np.ndarray:
    """All n-grams of a text as 32-bit codes: bytes of its words, A-Z lower-cased, one space between."""
    data = b"  " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    return np.ndarray((len(data) - GRAM + 1,), "<u4", data, 0, (1,))


class LanguageFilters:
    """The bit-sliced filter of a fitted model: ``slots`` has a row per slot and a word for each 64 languages."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages = languages
        kinds = [np.uint8, np.uint16, np.uint32, np.uint64]
        self.slots = slots.astype(next(k for k in kinds if np.iinfo(k).bits >= min(64, max(1, len(languages)))))
        self.shift = np.uint32(32 - (len(slots) - 1).bit_length())
        self.words = [np.arange(lo, min(lo + 64, len(languages))) for lo in range(0, len(languages), 64)]
        fill = np.array([np.count_nonzero(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]) / len(slots)
        self.false_rate = fill ** len(MULTIPLIERS)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram, a bit for every language that holds it."""
        found = None
        for m in MULTIPLIERS:
            at = (codes * np.uint32(m)) >> self.shift
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language holds, by a count of each bit."""
        found = self.masks(codes)
        counts = []
        for word, own in enumerate(self.words):
            values, n = self._tally(found[:, word]) if len(own) <= 12 else np.unique(found[:, word], return_counts=True)
            bits = values.astype(np.uint64)[:, None] >> np.arange(len(own), dtype=np.uint64) & np.uint64(1)
            counts.append(n @ bits.astype(np.int64))
        return np.concatenate(counts)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the share of the text's n-grams that it holds, corrected for false positives.

        Of languages that hold equally many, the first by name is given, also where none holds any.
        """
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        codes = gram_codes(text)
        held = np.maximum(self.hits(codes) - len(codes) * self.false_rate, 0) / (1 - np.minimum(self.false_rate, 0.999))
        best = int(held.argmax())
        return self.languages[best], float(min(1.0, held[best] / len(codes)))

    @staticmethod
    def _tally(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(masks, minlength=1)
        values = np.flatnonzero(counts)
        return values, counts[values]


def _count_grams(batches):
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(gram_codes(text))
        for lang, parts in by.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array([lang] * len(codes)), pa.array(n)], ["gram", "lang", "n"])


def fit(rows: DataFrame, sample: int = SAMPLE) -> LanguageFilters:
    """Fit filters on rows of (doc_id, text, lang) with a language.

    When there are more rows than ``sample``, those whose hashed doc_id falls below a
    threshold are used: about ``sample`` rows, chosen alike at every size. The filter is
    merged slot by slot in Spark; the driver gets 2^MOST_BITS slots at most. Rows that
    repeat an id are all used or all left out.
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(sample / n * (1 << 24)))
    counts = rows.select("text", "lang").mapInArrow(_count_grams, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    # One row per language.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("grams")).orderBy("lang").collect()
    if not totals:
        return LanguageFilters([], np.zeros((1 << BITS, 1), np.uint64))
    bits = min(MOST_BITS, max(BITS, (ROOM * max(r.grams for r in totals)).bit_length()))
    names = [r.lang for r in totals]
    place = counts.sparkSession.createDataFrame([(r.lang, i, float(r.total)) for i, r in enumerate(totals)], "lang string, i int, total double")
    rated = counts.join(F.broadcast(place), "lang").select("gram", "n", "i", (F.col("n") / F.col("total")).alias("rate"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    held = rated.withColumn("most", most).where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("most")))
    slots = F.array(*[F.shiftright((F.col("gram") * m).bitwiseAND(0xFFFFFFFF), 32 - bits) for m in MULTIPLIERS])
    merged = held.select(F.explode(slots).alias("slot"), F.floor(F.col("i") / 64).alias("word"), F.expr("shiftleft(1L, i % 64)").alias("mask"))
    merged = merged.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    counts.unpersist()
    table = np.zeros((1 << bits, -(-len(names) // 64)), np.uint64)
    table[merged["slot"].to_numpy(np.int64), merged["word"].to_numpy(np.int64)] = merged["mask"].to_numpy(np.int64).astype(np.uint64)
    return LanguageFilters(names, table)


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """Add lang_pred and score to ``docs``, replacing columns of those names in upper or lower case.

    A null text, and one without a letter, gives ``und`` and 0. Nothing but the text is
    looked at, so rows that repeat a text have the same answer. An empty table gives none.
    """
    rest = others(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = next(i for i, c in enumerate(rest) if c.lower() == "text")
    # Columns go through the function by plain names, as theirs may hold dots.
    plain = [f"c{i}" for i in range(len(rest))]

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*plain, "lang_pred", "score"])

    picked = docs.select(*[named(c).alias(p) for c, p in zip(rest, plain, strict=True)])
    out = T.StructType([*picked.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(run, out).toDF(*rest, "lang_pred", "score")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose id leaves no remainder 2 by 4, and identify every document."""
    learn = docs.where(crc_mod(F.col("doc_id"), 4) != 2)
    return identify(docs, fit(learn))


def identify_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return identify_documents(docs).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
