"""Language ID by hyperdimensional profiles: letter vectors, permuted and bound into n-gram vectors, bundled."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import checkpointed, column, fold, held_out, kept_columns, map_texts, table

DIMENSIONS = 1024
SEED = 7
#: Symbols of the alphabet: 0 parts words, 1-26 are a-z, other letters share the rest.
SYMBOLS = 64
#: Documents of each language that a profile is learned from, about.
LEARN_PER_LANGUAGE = 2000
#: Languages that profiles can be held for: their vectors are 40 MB. A table with more is refused, not cut.
MAX_LANGUAGES = 10_000
#: A document's vector is summed in whole steps of this, so that sums don't depend on their order.
STEP = 2.0**-24
#: Trigrams that are bundled at once.
TRIGRAMS_AT_ONCE = 60_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point -> symbol."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = 27 + (c * 2654435761 >> 16) % (SYMBOLS - 27)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = i + 1
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random vector of +1 and -1 for each symbol, as third, second and first letter of a trigram: a letter's place
    is a rotation of its vector."""
    v = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * 2 - 1
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text in order, as numbers; runs of anything but letters are one symbol. Empty without letters."""
    symbols = symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    symbols = symbols[np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))]
    if len(symbols) < 3:
        return np.empty(0, np.int32)
    return (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]


def trigram_vectors(numbers: np.ndarray) -> np.ndarray:
    third, second, first = letter_vectors()
    return first[numbers // (SYMBOLS * SYMBOLS)] * second[numbers // SYMBOLS % SYMBOLS] * third[numbers % SYMBOLS]


def bundles(texts: list[str]) -> np.ndarray:
    """Each text's sum of its trigrams' vectors, over the whole text, at length 1; zeros without letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    grams = [trigrams(t) for t in texts]
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(grams[end]) <= TRIGRAMS_AT_ONCE):
            size += len(grams[end])
            end += 1
        some = grams[start:end]
        used, at = np.unique(np.concatenate(some), return_inverse=True)
        if len(used):
            row = np.repeat(np.arange(len(some)), [len(g) for g in some])
            counts = np.bincount(row * len(used) + at, minlength=len(some) * len(used)).reshape(len(some), len(used))
            for k in range(0, len(used), 4096):  # a part of the trigrams at a time: bounded memory
                out[start:end] += counts[:, k : k + 4096].astype(np.float32) @ trigram_vectors(used[k : k + 4096]).astype(np.float32)
        start = end
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a row of length 1 for each language

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of the greatest cosine, and that cosine (0 where it is negative)."""
        own = bundles(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cosines = own @ self.vectors.T
        best, empty = cosines.argmax(axis=1), ~own.any(axis=1)
        return (
            [UNKNOWN if e else self.languages[b] for b, e in zip(best, empty, strict=True)],
            [0.0 if e else float(min(1.0, max(0.0, cosines[i, b]))) for i, (b, e) in enumerate(zip(best, empty, strict=True))],
        )


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = LEARN_PER_LANGUAGE) -> Profiles:
    """From about per_language documents of each language outside the held-out third, chosen by a hash of the id. Rows
    without language, id or letters teach nothing. Every document counts with length 1. Every language of the rows gets
    a profile; more than MAX_LANGUAGES of them are an error."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id") != 1))
    sizes = checkpointed(rows.groupBy("lang").count())
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chance = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) / float(1 << 30)
    rates = F.broadcast(sizes.select("lang", (F.lit(float(per_language)) / F.col("count")).alias("rate")))
    sample = rows.join(rates, "lang").filter(chance < F.col("rate")).select("text", "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One vector for each language of a task."""
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                vectors = np.rint(bundles(some.column(0).to_pylist()).astype(float) / STEP).astype(np.int64)
                languages = some.column(1).to_pylist()
                for lang in set(languages):
                    total[lang] = total.get(lang, 0) + vectors[[x == lang for x in languages]].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v], pa.list_(pa.int64()))], ["lang", "v"])

    parts = sample.mapInArrow(sums, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()  # MAX_LANGUAGES vectors at most
    vectors = np.array([[e["x"] * STEP for e in r["v"]] for r in found], np.float32).reshape(len(found), DIMENSIONS)
    size = np.linalg.norm(vectors, axis=1)
    own = size > 0
    return Profiles([r["lang"] for r, k in zip(found, own, strict=True) if k], vectors[own] / size[own][:, None])


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id_col, with carry the whole row as the struct `row`, lang_pred, score (cosine, 0 to 1).

    Whole texts are read. Null texts and texts without letters: `und`, score 0. Repeated rows and null ids are rows as
    any other; an empty table gives no rows; without profiles every text is `und`; columns of any name are left alone.
    Map-side only.
    """

    def compute(texts: list[str]) -> list[pa.Array]:
        languages, scores = profiles.predict(texts)
        return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, text_col, kept_columns(docs, id_col, carry), "lang_pred string, score double", compute)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
