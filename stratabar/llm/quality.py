"""Quality rules: base rules, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratabar.llm.common import checkpointed, held_by_worker, kept_columns, map_texts, table
from stratabar.llm.samples import label_share, labelled_sample

#: Features are hashed to 2^BITS weights.
BITS = 18
#: Characters of an n-gram inside a word, its bounds counted.
CHAR_GRAMS = (1, 2, 3, 4)
#: Words of a window for repeats.
WINDOW = 5
#: Labelled rows of each class for fitting, at most; one in CALIBRATE of them is kept for the calibration.
FIT_PER_CLASS = 1000
CALIBRATE = 4
#: Bytes of their features, at most: the rows of a class are taken in order of a hash until they reach half of it.
FIT_BYTES = 64 << 20
STEPS, RATE, L2 = 200, 0.05, 1e-5
#: A document is kept from this probability of good quality on.
THRESHOLD = 0.35
SYMBOLS = b"#*$%&|<>"
#: Words a worker remembers, and their bytes.
CACHE_WORDS, CACHE_BYTES = 300_000, 8_000_000

_SPACE = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def char_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, slot) for each character n-gram of each word."""
    letters = np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    space = letters == _SPACE
    owner = np.cumsum(space) - 1
    owners, slots = [], []
    for n in CHAR_GRAMS:
        size = len(letters) - n + 1
        if size <= 0:
            continue
        h = np.full(size, np.uint64(n), np.uint64)
        fits = ~space[:size] if n == 1 else np.ones(size, bool)
        for i in range(n):
            h = (h + letters[i : i + size]) * _MIX[1]
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                fits &= ~space[i : i + size]
        fits &= owner[:size] < len(words)
        owners.append(owner[:size][fits])
        slots.append(_slot(h[fits]))
    return np.concatenate(owners), np.concatenate(slots)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_slots(h: np.ndarray) -> np.ndarray:
    return _slot(h[:-1] * _MIX[2] + h[1:] * _MIX[3])


class WordTable:
    """word -> a number, and arrays by that number: its hash and, given weights, the sum of its features' weights."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights, self.numbers, self.bytes = weights, {}, 0
        self.hashes, self.scores = np.zeros(1024, np.uint64), np.zeros(1024)

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = set().union(*texts).difference(self.numbers) if texts else set()
        if len(self.numbers) + len(new) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.numbers, self.bytes, new = {}, 0, set().union(*texts)
        if new:
            self._add(list(new))
        get = self.numbers.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def _add(self, words: list[bytes]) -> None:
        first, last = len(self.numbers), len(self.numbers) + len(words)
        self.bytes += sum(map(len, words))
        if last > len(self.hashes):
            room = max(last, 2 * len(self.hashes))
            self.hashes, self.scores = (np.concatenate([a, np.zeros(room - len(a), a.dtype)]) for a in (self.hashes, self.scores))
        self.numbers.update(zip(words, range(first, last), strict=True))
        self.hashes[first:last] = word_hashes(words)
        if self.weights is not None:
            owner, slots = char_features(words)
            self.scores[first:last] = np.bincount(owner, self.weights[slots], len(words)) + self.weights[_slot(self.hashes[first:last])]


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found at least twice in the text, its first place included."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = (h + hashes[i : i + n]) * _MIX[4]
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + WINDOW, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    twice[starts] += 1
    twice[starts + WINDOW] -= 1
    return int((np.cumsum(twice) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    own = [x for x in lines if x.strip(" \t\n\v\f\r")]
    return len(own) - len(set(own))


@dataclass
class QualityModel:
    """Logit of good quality: bias + mean over words of their features' weights; calibrated by slope and offset."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, total: float, n_words: int) -> float:
        z = self.offset + self.slope * (self.bias + (total / n_words if n_words else 0.0))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _measures(texts: list[str], words: WordTable) -> Iterator[tuple[int, int, int, int, int, float]]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    split = [b.split() for b in raw]  # of bytes: at ASCII white space only
    for text, b, own, numbers in zip(texts, raw, split, words.look_up(split), strict=True):
        hashes = words.hashes[numbers]
        total = float(words.scores[numbers].sum()) + (float(words.weights[pair_slots(hashes)].sum()) if words.weights is not None and len(own) > 1 else 0.0)
        yield (
            len(own), len(text) - (len(b) - sum(map(len, own))), len(b) - len(b.translate(None, SYMBOLS)),
            duplicate_lines(text), repeated_words(hashes), total,
        )


def training_rows(sample: DataFrame) -> DataFrame:
    """id, y, n_words, slots and counts (binary) of the hashed features of each text."""

    def compute(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            own = t.encode("utf-8", "replace").split()
            distinct, inverse = np.unique(np.array(own, object), return_inverse=True) if own else ([], np.zeros(0, int))
            distinct, counts = list(distinct), np.bincount(inverse, minlength=len(distinct))
            owner, slots = char_features(distinct) if own else (np.zeros(0, int), np.zeros(0, int))
            h = word_hashes(distinct)
            slots = np.concatenate([slots, _slot(h), pair_slots(h[inverse]) if len(own) > 1 else np.zeros(0, np.int64)])
            amount = np.concatenate([counts[owner], counts, np.ones(max(0, len(own) - 1))])
            found, at = np.unique(slots, return_inverse=True)
            rows.append((len(own), found.astype("<i4").tobytes(), np.bincount(at, amount, len(found)).astype("<f4").tobytes() if own else b""))
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]

    return map_texts(sample, "text", [F.col("id"), F.col("y")], "n_words bigint, slots binary, counts binary", compute, rows_at_once=64)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = FIT_PER_CLASS, most_bytes: int = FIT_BYTES) -> QualityModel:
    """From at most per_class labelled rows of each class outside the held-out third, with at most most_bytes of features,
    which is what the driver gets. Without both classes: a model that finds every text good."""
    order = [F.xxhash64("id"), F.col("id")]
    made = checkpointed(training_rows(labelled_sample(docs, labels, label, per_class)).withColumn("bytes", F.octet_length("slots") + F.octet_length("counts")))
    upto = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # per_class numbers at most
    fits = made.select("id", "y", "bytes").withColumn("sum", F.sum("bytes").over(upto)).filter(F.col("sum") <= most_bytes // 2).select("id")
    rows = made.join(F.broadcast(fits), "id").orderBy(*order).collect()
    y = np.array([r["y"] for r in rows], float)
    share = label_share(labels, label)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(1 << BITS), bias=5.0)
    slots = [np.frombuffer(r["slots"], "<i4") for r in rows]
    values = [np.frombuffer(r["counts"], "<f4") / np.float32(max(1, r["n_words"])) for r in rows]
    place = {k: np.array([i for i in range(len(rows)) if (i % CALIBRATE == 0) == k]) for k in (False, True)}
    weights, bias = _logistic([slots[i] for i in place[False]], [values[i] for i in place[False]], y[place[False]])
    held = place[True]
    logits = np.array([bias + float(weights[slots[i]] @ values[i]) for i in held])
    slope, offset = _platt(logits, y[held], min(0.99, max(0.01, share)))
    return QualityModel(weights, bias, slope, offset)


def _logistic(slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Adam on all rows at once; the classes weigh alike. A row without features has the bias alone."""
    full = [i for i, s in enumerate(slots) if len(s)]
    at, x = np.concatenate([slots[i] for i in full]).astype(np.int64), np.concatenate([values[i] for i in full]).astype(np.float32)
    counts = np.array([len(slots[i]) for i in full])
    starts = np.cumsum(counts) - counts
    side = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    size = (1 << BITS) + 1  # the bias is the last
    theta, m, v = np.zeros(size, np.float32), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        z = np.full(len(y), float(theta[-1]))
        z[full] += np.add.reduceat(x * theta[at], starts)
        error = side * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(at, x * np.repeat(error[full].astype(np.float32), counts), size)
        g[:-1] += L2 * theta[:-1]
        g[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= (RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return theta[:-1].astype(float), float(theta[-1])


def _platt(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset by Newton's method, rows weighed to the classes' shares among all labels, targets smoothed."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    w = np.where(y == 1, prior / pos, (1 - prior) / neg) * len(y)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(z).mean()))
    a, b = 1.0, 0.0
    for _ in range(100):
        u = z / scale
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = np.array([(w * (p - target) * u).sum() + 1e-3 * (a - 1), (w * (p - target)).sum()])
        h = w * p * (1 - p)
        hess = np.array([[(h * u * u).sum() + 1e-3, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return a / scale, b


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id_col, with carry the whole row as the struct `row`, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and probability (of good quality).

    Words are runs of anything but ASCII white space. Whole texts are read; null and empty texts have no words and
    the probability of the bias alone. Repeated rows and null ids are rows as any other; an empty table gives no rows;
    columns of any name are left alone. Map-side only.
    """
    name = ("quality", xxhash.xxh64_intdigest(model.weights.tobytes()))

    def compute(texts: list[str]) -> list[pa.Array]:
        rows = list(_measures(texts, held_by_worker(name, lambda: WordTable(model.weights))))
        ints = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        return [*ints, pa.array([model.probability(r[5], r[0]) for r in rows], pa.float64())]

    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double"
    return map_texts(docs, text_col, kept_columns(docs, id_col, carry), added, compute)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_verdict(scored: DataFrame) -> DataFrame:
    """The result of score_quality with base_failed and kept."""
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= THRESHOLD))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_verdict(score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))))
