"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import held_out, kept_columns, map_texts, table
from stratabar.llm.samples import label_share, labelled_sample

#: Labelled rows of each class that the lexicon and its calibration are fitted on, at most.
FIT_PER_CLASS = 3000
#: Entries of a lexicon, at most.
MAX_ENTRIES = 2000
#: Letters of the word beginnings that can be entries.
STEMS = (4, 5, 6, 7)
#: Least log-likelihood ratio of an entry with the label; chance reaches it about once in 100,000 words.
LEAST_G2 = 20.0
#: Least weight (natural log of the odds ratio).
LEAST_WEIGHT = 2.0
THRESHOLD = 0.7
#: Documents of label 0 that a phrase around an entry needs to be an exception, and how rare it must be in label 1 beside
#: them (natural log of the odds ratio).
LEAST_EXCEPTION, EXCEPTION_WEIGHT = 3, -1.0

#: Letters that look like Latin letters, each before the letter it is taken for.
_LOOKALIKES = "аa еe іi јj оo кk рp сc уy хx ѕs һh ԁd ԛq ԝw мm нh тt вb αa βb εe ιi κk οo ρp τt υu χx ωw ηn ɑa ɡg ıi ßs øo łl đd"
HOMOGLYPHS = str.maketrans({pair[0]: pair[1] for pair in _LOOKALIKES.split()})
#: Digits and signs written for letters.
DIGITS = str.maketrans("0134578@$!", "oieastbasi")
_MIXED = re.compile(r"[a-z][0134578@$!]+[a-z]|(?<![\w@$!])[0134578@$!][a-z]{2}|[a-z]{3}[0134578@$](?![\w@$])")
_SPELLED = re.compile(r"(?<![\w@$!])[a-z0134578@$!]*[a-z][a-z0134578@$!]*")
_WORDS = re.compile(r"[^\W\d_]+")


def fold_text(text: str, one: str = "i") -> str:
    """Lower case, marks off, look-alike letters and digits inside words as the Latin letters they stand for; 1 as
    `one`, for it stands for i or l. Either reading has the same length."""
    try:
        raw = text.encode("latin-1").translate(_LATIN1)
        mixed, text = len(raw) != len(raw.translate(None, b"0134578@$!")), raw.decode("latin-1")
    except UnicodeEncodeError:
        mixed, text = True, _bare(text)
    if mixed and _MIXED.search(text):
        text = _SPELLED.sub(_unspell if one == "i" else _unspell_l, text)
    return text


def _bare(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(HOMOGLYPHS)


#: The same, letter by letter, for texts of the first 256 code points.
_LATIN1 = bytes(ord(x) if len(x := _bare(chr(c))) == 1 and ord(x) < 256 else c for c in range(256))


def _unspell(m: re.Match, digits: dict[int, int] = DIGITS) -> str:
    """Signs at the end stay; so do digits there, unless one stands for the last letter of a longer word."""
    word = m[0]
    core = word.rstrip("!")
    bare = core.rstrip("0134578@$")
    if len(core) - len(bare) != 1 or len(bare) < 3:
        core = bare
    return core.translate(digits) + word[len(core) :]


def _unspell_l(m: re.Match) -> str:
    return _unspell(m, DIGITS | {ord("1"): ord("l")})


@dataclass
class Lexicon:
    """words and stems (beginnings of words) with weights; exceptions; the calibration of hits to a probability."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for kind, entries in (("stem", self.stems), ("word", self.words)):
            for entry, weight in entries.items():
                a.add_word(entry, (kind, entry, weight))
        for phrase in self.exceptions:
            a.add_word(fold_text(phrase), ("not", fold_text(phrase), 0.0))
        a.make_automaton()
        return a

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) in the folded text; one hit at each start, none inside an exception phrase. Linear in
        the length of the text but for the sort of its hits."""
        if not (self.words or self.stems):
            return []
        found: dict[int, tuple[str, float]] = {}
        void: list[tuple[int, int]] = []
        folded = fold_text(text)
        self._scan(folded, found, void)
        if "1" in text and (other := fold_text(text, "l")) != folded:
            self._scan(other, found, void)
        starts, ends = [], []
        for a, b in sorted(void):
            if starts and a <= ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a)
                ends.append(b)

        def free(at: int) -> bool:
            k = bisect_right(starts, at) - 1
            return k < 0 or ends[k] < at

        return [(s, *found[s]) for s in sorted(found) if free(s)]

    def _scan(self, text: str, found: dict[int, tuple[str, float]], void: list[tuple[int, int]]) -> None:
        for end, (kind, entry, weight) in self.automaton.iter(text):
            start = end + 1 - len(entry)
            if start and text[start - 1].isalpha():
                continue
            if kind != "stem" and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            if kind == "not":
                void.append((start, end))
            elif start not in found or weight > found[start][1]:
                found[start] = (entry, weight)

    def features(self, text: str) -> tuple[float, float, list[str]]:
        """log(1 + sum of weights), weights per 100 letters-of-a-word units of length, distinct entries hit."""
        hits = self.hits(text)
        total = sum(h[2] for h in hits)
        return math.log1p(total), total / (1 + len(text) / 600), list(dict.fromkeys(h[1] for h in hits))

    def score(self, text: str) -> tuple[float, list[str]]:
        if not text:
            x, d, terms = 0.0, 0.0, []
        else:
            x, d, terms = self.features(text)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * math.log1p(d))))), terms


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """sample: id, text, y. Entries are words, and beginnings of words, that documents of label 1 have far more often. Without both labels: an empty lexicon."""
    classes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = classes.get(1, 0), classes.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, {}, coefficients=(math.log((pos + 1) / (neg + 1)), 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORDS.findall(fold_text(text)))
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                seen[y].update(words)
                seen[y].update(stems)
        for term in [seen[1], seen[0]]:
            y = int(term is seen[1])
            yield pa.RecordBatch.from_pydict({"term": list(term), "pos": [n * y for n in term.values()], "neg": [n * (1 - y) for n in term.values()]}, pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    counted = sample.select("text", "y").mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b, p, n = F.col("pos"), F.col("neg"), pos, neg
    df, share = a + b, p / (p + n)
    g2 = 2 * (F.when(a > 0, a * F.log(a / (df * share))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (df * (1 - share)))).otherwise(0.0))
    weight = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n + 1))
    rows = (
        counted.withColumn("g2", g2).withColumn("weight", weight)
        .filter((F.col("g2") >= LEAST_G2) & (F.col("weight") >= LEAST_WEIGHT) & (F.length("term") >= 3))
        .orderBy(F.desc("g2"), "term").limit(MAX_ENTRIES).collect()
    )
    return Lexicon(*_choose([(r["term"], r["pos"], r["neg"], r["weight"]) for r in rows]))


def _choose(terms: Iterable[tuple[str, int, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """A beginning goes if one longer entry explains nearly all of it; a longer entry goes if what is left of its
    beginnings says as much."""
    found = {t: (a, w) for t, a, _, w in terms}
    below = lambda s: [t for t in found if t != s and t.startswith(s[:-1]) and (t[:-1] != s[:-1] or not t.endswith("*"))]
    explained = {s for s in found if s.endswith("*") and any(found[t][0] >= 0.8 * found[s][0] and found[t][1] >= found[s][1] - 0.1 for t in below(s))}
    kept: dict[str, float] = {}
    for t in sorted(found.keys() - explained, key=lambda t: (len(t.rstrip("*")), t)):
        if not any(t.startswith(s[:-1]) and w >= found[t][1] - 0.5 for s, w in kept.items() if s.endswith("*")):
            kept[t] = found[t][1]
    best = sorted(kept, key=lambda t: -kept[t])[:MAX_ENTRIES]
    return {t: kept[t] for t in best if not t.endswith("*")}, {t[:-1]: kept[t] for t in best if t.endswith("*")}


def learn_exceptions(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """Adds the phrases of an entry and the word beside it that documents of label 0 have, and those of label 1 hardly:
    there the entry isn't abuse."""
    classes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold_text(text)
                words = [(m.start(), m.end()) for m in _WORDS.finditer(folded)]
                place = {a: k for k, (a, _) in enumerate(words)}
                own = set()
                for start, *_ in lexicon.hits(text):
                    k = place.get(start)
                    for i, j in ((k - 1, k), (k, k + 1)) if k is not None else ():
                        if 0 <= i and j < len(words) and words[j][0] - words[i][1] == 1:
                            own.add(folded[words[i][0] : words[j][1]])
                if own:
                    yield pa.RecordBatch.from_pydict({"phrase": sorted(own), "pos": [y] * len(own), "neg": [1 - y] * len(own)}, pa.schema([("phrase", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    counted = sample.select("text", "y").mapInArrow(phrases, "phrase string, pos bigint, neg bigint").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (classes.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (classes.get(0, 0) + 1))
    rows = counted.filter((F.col("neg") >= LEAST_EXCEPTION) & (weight <= EXCEPTION_WEIGHT)).orderBy(F.desc("neg"), "phrase").limit(MAX_ENTRIES).collect()
    return Lexicon(lexicon.words, lexicon.stems, (*lexicon.exceptions, *[r["phrase"] for r in rows if r["phrase"] not in lexicon.exceptions]), lexicon.coefficients)


def calibrate(lexicon: Lexicon, sample: DataFrame, prior: float) -> Lexicon:
    """Fits probability = logistic(a + b x + c log(1 + d)) on the sample, weighed so that label 1 has its share `prior`."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.features(t)[:2] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1).cast(pa.int64())], ["x", "d", "y"])

    rows = sample.select("text", "y").mapInArrow(features, "x double, d double, y bigint").collect()  # 2 x FIT_PER_CLASS rows at most
    rows = sorted(rows, key=lambda r: (r["y"], r["x"], r["d"]))  # sums in one order give the same fit at every run
    x, y = np.array([[1.0, r["x"], math.log1p(r["d"])] for r in rows]).reshape(-1, 3), np.array([r["y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return lexicon
    weights = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum())) * len(y)
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (weights * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    lexicon.coefficients = (float(beta[0]), float(beta[1]), float(beta[2]))
    return lexicon


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = FIT_PER_CLASS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon, its exception phrases (those given and those learned) and its calibration, from labelled rows outside
    the held-out third."""
    sample = labelled_sample(docs, labels, label, per_class)
    lexicon = learn_lexicon(sample)
    lexicon = learn_exceptions(Lexicon(lexicon.words, lexicon.stems, tuple(exceptions), lexicon.coefficients), sample)
    return calibrate(lexicon, sample, min(0.9, max(0.01, label_share(labels, label) or 0.01)))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id_col, with carry the whole row as the struct `row`, score (0 to 1), terms (lexicon
    entries found).

    Whole texts are matched. Null and empty texts have no hits and get the score of such. Repeated rows and null ids
    are rows as any other; an empty table gives no rows; columns of any name are left alone. Map-side only.
    """

    def compute(texts: list[str]) -> list[pa.Array]:
        got = [lexicon.score(t) for t in texts]
        return [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.string()))]

    return map_texts(docs, text_col, kept_columns(docs, id_col, carry), "score double, terms array<string>", compute)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
