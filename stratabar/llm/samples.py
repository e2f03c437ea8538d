"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabar.llm.common import checkpointed, column, fold, map_texts

#: Minima of hashed three-word shingles by which a sample knows near copies.
KEYS = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most per_class documents of label 0 and as many of label 1: id, text, y. None of them is held out.

    Chosen by a hash of the id, so the same rows come at every run. The ids are found in the labels alone, then a
    scan of docs keeps their texts (a broadcast of 2 x per_class ids). Ids labelled both ways are left out, rows that
    repeat an id count once, null ids, labels and texts are not used. Of copies and near copies (that share one of
    KEYS shingle minima) one stays, or what they have in common would pass for a mark of their label. The sample is
    written to the shared folder.
    """
    own = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col) != 1))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("top"))
        .filter("y = top").drop("top")
    )
    first = [F.xxhash64("id"), F.col("id")]
    ids = own.filter("y = 0").orderBy(*first).limit(per_class).unionByName(own.filter("y = 1").orderBy(*first).limit(per_class))
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    own = checkpointed(texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    keyed = map_texts(own, "text", [F.col("id"), F.col("y"), F.col("text")], ", ".join(f"k{i} bigint" for i in range(KEYS)), _keys)
    for i in range(KEYS):
        keyed = keyed.groupBy(f"k{i}").agg(F.min(F.struct("id", "y", "text", *[f"k{j}" for j in range(KEYS) if j != i])).alias("one")).select("one.*", f"k{i}")
    return checkpointed(keyed.select("id", "text", "y"))


def label_share(labels: DataFrame, label: str, id_col: str = "doc_id") -> float | None:
    """The share of label 1 among the labelled rows that are not held out."""
    return labels.filter(F.col(label).isin(0, 1) & (fold(id_col) != 1)).agg(F.avg(label)).first()[0]


def _keys(texts: list[str]) -> list[pa.Array]:
    rows = []
    for text in texts:
        words = re.findall(r"\w+", text.lower())
        shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        rows.append([min(xxhash.xxh64_intdigest(s, seed) for s in shingles) - (1 << 63) for seed in range(KEYS)])
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(KEYS)]
