"""Folds over the ordered rows of each partition, for recurrences that no window can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold_ordered(rows: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str], inputs: Mapping[str, str], added: str, start: Callable[[], Callable[[pa.Table], list[pa.Array]]]) -> DataFrame:
    """rows with the columns `added`, computed by start()'s result, which is made anew for each partition and called on
    that partition's rows in order, a batch at a time; it keeps the state. It sees `inputs` (its name: column).

    One shuffle by partition_cols, one sort; memory is a batch and the state. Without partition_cols all rows are one
    stream in one task, as such a recurrence must be.
    """
    group = F.xxhash64(*[F.col(c) for c in partition_cols]) if partition_cols else F.lit(0).cast("bigint")
    names = rows.columns
    packed = rows.select(
        group.alias("_g"), *[F.col(c).cast("string").alias(f"_p{i}") for i, c in enumerate(partition_cols)],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs.values())],
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
    )
    keys = [f"_p{i}" for i in range(len(partition_cols))]
    dealt = packed.repartition("_g", *keys) if partition_cols else packed.repartition(1)
    ordered = dealt.sortWithinPartitions("_g", *keys, *[f"_o{i}" for i in range(len(order_cols))])
    own = [f"c{i}" for i in range(len(names))]
    new = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(added)]
    kinds = ", ".join([f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(names))] + [f"a{i} {t}" for i, (_, t) in enumerate(new)])
    seen = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold = None, start()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for a, b in _runs(table, ["_g", *keys]):
                part = table.slice(a, b - a)
                key = tuple(part.column(k)[0].as_py() for k in ["_g", *keys])
                if held is not None and key != held:
                    fold = start()
                held = key
                made = fold(part.select([f"_i{i}" for i in range(len(seen))]).rename_columns(seen))
                yield from pa.Table.from_arrays([*part.select(own).columns, *made], [*own, *[f"a{i}" for i in range(len(new))]]).combine_chunks().to_batches()

    return ordered.mapInArrow(run, kinds).toDF(*names, *[n for n, _ in new])


def _runs(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of equal keys."""
    n = table.num_rows
    cut = np.zeros(max(0, n - 1), bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cut |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, b
