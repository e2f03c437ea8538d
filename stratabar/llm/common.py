"""What the operators of this subpackage share: table access, checkpoints, the train/held-out fold."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct: what is added beside it can't clash with them. `name.*` unpacks it."""
    return F.struct(*map(column, df.columns)).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where it is unset and Spark runs inside one process
    (tests) a temporary folder is made and set; on a cluster that would be a folder the executors don't see."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratabar-"))
        named = sc.getCheckpointDir()
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3: rows with 1 are held out of all learning. Null ids: null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 3


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def literal_rows(spark: SparkSession, json_rows: str, schema: str) -> DataFrame:
    """A small table given as a JSON array: one literal in the plan, so nothing but the plan is needed to rebuild it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json_rows), f"array<struct<{schema}>>")))


_held: dict[object, object] = {}


def held_by_worker(name: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task. Only the last operator's: another name drops what was held."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def released() -> None:
    """Drops what this worker holds."""
    _held.clear()


def map_texts(docs: DataFrame, text_col: str, keep: Sequence[Column], added: str, compute: Callable[[list[str]], list[pa.Array]], rows_at_once: int = 256) -> DataFrame:
    """The columns `keep`, as they are named, and those that compute makes of the texts (null: empty), declared in
    `added`. Names must differ: callers keep an id and, as one struct, whatever else a table has.

    compute gets at most rows_at_once texts, and that many rows go back at a time.
    """
    rows = docs.select(F.coalesce(column(text_col).cast("string"), F.lit("")), *keep)
    names = [f.name for f in rows.schema[1:]]
    made = StructType.fromDDL(added)
    if len({n.lower() for n in [*names, *made.names]}) < len(names) + len(made):
        raise ValueError(f"columns of one name among {', '.join([*names, *made.names])}")
    out = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*rows.schema[1:], *made])])
    labels = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(at, rows_at_once)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *compute(some.column(0).to_pylist())], labels)
        pa.default_memory_pool().release_unused()

    return rows.toDF(*[f"t{i}" for i in range(len(rows.columns))]).mapInArrow(run, out).toDF(*names, *made.names)


def kept_columns(docs: DataFrame, id_col: str, carry: bool) -> list[Column]:
    """The id, and with carry the whole row as the struct `row`."""
    return [column(id_col).alias(id_col), *([whole_row(docs)] if carry else [])]
