"""Archives and CSV files to typed, partitioned Parquet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratabar.schemas import HEADER_SYNONYMS, TIME_COLUMNS, DataType, get_data_type_schema

#: Lines of an archive that go to the JVM at once.
LINES = 20_000
#: What a field that is no number may hold without being a header.
_VALUES = {"true", "false", "nan", "null", ""}


def has_header(line: str) -> bool:
    """A header's first field is neither a number nor a truth value: files without one may hold True or False."""
    first = line.split(",")[0].strip().strip('"').lower()
    if first in _VALUES:
        return False
    try:
        float(first)
    except ValueError:
        return re.match(r"\d{4}-\d{2}-\d{2}", first) is None
    return False


def column_names(header: str, schema: StructType) -> list[str]:
    """A header's names, synonyms replaced."""
    names = [c.strip().strip('"') for c in header.split(",")]
    by_case = {n.lower(): n for n in schema.names}
    return [HEADER_SYNONYMS.get(n.lower()) or by_case.get(n.lower(), n) for n in names]


def _typed(lines: DataFrame, schema: StructType, data_type: DataType, timestamps: bool) -> DataFrame:
    """columns: fields in the schema's order. What can't be read as its type is null."""
    fields = [F.expr(f"try_cast(nullif(trim(fields[{i}]), '') AS {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(schema)]
    rows = lines.select(*[c for c in lines.columns if c != "fields"], *fields)
    if timestamps:
        times = [c for c in ("open_time", "close_time", "time", "timestamp", "transaction_time", "event_time", "calc_time", "create_time") if c in schema.names]
        rows = rows.withColumns({c: F.expr(f"try_to_timestamp({c}, 'yyyy-MM-dd HH:mm:ss')") if schema[c].dataType.simpleString() == "string" else F.timestamp_millis(c) for c in times})
    return rows


def read_archives(spark: SparkSession, paths: str | Sequence[str], data_type: DataType, timestamps: bool = False) -> DataFrame:
    """The first CSV file of each ZIP archive, typed by the schema of data_type, with source_file. With or without a
    header. One task per archive; its lines are streamed out in batches, and archives that can't be opened are skipped
    by none: the read fails."""
    schema = get_data_type_schema(data_type)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in _csv_rows(content.as_py(), names, schema):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(rows, pa.list_(pa.string()))], ["source_file", "fields"])

    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return _typed(files.select("path", "content").mapInArrow(run, "source_file string, fields array<string>"), schema, data_type, timestamps)


def _csv_rows(archive: bytes, names: list[str], schema: StructType) -> Iterator[list[list[str | None]]]:
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        if member is None:
            raise ValueError("the archive holds no CSV file")
        with z.open(member) as f:
            lines = io.TextIOWrapper(f, "utf-8")
            order, rows = list(range(len(names))), []
            for k, line in enumerate(lines):
                line = line.rstrip("\r\n")
                if not line:
                    continue
                if not k and has_header(line):
                    own = column_names(line, schema)
                    order = [own.index(n) if n in own else -1 for n in names]
                    continue
                fields = line.split(",")
                rows.append([fields[i] if 0 <= i < len(fields) else None for i in order])
                if len(rows) == LINES:
                    yield rows
                    rows = []
            if rows:
                yield rows


def read_csv(spark: SparkSession, path: str | Sequence[str], data_type: DataType, header: bool | None = None, timestamps: bool = False) -> DataFrame:
    """Typed CSV files. Without `header` each file's own first line tells whether it is one, so a folder may hold files
    with and without a header and with columns in other orders; files of one header are read together. The first
    lines are found by one scan, and a row per file comes to the driver. Empty files and folders give no rows."""
    schema = get_data_type_schema(data_type)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))
    heads = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "place").alias("line")).collect()
    layouts: dict[str | None, list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        named = has_header(r["line"]) if header is None else header
        layouts.setdefault(r["line"] if named else None, []).append(unquote(r["file"]))

    def fields(line: str | None, files: list[str]) -> DataFrame:
        names = schema.names if line is None else [f"{n}#{k}" if n in own[:k] else n for own in [column_names(line, schema)] for k, n in enumerate(own)]
        raw = spark.read.csv(files, header=line is not None, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=True)
        return raw.select(F.array(*[F.col(f"`{n}`") if n in names else F.lit(None).cast("string") for n in schema.names]).alias("fields"))

    parts = [fields(line, files) for line, files in layouts.items()] or [spark.createDataFrame([], "fields array<string>")]
    return _typed(reduce(DataFrame.unionByName, parts), schema, data_type, timestamps)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), codec: str = "zstd", level: int | None = None, mode: str = "overwrite") -> None:
    """Parquet with Zstandard; level up to 22 (18 is slow and small)."""
    writer = df.write.mode(mode).option("compression", codec)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def output_path(base: str, symbol: str, data_type: DataType, day: str, stem: str) -> str:
    """base/dataset_SYMBOL/YYYY_MM/type/stem.parquet"""
    return f"{base}/dataset_{symbol}/{day[:7].replace('-', '_')}/{data_type.value}/{stem}.parquet"


def present_sources(spark: SparkSession, out: str) -> DataFrame:
    """source_file of what a table holds; none if there is no table yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "source_file string")
    return spark.read.parquet(out).select("source_file").distinct()


def ingest_archives(spark: SparkSession, paths: str | Sequence[str], data_type: DataType, symbol: str, out: str) -> DataFrame:
    """Archives to Parquet partitioned by symbol, month and type; returns the written table. An archive that the table
    holds already, told by source_file, isn't added again."""
    listed = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("source_file"))
    new = [r["source_file"] for r in listed.join(present_sources(spark, out), "source_file", "left_anti").collect()]  # a row per archive
    if new:
        time = F.col(TIME_COLUMNS[data_type])
        at = F.to_timestamp(time) if data_type in (DataType.METRICS, DataType.BOOK_DEPTH) else F.timestamp_millis(time)
        rows = read_archives(spark, new, data_type).withColumns({"symbol": F.lit(symbol), "year_month": F.date_format(at, "yyyy_MM"), "data_type": F.lit(data_type.value)})
        write_parquet(rows, out, ["symbol", "year_month", "data_type"], mode="append")
    return spark.read.parquet(out)


def compact(spark: SparkSession, files: Sequence[str], out: str, data_type: DataType, max_records: int = 20_000_000) -> DataFrame:
    """Several files as one table in time order: ranges of time, sorted inside, so it needs no single task. The inputs
    stay."""
    time = TIME_COLUMNS[data_type]
    whole = spark.read.parquet(*files)
    ordered = whole.repartitionByRange(time).sortWithinPartitions(time)
    ordered.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_records).parquet(out)
    return spark.read.parquet(out)


def check_archives(spark: SparkSession, paths: str | Sequence[str], data_type: DataType) -> DataFrame:
    """A row per archive: source_file, n_rows, error (null where it can be read). One task per archive."""
    schema = get_data_type_schema(data_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, error = 0, None
                try:
                    n = sum(map(len, _csv_rows(content.as_py(), schema.names, schema)))
                except (ValueError, UnicodeDecodeError, zipfile.BadZipFile) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([error], pa.string())], ["source_file", "n_rows", "error"])

    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInArrow(run, "source_file string, n_rows bigint, error string")


def process_downloaded_files(spark: SparkSession, paths: str | Sequence[str], data_type: DataType, symbol: str, out: str) -> dict[str, int]:
    """Ingests the archives that can be read and aren't in the table yet; returns how many there are, and can be read or
    not. Run again, it adds nothing."""
    found = check_archives(spark, paths, data_type).collect()  # a row per file
    good = [r["source_file"] for r in found if r["error"] is None]
    if good:
        ingest_archives(spark, good, data_type, symbol, out)
    return {"total": len(found), "successful": len(good), "failed": len(found) - len(good)}


def process_csv_to_parquet(spark: SparkSession, path: str | Sequence[str], out: str, data_type: DataType) -> DataFrame:
    write_parquet(read_csv(spark, path, data_type), out)
    return spark.read.parquet(out)


def process_zip_to_parquet(spark: SparkSession, path: str | Sequence[str], out: str, data_type: DataType) -> DataFrame:
    write_parquet(read_archives(spark, path, data_type).drop("source_file"), out)
    return spark.read.parquet(out)


def shared_file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """For a URI that pyarrow knows, or a path."""
    uri = re.sub(r"^file:/(?=[^/])", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def export_archives(df: DataFrame, folder: str, stem: str = "part", header: bool = True, by: str | None = None) -> DataFrame:
    """Writes each partition of df as a ZIP archive of one CSV file into `folder`, which all executors must see; given
    `by`, an archive for each of its values (stem-value), without that column. Returns a row per archive: file, n_rows.
    An archive shows under its name once it is whole, so retried tasks do no harm."""
    fs, path = shared_file_system(folder)
    fs.create_dir(path, recursive=True)
    names = [c for c in df.columns if c != by]
    if by is not None:
        df = df.repartition(by).sortWithinPartitions(by)
    label = F.col(by).cast("string") if by is not None else F.lpad(F.spark_partition_id().cast("string"), 5, "0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = shared_file_system(folder)
        attempt = TaskContext.get().taskAttemptId()
        for value, parts in groupby(_by_first(batches), key=lambda x: x[0]):
            name, n = f"{stem}-{value}", 0
            hidden = f"{root}/.{name}.{attempt}"
            with own.open_output_stream(hidden) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name}.csv", "w") as f:
                if header:
                    f.write((",".join(names) + "\n").encode())
                for _, part in parts:
                    columns = [c.to_pylist() for c in part.columns[1:]]
                    f.write("".join(",".join("" if v is None else str(v) for v in row) + "\n" for row in zip(*columns, strict=True)).encode())
                    n += part.num_rows
            own.move(hidden, f"{root}/{name}.zip")
            yield pa.RecordBatch.from_pydict({"file": [f"{name}.zip"], "n_rows": [n]})

    written = df.select(label, *names).mapInArrow(run, "file string, n_rows bigint").collect()  # a row per archive
    return df.sparkSession.createDataFrame(written, "file string, n_rows bigint")


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Pieces of batches that have one value in the first column."""
    for batch in batches:
        codes = batch.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.column(0)[a].as_py(), batch.slice(a, b - a)
