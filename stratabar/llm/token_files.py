"""Token files: Arrow stream files of equal-length sequences and masks, written in id order and read back.

A part is two Arrow stream files. `part-N.arrows` has record batches of `ids` (fixed-size list of unsigned 16- or
32-bit integers) and `mask` (fixed-size list of booleans, false on padding): the ids of the part's documents on end,
cut into sequences of one length, the last one padded. As every batch but the last has the same size, a memory map
gives any sequence without copying. `part-N.index.arrows` has a row per document: id, start in the part, n_tokens.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from stratabar.llm.chunks import WITH_SPACES, WORDS_APART, ChunkCache, byte_letters, is_word, special_pattern
from stratabar.llm.common import column, held_by_worker, released, shared_dir, table

SEQUENCE = 2048
#: Sequences of a record batch.
BATCH_SEQUENCES = 128
#: Bytes of ids that go back to the JVM at once.
BATCH_BYTES = 8 << 20
#: Closes every document.
END_ID = 0


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct chunk. For byte-level tokenizers: the ids of a text are
    those of its chunks on end, as the library splits texts at the same places before it merges."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.model, self.shown = self.tok.model, byte_letters()
        self.space = self.shown[32]
        self.byte_level = self.tok.normalizer is None and [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str("a b")] == ["a", self.space + "b"]
        self.cut = WORDS_APART.findall if self.byte_level and self._words_end_at_signs() else WITH_SPACES.findall
        self.typecode = "H" if self.dtype == "<u2" else "I"
        self.specials = special_pattern([t.content for t in self.tok.get_added_tokens_decoder().values()])
        self.chunks = ChunkCache(self._ids)

    def _words_end_at_signs(self) -> bool:
        """Whether a word ends before every ASCII sign and digit, and what follows is cut as if it stood alone."""
        pieces = lambda text: [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        tails = [sign + more for sign in map(chr, range(0x21, 0x7F)) if not sign.isalpha() for more in ("", "s", "S", "re b", sign, "1", " ", "\n")]
        return all(pieces(word + tail) == pieces(word) + pieces(tail) for word in ("a", " aB", "\u00e9") for tail in tails)

    def _ids(self, chunk: str) -> bytes:
        """Plain words go to the library's model at once, other chunks through its patterns first."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if not (self.byte_level and is_word(word)):
            return array(self.typecode, self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        tokens = self.model.tokenize(self.space + word if chunk[0] == " " else word)
        return array(self.typecode, [t.id for t in tokens]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.specials and self.specials.search(text):
            return b"".join(map(self._plain, self.specials.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.cut(text)))


def encoder(path: str) -> LibraryEncoder:
    return held_by_worker(("library", path), lambda: LibraryEncoder(path))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """For a URI that pyarrow knows, or a path of this machine."""
    uri = re.sub(r"^file:/(?=[^/])", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class PartWriter:
    """Writes one part; it shows under its own name only once it is whole, so a retried task replaces it."""

    def __init__(self, folder: str, part: int, attempt: int, id_type: pa.DataType, dtype: str, length: int):
        self.fs, self.folder = file_system(folder)
        self.names = [f"part-{part:06d}.arrows", f"part-{part:06d}.index.arrows"]
        self.hidden = [f"{self.folder}/.{n}.{attempt}" for n in self.names]
        self.dtype, self.length, self.number = dtype, length, pa.from_numpy_dtype(np.dtype(dtype))
        schema = pa.schema([("ids", pa.list_(self.number, length)), ("mask", pa.list_(pa.bool_(), length))], {"id_bytes": str(np.dtype(dtype).itemsize), "sequence": str(length)})
        self.index_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(n) for n in self.hidden]
        self.sequences, self.index = pa.ipc.new_stream(self.files[0], schema), pa.ipc.new_stream(self.files[1], self.index_schema)
        self.held: list[bytes] = []
        self.held_bytes = self.tokens = self.docs = 0

    def add(self, ids: pa.Array, encoded: list[bytes]) -> None:
        width = np.dtype(self.dtype).itemsize
        counts = np.array([len(x) // width for x in encoded], np.int64)
        starts = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.tokens += int(counts.sum())
        self.docs += len(encoded)
        for x in encoded:
            self.held.append(x)
            self.held_bytes += len(x)
            if self.held_bytes >= BATCH_SEQUENCES * self.length * width:
                self._flush(BATCH_SEQUENCES * self.length)

    def _flush(self, every: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(ids) // every * every
        for at in range(0, whole, every):
            self._write(ids[at : at + every], every)
        self.held = [ids[whole:].tobytes()]
        self.held_bytes = len(self.held[0])

    def _write(self, ids: np.ndarray, room: int) -> None:
        mask = np.arange(room) < len(ids)
        padded = np.zeros(room, self.dtype)
        padded[: len(ids)] = ids
        self.sequences.write_batch(
            pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], ["ids", "mask"])
        )

    def close(self) -> tuple[int, int]:
        self._flush(BATCH_SEQUENCES * self.length)
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
        for x in (self.sequences, self.index, *self.files):
            x.close()
        for hidden, name in zip(self.hidden, self.names, strict=True):
            self.fs.move(hidden, f"{self.folder}/{name}")
        return self.docs, self.tokens


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, closes it with END_ID and writes the parts below `folder` in ascending order of id_col;
    returns the manifest: part, base (ids in all parts before), n_docs, n_tokens. Runs at once.

    `folder` must be one that all executors see. The rows are dealt by ranges of id, so parts follow each other in id
    order and each is written in one pass of bounded memory. Equal ids are ordered by text, null ids come first, null
    texts are empty (one END_ID). Other columns are not carried. An empty table gives no parts.
    """
    spark = docs.sparkSession
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, writer = encoder(tokenizer_path), TaskContext.get(), None
        end = np.array([END_ID], enc.dtype).tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = PartWriter(folder, task.partitionId(), task.taskAttemptId(), batch.schema.field(0).type, enc.dtype, length)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256)
                writer.add(batch.column(0).slice(at, 256), [enc.encode(t.as_py() or "") + end for t in texts])
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "n_docs": [n_docs], "n_tokens": [n_tokens]})
        pa.default_memory_pool().release_unused()

    ordered.mapInArrow(run, "part bigint, n_docs bigint, n_tokens bigint").write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    return spark.read.parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """From the files alone: id, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned
    32-bit). A task reads one part as a stream.

    id_type must be the type of the ids that were written; the files keep it, and other types of ids (strings, dates)
    are written as they are. A manifest without parts gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()  # the writing stage's encoder
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_part(folder, row["part"], row["base"])

    parts = max(1, manifest.count())
    return manifest.select("part", "base").repartition(parts).mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids binary")


def read_part(folder: str, part: int, base: int) -> Iterator[pa.RecordBatch]:
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/part-{part:06d}.arrows") as tokens, fs.open_input_stream(f"{path}/part-{part:06d}.index.arrows") as index:
        stream = _real_ids(pa.ipc.open_stream(tokens))
        held, names = np.empty(0, "<u4"), ["id", "start", "n_tokens", "ids"]
        for docs in pa.ipc.open_stream(index):
            out, size, first = [], 0, 0
            for at, n in enumerate(docs.column(2).to_pylist()):
                have, pieces = len(held), [held]
                while have < n:
                    pieces.append(next(stream))
                    have += len(pieces[-1])
                if len(pieces) > 1:
                    held = np.concatenate(pieces)
                out.append(held[:n].tobytes())
                held = held[n:]
                size += 4 * n
                if size > BATCH_BYTES or at + 1 == docs.num_rows:
                    some = docs.slice(first, len(out))
                    starts = pa.array(some.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([some.column(0), starts, some.column(2), pa.array(out, pa.binary())], names)
                    out, size, first = [], 0, at + 1


def _real_ids(batches: pa.RecordBatchReader) -> Iterator[np.ndarray]:
    for b in batches:
        ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
        yield (ids if mask.all() else ids[mask]).astype("<u4")


class TokenFile:
    """Random access to a part on this machine: sequences and masks as views of the memory map."""

    def __init__(self, path: str):
        self.batches = list(pa.ipc.open_stream(pa.memory_map(path)))
        self.starts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, side="right")) - 1
        ids, mask = (self.batches[k].column(c)[i - int(self.starts[k])].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
