"""BPE with forced boundaries: byte pairs that occur inside no vocabulary token are certain cuts."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer, models

from stratabar.llm.chunks import BETWEEN_SPACES, WITH_SPACES, ChunkCache, byte_letters, is_word, special_pattern
from stratabar.llm.common import column, held_by_worker, table

#: Bytes of fragments a worker remembers, of either kind, in each of two generations.
FRAGMENT_BYTES = 8 << 20
#: Bytes of results that go back to the JVM at once.
BATCH_BYTES = 2 << 20


class ForcedBoundaryBPE:
    """Encodes and decodes as the tokenizer file says. Normalisation, the split into words and the merges inside a
    fragment are the file's own (components of the tokenizers library).

    No merge can join the two sides of a byte pair that no token contains, so a word is cut there, each fragment is
    merged alone, and the ids are concatenated. Only the last fragment of a word carries the end-of-word mark, so the
    others go through a model of the same merges without it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.at_end = self.before_end = library.model
        if self.suffix:
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            self.before_end = models.BPE(vocab=self.vocab, merges=merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = special_pattern(list(self.added))
        self.tokens: list[str] = [""] * (1 + max(*self.vocab.values(), *self.added.values()))
        for token, i in {**self.vocab, **self.added}.items():
            self.tokens[i] = token
        self.keeps_spaces = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.shown = byte_letters()
        self.letters = {c: b for b, c in self.shown.items()}
        self._bytes = {t: bytes(map(self.letters.__getitem__, t)) if all(c in self.letters for c in t) else t.encode() for t in self.tokens}
        self.lower = self.normalizer is not None and self.normalizer.normalize_str("A") == "a"
        self.inside: set[str] = set()
        for token in self.vocab:
            if token not in self.added:
                body = token.removesuffix(self.suffix) if self.suffix else token
                self.inside.update(body[i : i + 2] for i in range(len(body) - 1))
        self.chunk = WITH_SPACES if self.keeps_spaces else BETWEEN_SPACES
        self.chunks = ChunkCache(self._encode_chunk, self._is_plain)
        self.middle = ChunkCache(lambda f: self._merged(f, self.before_end), room=FRAGMENT_BYTES)
        self.last = ChunkCache(lambda f: self._merged(f, self.at_end), room=FRAGMENT_BYTES)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return b"".join(self._id(self.added[p]) if p in self.added else self._plain(p) for p in parts)
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.keeps_spaces:
            return " ".join(tokens)
        return b"".join(map(self._bytes.__getitem__, tokens)).decode("utf-8", "replace")

    def fragments(self, word: str) -> list[str]:
        inside, out, start = self.inside, [], 0
        if inside.issuperset(map(add, word, word[1:])):
            return [word]
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[start:i])
                start = i
        return [*out, word[start:]]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(text)))

    @staticmethod
    def _id(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def _encode_chunk(self, chunk: str) -> bytes:
        out = []
        for word in self._words(chunk):
            *first, end = self.fragments(word)
            if first:
                out += [self.middle[f] for f in first]
                out.append(self.last[end])
            else:  # remembered as a chunk already
                out.append(self._merged(end, self.at_end))
        return b"".join(out)

    def _is_plain(self, chunk: str) -> bool:
        """Whether the chunk, as the normaliser leaves it, is a word to every pattern."""
        word = chunk.lower() if self.lower else chunk
        return is_word(word[1:] if self.keeps_spaces and word[0] == " " else word)

    def _words(self, chunk: str) -> list[str]:
        """In the letters that stand for bytes. Plain words need no look at the file's patterns."""
        if self._is_plain(chunk):
            word = chunk.lower() if self.lower else chunk
            return [word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(self.shown)]
        if self.normalizer:
            chunk = self.normalizer.normalize_str(chunk)
        return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    @staticmethod
    def _merged(fragment: str, model: models.BPE) -> bytes:
        ids = [t.id for t in model.tokenize(fragment)]
        return struct.pack(f"<{len(ids)}I", *ids)


def codec(path: str) -> ForcedBoundaryBPE:
    return held_by_worker(("bpe", path), lambda: ForcedBoundaryBPE(path))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (the text that
    the ids decode to). tokenizer_path is a tokenizer file that every executor can read at that path.

    Null texts count as empty: no ids, an empty decoded text. Whole texts are encoded, of any length; repeated rows
    and null ids are rows as any other; an empty table gives no rows; other columns are not carried. Map-side only:
    no shuffle, and a worker holds one input batch, bounded caches and BATCH_BYTES of results.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    made = StructType([StructField(id_col, rows.schema[0].dataType), *StructType.fromDDL("n_tokens bigint, ids binary, decoded string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            ids, decoded, size, start = [], [], 0, 0
            for at, text in enumerate(batch.column(1)):
                ids.append(bpe.encode(text.as_py() or ""))
                decoded.append(bpe.decode(ids[-1]))
                size += len(ids[-1]) + len(decoded[-1])
                if size > BATCH_BYTES or at + 1 == batch.num_rows:
                    keys = batch.column(0).slice(start, len(ids))
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids", "decoded"])
                    ids, decoded, size, start = [], [], 0, at + 1
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, made)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
