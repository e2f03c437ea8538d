import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Regex, Tokenizer, pre_tokenizers

from stratabar.llm.token_files import LibraryEncoder, TokenFile, file_system, op3_token_files, read_token_files, write_token_files
from tests.llm.test_bpe import LETTERS, ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_is_the_library():
    enc, library = LibraryEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ODD:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_of_all_scripts():
    enc, library = LibraryEncoder(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(f"{c} a{c}B {c}. x{c}, {c}{c}x" for c in LETTERS[k : k + 16]) for k in range(0, len(LETTERS), 16)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want.ids, repr(text)


def test_a_word_is_encoded_once_whatever_sign_follows():
    enc, library, made = LibraryEncoder(PATH), Tokenizer.from_file(PATH), []
    encode = enc.chunks.encode
    enc.chunks.encode = lambda chunk: made.append(chunk) or encode(chunk)
    signs = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalpha()]
    words = ["stands", "Être", "MENTREÊ", "cheauelle"]
    text = "".join(f" {w}{s}{more}" for w in words for s in signs for more in ("", s * 2, "."))
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made) == len(set(made)) and sorted(c for c in made if any(map(str.isalpha, c))) == sorted(f" {w}" for w in words)


def test_signs_after_letters_and_between():
    enc, library, rng = LibraryEncoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    parts = ["a", "don", "É", "\u024f", "\u0250", "я", "中", "\u0301", "ª", "'s", "'RE", "'", "1", "²", "-", "_", "***", ".", "’", "\x7f", "\x1f", "\xa0", " ", "  ", "\n", "\t", "<|endoftext|>", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(5000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want.ids, repr(text)


def test_patterns_that_join_words_and_signs(tmp_path):
    text = "Don't say it's over: a,b (we're) x-y, z's 12's.  It'll do"
    for pattern in (r" ?\p{L}+(?:'s|'t|'re|'ll)?| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", r" ?\p{L}+[.,]?| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"):
        library = Tokenizer.from_file(PATH)
        library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        library.save(f"{tmp_path}/t.json")
        enc = LibraryEncoder(f"{tmp_path}/t.json")
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_text_and_other_ids(spark, tmp_path):
    texts = {"a": "A very long text, of words. " * 60_000, "b": None, "c": "x" * 100_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    manifest = write_token_files(docs, f"{tmp_path}/t", PATH)
    library = Tokenizer.from_file(PATH)
    for r in read_token_files(manifest, f"{tmp_path}/t", "string").collect():
        want = [*library.encode(texts[r["id"]] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want


def test_query(spark):
    rows = op3_token_files(spark, "/root/testdata/sf0.001")
    assert rows.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library, start = Tokenizer.from_file(PATH), 0
    rows = sorted(map(tuple, rows.collect()))
    assert [r[0] for r in rows] == sorted(texts)
    for doc_id, at, n, crc in rows:
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_written_and_read(spark, tmp_path):
    texts = [None, "", "Hello world!", "same", "same", "long text " * 900]
    rows = [(i * 7 % 11, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (3, "another", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    folder = f"file://{tmp_path}/tokens"
    manifest = write_token_files(docs, folder, PATH, length=16)
    got = sorted((r["start"], r["id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in read_token_files(manifest, folder).collect())
    library, start, want = Tokenizer.from_file(PATH), 0, []
    bodies = {}
    for i, t, _ in rows:
        bodies.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    for at, i, n, crc in got:
        assert at == start
        body = next(b for b in bodies[i] if len(b) == n and zlib.crc32(np.array(b, "<u4").tobytes()) == crc)
        bodies[i].remove(body)
        want += body
        start += n
    # random access: the real ids of all sequences of all parts, in order, are the corpus
    ids = []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        f = TokenFile(f"{tmp_path}/tokens/part-{r['part']:06d}.arrows")
        for k in range(len(f)):
            sequence, mask = f[k]
            assert len(sequence) == len(mask) == 16
            ids += sequence[mask.to_numpy(zero_copy_only=False)].tolist()
    assert ids == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = write_token_files(docs, f"{tmp_path}/none", PATH)
    assert manifest.count() == 0 and read_token_files(manifest, f"{tmp_path}/none").count() == 0


def test_uris():
    assert file_system("file:/tmp/x")[1] == "/tmp/x" and file_system("/tmp/x")[1] == "/tmp/x"
