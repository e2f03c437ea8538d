import hashlib
import json
import random
import unicodedata
from sys import getsizeof

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratabar.llm.bpe import ForcedBoundaryBPE, digests, op2_bpe, round_trip
from stratabar.llm.chunks import ChunkCache

PATHS = {n: public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k")}
ODD = [
    "", " ", "a", "A  b\n\nc\t d ", "it's WE'RE they'll 'sx", "x<|endoftext|>y  <|startoftext|> z <|endoftext|>", "</w> a</w>",
    "Éé ñÑ ß ẞ İstanbul ΣΑΣ ς", "é ́x á̧", "1234 12a4 ²½ ⅷ", "a b   c  　d\u0085e\x1cf\x1fg",
    "日本語のテキスト 한국어", "😀👩‍👩‍👧 ok", "\x00\x01﻿�", "!!!???...---***$$$%%%&&&", "thwhst " * 40, "ab" * 3000, "x" * 2000 + "é" * 500,
]


def _words(rng):
    letters = "thereandoning'éèñüßçÀΩжя12!.,| \n\t <>/w"
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))


@pytest.mark.parametrize("name", PATHS)
def test_same_as_the_library(name):
    rng, bpe, library = random.Random(3), ForcedBoundaryBPE(PATHS[name]), Tokenizer.from_file(PATHS[name])
    for text in ODD + [_words(rng) for _ in range(2000)]:
        want = library.encode(text, add_special_tokens=False).ids
        got = bpe.encode(text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want, repr(text)
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False), repr(text)


#: Assigned code points, but for scripts whose thousands of letters are alike; all up to U+10FFFF were tried once.
LETTERS = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") and (c < 0x3400 or c % 97 == 0 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x12000 or 0x1D000 <= c < 0x20000)]


@pytest.mark.parametrize("name", PATHS)
def test_letters_of_all_scripts_alone_inside_words_and_before_stops(name):
    bpe, library = ForcedBoundaryBPE(PATHS[name]), Tokenizer.from_file(PATHS[name])
    texts = ["  ".join(f"{c} a{c}B {c}. x{c}, {c}{c}x" for c in LETTERS[k : k + 16]) for k in range(0, len(LETTERS), 16)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want.ids, repr(text)


def test_caches_are_bounded_in_bytes():
    made = []
    cache = ChunkCache(lambda c: made.append(c) or c.encode(), room=20_000)
    words = [f"{'ж' * 20}{i}" for i in range(2000)]
    for w in words + words:
        assert cache[w] == w.encode()
    held = sum(map(getsizeof, [*cache, *cache.values(), *cache.old, *cache.old.values()]))
    assert held < 40_000 and len(made) == 4000
    assert cache["x" * 100] == b"x" * 100 and "x" * 100 not in cache  # long chunks are not remembered


def test_cuts_are_pairs_inside_no_token():
    bpe = ForcedBoundaryBPE(PATHS["word_bpe_49k"])
    rng, cut = random.Random(5), 0
    for _ in range(300):
        word = "".join(rng.choice("qxzjkvwé") for _ in range(12)).encode().decode("latin-1").replace("\xa9", "©").replace("\xc3", "Ã")
        parts = bpe.fragments(word)
        assert "".join(parts) == word
        cut += len(parts) - 1
        for a, b in zip(parts, parts[1:], strict=False):
            assert not any(a[-1] + b[0] in t.removesuffix("</w>") for t in bpe.vocab if t not in bpe.added)
    assert cut


def _merge(symbols, ranks):
    """Lowest rank first, leftmost among equals."""
    while len(symbols) > 1:
        order = [ranks.get(p, len(ranks)) for p in zip(symbols, symbols[1:], strict=False)]
        if min(order) == len(ranks):
            break
        at = order.index(min(order))
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


@pytest.mark.parametrize("name", PATHS)
def test_fragments_merge_as_the_ranks_say(name):
    """Inside a word and at its end, short and long, beside a plain loop over the file's merges."""
    with open(PATHS[name], encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
    bpe, rng = ForcedBoundaryBPE(PATHS[name]), random.Random(7)
    for n in [*range(1, 60), 300, 2000]:
        fragment = "".join(rng.choice("thereading.,9Ã©") for _ in range(n))
        inner = [bpe.vocab[s] for s in _merge(list(fragment), ranks)]
        end = [bpe.vocab[s] for s in _merge([*fragment[:-1], fragment[-1] + bpe.suffix], ranks)]
        assert np.frombuffer(bpe.middle[fragment], "<u4").tolist() == inner
        assert np.frombuffer(bpe.last[fragment], "<u4").tolist() == end


def test_round_trip_of_a_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Null id", "x"), (3, "Same", "x"), (3, "Same", "x"), (4, "wörd " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = digests(round_trip(docs, PATHS["word_bpe_49k"])).collect()
    library = Tokenizer.from_file(PATHS["word_bpe_49k"])
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert round_trip(docs.limit(0), PATHS["word_bpe_49k"]).count() == 0


def test_query(spark):
    got = op2_bpe(spark, "/root/testdata/sf0.001")
    library = Tokenizer.from_file(PATHS["word_bpe_49k"])
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
