"""Cutting texts into chunks that a tokenizer treats alone, so that each distinct chunk is encoded once per worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from sys import getsizeof

#: Unicode White_Space, as the tokenizers' patterns understand \s.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
#: For tokenizers that drop white space.
BETWEEN_SPACES = re.compile(rf"[^{WHITE_SPACE}]+")
#: For byte-level tokenizers that keep it: a chunk is a run with the space before it, or white space before such a run.
WITH_SPACES = re.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: Letters of a range in which all versions of Unicode agree.
LETTERS = "".join(filter(str.isalpha, map(chr, range(0x250))))
#: For byte-level tokenizers whose words end at every ASCII sign and digit: as WITH_SPACES, but a word of LETTERS before
#: such a sign is a chunk of its own, and the signs after it another, so a word is one chunk whatever follows it.
WORDS_APART = re.compile(rf" ?[{LETTERS}]++(?![^!-@\[-`{{-~{WHITE_SPACE}])| ?[^{WHITE_SPACE}]++|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: Bytes of chunks and encodings that a cache remembers in each of two generations, with what Python needs to hold them.
CACHE_BYTES = 48 << 20
#: What an entry takes besides its chunk and its encoding.
ENTRY_BYTES = 80
#: Longer chunks are not remembered.
CACHE_CHARS = 64


class ChunkCache(dict):
    """chunk -> its encoding. When full, what it holds becomes the old generation, and what is asked for again moves
    back from there: frequent chunks stay. Bounded in bytes, so long chunks and wide letters don't take more.

    plain: tells whether a chunk is a word to which the tokenizer never joins a stop or comma that follows. The two are
    then put together from their encodings, and not remembered as a whole.
    """

    def __init__(self, encode: Callable[[str], bytes], plain: Callable[[str], bool] | None = None, room: int = CACHE_BYTES):
        super().__init__()
        self.encode, self.plain, self.room, self.free = encode, plain, room, room
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if self.plain is not None and chunk[-1] in ".," and len(chunk) > 1 and self.plain(chunk[:-1]):
            return self[chunk[:-1]] + self[chunk[-1]]
        out = self.old.get(chunk)
        if out is None:
            out = self.encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            self.free -= getsizeof(chunk) + getsizeof(out) + ENTRY_BYTES
            if self.free < 0:
                self.old, self.free = dict(self), self.room
                self.clear()
            self[chunk] = out
        return out


def is_word(chunk: str) -> bool:
    """Letters alone, of a range in which all versions of Unicode agree: every pattern takes them as one word."""
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def special_pattern(contents: list[str]) -> re.Pattern | None:
    """Splits a text at added tokens, which are kept."""
    return re.compile("(" + "|".join(map(re.escape, sorted(contents, key=len, reverse=True))) + ")") if contents else None
