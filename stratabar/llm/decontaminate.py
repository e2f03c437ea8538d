"""Benchmark decontamination: windows of typed templates, matched by hash and checked for consistent slots."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stratabar.llm.common import checkpointed, column, table, whole_row

#: Template tokens of a window; an item of fewer tokens is one window.
WINDOW = 8
#: Windows of an item that a document must have (all, if the item has fewer).
LEAST_WINDOWS = 5
#: Tokens of a window that must be words, not placeholders, or one in three if the window is shorter.
LEAST_WORDS = 3
#: Bits of the filters of the benchmark's windows and words that the workers get: 8 and 2 MB, whatever its size.
WINDOW_BITS, WORD_BITS = 26, 24
#: Windows and leaks that are broadcast to a join, at most; more are joined by shuffle.
MAX_BROADCAST = 200_000
#: Chunks, and their letters, that a worker remembers.
CACHE_CHUNKS, CACHE_LETTERS = 300_000, 4_000_000
#: Windows that go back to the JVM at once, about.
HITS_AT_ONCE = 20_000
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degrees degree kmh mph hz khz mhz ghz w kw kwh v a j kj cal kcal pa kpa bar".split()
) | frozenset("%$€£°")

_ONES, _TENS = "one two three four five six seven eight nine", "twenty thirty forty fifty sixty seventy eighty ninety"
#: Words that may stand for a number. Each counts as a number of its own ("two hundred" is two), but for twenty-one.
NUMBER_WORDS = frozenset(f"zero {_ONES} ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen {_TENS} hundred thousand million billion dozen".split()) | frozenset(
    f"{a}-{b}" for a in _TENS.split() for b in _ONES.split()
)
#: Words that begin sentences and are no names there, unless the item has them with a capital inside a sentence too.
STARTERS = frozenset(
    "a an the this that these those each every all both some any no one another other many most more much few several such what who whom whose which when where why how "
    "i you he she it we they his her its their our my your there here if in on at by for from of to with without into over under after before during since until while as because although though "
    "and but or so then thus hence therefore however also now next first second third last finally once is are was were be been am do does did has have had can could will would shall should may might must let "
    "given suppose assume consider find calculate compute determine solve write read choose select explain describe name list show prove use using draw state give estimate evaluate simplify complete fill answer question "
    "only not yes true false note example please tell about between among per round add subtract multiply divide".split()
)

NUMBER, NAME, UNIT, OTHER = 1, 2, 3, 0
_FIRST_WORD = 4
#: Stands for a line's end among the chunks.
_BREAK = "\ue000"
_TOKENS = re.compile(rf"(?i:\b(?:{_TENS.replace(' ', '|')})-(?:{_ONES.replace(' ', '|')})\b)|" r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£°]")
_ENDS = re.compile(r"[.!?:][\"'”’)\]*]*$")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
#: A factor for each place of a window.
_PLACES = np.random.default_rng(4).integers(1, 1 << 63, WINDOW).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Readings of windows that are hashed at once, about.
_AT_ONCE = 1 << 20


class Bits:
    """A filter of 64-bit hashes by their first bits: what it lacks is absent, what it has may be there."""

    def __init__(self, size: int, bits: bytes | bytearray):
        self.size, self.bits = size, np.frombuffer(bits, np.uint8)

    def __getstate__(self) -> tuple[int, bytes]:
        return self.size, zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.__init__(state[0], zlib.decompress(state[1]))

    @classmethod
    def of(cls, hashes: DataFrame, size: int) -> Bits:
        """From a column h. Spark sets the bits; 2^size of them, in pieces of 4 KB, come to the driver at most."""
        x = F.shiftrightunsigned("h", 64 - size) + 1
        made = hashes.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
        bits = bytearray((1 << size) // 8)
        for r in made.collect():
            bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
        return cls(size, bits)

    def has(self, h: int) -> bool:
        place = h >> (64 - self.size)
        return bool(self.bits[place >> 3] >> (place & 7) & 1)

    def have(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class _Chunks(dict):
    """chunk -> its number; for each number, arrays of what the chunk's tokens are."""

    def __init__(self, words: Bits | None):
        super().__init__()
        self.words, self.new, self.letters = words, [], 0
        self.ends, self.first, self.size = np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
        self.at_start, self.inside, self.also, self.units = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.plain = np.empty(0, np.int64)
        self.n_chunks = self.n_tokens = 0

    def full(self) -> bool:
        return len(self) > CACHE_CHUNKS or self.letters > CACHE_LETTERS

    def word(self, low: str) -> int:
        """The number of a lower-case word: a hash of 62 bits, or OTHER for one that the benchmark can't have."""
        h = xxhash.xxh64_intdigest(low)
        return OTHER if self.words is not None and not self.words.has(h) else (h >> 2) + _FIRST_WORD

    def __missing__(self, chunk: str) -> int:
        self.letters += len(chunk)
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number

    def settle(self) -> None:
        """Fills the arrays for the chunks met since the last time."""
        ends, size, at_start, inside, also, plain, units = [], [], [], [], [], [], []
        for chunk in self.new:
            ends.append(chunk == _BREAK or (not chunk[-1].isalnum() and _ENDS.search(chunk) is not None))
            tokens = [chunk] if chunk.isalpha() else _TOKENS.findall(chunk)
            size.append(len(tokens))
            for k, token in enumerate(tokens):
                low = token.lower()
                own = self.word(low)
                word = NUMBER if token[0].isdigit() else own
                name = NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else word
                at_start.append(name if k else word)
                inside.append(name)
                also.append(NUMBER if low in NUMBER_WORDS else name)
                plain.append(own)
                units.append(low in UNITS)
        self.new = []
        first = self.n_tokens + np.cumsum(np.append(0, size))[:-1].astype(np.int64)
        for name, more, filled in (("ends", ends, self.n_chunks), ("first", first, self.n_chunks), ("size", size, self.n_chunks), ("at_start", at_start, self.n_tokens), ("inside", inside, self.n_tokens), ("also", also, self.n_tokens), ("plain", plain, self.n_tokens), ("units", units, self.n_tokens)):
            own = getattr(self, name)
            if filled + len(more) > len(own):
                own = np.concatenate([own, np.zeros(max(len(own), len(more), 1 << 16), own.dtype)])
                setattr(self, name, own)
            own[filled : filled + len(more)] = more
        self.n_chunks += len(size)
        self.n_tokens += len(at_start)


class Templates:
    """Texts as template tokens over the words of the benchmark: a number, name or unit is its type, a word of the
    benchmark is itself, any other word matches nothing. A name is a word with one capital, its first letter. Two
    readings are kept of a word that begins a sentence or a line so, itself and a name, of a number word, itself and a
    number, and of a unit after one. Without a filter of words, all words are the benchmark's."""

    def __init__(self, words: Bits | None = None):
        self.words = words
        self.known = _Chunks(words)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of all texts on end: template tokens, their second readings (or the same again), the lower-case words and
        numbers without placeholders, the chunk of each, the chunks, and where each text's tokens start (one more for
        the end)."""
        if self.known.full():
            self.known = _Chunks(self.words)
        chunks: list[str] = []
        stops = [0]
        for t in texts:
            chunks += t.replace("\n", " \ue000 ").split()
            chunks.append(_BREAK)
            stops.append(len(chunks))
        known = self.known
        at = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        if known.new:
            known.settle()
        n = known.size[at]
        ends = known.ends[at]
        offsets = np.append(0, np.cumsum(n))
        owner = np.repeat(np.arange(len(chunks)), n)
        place = np.arange(len(owner)) - offsets[owner] + known.first[at][owner]
        starts = np.append(True, ends[:-1])[owner]
        tokens = np.where(starts, known.at_start[place], known.inside[place])
        also = known.also[place]
        unit = known.units[place]
        unit[:1] = False
        after = lambda x: unit & np.append(False, x[:-1] == NUMBER)[: len(unit)]
        tokens, also = np.where(after(tokens), UNIT, tokens), np.where(after(also) | after(tokens), UNIT, also)
        return np.where(tokens == OTHER, also, tokens), also, known.plain[place], owner, chunks, offsets[np.array(stops)]

    @staticmethod
    def slot(place: int, owner: np.ndarray, chunks: list[str]) -> str:
        """The written form of the token at a place."""
        k = place - int(np.searchsorted(owner, owner[place]))
        return _TOKENS.findall(chunks[owner[place]])[k].lower()


def window_hashes(tokens: np.ndarray, also: np.ndarray, length: int, plain: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes), in parts, of the readings of windows that hold no unknown word and, but for plain ones, enough
    words. Windows of another length or form have other hashes."""
    n = len(tokens) - length + 1
    if n < 1:
        return
    sums = lambda x: np.cumsum(np.append(0, x))[length:] - np.cumsum(np.append(0, x))[:-length]
    need = 0 if plain else min(LEAST_WORDS, -(-length // 3))
    salt = np.uint64((2 * length + plain) * int(_MIX[0]) % (1 << 64))
    words, two = tokens >= _FIRST_WORD, tokens != also
    held = sums(words)
    starts = np.flatnonzero((sums(tokens == OTHER) == 0) & (held >= need))
    mixed = tokens.astype(np.uint64) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    other = also.astype(np.uint64) * _MIX[0]
    other = (other ^ (other >> np.uint64(32))) * _MIX[1] - mixed
    part = np.cumsum(1 << sums(two)[starts]) // _AT_ONCE
    for own in np.split(starts, np.flatnonzero(np.diff(part)) + 1) if len(starts) else []:
        h = np.full(len(own), salt, np.uint64)
        for i in range(length):
            h += mixed[own + i] * _PLACES[i]
        left = held[own]
        for i in range(length if two.any() else 0):
            k = np.flatnonzero(two[own + i])
            k = k[left[k] - words[own[k] + i] >= need]
            h = np.append(h, h[k] + other[own[k] + i] * _PLACES[i])
            left = np.append(left, left[k] - words[own[k] + i])
            own = np.append(own, own[k])
        yield own, h ^ (h >> np.uint64(29))


#: A window of an item. slots: place in the item, type, written form and, of a token with two readings, whether it must
#: keep its form (else null). needed, total: the item's different template windows, and all its windows.
_WINDOWS = "h bigint, n bigint, place int, length int, plain boolean, needed int, total int, slots array<struct<q:int,kind:int,own:string,firm:boolean>>"
_HITS = "hits array<struct<h:bigint,start:int,read:array<string>>>"
_SLOT = pa.struct([("q", pa.int32()), ("kind", pa.int32()), ("own", pa.string()), ("firm", pa.bool_())])
_HIT = pa.struct([("h", pa.int64()), ("start", pa.int32()), ("read", pa.list_(pa.string()))])


def item_windows(text: str, templates: Templates) -> tuple[list[dict], set[int]]:
    """The windows of an item as _WINDOWS has them, but n, and the hashes of its words. Items of numbers alone have none."""
    tokens, also, plain, owner, chunks, _ = templates.tokens([text])
    found = _TOKENS.findall(text)
    length = min(WINDOW, len(tokens))
    worded = any(t[0].isalpha() for t in found)
    hashed = list(window_hashes(tokens, also, length)) if length else []
    if not hashed and not worded:
        return [], set()
    slots = {p: (int(also[p]), Templates.slot(p, owner, chunks)) for p in np.flatnonzero((also < _FIRST_WORD) & (also != OTHER)).tolist()}
    two = tokens != also
    inner = {slots[p] for p in slots if not two[p]}
    usual = {Templates.slot(p, owner, chunks) for p in np.flatnonzero(also >= _FIRST_WORD).tolist()} | STARTERS
    firm = {p: slots[p][0] == NAME and slots[p] not in inner and slots[p][1] in usual if two[p] else None for p in slots}
    needed = len(np.unique(np.concatenate([x for x, _ in hashed]))) if hashed else 0
    total = len(tokens) - length + 1 if worded else needed
    both = [(False, *x) for x in hashed] + [(True, *x) for x in (window_hashes(plain, plain, length, True) if worded else [])]
    rows = []
    for form, starts, hashes in both:
        for p, h in zip(starts.tolist(), hashes.view(np.int64).tolist(), strict=True):
            own = [] if form else [{"q": q, "kind": slots[q][0], "own": slots[q][1], "firm": firm[q]} for q in range(p, p + length) if q in slots]
            rows.append({"h": h, "place": p, "length": length, "plain": form, "needed": needed, "total": total, "slots": own})
    return rows, {xxhash.xxh64_intdigest(t.lower()) for t in found}


def text_windows(texts: list[str], templates: Templates, kinds: list[tuple[int, bool]], known: Bits) -> list[list[dict]]:
    """For each text its windows that the benchmark may have, as _HITS has them. read: the written forms of a template's
    tokens."""
    tokens, also, plain, owner, chunks, stops = templates.tokens(texts)
    out: list[list[dict]] = [[] for _ in texts]
    for length, form in kinds:
        for starts, hashes in window_hashes(plain, plain, length, True) if form else window_hashes(tokens, also, length):
            hit = np.flatnonzero(known.have(hashes))
            starts, hashes = starts[hit], hashes[hit]
            text = np.searchsorted(stops, starts, side="right") - 1
            inside = starts + length <= stops[text + 1]
            for k, p, h in zip(text[inside].tolist(), starts[inside].tolist(), hashes[inside].view(np.int64).tolist(), strict=True):
                read = None if form else [Templates.slot(q, owner, chunks) for q in range(p, p + length)]
                out[k].append({"h": h, "start": p - int(stops[k]), "read": read})
    return out


def judge(windows: list[dict], needed: int, total: int) -> tuple[int, int] | None:
    """(windows found, slots changed) if the windows that a text and an item share are a leak. windows: start in the
    text, place in the item, length, plain, slots of the item, read of the text."""
    same = {w["place"] for w in windows if w["plain"]}
    alignments: dict[int, dict[int, dict]] = defaultdict(dict)
    for w in windows:
        if not w["plain"]:
            alignments[w["start"] - w["place"]][w["place"]] = w

    def enough(found: set[int]) -> bool:
        return bool(found) and len(found) >= min(needed, LEAST_WINDOWS) or len(found | same) >= min(total, LEAST_WINDOWS)

    if not enough({p for own in alignments.values() for p in own}):
        return None
    found: set[int] = set()
    changed = 0
    for own in alignments.values():
        kept, other = _consistent(own)
        found |= kept
        changed += other
    return (len(found | same), changed) if enough(found) else None


def _consistent(windows: dict[int, dict]) -> tuple[set[int], int]:
    """Of one alignment, by place: the windows whose slots agree with its one-to-one renaming of slot values, and how
    many slots have another value than in the item. Each value of the item is renamed as it is most often. A slot with
    a second reading may always keep its value, and a firm one (a word that only begins a sentence) must."""
    read, firm = {}, {}
    for p, w in windows.items():
        for s in w["slots"]:
            read[s["q"]] = ((s["kind"], s["own"]), w["read"][s["q"] - p])
            if s["firm"] is not None:
                firm[s["q"]] = s["firm"]
    read = dict(sorted(read.items()))
    lost = {q for q, (own, new) in read.items() if firm.get(q) and own[1] != new}
    read = {q: (own, new) for q, (own, new) in read.items() if q not in firm or own[1] != new and not firm[q]}
    renamed: dict[tuple[int, str], str] = {}
    taken: set[tuple[int, str]] = set()
    for (own, new), _ in Counter(read.values()).most_common():
        if own not in renamed and (own[0], new) not in taken:
            renamed[own] = new
            taken.add((own[0], new))
    bad = lost | {q for q, (own, new) in read.items() if renamed.get(own) != new}
    kept = {p for p, w in windows.items() if not any(q in bad for q in range(p, p + w["length"]))}
    return kept, sum(own[1] != new for q, (own, new) in read.items() if q not in bad)


@dataclass
class Benchmark:
    """A benchmark's windows as a table by hash, its items' ids by number, and filters of bounded size."""

    windows: DataFrame
    items: DataFrame
    kinds: list[tuple[int, bool]]
    known: Bits
    words: Bits
    n_windows: int = field(default=0)


def read_benchmark(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Benchmark:
    """Its windows and words are made on the executors and written to the shared folder; the driver gets the filters and
    the lengths of windows alone."""
    items = checkpointed(benchmark.select(F.monotonically_increasing_id().alias("n"), column(item_col).alias("item_id"), column(item_text).cast("string").alias("text")))
    made = StructType([*StructType.fromDDL(_WINDOWS), StructField("words", StructType.fromDDL("w array<bigint>")[0].dataType)])
    names = made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for n, text in zip(batch.column(0), batch.column(1), strict=True):
                rows, words = item_windows(text.as_py(), templates)
                if rows:
                    own = [h - (1 << 64) if h >> 63 else h for h in sorted(words)]
                    values = {"n": [n.as_py()] * len(rows), "words": [own] + [None] * (len(rows) - 1)} | {k: [r[k] for r in rows] for k in rows[0]}
                    kinds = {"h": pa.int64(), "n": pa.int64(), "plain": pa.bool_(), "slots": pa.list_(_SLOT), "words": pa.list_(pa.int64())}
                    yield pa.RecordBatch.from_arrays([pa.array(values[k], kinds.get(k, pa.int32())) for k in names], names)

    windows = checkpointed(items.filter(F.col("text").isNotNull()).select("n", "text").mapInArrow(run, made))
    kinds = [(r["length"], r["plain"]) for r in windows.select("length", "plain").distinct().collect()]  # 2 x WINDOW at most
    words = windows.filter(F.col("words").isNotNull()).select(F.explode("words").alias("h"))
    return Benchmark(windows.drop("words"), items.select("n", "item_id"), sorted(kinds), Bits.of(windows, WINDOW_BITS), Bits.of(words, WORD_BITS), windows.count())


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that leaks into it: id, text_key (MD5 of the text), n (the item's row), item_id,
    windows, of_windows, changed_slots. Rows that repeat both id and text are one document.

    An item leaks into a document that has LEAST_WINDOWS of its windows (all, if it has fewer) as templates, counted
    where slots are renamed consistently, or in plain lower case: changed_slots above 0 marks a re-parameterised copy.
    Whole texts are searched. Null and empty documents have no leaks; null and empty items, and items of numbers alone,
    can't leak; repeated items are reported each, whatever the type of their ids. An empty benchmark finds nothing; an
    empty table gives no rows.

    The documents are read once, whatever the benchmark's size: a filter of fixed size lets pass the windows that the
    benchmark may have, which are joined with its windows by hash (broadcast up to MAX_BROADCAST of them, else by
    shuffle); what a document and an item share, bounded by the document's length, is then checked for its slots.
    """
    bench = read_benchmark(benchmark, item_col, item_text)
    text = column(text_col).cast("string")
    rows = docs.select(column(id_col).alias("id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text")).filter(F.col("text").isNotNull())
    own = list(rows.schema[:2])
    kinds, known, words = bench.kinds, bench.known, bench.words

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                hits = text_windows(some.column(2).to_pylist(), templates, kinds, known)
                where = [k for k, x in enumerate(hits) if x]
                size, first = 0, 0
                for i, k in enumerate(where):
                    size += len(hits[k])
                    if size > HITS_AT_ONCE or i + 1 == len(where):
                        part = where[first : i + 1]
                        yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(part)) for c in (0, 1)], pa.array([hits[x] for x in part], pa.list_(_HIT))], ["id", "text_key", "hits"])
                        size, first = 0, i + 1
        pa.default_memory_pool().release_unused()

    shared = rows.mapInArrow(search, StructType([*own, *StructType.fromDDL(_HITS)])).select("id", "text_key", F.inline("hits"))
    windows = F.broadcast(bench.windows) if bench.n_windows <= MAX_BROADCAST else bench.windows
    pairs = shared.join(windows, "h").groupBy("id", "text_key", "n").agg(
        F.first("needed").alias("needed"), F.first("total").alias("total"), F.collect_set(F.struct("start", "place", "length", "plain", "slots", "read")).alias("windows")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                needed, total = some.column(3).to_pylist(), some.column(4).to_pylist()
                found = [judge(w.as_py(), a, b) for w, a, b in zip(some.column(5), needed, total, strict=True)]
                part = [k for k, x in enumerate(found) if x]
                numbers = [[found[k][0] for k in part], [total[k] for k in part], [found[k][1] for k in part]]
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(part, pa.int64())) for c in range(3)], *[pa.array(x, pa.int32()) for x in numbers]], ["id", "text_key", "n", "windows", "of_windows", "changed_slots"])

    judged = pairs.mapInArrow(check, StructType([*own, *StructType.fromDDL("n bigint, windows int, of_windows int, changed_slots int")]))
    return judged.join(bench.items, "n").select("id", "text_key", "n", "item_id", "windows", "of_windows", "changed_slots")


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).alias("id"), F.md5(column(text_col).cast("string").cast("binary")).alias("text_key"), whole_row(docs))


def _of_documents(found: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """rows joined with what was found about their documents, which is broadcast if it is little."""
    found = checkpointed(found)
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST else found
    return rows.join(found, rows["id"].eqNullSafe(found["id"]) & (rows["text_key"] == found["text_key"]), how)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id_col, with carry the whole row as the struct `row`, leaks (array of item_id, windows,
    of_windows, changed_slots; empty for clean documents). See leaked()."""
    one = F.struct("n", "item_id", "windows", "of_windows", "changed_slots")
    found = leaked(docs, benchmark, id_col, text_col, item_col, item_text).groupBy("id", "text_key").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["n"] < b["n"], -1).otherwise(1)).alias("leaks"))
    rows = _with_key(docs, id_col, text_col)
    out = _of_documents(found, rows, "left")
    leaks = F.transform(F.col("leaks"), lambda x: x.dropFields("n"))
    return out.select(rows["id"].alias(id_col), *(["row"] if carry else []), F.coalesce(leaks, F.array().cast(out.select(leaks.alias("x")).schema[0].dataType)).alias("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs into which nothing leaks, with all their columns, whatever these are called. See leaked()."""
    found = leaked(docs, benchmark, id_col, text_col, item_col, item_text).select("id", "text_key").distinct()
    return _of_documents(found, _with_key(docs, id_col, text_col), "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and item that leaked into it."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "windows", "of_windows", (F.col("changed_slots") > 0).alias("reparameterised"))
