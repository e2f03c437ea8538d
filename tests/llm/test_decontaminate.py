import random
import re
from collections import defaultdict

import pytest

from stratabar.llm import decontaminate
from stratabar.llm.common import table
from stratabar.llm.decontaminate import Bits, Templates, find_leaks, item_windows, judge, leaked, op4_decontamination, text_windows, without_leaks

QUESTION = "A farmer named John sells 12 kg of apples and 7 kg of pears to Mary on Monday. How many kg does John sell if Mary returns 3 kg of apples?"
RENAMED = "A farmer named Pedro sells 55 kg of apples and 20 kg of pears to Anna on Friday. How many kg does Pedro sell if Anna returns 4 kg of apples?"
MIXED = "A farmer named Pedro sells 55 kg of apples and 20 kg of pears to Anna on Friday. How many kg does Jorge sell if Peter returns 4 kg of apples?"
OTHER = "The mayor of a town speaks about 12 kg of apples and nothing else that farmers of the land would like to hear on a Monday."


def bits_of(hashes, size):
    bits = bytearray((1 << size) // 8)
    for h in hashes:
        place = h % (1 << 64) >> (64 - size)
        bits[place >> 3] |= 1 << (place & 7)
    return Bits(size, bits)


def one(text, items=((1, QUESTION),)):
    """What leaks into one text, by the operator's parts, without tables."""
    made = [(i, *item_windows(t, Templates())) for i, t in items]
    kinds = sorted({(w["length"], w["plain"]) for _, rows, _ in made for w in rows})
    known, words = bits_of([w["h"] for _, rows, _ in made for w in rows], 20), bits_of([h for *_, own in made for h in own], 20)
    (hits,) = text_windows([text], Templates(words), kinds, known)
    out = []
    for i, rows, _ in made:
        both = [x | w for x in hits for w in rows if w["h"] == x["h"]]
        if both and (found := judge(both, both[0]["needed"], both[0]["total"])):
            out.append({"item_id": i, "windows": found[0], "of_windows": both[0]["total"], "changed_slots": found[1]})
    return out


def test_slots():
    (exact,) = one("Intro words here. " + QUESTION + " And more.")
    assert exact["windows"] == exact["of_windows"] and exact["changed_slots"] == 0
    (renamed,) = one("Said someone once: " + RENAMED)
    assert renamed["windows"] == renamed["of_windows"] and renamed["changed_slots"] > 0
    mixed = one(MIXED)
    assert not mixed or mixed[0]["windows"] < renamed["windows"]
    assert one(OTHER) == [] and one("") == []


def test_inconsistent_slots_are_rejected():
    item = "Then Ann gives Bob some of the old red books while Bob and Ann read what Ann gave Bob"
    good = "Then Eve gives Sam some of the old red books while Sam and Eve read what Eve gave Sam"
    bad = "Then Eve gives Sam some of the old red books while Tom and Joe read what Kim gave Max"
    swapped = "Then Eve gives Eve some of the old red books while Eve and Eve read what Eve gave Eve"
    assert one(good, [(1, item)])[0]["windows"] == one(item, [(1, item)])[0]["windows"]
    for text in (bad, swapped):
        found = one(text, [(1, item)])
        assert not found or found[0]["windows"] < one(good, [(1, item)])[0]["windows"]


TOM = "Tom has 3 apples. Tom buys 5 apples. How many apples does Tom have?"
WILL = "Will has 3 apples.\nWill will buy 5 apples. How many apples does Will have?"


@pytest.mark.parametrize("item", [TOM, WILL])
@pytest.mark.parametrize("text", ["Ann has 4 apples. Ann buys 9 apples. How many apples does Ann have?", "Ann has four apples. Ann buys twenty-one apples. How many apples does Ann have?", "Well, Ann has 4 apples.\nAnn buys 9 apples. How many apples does Ann have?"])
def test_names_that_begin_sentences_and_number_words(item, text):
    text = text.replace("buys", "will buy") if item == WILL else text
    (found,) = one(text, [(1, item)])
    assert found["windows"] == found["of_windows"] and found["changed_slots"] > 0
    mixed = one(text.replace("does Ann", "does Eve").replace("Ann will", "Bob will").replace("Ann buys", "Bob buys"), [(1, item)])
    assert not mixed or mixed[0]["windows"] < found["windows"]


def test_number_words_in_items():
    item = "Each of the three boys walks seven miles to the old school and carries twelve books home."
    (found,) = one("Each of the 4 boys walks nine miles to the old school and carries 30 books home.", [(1, item)])
    assert found["windows"] == found["of_windows"] and found["changed_slots"] == 3


def test_words_that_begin_sentences_are_no_names():
    item = [(1, "What is the capital of France?")]
    assert one("Paris is the capital of France.", item) == [] and one("London is the capital of England", item) == []
    assert one("someone asked What is the capital of Spain?", item)[0]["changed_slots"] == 1


@pytest.mark.parametrize("item", ["What is the capital of France?", QUESTION, TOM, "Ann, Bob, Eve, Tom, Max, Kim, Joe, Sam, Pam, Ian and Lea", "Ann Bob 12 14 15 16 Eve Max 17 18 19 Kim 20 21 22 23", "Berlin Paris"])
def test_verbatim_copies_in_any_case(item):
    for copy in (item, item.lower(), item.upper(), item.title(), item.replace(" ", "\n"), re.sub(r" (?=[A-Z])", "\n", item)):
        for text in (copy, "someone asked " + copy, "A list. " + copy + " More of it."):
            (found,) = one(text, [(1, item)])
            assert found["windows"] == found["of_windows"]


def test_many_readings(monkeypatch):
    monkeypatch.setattr(decontaminate, "_AT_ONCE", 500)
    item = "We count like this: one two three four we go on five six seven eight and so on"
    (found,) = one("one two three four five six seven eight nine " * 400 + item.replace("eight", "9"), [(1, item)])
    assert found["windows"] == found["of_windows"] and found["changed_slots"] == 1


def test_short_items_and_odd_ones():
    items = [(1, "only four words here"), (2, ""), (3, "12 34 56"), (4, "only four words here"), (5, "...")]
    assert [x["item_id"] for x in one("well only four words here too", items)] == [1, 4]
    assert one("12 34 56", items) == []


def plain(docs, bench):
    """Windows of lower-case words, without placeholders: what the templates must find at least."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    windows, total = defaultdict(set), {}
    for i, t in bench:
        w = split(t)
        total[i] = max(1, len(w) - 7)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add((i, k))
    out = set()
    for d, t in docs:
        w, got = split(t), defaultdict(set)
        for k in range(len(w) - 7):
            for i, p in windows.get(tuple(w[k : k + 8]), ()):
                got[i].add(p)
        out |= {(d, i) for i, p in got.items() if len(p) >= min(total[i], decontaminate.LEAST_WINDOWS)}
    return out


def test_against_brute_force(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    rows = find_leaks(docs, bench, carry=True).collect()
    assert len(rows) == docs.count()
    got = {(r["doc_id"], x["item_id"]) for r in rows for x in r["leaks"]}
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got and all(r["row"]["doc_id"] == r["doc_id"] for r in rows)
    query = op4_decontamination(spark, "/root/testdata/sf0.01")
    assert query.columns == ["doc_id", "item_id", "windows", "of_windows", "reparameterised"]
    assert {(r["doc_id"], r["item_id"]) for r in query.collect()} == got


NAMES, UNITS = ("Ann Bob Eve Tom Max Kim Joe Sam Pam Ian Lea Max Ben Zoe Amy Leo").split(), ("kg g km miles liters hours minutes dollars pounds days").split()
FRAMES = [
    "{a} has {x} {u} of flour and gives {y} {u} of it to {b}. How many {u} does {a} still have?",
    "A train with {x} wagons leaves the town of {a} and stops after {y} {u} near the town of {b}. How far is {b} from {a}?",
    "{a} reads {x} pages of the book that {b} wrote. {b} reads {y} pages more than {a}. How many pages do they read together?",
    "If {a} pays {x} {u} for every ticket and buys {y} tickets for the friends of {b}, what does {a} pay in all?",
    "In the garden of {a} there are {x} old trees. {b} plants {y} new ones, and {a} fells one. How many trees are left?",
]


def templated(frame, rng, words):
    a, b = rng.sample(words, 2)
    x, y = rng.sample(range(2, 900), 2)
    return frame.format(a=a, b=b, x=x, y=y, u=rng.choice(UNITS))


def brute_templates(text):
    """A plain version of the templates where every slot is known: names, numbers and units of these questions only."""
    return tuple("#" if t[0].isdigit() else "@" if t in NAMES else "%" if t in UNITS else t.lower() for t in re.findall(r"\w+", text))


def test_reparameterised_items_against_brute_force(spark):
    """Recall on renamed questions (names at sentence starts too, other numbers and units), precision on other frames."""
    rng = random.Random(12)
    bench = [(f"q{i}", templated(f, rng, NAMES[:8])) for i, f in enumerate(FRAMES)]
    docs, want = [], {}
    for d in range(200):
        f = rng.choice(FRAMES)
        body = templated(f, rng, NAMES)
        if d % 4 == 3:  # shuffled words: no template is left
            words = body.split()
            rng.shuffle(words)
            body = " ".join(words)
        docs.append((d, f"Some words before it. {body} And some after it."))
        want[d] = {i for i, t in bench if brute_templates(t) == brute_templates(body)}
    found = leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id string, text string")).collect()
    got = {(r["id"], r["item_id"]) for r in found}
    planted = {(d, i) for d, items in want.items() for i in items}
    assert len(planted) >= 140 and len(got & planted) / len(planted) >= 0.95
    assert got <= planted
    assert sum(r["changed_slots"] > 0 for r in found) >= 0.9 * len(found)


def test_one_pass_however_many_items(spark, monkeypatch):
    """The documents go to Python once whatever the benchmark's size, and no window comes to the driver."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plans = []
    for n in (2, 4000):
        bench = spark.range(n).selectExpr("id AS item_id", "concat('what is number ', id, ' of the long list of things that nobody ever reads to the end') AS text")
        if n > 2:
            monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 100)  # joined by shuffle
        found = leaked(docs, bench)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        assert found.count() == 0
    assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") == 2  # one over the documents, one over what they share with items
    copies = spark.createDataFrame([(1, "So: what is number 17 of the long list of things that nobody ever reads to the end")], "doc_id bigint, text string")
    assert leaked(copies, bench).count() == 4000  # numbers are slots


def test_edges(spark):
    schema = "doc_id bigint, text string, leaks string, row string, id int, text_key string, n int, item_id string"
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "k", 2, "z") for i, t in [(1, None), (2, ""), (None, QUESTION), (3, QUESTION), (3, QUESTION), (4, "filler word " * 30_000 + QUESTION)]], schema)
    bench = spark.createDataFrame([(1, QUESTION, "a"), (1, QUESTION, "b"), (2, None, "c"), (None, QUESTION, "d")], "item_id bigint, text string, h string")
    rows = find_leaks(docs, bench, carry=True).collect()
    assert sorted((str(r["doc_id"]), len(r["leaks"])) for r in rows) == [("1", 0), ("2", 0), ("3", 3), ("3", 3), ("4", 3), ("None", 3)]
    assert all((r["row"]["leaks"], r["row"]["row"], r["row"]["item_id"]) == ("x", "y", "z") for r in rows)
    clean = without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2]
    assert leaked(docs, bench).count() == 9  # rows that repeat id and text are one document
    assert find_leaks(docs.limit(0), bench).count() == 0 and {len(r["leaks"]) for r in find_leaks(docs, bench.limit(0)).collect()} == {0}
    assert without_leaks(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("kind", ["string", "int", "decimal(5,1)", "date", "boolean"])
def test_item_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([("d", QUESTION)], "doc_id string, text string")
    bench = spark.createDataFrame([(1, QUESTION)], "k int, text string").selectExpr("CAST(CASE WHEN k = 1 THEN %s END AS %s) AS item_id" % ("date'2024-01-01'" if kind == "date" else "true" if kind == "boolean" else "k", kind), "text")
    (row,) = find_leaks(docs, bench).collect()
    assert row["leaks"][0]["item_id"] == bench.first()["item_id"]
