"""Toxicity, quality and language: fitted on made and given tables, scored against plain versions."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from stratabar.llm import lang_id, quality, toxicity
from stratabar.llm.common import held_out, table
from stratabar.llm.samples import labelled_sample

SF = "/root/testdata/sf0.1"
EDGE = [(1, None), (2, ""), (3, "   \n"), (None, "You idiot"), (4, "same"), (4, "same"), (5, "word " * 60_000), (6, "!!! ... 123"), (7, "日本語 текст عربى")]


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def edge(spark):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in EDGE], "doc_id bigint, text string, score string, probability double")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def test_fold(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}
    assert spark.sql("SELECT CAST(NULL AS bigint) AS id").select(held_out("id")).first()[0] is False


def test_sample_is_bounded_and_keeps_the_fold(spark, tables):
    docs, labels = tables
    rows = labelled_sample(docs, labels, "toxic", 50).collect()
    assert len({r["id"] for r in rows}) == len(rows) and max(Counter(r["y"] for r in rows).values()) <= 50
    assert all(zlib.crc32(str(r["id"]).encode()) % 3 != 1 for r in rows)
    a, b, c = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    both = spark.createDataFrame([(a, 0, 0), (a, 1, 0), (None, 1, 1), (b, None, 1), (b, 1, 1), (c, 5, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(a, "a b"), (b, "c d"), (b, "e f"), (c, "g h")], "doc_id bigint, text string")
    assert [(r["id"], r["text"]) for r in labelled_sample(docs, both, "quality", 10).collect()] == [(b, "c d")]


# ---- toxicity


def test_folding_of_letters():
    f = toxicity.fold_text
    assert f("ÉCLAIR Straße") == "eclair strase" and f("1d10t st\u0443pid m0r0n") == "idiot stypid moron" and f("$tupid tr@sh!!") == "stupid trash!!"
    assert f("idі\u043ft") != "" and f("ｉｄｉｏｔ") == "idiot" and f("a b2 300 $$$ 50%") == "a b2 300 $$$ 50%"
    assert f("idio7 asshol3 1oser room 101 mp3") == "idiot asshole ioser room 101 mp3" and f("1oser", "l") == "loser"


def brute_hits(lexicon, text):
    readings = [toxicity.fold_text(text), toxicity.fold_text(text, "l")]
    void = [(m.start(), m.end()) for t in readings for e in lexicon.exceptions for m in re.finditer(r"(?<![^\W\d_])" + re.escape(toxicity.fold_text(e)) + r"(?![^\W\d_])", t)]
    out = {}
    for t in readings:
        for kind, entries in (("w", lexicon.words), ("s", lexicon.stems)):
            for e, w in entries.items():
                for m in re.finditer(r"(?<![^\W\d_])" + re.escape(e) + (r"(?![^\W\d_])" if kind == "w" else ""), t):
                    if not any(a <= m.start() < b for a, b in void) and w > out.get(m.start(), ("", 0))[1]:
                        out[m.start()] = (e, w)
    return [(k, *out[k]) for k in sorted(out)]


def test_hits_against_brute_force(tables):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0, "scum": 3.0, "loser": 2.5}, {"mor": 2.0, "lowe": 6.0}, ("trash can", "idiot proof"))
    texts = ["You idiot, 1D10T! idiots. idiot", "trash can trash trashy", "1diot 1oser scum1 trasn tr4sh can", "moron mor amor loweß", "", "scum_scum scum-scum", "SCUM" * 3, "idiot proof idiot-proof"]
    for t in texts + [r["text"] for r in tables[0].limit(200).collect()]:
        assert lexicon.hits(t) == brute_hits(lexicon, t), t
    assert toxicity.Lexicon({}, {}).hits("idiot") == []


def test_exceptions_are_learned_and_cost_no_more_than_their_length(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abdefghklmnprstuvz"), 6))
    noise = [(" ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))) for _ in range(200)]
    texts = [f"{a} trash, go {b}" if k % 2 else f"{a} trash can {b}" if k % 20 == 0 else f"{a} {b} can go" for k, (a, b) in enumerate(noise)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, toxic int")
    lexicon = toxicity.fit_toxicity(docs, labels)
    assert "trash" in lexicon.words or any("trash".startswith(x) for x in lexicon.stems)
    assert "trash can" in lexicon.exceptions
    assert lexicon.hits("the trash can") == [] and lexicon.hits("you trash, can") != []
    started = time.process_time()
    assert lexicon.hits("trash can trash " * 40_000)
    assert time.process_time() - started < 5


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    lexicon = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, lexicon).join(labels, "doc_id").filter(held_out("doc_id") & labels["toxic"].isNotNull()).collect()
    hit = Counter((r["toxic"], r["score"] >= toxicity.THRESHOLD) for r in got)
    assert hit[1, True] / (hit[1, True] + hit[1, False]) > 0.8 and hit[0, True] / (hit[0, True] + hit[0, False]) < 0.01
    edges = toxicity.score_toxicity(edge(spark), lexicon).collect()
    assert len(edges) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edges)
    assert len({r["score"] for r in edges if r["doc_id"] in (1, 2, 3)}) == 1
    assert next(r for r in edges if r["doc_id"] is None)["terms"] == ["idiot"]
    assert toxicity.score_toxicity(edge(spark).limit(0), lexicon).count() == 0


def test_models_don_t_see_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    from pyspark.sql import functions as F

    turned = labels.withColumns({c: F.when(held_out("doc_id"), 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    assert toxicity.fit_toxicity(docs, labels) == toxicity.fit_toxicity(docs, turned)
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_models_without_labels(spark):
    none = no_labels(spark)
    assert all(r["score"] < 0.7 for r in toxicity.score_toxicity(edge(spark), toxicity.fit_toxicity(edge(spark), none)).collect())
    rows = quality.with_verdict(quality.score_quality(edge(spark), quality.fit_quality(edge(spark), none))).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


# ---- quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_against_brute_force(spark, tables):
    docs = tables[0].limit(1500).unionByName(edge(spark).select("doc_id", "text"), allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame([(90, "a b c d e a b c d e"), (91, "x\u00a0y \x1c z\n\nx\u00a0y \x1c z\n"), (92, "a " * 30), (93, "# $ <b> | &\n# $ <b> | &")], "doc_id bigint, text string"), allowMissingColumns=True)
    model = quality.QualityModel(np.zeros(1 << quality.BITS))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.score_quality(docs, model, carry=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[n] for n in names) == brute_measures(r["row"]["text"]), r["doc_id"]


def test_linear_score_is_the_sum_of_its_features():
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS)
    text = "Ein Wört, ein wort |x| été! Ein Wört"
    words = text.encode().split()
    total = 0.0
    for w in words:
        _, slots = quality.char_features([w])
        total += weights[slots].sum() + weights[quality._slot(quality.word_hashes([w]))[0]]
        grams = [f" {w.decode()} "[i : i + n] for n in quality.CHAR_GRAMS for i in range(len(w.decode()) + 3 - n)]
        assert len(slots) == sum(g != " " for g in grams)
    h = quality.word_hashes(words)
    total += weights[quality.pair_slots(h)].sum()
    (row,) = quality._measures([text], quality.WordTable(weights))
    assert row[5] == pytest.approx(total)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels, per_class=600)
    rows = quality.with_verdict(quality.score_quality(docs, model)).join(labels, "doc_id").filter(held_out("doc_id") & labels["quality"].isNotNull()).filter("NOT base_failed").collect()
    hit = Counter((r["quality"], r["kept"]) for r in rows)
    assert hit[1, True] / (hit[1, True] + hit[1, False]) > 0.99 and hit[0, False] / (hit[0, True] + hit[0, False]) > 0.9
    # calibration: of rows scored around p, about p are good
    p, y = np.array([r["probability"] for r in rows]), np.array([r["quality"] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.05


# ---- language


def naive_bundle(text):
    v = lang_id.letter_vectors()[0].astype(float)
    s = [0, *(int(lang_id.symbol_table()[ord(c)]) for c in text.lower()), 0]
    s = [x for k, x in enumerate(s) if k == 0 or x or s[k - 1]]
    out = np.zeros(lang_id.DIMENSIONS)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    n = np.linalg.norm(out)
    return out / n if n else out


def test_bundles_against_brute_force():
    texts = ["", "a", "12 ..", "The cat sat, on the mat.", "Éé ñ 日本語", "abc" * 50, "thwhst ning " * 300]
    assert np.allclose(lang_id.bundles(texts), [naive_bundle(t) for t in texts], atol=1e-5)


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    profiles = lang_id.learn_profiles(docs)
    rows = lang_id.identify(docs, profiles, carry=True).filter(held_out("doc_id")).collect()
    assert sum(r["row"]["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    edges = {r["doc_id"]: r for r in lang_id.identify(edge(spark), profiles).collect()}
    assert all((edges[k]["lang_pred"], edges[k]["score"]) == ("und", 0.0) for k in (1, 2, 3, 6)) and edges[7]["lang_pred"] in profiles.languages
    assert lang_id.identify(edge(spark).limit(0), profiles).count() == 0
    none = lang_id.learn_profiles(spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in lang_id.identify(edge(spark), none).collect()} == {"und"}


def test_profiles_don_t_see_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    from pyspark.sql import functions as F

    a = lang_id.learn_profiles(docs)
    b = lang_id.learn_profiles(docs.withColumns({"lang": F.when(held_out("doc_id"), "xx").otherwise(F.col("lang")), "source": F.lit("other")}))
    assert a.languages == b.languages and np.array_equal(a.vectors, b.vectors)
    assert math.isclose(float(np.linalg.norm(a.vectors[0])), 1.0, rel_tol=1e-5)


def test_every_language_gets_a_profile(spark, monkeypatch):
    rows = [(i, f"text {chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 3}", f"l{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert set(lang_id.learn_profiles(docs).languages) == learned
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 10)
    with pytest.raises(ValueError):
        lang_id.learn_profiles(docs)


def test_fit_is_bounded_in_bytes(spark, tables):
    docs, labels = tables
    whole = quality.fit_quality(docs, labels, per_class=60)
    cut = quality.fit_quality(docs, labels, per_class=60, most_bytes=400_000)
    assert (whole.weights != 0).sum() > (cut.weights != 0).sum() > 0


# ---- columns of clashing names


def test_columns_of_any_name_are_left_alone(spark, tables):
    names = ["score", "terms", "row", "n_words", "probability", "kept", "base_failed", "lang_pred", "id", "y", "c0", "a.b", "t1"]
    docs = tables[0].limit(50)
    odd = docs.select("doc_id", "text", *[docs.source.alias(n) for n in names])
    lexicon, model = toxicity.Lexicon({"idiot": 5.0}, {}), quality.QualityModel(np.zeros(1 << quality.BITS))
    profiles = lang_id.learn_profiles(tables[0].limit(200))
    want = sorted(map(tuple, odd.collect()), key=str)
    for scored in (toxicity.score_toxicity(odd, lexicon, carry=True), quality.with_verdict(quality.score_quality(odd, model, carry=True)), lang_id.identify(odd, profiles, carry=True)):
        back = scored.select("row.*")
        assert back.columns == odd.columns and sorted(map(tuple, back.collect()), key=str) == want
