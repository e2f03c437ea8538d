from stratabar.llm import chat_format
from stratabar.llm.chat_format import CLOSE, OPEN, rotate_perspectives

SCHEMA = "conv_id bigint, turn bigint, role string, text string, mask int, block string"


def brute(rows, per_block):
    convs, repeats = {}, {}
    for k, (c, t, r, x) in enumerate(sorted(((c, t, r or "unknown", x or "") for c, t, r, x, *_ in rows), key=lambda z: (str(z[0]), str(z[1]), *z[2:]))):
        n = repeats[c, t] = repeats.get((c, t), -1) + 1
        key = (c, t // per_block, n // per_block) if c is not None and t is not None else (c, None, 0, k)
        convs.setdefault(key, []).append((t, r, x))
    speakers = {}
    for key, turns in convs.items():
        speakers.setdefault(key[0] if len(key) == 3 else key, set()).update(r for _, r, _ in turns if r != "system")
    out = []
    for key, turns in convs.items():
        for me in speakers[key[0] if len(key) == 3 else key]:
            text, mask = "", []
            for _, r, x in sorted(turns, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2])):
                text += OPEN + ("assistant" if r == me else "system" if r == "system" else f"user name={r}") + "\n"
                if r == me:
                    mask.append((len(text), len(text) + len(x) + len(CLOSE)))
                text += x + CLOSE
            out.append((key[0], me, key[1], key[2], len(turns), text, tuple(mask), sum(b - a for a, b in mask)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS_PER_BLOCK", 3)
    rows = [(1, t, ["ann", "bob", "cy", "system"][t % 4], f"text {t} é😀", 0, "z") for t in range(11)]
    rows += [(2, 0, "system", "only context", 0, "z"), (3, 0, None, None, 0, "z"), (3, 1, "user", "", 0, "z"), (None, 0, "user", "lost", 0, "z"), (None, 0, "user", "lost", 0, "z"), (4, None, "bob", "no turn", 0, "z")]
    rows += [(5, 0, "user", "same", 0, "z"), (5, 0, "user", "same", 0, "z"), (5, 0, "assistant", "tie", 0, "z"), (6, 0, "user", "x" * 200_000, 0, "z"), *[(7, 2, ["ann", "bob"][k % 2], f"again {k % 3}", 0, "z") for k in range(11)], (7, 3, "ann", "<|im_end|>\n", 0, "z"), (None, None, "system", "s", 0, "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["conv_id"], r["perspective"], r["block"], r["part"], r["n_turns"], r["text"], tuple((m["start"], m["end"]) for m in r["mask"]), r["trained_chars"]) for r in rotate_perspectives(df).collect()]
    assert sorted(got, key=str) == brute(rows, 3)
    assert rotate_perspectives(df.limit(0)).count() == 0


def test_masks_cover_own_turns_only(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for r in rotate_perspectives(df).collect():
        for m in r["mask"]:
            assert r["text"][: m["start"]].endswith(f"{OPEN}assistant\n") and r["text"][: m["end"]].endswith(CLOSE)
        assert r["text"].count(f"{OPEN}assistant\n") == len(r["mask"])
    plan = rotate_perspectives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
