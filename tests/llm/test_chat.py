import random
from collections import defaultdict

from risekit.llm import chat


def brute(rows):
    convs = defaultdict(set)
    for c, *turn in rows:
        convs[c].add(tuple(turn))
    key = lambda t: tuple((x is not None, x if x is not None else 0 if k == 0 else "") for k, x in enumerate(t))
    full = {c: tuple(t[1:] for t in sorted(s, key=key)) for c, s in convs.items()}
    keep = []
    for c, f in full.items():
        order = lambda x: (x is None, x or 0)
        if not any((len(g) > len(f) and g[: len(f)] == f) or (g == f and order(d) < order(c)) for d, g in full.items()):
            keep.append(c)
    return {c: full[c] for c in keep}


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    base = [("user" if i % 2 == 0 else "assistant", f"turn {i} {r.random()}") for i in range(200)]
    for c in range(30):
        rows += [(c, i, *base[i]) for i in range(r.choice([1, 2, 3, 5, 8, 8, 70]))]
    rows += [(c, i, "user", f"{c}") for c in range(30, 40) for i in range(3)]
    rows += rows[:20]  # repeated rows
    rows += [(50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, None, "system", None), (None, 0, "user", "x"), (None, 1, None, None)]
    rows += [(60, 0, None, "x"), (61, 0, "x", None), (62, 0, "", "x"), (63, 0, "x", ""), (64, 0, None, "x"), (64, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    want = brute(rows)
    got = defaultdict(list)
    for x in chat.collapse_snapshots(df).collect():
        got[x["conv_id"]].append((x["pos"], x["role"], x["text"]))
    assert {c: tuple(t[1:] for t in sorted(v)) for c, v in got.items()} == want
    parts = defaultdict(list)
    for x in chat.render(chat.collapse_snapshots(df)).collect():
        parts[x["conv_id"]].append((x["part"], x["rendered"]))
    for c, turns in want.items():
        text = "".join(f"<|im_start|>{role or ''}\n{t or ''}<|im_end|>\n" for role, t in turns)
        assert "".join(p for _, p in sorted(parts[c])) == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.collapse_snapshots(df)).count() == 0
