from collections import defaultdict

from risekit.llm.line_dedup import dedup_lines

BLANK = "\t\n\x0b\x0c\r "


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10):
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[low(line.strip(BLANK))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k := low(x.strip(BLANK))) or len(seen[k]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_any_type_of_id(spark):
    rows = [(f"id {i}", f"shared\nown {i}", "x") for i in range(10)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, n_lines string")).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"]) for r in got) == sorted((i, t[7:], 2) for i, t, _ in rows)


def test_against_brute_force(documents):
    rows = [(i, f"Shared Line \nown {i}\n\n shared line\nÉtat\n{'x' * (i % 3)}") for i in range(12)]
    rows += [(100 + i, "nine docs") for i in range(9)] + [(200, "shared line"), (201, ""), (202, None), (203, "\n\n"), (204, "état\n shared line")]
    rows += [(300, "nine docs\n" * 500), (200, "shared line"), (200, "other"), (None, "shared line"), (None, "lone")]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(documents(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_other_columns_stay_and_clashes_are_replaced(documents):
    from pyspark.sql import functions as F

    df = documents([(i, "a\nb") for i in range(10)]).withColumn("N_LINES", F.lit("old"))
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert {(r["text"], r["n_dropped"]) for r in out.collect()} == {("", 2)}


def test_empty_table(documents):
    assert dedup_lines(documents([])).count() == 0


def test_columns_of_any_name_come_through(spark):
    names = ["doc_id", "text", "of", "at", "lost", "__id", "__lost", "__v", "id", "v", "h1"]
    rows = [(i, f"shared\nown {i}", *range(i, i + 9)) for i in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    got = dedup_lines(df)
    assert got.columns == [*names, "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"own {i}", *range(i, i + 9), 2, 1) for i in range(10)]
