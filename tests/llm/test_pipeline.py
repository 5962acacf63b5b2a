"""The pipeline's stages, each on what its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F

from risekit.llm import bpe
from risekit.llm.common import new_path, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
        assert df.schema == stages[0].schema


def test_rows_only_go_where_a_stage_decides(stages):
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in stages]
    assert ids[1] < ids[0] and ids[2] == ids[1] and ids[3] < ids[2] and ids[4] == ids[3] and ids[5] == ids[4]
    assert len(ids[1]) > 0.8 * len(ids[0]) and len(ids[3]) > 0.7 * len(ids[2])


def test_no_near_duplicates_are_left(spark, stages):
    from tests.llm.test_jaccard import brute

    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    leaders = {d for d, _, c in brute(before, 5, 80) if d == c}
    assert {r["doc_id"] for r in stages[3].collect()} == leaders


def test_one_row_of_each_group_stays(spark, documents):
    one, other, alone = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one), (1, one + " end"), (2, one), (1, other), (3, other + " end"), (7, alone), (7, alone)]
    rows += [(None, " "), (None, None), (None, one), (4, "")] + [(None, "n " * 3 + alone[:90]), (None, "N " * 3 + alone[:90])]
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates_stage(spark, documents(rows), SF).collect()), key=str)
    assert len(kept) == 7
    assert [sum(c in (t or "") for _, t in kept) for c in ("x0", "y0", "z59")] == [1, 1, 1]
    assert all(d == 1 for d, t in kept if t and ("x0" in t or "y0" in t))
    assert [(None, " ") in kept, (None, None) in kept, (4, "") in kept, (7, alone) in kept] == [True] * 4


def test_no_benchmark_passage_is_left(spark, stages):
    from risekit.llm import decontaminate as d

    left = d.contaminated(stages[4], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert d.contaminated(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(spans) > 0").count() > 0
    assert left.where("size(spans) > 0").count() == 0


def test_lengths_follow_texts(stages):
    for df in stages[1:5]:
        assert df.where("n_chars <> char_length(text)").count() == 0


def test_ids_decode(spark, stages):
    path = bpe.vocabulary_path()
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    t = bpe.WordBpe(path)
    for r in stages[5].collect():
        assert r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) and bytes(r["ids"]) == t.encode_batch([texts[r["doc_id"]]])[0]
        assert r["decoded"] == t.decode(bytes(r["ids"]))


CLASHES = ["document", "_", "kept", "hash", "repeated", "n_lines", "n_dropped", "score", "predicted", "spans", "items", "n_words", "class", "text_hash", "sid", "key", "id", "pos", "with.dot"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_nulls_repeats_and_clashing_columns(spark, documents, empty):
    passage = " ".join(f"b{i}" for i in range(30))
    rows = [(1, None), (1, None), (None, None), (2, ""), (None, "some words of a text"), (3, "own words " * 20), (3, "own words " * 20), (4, "common line\n" + passage)]
    rows += [(10 + i, f"common line\ntext {i} of its own") for i in range(12)] + [(40, "word " * 30_000)]
    docs = documents([] if empty else rows)
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"own {i}"))
    folder = new_path(spark, "test-tables")
    spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, passage), (None, ""), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, folder), "test-stage")
        if name != "BPE":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            for r in out.collect():
                assert [r[c] for c in CLASHES] == [f"own {i}" for i in range(len(CLASHES))]
        elif not empty:
            assert out.count() == docs.count() > 10
        docs = out if name != "BPE" else docs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts == {} if empty else (texts[4] == "" and all("common line" not in (t or "") for t in texts.values()) and {1, 2, 3, 4, 40, None} <= set(texts))


def test_run(spark, stages):
    got = sorted(map(str, cp.run(spark, SF).collect()))
    assert got == sorted(map(str, stages[5].collect()))
