"""The stages of the pipeline, each on what its predecessor kept, against plain versions of what they promise."""

import random

import pytest

pytest.importorskip("panelspan.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        text = prose(rng, 50) + "\n" + prose(rng, 50)
        if i % 5 == 4:
            text = "### ".join(text.split(" "))
        rows.append([i, text, "en" if i % 3 else "fr", f"src{i % 4}", len(text)])
    rows[101][1] = rows[50][1]                                                     # a copy
    first = rows[51][1].split(" ")
    rows[102][1] = " ".join([*first[:10], "changed", *first[11:]])              # a near copy
    rows[103][1] = rows[52][1].split("\n")[0] + "\n" + rows[52][1].split("\n")[1] + "\n" + rows[103][1]   # a repeated run
    rows += [[200, None, None, None, None], [201, "", "en", "src1", 0], [None, prose(rng, 60), "fr", "src2", 5], list(rows[60])]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' as keep", "doc_id as id", "1 as _rest2")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 4), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing to target weights", "packing"]
    out = {}
    for n, f in list(stage.items())[:-1]:
        kept = f(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{len(out)}")
        kept = spark.read.parquet(f"{tmp_path}/{len(out)}")
        assert kept.columns == docs.columns
        out[n] = [r.asDict() for r in kept.collect()]
    good = {r["doc_id"] for r in out["quality classifier"]}
    assert {i for i in range(200) if i % 5 != 4} <= good and not {i for i in range(200) if i % 5 == 4} & good
    lines = {r["doc_id"]: r for r in out["line dedup"]}
    assert good - set(lines) <= {101} and lines[103]["text"] == rows[103][1].split("\n", 2)[2] and lines[103]["n_chars"] == len(lines[103]["text"])
    one = {r["doc_id"] for r in out["SimHash near-dedup"]}
    assert set(lines) - one <= {102, 201} and 102 not in one and {50, 51, 52, 103} <= one
    assert sum(r["doc_id"] == 60 for r in out["SimHash near-dedup"]) == 2
    mixed = out["mixing to target weights"]
    assert {r["doc_id"] for r in mixed} == one and len(mixed) > len(out["SimHash near-dedup"])
    pieces = stage["packing"](spark, kept, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == len(mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(pieces) and whole.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    empty = docs.limit(0)
    for n, f in list(stage.items())[:-1]:
        empty = f(spark, empty, str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0


def test_line_stage_removes_a_long_line_that_repeats(spark):
    rng = random.Random(3)
    passage, short = prose(rng, 60), prose(rng, 40)
    rows = [(0, passage), (1, f"{prose(rng, 60)}\n{passage}"), (2, passage), (3, short), (4, short)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r for r in corpus_pipeline.clear_lines(spark, docs, "").collect()}
    assert set(kept) == {0, 1, 3, 4} and kept[1].text == rows[1][1].split("\n")[0] and kept[1].n_chars == len(kept[1].text)
