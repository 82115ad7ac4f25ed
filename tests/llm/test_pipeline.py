import pytest


def test_stages_on_a_small_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, source).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] >= kept[3] > 0
    lengths = {}
    for r in pipeline.STAGES[-1][1](spark, docs, source).collect():
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 4096
    assert pipeline.run(spark, source).count() == pipeline.STAGES[-1][1](spark, docs, source).count()


def test_exact_stage_equals_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    top = {}
    for r in docs.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        top[key] = max(top.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in pipeline.exact_dedup(spark, docs, "").collect()} == set(top.values())


def test_stages_and_run_on_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_ties_repeats_and_clashing_names_through_the_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    letters = "the quick brown fox jumps over the lazy dog near a river bank today"
    rows = [
        (1, letters, "en", "s", 1, "x"), (1, letters, "en", "s", 1, "x"), (2, letters.upper(), "en", None, 2, None), (None, letters + " again", None, "s", 3, "y"),
        (3, None, "en", "s", None, "z"), (4, "", "en", None, 0, "z"), (5, "12 34", None, "t", 5, "z"), (6, "word " * 30_000, "en", "t", 6, "w"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark int, own_1 string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:3]:
        held = stage(spark, held, "")
        assert held.columns == docs.columns
        kept.append(sorted((r.doc_id for r in held.collect()), key=str))
    assert kept == [[1, 1, 2, 6, None], [2, 6, None], [2, 6]]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {2, 6} and out
