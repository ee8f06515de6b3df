import corpus_pipeline
from pyspark.sql import functions as F

from voltweave.llm import pieces

from .data import DOCS, ODD, corpus
from .test_text import TEXTS, base


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows, _ = corpus(120)
    copy = (500, rows[0][1], rows[0][2], "s", rows[0][4])
    leak = (501, rows[1][1] + " one two three four five six seven eight nine ten", rows[1][2], "s", 0)
    private = (502, rows[2][1][::-1] + " a.b@c.de 4111 1111 1111 1111", rows[2][2], "s", 0)
    docs = spark.createDataFrame([*rows, copy, leak, private, *ODD], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, TEXTS[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(at)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    clean = {i for i, *_ in rows}
    assert ids[0] >= clean | {500, 501, 502, 1007, None} and not ids[0] & {1001, 1002, 1003, 1004}
    assert 500 not in ids[1] and ids[1] >= clean and seen[1].where("doc_id = 1007").count() == 1
    assert 501 not in ids[2] and ids[2] >= clean | {502}
    text = {r.doc_id: r for r in seen[3].collect()}
    assert "<EMAIL>" in text[502].text and "<CARD>" in text[502].text and text[502].n_chars == len(text[502].text)
    assert all(not base(r.text) for r in text.values())
    codec = pieces.Codec(pieces.load())
    assert {r.doc_id: codec.decode(r.ids) for r in seen[4].collect()} == {i: r.text for i, r in text.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_registered_names():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in e.queries()} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_stage_input_without_rows(spark, tmp_path):
    spark.createDataFrame([(1, TEXTS[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
