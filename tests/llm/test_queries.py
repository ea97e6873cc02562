import corpus_pipeline
from tesserae.llm import queries


def test_ten_queries():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_queries_give_a_row_for_each_input_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in queries.queries().items():
        got = query(spark, sf_dir)
        if name[:4] not in ("op2_", "op4_", "op6_"):
            assert got.count() == n, name


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
