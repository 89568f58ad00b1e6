import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from memspark.llm import queries
from memspark.llm.common import distinct_rows, written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        out = written(stage(spark, kept, sf), f"test-{name}")
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.8 * len(before)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == columns
        else:
            assert after == before
        if name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(b in r.text for r in out.collect() for b in bench)
        kept = out


def test_near_duplicates_of_raw_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.count() - pipeline.near_duplicates(spark, docs, sf).count() >= 70


def test_repeated_rows_and_odd_columns(spark, sf):
    """A row that stands twice leaves once; nulls, empty texts, equal ids and clashing names pass."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, None), (9001, ""), (9002, "one two"), (9002, "three four five"), (9003, None)], "doc_id long, text string")
    odd = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(0 as long) as n_chars")
    extra = {c: F.lit("clash") for c in ("n", "words", "class", "key", "line", "set_hash", "_row_hash2", "part")}
    every = docs.unionByName(docs.where("doc_id < 20")).unionByName(odd).withColumns(extra)
    kept = every
    for name, stage in pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, "/root/testdata/sf0.001"), f"test-{name}")
        assert kept.columns == every.columns
    assert kept.count() == kept.distinct().count() > 100
    assert pipeline.packed(spark, kept, sf).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_distinct_rows(spark):
    rows = [(1, None, {"a": 1}), (1, None, {"a": 1}), (1, "", {"a": 1}), (1, "", {"a": 2}), (None, "x", None), (None, "x", None), (None, "x", None), (2, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `m.x` map<string,int>")
    assert sorted(map(str, distinct_rows(df).collect())) == sorted(map(str, spark.createDataFrame([rows[0], *rows[2:5], rows[7]], df.schema).collect()))
    assert distinct_rows(df.where("false")).count() == 0


def test_registry(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(names)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
