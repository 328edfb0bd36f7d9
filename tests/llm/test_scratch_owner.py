from gaugeflow.llm import ngram_join
from gaugeflow.llm._scratch import Owner, Scratch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_live_results_survive_a_pipeline_run(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    live = ngram_join.ngram_components(docs, width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
    first = corpus_pipeline.run(spark, sf_dir)
    before = rows(live)
    second = corpus_pipeline.run(spark, sf_dir)
    assert len(before) == docs.count() and rows(live) == before
    assert rows(first.select("doc_id", "shard", "size")) == rows(second.select("doc_id", "shard", "size"))


def test_an_owner_deletes_its_own_tables_only(spark):
    outside = Scratch(spark, "test").table(spark.range(3))
    with Owner(spark) as outer:
        mine = Scratch(spark, "test").table(spark.range(4))
        with Owner(spark) as inner:
            inner_roots = Scratch(spark, "test").table(spark.range(5))._scratch_path
        inner.release()
        assert mine.count() == 4
    late = Scratch(spark, "test").table(spark.range(6))
    exists = lambda at: spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(at))
    assert exists(mine._scratch_path) and not exists(inner_roots)
    outer.release()
    assert not exists(mine._scratch_path) and outside.count() == 3 and late.count() == 6
