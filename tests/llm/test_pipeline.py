import corpus_pipeline

from .helpers import edge, empty, label_table


def test_stages_on_edges(spark, tmp_path, monkeypatch):
    label_table(spark, [(1, 1, 0), (7, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge(spark), empty(spark)):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), f"test-{name}")
            if name != "packing":
                assert docs.columns == columns
        assert (docs.count() > 0) == (n > 0)


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
