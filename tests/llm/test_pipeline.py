import corpus_pipeline
from spanloom.llm import quality, simhash


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == odd_docs.columns, name
            assert out.count() <= 4 * docs.count()
        slim = stage(spark, odd_docs.select(columns), "/root/testdata/sf0.001")
        assert slim.columns == columns
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, odd_docs, "").count() == odd_docs.count() and stage(spark, no_docs, "").count() == 0


def test_run_on_the_small_table(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = {r.doc_id for r in quality.quality_report(docs).filter("kept").collect()}
    heads = {r.doc_id for r in simhash.near_duplicates(docs.filter(docs.doc_id.isin(list(good)))).filter("doc_id = component_id").collect()}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} <= heads
    assert len({r.doc_id for r in rows}) >= 0.8 * len(heads)
    assert all(r.n_pieces == len(r.piece_ids) for r in rows)
