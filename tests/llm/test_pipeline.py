import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from termloom.llm._io import cut

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, sf))
        assert out.columns[:5] == COLUMNS and (len(out.columns) == 5) == (k < len(corpus_pipeline.STAGES) - 1)
        rows = out.collect()
        assert rows and all(first[r.doc_id] == r.text for r in rows)
        if name == "decontamination":
            assert not any(b in r.text for r in rows for b in bench)
        docs = out.select(*COLUMNS)
