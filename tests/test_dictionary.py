from termloom.sources import dictionary


def test_concepts_begin_at_every_word(spark, tmp_path):
    text = " ".join(f"q{c}x" for c in "abcdefghijklmnop") + " zeta kappa, omega."
    spark.createDataFrame([(4, text), (9, "omega")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = dictionary.concepts(spark, str(tmp_path)).collect()
    got = {(r.firstword, r.tailwords, r.objectid) for r in rows}
    assert {("zeta", "kappa", 4), ("kappa", "", 4), ("qpx", "zeta kappa", 4), ("omega", "", 4)} <= got
    assert not any(f == "kappa" and t for f, t, _ in got)
    assert len({(f, t) for f, t, _ in got}) == 19 + 17 + 16
