import corpus_pipeline as cp


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, df = {r.doc_id: r.text for r in docs.collect()}, docs
    for k, (name, stage) in enumerate(cp.STAGES):
        made = stage(spark, df, sf_dir)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-stage-{k}"
        made.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        rows = df.collect()
        assert rows, name
        if k < 4:
            assert df.columns == docs.columns and all(r.text == before[r.doc_id] for r in rows)
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    assert cp.run(spark, sf_dir).count() == len(rows)


def test_pipeline_on_odd_rows(spark, tmp_path, sf_dir):
    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(good)] + [(0, good[0], "s0"), (100, good[1], "s1"), (None, good[2], None), (None, None, "s0"), (101, None, "s0"), (102, "", "s1"), (103, " ".join([good[3]] * 200), "s2")]
    df = spark.createDataFrame([(i, t, s, 1, "clash", 2.0) for i, t, s in rows], "doc_id long, text string, source string, key int, row string, size double")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = df
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / f"out-{k}"))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / f"out-{k}"))
    near = spark.read.parquet(str(tmp_path / "out-1")).collect()
    assert len({r.text for r in near if r.text in good}) == sum(r.text in good for r in near) and all(r.doc_id is not None for r in near if r.text in good)
    assert cp.run(spark, str(tmp_path)).count() == docs.count()
    empty = df.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
        if "n_tokens" in empty.columns:
            break
