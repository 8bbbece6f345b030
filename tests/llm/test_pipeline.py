import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if i < 3:
            assert all(before[k] == t for k, t in after.items())
        if i == 1:
            assert len(set(after.values())) == len(after)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated ids with the same and other texts, clashing columns: no text is lost, and only its copies go."""
    import random

    r = random.Random(3)
    fresh = lambda n=70: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    a, b, c, passage = fresh(), fresh(), fresh(), fresh(60)
    rows = [(1, a), (2, a), (5, b), (5, c), (5, c), (None, a), (None, fresh()), (None, fresh()), (6, None), (7, ""), (7, " \n"), (8, c[:-12] + " end."), (9, fresh() + " " + passage), (9, fresh() + " " + passage), (10, "word " * 4000)]
    rows = [(i, t, "en", None, None if t is None else len(t), 1.5, [1]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id double, spans array<int>")
    left = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, left, "").cache()
        assert left.columns == docs.columns
        if name == "exact dedup":
            assert left.count() == 11
        if name == "n-gram Jaccard join":
            kept = {x.text for x in left.collect()}
            assert a in kept and b in kept and len({c, c[:-12] + " end."} & kept) == 1
    out = left.collect()
    assert sum(passage in (x.text or "") for x in out) == 1 and all(x.n_chars == len(x.text) for x in out if x.text)
    assert corpus_pipeline.STAGES[-1][1](spark, left, "").select("doc_id").count() >= len(out)
    for many, folder in ((docs, "odd"), (docs.limit(0), "empty")):
        many.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (10, 0, None), (77, None, 0)], "doc_id long, quality int, toxic int")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect()
        assert bool(got) == (folder == "odd")
