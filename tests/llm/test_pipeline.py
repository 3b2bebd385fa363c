import corpus_pipeline


def test_stages_in_order(spark):
    sf_dir = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "ngram_jaccard", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert name == "sentencepiece" or docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
    assert docs.where("NOT round_trip").count() == 0


def test_nulls_repeated_ids_clashing_names_and_nothing(spark, tmp_path):
    """Clean, long enough texts with odd rows beside them, stage by stage."""
    import shutil

    from pyspark.sql import functions as F

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    good = corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, source), source).limit(6).collect()
    texts = [r.text for r in good]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, None), (3, None), (4, ""), (None, texts[3]), (7, texts[4] + " and more")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long"), "score": F.lit("mine"), "_m": F.lit(1), "_text_key": F.lit(2), "_text": F.lit(3)})
    for name in ("empty", "odd"):
        folder = tmp_path / name
        folder.mkdir()
        for table in ("labels", "benchmark"):
            shutil.copy(f"{source}/{table}.parquet", folder / f"{table}.parquet")
        (odd if name == "odd" else odd.limit(0)).unionByName(docs, allowMissingColumns=True).where("score IS NOT NULL").write.parquet(str(folder / "documents.parquet"))
        kept = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, source)
            assert kept.columns == odd.columns, stage
        last = corpus_pipeline.STAGES[-1][1](spark, kept, source).collect()
        if name == "empty":
            assert not last
        else:
            found = sorted((r.doc_id or 0, r.text) for r in kept.collect())
            assert found == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (0, texts[3]), (7, texts[4] + " and more")]) and len(last) == len(found)


def test_folders_of_earlier_stages_are_removed(spark):
    import os

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    folder = os.path.dirname(os.path.dirname(rows.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    assert os.listdir(folder) == ["sentencepiece"]
