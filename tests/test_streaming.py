from lodeseam.streaming import ingest


def test_ingest(spark, tmp_path):
    folder, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for text in ("FROM x\nRUN y", "FROM z"):
        spark.createDataFrame([("r", f"{text[-1]}/Dockerfile", "Dockerfile", text)], ingest.FILES).write.mode("append").parquet(folder)
        query = ingest.write_chunks(ingest.landing(spark, folder), table, mark)
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.option("basePath", table).parquet(f"{table}/*").collect()
    assert sorted((r.repository_id, r.content) for r in got) == [("r", "FROM x\nRUN y"), ("r", "FROM z")]
