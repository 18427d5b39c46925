from lodestone.operators.index import postings
from lodestone.streaming.refresh import read_postings, start_refresh


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source, out, at = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/at"
    schema = "doc_id long, text string"
    assert read_postings(spark, out).count() == 0
    for n, rows in enumerate([[(1, "alpha beta alpha"), (2, None)], [(3, "beta")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        start_refresh(spark.readStream.schema(schema).parquet(str(source)), out, at, once=True).awaitTermination()
        start_refresh(spark.readStream.schema(schema).parquet(str(source)), out, at, once=True).awaitTermination()
        want = postings(spark.read.schema(schema).parquet(str(source)), "doc_id", "text")
        got = read_postings(spark, out).select("term", "doc_id", "w")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), n
