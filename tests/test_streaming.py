from trackclean.streaming.cleaning import cleaned_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [("03 - some_tune [160]", "N"), (None, None), ("va - good tune (Original Mix)", "N")]
    df = spark.createDataFrame(rows, "title string, artist string")
    df.write.parquet(f"{tmp_path}/in")
    stream = cleaned_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table("cleaned").collect()))
    assert got == sorted(map(str, cleaned_stream(df).collect()))
    assert {r.clean_title for r in spark.table("cleaned").collect()} == {"Some Tune", "", "Good Tune"}
