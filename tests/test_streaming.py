from pyspark.sql import functions as F

from axisframe.streaming.incremental import windowed_reduce


def test_windowed_reduce(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:01:50", 2.0), (2, "2024-01-01 00:02:30", 5.0), (1, "2024-01-01 01:00:00", 9.0)]
    df = spark.createDataFrame(rows, "k long, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windowed_reduce(stream, "t", ["k"], [F.sum("v").alias("total")], "2 minutes", "10 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.start.minute, r.total) for r in spark.table("sums").collect()}
    assert {(1, 0, 3.0), (2, 2, 5.0)} <= got
