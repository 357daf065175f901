from linkpeak.streaming.demand import windowed_demand

SCHEMA = "ts timestamp, src int, prefix long, demand double"


def test_windows_close_behind_the_watermark(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "ts string, src int, prefix long, demand double").selectExpr("to_timestamp(ts) AS ts", "src", "prefix", "demand").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put("a", [("2024-01-01 00:10:00", 0, 1, 2.0), ("2024-01-01 00:50:00", 0, 1, 3.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = windowed_demand(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        put("b", [("2024-01-01 02:30:00", 0, 1, 5.0)])
        query.processAllAvailable()
        rows = spark.table("windows").collect()
    finally:
        query.stop()
    assert [(r["src"], r["prefix"], r["demand"]) for r in rows] == [(0, 1, 5.0)]
