"""Streaming operators on file streams."""

from tideline.streaming.online import online_cusum


def test_cusum_state_is_carried(spark, tmp_path):
    for k, values in enumerate(([0.0, 0.0, 3.0], [3.0, 3.0])):
        rows = [("a", 3 * k + i, v) for i, v in enumerate(values)]
        spark.createDataFrame(rows, "series_id string, t int, x double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t int, x double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    model = spark.createDataFrame([("a", 0.0, 1.0), ("b", 9.0, 2.0)], "series_id string, mean double, std double")
    q = online_cusum(stream, model).writeStream.format("memory").queryName("cusum_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("cusum_out").orderBy("t").collect()
    assert [r.up for r in rows] == [0.0, 0.0, 2.5, 5.0, 7.5]
    assert [r.alert for r in rows] == [False, False, False, False, True]


def test_cusum_takes_a_batch_in_order(spark, tmp_path):
    values = [float(i * 7 % 5) for i in range(3000)]
    rows = [(k, i, v) for k in "ab" for i, v in enumerate(values)][::-1]
    spark.createDataFrame(rows, "series_id string, t int, x double").repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t int, x double").json(str(tmp_path / "in"))
    model = spark.createDataFrame([("a", 2.0, 1.0), ("b", 1.0, 2.0)], "series_id string, mean double, std double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        q = online_cusum(stream, model).writeStream.format("memory").queryName("cusum_order").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, mean, std in (("a", 2.0, 1.0), ("b", 1.0, 2.0)):
        up = down = 0.0
        want = []
        for i, x in enumerate(values):
            if i:
                up, down = max(0.0, up + x - mean - 0.5 * std), max(0.0, down - x + mean - 0.5 * std)
            want.append((up, down))
        got = spark.table("cusum_order").where(f"series_id = '{key}'").orderBy("t").collect()
        assert [(r.up, r.down) for r in got] == want
