"""Streams over several micro-batches: late rows, repeats across batches, and a batch that is retried."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cairnflow.streaming import log

SCHEMA = "id long, ts timestamp, query string, poi string"
T0 = datetime(2024, 1, 1, 0, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


BATCHES = [
    [(1, at(5), "a", "x"), (2, at(50), "a", "y"), (3, at(70), "b", "x")],
    [(2, at(50), "a", "y"), (4, at(55), "a", "x"), (5, at(200), "b", "y")],  # a repeat, a row that is late but within the watermark
    [(7, at(400), "c", "z")],
    [(6, at(10), "a", "x")],  # a row later than the watermark of the batch before last allows
]


def batches(spark, folder):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(folder)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    stream = batches(spark, f"{tmp_path}/in")
    q = log.windowed_popularity(stream, "ts", "query").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r["query"]): r.n for r in spark.table("closed").collect()}
    # the row of minute 10 came after its window had closed; repeats are rows here
    assert got == {(at(0), "a"): 4, (at(60), "b"): 1, (at(180), "b"): 1}


def test_repeats_across_batches_go_once(spark, tmp_path):
    stream = batches(spark, f"{tmp_path}/in")
    q = log.deduplicated(stream, "ts", "id").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", f"{tmp_path}/d").start()
    q.processAllAvailable()
    q.stop()
    ids = sorted(r.id for r in spark.table("once").collect())
    assert ids == [1, 2, 3, 4, 5, 7]


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    write = log.append_pairs(f"{tmp_path}/out")
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in BATCHES]
    for number in (0, 1, 1, 2, 3):
        write(frames[number], number)
    back = spark.read.parquet(f"{tmp_path}/out").groupBy("query", "poi").agg(F.sum("n").alias("n"))
    want = {}
    for rows in BATCHES:
        for _, _, q, p in rows:
            want[q, p] = want.get((q, p), 0) + 1
    assert {(r["query"], r.poi): r.n for r in back.collect()} == want
