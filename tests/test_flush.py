import pandas as pd
from pyspark.sql import functions as F

from tessera.streaming import flush


def test_capacity_and_age(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 4), (2, 100, 5), (2, 101, 6)]
    events = spark.createDataFrame(rows, "k long, t long, i long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.i: (r.flush_id, r.trigger) for r in flush.by_capacity_or_age(events, "k", "ts", "i", 2, 60.0).collect()}
    assert got == {1: (0, "hold"), 2: (0, "flush"), 3: (1, "manual"), 4: (0, "hold"), 5: (0, "flush"), 6: (1, "manual")}


def test_serial_done(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 20)], "k long, f long, a long")
    assert [r.done for r in flush.serial_done(rows, "k", "a", "f").orderBy("f").collect()] == [11, 12, 21]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, float(t), k * 100 + n) for k in range(3) for n, t in enumerate([0, 10, 20, 200, 201, 202, 203])]
    spark.createDataFrame(rows, "key long, ts_s double, ident long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts_s double, ident long").parquet(str(tmp_path / "in"))
    q = flush.append_batches(flush.streaming_flush(stream, 3, 60.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out") + "/batch=*").toPandas()
    events = spark.createDataFrame(rows, "key long, ts_s double, ident long").withColumn("ts", F.timestamp_seconds("ts_s"))
    want = flush.by_capacity_or_age(events, "key", "ts", "ident", 3, 60.0).where("trigger <> 'manual'").toPandas()
    key = lambda d: sorted(map(tuple, d[["key", "ident", "flush_id"]].astype(int).values))
    assert key(got) == key(pd.DataFrame(want)) and len(got)
