"""Quotas of a stream over several batches against those of the table."""

import random
from datetime import datetime, timedelta

from plumbline.streaming.quota import stream_quota

SCHEMA = "post_id long, user_id long, created_at timestamp, text string"


def test_quota_over_batches_with_late_rows(spark, tmp_path):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    batches, all_rows, n = [], [], 0
    for b in range(5):
        rows = []
        for _ in range(60):
            at = start + timedelta(minutes=10 * b) + timedelta(seconds=r.randrange(600))
            if b and r.random() < 0.3:  # up to eight minutes before the batch: late, but within the watermark
                at = start + timedelta(minutes=10 * b) - timedelta(seconds=r.randrange(480))
            rows.append((n, r.choice([0, 0, 0, 1, 2, 3]), at, f"t{n}"))
            n += 1
        batches.append(rows)
        all_rows += rows
    end = [(9000 + k, 99, start + timedelta(days=2 + k), "end") for k in range(2)]  # moves the watermark past all others
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in [*batches, end[:1], end[1:]]:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = stream_quota(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "user_id", "created_at", ["post_id"], 7, "20 minutes")
            q = stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(x.post_id for x in spark.read.schema(SCHEMA).parquet(out).collect() if x.user_id != 99)
    want = stream_quota(spark.createDataFrame(all_rows, SCHEMA), "user_id", "created_at", ["post_id"], 7)
    assert got == sorted(x.post_id for x in want.collect())
