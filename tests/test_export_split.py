"""Export batches of any size, and a batch that is run again."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from sensorlake.sources import messages
from sensorlake.streaming import jobs


def test_an_oversize_batch_is_written_in_flushes(spark, tmp_path, monkeypatch):
    landed, table, marks = (str(tmp_path / name) for name in ("landed", "table", "marks"))
    sizes = (2500, 0, 7, 1025)
    at = 0
    for n in sizes:  # one file each, several read by one batch
        rows = spark.range(at, at + n, 1, 1).select(
            F.lit(None).cast("binary").alias("key"), F.lit(b"{}").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
            F.col("id").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"),
        )
        rows.write.mode("append").parquet(landed)
        at += n
    written, write = [], jobs._write_batch

    def fails_once(*args):
        out = write(*args)
        written.append(out)
        if len(written) == 1:
            raise RuntimeError("stopped after the write, before the commit")
        return out

    monkeypatch.setattr(jobs, "_write_batch", fails_once)
    for run in range(2):
        query = jobs.start_export(messages.file_stream(spark, landed), table, marks, split=True, available_now=True)
        try:
            query.awaitTermination(120)
            assert run == 1
        except Exception as failure:
            assert run == 0 and "before the commit" in str(failure)
    stored = spark.read.parquet(table).select("offset", "batch_id", "flush").collect()
    assert sorted(r.offset for r in stored) == list(range(at))
    each = collections.Counter((r.batch_id, r.flush) for r in stored)
    assert sorted(each.values()) == [at % 1024] + [1024] * (at // 1024)
    assert sorted(f for _, f in each) == list(range(len(each)))
