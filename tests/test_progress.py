"""How far a scan is, in percent, and the result of one that was stopped half-way."""

import time

from scanframe.operators import findings, rules
from scanframe.schema import FILE, RANKED
from scanframe.streaming import incremental


def _until(done):
    for _ in range(300):
        if done():
            return
        time.sleep(0.1)
    raise AssertionError("it took too long")


def test_percentage_and_partial_result(spark, tmp_path):
    rows = [(f"f{k}.py", f"f{k}.py", ".py", "python", None if k % 4 == 3 else f"eval(input())\nx = {k}\nDEBUG = True") for k in range(8)]
    folder, found = str(tmp_path / "in"), str(tmp_path / "found")
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], FILE).coalesce(1).write.mode("append").parquet(folder)
    told = []
    watch = incremental.Progress(len(rows), told.append)
    spark.streams.addListener(watch)
    try:
        files = incremental.counted(incremental.file_stream(spark, folder, files_per_trigger=1))
        seen = []

        def deliver(batch, number):
            seen.append(number)
            if number >= 1:
                time.sleep(3)

        query = incremental.start(files, found, str(tmp_path / "checkpoint"), deliver, trigger="10 milliseconds")
        _until(lambda: len(seen) >= 2 and watch.batches >= 1)
        assert watch.state()["percent"] == 25 and watch.state()["files"] == 2
        query.stop()  # in the second batch
        _until(lambda: watch.ended)
        assert told[0]["percent"] == 25 and told[-1]["ended"] and watch.state()["percent"] < 100
        part = spark.read.schema(RANKED).parquet(f"{found}/batch=0").select("file").distinct().collect()
        assert len(incremental.final(spark, found).filter("type LIKE '%eval%'").select("file").distinct().collect()) >= len(part) >= 1
        # a restart goes on from the checkpoint and ends as a scan of everything
        incremental.start(files, found, str(tmp_path / "checkpoint")).awaitTermination()
        _until(lambda: watch.files >= len(rows))
        assert watch.state()["percent"] == 100 and watch.state()["skipped"] == 2
    finally:
        spark.streams.removeListener(watch)
    whole = findings.ranked(findings.dedup(rules.procedural(spark.createDataFrame(rows, FILE))))
    assert list(map(tuple, incremental.final(spark, found).collect())) == list(map(tuple, whole.collect()))
