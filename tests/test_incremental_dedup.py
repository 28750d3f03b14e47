"""Both levels of dedup as findings arrive: a longer description replaces an earlier one."""

import random

from scanframe.operators import findings
from scanframe.schema import RANKED
from scanframe.streaming import incremental


def _rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select(RANKED.names).collect())


def test_any_batches_end_as_all_at_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (f"f{rng.randrange(3)}", rng.randrange(4), f"t{rng.randrange(5)}", rng.choice(("HIGH", "LOW")), rng.choice(("s", None)), "d" * rng.randrange(6), rng.choice(("a", "A", "b")), "pattern", rng.randrange(3), k)
        for k in rng.sample(range(1000), 240)
    ]
    folder, found, stops = str(tmp_path / "in"), str(tmp_path / "found"), (60, 61, 200, 240)
    spark.createDataFrame([], RANKED).write.parquet(folder)
    start = 0
    for stop in stops:
        spark.createDataFrame(rows[start:stop], RANKED).coalesce(1).write.mode("append").parquet(folder)
        start = stop
        stream = spark.readStream.schema(RANKED).parquet(folder)
        incremental.start_found(incremental.dedup_of_each(stream), found, str(tmp_path / "checkpoint"), mode="update").awaitTermination()
        got = _rows(incremental.latest(spark, found))
        assert got == _rows(findings.dedup(spark.createDataFrame(rows[:stop], RANKED)))
    # nothing new: the state and what it has delivered stay
    stream = spark.readStream.schema(RANKED).parquet(folder)
    incremental.start_found(incremental.dedup_of_each(stream), found, str(tmp_path / "checkpoint"), mode="update").awaitTermination()
    assert _rows(incremental.latest(spark, found)) == got


def test_batches_are_delivered_by_both_levels_and_without_python(spark, tmp_path):
    first = [("f", 1, "a", "HIGH", "s", "short", "c", "pattern", 1, 5), ("f", 2, "a", "HIGH", "s", "other", "c", "pattern", 1, 6)]
    second = [("f", 1, "b", "HIGH", "s", "a longer one", "C", "pattern", 1, 7), ("f", 1, "a", "LOW", "s", "earlier", "c", "pattern", 0, 1)]
    folder, told = str(tmp_path / "in"), {}
    for rows in (first, second):
        spark.createDataFrame(rows, RANKED).coalesce(1).write.mode("append").parquet(folder)
        found = incremental.dedup_of_each(spark.readStream.schema(RANKED).parquet(folder))
        assert "Pandas" not in found._jdf.queryExecution().analyzed().toString()
        with incremental.state_on_disk(spark):
            incremental.start_found(found, str(tmp_path / "found"), str(tmp_path / "checkpoint"), lambda b, n: told.update({n: _rows(b)}), mode="update").awaitTermination()
    assert told[0] == _rows(findings.dedup(spark.createDataFrame(first, RANKED)))
    # line 1 alone is touched: its first finding of type a is now another, in a group of its own
    assert told[1] == [r for r in _rows(findings.dedup(spark.createDataFrame(first + second, RANKED))) if r[1] == 1]
