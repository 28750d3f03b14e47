"""Incremental scans: findings while files arrive, then the final result.

``first_of_each`` delivers findings exactly deduplicated, and ``final`` recomputes both levels of
dedup over everything. ``dedup_of_each`` keeps both levels up to date as findings arrive: the
longest description of a group replaces an earlier one, and ``latest`` reads what holds now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from scanframe.operators import findings, rules
from scanframe.schema import FILE, RANKED


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Tables of files (Parquet, schema FILE) as they arrive in a folder."""
    return spark.readStream.schema(FILE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_findings(files: DataFrame) -> DataFrame:
    """Streaming findings of the stateless detectors, each (file, line, type) once.

    The state holds the keys delivered so far. For endless streams give the files an event
    time ``seen`` with a watermark: keys are then forgotten once it has passed them. A batch may
    come in few files, so its rows are dealt to all cores before they are scanned.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return first_of_each(rules.procedural(files.repartition(cores)))


def first_of_each(found: DataFrame) -> DataFrame:
    """Streaming findings, each (file, line, type) once."""
    return found.dropDuplicates(["file", "line", "type"])


def dedup_of_each(found: DataFrame) -> DataFrame:
    """Streaming findings: of each (file, line, type) the first so far, when a batch brings it or one before it.

    A native aggregate, of the same rows as ``findings.dedup_exact``: the state of a key is one finding. What is
    delivered only ever improves, so both levels of dedup follow from it (see ``latest``), whatever the batches.
    """
    return findings.dedup_exact(found)


def latest(spark: SparkSession, found_dir: str) -> DataFrame:
    """What holds now, by both levels, of all that ``dedup_of_each`` has delivered: a longer description
    has taken the place of an earlier one, and a first finding that of a later one."""
    return findings.dedup(spark.read.schema(RANKED).parquet(found_dir))


def latest_of_batch(spark: SparkSession, found_dir: str, number: int) -> DataFrame:
    """``latest`` of the lines for which a batch has brought something, as of that batch."""
    now = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in RANKED.fields)}, batch long").parquet(found_dir)
    touched = now.filter(F.col("batch") == number).select("file", "line").distinct()
    return findings.dedup(now.filter(F.col("batch") <= number).join(touched, ["file", "line"], "left_semi"))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within hold their state in RocksDB, so that it may outgrow the executors' memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Findings by severity in event-time windows of ``ts``; late ones count within ``delay``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window, "severity").agg(F.count("*").alias("n"))


def start(files: DataFrame, found_dir: str, checkpoint: str, deliver: Callable[[DataFrame, int], None] | None = None, trigger: str | None = None) -> StreamingQuery:
    """Write new findings to ``found_dir`` batch by batch, handing each to ``deliver``.

    A batch is written under its number, so one that runs again replaces itself. Without
    ``trigger`` (such as "100 milliseconds") all that is there is read, then the query ends;
    ``query.stop()`` cancels, and a restart goes on from the checkpoint.
    """
    return start_found(stream_findings(files), found_dir, checkpoint, deliver, trigger)


def start_found(found: DataFrame, found_dir: str, checkpoint: str, deliver: Callable[[DataFrame, int], None] | None = None, trigger: str | None = None, mode: str = "append") -> StreamingQuery:
    """As ``start``, for a stream of findings (see ``first_of_each``); ``mode`` is "update" for ``dedup_of_each``,
    of which ``deliver`` is handed ``latest_of_batch``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{found_dir}/batch={number}")
        if deliver:
            spark = batch.sparkSession
            deliver(latest_of_batch(spark, found_dir, number) if mode == "update" else spark.read.schema(RANKED).parquet(f"{found_dir}/batch={number}"), number)

    writer = found.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def final(spark: SparkSession, found_dir: str, *more: DataFrame) -> DataFrame:
    """The result that replaces the incremental one: all findings, deduplicated and ranked."""
    found = spark.read.schema(RANKED).parquet(f"{found_dir}/batch=*")
    return findings.ranked(findings.dedup(findings.union(found, *more)))


#: The name under which a stream counts the files that it has read.
COUNTED = "files_read"


def counted(files: DataFrame) -> DataFrame:
    """Streaming files, counted as they are read (see ``Progress``)."""
    return files.observe(COUNTED, F.count(F.lit(1)).alias("files"), F.count_if(F.col("content").isNull()).alias("skipped"))


class Progress(StreamingQueryListener):
    """How far a scan of ``counted`` files is: add it with ``spark.streams.addListener``.

    Counts are those of finished batches, so what it says has been delivered: after
    ``query.stop()`` it tells how much of the files ``final`` is the result of.
    """

    def __init__(self, total: int, told: Callable[[dict], None] | None = None):
        self.total, self.told = total, told
        self.files = self.skipped = self.batches = 0
        self.ended = False

    def state(self) -> dict:
        """``files`` read of ``total``, ``percent``, ``skipped``, ``batches``, and whether the query has ``ended``."""
        percent = 100 if not self.total else min(100, 100 * self.files // self.total)
        return {"files": self.files, "total": self.total, "percent": percent, "skipped": self.skipped, "batches": self.batches, "ended": self.ended}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(COUNTED)
        if row is not None and row.files:
            self.files += row.files
            self.skipped += row.skipped
            self.batches += 1
            if self.told:
                self.told(self.state())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True
        if self.told:
            self.told(self.state())


def progress(query: StreamingQuery) -> dict:
    """``batch`` and ``files`` read in the latest batch, and whether more is there."""
    p = query.lastProgress
    return {"batch": p["batchId"], "files": p["numInputRows"], "active": query.isActive} if p else {"batch": -1, "files": 0, "active": query.isActive}
