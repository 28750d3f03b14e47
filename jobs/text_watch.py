"""Watch a growing folder of texts for exposed secrets and unsafe configuration.

    spark-submit jobs/text_watch.py --documents DIR --output DIR --config jobs/text_watch.json

Each run takes the Parquet files that no earlier run has taken, and ends. A batch of files is
scanned once, into one row a text with its findings; the findings by severity and the coverage by
source are made of those rows. A batch writes folders of its own number, so one that ran before,
whole or in part, replaces itself when it runs again.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from scanframe.operators import rules
from scanframe.schema import STAGE

log = logging.getLogger("jobs.text_watch")

DOCUMENTS = "doc_id long, text string, source string"
SCANNED = f"source string, path string, chars long, found {rules.HITS}"
FINDINGS = "file string, source string, line int, type string, snippet string, description string, category string, stage int, seq long, batch long, severity string"
COVERAGE = "source string, texts long, empty long, chars long, findings long, batch long"


def run(spark: SparkSession, documents: str, output: str, rules: tuple[str, ...] = ("secret", "config"), files_per_batch: int = 1000) -> DataFrame:
    """Scan what is new in ``documents``; returns ``report`` of everything scanned so far.

    ``documents``: a folder of Parquet files with ``doc_id, text, source``, or a pattern of such; other columns
    are ignored, and a file must not change once it is there. ``output`` gets ``scanned``,
    ``findings`` (by batch and severity), ``coverage`` and the stream's ``checkpoint``.
    Findings name secrets by their SHA-256 only. Null texts and texts without a finding count
    in the coverage; a folder without files leaves empty output.
    """
    output = output.rstrip("/")
    chosen, done = common.catalogue(rules), []

    def batch(docs: DataFrame, number: int) -> None:
        _scan(docs, number, output, chosen)
        done.append(number)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s, new batches: %s; wrote %s", documents, done or "none", output)
    return report(spark, output)


def _scan(docs: DataFrame, number: int, output: str, chosen: tuple) -> None:
    spark, files = docs.sparkSession, common.document_files(docs)
    at = {name: f"{output}/{name}/batch={number}" for name in ("scanned", "findings", "coverage")}
    found = files.select("source", "path", F.length("content").cast("long").alias("chars"), rules.hits(F.col("content"), chosen).alias("found"))
    redacted = F.transform("found", lambda h: h.withField("match", common.fingerprint(h["match"])).withField("snippet", F.lit("")))
    found.withColumn("found", redacted).write.mode("overwrite").parquet(at["scanned"])
    scanned = spark.read.schema(SCANNED).parquet(at["scanned"])
    each = scanned.select("source", F.col("path").alias("file"), F.explode("found").alias("h"))
    own = each.select(
        "file", "source", "h.line", "h.type", F.col("h.match").alias("snippet"), "h.description", "h.category", F.lit(STAGE["config"]).alias("stage"), "h.seq", "h.severity"
    )
    own.write.mode("overwrite").partitionBy("severity").parquet(at["findings"])
    by_source = scanned.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if(F.col("chars") == 0).alias("empty"), F.sum("chars").alias("chars"), F.sum(F.size("found")).cast("long").alias("findings")
    )
    by_source.write.mode("overwrite").parquet(at["coverage"])
    told = spark.read.schema(COVERAGE).parquet(at["coverage"]).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("texts", "chars", "findings")]).first()
    log.info("batch %d: read %d texts of %d characters, wrote %d findings to %s", number, *told, at["findings"])


def _read(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    """All batches; none before the first one, when there is no folder yet."""
    try:
        return spark.read.schema(schema).parquet(f"{output}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def findings(spark: SparkSession, output: str) -> DataFrame:
    """The first finding of each (file, line, type), in whichever batches they came."""
    rest = ("seq", "snippet", "severity", "source", "description", "category", "stage")
    found = _read(spark, output, "findings", FINDINGS)
    return found.groupBy("file", "line", "type").agg(F.min(F.struct(*rest)).alias("f")).select("file", "line", "type", "f.*")


def report(spark: SparkSession, output: str) -> DataFrame:
    """``record, source, file, line, type, severity, category, snippet, texts, empty, chars, findings``:
    a row a finding, and a row a source with what was covered."""
    found = findings(spark, output).select(
        F.lit("finding").alias("record"), "source", "file", "line", "type", "severity", "category", "snippet",
        *[F.lit(None).cast("long").alias(c) for c in ("texts", "empty", "chars", "findings")],
    )
    covered = _read(spark, output, "coverage", COVERAGE).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("texts", "empty", "chars", "findings")])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "int"), ("type", "string"), ("severity", "string"), ("category", "string"), ("snippet", "string"))]
    return found.unionByName(covered.select(F.lit("source").alias("record"), "source", *none, "texts", "empty", "chars", "findings"))


if __name__ == "__main__":
    common.command_line("text_watch", run, ("documents",))
