"""Report how far each exposed secret has spread, and how exposed each source is.

    spark-submit jobs/exposure_report.py --documents DIR --pages DIR --output DIR --config jobs/exposure_report.json

Whoever rotates a leaked secret must know every place that holds it; whoever owns a source wants
to know what to mend first. Documents and web pages are scanned once; the same match anywhere is
one exposure. A rerun replaces the report as a whole.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from scanframe.functions import columns as C
from scanframe.operators import rules
from scanframe.schema import SEVERITIES

log = logging.getLogger("jobs.exposure_report")

WEIGHTS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}


def _worst(severity: Column) -> Column:
    """The most severe of a group."""
    return F.min_by(severity, C.severity_rank(severity))


def run(spark: SparkSession, documents: str, pages: str, output: str, rules: tuple[str, ...] = ("secret", "config"), weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """Scan ``documents`` and ``pages`` (tables of Parquet files); returns the report read back.

    ``output`` gets ``places`` (a row a secret and file that holds it), and ``report`` by record and
    severity: a row a secret (``findings``, ``files``, ``sources``, the first file) and a row a
    source (its ``texts``, ``findings``, ``files`` and ``secrets`` found, and ``risk``, the weights of its
    distinct secrets). Secrets are named by their SHA-256 only. Sources are a
    document's source and a page's host. Null texts are texts without findings; extra columns are ignored;
    sources without findings have no severity and no risk.
    """
    output = output.rstrip("/")
    files = common.document_files(spark.read.parquet(documents)).unionByName(common.page_files(spark.read.parquet(pages)))
    found = files.select("source", "path", F.explode(_found(common.catalogue(rules))).alias("h"))
    keys = ("h.type", "h.severity", "h.category")
    places = found.select("source", F.col("path").alias("file"), *keys, common.fingerprint(F.col("h.match")).alias("secret"), "h.line")
    # a file's matches are in one task: combined there, the shuffle carries a row a place
    counted = places.groupBy("secret", "type", "severity", "category", "source", "file").agg(F.count("*").alias("findings"), F.min("line").alias("line"))
    counted.hint("rebalance", "severity").write.mode("overwrite").partitionBy("severity").parquet(f"{output}/places")
    schema = "secret string, type string, category string, source string, file string, findings long, line int, severity string"
    held = spark.read.schema(schema).parquet(f"{output}/places")

    report = _secrets(held).unionByName(_sources(held, files.groupBy("source").agg(F.count("*").alias("texts")), weights))
    report.hint("rebalance", "record", "severity").write.mode("overwrite").partitionBy("record", "severity").parquet(f"{output}/report")
    written = spark.read.schema(report.schema).parquet(f"{output}/report")
    for record, n in sorted(tuple(r) for r in written.groupBy("record").count().collect()):
        log.info("read %s and %s; wrote %d rows of %ss to %s", documents, pages, n, record, output)
    return written


def _found(chosen: tuple) -> Column:
    return rules.hits(F.col("content"), chosen)


_COLUMNS = ("record", "key", "type", "category", "severity", "findings", "files", "sources", "secrets", "texts", "first_file", "first_line", "risk")


def _secrets(places: DataFrame) -> DataFrame:
    """A row a secret. Counted by source first, so that sources are rows to count, not a set to hold."""
    first = F.min(F.struct("file", "line")).alias("first")
    by_source = places.groupBy("secret", "type", "category", "severity", "source").agg(F.sum("findings").alias("findings"), F.count("*").alias("files"), first)
    each = by_source.groupBy("secret", "type", "category", "severity").agg(
        F.sum("findings").alias("findings"), F.sum("files").alias("files"), F.count("*").alias("sources"), F.min("first").alias("first")
    )
    fixed = {"record": F.lit("secret"), "key": F.col("secret"), "first_file": F.col("first.file"), "first_line": F.col("first.line")}
    return each.select(*[fixed[c].alias(c) if c in fixed else _typed(c) if c in ("secrets", "texts", "risk") else F.col(c) for c in _COLUMNS])


def _sources(places: DataFrame, texts: DataFrame, weights: dict[str, int]) -> DataFrame:
    """A row a source: its secrets and its files are each counted from rows of their own."""
    weight = C.one_of({s: str(weights.get(s, 0)) for s in SEVERITIES}, F.col("severity"), F.lit("0")).cast("long")
    by_secret = places.groupBy("source", "secret", "type", "severity").agg(F.sum("findings").alias("findings"))
    by_file = places.groupBy("source", "file").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("files"))
    by_source = by_secret.groupBy("source").agg(F.sum("findings").alias("findings"), F.count("*").alias("secrets"), F.sum(weight).alias("risk"), _worst(F.col("severity")).alias("severity"))
    own = texts.join(by_source, "source", "left").join(by_file, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    fixed = {"record": F.lit("source").alias("record"), "key": F.col("source").alias("key"), "texts": F.col("texts"), "severity": F.col("severity")}
    return own.select(*[fixed[c] if c in fixed else zero(c) if c in ("findings", "files", "secrets", "risk") else _typed(c) for c in _COLUMNS])


def _typed(c: str) -> Column:
    kind = {"type": "string", "category": "string", "first_file": "string", "first_line": "int"}.get(c, "long")
    return F.lit(None).cast(kind).alias(c)


if __name__ == "__main__":
    common.command_line("exposure_report", run, ("documents", "pages"))
