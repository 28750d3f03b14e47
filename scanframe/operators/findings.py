"""Findings: union, two-level dedup, order, counts, roll-up and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions import columns as C
from scanframe.schema import FINDING_COLUMNS, RANKED_COLUMNS, SEVERITIES, STAGE


def staged(findings: DataFrame, stage: str, order: list | None = None) -> DataFrame:
    """Place findings without ordinals: ``seq`` counts within a file, by ``order``."""
    w = Window.partitionBy("file").orderBy(*(order or ["line", "type"]))
    return findings.select(*FINDING_COLUMNS, F.lit(STAGE[stage]).alias("stage"), F.row_number().over(w).cast("long").alias("seq"))


def union(*parts: DataFrame) -> DataFrame:
    """All detectors' findings; their order is in (stage, seq), not in the union."""
    return reduce(DataFrame.unionByName, [p.select(*RANKED_COLUMNS) for p in parts])


def dedup_exact(findings: DataFrame) -> DataFrame:
    """The first finding of each (file, line, type).

    An aggregate, so each task keeps one row a key before anything is shuffled.
    """
    rest = [c for c in RANKED_COLUMNS if c not in ("file", "line", "type", "stage", "seq")]
    first = F.min_by(F.struct(*rest, "stage", "seq"), F.struct("stage", "seq")).alias("f")
    return findings.groupBy("file", "line", "type").agg(first).select("file", "line", "type", "f.*").select(*RANKED_COLUMNS)


def dedup_semantic(findings: DataFrame) -> DataFrame:
    """Of each (file, line, category in upper case, severity) the longest description.

    Ties go to the first. The survivor takes the place (``stage``, ``seq``) at which its group
    first appeared. Expects the result of ``dedup_exact``.
    """
    rest = [c for c in RANKED_COLUMNS if c not in ("file", "line", "severity", "stage", "seq")]
    best = F.min_by(F.struct(*rest), F.struct((-F.length("description")).alias("d"), "stage", "seq")).alias("f")
    grouped = findings.groupBy("file", "line", "severity", F.upper("category").alias("key")).agg(best, F.min(F.struct("stage", "seq")).alias("p"))
    return grouped.select("file", "line", "severity", "f.*", "p.*").select(*RANKED_COLUMNS)


def dedup(findings: DataFrame) -> DataFrame:
    return dedup_semantic(dedup_exact(findings))


def ranked(findings: DataFrame) -> DataFrame:
    """Most severe first; within a severity by file and place. A range exchange, no collect."""
    return findings.orderBy(C.severity_rank(F.col("severity")), "file", "stage", "seq")


def top(findings: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``ranked``: a bounded heap in each task, then one merge."""
    return ranked(findings).limit(n)


def severity_counts(findings: DataFrame) -> DataFrame:
    """``severity, n`` of every severity that occurs, in upper case."""
    return findings.groupBy(F.upper("severity").alias("severity")).agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: ``total`` and a count for each known severity."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def rollup(findings: DataFrame) -> DataFrame:
    """One row a report rule, described by its first finding."""
    first = F.min_by(F.struct("type", "description", "severity", "category", "analyzer"), F.struct("file", "stage", "seq")).alias("f")
    grouped = findings.groupBy(C.rule_id().alias("id")).agg(first, F.count("*").alias("n"))
    return grouped.select(
        "id",
        F.left("f.type", F.lit(80)).alias("name"),
        F.left("f.type", F.lit(120)).alias("short"),
        F.left("f.description", F.lit(500)).alias("full"),
        C.report_level(F.col("f.severity")).alias("level"),
        "f.category",
        "f.analyzer",
        "f.severity",
        "n",
    )


def display(findings: DataFrame) -> DataFrame:
    """Columns cut to the width of a results table."""
    return findings.select(
        C.shortened(F.col("file"), 30, tail=True).alias("file"),
        "line",
        C.shortened(F.col("type"), 35).alias("type"),
        "category",
        "severity",
        C.shortened(F.col("description"), 80).alias("description"),
    )


def report_lines(findings: DataFrame) -> DataFrame:
    return findings.select(C.report_line().alias("text"))


def coverage(files: DataFrame) -> DataFrame:
    """``discovered, queued, analyzed, skipped, failed`` from rows with ``status``.

    Every discovered file is in exactly one of analyzed, failed and skipped.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    return files.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("status") != "skipped").alias("queued"),
        is_("analyzed").alias("analyzed"),
        is_("skipped").alias("skipped"),
        is_("failed").alias("failed"),
    )


def taint_path_findings(paths: DataFrame) -> DataFrame:
    """Findings of rows ``file, source_line, source_var, sink_line, sink_func, path_vars, severity``."""
    told = F.concat(
        F.lit("Taint flow: variable '"), "source_var", F.lit("' (line "), F.col("source_line").cast("string"), F.lit(") flows into dangerous sink '"),
        "sink_func", F.lit("' (line "), F.col("sink_line").cast("string"), F.lit("). Path: "), C.path_text(F.col("path_vars")),
    )
    pair = F.concat("source_var", F.lit(" -> "), "sink_func")
    return paths.select(
        "file", F.col("sink_line").cast("int").alias("line"), F.concat(F.lit("Taint: "), pair).alias("type"), F.coalesce("severity", F.lit("CRITICAL")).alias("severity"),
        pair.alias("snippet"), told.alias("description"), F.lit("INJECTION").alias("category"), F.lit("taint").alias("analyzer"),
    )


def prompt(findings: DataFrame, n: int = 20) -> DataFrame:
    """One row ``prompt``: a request to explain the first ``n`` findings, and how many there are."""
    line = F.concat(
        F.lit("- ["), "severity", F.lit("] "), "type", F.lit(" in "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" - "), F.left("description", F.lit(100))
    )
    order = F.struct(C.severity_rank(F.col("severity")).alias("r"), "file", "stage", "seq")
    first = top(findings, n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    total = findings.agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > n, F.concat(F.lit("\n... and "), (F.col("total") - n).cast("string"), F.lit(" more findings"))).otherwise(F.lit(""))
    head = F.concat(F.lit("Explain these findings, most urgent first, and how to fix them.\nFindings ("), F.col("total").cast("string"), F.lit(" total):\n"))
    return total.join(first, how="cross").select(F.concat(head, "lines", more).alias("prompt"))
