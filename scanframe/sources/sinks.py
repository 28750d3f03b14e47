"""Sinks: a report as one document, rendered row by row in native expressions.

``save_report`` writes it as the ``report`` data source does: each task a part, in a folder in any
store that Arrow's file systems know, and the parts in the order of their names are the
document; no row passes through the driver. ``write_report`` writes a single file on the driver's machine,
for small reports: rows stream through ``toLocalIterator`` a partition at a time. All sinks
raise on failure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scanframe.functions import columns as C
from scanframe.operators import findings as O
from scanframe.schema import FINDING_COLUMNS

TOOL, VERSION = "scanframe", "1.0.0"
CSV_COLUMNS = {"File": "file", "Line": "line", "Threat": "type", "Category": "category", "Severity": "severity", "Description": "description", "Snippet": "snippet", "Analyzer": "analyzer"}


def json_row() -> Column:
    return F.to_json(F.struct(*FINDING_COLUMNS))


def csv_field(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; quotes doubled."""
    text = c.cast("string")
    return F.when(text.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row() -> Column:
    return F.concat_ws(",", *[csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in CSV_COLUMNS.values()])


def escaped(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def html_row() -> Column:
    cell = lambda c, attributes="": F.concat(F.lit(f"<td{attributes}>"), c, F.lit("</td>"))
    badge = lambda c: F.concat(F.lit('<span class="badge">'), c, F.lit("</span>"))
    code = F.concat(F.lit("<code>"), escaped(F.left("snippet", F.lit(80))), F.lit("</code>"))
    severity = F.concat(F.lit('<td class="'), escaped(F.lower("severity")), F.lit('">'), escaped(F.col("severity")), F.lit("</td>"))
    return F.concat(
        F.lit("<tr>"), cell(escaped(F.col("file"))), cell(F.col("line").cast("string")), cell(escaped(F.col("type"))), cell(badge(escaped(F.col("category")))), severity,
        cell(escaped(F.col("description"))), cell(code), cell(badge(escaped(F.col("analyzer")))), F.lit("</tr>"),
    )


def sarif_result() -> Column:
    place = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    mark = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "type")
    return F.to_json(
        F.struct(
            C.rule_id().alias("ruleId"),
            C.report_level(F.col("severity")).alias("level"),
            F.struct(F.left("description", F.lit(1000)).alias("text")).alias("message"),
            F.array(place).alias("locations"),
            F.struct(mark.alias("primaryLocationLineHash/v1")).alias("fingerprints"),
            F.struct("severity", "category", "analyzer", F.left(F.coalesce("snippet", F.lit("")), F.lit(200)).alias("snippet")).alias("properties"),
        )
    )


def sarif_rule() -> Column:
    return F.to_json(
        F.struct(
            "id", "name", F.struct(F.col("short").alias("text")).alias("shortDescription"), F.struct(F.col("full").alias("text")).alias("fullDescription"),
            F.struct("level").alias("defaultConfiguration"), F.struct("category", "analyzer", "severity").alias("properties"),
        )
    )


def _rows(df: DataFrame, c: Column) -> Iterable[str]:
    return (r[0] for r in df.select(c.alias("row")).toLocalIterator(prefetchPartitions=True))


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Document(NamedTuple):
    """What stands before, between and after the rows of a report."""

    head: str
    row: Column
    between: str
    tail: str


def _json(findings: DataFrame) -> Document:
    counts = O.summary(findings).first().asDict()
    head = {"tool": TOOL, "version": VERSION, "generated": _now().isoformat(), "summary": {k: counts[k] for k in ("total", "critical", "high", "medium", "low")}}
    return Document(json.dumps(head, indent=2)[:-2] + ',\n  "findings": [\n', json_row(), ",\n", "\n  ]\n}\n")


def _csv(findings: DataFrame) -> Document:
    return Document("\ufeff" + ",".join(CSV_COLUMNS) + "\r\n", F.concat(csv_row(), F.lit("\r\n")), "", "")


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="UTF-8"><title>Security report</title>
<style>body{{font-family:system-ui,sans-serif;margin:2em}}table{{border-collapse:collapse;width:100%}}
td,th{{border:1px solid #ccc;padding:4px 8px;text-align:left}}.critical{{color:#b00020}}.high{{color:#c25700}}
.medium{{color:#8a6d00}}.low{{color:#1b5e20}}.badge{{background:#eee;padding:1px 4px}}</style></head><body>
<h1>Security report</h1><p>Generated: {when}</p>
<ul><li>CRITICAL: {critical}</li><li>HIGH: {high}</li><li>MEDIUM: {medium}</li><li>LOW: {low}</li><li>TOTAL: {total}</li></ul>
<table><tr><th>File</th><th>Line</th><th>Threat</th><th>Category</th><th>Severity</th><th>Description</th><th>Code</th><th>Analyzer</th></tr>
"""


def _html(findings: DataFrame) -> Document:
    counts = O.summary(findings).first().asDict()
    return Document(_PAGE.format(when=_now().strftime("%Y-%m-%d %H:%M:%S"), **counts), F.concat(html_row(), F.lit("\n")), "", "</table></body></html>\n")


def _sarif(findings: DataFrame) -> Document:
    counts = O.summary(findings).first().asDict()
    rules = sorted(_rows(O.rollup(findings), sarif_rule()))  # a row a detector and category
    driver = {"name": TOOL, "version": VERSION, "rules": [json.loads(r) for r in rules], "properties": {"totalFindings": counts["total"], **{f"{k}Count": counts[k] for k in ("critical", "high", "medium", "low", "info")}}}
    invocation = {"executionSuccessful": True, "toolExecutionNotifications": [], "properties": {"scanStartTime": _now().isoformat(), "totalFindings": counts["total"]}}
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": ' + json.dumps({"driver": driver})
    head += ', "artifacts": [{"location": {"uri": ".", "uriBaseId": "%SRCROOT%"}}], "invocations": [' + json.dumps(invocation) + '], "results": [\n'
    return Document(head, sarif_result(), ",\n", "\n]}]}\n")


DOCUMENTS = {"json": _json, "csv": _csv, "html": _html, "sarif": _sarif}


def write_report(findings: DataFrame, path: str, kind: str) -> None:
    """One file on the driver's machine. ``findings`` is read more than once."""
    document = DOCUMENTS[kind](findings)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(document.head)
        for k, row in enumerate(_rows(O.ranked(findings), document.row)):
            f.write((document.between if k else "") + row)
        f.write(document.tail)


def save_report(findings: DataFrame, path: str, kind: str) -> None:
    """A folder of parts, written by the tasks; it replaces what is there. ``findings`` is read more than once."""
    document = DOCUMENTS[kind](findings)
    findings.sparkSession.dataSource.register(ReportSink)
    rows = O.ranked(findings).select(document.row.alias("row"))
    rows.write.format(ReportSink.name()).mode("overwrite").options(head=document.head, between=document.between, tail=document.tail).save(path)


class ReportSink(DataSource):
    """``df.write.format("report").options(head=, between=, tail=).save(uri)``: the strings of the
    one column, in the order of the partitions, as parts whose names sort as the document goes.

    A task's part is written under a name of its attempt, so a repeated or a lost task leaves no
    half part behind; on commit the driver names the parts of the attempts that counted, and
    adds the head, the tail and what stands between parts. A report with ``tail`` is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> "ReportWriter":
        return ReportWriter(dict(self.options), overwrite)


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    rows: int


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite, self.run = options, overwrite, uuid.uuid4().hex
        store, base = self._store()
        if not overwrite and self._names(store, base):
            raise ValueError(f"{options['path']} holds a report already")

    def _store(self):
        from pyarrow import fs

        uri = self.options["path"].rstrip("/")
        if uri.startswith("file:/"):
            uri = uri.removeprefix("file:").replace("///", "/", 1)
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def _names(self, store, base: str) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.File)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, base = self._store()
        task, rows = TaskContext.get(), 0
        number, file = task.partitionId(), f"_{self.run}-{task.taskAttemptId()}"
        out = None
        for batch in iterator:
            for row in batch.column(0).to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{file}")
                out.write(((self.options.get("between", "") if rows else "") + row).encode())
                rows += 1
        if out is not None:
            out.close()
        return Part(number, file, rows)

    def commit(self, messages) -> None:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        for name in self._names(store, base):  # an earlier report, its tail first; what lost attempts of this one left
            if not name.startswith("_"):
                store.delete_file(f"{base}/{name}")
        own = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        self._put(store, f"{base}/part-00000000-head", self.options.get("head", ""))
        for k, m in enumerate(own):
            if k and self.options.get("between"):
                self._put(store, f"{base}/part-{m.number + 1:08}-a", self.options["between"])
            store.move(f"{base}/{m.file}", f"{base}/part-{m.number + 1:08}-b")
        self._put(store, f"{base}/part-99999999-tail", self.options.get("tail", ""))
        self._clear(store, base)

    def abort(self, messages) -> None:
        self._clear(*self._store())

    def _put(self, store, path: str, text: str) -> None:
        with store.open_output_stream(path) as f:
            f.write(text.encode())

    def _clear(self, store, base: str) -> None:
        for name in self._names(store, base):
            if name.startswith(f"_{self.run}"):
                store.delete_file(f"{base}/{name}")
