"""The jobs as queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import common, exposure_report, text_watch
from scanframe.plans import rule_sql
from scanframe.plans.stages import shared_dir


def job1_text_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the documents into one folder: the second finds nothing new.

    A stream reads a folder, or what a pattern names; the table may be a single file.
    """
    documents, output = f"{sf_dir}/documents[.]parquet", f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    text_watch.run(spark, documents, output)
    return text_watch.run(spark, documents, output)


def job2_exposure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over documents and pages into one folder: the second replaces the first's report."""
    output = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    paths = [f"{sf_dir}/{name}.parquet" for name in ("documents", "pages")]
    exposure_report.run(spark, *paths, output)
    return exposure_report.run(spark, *paths, output)


_DOCUMENTS = "SELECT coalesce(source, 'none') AS source, coalesce(source, 'none') || '/' || coalesce(doc_id::VARCHAR, 'null') || '.txt' AS file, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS content FROM documents"
_PAGES = (
    "SELECT coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ''), 'none') AS source, "
    "'pages/' || coalesce(page_id::VARCHAR, 'null') || '.html' AS file, regexp_replace(coalesce(html, ''), '\\r\\n?', chr(10), 'g') AS content FROM pages"
)


def _found(*texts: str) -> str:
    each = rule_sql.found(common.catalogue(("secret", "config")), keep="source, file")
    return f"WITH texts AS ({' UNION ALL '.join(texts)}),\nfound AS (SELECT *, 'sha256:' || sha256(match) AS snippet FROM (\n  {each}))"


_LONG = "NULL::BIGINT AS"
_JOB1 = f"""{_found(_DOCUMENTS)},
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY seq, snippet) = 1)
SELECT 'finding' AS record, source, file, line, type, severity, category, snippet, {_LONG} texts, {_LONG} empty, {_LONG} chars, {_LONG} findings FROM firsts
UNION ALL
SELECT 'source', source, NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE content = ''), sum(length(content))::BIGINT,
       (SELECT count(*) FROM found f WHERE f.source = t.source) FROM texts t GROUP BY source"""

_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in exposure_report.WEIGHTS.items()) + " ELSE 0 END"
_JOB2 = f"""{_found(_DOCUMENTS, _PAGES)},
first_places AS (SELECT type, category, severity, snippet, file, line FROM found QUALIFY row_number() OVER (PARTITION BY type, category, severity, snippet ORDER BY file, line) = 1),
secrets AS (SELECT type, category, severity, snippet, count(*) AS findings, count(DISTINCT file) AS files, count(DISTINCT source) AS sources FROM found GROUP BY ALL),
risks AS (
  SELECT source, sum({_WEIGHT})::BIGINT AS risk, count(*) AS secrets, arg_min(severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS severity
  FROM (SELECT DISTINCT source, type, severity, snippet FROM found) GROUP BY source),
exposed AS (SELECT source, count(*) AS findings, count(DISTINCT file) AS files FROM found GROUP BY source),
totals AS (SELECT source, count(*) AS texts FROM texts GROUP BY source)
SELECT 'secret' AS record, snippet AS key, type, category, severity, findings, files, sources, {_LONG} secrets, {_LONG} texts, file AS first_file, line AS first_line, {_LONG} risk
FROM secrets JOIN first_places USING (type, category, severity, snippet)
UNION ALL
SELECT 'source', source, NULL, NULL, severity, coalesce(findings, 0), coalesce(files, 0), NULL, coalesce(secrets, 0), texts, NULL, NULL, coalesce(risk, 0)
FROM totals LEFT JOIN risks USING (source) LEFT JOIN exposed USING (source)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_text_watch": job1_text_watch, "job2_exposure_report": job2_exposure_report}
ORACLE_SQL: dict[str, str] = {"job1_text_watch": _JOB1, "job2_exposure_report": _JOB2}
