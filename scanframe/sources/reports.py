"""Findings from the JSON reports of other scanners.

Each reader takes paths of report files (or a DataFrame with a ``value`` column of documents)
and gives findings; absent fields take their defaults, broken documents give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import columns as C
from scanframe.schema import FINDING_COLUMNS

BANDIT = "results array<struct<filename:string,line_number:int,test_id:string,test_name:string,issue_severity:string,issue_text:string,code:string>>"
SEMGREP = "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<severity:string,lines:string,message:string>>>"
TRIVY = "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string>>>>"
SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
)
#: Severities by level of a SARIF-like report.
SARIF_LEVELS = {"blocker": "CRITICAL", "critical": "HIGH", "major": "MEDIUM", "minor": "LOW", "info": "LOW", "error": "HIGH", "warning": "MEDIUM", "note": "LOW"}


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths), wholetext=True)


def relative(path: Column, folder: str) -> Column:
    prefix = folder.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if folder else path


def _or(c: str, default: str | int) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _finding(**columns: Column) -> list[Column]:
    return [columns[k].alias(k) for k in FINDING_COLUMNS]


def _exploded(docs: DataFrame, schema: str, path: str) -> DataFrame:
    return docs.select(F.from_json("value", schema).alias("d")).select(F.explode(f"d.{path}").alias("r"))


def bandit(docs: DataFrame, folder: str = "") -> DataFrame:
    """Results but those of the password tests whose literal is a placeholder."""
    r = _exploded(docs, BANDIT, "results")
    quoted = C.first_quoted(F.concat_ws(" ", _or("r.code", ""), _or("r.issue_text", "")))
    noise = F.col("r.test_id").isin("B105", "B106", "B107") & F.coalesce(C.is_placeholder(quoted), F.lit(False))
    return r.filter(~F.coalesce(noise, F.lit(False))).select(
        *_finding(
            file=relative(_or("r.filename", ""), folder), line=_or("r.line_number", 0), type=F.concat(F.lit("Bandit: "), _or("r.test_id", ""), F.lit(" "), _or("r.test_name", "")),
            severity=F.upper(_or("r.issue_severity", "MEDIUM")), snippet=F.left(_or("r.code", ""), F.lit(120)), description=_or("r.issue_text", ""),
            category=F.lit("BANDIT"), analyzer=F.lit("bandit"),
        )
    )


def semgrep(docs: DataFrame, folder: str = "") -> DataFrame:
    level = F.upper(_or("r.extra.severity", "WARNING"))
    return _exploded(docs, SEMGREP, "results").select(
        *_finding(
            file=relative(_or("r.path", ""), folder), line=_or("r.start.line", 0), type=F.concat(F.lit("Semgrep: "), _or("r.check_id", "unknown")),
            severity=C.one_of({"CRITICAL": "CRITICAL", "ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}, level, F.lit("MEDIUM")),
            snippet=F.left(_or("r.extra.lines", ""), F.lit(120)), description=_or("r.extra.message", ""), category=F.lit("INJECTION"), analyzer=F.lit("semgrep"),
        )
    )


def trivy(docs: DataFrame, folder: str = "") -> DataFrame:
    v = _exploded(docs, TRIVY, "Results").select("r.Target", F.explode("r.Vulnerabilities").alias("r"))
    told = F.concat(F.coalesce("r.Title", F.left("r.Description", F.lit(100)), F.lit("")), F.lit(". Fixed in: "), _or("r.FixedVersion", "N/A"))
    return v.select(
        *_finding(
            file=relative(_or("Target", ""), folder), line=F.lit(0), type=F.concat(F.lit("Trivy: "), _or("r.VulnerabilityID", "")), severity=F.upper(_or("r.Severity", "MEDIUM")),
            snippet=F.concat(_or("r.PkgName", ""), F.lit(" "), _or("r.InstalledVersion", "")), description=told, category=F.lit("DEPENDENCY"), analyzer=F.lit("trivy"),
        )
    )


def sarif(docs: DataFrame, folder: str = "") -> DataFrame:
    """Results of a SARIF-like report; of a result's places the first counts."""
    r = _exploded(docs, SARIF, "runs").select(F.explode("r.results").alias("r")).withColumn("at", F.get("r.locations", F.lit(0))["physicalLocation"])
    return r.select(
        *_finding(
            file=relative(_or("at.artifactLocation.uri", ""), folder), line=_or("at.region.startLine", 0), type=F.concat(F.lit("Sonar: "), _or("r.ruleId", "unknown")),
            severity=C.one_of(SARIF_LEVELS, F.lower(_or("r.level", "warning")), F.lit("MEDIUM")), snippet=F.lit(""), description=_or("r.message.text", ""),
            category=F.lit("QUALITY"), analyzer=F.lit("sonar"),
        )
    )


READERS = {"bandit": bandit, "semgrep": semgrep, "trivy": trivy, "sonar": sarif}


def reports(spark: SparkSession, paths: dict[str, str], folder: str = "") -> DataFrame | None:
    """The findings of all given reports, by scanner name; None without any."""
    from scanframe.operators.findings import staged

    parts = [staged(READERS[k](documents(spark, p), folder), k) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None
