"""A whole scan: files to findings, deduplicated and ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.operators import context, dependencies, findings, graph, rules, syntax
from scanframe.plans.stages import materialise

#: Detectors by name, each from files to findings; those of DEFAULT run unless others are named.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "file": rules.suspicious_files,
    "rules": rules.procedural,
    "context": context.context_findings,
    "dependency": dependencies.dependency_findings,
    "graph": graph.graph_findings,
    "tree": syntax.tree_findings,
}
DEFAULT = ("file", "rules", "context", "dependency", "graph")


def detect(files: DataFrame, detectors: tuple[str, ...] = DEFAULT) -> DataFrame:
    """All findings before dedup. Each detector filters the files to those it reads before it
    touches their content, and the filters reach the scan."""
    return findings.union(*[DETECTORS[d](files) for d in detectors])


def scan(files: DataFrame, detectors: tuple[str, ...] = DEFAULT, reports: DataFrame | None = None) -> DataFrame:
    """Findings of the files, and of other scanners' reports, deduplicated; see ``ranked``."""
    found = detect(files, detectors)
    return findings.dedup(found if reports is None else found.unionByName(reports))


def register_detector(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``detector``, from FILE rows to RANKED findings, known to ``detect`` and ``scan`` by name."""
    if name in DETECTORS and DETECTORS[name] is not detector:
        raise ValueError(f"there is a detector {name} already")
    DETECTORS[name] = detector


def forget_detector(name: str) -> None:
    DETECTORS.pop(name, None)


def scan_covered(files: DataFrame, detectors: tuple[str, ...] = DEFAULT, reports: DataFrame | None = None, extra: dict[str, rules.Detector] | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings of ``scan`` and the coverage, from one pass of the procedural detectors.

    Their rows, findings and a status a file, are written to the shared folder, and both results read them.
    ``extra`` are detectors of the user's own, by name, which run in the same pass.
    """
    rows = materialise(rules.scanned(files, extra), "scanned")
    others = [DETECTORS[d](files) for d in detectors if d != "rules"]
    found = findings.union(rules.findings_of(rows), *others)
    return findings.dedup(found if reports is None else found.unionByName(reports)), findings.coverage(rules.status_of(rows))


def scan_coverage(files: DataFrame) -> DataFrame:
    return findings.coverage(rules.status(files))


def routed(files: DataFrame) -> DataFrame:
    """Files by language family."""
    return files.groupBy("language", "ext").agg(F.count("*").alias("files"))
