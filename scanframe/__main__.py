"""``spark-submit scanframe/__main__.py FOLDER [--report PATH --kind KIND] [--settings FILE]``

Scans a source tree, prints counts by severity and the coverage, and writes a report. The
settings file is JSON: ``detectors`` (names), ``reports`` (scanner name to report file),
``max_bytes``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> dict:
    from scanframe.operators import findings
    from scanframe.plans import scan
    from scanframe.sources import files, reports, sinks

    parser = argparse.ArgumentParser(prog="scanframe")
    parser.add_argument("folder")
    parser.add_argument("--report")
    parser.add_argument("--save", help="a folder in any store, for a report in parts")
    parser.add_argument("--kind", choices=list(sinks.DOCUMENTS), default="json")
    parser.add_argument("--settings")
    given = parser.parse_args(argv)
    settings = {}
    if given.settings:
        with open(given.settings, encoding="utf-8") as f:
            settings = json.load(f)
    spark = SparkSession.builder.appName("scanframe").getOrCreate()
    options = {"max_bytes": settings["max_bytes"]} if "max_bytes" in settings else {}
    source = files.files_from_tree(spark, given.folder, **options).cache()
    more = reports.reports(spark, settings.get("reports", {}), given.folder)
    found, covered = scan.scan_covered(source, tuple(settings.get("detectors", scan.DEFAULT)), more)
    found = found.cache()
    result = {"summary": findings.summary(found).first().asDict(), "coverage": covered.first().asDict()}
    if given.report:
        sinks.write_report(found, given.report, given.kind)
    if given.save:
        sinks.save_report(found, given.save, given.kind)
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
