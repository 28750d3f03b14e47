"""Reports saved in parts: their parts in order are the document that one file would be."""

import csv
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from scanframe.schema import RANKED
from scanframe.sources import sinks


@pytest.fixture(scope="module")
def found(spark):
    severities = ("LOW", "CRITICAL", "HIGH", "odd", "MEDIUM", "INFO")
    rows = [(f"src/é{k % 37}.py", k, f'T "{k % 5}" <x>', severities[k % 6], f"s, {k}", f"d\n{k}", "C" if k % 2 else "d", "pattern", k % 3, k) for k in range(3000)]
    return spark.createDataFrame(rows, RANKED).repartition(7)


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _document(folder):
    names = sorted(os.listdir(folder))
    assert not any(n.startswith("_") for n in names)
    return "".join(open(f"{folder}/{n}", encoding="utf-8", newline="").read() for n in names if not n.startswith(".")), names


@pytest.mark.parametrize("kind", sinks.DOCUMENTS)
def test_parts_make_up_the_document(found, tmp_path, kind):
    sinks.save_report(found, str(tmp_path / "parts"), kind)
    sinks.write_report(found, str(tmp_path / "one"), kind)
    text, names = _document(tmp_path / "parts")
    assert len(names) > 4
    when = lambda s: re.sub(r'\d{4}-\d\d-\d\d[T ][\d:.+]+', "", s)
    assert when(text) == when((tmp_path / "one").open(encoding="utf-8", newline="").read())
    if kind == "json":
        assert len(json.loads(text)["findings"]) == 3000
    elif kind == "sarif":
        assert len(json.loads(text)["runs"][0]["results"]) == 3000
    elif kind == "csv":
        assert len(list(csv.reader(text.splitlines(keepends=True)))) == 3001


def test_a_report_replaces_another(spark, found, tmp_path):
    folder = "file://" + str(tmp_path / "a" / "b")
    sinks.save_report(found, folder, "json")
    sinks.save_report(found.filter("line = 5"), folder, "json")
    text, names = _document(tmp_path / "a" / "b")
    assert len(json.loads(text)["findings"]) == 1 and len(names) == 3
    sinks.save_report(found.limit(0), folder, "sarif")
    text, names = _document(tmp_path / "a" / "b")
    assert json.loads(text)["runs"][0]["results"] == [] and len(names) == 2
    with pytest.raises(Exception, match="holds a report already"):
        found.select(F.lit("x").alias("row")).write.format("report").mode("append").save(folder)


def test_a_failed_write_leaves_the_earlier_report(spark, found, tmp_path):
    folder = str(tmp_path / "r")
    sinks.save_report(found.filter("line = 5"), folder, "json")
    before = _document(folder)
    broken = found.select(F.when(F.col("line") == 2999, F.raise_error(F.lit("lost"))).otherwise("file").alias("row"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("report").mode("overwrite").options(head="", between="", tail="").save(folder)
    assert _document(folder) == before


def test_attempts_that_do_not_count_are_not_named(tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    writer = sinks.ReportWriter({"path": str(folder), "head": "[", "between": ",", "tail": "]"}, True)
    for name, text in ((f"_{writer.run}-1", "a"), (f"_{writer.run}-2", "a"), (f"_{writer.run}-3", "b"), ("part-00000007-b", "old")):
        (folder / name).write_text(text)
    writer.commit([sinks.Part(4, f"_{writer.run}-3", 1), None, sinks.Part(0, f"_{writer.run}-2", 1), sinks.Part(2, "_none", 0)])
    assert _document(folder)[0] == "[a,b]"
