"""Rules from a table with their own conditions, detectors of a user's own, coverage of one pass."""

import pytest
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions.source import Hit
from scanframe.operators import findings, rules
from scanframe.plans import scan
from scanframe.schema import FILE, RANKED

DDL = "name string, pattern string, severity string, category string, description string, validator string"


def _files(spark, **contents):
    return spark.createDataFrame([(f"{n}.py", f"{n}.py", ".py", "python", c) for n, c in contents.items()], FILE)


def test_rules_of_a_table(spark):
    df = _files(spark, a="foo 12\nfoo 7\nFOO 99", b="bar", c="", d=None)
    own = spark.createDataFrame([("Foo", r"foo\s+\d+", "LOW", "X", "d", "cast(regexp_extract(match, '[0-9]+', 0) AS int) > 9 AND line < 3"), ("Bar", "bar", "HIGH", "Y", "e", None)], DDL)
    got = sorted((r.file, r.line, r.type, r.severity, r.snippet) for r in rules.table_findings(df, own).collect())
    assert got == [("a.py", 1, "Foo", "LOW", "foo 12"), ("b.py", 1, "Bar", "HIGH", "bar")]
    assert rules.table_findings(df, own.limit(0)).count() == 0 and rules.table_findings(df, own).dtypes == rules.table_findings(df, own.limit(0)).dtypes
    with pytest.raises(Exception, match="unterminated|missing"):
        rules.table_findings(df, spark.createDataFrame([("Bad", "(", "LOW", "X", "d", None)], DDL))


def test_validators_of_a_catalogue(spark):
    df = _files(spark, a="foo 12\nfoo 7")
    found = rules.occurrences(df, [("Foo", r"foo\s+\d+", "LOW", "X", "d")], {"Foo": lambda m: F.length(m) > 5, "Other": lambda m: F.lit(False)})
    assert [(r.line, r.seq) for r in found.collect()] == [(1, 1)]


def test_registry(spark):
    def own(files):
        return rules.occurrences(files, [("Foo", "foo", "LOW", "X", "d")])

    scan.register_detector("mine", own)
    try:
        scan.register_detector("mine", own)  # again the same
        with pytest.raises(ValueError, match="already"):
            scan.register_detector("mine", lambda f: f)
        assert [r.type for r in scan.scan(_files(spark, a="foo"), ("mine",)).collect()] == ["Foo"]
    finally:
        scan.forget_detector("mine")
    with pytest.raises(KeyError):
        scan.detect(_files(spark, a="foo"), ("mine",))


def test_one_pass_gives_findings_and_coverage(spark):
    def broken(content, ext):
        if "boom" in content:
            raise RuntimeError("boom")
        yield Hit(1, "Own", "INFO", "", "", "X", "own")

    df = _files(spark, a="eval(input())\n# boom", b="x = 1", c="", d=None)
    found, covered = scan.scan_covered(df, ("rules", "graph"), extra={"own": broken})
    c = covered.first()
    assert (c.discovered, c.queued, c.analyzed, c.skipped, c.failed) == (4, 3, 2, 1, 1)
    kinds = {(r.file, r.type) for r in found.collect()}
    assert ("b.py", "Own") in kinds and ("a.py", "Own") not in kinds and any(f == "a.py" for f, _ in kinds)  # what failed cost no other's findings
    plain = scan.scan(df, ("rules", "graph"))
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r) for r in found.filter("type <> 'Own'").collect())
    errors = {r.path: r.errors for r in rules.status_of(rules.scanned(df, {"own": broken})).collect()}
    assert errors == {"a.py": "own: RuntimeError", "b.py": "", "c.py": "", "d.py": ""}


def test_whole_scan_equals_its_detectors_one_by_one(spark):
    """No detector changes or loses another's findings; dedup is that of a loop over an ordered list."""
    text = "import os\nname = request.args\nos.system(name)\npassword = 'hunter22x'\nhttp://a.example.org\neval(name)\nDEBUG = True\n"
    df = _files(spark, a=text, b=text * 3, c="")
    every = [r for d in scan.DEFAULT for r in scan.DETECTORS[d](df).select(RANKED.names).collect()]
    first: dict[tuple, tuple] = {}
    for r in sorted(every, key=lambda r: (r.stage, r.seq)):
        first.setdefault((r.file, r.line, r.type), r)
    groups: dict[tuple, list] = {}
    for r in first.values():
        groups.setdefault((r.file, r.line, r.severity, r.category.upper()), []).append(r)
    want = {(*k[:3], max(own, key=lambda r: (len(r.description), -r.stage, -r.seq)).type, min((r.stage, r.seq) for r in own)) for k, own in groups.items()}
    got = scan.scan(df).collect()
    assert {(r.file, r.line, r.severity, r.type, (r.stage, r.seq)) for r in got} == want and len(got) == len(want)
    assert findings.coverage(rules.status(df)).first().analyzed == 3
    assert len(tables.CONFIG_RULES) == 14
