"""Operators over small tables, and the registered queries against their SQL."""

import csv
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scanframe.operators import context, dependencies, findings, graph, rules, syntax
from scanframe.plans import queries, scan, views
from scanframe.schema import FILE, RANKED, STAGE
from scanframe.sources import files, reports, sinks
from scanframe.streaming import incremental

SF = "/root/testdata/sf0.001"


def make(spark, rows):
    return spark.createDataFrame([(f, n, t, s, "", d, c, a, st, q) for f, n, t, s, d, c, a, st, q in rows], RANKED)


def programs(spark, **named):
    rows = spark.createDataFrame([(p.replace("__", "/").replace("_dot_", "."), c) for p, c in named.items()], "path string, content string")
    return files.files_from_table(rows)


# ---- findings


def in_order(rows):
    """Both levels of dedup as one pass over the findings in order."""
    seen, groups, out = set(), {}, []
    for r in sorted(rows, key=lambda r: (r[7], r[8])):
        if r[:3] in seen:
            continue
        seen.add(r[:3])
        key = (r[0], r[1], r[5].upper(), r[3])
        if key not in groups:
            groups[key] = len(out)
            out.append([r, r[7], r[8]])
        elif len(r[4]) > len(out[groups[key]][0][4]):
            out[groups[key]][0] = r
    return sorted((r[0], r[1], r[2], r[3], r[4], s, q) for r, s, q in out)


def test_dedup_equals_one_pass(spark):
    rng = random.Random(7)
    rows = [
        (rng.choice("ab"), rng.randint(0, 3), rng.choice("xyz"), rng.choice(["HIGH", "LOW"]), "d" * rng.randint(0, 4), rng.choice(["Crypto", "CRYPTO", "auth"]), "p", rng.randint(0, 3), q)
        for q in range(400)
    ]
    got = sorted((r.file, r.line, r.type, r.severity, r.description, r.stage, r.seq) for r in findings.dedup(make(spark, rows)).collect())
    assert got == in_order(rows)


def test_semantic_dedup_takes_the_place_of_its_group(spark):
    rows = [("f", 1, "a", "LOW", "12345", "c", "p", 0, 1), ("f", 1, "b", "LOW", "123456789", "C", "p", 0, 2), ("f", 1, "c", "LOW", "abcdefghi", "c", "p", 0, 3)]
    assert [(r.type, r.seq) for r in findings.dedup(make(spark, rows)).collect()] == [("b", 1)]


def test_rank_and_counts(spark):
    rows = [("f", k, s, s, "d", "c", "pattern", 0, k) for k, s in enumerate(["MEDIUM", "ERROR", "CRITICAL", "INFO"])]
    df = make(spark, rows)
    assert [r.severity for r in findings.ranked(df).collect()] == ["CRITICAL", "MEDIUM", "ERROR", "INFO"]
    assert {r.severity: r.n for r in findings.severity_counts(df).collect()} == {"MEDIUM": 1, "ERROR": 1, "CRITICAL": 1, "INFO": 1}
    assert [r.id for r in findings.rollup(make(spark, [("f", 1, "t", "LOW", "d", "Crypto", "pattern", 0, 1)])).collect()] == ["PATT-CRYPTO"]


def test_coverage(spark):
    rows = spark.createDataFrame([("a", "analyzed")] * 4 + [("b", "failed"), ("c", "skipped")], "path string, status string")
    c = findings.coverage(rows).first()
    assert c.discovered == c.analyzed + c.failed + c.skipped == 6 and c.queued == 5


def test_failing_detector_costs_no_other(spark, monkeypatch):
    from scanframe.functions import source

    def broken(*_):
        raise RuntimeError

    monkeypatch.setattr(source, "scan_python", broken)
    got = list(rules.detect("a.py", ".py", "python", "eval(input())", [], []))
    assert any(isinstance(h, RuntimeError) for _, h in got) and any(h and not isinstance(h, Exception) for _, h in got)


# ---- detectors


def test_suspicious_files_and_empty_content(spark):
    df = programs(spark, a___dot_env="", b_dot_py="")
    df = files.files_from_table(spark.createDataFrame([("a/.env", ""), ("b.py", "")], "path string, content string"))
    assert [(r.file, r.line, r.severity, r.category) for r in scan.scan(df).collect()] == [("a/.env", 0, "HIGH", "CONFIG")]


def test_context_credentials(spark):
    rows = [
        ("src/app.py", 'password = "abcdefghijklmnop"\nx = 1'), ("tests/app.py", "api_key: 'sample-value'\nsecret = 'really-secret'"), ("src/b.js", "pwd = 'changeme'"),
        ("src/c.txt", 'password = "abcdefghijklmnop"'), ("src/d.php", "$db_password => 'p`q'; $token = `x`"),
    ]
    df = files.files_from_table(spark.createDataFrame(rows, "path string, content string"))
    got = [(r.file, r.line, r.severity, r.snippet) for r in context.context_findings(df).collect() if r.category == "AUTH"]
    assert sorted(got) == [("src/app.py", 1, "CRITICAL", f'password = "{"*" * 12}"'), ("tests/app.py", 2, "HIGH", f"secret = '{'*' * 12}'")]


def test_context_others(spark):
    rows = [
        ("a.js", 'db.query("select " + x)\n// db.query("a" + x)\ndb.query("constant")'), ("b.py", "ALLOWED_HOSTS = ['a', '*']\n@csrf_exempt\napp.run(debug=True)"),
        ("c.java", 'log("${jndi:ldap://x}")'), ("d.ts", "cors({ origin: '*' })"), ("test/e.py", "@csrf_exempt"),
    ]
    df = files.files_from_table(spark.createDataFrame(rows, "path string, content string"))
    got = sorted((r.file, r.line, r.severity, r.type.removeprefix("Context: ")) for r in context.context_findings(df).collect())
    assert got == [
        ("a.js", 1, "CRITICAL", "SQL built from dynamic string"), ("b.py", 1, "HIGH", "ALLOWED_HOSTS accepts all hosts"), ("b.py", 2, "MEDIUM", "@csrf_exempt used"),
        ("b.py", 3, "HIGH", "Flask debug mode in run()"), ("c.java", 1, "CRITICAL", "JNDI lookup payload"), ("d.ts", 1, "HIGH", "CORS allows any origin"), ("test/e.py", 1, "LOW", "@csrf_exempt used"),
    ]


def flows_of(found):
    return graph.flows(found)


def test_graph_flow(spark):
    text = "# c\na = request.args\nb = a\nopen(b)\neval(a)"
    df = files.files_from_table(spark.createDataFrame([("p.py", text)], "path string, content string"))
    found = graph.nodes(df)
    assert [(r.id, r.node_type, r.label, r.line) for r in found.orderBy("line").collect()] == [
        ("n1", "comment", "# c", 1), ("n2", "source", "request.args", 2), ("n3", "assignment", "b = a", 3), ("n4", "sink", "open", 4), ("n5", "sink", "eval", 5),
    ]
    data = {(r.source_id, r.target_id) for r in graph.data_edges(found).collect()}
    assert data == {("n2", "n2"), ("n2", "n3"), ("n2", "n5")}  # a use is a substring
    assert {(r.source_id, r.target_id) for r in graph.data_edges(found, words=True).collect()} == {("n2", "n3")}
    flows = graph.flows(found).collect()
    assert [(r.source, r.sink, r.vars) for r in flows] == [("request.args", "eval", ["request.args", "eval"])]
    both = [sorted(map(tuple, x.collect())) for x in (graph.findings(found, flows_of(found)), graph.graph_findings(df))]
    assert both[0] == both[1]
    assert {(r.type, r.severity) for r in graph.graph_findings(df).collect()} == {("Taint: request.args -> eval", "CRITICAL")}
    assert [r.line for r in graph.in_comment(found, found.select("path", "line")).collect()] == [1]


def test_reachability_ends_on_cycles(spark):
    pairs = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("q", "a", "b")], "path string, source_id string, target_id string")
    got = {(r.path, r.source_id, r.target_id) for r in graph.reachable(pairs).collect()}
    assert got == {("p", a, b) for a in "abc" for b in "abc"} | {("q", "a", "b")}


def test_unreachable(spark):
    df = files.files_from_table(spark.createDataFrame([("p.py", "def f():\n    return 1\n    x = 2\ny = 3")], "path string, content string"))
    assert [(r.path, r.line) for r in graph.unreachable(df).collect()] == [("p.py", 3)]


def test_manifests():
    p = dependencies.parse
    assert p("requirements.txt", "# c\n-r x.txt\nDjango>=3.1,<4\nrequests[security]==2.25.0\nplain") == [("Django", "3.1,"), ("requests", "2.25.0")]
    assert p("go.sum", "a/b v1.0.0 h\na/b v2.0.0 h\nc v3/go.mod h") == [("a/b", "v1.0.0"), ("c", "v3")]
    assert p("yarn.lock", '"@a/b@^1.0", "@a/b@^1.1":\n  version "1.2.3"\n\n"c@npm:^2":\n  version: 2.0.1\n') == [("@a/b", "1.2.3"), ("c", "2.0.1")]
    assert p("pom.xml", "<artifactId>a</artifactId>\n<groupId>g</groupId>\n<version>1</version>\n<version>2</version>") == [("a", "1")]
    assert p("package.json", "{broken") == p("composer.lock", "[]") == p("Pipfile.lock", "3") == []
    assert p("Gemfile.lock", "    rails (6.1.0)\n  x\n") == [("rails", "6.1.0")] and p("build.gradle", "implementation 'g:a:1.0'") == [("g:a", "1.0")]
    assert p("poetry.lock", 'name = "a"\nversion = "1"\nversion = "2"') == [("a", "1")] and p("Cargo.lock", '[[package]]\nversion = "1"') == []


def test_dependency_findings(spark):
    df = files.files_from_table(spark.createDataFrame([("requirements.txt", "django==3.2.5\nflask==1.0\nrequests>=2.25.0"), ("x.txt", "django==1.0")], "path string, content string"))
    assert sorted(r.snippet for r in dependencies.dependency_findings(df).collect()) == ["flask==1.0", "requests==2.25.0"]


def test_tree_searches(spark):
    df = files.files_from_table(spark.createDataFrame([("p.py", 'class A:\n    def f(self):\n        return os.system("a" + b)\n')], "path string, content string"))
    row = syntax.analysis(syntax.tree(df)).first()
    assert (row.functions, row.classes, row.string_concats, row.dangerous_calls) == (1, 1, 1, 1)
    assert [r.type for r in syntax.tree_findings(df).collect()] == ['Tree-sitter: os.system("a" + b)']
    assert [(r.line, r.func, r.fed) for r in syntax.calls(df).collect()] == [(3, "os.system", False)]


# ---- sources and sinks


def test_source_tree(spark, tmp_path):
    for path, data in {
        "src/.env": b"A=1\r\nB=2\rC", "src/__init__.py": b"", "node_modules/a.js": b"x", "src/a.js": b"ok\xff\xfe!", "src/deep/vendor/b.py": b"x", "_x/c.bin": b"x", "big.py": b"y" * 2000,
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {r.path: r for r in files.files_from_tree(spark, str(tmp_path), max_bytes=1000, files_per_task=2).collect()}
    assert set(got) == {"src/.env", "src/__init__.py", "src/a.js", "big.py"}
    assert got["src/.env"].content == "A=1\nB=2\nC" and got["src/a.js"].content == "ok!" and got["big.py"].content is None
    assert (got["src/a.js"].language, got["src/.env"].ext) == ("javascript", "")
    c = scan.scan_coverage(files.files_from_tree(spark, str(tmp_path), max_bytes=1000)).first()
    assert (c.discovered, c.analyzed, c.skipped, c.failed) == (4, 3, 1, 0)
    (tmp_path / "empty").mkdir()
    assert files.files_from_tree(spark, str(tmp_path / "empty")).count() == 0


def test_reports_take_defaults(spark):
    docs = spark.createDataFrame([('{"results": [{}]}',), ("broken",), ("{}",)], "value string")
    assert [tuple(r) for r in reports.semgrep(docs).collect()] == [("", 0, "Semgrep: unknown", "MEDIUM", "", "", "INJECTION", "semgrep")]
    assert [r.severity for r in reports.bandit(docs).collect()] == ["MEDIUM"]


def test_writers(spark, tmp_path):
    rows = [("a,b.py", 0, 'T"<1>', "CRITICAL", "d & é", "c", "pattern", 0, 1), ("z.py", 3, "u", "odd", "line\nend", "c", "taint", 0, 2)]
    df = make(spark, rows)
    for kind in sinks.DOCUMENTS:
        sinks.write_report(df, str(tmp_path / kind), kind)
    doc = json.loads((tmp_path / "json").read_text())
    assert doc["summary"] == {"total": 2, "critical": 1, "high": 0, "medium": 0, "low": 0} and [f["line"] for f in doc["findings"]] == [0, 3]
    raw = (tmp_path / "csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    assert lines[0][2] == "Threat" and lines[1][:3] == ["a,b.py", "0", 'T"<1>'] and lines[2][5] == "line\nend"
    page = (tmp_path / "html").read_text()
    assert "T&quot;&lt;1&gt;" in page and "<li>TOTAL: 2</li>" in page
    run = json.loads((tmp_path / "sarif").read_text())["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "warning"] and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} == {"PATT-C", "TAIN-C"}
    with pytest.raises(OSError):
        sinks.write_report(df, str(tmp_path / "no" / "dir"), "json")
    empty = make(spark, [])
    sinks.write_report(empty, str(tmp_path / "none"), "json")
    assert json.loads((tmp_path / "none").read_text())["findings"] == []


# ---- streams


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"d{k}/a.py", f"import os\neval(input())\nos.system(c{k})\n") for k in range(30)]
    df = files.files_from_table(spark.createDataFrame(rows + rows[:5], "path string, content string"))
    df.select(*FILE.names).repartition(6).write.parquet(str(tmp_path / "in"))
    delivered = []
    stream = incremental.file_stream(spark, str(tmp_path / "in"), files_per_trigger=2)
    q = incremental.start(stream, str(tmp_path / "found"), str(tmp_path / "cp"), lambda b, n: delivered.append((n, b.count())))
    q.awaitTermination()
    final = incremental.final(spark, str(tmp_path / "found"))
    batch = findings.dedup(rules.procedural(df))
    assert {(r.file, r.line, r.type) for r in final.collect()} == {(r.file, r.line, r.type) for r in batch.collect()}
    assert len(delivered) > 1 and sum(n for _, n in delivered) == spark.read.parquet(str(tmp_path / "found")).count()
    assert not q.isActive and incremental.progress(q)["active"] is False


def test_late_findings_count_within_the_delay(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "HIGH"), ("2024-01-01 00:07:00", "HIGH"), ("2024-01-01 00:02:00", "LOW")]
    spark.createDataFrame(rows, "ts string, severity string").selectExpr("cast(ts as timestamp) ts", "severity").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, severity string").parquet(str(tmp_path / "ev"))
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.severity, r.n) for r in spark.table("windowed").collect()) == [("HIGH", 1), ("HIGH", 1), ("LOW", 1)]


# ---- registered queries


def plain(v):
    if isinstance(v, float):
        return "NULL" if v != v else repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "NULL" if v is None else repr(v) if isinstance(v, (bool, str, list)) else repr(int(v)) if hasattr(v, "__int__") else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Filters and columns reach the scan, and detectors add no exchange."""
    explain = lambda df: df._jdf.queryExecution().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = files.files_from_table(docs.select(F.col("source").alias("path"), F.col("text").alias("content")))
    plan = explain(rules.procedural(df))
    assert "Exchange" not in plan and "ReadSchema: struct<text:string,source:string>" in plan
    found = graph.graph_findings(views.code(spark, SF))
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(path") == 1 and physical.count("Scan parquet") == 1
    assert explain(findings.top(make(spark, []), 5)).count("TakeOrderedAndProject") >= 1
    assert STAGE["file"] == 0


# ---- surfaces


def test_sql_functions(spark):
    import scanframe

    scanframe.register(spark)
    row = spark.sql("SELECT severity_rank('HIGH') a, version_key('v1.20') b, is_test_path('x/spec/y') c, is_placeholder('changeme') d").first()
    assert (row.a, [int(x) for x in row.b], row.c, row.d) == (1, [1, 20, 0, 0], True, True)
    got = spark.sql("SELECT t.type FROM VALUES ('eval(input())', '.py') f(c, e), LATERAL scan_rules(f.c, f.e) t").collect()
    assert [r.type for r in got] == ["Python eval(input)"]
    assert spark.sql("SELECT * FROM scan_taint('eval(input())', '.py')").count() == spark.sql("SELECT * FROM scan_python('os.system(x)')").count() == 1


def test_command(spark, tmp_path, monkeypatch):
    from scanframe import __main__

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("eval(input())\n")
    (tmp_path / "semgrep.json").write_text('{"results": [{"path": "%s/src/a.py", "check_id": "x", "start": {"line": 9}}]}' % tmp_path)
    (tmp_path / "s.json").write_text(json.dumps({"detectors": ["file", "rules"], "reports": {"semgrep": str(tmp_path / "semgrep.json")}}))
    out = __main__.main([str(tmp_path / "src"), "--report", str(tmp_path / "r.sarif"), "--kind", "sarif", "--settings", str(tmp_path / "s.json")])
    assert out["coverage"]["analyzed"] == 1 and out["summary"]["medium"] == 1 and out["summary"]["critical"] >= 1
    assert len(json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["results"]) == out["summary"]["total"]
