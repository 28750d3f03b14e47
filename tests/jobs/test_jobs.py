import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, exposure_report, text_watch
from jobs.queries import ORACLE_SQL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
KEY, HEX = "AKIA" + "A1B2C3D4E5F6G7H8", "token = \"" + "0a" * 20 + '"'
TEXTS = [
    f"a\r\nb {KEY} and {KEY}\n{HEX} {HEX}", f"x\n{HEX}", f"{KEY}", "password = 'hunter22x'\npassword: 'changeme'", "password = '${ENVIRONMENT}' secret: \"%s%d-long\"",
    "http://10.0.0.1/ http://a.example.org/\nhttp://localhost/ HTTP://B.example.org http://172.20.1.1/", "-----BEGIN RSA PRIVATE KEY-----", "Authorization: Bearer abcdefghijklmnopqrstuvwxyz",
    "postgres://me:pw@host/db", "debug: yes\nDEBUG = True", "Access-Control-Allow-Origin: *\nAccess-Control-Allow-Origin: req.headers.origin *", "get(verify=False)", "Server: 'x/1'", "Options +Indexes",
    "print(my_token)", "console.log(secret)", "params[", "logger.info('a' + b)", "FileField", "e.printStackTrace()", "TLSClientConfig{InsecureSkipVerify: true}", "", None,
    "\n".join(f"line {k} http://h{k}.example.org/" for k in range(2000)),
]
ROWS = [(k, t, None if k % 5 == 0 else f"s{k % 3}") for k, t in enumerate(TEXTS)]
ROWS += [ROWS[0], (None, HEX, "s1"), (1, f"{HEX}\n{KEY}", "s1")]  # repeats of a row, no id, an id again with another text


def _rows(df):
    names = sorted(df.columns)
    return Counter(tuple(r[c] for c in names) for r in df.collect())


def _sql(name, **views):
    con = duckdb.connect()
    for view, path in views.items():
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(r[k] for k in order) for r in found.fetchall())


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def grown(spark, tmp_path):
    """A folder with the documents of the table, and what adds the rows of this module to it."""
    folder = str(tmp_path / "documents")
    spark.read.parquet(DOCUMENTS).repartition(3).write.parquet(folder)
    own = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("content", F.lit(1)).withColumn("line", F.lit("x"))
    return folder, lambda: own.coalesce(1).write.mode("append").parquet(folder)


def test_watch_takes_only_what_is_new(spark, tmp_path, grown):
    folder, grow = grown
    out = str(tmp_path / "out")
    first = _rows(text_watch.run(spark, folder, out))
    assert first == _sql("job1_text_watch", documents=DOCUMENTS)
    before = _files(f"{out}/scanned") | _files(f"{out}/findings")
    grow()
    whole = _rows(text_watch.run(spark, folder, out, files_per_batch=1))
    expected = Counter({k: v for k, v in _sql("job1_text_watch", documents=f"{folder}/*.parquet").items()})
    assert whole == expected and len(whole) > len(first)
    after = _files(f"{out}/scanned") | _files(f"{out}/findings")
    assert before.items() <= after.items() and len(after) > len(before)
    # every rule of both sets has found something
    kinds = {r[0] for r in text_watch.findings(spark, out).select("type").distinct().collect()}
    assert kinds == {rule[0] for rule in common.catalogue(("secret", "config"))}
    # secrets are not in the output
    assert not text_watch.findings(spark, out).filter(F.concat_ws(" ", "snippet", "description").contains(KEY)).count()
    # nothing is new
    assert _rows(text_watch.run(spark, folder, out)) == whole
    assert _files(f"{out}/scanned") | _files(f"{out}/findings") == after


def test_a_batch_that_was_not_committed_replaces_itself(spark, tmp_path, grown):
    folder, grow = grown
    out = str(tmp_path / "out")
    text_watch.run(spark, folder, out)
    grow()
    whole = _rows(text_watch.run(spark, folder, out))
    for name in ("1", ".1.crc"):
        if os.path.exists(path := f"{out}/checkpoint/commits/{name}"):
            os.remove(path)
    assert _rows(text_watch.run(spark, folder, out)) == whole


def test_watch_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    assert text_watch.run(spark, str(tmp_path / "documents"), str(tmp_path / "out")).count() == 0


def _pages(spark, path):
    rows = [(1, "https://A.example.org/x", f"<p>{KEY}</p>"), (2, None, f"<p>\n{HEX}</p>"), (3, "nonsense", None), (4, "https://b.example.org?q", "clean"), (None, "https://a.example.org", f"{KEY}\n{KEY}")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("source", F.lit("x")).write.parquet(path)
    return path


def test_exposures(spark, tmp_path, grown):
    folder, grow = grown
    grow()
    pages, out = _pages(spark, str(tmp_path / "pages")), str(tmp_path / "out")
    found = exposure_report.run(spark, folder, pages, out)
    expected = _sql("job2_exposure_report", documents=f"{folder}/*.parquet", pages=f"{pages}/*.parquet")
    assert _rows(found) == expected
    key = found.filter(f"record = 'secret' AND key = 'sha256:' || sha2('{KEY}', 256)").first()
    assert (key.findings, key.files, key.sources, key.first_file) == (2 * 2 + 1 + 1 + 1 + 2, 5, 4, "none/0.txt")
    clean = found.filter("record = 'source' AND key = 'b.example.org'").first()
    assert (clean.texts, clean.findings, clean.severity, clean.risk) == (1, 0, None, 0)
    # a rerun replaces the report; one of other rules leaves nothing of the first
    assert _rows(exposure_report.run(spark, folder, pages, out)) == expected
    fewer = exposure_report.run(spark, folder, pages, out, rules=("secret",), weights={"HIGH": 1})
    assert fewer.filter("type = 'Insecure HTTP'").count() == 0
    assert fewer.filter("record = 'source' AND key = 'a.example.org'").first().risk == 0


def test_exposures_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert exposure_report.run(spark, str(tmp_path / "d"), str(tmp_path / "p"), str(tmp_path / "out")).count() == 0


def test_settings_stay_as_they_were(spark, tmp_path, grown):
    before = {k: v for k, v in spark.conf.getAll.items()}
    text_watch.run(spark, grown[0], str(tmp_path / "out"))
    exposure_report.run(spark, grown[0], _pages(spark, str(tmp_path / "pages")), str(tmp_path / "out2"))
    assert {k: v for k, v in spark.conf.getAll.items()} == before


def test_unknown_rules_are_refused(spark, tmp_path, grown):
    with pytest.raises(ValueError, match="no such rule sets"):
        text_watch.run(spark, grown[0], str(tmp_path / "out"), rules=("odd",))


@pytest.mark.parametrize("job, inputs", [("text_watch", ["documents"]), ("exposure_report", ["documents", "pages"])])
def test_command_line(tmp_path, job, inputs):
    folder = tmp_path / "documents"
    folder.mkdir()
    os.symlink(DOCUMENTS, folder / "a.parquet")
    paths = {"documents": str(folder), "pages": DOCUMENTS.replace("documents", "pages")}
    args = [x for i in inputs for x in (f"--{i}", paths[i])]
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", *args, "--output", str(tmp_path / "out"), "--config", f"{ROOT}/jobs/{job}.json"], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job}" in done.stderr and "wrote" in done.stderr
    assert _files(tmp_path / "out")
