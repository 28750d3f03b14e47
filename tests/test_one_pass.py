"""What a file costs: each thing is read, matched and shuffled once."""

import pyarrow as pa
from pyspark.sql import functions as F

from scanframe.functions import code
from scanframe.operators import context, graph, rules, syntax
from scanframe.plans import queries, views
from scanframe.streaming import incremental

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_lines_are_stripped_once(spark):
    assert graph.nodes(views.code(spark, SF))._jdf.queryExecution().optimizedPlan().toString().count("\\s+$") == 1


def test_comment_lines_read_the_programs_once(spark):
    assert "part.parquet" not in _plan(queries.graph_comment_lines(spark, SF))


def test_data_edges_shuffle_once(spark):
    assert _plan(graph.data_edges(graph.nodes(views.code(spark, SF)))).count("Exchange hashpartitioning") == 1


def test_summaries_are_those_of_edges_and_flows(spark):
    files = views.code(spark, SF).select("path", "language", "content")
    own = [("a.py", "python", "# only\n# comments\n"), ("b.py", "python", "v = request.args\nv = v + v\neval(v)\nw = v\n"), ("c.py", "python", "\n"), ("d.js", "javascript", "x = 1\n// x\nx = x\n")]
    files = files.unionByName(spark.createDataFrame(own, files.schema))
    found = graph.nodes(files)
    assert _rows(graph.summaries(files)) == _rows(graph.summary(found, graph.edges(found), graph.flows(found)))
    assert _plan(graph.summaries(files)).count("Exchange hashpartitioning") == 1


def test_white_space_is_no_match_of_tokens(spark):
    text = spark.createDataFrame([(" \n\t a  =\n b ( c )\n",)], "t string")
    assert text.select(F.size(F.regexp_extract_all("t", F.lit(code._alternation()), F.lit(0)))).first()[0] == 6
    kept = text.select(F.explode(code.tokens(F.col("t"))).alias("k")).select("k.value", "k.line", "k.col", "k.type").collect()
    assert [tuple(r) for r in kept] == [("a", 2, 2, "IDENT"), ("=", 2, 5, "OPERATOR"), ("b", 3, 1, "FUNCTION_CALL"), ("(", 3, 3, "PUNCTUATION"), ("c", 3, 5, "IDENT"), (")", 3, 7, "PUNCTUATION")]


def test_running_sums_join_once_a_value(spark):
    calls = []

    def add(a, x):
        calls.append(1)
        return a + x

    from scanframe.functions import columns as C

    df = spark.range(1).select(C.running(F.sequence(F.lit(1), F.lit(5000)), F.lit(0), add).alias("s"))
    assert df.first().s == [k * (k + 1) // 2 for k in range(5000)]
    assert "array_append" in df._jdf.queryExecution().analyzed().toString().lower()


def test_tasks_take_files_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["k"])
    parts = list(rules.in_parts([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert max(p.num_rows for p in parts) <= rules.FILES < 1000
    assert [k for p in parts for k in p.column(0).to_pylist()] == [*range(1000), 0, 1, 2]


def test_trees_are_built_once(spark):
    assert "MapInArrow" not in _plan(queries.tree_analysis(spark, SF))
    found = syntax.tree(spark.createDataFrame([("a.py", "python", "eval(f(x))\n(lambda: eval)()\nok()\n")], "path string, language string, content string"))
    assert [(r.line, r.text) for r in syntax.dangerous(found).orderBy("node_id").collect()] == [(1, "eval(f(x))"), (2, "(lambda: eval)()")]


def test_syntax_findings_are_those_of_the_scan(spark):
    files = views.code(spark, SF)
    assert _rows(rules.syntax_findings(files)) == _rows(rules.procedural(files).filter("analyzer = 'ast'"))


def test_streams_are_dealt_to_all_cores(spark, tmp_path):
    plan = incremental.stream_findings(incremental.file_stream(spark, str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan


def test_graph_findings_shuffle_nothing(spark):
    files = views.code(spark, SF).select("path", "language", "content")
    own = [("a.py", "python", "v = request.args\neval(v)\n"), ("a.py", "python", "x = 1\neval(v)\n"), ("b.py", "python", "\n")]
    assert "Exchange hashpartitioning" not in _plan(graph.graph_findings(files))
    few = spark.createDataFrame(own, files.schema).coalesce(1)
    assert [(r.file, r.line) for r in graph.graph_findings(few).filter("severity = 'CRITICAL'").collect()] == [("a.py", 2)]


def test_context_detectors_leave_files_alone_that_fail_the_cheap_test(spark):
    files = views.code(spark, SF)
    hits = context.detectors(F.col("content"), F.col("content"), F.col("ext"), F.col("path"))
    assert "slice(" not in files.select(*hits)._jdf.queryExecution().optimizedPlan().toString()


def test_only_telling_tokens_are_cut_out(spark):
    text = "// eval(a)\n" + "x = 'eval(b)' + c[1];\n" * 20_000 + "/* \n */ eval (x);\na.innerHTML /* b */ = c; a.innerHTML == c;\n"
    df = spark.createDataFrame([(text,)], "c string").select(code.token_hits(F.col("c"), F.lit(".js")).alias("h"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [(h.line, h.type) for h in df.first().h] == [(20_003, "Lexer: eval()"), (20_004, "Lexer: XSS sink 'innerHTML'")]
