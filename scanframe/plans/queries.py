"""All registered queries but those of the training-data subpackage, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.functions import source
from scanframe.operators import context, dependencies, findings, graph, prompts, rules, syntax
from scanframe.plans import rule_sql, scan, views
from scanframe.plans.stages import materialise, shared_dir
from scanframe.plans.views import CODE, DOCS, EXACT, FOUND, LEVEL, LINES, LINKS, PACKAGED, PATHS, RANK, UNIQUE, quoted, read
from scanframe.schema import RANKED
from scanframe.secrets_family import SECRET_RULES
from scanframe.sources import files, reports, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` follows the common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def _list(items) -> str:
    return ", ".join(map(quoted, items))


# ---------------------------------------------------------------- sources


@query(
    f"SELECT path, ext FROM named WHERE NOT (folder IN ({_list(tables.EXCLUDED_DIRS)})) AND "
    f"(ext IN ({_list(tables.TEXT_EXTS)}) OR name IN ({_list(tables.SUSPICIOUS_FILES)}) OR name IN ({_list(tables.MANIFESTS)}))",
    PATHS,
)
def wanted_files(spark, sf_dir):
    return files.wanted(views.paths(spark, sf_dir)).select("path", "ext")


@query(f"SELECT path FROM paths WHERE folder IN ({_list(tables.EXCLUDED_DIRS)})", PATHS)
def pruned_paths(spark, sf_dir):
    return views.paths(spark, sf_dir).filter(C.is_pruned(F.col("path"))).select("path")


@query(f"SELECT path FROM named WHERE ext = '.py' AND folder NOT IN ({_list(tables.EXCLUDED_DIRS)})", PATHS)
def python_files(spark, sf_dir):
    return files.python_files(views.paths(spark, sf_dir)).select("path")


@query("SELECT language, ext, count(*) AS files FROM code GROUP BY ALL", CODE)
def language_routing(spark, sf_dir):
    return scan.routed(views.code(spark, sf_dir))


@query("SELECT path, length(content) AS chars FROM docs", DOCS)
def read_files(spark, sf_dir):
    return views.docs(spark, sf_dir).select("path", F.length("content").cast("long").alias("chars"))


def _documents(spark, sf_dir, text):
    part = read(spark, sf_dir, "part")
    return part.select(F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string")).alias("value"))


BANDIT = '{"results": [{"filename": "/w/a{k}.py", "line_number": {s}, "test_id": "B105", "test_name": "password", "issue_severity": "low", "issue_text": "Possible: \'changeme\'", "code": "x"}, {"filename": "/w/b{k}.py", "line_number": {s}, "test_id": "B602", "test_name": "shell", "issue_severity": "high", "issue_text": "shell", "code": "call()"}]}'


@query("SELECT 'b' || p_partkey || '.py' AS file, p_size AS line, 'Bandit: B602 shell' AS type, 'HIGH' AS severity, 'call()' AS snippet, 'shell' AS description, 'BANDIT' AS category, 'bandit' AS analyzer FROM part")
def bandit_report(spark, sf_dir):
    return reports.bandit(_documents(spark, sf_dir, BANDIT), "/w")


SEMGREP = '{"results": [{"path": "/w/a{k}.js", "check_id": "rule.{s}", "start": {"line": {s}}, "extra": {"severity": "ERROR", "lines": "a\\\\n", "message": "m"}}, {"path": "/o/c.js"}]}'


@query(
    "SELECT unnest(['a' || p_partkey || '.js', '/o/c.js']) AS file, unnest([p_size, 0]) AS line, unnest(['Semgrep: rule.' || p_size, 'Semgrep: unknown']) AS type, unnest(['HIGH', 'MEDIUM']) AS severity, "
    "unnest(['a\\n', '']) AS snippet, unnest(['m', '']) AS description, 'INJECTION' AS category, 'semgrep' AS analyzer FROM part"
)
def semgrep_report(spark, sf_dir):
    return reports.semgrep(_documents(spark, sf_dir, SEMGREP), "/w")


TRIVY = '{"Results": [{"Target": "/w/lock{k}", "Vulnerabilities": [{"VulnerabilityID": "V-{s}", "PkgName": "p", "InstalledVersion": "1.{s}", "Severity": "high", "Title": "t"}, {"VulnerabilityID": "W", "FixedVersion": "2", "Description": "d"}]}, {"Target": "none"}]}'


@query(
    "SELECT 'lock' || p_partkey AS file, 0 AS line, unnest(['Trivy: V-' || p_size, 'Trivy: W']) AS type, unnest(['HIGH', 'MEDIUM']) AS severity, unnest(['p 1.' || p_size, ' ']) AS snippet, "
    "unnest(['t. Fixed in: N/A', 'd. Fixed in: 2']) AS description, 'DEPENDENCY' AS category, 'trivy' AS analyzer FROM part"
)
def trivy_report(spark, sf_dir):
    return reports.trivy(_documents(spark, sf_dir, TRIVY), "/w")


SARIF = '{"runs": [{"results": [{"ruleId": "R{s}", "level": "BLOCKER", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "/w/f{k}"}, "region": {"startLine": {s}}}}, {}]}, {"level": "odd"}]}]}'


@query(
    "SELECT unnest(['f' || p_partkey, '']) AS file, unnest([p_size, 0]) AS line, unnest(['Sonar: R' || p_size, 'Sonar: unknown']) AS type, unnest(['CRITICAL', 'MEDIUM']) AS severity, '' AS snippet, "
    "unnest(['t', '']) AS description, 'QUALITY' AS category, 'sonar' AS analyzer FROM part"
)
def sarif_report(spark, sf_dir):
    return reports.sarif(_documents(spark, sf_dir, SARIF), "/w")


@query("SELECT analyzer, count(*) AS n FROM (SELECT unnest(['bandit', 'semgrep', 'semgrep', 'trivy', 'trivy', 'sonar', 'sonar']) AS analyzer FROM part) GROUP BY 1")
def report_union(spark, sf_dir):
    parts = [(bandit_report, "bandit"), (semgrep_report, "semgrep"), (trivy_report, "trivy"), (sarif_report, "sonar")]
    return findings.union(*[findings.staged(f(spark, sf_dir), k) for f, k in parts]).groupBy("analyzer").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- predicates

_NAMED = "SELECT name, min(description) AS description FROM (VALUES {}) t(name, description) GROUP BY 1"


@query(
    f"SELECT path AS file, 0 AS line, 'Suspicious File (' || name || ')' AS type, description FROM paths JOIN (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in tables.SUSPICIOUS_FILES.items())}) t(name, description) USING (name)",
    PATHS,
)
def suspicious_files(spark, sf_dir):
    return rules.suspicious_files(views.paths(spark, sf_dir)).select("file", "line", "type", "description")


VALUES = ("changeme", "s3cr3t-value", "${ENV}", "abc", "<key>", "xxxxxxxx", "{{ x }}zz", "hunter22", " 'Password' ", "%s%d%s!", "a%sb%dcdef", "x*.·_-x", "")


@query(
    f"""SELECT value, n FROM (SELECT {views._pick(VALUES, "c_custkey")} AS value, count(*) AS n FROM customer GROUP BY 1) WHERE
    lower(trim(trim(value), '''"')) IN ({_list(tables.PLACEHOLDERS)}) OR length(trim(trim(value), '''"')) < 6 OR regexp_matches(lower(trim(trim(value), '''"')), '^[$%<{{\\[]|[}}>\\]]$')
    OR regexp_matches(lower(trim(trim(value), '''"')), '^[x*.·_-]*$') OR contains(value, '{{{{') OR contains(value, '{{%')
    OR (contains(value, '%') AND length(replace(replace(lower(trim(trim(value), '''"')), '%s', ''), '%d', '')) < 3)"""
)
def placeholder_values(spark, sf_dir):
    value = F.get(F.array(*map(F.lit, VALUES)), (F.col("c_custkey") % len(VALUES)).cast("int"))
    counted = read(spark, sf_dir, "customer").groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return counted.filter(C.is_placeholder(F.col("value")))


@query(
    "SELECT ok, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN false ELSE true END AS ok FROM part) GROUP BY 1",
)
def credible_matches(spark, sf_dir):
    k = F.col("p_partkey")
    match = F.when(k % 3 == 0, F.lit("password = '${SECRET}'")).when(k % 3 == 1, F.concat(F.lit('pwd: "k-'), "p_name", F.lit('" or \'x\''))).otherwise(F.lit("password = unquoted"))
    return read(spark, sf_dir, "part").groupBy(C.is_credible(match).alias("ok")).agg(F.count("*").alias("n"))


@query("SELECT path, regexp_matches(lower(path), 'test|spec|mock|fixture|e2e|integration') AS test FROM paths", PATHS)
def test_paths(spark, sf_dir):
    return views.paths(spark, sf_dir).select("path", C.is_test_path(F.col("path")).alias("test"))


@query(
    f"SELECT p_type AS kind, CASE {' '.join(f'WHEN contains(t, {quoted(n)}) THEN {quoted(f)}' for n, f in tables.FRAMEWORK_HINTS)} END AS framework, count(*) AS n "
    "FROM (SELECT p_type, lower('import ' || CASE p_partkey % 4 WHEN 0 THEN 'Flask' WHEN 1 THEN 'express' WHEN 2 THEN 'gin-gonic/django' ELSE 'os' END) AS t FROM part) GROUP BY ALL"
)
def frameworks(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.concat(F.lit("import "), F.when(k == 0, "Flask").when(k == 1, "express").when(k == 2, "gin-gonic/django").otherwise("os"))
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), C.framework_of(text).alias("framework")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\w])the($|[^\\w])')")
def word_uses(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.filter(C.holds_word(F.coalesce("text", F.lit("")), F.lit("the"))).select("doc_id")


@query("SELECT language, count(*) AS n FROM lines WHERE CASE WHEN language = 'python' THEN raw LIKE '#%' WHEN language = 'php' THEN regexp_matches(raw, '^(//|#|/\\*)') ELSE regexp_matches(raw, '^(//|/\\*|\\*)') END GROUP BY 1", CODE, LINES)
def comment_lines(spark, sf_dir):
    lines = views.code(spark, sf_dir).select("language", F.explode(F.split("content", "\n")).alias("s"))
    return lines.filter(C.is_comment_line(C.strip(F.col("s")), F.col("language"))).groupBy("language").agg(F.count("*").alias("n"))


@query(f"SELECT severity, min(least({RANK}, 4)) AS rank, count(*) AS n FROM found GROUP BY 1", FOUND)
def severity_ranks(spark, sf_dir):
    f = views.found(spark, sf_dir)
    return f.groupBy("severity").agg(F.min(C.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n"))


@query(
    "SELECT 'f' || l_orderkey AS file, min(l_linenumber)::INTEGER AS line, 'Taint: v' || l_orderkey % 9 || ' -> eval' AS type, 'CRITICAL' AS severity, 'v' || l_orderkey % 9 || ' -> eval' AS snippet, "
    "'Taint flow: variable ''v' || l_orderkey % 9 || ''' (line 1) flows into dangerous sink ''eval'' (line ' || min(l_linenumber) || '). Path: a -> b' AS description, 'INJECTION' AS category, 'taint' AS analyzer FROM lineitem GROUP BY l_orderkey"
)
def taint_paths(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("sink_line"))
    rows = li.select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"), F.lit(1).alias("source_line"), F.concat(F.lit("v"), (F.col("l_orderkey") % 9).cast("string")).alias("source_var"),
        "sink_line", F.lit("eval").alias("sink_func"), F.array(F.lit("a"), F.lit("b")).alias("path_vars"), F.lit(None).cast("string").alias("severity"),
    )
    return findings.taint_path_findings(rows)


# ---------------------------------------------------------------- text and rules


@query("SELECT path, count(*) AS lines FROM (SELECT path, unnest(string_split(content, chr(10))) FROM docs) GROUP BY 1", DOCS)
def line_counts(spark, sf_dir):
    return views.docs(spark, sf_dir).select("path", F.size(F.split("content", "\n")).cast("long").alias("lines"))


#: What is neither comment nor string in the programs, runs of spaces taken together.
SQUEEZED = """squeezed AS (
  SELECT path, ext, regexp_replace(regexp_replace(content, CASE WHEN ext IN ('.py', '.php') THEN '#[^\\n]*|"[^"]*"|''[^'']*''' ELSE '//[^\\n]*|"[^"]*"|''[^'']*''' END, ' ', 'g'), ' +', ' ', 'g') AS clean
  FROM code)"""
_TOKENS = r"regexp_extract_all(clean, '\$\w+|\w+|[+*/%=<>!&|^~?:-]+|[(){}\[\];,.]')"


@query("SELECT path, clean, len(string_split(clean, chr(10))) AS lines FROM squeezed", CODE, SQUEEZED)
def blanked_code(spark, sf_dir):
    clean = F.regexp_replace("clean", " +", " ")
    return rules.blanked(views.code(spark, sf_dir)).select("path", clean.alias("clean"), F.size(F.split("clean", "\n")).alias("lines"))


@query("SELECT path, line::INTEGER AS line FROM lines WHERE NOT CASE WHEN ext IN ('.py', '.php') THEN raw LIKE '#%' ELSE raw LIKE '//%' END", CODE, LINES)
def code_line_numbers(spark, sf_dir):
    return rules.code_lines(views.code(spark, sf_dir)).select("path", F.explode("lines").alias("line"))


def _rule_sql(view: str, name: str, pattern: str, severity: str, category: str, description: str) -> str:
    return f"""m AS (SELECT path, content, regexp_extract_all(content, {quoted("(?i)" + pattern)}) AS ms, string_split_regex(content, {quoted("(?i)" + pattern)}) AS ps FROM {view} WHERE regexp_matches(content, {quoted("(?i)" + pattern)})),
k AS (SELECT path, content, unnest(range(1, len(ms) + 1)) AS k, ms, ps FROM m),
n AS (SELECT path, content, k, 1 + length(t) - length(replace(t, chr(10), '')) AS line FROM (SELECT path, content, k, array_to_string(ms[1:k - 1], '') || array_to_string(ps[1:k], '') AS t FROM k))
SELECT path AS file, line::INTEGER AS line, {quoted(name)} AS type, {quoted(severity)} AS severity, left(trim(string_split(content, chr(10))[line]), 120) AS snippet, {quoted(description)} AS description,
       {quoted(category)} AS category, 'pattern' AS analyzer, 2 AS stage, k AS seq FROM n"""


TOKEN_RULE = ("Hex Token", 'token\\s*=\\s*"[0-9a-f]{40}"', "HIGH", "SECRET", "A 40-digit token is assigned in plain text.")
NUMBER_RULE = ("Number And Word", r"[0-9]{3}\s+[A-Za-z]", "INFO", "QUALITY", "A number stands before a word.")
HTTP_RULE = ("Insecure HTTP", "http://", "LOW", "NETWORK", "HTTP instead of HTTPS.")


@query(_rule_sql("docs", *TOKEN_RULE), DOCS)
def rule_token_lines(spark, sf_dir):
    return rules.match_native(views.docs(spark, sf_dir), *TOKEN_RULE)


@query(_rule_sql("docs", *NUMBER_RULE), DOCS)
def rule_number_lines(spark, sf_dir):
    return rules.match_native(views.docs(spark, sf_dir), *NUMBER_RULE)


@query(_rule_sql("pages_", *NUMBER_RULE), views.PAGES)
def rule_page_lines(spark, sf_dir):
    """The content of web pages under a rule."""
    return rules.match_native(views.pages(spark, sf_dir), *NUMBER_RULE)


# keep the CTE lists of the rule queries whole: their own expressions follow the views'
for _name, _table in (("rule_token_lines", "documents"), ("rule_number_lines", "documents"), ("rule_page_lines", "pages")):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(f"FROM {_table}) m AS", f"FROM {_table}), m AS")


@query("SELECT path AS file, 1 AS line, 'Insecure HTTP' AS type, content AS snippet FROM links WHERE contains(content, 'http://')", LINKS)
def insecure_http(spark, sf_dir):
    """The rule that leaves out private hosts, in native expressions; the urls have none."""
    rule = next(r for r in tables.CONFIG_RULES if r[0] == "Insecure HTTP")
    return rules.match_native(views.links(spark, sf_dir), *rule).select("file", "line", "type", "snippet")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE contains(lower(content), 'http://')) AS passed FROM links", LINKS)
def needle_prefilter(spark, sf_dir):
    from scanframe.functions.source import needle

    rule = next(r for r in tables.CONFIG_RULES if r[0] == "Insecure HTTP")
    passed = F.contains(F.lower("content"), F.lit(needle(rule[1])))
    return views.links(spark, sf_dir).agg(F.count("*").alias("files"), F.count_if(passed).alias("passed"))


_OWN_RULES = ", ".join(f"({quoted(e)}, {quoted(r[0])})" for r in tables.LANGUAGE_RULES for e in r[5].split())


@query(f"SELECT ext, count(*) AS files, (SELECT count(*) FROM (VALUES {_OWN_RULES}) r(own, name) WHERE own = ext) + {len(tables.CONFIG_RULES)} AS rules FROM named GROUP BY ext", PATHS)
def rule_catalogue(spark, sf_dir):
    """The files of each extension, and the rules that they are judged by: their own and those for all."""
    catalogue = rules.rules_table(spark)
    own = catalogue.filter("ext IS NOT NULL").groupBy("ext").agg(F.count("*").alias("own"))
    shared = len(tables.CONFIG_RULES)
    counted = views.paths(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("files")).join(F.broadcast(own), "ext", "left")  # a row an extension that has rules
    return counted.select("ext", "files", (F.coalesce("own", F.lit(0)) + shared).alias("rules"))


@query(
    "SELECT type, count(*) AS n FROM (SELECT 'Insecure HTTP' AS type FROM links WHERE contains(content, 'http://')) GROUP BY 1",
    LINKS,
)
def catalogue_on_links(spark, sf_dir):
    """The whole catalogue in Arrow batches; of it the urls hit one rule."""
    return rules.procedural(views.links(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


#: The rules that run on every text, and what they find in documents, urls, pages and programs.
EVERYWHERE = (*SECRET_RULES, *tables.CONFIG_RULES)
_HITS = f"hits AS ({rule_sql.found(EVERYWHERE)})"


@query("SELECT type, count(*) AS n FROM hits GROUP BY 1", DOCS, "texts AS (SELECT path AS file, content FROM docs)", _HITS)
def catalogue_on_documents(spark, sf_dir):
    """Documents through the whole catalogue in Arrow batches: how often each rule is met."""
    return rules.procedural(views.docs(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


_TEXTS = "texts AS (SELECT path AS file, content FROM docs UNION ALL SELECT path, content FROM links UNION ALL SELECT path, content FROM pages_ UNION ALL SELECT path, content FROM code)"


def _everything(spark, sf_dir):
    return views.docs(spark, sf_dir).unionByName(views.links(spark, sf_dir)).unionByName(views.pages(spark, sf_dir)).unionByName(views.code(spark, sf_dir))


@query("SELECT file, line, type, severity, category, description FROM hits", DOCS, LINKS, views.PAGES, CODE, _TEXTS, _HITS)
def native_catalogue(spark, sf_dir):
    """Secret and configuration rules on every text, in native expressions."""
    return rules.occurrences(_everything(spark, sf_dir), EVERYWHERE).select("file", "line", "type", "severity", "category", "description")


_NEEDLES = ", ".join(f"({quoted(r[0])}, [{_list(source.needles(r[1]))}])" for r in EVERYWHERE)


@query(
    f"SELECT type, count(*) AS n FROM texts JOIN (VALUES {_NEEDLES}) r(type, needles) ON len(list_filter(needles, lambda x: contains(lower(content), x))) > 0 GROUP BY 1",
    DOCS, LINKS, views.PAGES, CODE, _TEXTS,
)
def rule_candidates(spark, sf_dir):
    """How many texts each rule is tried on, by the literals that its matches require."""
    may = rules.may_match(F.col("content"), EVERYWHERE)
    return _everything(spark, sf_dir).select(F.explode(may).alias("r")).groupBy(F.col("r.type").alias("type")).agg(F.count("*").alias("n"))


#: What the rule, token, syntax-tree and taint detectors find in the programs, by hand.
EXPECTED = (
    ('.py', 10, 'AST: hardcoded password'),
    ('.py', 13, 'AST: os.system'),
    ('.py', 14, 'AST: weak hash (MD5)'),
    ('.py', 16, 'AST: binds 0.0.0.0'),
    ('.py', 13, 'Python os.system'),
    ('.py', 14, 'Python hashlib.md5'),
    ('.py', 16, 'Python django DEBUG'),
    ('.py', 16, 'Python flask debug'),
    ('.py', 9, 'Taint: query -> execute'),
    ('.py', 12, 'Taint: name -> eval'),
    ('.py', 13, 'Taint: name -> os.system'),
    ('.py', 16, 'Debug Mode'),
    ('.py', 11, 'Hex Token'),
    ('.py', 10, 'Hardcoded Credential'),
    ('.js', 8, 'Lexer: eval()'),
    ('.js', 6, "Lexer: XSS sink 'innerHTML'"),
    ('.js', 8, 'JS eval'),
    ('.js', 6, 'JS innerHTML'),
    ('.js', 5, 'JS document.write'),
    ('.js', 10, 'Insecure Random (JS)'),
    ('.js', 5, 'Taint: html -> document.write'),
    ('.js', 6, 'Taint: html -> innerHTML'),
    ('.js', 7, 'Taint: name -> query'),
    ('.js', 8, 'Taint: html -> eval'),
    ('.js', 9, 'Insecure HTTP'),
    ('.java', 7, 'Lexer: exec()'),
    ('.java', 7, 'Java Runtime.exec'),
    ('.java', 6, 'Taint: sql -> Statement.execute'),
    ('.java', 7, 'Taint: name -> Runtime.exec'),
    ('.php', 6, 'Lexer: system()'),
    ('.php', 6, 'PHP system'),
    ('.php', 7, 'PHP include variable'),
    ('.php', 5, 'Taint: name -> echo'),
    ('.php', 6, 'Taint: name -> exec'),
    ('.php', 7, 'Taint: name -> include'),
    ('.php', 9, 'Taint: name -> query'),
)
_EXPECTED = f"expected(ext, line, type) AS (VALUES {', '.join(f'({quoted(e)}, {n}, {quoted(t)})' for e, n, t in EXPECTED)})"


@query("SELECT path AS file, line, type FROM code JOIN expected USING (ext)", CODE, _EXPECTED)
def language_rules_on_code(spark, sf_dir):
    return rules.procedural(views.code(spark, sf_dir)).select("file", "line", "type")


@query(f"SELECT path, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS value FROM (SELECT path, {_TOKENS} AS t FROM squeezed)", CODE, SQUEEZED)
def code_tokens(spark, sf_dir):
    return rules.tokenize(views.code(spark, sf_dir)).select("path", "pos", "value")


@query(f"SELECT path, len({_TOKENS}) AS tokens, 0 AS rank, path LIKE 'tests/%' AS test, false AS dots, true AS short FROM squeezed", CODE, SQUEEZED)
def sql_functions(spark, sf_dir):
    """The scan functions in SQL text."""
    from scanframe.functions import sql

    sql.register(spark)
    text = "SELECT f.path, count(*) AS tokens, min(severity_rank('CRITICAL')) AS rank, is_test_path(f.path) AS test, is_placeholder('a.path.' || f.path) AS dots, is_placeholder(left(f.path, 5)) AS short FROM {files} f, LATERAL tokenize(f.content) t GROUP BY 1"
    return spark.sql(text, files=views.code(spark, sf_dir))


@query(
    "SELECT path, line::INTEGER AS line, regexp_extract(raw, '(eval|exec|system)\\(', 1) AS value, CASE ext WHEN '.js' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM lines "
    "WHERE (ext = '.js' AND raw LIKE 'eval(%') OR (ext = '.java' AND raw LIKE '%.exec(%') OR (ext = '.php' AND raw LIKE 'system(%')",
    CODE,
    LINES,
)
def dangerous_calls(spark, sf_dir):
    return rules.dangerous_calls(rules.tokenize(views.code(spark, sf_dir))).select("path", "line", "value", "severity")


@query("SELECT path, line::INTEGER AS line, 'innerHTML' AS value FROM lines WHERE ext = '.js' AND raw LIKE '%innerHTML =%'", CODE, LINES)
def markup_writes(spark, sf_dir):
    return rules.markup_writes(rules.tokenize(views.code(spark, sf_dir))).select("path", "line", "value")


# ---------------------------------------------------------------- context detectors

_TEST = "regexp_matches(lower(path), 'test|spec|mock|fixture|e2e|integration')"


@query(
    f"SELECT path AS file, line::INTEGER AS line, severity, type FROM (SELECT path, line, 'CRITICAL' AS severity, 'Context: JNDI lookup payload' AS type FROM lines WHERE regexp_matches(raw, '\\$\\{{jndi:ldap://') "
    f"UNION ALL SELECT path, line, CASE WHEN {_TEST} THEN 'LOW' ELSE 'HIGH' END, 'Context: ALLOWED_HOSTS accepts all hosts' FROM lines WHERE raw LIKE 'ALLOWED_HOSTS = %*%' "
    f"UNION ALL SELECT path, line, CASE WHEN {_TEST} THEN 'LOW' ELSE 'HIGH' END, 'Context: Flask debug mode in run()' FROM lines WHERE raw LIKE '%.run(%debug=True%')",
    CODE,
    LINES,
)
def context_lines(spark, sf_dir):
    found = context.context_findings(views.code(spark, sf_dir))
    return found.filter("type NOT LIKE '%credential' AND type NOT LIKE '%dynamic string'").select("file", "line", "severity", "type")


@query(
    f"""SELECT path AS file, line::INTEGER AS line, CASE WHEN {_TEST} THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
    replace(raw, v, repeat('*', least(length(v), 12))) AS snippet,
    'Credential ''' || regexp_extract(raw, '(password|secret)', 1) || ''' hardcoded in ' || ext || ' source. Move to environment variables or a secrets manager.' AS description
    FROM (SELECT *, regexp_extract(raw, 'password = "([^"]{{6,}})"', 1) AS v FROM lines WHERE ext = '.py') WHERE v <> ''""",
    CODE,
    LINES,
)
def context_credentials(spark, sf_dir):
    found = context.context_findings(views.code(spark, sf_dir))
    return found.filter("type = 'Context: hardcoded credential'").select("file", "line", "severity", "snippet", "description")


@query(
    f"SELECT path AS file, line::INTEGER AS line, CASE WHEN {_TEST} THEN 'MEDIUM' ELSE 'CRITICAL' END AS severity, 'db.query(' || repeat(' ', 9) || ' + name);' AS snippet FROM lines WHERE ext = '.js' AND raw LIKE 'db.query(%'",
    CODE,
    LINES,
)
def context_sql(spark, sf_dir):
    found = context.context_findings(views.code(spark, sf_dir))
    return found.filter("type LIKE '%dynamic string'").select("file", "line", "severity", "snippet")


# ---------------------------------------------------------------- syntax trees, taint


@query(
    "SELECT path, unnest([8, 9, 12, 13, 14, 16])::INTEGER AS line, unnest(['open', 'cursor.execute', 'eval', 'os.system', 'hashlib.md5', 'app.run']) AS func, "
    "unnest([false, true, false, false, false, false]) AS fed FROM code WHERE ext = '.py'",
    CODE,
)
def python_calls(spark, sf_dir):
    return syntax.calls(views.code(spark, sf_dir)).select("path", "line", "func", "fed")


@query(
    "SELECT path, 1 AS functions, 0 AS classes, 2 AS string_concats, 3 AS dangerous_calls FROM code WHERE ext = '.py'",
    CODE,
)
def tree_analysis(spark, sf_dir):
    return syntax.analysis(materialise(syntax.tree(views.code(spark, sf_dir)), "tree"))


@query(
    "SELECT path, unnest(['function_definition', 'binary_operator', 'binary_operator']) AS type, unnest([7, 6, 13])::INTEGER AS line, "
    "unnest(['def load(path):' || chr(10) || '    return open(path)', '\"select \" + name', '\"ls \" + name']) AS text FROM code WHERE ext = '.py'",
    CODE,
)
def tree_definitions(spark, sf_dir):
    t = syntax.tree(views.code(spark, sf_dir))
    return syntax.functions(t).unionByName(syntax.classes(t)).unionByName(syntax.joined_strings(t)).select("path", "type", "line", "text")


@query(
    "SELECT path AS file, unnest([9, 12, 13])::INTEGER AS line, 'Tree-sitter: ' || unnest(['cursor.execute(query)', 'eval(name)', 'os.system(\"ls \" + name)']) AS type FROM code WHERE ext = '.py'",
    CODE,
)
def tree_findings(spark, sf_dir):
    return syntax.tree_findings(views.code(spark, sf_dir)).select("file", "line", "type")


@query(
    "SELECT type, count(*) AS n FROM (SELECT unnest(['AST: eval() with user input', 'AST: os.system', 'AST: binds 0.0.0.0', 'AST: weak hash (MD5)', 'AST: hardcoded password']) AS type, ext, content FROM code) "
    "WHERE ext = '.py' AND type IN ('AST: os.system', 'AST: binds 0.0.0.0', 'AST: weak hash (MD5)', 'AST: hardcoded password') GROUP BY 1",
    CODE,
)
def syntax_findings(spark, sf_dir):
    return rules.syntax_findings(views.code(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT path AS file, line, type FROM code JOIN expected USING (ext) WHERE type LIKE 'Taint: %'", CODE, _EXPECTED)
def taint_findings(spark, sf_dir):
    return rules.taint_findings(views.code(spark, sf_dir)).select("file", "line", "type")


# ---------------------------------------------------------------- a file for each thing to find


def _cases(found: DataFrame) -> DataFrame:
    return found.select("file", "line", "type", "severity")


@query(views.cases_sql("ast"))
def syntax_cases(spark, sf_dir):
    """Every detector of Python's syntax trees, on what it must find and what it must not."""
    return _cases(rules.procedural(views.cases(spark, sf_dir, "ast")).filter("analyzer = 'ast'"))


@query(views.cases_sql("config"))
def config_cases(spark, sf_dir):
    """Every configuration rule."""
    return _cases(rules.procedural(views.cases(spark, sf_dir, "config")))


@query(views.cases_sql("context"))
def context_cases(spark, sf_dir):
    """The configuration checks of the context detectors that the programs do not hold."""
    return _cases(context.context_findings(views.cases(spark, sf_dir, "context")))


@query(views.cases_sql("taint"))
def taint_cases(spark, sf_dir):
    """Every dialect of the taint tracker."""
    return _cases(rules.taint_findings(views.cases(spark, sf_dir, "taint")))


@query(views.cases_sql("lexer"))
def token_cases(spark, sf_dir):
    """Every dangerous call and every name that writes markup, and their look-alikes."""
    return _cases(rules.token_findings(views.cases(spark, sf_dir, "lexer")))


# ---------------------------------------------------------------- property graph


def _choice(language: str, names: dict, bare: str) -> str:
    return f"list_filter([{_list(sorted(names[language]))}], lambda x: contains(s, rtrim(x, {quoted(bare)})))[1]"


def _by_language(choose) -> str:
    return "CASE language " + " ".join(f"WHEN {quoted(k)} THEN {choose(k)}" for k in graph.LANGUAGES) + " END"


def _function(k: str) -> str:
    p = quoted(tables.FUNCTION_PATTERNS[k])
    groups = [f"nullif(regexp_extract(s, {p}, {g}), '')" for g in graph._function_groups(k)]
    return f"CASE WHEN regexp_matches(s, {p}) THEN coalesce({', '.join(groups)}) END"


def _variable(k: str, g: int) -> str:
    return f"CASE WHEN regexp_matches(s, {quoted(graph._assignment(k))}) THEN regexp_extract(s, {quoted(graph._assignment(k))}, {g}) END"


NODES = f"""parsed AS (
  SELECT path, language, line, s, CASE WHEN language = 'python' THEN s LIKE '#%' WHEN language = 'php' THEN regexp_matches(s, '^(//|#|/\\*)') ELSE regexp_matches(s, '^(//|/\\*|\\*)') END AS is_comment,
         {_by_language(_function)} AS function, {_by_language(lambda k: _variable(k, 1))} AS v, {_by_language(lambda k: _variable(k, 2))} AS val,
         {_by_language(lambda k: _choice(k, tables.GRAPH_SINKS, "("))} AS sink, {_by_language(lambda k: _choice(k, tables.GRAPH_SOURCES, "(["))} AS source,
         CASE language WHEN 'python' THEN contains(s, 'f"') OR contains(s, 'f''') OR contains(s, '%') OR contains(s, '.format(') WHEN 'javascript' THEN contains(s, chr(96)) OR contains(s, '+')
              WHEN 'java' THEN contains(s, '+') AND (contains(s, '"') OR contains(s, 'String')) ELSE contains(s, '.') AND contains(s, '"') END AS joined
  FROM (SELECT path, language, line, trim(raw) AS s FROM lines) WHERE s <> ''),
kinds AS (
  SELECT *, CASE WHEN is_comment THEN 'comment' WHEN joined THEN 'string_concat' WHEN source IS NOT NULL THEN 'source' WHEN sink IS NOT NULL THEN 'sink'
                 WHEN v IS NOT NULL THEN 'assignment' WHEN function IS NOT NULL THEN 'function' END AS node_type FROM parsed),
nodes AS (
  SELECT path, 'n' || row_number() OVER (PARTITION BY path ORDER BY line) AS id, node_type,
         CASE node_type WHEN 'comment' THEN s WHEN 'string_concat' THEN left(s, 60) WHEN 'source' THEN rtrim(source, '([') WHEN 'sink' THEN rtrim(sink, '(')
              WHEN 'assignment' THEN v || ' = ' || left(coalesce(val, ''), 50) ELSE function END AS label,
         line::INTEGER AS line, language, CASE WHEN NOT is_comment THEN v END AS variable, CASE WHEN NOT is_comment THEN val END AS value,
         node_type = 'source' AS is_source, node_type = 'sink' AS is_sink, is_comment
  FROM kinds WHERE node_type IS NOT NULL)"""
CONTROL = "control AS (SELECT * FROM (SELECT path, lag(id) OVER (PARTITION BY path ORDER BY line) AS source_id, id AS target_id, 'flows_to' AS edge_type, '' AS label FROM nodes WHERE NOT is_comment) WHERE source_id IS NOT NULL)"
DATA = """data AS (
  SELECT d.path, d.id AS source_id, u.id AS target_id, 'data_flow' AS edge_type, d.variable || ' flows to' AS label
  FROM nodes d JOIN nodes u ON d.path = u.path AND d.variable IS NOT NULL AND NOT u.is_comment
   AND (contains(u.label, d.variable) OR (u.node_type = 'assignment' AND contains(coalesce(u.value, ''), d.variable))) AND NOT (d.id = u.id AND d.node_type = 'assignment'))"""


@query("SELECT * FROM nodes", CODE, LINES, NODES)
def graph_nodes(spark, sf_dir):
    return graph.nodes(views.code(spark, sf_dir))


@query("SELECT node_type, count(*) AS n FROM nodes GROUP BY 1", CODE, LINES, NODES)
def graph_node_types(spark, sf_dir):
    return graph.nodes(views.code(spark, sf_dir)).groupBy("node_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM control", CODE, LINES, NODES, CONTROL)
def graph_control_edges(spark, sf_dir):
    return graph.control_edges(graph.nodes(views.code(spark, sf_dir)))


@query("SELECT * FROM data", CODE, LINES, NODES, DATA)
def graph_data_edges(spark, sf_dir):
    return graph.data_edges(graph.nodes(views.code(spark, sf_dir)))


REACH = """RECURSIVE e AS (SELECT DISTINCT l_orderkey AS path, l_partkey % 7 AS source_id, l_suppkey % 7 AS target_id FROM lineitem),
r AS (SELECT path, source_id, target_id FROM e UNION SELECT r.path, r.source_id, e.target_id FROM r JOIN e ON r.path = e.path AND r.target_id = e.source_id)"""


@query("SELECT path, source_id, target_id FROM r", REACH)
def graph_reachability(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return graph.reachable(li.select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 7).alias("source_id"), (F.col("l_suppkey") % 7).alias("target_id")))


def _flows(spark, sf_dir):
    found = graph.nodes(views.code(spark, sf_dir))
    return found, graph.flows(found)


FLOWS = """RECURSIVE walk AS (SELECT path, source_id, target_id FROM data UNION SELECT w.path, w.source_id, d.target_id FROM walk w JOIN data d ON w.path = d.path AND w.target_id = d.source_id)"""


#: Walks of so many edges are spelled out; the programs' longest shortest walk has fewer.
STEPS = 5


def _walks() -> str:
    """The first of the shortest walks from each source to each node, an edge more a table."""
    number = "substr({}, 2)::INTEGER"
    parts = [
        "reached0 AS (SELECT path, id AS source_id, id AS goal, [substr(id, 2)::INTEGER] AS walk FROM nodes WHERE is_source)",
    ]
    for k in range(1, STEPS + 1):
        before = " UNION ALL ".join(f"SELECT path, source_id, goal FROM reached{j}" for j in range(k))
        step = f"SELECT r.path, r.source_id, d.target_id AS goal, list_append(r.walk, {number.format('d.target_id')}) AS walk FROM reached{k - 1} r JOIN data d ON r.path = d.path AND r.goal = d.source_id"
        parts.append(f"reached{k} AS (SELECT * FROM ({step}) s WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.path = s.path AND b.source_id = s.source_id AND b.goal = s.goal) QUALIFY row_number() OVER (PARTITION BY path, source_id, goal ORDER BY walk) = 1)")
    parts.append("walked AS (" + " UNION ALL ".join(f"SELECT * FROM reached{k}" for k in range(1, STEPS + 1)) + ")")
    parts.append("shown AS (SELECT path, substr(id, 2)::INTEGER AS n, CASE WHEN node_type = 'assignment' AND variable IS NOT NULL THEN variable ELSE label END AS name FROM nodes)")
    return ", ".join(parts)


@query(
    "SELECT w.path, w.source_id, w.goal AS sink_id, any_value(a.label) AS source, any_value(b.label) AS sink, any_value(a.line) AS source_line, any_value(b.line) AS sink_line, list(s.name ORDER BY w.k) AS vars "
    "FROM (SELECT path, source_id, goal, unnest(walk) AS n, generate_subscripts(walk, 1) AS k FROM walked) w JOIN nodes a ON a.path = w.path AND a.id = w.source_id "
    "JOIN nodes b ON b.path = w.path AND b.id = w.goal AND b.is_sink JOIN shown s ON s.path = w.path AND s.n = w.n GROUP BY w.path, w.source_id, w.goal",
    CODE,
    LINES,
    NODES,
    DATA,
    _walks(),
)
def graph_flows(spark, sf_dir):
    return _flows(spark, sf_dir)[1]


@query(
    """SELECT path, count(*) AS total_nodes, count(*) FILTER (WHERE is_source) AS sources, count(*) FILTER (WHERE is_sink) AS sinks, count(*) FILTER (WHERE is_comment) AS comments,
    count(*) FILTER (WHERE node_type = 'string_concat') AS string_concatenations, count(*) FILTER (WHERE node_type = 'function') AS functions,
    any_value(e.n) AS total_edges, any_value(coalesce(t.n, 0)) AS taint_flows, bool_or(is_source) AND bool_or(is_sink) AS high_risk
    FROM nodes LEFT JOIN (SELECT path, count(*) AS n FROM (SELECT path FROM control UNION ALL SELECT path FROM data) GROUP BY 1) e USING (path)
    LEFT JOIN (SELECT w.path, count(*) AS n FROM walk w JOIN nodes a ON a.path = w.path AND a.id = w.source_id AND a.is_source JOIN nodes b ON b.path = w.path AND b.id = w.target_id AND b.is_sink GROUP BY 1) t USING (path)
    GROUP BY path""",
    f"RECURSIVE {CODE}",
    LINES,
    NODES,
    CONTROL,
    DATA,
    FLOWS.removeprefix("RECURSIVE "),
)
def graph_summary(spark, sf_dir):
    return graph.summaries(views.code(spark, sf_dir))


@query(
    "SELECT w.path AS file, b.line, 'Taint: ' || a.label || ' -> ' || b.label AS type FROM walk w JOIN nodes a ON a.path = w.path AND a.id = w.source_id AND a.is_source "
    "JOIN nodes b ON b.path = w.path AND b.id = w.target_id AND b.is_sink",
    f"RECURSIVE {CODE}",
    LINES,
    NODES,
    DATA,
    FLOWS.removeprefix("RECURSIVE "),
)
def graph_flow_findings(spark, sf_dir):
    return graph.graph_findings(views.code(spark, sf_dir)).filter("severity = 'CRITICAL'").select("file", "line", "type")


@query("SELECT path AS file, line, 'String Concatenation in Query' AS type, 'Potential injection via string concatenation: ' || left(label, 80) AS description FROM nodes WHERE node_type = 'string_concat'", CODE, LINES, NODES)
def graph_joined_strings(spark, sf_dir):
    return graph.graph_findings(views.code(spark, sf_dir)).filter("severity = 'MEDIUM'").select("file", "line", "type", "description")


@query("SELECT path, line FROM nodes WHERE is_comment", CODE, LINES, NODES)
def graph_comment_lines(spark, sf_dir):
    found = materialise(graph.nodes(views.code(spark, sf_dir)).select("path", "line", "is_comment"), "nodes")
    return graph.in_comment(found, found.select("path", "line"))


@query("SELECT path, line::INTEGER AS line FROM lines WHERE ext = '.java' AND raw LIKE '%log(sql);'", CODE, LINES)
def graph_unreachable(spark, sf_dir):
    return graph.unreachable(views.code(spark, sf_dir))


# ---------------------------------------------------------------- dependencies


@query("SELECT path, version, vuln_version, description FROM hits", PACKAGED)
def vulnerable_packages(spark, sf_dir):
    found = dependencies.match(dependencies.packages(views.manifests(spark, sf_dir)))
    return found.select("path", "version", "vuln_version", "description")


@query("SELECT path AS file, 0 AS line, 'Vulnerable Package: ' || pkg AS type, pkg || '==' || version AS snippet, pkg || ' ' || version || ': ' || description AS description FROM hits", PACKAGED)
def dependency_findings(spark, sf_dir):
    return dependencies.dependency_findings(views.manifests(spark, sf_dir)).select("file", "line", "type", "snippet", "description")


@query(
    "SELECT name, count(*) AS n FROM (SELECT regexp_extract(path, '[^/]+$') AS name FROM packaged UNION ALL SELECT 'package.json' FROM packaged WHERE path LIKE '%/package.json') GROUP BY 1",
    PACKAGED,
)
def manifest_packages(spark, sf_dir):
    return dependencies.packages(views.manifests(spark, sf_dir)).groupBy(C.base_name(F.col("path")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_size, v1, v2, list_transform([v1, v2], lambda v: list_resize(list_transform(regexp_extract_all(v, '\\d+')[1:4], lambda x: x::INTEGER), 4, 0))[1] <= [3, 2, 0, 0] AS below FROM (SELECT p_size, p_size % 5 || '.' || p_partkey % 4 || '.' || p_size % 3 AS v1, '3.2.0' AS v2 FROM part)")
def version_order(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    v1 = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit("."), (F.col("p_size") % 3).cast("string"))
    own = part.select("p_size", v1.alias("v1"), F.lit("3.2.0").alias("v2"))
    return own.withColumn("below", C.version_key(F.col("v1")) <= C.version_key(F.col("v2")))


@query("SELECT json_extract(props, '$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1")
def json_values(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- findings


@query("SELECT * FROM exact", FOUND, EXACT)
def exact_dedup(spark, sf_dir):
    return findings.dedup_exact(views.found(spark, sf_dir))


@query("SELECT * FROM uniq", FOUND, EXACT, UNIQUE)
def semantic_dedup(spark, sf_dir):
    return findings.dedup(views.found(spark, sf_dir))


@query(f"SELECT file, line, type, severity, seq FROM uniq ORDER BY {RANK}, file, stage, seq LIMIT 500", FOUND, EXACT, UNIQUE)
def severity_rank_top(spark, sf_dir):
    return findings.top(findings.dedup(views.found(spark, sf_dir)), 500).select("file", "line", "type", "severity", "seq")


@query("SELECT upper(severity) AS severity, count(*) AS n FROM found GROUP BY 1", FOUND)
def severity_counts(spark, sf_dir):
    return findings.severity_counts(views.found(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE severity = 'INFO') AS info FROM uniq", FOUND, EXACT, UNIQUE)
def finding_summary(spark, sf_dir):
    return findings.summary(findings.dedup(views.found(spark, sf_dir)))


@query(
    f"SELECT upper(left(analyzer, 4)) || '-' || upper(category) AS id, left(arg_min(type, o), 80) AS name, left(arg_min(type, o), 120) AS short, left(arg_min(description, o), 500) AS full, arg_min({LEVEL}, o) AS level, "
    "arg_min(category, o) AS category, arg_min(analyzer, o) AS analyzer, arg_min(severity, o) AS severity, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY file, stage, seq) AS o FROM found) GROUP BY 1",
    FOUND,
)
def rule_rollup(spark, sf_dir):
    return findings.rollup(views.found(spark, sf_dir))


@query("SELECT 'pattern' AS analyzer, count(*) AS n FROM found UNION ALL SELECT 'file', count(*) FROM paths WHERE name IN (" + _list(tables.SUSPICIOUS_FILES) + ")", FOUND.replace("CASE WHEN user_id % 2 = 0 THEN 'pattern' ELSE 'taint' END", "'pattern'"), PATHS)
def detector_union(spark, sf_dir):
    both = findings.union(views.found(spark, sf_dir).withColumn("analyzer", F.lit("pattern")), rules.suspicious_files(views.paths(spark, sf_dir)))
    return both.groupBy("analyzer").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN length(file) > 30 THEN '...' || right(file, 27) ELSE file END AS file, line, CASE WHEN length(type) > 35 THEN left(type, 32) || '...' ELSE type END AS type, category, severity, "
    "CASE WHEN length(description) > 80 THEN left(description, 77) || '...' ELSE description END AS description FROM found",
    FOUND,
)
def display_columns(spark, sf_dir):
    return findings.display(views.found(spark, sf_dir))


@query("SELECT file || ':' || line || ' | ' || severity || ' | ' || type || ' | ' || description AS text FROM found", FOUND)
def report_lines(spark, sf_dir):
    return findings.report_lines(views.found(spark, sf_dir))


@query("SELECT count(*) AS discovered, count(*) FILTER (WHERE path NOT LIKE 'tests/%') AS queued, count(*) FILTER (WHERE path NOT LIKE 'tests/%') AS analyzed, count(*) FILTER (WHERE path LIKE 'tests/%') AS skipped, 0 AS failed FROM code", CODE)
def scan_coverage(spark, sf_dir):
    """Coverage where the content of test files could not be read."""
    code = views.code(spark, sf_dir)
    return scan.scan_coverage(code.withColumn("content", F.when(~F.startswith("path", F.lit("tests/")), F.col("content"))))


@query(
    "SELECT count(*) AS discovered, count(*) FILTER (WHERE path NOT LIKE 'tests/%') AS queued, count(*) FILTER (WHERE path NOT LIKE 'tests/%' AND ext <> '.php') AS analyzed, count(*) FILTER (WHERE path LIKE 'tests/%') AS skipped, "
    "count(*) FILTER (WHERE path NOT LIKE 'tests/%' AND ext = '.php') AS failed, (SELECT count(*) FROM code JOIN expected USING (ext) WHERE path NOT LIKE 'tests/%') + count(*) FILTER (WHERE path NOT LIKE 'tests/%' AND ext <> '.php') AS findings FROM code",
    CODE,
    _EXPECTED,
)
def covered_scan(spark, sf_dir):
    """Coverage and findings of one pass, with a detector of the user's own that fails on some files."""

    def first_line(content, ext):
        if ext == ".php":
            raise ValueError(content)
        yield source.Hit(1, "First Line", "INFO", content.split("\n")[0], "", "QUALITY", "own")

    code = views.code(spark, sf_dir)
    rows = rules.scanned(code.withColumn("content", F.when(~F.startswith("path", F.lit("tests/")), F.col("content"))), {"own": first_line})
    rows = materialise(rows, "scanned")
    return findings.coverage(rules.status_of(rows)).withColumn("findings", F.lit(rules.findings_of(rows).count()))


_OWN = (
    ("License Line", r"licensed under [^\n.]+", "INFO", "LICENSE", "A license is named.", "match NOT LIKE '%CC BY%' AND length(match) < 60"),
    ("Number And Word", r"[0-9]{3}\s+[A-Za-z]+", "INFO", "QUALITY", "A number stands before a word.", "length(match) > 9"),
    ("Odd Token", r"token\s*=", "LOW", "SECRET", "A token is assigned.", None),
)


@query(
    "SELECT file, line, type, severity, category FROM hits WHERE " + " AND ".join(f"(type <> {quoted(r[0])} OR ({r[5]}))" for r in _OWN if r[5]),
    DOCS, "texts AS (SELECT path AS file, content FROM docs)", f"hits AS ({rule_sql.found([r[:5] for r in _OWN])})",
)
def custom_rules(spark, sf_dir):
    """Rules from a table, each with a condition of its own, as a detector that is registered for this scan."""
    own = spark.createDataFrame(_OWN, "name string, pattern string, severity string, category string, description string, validator string")
    scan.register_detector("own", detector := lambda files: rules.table_findings(files, own))
    try:
        return scan.detect(views.docs(spark, sf_dir), ("own",)).select("file", "line", "type", "severity", "category")
    finally:
        assert scan.DETECTORS["own"] is detector
        scan.forget_detector("own")


@query(
    f"""SELECT 'Explain these findings, most urgent first, and how to fix them.' || chr(10) || 'Findings (' || (SELECT count(*) FROM uniq) || ' total):' || chr(10)
    || (SELECT string_agg('- [' || severity || '] ' || type || ' in ' || file || ':' || line || ' - ' || left(description, 100), chr(10) ORDER BY {RANK}, file, stage, seq) FROM (SELECT * FROM uniq ORDER BY {RANK}, file, stage, seq LIMIT 20))
    || chr(10) || '... and ' || ((SELECT count(*) FROM uniq) - 20) || ' more findings' AS prompt""",
    FOUND,
    EXACT,
    UNIQUE,
)
def finding_prompt(spark, sf_dir):
    return findings.prompt(findings.dedup(views.found(spark, sf_dir)))


@query(
    f"SELECT path, 'Review this ' || language || ' file for security vulnerabilities.' || chr(10) || 'File: ' || path || chr(10) || '```' || language || chr(10) || left(content, 200) || chr(10) || '```' || {quoted(prompts._TASK)} AS prompt FROM code",
    CODE,
)
def file_prompts(spark, sf_dir):
    """A request to review each program, of which the first characters are shown."""
    return prompts.file_prompts(views.code(spark, sf_dir), 200)


@query(
    "SELECT conv_id, to_json({'contents': contents, 'systemInstruction': {'parts': [{'text': coalesce(instruction, " + quoted(prompts.INSTRUCTION) + ")}]}})::VARCHAR AS request FROM "
    "(SELECT conv_id, list({'role': CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END, 'parts': [{'text': coalesce(text, '')}]} ORDER BY turn) AS contents "
    "FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id) "
    "LEFT JOIN (SELECT conv_id, arg_min(coalesce(text, ''), turn) AS instruction FROM conversations WHERE role = 'system' GROUP BY conv_id) USING (conv_id)"
)
def chat_requests(spark, sf_dir):
    """The next request of each conversation: its instruction and its newest turns."""
    return prompts.chat_requests(read(spark, sf_dir, "conversations"), 4)


_MARKS = {"hash": tables.HASH_COMMENT_EXTS, "slash": tables.SLASH_COMMENT_EXTS, "block": tuple(sorted(source.BLOCK_COMMENT_EXTS))}


@query(f"SELECT ext, count(*) AS files, {', '.join(f'ext IN ({_list(exts)}) AS {mark}' for mark, exts in _MARKS.items())} FROM named WHERE ext <> '' GROUP BY ext", PATHS)
def comment_dialects(spark, sf_dir):
    """The files of each extension, and the comments that end there."""
    own = views.paths(spark, sf_dir).filter("ext <> ''").groupBy("ext").agg(F.count("*").alias("files"))
    return own.select("ext", "files", *[F.col("ext").isin(*exts).alias(mark) for mark, exts in _MARKS.items()])


# ---------------------------------------------------------------- sinks


@query("SELECT to_json({'file': file, 'line': line, 'type': type, 'severity': severity, 'snippet': snippet, 'description': description, 'category': category, 'analyzer': analyzer})::VARCHAR AS row FROM found", FOUND)
def json_rows(spark, sf_dir):
    return views.found(spark, sf_dir).select(sinks.json_row().alias("row"))


@query("SELECT file || ',' || line || ',' || type || ',' || category || ',' || severity || ',\"' || replace(description, '\"', '\"\"') || '\",\"' || replace(snippet, '\"', '\"\"') || '\",' || analyzer AS row FROM found", FOUND)
def csv_rows(spark, sf_dir):
    return views.found(spark, sf_dir).select(sinks.csv_row().alias("row"))


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    f"SELECT '<tr><td>' || file || '</td><td>' || line || '</td><td>' || type || '</td><td><span class=\"badge\">' || category || '</span></td><td class=\"' || lower(severity) || '\">' || severity || '</td><td>' || {_ESCAPE.format('description')} "
    f"|| '</td><td><code>' || {_ESCAPE.format('left(snippet, 80)')} || '</code></td><td><span class=\"badge\">' || analyzer || '</span></td></tr>' AS row FROM found",
    FOUND,
)
def html_rows(spark, sf_dir):
    return views.found(spark, sf_dir).select(sinks.html_row().alias("row"))


@query(
    f"SELECT to_json({{'ruleId': upper(left(analyzer, 4)) || '-' || upper(category), 'level': {LEVEL}, 'message': {{'text': left(description, 1000)}}, "
    "'locations': [{'physicalLocation': {'artifactLocation': {'uri': file, 'uriBaseId': '%SRCROOT%'}, 'region': {'startLine': greatest(line, 1), 'startColumn': 1}}}], "
    "'fingerprints': {'primaryLocationLineHash/v1': file || ':' || line || ':' || type}, 'properties': {'severity': severity, 'category': category, 'analyzer': analyzer, 'snippet': left(snippet, 200)}})::VARCHAR AS row FROM found",
    FOUND,
)
def sarif_results(spark, sf_dir):
    return views.found(spark, sf_dir).select(sinks.sarif_result().alias("row"))


@query("SELECT to_json({'file': file, 'line': line, 'type': type, 'severity': severity, 'snippet': snippet, 'description': description, 'category': category, 'analyzer': analyzer})::VARCHAR AS row FROM found", FOUND)
def saved_report(spark, sf_dir):
    """A JSON report saved by the tasks, and its findings read back from the parts."""
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    sinks.save_report(views.found(spark, sf_dir), folder, "json")
    lines = spark.read.text(folder).select(F.regexp_replace("value", ",$", "").alias("row"))
    return lines.filter(F.startswith("row", F.lit('{"file"')))


# ---------------------------------------------------------------- whole scans, streams


@query()
def full_scan(spark, sf_dir):
    """All detectors over programs, manifests, documents, urls and web pages, deduplicated."""
    everything = views.code(spark, sf_dir).unionByName(views.manifests(spark, sf_dir)).unionByName(views.docs(spark, sf_dir)).unionByName(views.links(spark, sf_dir)).unionByName(views.pages(spark, sf_dir))
    return scan.scan(everything)


@query(
    "SELECT severity, count(*) AS n FROM (SELECT DISTINCT file, line, severity, upper(category) FROM hits) GROUP BY 1",
    DOCS, LINKS, "texts AS (SELECT path AS file, content FROM docs UNION ALL SELECT path, content FROM links)", _HITS,
)
def flagship(spark, sf_dir):
    """Documents and urls through the secret and configuration rules, both levels of dedup, and counts by severity."""
    both = views.docs(spark, sf_dir).unionByName(views.links(spark, sf_dir))
    return findings.dedup(rules.occurrences(both, EVERYWHERE)).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT file, line, type FROM exact", FOUND, EXACT)
def incremental_keys(spark, sf_dir):
    """The keys that an incremental exact dedup delivers: the same as those of the batch one.

    Findings arrive as a stream of four files, a file a batch.
    """
    from scanframe.streaming import incremental

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    views.found(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(RANKED).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    incremental.start_found(incremental.first_of_each(stream), f"{base}/found", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(RANKED).parquet(f"{base}/found/batch=*").select("file", "line", "type")


@query("SELECT file, line, type, severity, snippet, description, category, analyzer, stage, seq FROM uniq", FOUND, EXACT, UNIQUE)
def incremental_dedup(spark, sf_dir):
    """Both levels of dedup kept up to date while findings arrive, a file a batch: the same in the end as over all at once."""
    from scanframe.streaming import incremental

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    views.found(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(RANKED).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    with incremental.state_on_disk(spark):
        running = incremental.start_found(incremental.dedup_of_each(stream), f"{base}/found", f"{base}/checkpoint", mode="update")
        running.awaitTermination()
    return incremental.latest(spark, f"{base}/found")


@query(
    "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type AS severity, count(*) AS n FROM events GROUP BY ALL",
)
def windowed_counts(spark, sf_dir):
    from scanframe.streaming import incremental

    e = read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("severity"))
    return incremental.windowed_counts(e).select(F.col("window.start").alias("start"), "severity", "n")


@query("SELECT path AS file, 1 AS line, 'Insecure HTTP' AS type FROM links WHERE contains(content, 'http://')", LINKS)
def streamed_scan(spark, sf_dir):
    """Files arrive as a stream; findings are delivered batch by batch, then recomputed."""
    from scanframe.streaming import incremental

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    views.links(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = incremental.file_stream(spark, f"{base}/in", files_per_trigger=1)
    incremental.start(stream, f"{base}/found", f"{base}/checkpoint").awaitTermination()
    return incremental.final(spark, f"{base}/found").select("file", "line", "type")
