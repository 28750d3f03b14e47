"""Functions of one file's text, and the native columns that must agree with them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.functions import source


def values(spark, items, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


# ---- comments and strings


def stepwise(text, ext):
    """A character-by-character version of ``blank``."""
    out, k = [], 0
    hashed, slashed, blocks = ext in tables.HASH_COMMENT_EXTS, ext in tables.SLASH_COMMENT_EXTS, ext in source.BLOCK_COMMENT_EXTS
    hide = lambda s: "".join(c if c == "\n" else " " for c in s)
    while k < len(text):
        rest = text[k:]
        if (hashed and rest[0] == "#") or (slashed and rest.startswith("//")) or (ext == ".sql" and rest.startswith("--")):
            end = text.find("\n", k)
            end = len(text) if end < 0 else end
            out.append(hide(text[k:end]))
        elif blocks and rest.startswith("/*"):
            end = text.find("*/", k + 2)
            end = len(text) if end < 0 else end + 2
            out.append(hide(text[k:end]))
        elif rest[0] in "\"'" or (rest[0] == "`" and ext in tables.BACKTICK_EXTS):
            quote = rest[0] * 3 if rest[0] != "`" and rest.startswith(rest[0] * 3) else rest[0]
            end = k + len(quote)
            while end < len(text) and not text.startswith(quote, end):
                end += 2 if text[end] == "\\" else 1
            end = min(len(text), end + len(quote)) if text.startswith(quote, end) else len(text)
            out.append(" " + hide(text[k + len(quote) : end]))
        else:
            end = k + 1
            out.append(text[k])
        k = end
    return "".join(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab\"'`#/*-\\\n "), max_size=40), st.sampled_from([".py", ".js", ".php", ".sql", ".lua", ".c", ".txt"]))
def test_blank(text, ext):
    clean = source.blank(text, ext)
    assert clean == stepwise(text, ext)
    assert clean.count("\n") == text.count("\n")


def test_code_lines():
    text = "x\n# c\n\n/* a\n b\n*/\n// d\ny /* z */"
    assert source.code_lines(text, ".js") == [0, 1, 2, 7]
    assert source.code_lines("/* a\nb */\nc", ".c") == [1, 2]
    assert source.code_lines("a\n# b\nc", ".py") == [0, 2]


# ---- rules


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"pickle\.loads?\s*\(", "pickle.load"), (r"\bsystem\s*\(", ""), (r"http://(?!x)", "http://"), ("ab?c", ""), (r"modes\.ECB|MODE_ECB", ""), (r"access_token\$production", "access_token$production"), ("(?i)Debug", "debug")],
)
def test_needle(pattern, want):
    assert source.needle(pattern) == want


def test_needles_are_in_every_match():
    for rows in (tables.LANGUAGE_RULES, tables.CONFIG_RULES):
        for r in rows:
            rule = source.compile_rule(*r[:5])
            text = "x = 1\neval(input()) pickle.load(f) MODE_ECB modes.ECB ImageField http://a debug=true\n" * 2
            for m in rule.regex.finditer(text):
                assert source.needle(r[1]) in m[0].lower()
                assert not rule.needles or any(n in m[0].lower() for n in rule.needles)


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"FileField|ImageField", ("filefield", "imagefield")), (r"(?:attr_accessible|permit!|params\[)", ("attr_accessible", "params[", "permit!")), (r"a?b*\w+", ()), (r"ab\s*cde(?:f|)", ("cde",)),
        (r"(?:x|yyyy)", ()), (r"(?:abc)+d", ("abc",)), (r"(?:abc)*dd", ()), (r"(?<!\w)eval\s*\(", ("eval",)),
    ],
)
def test_needles(pattern, want):
    assert source.needles(pattern) == want


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_needles_occur_in_generated_matches(data):
    rows = [*tables.LANGUAGE_RULES, *tables.CONFIG_RULES]
    pattern = data.draw(st.sampled_from([r[1] for r in rows if "(?!" not in r[1] and "(?<!" not in r[1]]))
    match = data.draw(st.from_regex(re.compile(pattern, re.IGNORECASE | re.MULTILINE), fullmatch=True))
    found = source.needles(pattern)
    assert not found or any(n in match.lower().replace("\u017f", "s") for n in found)


_PIECES = (
    "eval(input())", "os.system(x)", "pickle.load(f)", "token = \"" + "0a" * 20 + '"', "AKIA" + "A1B2C3D4E5F6G7H8", "http://a", "DEBUG = True", "verify=False", "e.printStackTrace()", "print(token)", "innerHTML = x", "logger.info('a' + b)",
    "password = 'hunter22x'", "FileField", "params[", "md5(", "exec(", "SELECT ", "\n", " ", "x", "ſ", "İ", "K", "'", '"', "$_GET['a']", "unserialize($x)", "Runtime.getRuntime().exec(c)", "strcpy(a, b)",
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=12), st.sampled_from(sorted({e for r in tables.LANGUAGE_RULES for e in r[5].split()})))
def test_the_prefilter_loses_no_match(pieces, ext):
    """One automaton of all literals against every rule on every text."""
    text = "".join(pieces)
    for own in (source.secret_rules(), source.config_rules(), source.language_rules(ext)):
        may = own.candidates(text.lower())
        assert [r.name for r in own if r.regex.search(text) and r not in may] == []
        assert [r for r in own if r in may] == may
        assert list(source.scan_rules(text, own)) == list(source.scan_rules(text, tuple(r._replace(needles=()) for r in own)))


def test_rule_lines_and_snippets():
    rule = source.compile_rule("r", r"b\s*c", "LOW", "X", "d")
    hits = list(source.scan_rules("a\n  b\nc  \n\nB c" + "z" * 200, (rule,)))
    assert [(h.line, h.snippet) for h in hits] == [(2, "b"), (5, ("B c" + "z" * 200)[:120])]
    assert source.compile_rule("bad", "(", "LOW", "X", "d") is None


def test_native_match_equals_python(spark):
    from scanframe.operators import rules

    texts = ["", "no", "http://a http://localhost\nx\nhttp://b", "\n\nhttp://c", "a verify = False\nverify=\nFalse", "HTTP://Z", "é http://é\n\n\n http://q"]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")
    for name in ("Insecure HTTP", "SSL Verify Disabled"):
        r = next(x for x in tables.CONFIG_RULES if x[0] == name)
        got = sorted((x.file, x.seq, x.line, x.snippet) for x in rules.match_native(rows, *r).collect())
        want = sorted((str(k), n, h.line, h.snippet) for k, t in enumerate(texts) for n, h in enumerate(source.scan_rules(t, source.compile_rules([r])), 1))
        assert got == want and want


def test_every_pattern_compiles_in_java(spark):
    row = spark.createDataFrame([("x = eval(input())",)], "v string")
    patterns = [r[1] for r in (*tables.LANGUAGE_RULES, *tables.CONFIG_RULES)]
    found = row.select(*[F.col("v").rlike(C.RULE_FLAGS + p).alias(f"c{k}") for k, p in enumerate(patterns)]).first()
    assert list(found) == [bool(re.search(p, "x = eval(input())", re.I | re.M)) for p in patterns]


# ---- values


LITERALS = ["changeme", "abc", "${ENV}", "<key>", "xxxxxxxx", "{{ x }}zz", "s3cr3t-value", "hunter22", "", " ", "'quoted-value'", "%s%s%d!!", "50% of it", "ends}", "x*.·_-", "Password", "{%if%}longer", "\u2003spaced-out\u2003"]


def test_placeholders(spark):
    want = [source.is_placeholder(v) for v in LITERALS]
    assert want[:8] == [True] * 6 + [False] * 2
    assert values(spark, LITERALS, C.is_placeholder) == want


def test_quoted_literals(spark):
    texts = ["p = 'ab'", 'q = "abc" \'d e\'', "none", "''", "`x y`", "'a\nb' \"ok\""]
    assert values(spark, texts, C.first_quoted) == [source.first_quoted(t) for t in texts]
    assert values(spark, texts + ["x = 'changeme'", "x = 'v3ry-real'"], C.is_credible)[-2:] == [False, True]


def test_versions(spark):
    pairs = [("3.2.5", "3.2.0", False), ("3.1", "3.2.0", True), ("1.9", "1.9.0", True), ("1.90", "1.9", True), ("10.0", "9.0.0", False), ("x", "1.0", False), ("99999999999999999999.1", "1.0", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r.got == r.w for r in rows.withColumn("got", C.is_vulnerable(F.col("a"), F.col("b"))).collect())


def test_packages(spark):
    assert values(spark, ["org.g:log4j-core", "@s/lodash", "GitHub.com/x/Express", " Django "], C.clean_package) == ["log4j-core", "lodash", "express", "django"]
    assert values(spark, ["^4.17.20", "v1.2", "==3.2.0", "~> 1.0 "], C.clean_version) == ["4.17.20", "1.2", "3.2.0", "1.0"]


def test_paths(spark):
    assert values(spark, ["src/latest.py", "src/inspector.js", "src/app.py"], C.is_test_path) == [True, True, False]
    assert values(spark, ["node_modules/a.js", "src/a.js", "src/.env", "src/__init__.py", "a/vendor/b/c.py", "vendor"], C.is_pruned) == [True, False, False, False, True, False]
    names = ["a.py", ".env", "x.env", "A.TAR.GZ", "Makefile", "a.", ".a.b", "..c"]
    from scanframe.sources.files import suffix

    assert values(spark, names, C.extension) == [suffix(n) for n in names] == [".py", "", ".env", ".gz", "", "", ".b", ".c"]


def test_display(spark):
    assert values(spark, ["p" * 40, "q" * 30], lambda c: C.shortened(c, 30, tail=True)) == ["..." + "p" * 27, "q" * 30]
    assert values(spark, ["d" * 100], lambda c: C.shortened(c, 80)) == ["d" * 77 + "..."]
    assert values(spark, ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "odd"], C.report_level) == ["error", "error", "warning", "note", "none", "warning"]
    assert values(spark, ["CRITICAL", "INFO", "ERROR", None], C.severity_rank) == [0, 4, 4, 4]
    assert values(spark, ["\u2003 x \n", "y"], C.strip) == ["x", "y"]
    assert values(spark, ["a.b", "ab"], lambda c: C.holds_word(c, F.lit("a"))) == [True, False]
    assert values(spark, ["import Flask", "x"], C.framework_of) == ["flask", None]


# ---- tokens, taint, trees


def test_tokens():
    got = source.tokens('/* a\n b */ foo(1) // x\n$y = "s" + z;\n')
    assert [(t.type, t.value, t.line, t.col) for t in got] == [
        ("FUNCTION_CALL", "foo", 2, 6), ("PUNCTUATION", "(", 2, 9), ("NUMBER", "1", 2, 10), ("PUNCTUATION", ")", 2, 11),
        ("VARIABLE", "$y", 3, 0), ("OPERATOR", "=", 3, 3), ("OPERATOR", "+", 3, 9), ("IDENT", "z", 3, 11), ("PUNCTUATION", ";", 3, 12),
    ]


def test_token_findings_leave_comments_and_strings_alone():
    assert source.scan_tokens("// eval(x)\n'eval(y)'\n/* eval(z) */", ".js") == []
    hits = source.scan_tokens("eval(x)\nnode.innerHTML = 1\nnode.innerHTML += 1", ".js")
    assert [(h.line, h.type) for h in hits] == [(1, "Lexer: eval()"), (2, "Lexer: XSS sink 'innerHTML'")]


def test_taint_flows():
    hits = source.scan_taint("x = request.args\ny = x\neval(y)", ".py")
    assert [(h.line, h.type, h.severity) for h in hits] == [(3, "Taint: y -> eval", "CRITICAL")] and "(line 1)" in hits[0].description
    assert [(h.line, h.type) for h in source.scan_taint("eval(input())", ".py")] == [(1, "Taint: input -> eval")]
    assert source.scan_taint("eval(x)", ".py") == [] and source.scan_taint("x", ".rs") == []
    # the line's own assignment comes after its sinks, and the first tainted variable is named
    hits = source.scan_taint("a = request.x\nb = request.y\na = request.z\neval(b, a)", ".py")
    assert [h.type for h in hits] == ["Taint: a -> eval"] and "(line 3)" in hits[0].description


def test_python_findings():
    text = """
DEBUG = True
api_key = "abcd-efgh-ijkl"
password = "changeme"
eval(request.args)
eval("1")
exec(f(input))
__import__(data["x"])
pickle.loads(b)
yaml.load(f)
yaml.load(f, Loader=X)
os.popen(c)
subprocess.run(c, shell=True)
subprocess.run(c, shell=False)
open("a" + query)
render_template_string(t)
getattr(o, args)
marshal.load(f)
cur.execute("a %s" % x)
cur.execute("a", (x,))
hashlib.sha1(x)
hashlib.new("MD5")
app.run(host="0.0.0.0")
app.run("127.0.0.1")
"""
    got = [(h.line, h.type) for h in sorted(source.scan_python(text))]
    assert got == [
        (2, "AST: DEBUG = True"), (3, "AST: hardcoded api_key"), (5, "AST: eval() with user input"), (7, "AST: exec() with user input"), (8, "AST: Dynamic import with user input"),
        (9, "AST: pickle deserialization"), (10, "AST: yaml.load without SafeLoader"), (12, "AST: os.popen"), (13, "AST: subprocess with shell=True"), (15, "AST: open() with user input"),
        (16, "AST: render_template_string"), (17, "AST: getattr with user input"), (18, "AST: marshal deserialization"), (19, "AST: SQL query via string formatting"),
        (21, "AST: weak hash (SHA1)"), (22, "AST: weak hash (MD5)"), (23, "AST: binds 0.0.0.0"),
    ]
    assert source.scan_python("def broken(:") == [] and source.python_tree("x = (") == []


def test_python_tree():
    rows = source.python_tree("def f():\n    return g(1) + 2\n")
    assert rows[0].parent_id == -1 and all(rows[r.parent_id].node_id < r.node_id for r in rows[1:])
    assert {"function_definition", "call", "binary_operator"} <= {r.type for r in rows}


def test_matches_of_a_long_text_take_time_in_proportion(spark):
    import time

    from scanframe.operators import rules

    text = "".join(f"line {k} http://h{k}.example.com/\n" for k in range(100_000))
    files = spark.createDataFrame([("p", text)], "path string, content string")
    began = time.perf_counter()
    got = rules.match_native(files, "Insecure HTTP", "http://", "LOW", "NETWORK", "HTTP instead of HTTPS.").collect()
    assert [r.line for r in got] == list(range(1, 100_001)) and got[77].snippet == "line 77 http://h77.example.com/" and time.perf_counter() - began < 60


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from scanframe.functions import columns as C

    rows = [[], [5], list(range(33)), list(range(3000)), [1] * 1025]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<bigint>")
    got = {r.k: r.s for r in df.select("k", C.running(F.col("v"), F.lit(0).cast("long"), lambda a, x: a + x).alias("s")).collect()}
    for k, r in enumerate(rows):
        assert got[k] == ([sum(r[:i]) for i in range(len(r))] if r else None)


def test_sql_placeholder_equals_the_function(spark):
    from scanframe.functions import source, sql

    sql.register(spark)
    values = ["changeme", "${x}", "realSecret9!", "a%sb", "'xx--xx'", "{{a}}bcdefgh", "it's-fine-12", "   short ", "", "\\\\back\\\\slash", "%s%d%sab", "x*x*x*x", "[token]"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.p for r in spark.sql("SELECT is_placeholder(v) AS p FROM {df}", df=df).collect()]
    assert got == [source.is_placeholder(v) for v in values]
    assert not spark.sql("SELECT is_placeholder(NULL) AS p").first().p
