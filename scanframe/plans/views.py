"""Views of the star-schema tables as files and findings, in Spark and in SQL.

Each view has a DataFrame function and the same rows as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.plans.stages import spread
from scanframe.sources.files import files_from_table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


#: One small program a language; ``{k}`` and ``{name}`` are filled in from a row.
PROGRAMS = {
    ".py": """# {name}
import os
name = request.args
e = request.form
limit = {k}
query = "select " + name
def load(path):
    return open(path)
cursor.execute(query)
password = "pw-{name}-{k}"
token = "0123456789abcdef0123456789abcdef01234567"
eval(name)
os.system("ls " + name)
digest = hashlib.md5(name)
ALLOWED_HOSTS = ['*']
app.run(host="0.0.0.0", debug=True)
""",
    ".js": """// {name}
const name = req.body;
const limit = {k};
let html = name + limit;
document.write(html);
node.innerHTML = html;
db.query("select " + name);
eval(html);
const url = "http://{k}.example.com/";
const key = Math.random();
""",
    ".java": """// {name}
class Part{k} {
  String name = request.getParameter("id");
  public String load(String path) {
    String sql = "select " + name;
    Statement.executeQuery(sql);
    Runtime.getRuntime().exec(name);
    String probe = "${jndi:ldap://{k}.example.com/a}";
    return sql;
    log(sql);
  }
}
""",
    ".php": """<?php
# {name}
$name = $_GET['name'];
$limit = {k};
echo $name;
system($name);
include($name);
$secret = 'changeme';
$result = mysqli_query("select " . $name);
""",
}
EXTS = tuple(PROGRAMS)


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for every part."""
    part = spread(read(spark, sf_dir, "part"))
    k = F.col("p_partkey").cast("string")
    text = F.lit("")
    for n, ext in enumerate(EXTS):
        text = F.when(F.col("p_partkey") % 4 == n, F.replace(F.replace(F.lit(PROGRAMS[ext]), F.lit("{name}"), F.col("p_name")), F.lit("{k}"), k)).otherwise(text)
    ext = F.get(F.array(*map(F.lit, EXTS)), (F.col("p_partkey") % 4).cast("int"))
    folder = F.when(F.col("p_partkey") % 5 == 0, "tests").otherwise("src")
    return files_from_table(part.select(F.concat(folder, F.lit("/p"), k, ext).alias("path"), text.alias("content")))


def _code_sql() -> str:
    cases = " ".join(f"WHEN {n} THEN {quoted(PROGRAMS[e])}" for n, e in enumerate(EXTS))
    exts = " ".join(f"WHEN {n} THEN {quoted(e)}" for n, e in enumerate(EXTS))
    langs = " ".join(f"WHEN {n} THEN {quoted(tables.LANGUAGE_OF_EXT[e])}" for n, e in enumerate(EXTS))
    return f"""code AS (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN 'tests' ELSE 'src' END || '/p' || p_partkey || CASE p_partkey % 4 {exts} END AS path,
         CASE p_partkey % 4 {exts} END AS ext, CASE p_partkey % 4 {langs} END AS language,
         replace(replace(CASE p_partkey % 4 {cases} END, '{{name}}', p_name), '{{k}}', p_partkey::VARCHAR) AS content
  FROM part)"""


CODE = _code_sql()

LINES = """lines AS (
  SELECT path, ext, language, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS raw
  FROM code)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files."""
    d = spread(read(spark, sf_dir, "documents"))
    return files_from_table(d.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content")))


DOCS = """docs AS (
  SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, '.txt' AS ext,
         regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS content
  FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as one-line files."""
    p = spread(read(spark, sf_dir, "pages"))
    return files_from_table(p.select(F.concat(F.lit("links/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("url", F.lit("")).alias("content")))


LINKS = "links AS (SELECT 'links/' || page_id || '.md' AS path, coalesce(url, '') AS content FROM pages)"

NAMES = ("node_modules", "src", "vendor", "app", "tests", "build", "lib", ".git", "docs", "__pycache__")
FILE_NAMES = ("main.py", ".env", "notes.bin", "package.json", "go.sum", "config.yml", "INDEX.HTML", "id_rsa", "a.tar.gz", "Makefile", "requirements.txt", "x.PY", ".gitignore", "web.config")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every customer."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.get(F.array(*map(F.lit, FILE_NAMES)), (k % len(FILE_NAMES)).cast("int"))
    top = F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int"))
    path = F.concat(F.lit("r"), (k % 7).cast("string"), F.lit("/"), top, F.lit("/d"), k.cast("string"), F.lit("/"), name)
    return files_from_table(c.select(path.alias("path"), F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("content")))


def _pick(items: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(map(quoted, items))}])[{key} % {len(items)} + 1]"


PATHS = f"""paths AS (
  SELECT 'r' || c_custkey % 7 || '/' || {_pick(NAMES, "c_custkey")} || '/d' || c_custkey || '/' || {_pick(FILE_NAMES, "c_custkey")} AS path,
         {_pick(FILE_NAMES, "c_custkey")} AS name, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS content,
         {_pick(NAMES, "c_custkey")} AS folder
  FROM customer),
named AS (SELECT *, CASE WHEN strpos(ltrim(name, '.'), '.') > 0 THEN lower(regexp_extract(name, '\\.[^.]+$')) ELSE '' END AS ext FROM paths)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    severity = F.when(kind == "error", "CRITICAL").when(kind == "purchase", "HIGH").when(kind == "signup", "MEDIUM").when(kind == "click", "LOW").otherwise(F.when(F.col("event_id") % 3 == 0, "INFO").otherwise("ODD"))
    category = F.when(kind.isin("click", "view"), F.when(F.col("event_id") % 2 == 0, "ui").otherwise("UI")).otherwise("CORE")
    analyzer = F.when(F.col("user_id") % 2 == 0, "pattern").otherwise("taint")
    return e.select(
        F.concat(F.lit("app/users/u"), F.col("user_id").cast("string"), F.lit("/session/history.log")).alias("file"), (F.col("event_id") % 50).cast("int").alias("line"),
        F.concat(kind, F.lit(" event of an unusually long name")).alias("type"), severity.alias("severity"), F.col("props").alias("snippet"),
        F.concat(F.lit("A \"quoted\", <"), kind, F.lit("> event & its properties: "), F.repeat(F.lit("x"), (F.col("event_id") % 60).cast("int")), "props").alias("description"),
        category.alias("category"), analyzer.alias("analyzer"), (F.col("event_id") % 3).cast("int").alias("stage"), F.col("event_id").alias("seq"),
    )


FOUND = """found AS (
  SELECT 'app/users/u' || user_id || '/session/history.log' AS file, (event_id % 50)::INTEGER AS line, event_type || ' event of an unusually long name' AS type,
         CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW'
              ELSE CASE WHEN event_id % 3 = 0 THEN 'INFO' ELSE 'ODD' END END AS severity,
         props AS snippet, 'A "quoted", <' || event_type || '> event & its properties: ' || repeat('x', (event_id % 60)::INTEGER) || props AS description,
         CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 2 = 0 THEN 'ui' ELSE 'UI' END ELSE 'CORE' END AS category,
         CASE WHEN user_id % 2 = 0 THEN 'pattern' ELSE 'taint' END AS analyzer, (event_id % 3)::INTEGER AS stage, event_id AS seq
  FROM events)"""
EXACT = "exact AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY stage, seq) = 1)"
UNIQUE = """uniq AS (
  SELECT file, line, type, severity, snippet, description, category, analyzer, p.stage AS stage, p.seq AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY file, line, severity, upper(category) ORDER BY length(description) DESC, stage, seq) AS r,
           first_value({'stage': stage, 'seq': seq}) OVER (PARTITION BY file, line, severity, upper(category) ORDER BY stage, seq) AS p
    FROM (SELECT file, line, type, severity, snippet, description, category, analyzer, stage, seq FROM exact)) WHERE r = 1)"""
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
LEVEL = "CASE upper(severity) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'none' ELSE 'warning' END"


#: Manifests by name; ``{p}`` and ``{v}`` are a package and its version.
MANIFESTS = {
    "requirements.txt": "# pinned\n-r base.txt\n{p}>={v},<99\n",
    "package.json": '{"dependencies": {"{p}": "^{v}"}, "devDependencies": {"left-pad": "1.0.0"}}',
    "package-lock.json": '{"dependencies": {"{p}": {"version": "{v}"}}}',
    "Pipfile.lock": '{"default": {"{p}": {"version": "=={v}"}}, "develop": {}}',
    "poetry.lock": '[[package]]\nname = "{p}"\nversion = "{v}"\n',
    "Cargo.lock": '[[package]]\nname = "{p}"\nsource = "registry"\nversion = "{v}"\n',
    "yarn.lock": '# yarn lockfile v1\n\n"{p}@^{v}":\n  version "{v}"\n  resolved "x"\n',
    "Gemfile.lock": "GEM\n  specs:\n    {p} ({v})\n",
    "go.sum": "example.com/x/{p} v{v} h1:abc=\nexample.com/x/{p} v0.0.1/go.mod h1:def=\n",
    "composer.lock": '{"packages": [{"name": "acme/{p}", "version": "v{v}"}], "packages-dev": []}',
    "pom.xml": "<project>\n<groupId>org.acme</groupId>\n<artifactId>{p}</artifactId>\n<version>{v}</version>\n</project>\n",
    "build.gradle": "dependencies {\n  implementation 'org.acme:{p}:{v}'\n}\n",
}
PACKAGES = ("django", "flask", "lodash", "log4j-core", "ring", "tar")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for every part."""
    part, k = spread(read(spark, sf_dir, "part")), F.col("p_partkey")
    names = list(MANIFESTS)
    name = F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    text = F.get(F.array(*[F.lit(MANIFESTS[n]) for n in names]), (k % len(names)).cast("int"))
    package = F.get(F.array(*map(F.lit, PACKAGES)), (F.floor(k / len(names)) % len(PACKAGES)).cast("int"))
    version = F.concat((F.col("p_size") % 6).cast("string"), F.lit("."), (k % 23).cast("string"), F.lit("."), (F.col("p_size") % 4).cast("string"))
    content = F.replace(F.replace(text, F.lit("{p}"), package), F.lit("{v}"), version)
    return files_from_table(part.select(F.concat(F.lit("m"), k.cast("string"), F.lit("/"), name).alias("path"), content.alias("content")))


PACKAGED = f"""packaged AS (
  SELECT 'm' || p_partkey || '/' || {_pick(tuple(MANIFESTS), "p_partkey")} AS path, {_pick(PACKAGES, f"(p_partkey // {len(MANIFESTS)})")} AS pkg,
         (p_size % 6) || '.' || (p_partkey % 23) || '.' || (p_size % 4) || CASE WHEN p_partkey % {len(MANIFESTS)} = 0 THEN ',' ELSE '' END AS version
  FROM part),
vulnerable(pkg, vuln_version, description) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in tables.VULNERABLE)}),
keyed AS (
  SELECT *, list_transform(list_resize(regexp_extract_all(version, '\\d+'), 4, '0'), lambda x: x::INTEGER) AS vk,
         list_transform(list_resize(regexp_extract_all(vuln_version, '\\d+'), 4, '0'), lambda x: x::INTEGER) AS wk
  FROM packaged JOIN vulnerable USING (pkg)),
hits AS (SELECT * FROM keyed WHERE starts_with(version, vuln_version) OR vk <= wk)"""


#: Small files, one for each thing that a detector looks for and some that it must leave alone:
#: (name of the case's detector, extension, content, line of the finding or 0, type, severity).
CASES = (
    ("ast", ".py", "x = 1\neval(request.args)\n", 2, "AST: eval() with user input", "CRITICAL"),
    ("ast", ".py", "exec(x, request.form)\n", 1, "AST: exec() with user input", "CRITICAL"),
    ("ast", ".py", "eval(x)\n", 0, "", ""),
    ("ast", ".py", "m = __import__(request.form)\n", 1, "AST: Dynamic import with user input", "CRITICAL"),
    ("ast", ".py", "import a\nimport b\npickle.loads(blob)\n", 3, "AST: pickle deserialization", "CRITICAL"),
    ("ast", ".py", "yaml.load(text)\n", 1, "AST: yaml.load without SafeLoader", "HIGH"),
    ("ast", ".py", "yaml.load(text, Loader=SafeLoader)\n", 0, "", ""),
    ("ast", ".py", "os.popen(x)\n", 1, "AST: os.popen", "HIGH"),
    ("ast", ".py", "subprocess.run(cmd, shell=True)\n", 1, "AST: subprocess with shell=True", "HIGH"),
    ("ast", ".py", "subprocess.run(cmd, shell=False)\n", 0, "", ""),
    ("ast", ".py", "def f():\n    return open(request.args)\n", 2, "AST: open() with user input", "HIGH"),
    ("ast", ".py", "render_template_string(t)\n", 1, "AST: render_template_string", "CRITICAL"),
    ("ast", ".py", "getattr(o, request.args)\n", 1, "AST: getattr with user input", "HIGH"),
    ("ast", ".py", "marshal.loads(b)\n", 1, "AST: marshal deserialization", "CRITICAL"),
    ("ast", ".py", "db.execute('select %s' % v)\n", 1, "AST: SQL query via string formatting", "CRITICAL"),
    ("ast", ".py", "db.execute('select 1', v)\n", 0, "", ""),
    ("ast", ".py", "hashlib.sha1(b)\n", 1, "AST: weak hash (SHA1)", "MEDIUM"),
    ("ast", ".py", "hashlib.new('md5')\n", 1, "AST: weak hash (MD5)", "HIGH"),
    ("ast", ".py", "hashlib.new('SHA-1', b)\n", 1, "AST: weak hash (SHA1)", "MEDIUM"),
    ("ast", ".py", "app.run('0.0.0.0')\n", 1, "AST: binds 0.0.0.0", "MEDIUM"),
    ("ast", ".py", "DEBUG = True\n", 1, "AST: DEBUG = True", "HIGH"),
    ("ast", ".py", "api_key = 'k9-AbCdEf123'\n", 1, "AST: hardcoded api_key", "CRITICAL"),
    ("ast", ".py", "api_key = 'changeme'\n", 0, "", ""),
    ("config", ".txt", "a\ndebug: yes\n", 2, "Debug Mode", "MEDIUM"),
    ("config", ".txt", "Access-Control-Allow-Origin: *\n", 1, "CORS Wildcard", "MEDIUM"),
    ("config", ".txt", "get(u, verify=False)\n", 1, "SSL Verify Disabled", "HIGH"),
    ("config", ".txt", "TLSClientConfig: c{InsecureSkipVerify: true}\n", 1, "SSL Verify Disabled (Go)", "HIGH"),
    ("config", ".txt", "http://10.0.0.1/\nhttp://localhost/\nhttp://h.example.org/\n", 3, "Insecure HTTP", "LOW"),
    ("config", ".txt", "http://192.168.0.1/ http://172.20.0.1/\n", 0, "", ""),
    ("config", ".txt", "Server: 'x/1.0'\n", 1, "Version Disclosure", "LOW"),
    ("config", ".txt", "Options +Indexes\n", 1, "Directory Listing", "MEDIUM"),
    ("config", ".txt", "Access-Control-Allow-Origin: req.headers.origin\n", 1, "CORS Origin Reflection", "HIGH"),
    ("config", ".txt", "e.printStackTrace()\n", 1, "Verbose Errors", "LOW"),
    ("config", ".txt", "print(my_password)\n", 1, "Info Disclosure (print secrets)", "HIGH"),
    ("config", ".txt", "console.log(token)\n", 1, "Info Disclosure (console.log)", "HIGH"),
    ("config", ".txt", "user.permit!\n", 1, "Mass Assignment (Rails)", "MEDIUM"),
    ("config", ".txt", "logger.info('a' + b)\n", 1, "Log Injection", "LOW"),
    ("config", ".txt", "models.FileField\n", 1, "File Upload (Django)", "LOW"),
    ("context", ".py", "CORS_ALLOW_ALL_ORIGINS = True\n", 1, "Context: CORS allows any origin", "HIGH"),
    ("context", ".js", "use(cors({origin: '*'}))\n", 1, "Context: CORS allows any origin", "HIGH"),
    ("context", ".py", "@csrf_exempt\ndef f(r): pass\n", 1, "Context: @csrf_exempt used", "MEDIUM"),
    ("context", ".py", "csrf_exempt_not(1)\n", 0, "", ""),
    ("taint", ".py", "v = sys.argv\n\nos.system(v)\n", 3, "Taint: v -> os.system", "HIGH"),
    ("taint", ".php", "$v = $_GET['a'];\nsystem($v);\n", 2, "Taint: v -> exec", "CRITICAL"),
    ("taint", ".js", "const v = req.body;\nconst w = v;\neval(w);\n", 3, "Taint: w -> eval", "HIGH"),
    ("taint", ".ts", "let v = req.query;\neval(v);\n", 2, "Taint: v -> eval", "HIGH"),
    ("taint", ".java", "String v = request.getHeader(1);\nRuntime.getRuntime().exec(v);\n", 2, "Taint: v -> Runtime.exec", "CRITICAL"),
    ("taint", ".rb", "v = params\neval(v)\n", 2, "Taint: v -> eval", "HIGH"),
    ("taint", ".go", "v := r.FormValue(a)\nexec.Command(v)\n", 2, "Taint: v -> exec.Command", "HIGH"),
    ("taint", ".cs", "var v = Request.Form[a];\nProcess.Start(v);\n", 2, "Taint: v -> Process.Start", "MEDIUM"),
    ("taint", ".kt", "val v: String = readLine()\nProcessBuilder(v)\n", 2, "Taint: v -> ProcessBuilder", "HIGH"),
    ("taint", ".lua", "local v = io.read()\nos.execute(v)\n", 2, "Taint: v -> os.execute", "CRITICAL"),
    ("taint", ".pl", "my $v = <STDIN>;\nsystem($v);\n", 2, "Taint: v -> system", "HIGH"),
    ("taint", ".c", "char *v = getenv(a);\npopen(v, b);\n", 2, "Taint: v -> popen", "CRITICAL"),
    ("taint", ".cpp", "auto v = getenv(a);\nsystem(v);\n", 2, "Taint: v -> system", "CRITICAL"),
    ("taint", ".rb", "v = 1\neval(v)\n", 0, "", ""),
    *(("lexer", ext, f"/* {name}(a) */ x\n{name} (a);\n", 2, f"Lexer: {name}()", severity) for ext, name, severity, _ in tables.DANGEROUS_CALLS),
    *(("lexer", ".js", f"// {name} = 1\na.{name} = b;\n", 2, f"Lexer: XSS sink '{name}'", "HIGH") for name in tables.XSS_NAMES if name != "document"),
    ("lexer", ".js", "x = 'eval(a)'; // eval(b)\n", 0, "", ""),
    ("lexer", ".js", "a.innerHTML += b;\n", 0, "", ""),
    ("lexer", ".php", "$exec = 1; $eval\n(x);\n", 0, "", ""),
    ("lexer", ".java", "executor(a); exec;\n", 0, "", ""),
    ("lexer", ".py", "eval(a)\n", 0, "", ""),
)


def cases(spark: SparkSession, sf_dir: str, detector: str) -> DataFrame:
    """A file for every part: the cases of one detector by turns."""
    own = [c for c in CASES if c[0] == detector]
    part, k = spread(read(spark, sf_dir, "part")), F.col("p_partkey")
    at = (k % len(own)).cast("int")
    path = F.concat(F.lit("src/c"), k.cast("string"), F.get(F.array(*[F.lit(c[1]) for c in own]), at))
    return files_from_table(part.select(path.alias("path"), F.get(F.array(*[F.lit(c[2]) for c in own]), at).alias("content")))


def cases_sql(detector: str) -> str:
    """The findings that the cases' files have: ``file, line, type, severity``."""
    own = [c for c in CASES if c[0] == detector]
    values = ", ".join(f"({n}, {quoted(ext)}, {line}, {quoted(kind)}, {quoted(severity)})" for n, (_, ext, _, line, kind, severity) in enumerate(own))
    return f"SELECT 'src/c' || p_partkey || ext AS file, line::INTEGER AS line, type, severity FROM part JOIN (VALUES {values}) t(n, ext, line, type, severity) ON p_partkey % {len(own)} = n WHERE line > 0"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files."""
    p = spread(read(spark, sf_dir, "pages"))
    return files_from_table(p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content")))


PAGES = "pages_ AS (SELECT 'pages/' || page_id || '.html' AS path, regexp_replace(coalesce(html, ''), '\\r\\n?', chr(10), 'g') AS content FROM pages)"
