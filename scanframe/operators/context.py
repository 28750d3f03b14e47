"""Context detectors over the lines of a file, in native expressions.

A file's detectors are arrays built side by side in its row, so the file is read once and
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.functions.code import HITS
from scanframe.functions.columns import let
from scanframe.operators.rules import blanked
from scanframe.schema import STAGE

#: What the detectors look for.
JNDI = r"\$\{jndi:(?:ldap|rmi|dns|iiop|corba|nds|http)s?://"
SQL_SINK = r"\b(?:\w+\s*\.\s*)?(?:execute|executemany|executescript|raw|query|executeQuery|executeUpdate|createQuery|runCommand)\s*\("
DYNAMIC_ARGUMENT = r"""`[^`]*\$\{[^}]+\}[^`]*`|f"[^"]*\{|f'[^']*\{|\+\s*\w+|\w+\s*\+|%\s*\w+\)?\s*$|\.format\s*\(|\$\w+"""
#: In lower case; every call of SQL_SINK holds one of them.
SQL_NAMES = ("execute", "raw", "query", "runcommand")
SQL_EXTS = (".js", ".ts", ".jsx", ".tsx", ".php", ".java", ".cs", ".go", ".kt", ".scala", ".groovy")
CREDENTIAL = (
    r"\b((?:db_|database_|mysql_|postgres_|mongo_|redis_|smtp_|admin_|root_)?"
    r"(?:password|passwd|pwd|secret|secret[_-]?key|client[_-]?secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|private[_-]?key|"
    r"signing[_-]?key|encryption[_-]?key|master[_-]?key|aws[_-]?secret))\b\s*(?:=|:|=>)\s*([\"'`])([^'`\n]{6,})\2"
)
#: (pattern, ignores case, type, severity, description)
CONFIG_CHECKS = (
    (r"ALLOWED_HOSTS\s*=\s*\[[^\]]*[\"']\*[\"'][^\]]*\]", False, "ALLOWED_HOSTS accepts all hosts", "HIGH", "Django ALLOWED_HOSTS contains '*' - host header spoofing risk."),
    (r"CORS_ORIGIN_ALLOW_ALL\s*=\s*True|CORS_ALLOW_ALL_ORIGINS\s*=\s*True|cors\s*\(\s*\{\s*origin\s*:\s*[\"']\*[\"']|origin\s*:\s*[\"']\*[\"']", True, "CORS allows any origin", "HIGH", "CORS policy allows arbitrary origins - data exposure risk."),
    (r"@csrf_exempt\b", False, "@csrf_exempt used", "MEDIUM", "Django CSRF protection explicitly disabled for this view."),
    (r"\.run\s*\([^)]*debug\s*=\s*True", False, "Flask debug mode in run()", "HIGH", "Flask development server with debug=True exposes interactive debugger (RCE via Werkzeug console)."),
)
JNDI_TEXT = "${jndi:...} lookup payload present - Log4Shell-style remote code execution vector."
SQL_TEXT = "Database query assembled via concatenation or template interpolation - SQL injection risk. Use parameterized statements."


def _numbered(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line, k: F.struct((k + 1).alias("n"), line.alias("s")))


def _hit(line: Column, kind: Column, severity: Column, shown: Column, told: Column, category: str) -> Column:
    return F.struct(
        line["n"].cast("int").alias("line"), F.concat(F.lit("Context: "), kind).alias("type"), severity.alias("severity"), shown.alias("snippet"),
        told.alias("description"), F.lit(category).alias("category"), F.lit("context").alias("analyzer"),
    )


def _where(may: Column, lines: Column, keep, make) -> Column:
    """Hits of the lines that ``keep``; a file that fails the cheap test ``may`` has none."""
    return F.when(may, F.transform(F.filter(lines, keep), make)).otherwise(F.array().cast(HITS))


def detectors(raw: Column, clean: Column, ext: Column, path: Column) -> list[Column]:
    """Arrays of hits: JNDI payloads, dynamic SQL, configuration, credentials."""
    test, lines, clean_lines = C.is_test_path(path), _numbered(raw), _numbered(clean)
    plain = lambda s: C.snippet(s["s"])
    out = []
    jndi = "(?idU)" + JNDI
    out.append(_where(F.contains(F.lower(raw), F.lit("${jndi:")), lines, lambda s: s["s"].rlike(jndi), lambda s: _hit(s, F.lit("JNDI lookup payload"), F.lit("CRITICAL"), plain(s), F.lit(JNDI_TEXT), "INJECTION")))
    sink, dynamic = "(?idU)" + SQL_SINK, C.TEXT_FLAGS + DYNAMIC_ARGUMENT
    arguments = lambda s: F.substring(s, F.instr(s, "(") + 1, F.length(s))
    severity = F.when(test, "MEDIUM").otherwise("CRITICAL")
    called = lambda s: let(F.lower(s), lambda low: F.exists(F.array(*map(F.lit, SQL_NAMES)), lambda n: F.contains(low, n)))
    out.append(
        _where(ext.isin(*SQL_EXTS) & called(clean), clean_lines, lambda s: F.contains(s["s"], F.lit("(")) & called(s["s"]) & s["s"].rlike(sink) & arguments(s["s"]).rlike(dynamic), lambda s: _hit(s, F.lit("SQL built from dynamic string"), severity, plain(s), F.lit(SQL_TEXT), "INJECTION"))
    )
    for pattern, any_case, kind, level, told in CONFIG_CHECKS:
        p = ("(?idU)" if any_case else C.TEXT_FLAGS) + pattern
        out.append(_config(raw, lines, p, kind, F.when(test, "LOW").otherwise(level), told))
    secret = "(?idU)" + CREDENTIAL
    part = lambda s, k: F.regexp_extract(s, secret, k)
    lower = lambda v: F.lower(C.strip(v))
    excused = lambda v: F.exists(F.array(*map(F.lit, tables.SAFE_CREDENTIAL_WORDS)), lambda w: F.contains(lower(v), w))
    quoted = lambda s: (F.contains(s, F.lit("=")) | F.contains(s, F.lit(":"))) & (F.contains(s, F.lit('"')) | F.contains(s, F.lit("'")) | F.contains(s, F.lit("`")))
    keep = lambda s: quoted(s["s"]) & s["s"].rlike(secret) & ~C.is_placeholder(C.strip(part(s["s"], 3))) & ~(test & excused(part(s["s"], 3)))
    masked = lambda s: F.left(F.replace(C.strip(s["s"]), part(s["s"], 3), F.repeat(F.lit("*"), F.least(F.length(C.strip(part(s["s"], 3))), F.lit(12)))), F.lit(C.SNIPPET))
    told = lambda s: F.concat(F.lit("Credential '"), part(s["s"], 1), F.lit("' hardcoded in "), ext, F.lit(" source. Move to environment variables or a secrets manager."))
    level = F.when(test, "HIGH").otherwise("CRITICAL")
    named = let(F.lower(raw), lambda low: F.exists(F.array(*map(F.lit, ("pass", "pwd", "secret", "key", "token"))), lambda n: F.contains(low, n)))
    out.append(_where(named, lines, keep, lambda s: _hit(s, F.lit("hardcoded credential"), level, masked(s), told(s), "AUTH")))
    return out


def _config(raw: Column, lines: Column, pattern: str, kind: str, severity: Column, told: str) -> Column:
    # each of the patterns ends in what is true, in a star, or in a name that is a search of its own
    may = F.contains(raw, F.lit("*")) | F.contains(raw, F.lit("@")) | F.contains(F.lower(raw), F.lit("true"))
    return _where(may & raw.rlike(pattern), lines, lambda s: s["s"].rlike(pattern), lambda s: _hit(s, F.lit(kind), severity, C.snippet(s["s"]), F.lit(told), "CONFIG"))


def context_findings(files: DataFrame) -> DataFrame:
    """Findings of all context detectors; only code files are read."""
    code = files.filter(F.col("ext").isin(*tables.CODE_EXTS) & (F.col("content") != "")).select("path", "ext", "content")
    found = blanked(code).select("path", F.concat(*detectors(F.col("content"), F.col("clean"), F.col("ext"), F.col("path"))).alias("hits"))
    return found.select(F.col("path").alias("file"), F.posexplode("hits").alias("k", "h")).select(
        "file", "h.*", F.lit(STAGE["context"]).alias("stage"), (F.col("k") + 1).cast("long").alias("seq")
    )
