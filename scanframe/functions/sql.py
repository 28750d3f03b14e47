"""The scan functions for SQL: native scalar functions, and table functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scanframe import tables
from scanframe.functions import source


def _list(items: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in items)


#: Temporary SQL functions; the optimizer inlines their bodies.
SCALARS = {
    "severity_rank(s STRING) RETURNS INT": "CASE s WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END",
    "version_key(v STRING) RETURNS ARRAY<DECIMAL(38,0)>": r"slice(concat(transform(slice(regexp_extract_all(v, '\\d+', 0), 1, 4), x -> cast(x AS DECIMAL(38,0))), array_repeat(cast(0 AS DECIMAL(38,0)), 4)), 1, 4)",
    "is_placeholder(value STRING) RETURNS BOOLEAN": rf"""coalesce(transform(array(lower(regexp_replace(regexp_replace(value, '(?U)^\\s+|\\s+$', ''), '^[\'"]+|[\'"]+$', ''))), v ->
        v IN ({_list(tuple(sorted(tables.PLACEHOLDERS)))}) OR length(v) < 6 OR v RLIKE '^[$%<{{\\[]|[}}>\\]]$' OR v RLIKE '^[x*.·_-]*$' OR contains(value, '{{{{') OR contains(value, '{{%')
        OR (contains(v, '%') AND length(replace(replace(v, '%s', ''), '%d', '')) < 3))[0], false)""",
    "is_test_path(p STRING) RETURNS BOOLEAN": "lower(p) RLIKE 'test|spec|mock|fixture|e2e|integration'",
}


class _Tokenize:
    def eval(self, content: str) -> Iterator[tuple]:
        yield from map(tuple, source.tokens(content or ""))


class _ScanRules:
    def eval(self, content: str, ext: str) -> Iterator[tuple]:
        """Config rules on the text, then the extension's rules on the text without comments."""
        text = content or ""
        yield from map(tuple, source.scan_rules(text, source.config_rules()))
        yield from map(tuple, source.scan_rules(source.blank(text, ext or ""), source.language_rules(ext or "")))


class _ScanTaint:
    def eval(self, content: str, ext: str) -> Iterator[tuple]:
        yield from map(tuple, source.scan_taint(content or "", ext or ""))


class _ScanPython:
    def eval(self, content: str) -> Iterator[tuple]:
        yield from map(tuple, source.scan_python(content or ""))


_HIT = "line: int, type: string, severity: string, snippet: string, description: string, category: string, analyzer: string"
TABLES = {
    "tokenize": (_Tokenize, "pos: int, type: string, value: string, line: int, col: int"),
    "scan_rules": (_ScanRules, _HIT),
    "scan_taint": (_ScanTaint, _HIT),
    "scan_python": (_ScanPython, _HIT),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to ``spark.sql``, as in
    ``SELECT path, t.* FROM files, LATERAL scan_rules(content, ext) t``."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, (eval_class, returns) in TABLES.items():
        spark.udtf.register(name, udtf(eval_class, returnType=returns, useArrow=True))
