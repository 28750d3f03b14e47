"""Rule matching: a catalogue in Arrow batches, or one rule in native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.functions import code, source
from scanframe.schema import STAGE

_ARROW = [("file", pa.string()), ("line", pa.int32()), *[(n, pa.string()) for n in ("type", "severity", "snippet", "description", "category", "analyzer")], ("stage", pa.int32()), ("seq", pa.int64())]
_SCANNED = [*_ARROW, ("status", pa.string()), ("errors", pa.string())]
HITS = "array<struct<type:string,severity:string,category:string,description:string,line:int,match:string,snippet:string,seq:bigint>>"
RANKED_DDL = "file string, line int, type string, severity string, snippet string, description string, category string, analyzer string, stage int, seq long"


def rules_table(spark: SparkSession) -> DataFrame:
    """``name, pattern, severity, category, description, ext, needle``: a row a rule and
    extension; config rules have a null extension, which stands for all."""
    rows = [(*r[:5], ext, source.needle(r[1])) for r in tables.LANGUAGE_RULES for ext in r[5].split()]
    rows += [(*r, None, source.needle(r[1])) for r in tables.CONFIG_RULES]
    return spark.createDataFrame(rows, "name string, pattern string, severity string, category string, description string, ext string, needle string")


def detect(path: str, ext: str, language: str, content: str, calls: list[source.Hit], flows: list[source.Hit]) -> Iterator[tuple[str, list[source.Hit] | Exception]]:
    """(stage, findings) of the detectors on one file, in stage order; ``calls`` and ``flows`` are
    those of tokens and taint, which native functions have found (``_native``).

    Each detector is on its own: what one raises is handed on and costs no other's findings.
    """

    def tried(find):
        try:
            return list(find())
        except Exception as e:  # noqa: BLE001
            return e

    yield "secret", tried(lambda: source.scan_rules(content, source.secret_rules()))
    yield "config", tried(lambda: source.scan_rules(content, source.config_rules()))
    rules = source.language_rules(ext)
    if language == "unknown" or not rules:
        return
    if language == "javascript":
        dialect = ".ts" if ext in (".ts", ".tsx") else ".js"
    else:
        dialect = ext
    if language == "python":
        yield "language", tried(lambda: source.scan_python(content))
    elif language != "generic":
        yield "language", calls
    yield "language", tried(lambda: source.scan_rules(source.blank(content, dialect), rules))
    yield "language", flows


def _native() -> tuple[Column, Column]:
    """What tokens and taint tell of a file: beside its row, so that the file is read once."""
    language, content, ext = F.col("language"), F.col("content"), code.dialect(F.col("language"), F.col("ext"))
    none = F.array().cast(code.HITS)
    calls = F.when(~language.isin("unknown", "python", "generic"), code.token_hits(content, ext)).otherwise(none)
    flows = F.when(language != "unknown", code.taint_hits(content, ext)).otherwise(none)
    return calls.alias("calls"), flows.alias("flows")


#: Files that a task holds as Python objects at a time, with what is found in them.
FILES = 256


def in_parts(batches: Iterable[pa.RecordBatch], rows: int = FILES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what is made of one as Python objects does not grow with a task's input."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _hits(column: pa.ListArray) -> Iterator[list[source.Hit]]:
    """The findings in each row: read field by field, as a struct's own objects are slow to make."""
    found = list(map(source.Hit, *(f.to_pylist() for f in column.flatten().flatten())))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield found[at : (at := at + (n or 0))]


#: A detector of a user's own: (content, extension) to findings; it runs in Arrow batches.
Detector = Callable[[str, str], Iterable[source.Hit]]


def scanned(files: DataFrame, extra: dict[str, Detector] | None = None) -> DataFrame:
    """RANKED findings of the secret, config and language detectors and of ``extra``, and beside them a
    row a file with ``status`` and ``errors`` (null for findings): one pass over the files.

    Tokens and taint are native; rules in Python's regex dialect and syntax trees run in Arrow
    batches, which hand the native findings on in their place. A file is ``failed`` if a detector
    raised, which costs no other's findings, ``skipped`` if its content is null, else
    ``analyzed``; there is nothing to find in empty ones.
    """
    more = dict(extra or {})

    def of(path: str, ext: str, language: str, content: str | None, calls: list, flows: list) -> Iterator[tuple]:
        if content is None:
            yield (path, *[None] * 9, "skipped", "")
            return
        counts: dict[str, int] = {}
        errors = []
        for stage, found in (*detect(path, ext, language, content, calls, flows), *_tried(more, content, ext)) if content else ():
            if isinstance(found, Exception):
                errors.append(f"{stage}: {type(found).__name__}")
                continue
            for h in found:
                own = stage if stage in STAGE else "language"
                counts[own] = counts.get(own, 0) + 1
                yield (path, *h, STAGE[own], counts[own], None, None)
        yield (path, *[None] * 9, "failed" if errors else "analyzed", "; ".join(errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            *told, calls, flows = b.columns
            rows = [r for file in zip(*(c.to_pylist() for c in told), _hits(calls), _hits(flows), strict=True) for r in of(*file)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _SCANNED, strict=True)], [n for n, _ in _SCANNED])

    return files.select("path", "ext", "language", "content", *_native()).mapInArrow(run, f"{RANKED_DDL}, status string, errors string")


def _tried(detectors: dict[str, Detector], content: str, ext: str) -> Iterator[tuple[str, list[source.Hit] | Exception]]:
    for name, find in detectors.items():
        try:
            yield name, list(find(content, ext))
        except Exception as e:  # noqa: BLE001
            yield name, e


def procedural(files: DataFrame, extra: dict[str, Detector] | None = None) -> DataFrame:
    """The findings of ``scanned``."""
    return findings_of(scanned(files.filter(F.col("content") != ""), extra))


def findings_of(rows: DataFrame) -> DataFrame:
    return rows.filter("status IS NULL").drop("status", "errors")


def status_of(rows: DataFrame) -> DataFrame:
    """``path, status, errors`` of each file that ``scanned`` has seen."""
    return rows.filter("status IS NOT NULL").select(F.col("file").alias("path"), "status", "errors")


def syntax_findings(files: DataFrame) -> DataFrame:
    """RANKED findings of Python's syntax trees alone; only Python files are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            rows = [(path, *h, STAGE["language"], k) for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, h in enumerate(source.scan_python(content), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ARROW, strict=True)], [n for n, _ in _ARROW])

    return files.filter("language = 'python' AND content <> ''").select("path", "content").mapInArrow(run, RANKED_DDL)


def taint_findings(files: DataFrame) -> DataFrame:
    """RANKED findings of the taint fold alone, without a Python worker."""
    return _of_native(files, 1)


def token_findings(files: DataFrame) -> DataFrame:
    """RANKED findings of the token detectors alone, without a Python worker."""
    return _of_native(files, 0)


def _of_native(files: DataFrame, which: int) -> DataFrame:
    each = files.filter(F.col("content") != "").select("path", F.posexplode(_native()[which]).alias("k", "h"))
    return each.select(F.col("path").alias("file"), "h.*", F.lit(STAGE["language"]).alias("stage"), (F.col("k") + 1).cast("long").alias("seq"))


def status(files: DataFrame) -> DataFrame:
    """``status_of`` a scan of its own."""
    return status_of(scanned(files))


def match_native(files: DataFrame, name: str, pattern: str, severity: str, category: str, description: str, stage: str = "config") -> DataFrame:
    """Findings of one rule in native expressions, behind the literal that its matches start with.

    ``files`` needs ``path`` and ``content``. The pattern must mean the same in Java.
    """
    found = files.select("path", F.posexplode(C.match_lines(F.col("content"), pattern, source.needle(pattern))).alias("k", "m"))
    return found.select(
        F.col("path").alias("file"),
        F.col("m.line").alias("line"),
        F.lit(name).alias("type"),
        F.lit(severity).alias("severity"),
        F.col("m.snippet").alias("snippet"),
        F.lit(description).alias("description"),
        F.lit(category).alias("category"),
        F.lit("pattern").alias("analyzer"),
        F.lit(STAGE[stage]).alias("stage"),
        (F.col("k") + 1).cast("long").alias("seq"),
    )


_RULE = ("type", "pattern", "severity", "category", "description")


def may_match(content: Column, catalogue) -> Column:
    """The rules of a catalogue, as structs, that may match a text: it holds a literal which their
    matches require, or they require none."""
    entry = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(_RULE, r, strict=True)], F.array(*map(F.lit, source.needles(r[1]))).cast("array<string>").alias("needles"))
    known = F.array(*[entry(r) for r in catalogue])
    return C.let(F.lower(content), lambda low: F.filter(known, lambda r: (F.size(r["needles"]) == 0) | F.exists(r["needles"], lambda n: F.contains(low, n))))


#: What makes a match of a rule count: a condition on the match.
Validators = dict[str, Callable[[Column], Column]]


def hits(content: Column, catalogue, validators: Validators | None = None) -> Column:
    """``array<struct<type, severity, category, description, line, match, snippet, seq>>``: every
    match of every rule of a catalogue ``(name, pattern, severity, category, description)`` in a text.

    Native, and one pass: a rule is tried on texts that hold a literal which its matches require.
    What is quoted in matches of the rules named in ``VALIDATED`` must not be a placeholder, and
    ``validators`` judge the matches of the rules that they name. ``seq`` counts a rule's
    matches. The patterns must mean the same in Java.
    """

    def of(r: Column) -> Column:
        hit = lambda m, k: F.struct(*[r[n].alias(n) for n in _RULE if n != "pattern"], *[m[n].alias(n) for n in ("line", "match", "snippet")], (k + 1).cast("long").alias("seq"))

        def counts(x: Column) -> Column:
            good = ~x["type"].isin(*source.VALIDATED) | C.is_credible(x["match"])
            for name, judge in (validators or {}).items():
                good &= (x["type"] != name) | F.coalesce(judge(x["match"]), F.lit(False))
            return good

        return F.filter(F.transform(C.match_lines(content, r["pattern"]), hit), counts)

    return F.coalesce(F.flatten(F.transform(may_match(content, catalogue), of)), F.array().cast(HITS))


def occurrences(files: DataFrame, catalogue, validators: Validators | None = None) -> DataFrame:
    """RANKED findings of a catalogue in native expressions: a row a match, rules in their order."""
    return _occurred(files, catalogue, validators).drop("match")


def _occurred(files: DataFrame, catalogue, validators: Validators | None) -> DataFrame:
    found = files.select("path", F.posexplode(hits(F.col("content"), catalogue, validators)).alias("k", "m"))
    return found.select(
        F.col("path").alias("file"), "m.line", "m.type", "m.severity", "m.snippet", "m.description", "m.category", F.lit("pattern").alias("analyzer"),
        F.lit(STAGE["config"]).alias("stage"), (F.col("k") + 1).cast("long").alias("seq"), "m.match",
    )


#: Rules that a table may hold: they are part of the plan.
MOST_RULES = 5000


def table_findings(files: DataFrame, rules: DataFrame) -> DataFrame:
    """RANKED findings of the rules in a table: ``name, pattern, severity, category, description``, and
    ``validator``, a SQL condition on ``match, file, line, snippet`` that a match must meet, or null.

    A pattern that does not compile is an error, as is a table of more than MOST_RULES.
    """
    own = rules.select("name", "pattern", "severity", "category", "description", "validator").orderBy("name").limit(MOST_RULES + 1).collect()
    if len(own) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not own:
        return files.sparkSession.createDataFrame([], RANKED_DDL)
    for r in own:
        re.compile(r.pattern)
    found = _occurred(files, [tuple(r)[:5] for r in own], None)
    for r in own:
        if r.validator:
            found = found.filter((F.col("type") != r.name) | F.coalesce(F.expr(r.validator), F.lit(False)))
    return found.drop("match")


def suspicious_files(files: DataFrame) -> DataFrame:
    """Files that are findings by their name, empty ones too: a join with a fixed table."""
    spark = files.sparkSession
    names = F.broadcast(spark.createDataFrame(list(tables.SUSPICIOUS_FILES.items()), "name string, description string"))
    return files.select("path", "name").join(names, "name").select(
        F.col("path").alias("file"), F.lit(0).alias("line"), F.concat(F.lit("Suspicious File ("), "name", F.lit(")")).alias("type"), F.lit("HIGH").alias("severity"),
        F.col("name").alias("snippet"), "description", F.lit("CONFIG").alias("category"), F.lit("file").alias("analyzer"), F.lit(STAGE["file"]).alias("stage"), F.lit(1).cast("long").alias("seq"),
    )


def tokenize(files: DataFrame) -> DataFrame:
    """``path, ext, pos, type, value, line, col``: the code tokens of every file, natively."""
    return files.select("path", "ext", F.explode(code.tokens(F.coalesce("content", F.lit("")))).alias("t")).select("path", "ext", "t.*")


def dangerous_calls(tokens: DataFrame) -> DataFrame:
    """Tokens that call a dangerous function: a hash join on (ext, value) with a fixed table."""
    table = tokens.sparkSession.createDataFrame(list(tables.DANGEROUS_CALLS), "ext string, value string, severity string, category string")
    return tokens.filter("type = 'FUNCTION_CALL'").join(F.broadcast(table), ["ext", "value"])


def markup_writes(tokens: DataFrame) -> DataFrame:
    """Names that write markup and are followed by ``=`` or ``(``."""
    from pyspark.sql import Window

    following = F.lead("value").over(Window.partitionBy("path").orderBy("pos"))
    own = tokens.filter(F.col("ext").isin(*tables.BACKTICK_EXTS)).withColumn("following", following)
    return own.filter((F.col("type") == "IDENT") & F.col("value").isin(*tables.XSS_NAMES) & F.col("following").isin("=", "("))


def blanked(files: DataFrame) -> DataFrame:
    """``files`` with ``clean``: content without comments and strings, line by line in place."""
    schema = files.select("*", F.lit("").alias("clean")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [source.blank(c or "", e or "") for c, e in zip(b.column("content").to_pylist(), b.column("ext").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(clean, pa.string())], [*b.schema.names, "clean"])

    return files.mapInArrow(run, schema)


def code_lines(files: DataFrame) -> DataFrame:
    """``path, lines``: the numbers, from 1, of the lines that are not comments as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [[k + 1 for k in source.code_lines(c or "", e or "")] for c, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.list_(pa.int32()))], ["path", "lines"])

    return files.select("path", "content", "ext").mapInArrow(run, "path string, lines array<int>")
