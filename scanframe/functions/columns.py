"""Native column functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.schema import SEVERITIES

#: Java flags that give patterns the meaning they have in Python with IGNORECASE and MULTILINE:
#: Unicode classes, and ``.`` and ``$`` that know no line end but ``\n``.
RULE_FLAGS = "(?idmU)"
TEXT_FLAGS = "(?dU)"
SNIPPET = 120


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` knows spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def snippet(line: Column) -> Column:
    return F.substring(strip(line), 1, SNIPPET)


def extension(name: Column) -> Column:
    """The lower-cased suffix of a file name; a leading or a last dot makes none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def one_of(mapping: dict[str, str], key: Column, default: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key), default)


def language_of(ext: Column) -> Column:
    return one_of(tables.LANGUAGE_OF_EXT, ext, F.lit("unknown"))


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; anything unknown ranks with INFO."""
    return one_of({s: str(k) for k, s in enumerate(SEVERITIES)}, severity, F.lit(str(len(SEVERITIES) - 1))).cast("int")


def known_severity(severity: Column) -> Column:
    return F.when(severity.isin(*SEVERITIES), severity).otherwise(F.lit("INFO"))


def is_pruned(path: Column) -> Column:
    """Whether a directory on the way to the file is one that scans leave out."""
    parents = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parents, lambda d: d.isin(*tables.EXCLUDED_DIRS))


def is_wanted(name: Column) -> Column:
    """Whether a file is read: by extension, suspicious name or manifest name."""
    return extension(name).isin(*tables.TEXT_EXTS) | name.isin(*tables.SUSPICIOUS_FILES) | name.isin(*tables.MANIFESTS)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("test|spec|mock|fixture|e2e|integration")


def is_placeholder(value: Column) -> Column:
    """Whether a literal stands for a value to be filled in rather than being one."""
    v = F.lower(F.regexp_replace(strip(value), "^['\"]+|['\"]+$", ""))
    bare = F.replace(F.replace(v, F.lit("%s"), F.lit("")), F.lit("%d"), F.lit(""))
    return (
        v.isin(*tables.PLACEHOLDERS)
        | (F.length(v) < 6)
        | v.rlike(r"^[$%<{\[]|[}>\]]$")
        | v.rlike(r"^[x*.·_-]*$")
        | F.contains(value, F.lit("{{"))
        | F.contains(value, F.lit("{%"))
        | (F.contains(v, F.lit("%")) & (F.length(bare) < 3))
    )


def first_quoted(text: Column) -> Column:
    """The first quoted literal of two or more characters, or null."""
    quoted = F.regexp_extract(text, r"'[^'\n]{2,}'|\"[^\"\n]{2,}\"|`[^`\n]{2,}`", 0)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def is_credible(match: Column) -> Column:
    """Whether a credential match has no quoted literal or one that is no placeholder."""
    return F.coalesce(~is_placeholder(first_quoted(match)), F.lit(True))


def framework_of(content: Column) -> Column:
    low, out = F.lower(content), F.lit(None).cast("string")
    for needle, framework in reversed(tables.FRAMEWORK_HINTS):
        out = F.when(F.contains(low, F.lit(needle)), F.lit(framework)).otherwise(out)
    return out


def is_comment_line(line: Column, language: Column) -> Column:
    """Whether a stripped line is a comment in the language."""
    return (
        F.when(language == "python", F.startswith(line, F.lit("#")))
        .when(language.isin("javascript", "java"), line.rlike(r"^(?://|/\*|\*)"))
        .when(language == "php", line.rlike(r"^(?://|#|/\*)"))
        .otherwise(F.lit(False))
    )


def holds_word(text: Column, word: Column) -> Column:
    """Whether ``word`` occurs in ``text`` as a word of its own."""
    return F.array_contains(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), word)


def version_key(version: Column) -> Column:
    """The first four numbers of a version, padded with zeros: arrays compare as versions do."""
    numbers = F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), 1, 4), lambda x: x.cast("decimal(38,0)"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("decimal(38,0)"), 4)), 1, 4)


def is_vulnerable(version: Column, vulnerable: Column) -> Column:
    """Prefix match, or numerically at or below; a version without a number is never below."""
    return F.startswith(version, vulnerable) | (version.rlike(r"\d") & (version_key(version) <= version_key(vulnerable)))


def clean_package(package: Column) -> Column:
    """Lower-cased; of scoped names (``group:artifact``, ``@scope/name``) the last part."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(package)), "(?s)^.*:", ""), "(?s)^.*/", "")


def clean_version(version: Column) -> Column:
    return strip(F.regexp_replace(version, "^[v^~>=< ]+", ""))


def path_text(variables: Column) -> Column:
    return F.array_join(variables, " -> ")


def shortened(c: Column, limit: int, tail: bool = False) -> Column:
    """At most ``limit`` characters, the last (or first) three being dots."""
    cut = F.concat(F.lit("..."), F.right(c, F.lit(limit - 3))) if tail else F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def report_line() -> Column:
    return F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" | "), "severity", F.lit(" | "), "type", F.lit(" | "), "description")


def rule_id() -> Column:
    return F.concat(F.upper(F.left("analyzer", F.lit(4))), F.lit("-"), F.upper("category"))


def report_level(severity: Column) -> Column:
    return one_of({"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none"}, F.upper(severity), F.lit("warning"))


#: Values that ``running`` joins one by one.
RUN = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, though functions in ``body`` use it again
    and again: the optimizer would put a column's expression in each place that names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of all values before each one, in steps that grow with their number.

    Joined within chunks of RUN values, over chunks, and over chunks of chunks, a join a value:
    a chunk's results are put behind each other. ``zero`` is for nothing before, and an empty
    array gives null.
    """
    every = lambda x: F.aggregate(x, zero, join)
    part = lambda x, c: F.slice(x, c * RUN + 1, F.lit(RUN))
    numbers = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int"))
    sums = lambda x: F.transform(numbers(x), lambda c: every(part(x, c)))
    onward = lambda x, base: F.slice(F.aggregate(x, F.array(base), lambda a, v: F.array_append(a, join(F.element_at(a, -1), v))), F.lit(1), F.size(x))
    within = lambda x, bases: F.flatten(F.transform(bases, lambda base, c: onward(part(x, c), base)))
    first = lambda x: F.transform(x, lambda _, c: every(F.slice(x, F.lit(1), c)))
    found = let(values, lambda v: let(sums(v), lambda t: let(sums(t), lambda u: within(v, within(t, first(u))))))
    return F.when(F.size(values) > 0, found)


def match_lines(text: Column, pattern: str | Column, needle: str = "") -> Column:
    """``array<struct<line, match, snippet>>`` of all matches, with the line each starts on.

    ``pattern`` may be a column. The k-th match starts after the first k + 1 gaps and the first k matches; the line ends in
    those are counted, as a running sum. A match may span lines, so the text is never cut into
    lines first.
    """
    p = F.concat(F.lit(RULE_FLAGS), pattern) if isinstance(pattern, Column) else F.lit(RULE_FLAGS + pattern)
    ends = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).cast("int")
    add = lambda a, x: a + x

    def lines(found: Column, gaps: Column, raw: Column) -> Column:
        within = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: ends(g) + ends(m))
        at = lambda before, m, k: F.get(before, k) + ends(F.get(gaps, k))
        hit = lambda n, m: F.struct(n.alias("line"), m.alias("match"), snippet(F.get(raw, n - 1)).alias("snippet"))
        return let(running(within, F.lit(0), add), lambda before: F.transform(found, lambda m, k: hit(at(before, m, k) + 1, m)))

    none = F.array().cast("array<struct<line:int,match:string,snippet:string>>")
    found = let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: let(F.split(text, p, -1), lambda gaps: let(F.split(text, "\n"), lambda raw: lines(found, gaps, raw))))
    may = F.contains(F.lower(text), F.lit(needle)) if needle else F.lit(True)
    return F.when(may & F.rlike(text, p), found).otherwise(none)
