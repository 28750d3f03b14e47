"""Native column functions of a file's code: tokens, what they tell, and the taint fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.functions.columns import let

TOKENS = "array<struct<pos:int,type:string,value:string,line:int,col:int>>"
#: What a detector finds in one file, in its order.
HITS = "array<struct<line:int,type:string,severity:string,snippet:string,description:string,category:string,analyzer:string>>"
_ALIAS = ("line", "type", "severity", "snippet", "description", "category", "analyzer")


def _hit(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, _ALIAS, strict=True)])


def dialect(language: Column, ext: Column) -> Column:
    """The extension whose tables a file is judged by."""
    return F.when(language == "javascript", F.when(ext.isin(".ts", ".tsx"), ".ts").otherwise(".js")).otherwise(ext)


# ---------------------------------------------------------------- tokens


def _alternation() -> str:
    """All token classes in their order; the calls' is the one group. Loops over strings give
    nothing back, which changes no match and keeps Java's matcher off its stack. White space, where
    no other class can start, is left to the gaps."""
    parts = []
    for name, pattern in tables.TOKEN_CLASSES:
        if name in ("NEWLINE", "SKIP"):
            continue
        if name.startswith("STRING"):
            pattern = pattern.replace(")*", ")*+")
        parts.append(f"({pattern})" if name == "FUNCTION_CALL" else f"(?:{pattern})")
    return C.TEXT_FLAGS + "|".join(parts)


def _class(value: Column, call: Column) -> Column:
    """A token's class, read off its first characters; null for what is dropped."""
    dropped = value.rlike(r"^(?://|[#\"'])") | (value.startswith("/*") & value.endswith("*/") & (F.length(value) > 3))
    return (
        F.when(dropped, F.lit(None))
        .when(value.startswith("$"), "VARIABLE")
        .when(call != "", "FUNCTION_CALL")
        .when(value.rlike(r"(?U)^\d"), "NUMBER")
        .when(value.rlike(r"^[+\-*/%=<>!&|^~?:]"), "OPERATOR")
        .when(value.rlike(r"^[(){}\[\];,.]"), "PUNCTUATION")
        .otherwise("IDENT")
    )


def tokens(content: Column) -> Column:
    """Code tokens, TOKENS; comments, strings and white space are dropped. Lines and columns are
    those of the text, whatever was dropped before.

    Tokens and the gaps between them make up the text, so where a token starts is a running sum
    of lengths over both, its line one of line ends, and its column what lies between it and
    the line's start. All sums are of plain numbers: a struct's fields would each sum again.
    """
    pattern, zero = _alternation(), F.lit(0)
    add = lambda a, x: a + x
    ends = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("\n")))).cast("int")
    both = lambda f, found, gaps: F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: f(g) + f(v))

    def placed(found: Column, gaps: Column, calls: Column, rows: Column, chars: Column, starts: Column) -> Column:
        def token(v: Column, k: Column) -> Column:
            at = F.get(chars, k) + F.length(F.get(gaps, k))
            own = lambda line: F.struct(_class(v, F.get(calls, k)).alias("type"), v.alias("value"), (line + 1).alias("line"), (at - F.get(starts, line)).alias("col"))
            return let(F.get(rows, k) + ends(F.get(gaps, k)), own)

        return F.filter(F.transform(found, token), lambda t: t["type"].isNotNull())

    def numbered(found: Column, gaps: Column) -> Column:
        calls = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        widths = F.transform(F.split(content, "\n"), lambda line: F.length(line) + 1)
        sums = (calls, C.running(both(ends, found, gaps), zero, add), C.running(both(F.length, found, gaps), zero, add), C.running(widths, zero, add))
        kept = let(sums[0], lambda c: let(sums[1], lambda r: let(sums[2], lambda n: let(sums[3], lambda s: placed(found, gaps, c, r, n, s)))))
        return F.transform(kept, lambda t, k: F.struct(k.alias("pos"), t["type"].alias("type"), t["value"].alias("value"), t["line"].alias("line"), t["col"].alias("col")))

    all_of = let(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(content, pattern, -1), lambda gaps: numbered(found, gaps))))
    return F.coalesce(all_of, F.array().cast(TOKENS))


def _by_ext(values: dict[str, Column], ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), ext)


def _telling() -> tuple[str, str]:
    """A pattern of all up to and with the next dangerous call or write of markup, and one of the name at its end.

    A match starts where the one before ended, and what is passed over is whole tokens, so no name in a comment
    or a string counts. Loops give nothing back.
    """
    dropped = [p.replace(")*", ")*+") for n, p in tables.TOKEN_CLASSES if n.startswith(("COMMENT", "STRING"))]
    kept = [p for n, p in tables.TOKEN_CLASSES if not n.startswith(("COMMENT", "STRING", "NEWLINE", "SKIP"))]
    operator = dict(tables.TOKEN_CLASSES)["OPERATOR"]
    calls, writes = "|".join(sorted({name for _, name, _, _ in tables.DANGEROUS_CALLS})), "|".join(tables.XSS_NAMES)
    gap = rf"(?:\s++|{'|'.join(dropped)}|(?!{'|'.join(kept)})[\s\S])*+"
    told = rf"\b(?:(?:{calls})\b(?=\s*+\()|(?:{writes})\b(?!\s*+\()(?={gap}(?:=(?!{operator})|\()))"
    return rf"{C.TEXT_FLAGS}\G(?:\s++|(?!{told})(?:{'|'.join([*dropped, *kept])}|[\s\S]))*+{told}", f"(?:{calls}|{writes})$"


def token_hits(content: Column, ext: Column) -> Column:
    """Dangerous calls, then names that write markup and are assigned or called: of the tokens (see
    ``tokens``) only these are cut out of a text."""
    calls: dict[str, list[Column]] = {}
    for e, name, severity, category in tables.DANGEROUS_CALLS:
        calls.setdefault(e, []).append(F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(category).alias("category")))
    known = _by_ext({e: F.array(*c) for e, c in calls.items()}, ext)
    pattern, name = _telling()
    ends = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("\n")))).cast("int")

    def of(found: Column, raw: Column) -> Column:
        shown = lambda t: F.substring(C.strip(F.get(raw, t["line"] - 1)), 1, C.SNIPPET)
        rule = lambda t: F.get(F.filter(known, lambda r: r["name"] == t["value"]), F.lit(0))

        def call(t: Column) -> Column:
            told = F.concat(F.lit("Lexer detected dangerous function '"), t["value"], F.lit("()'."))
            return _hit(t["line"], F.concat(F.lit("Lexer: "), t["value"], F.lit("()")), rule(t)["severity"], shown(t), told, rule(t)["category"], F.lit("lexer"))

        def write(t: Column) -> Column:
            told = F.concat(F.lit("Lexer detected XSS sink '"), t["value"], F.lit("'."))
            return _hit(t["line"], F.concat(F.lit("Lexer: XSS sink '"), t["value"], F.lit("'")), F.lit("HIGH"), shown(t), told, F.lit("XSS"), F.lit("lexer"))

        dangerous = F.filter(found, lambda t: F.coalesce(rule(t).isNotNull(), F.lit(False)))
        writes = F.filter(found, lambda t: t["value"].isin(*tables.XSS_NAMES))
        marked = F.when(ext.isin(*tables.BACKTICK_EXTS), F.transform(writes, write)).otherwise(F.array().cast(HITS))
        return F.concat(F.transform(dangerous, call), marked)

    def placed(parts: Column) -> Column:
        token = lambda before: F.transform(parts, lambda p, k: F.struct((F.get(before, k) + ends(p) + 1).alias("line"), F.regexp_extract(p, name, 0).alias("value")))
        return let(C.running(F.transform(parts, ends), F.lit(0), lambda a, x: a + x), token)

    # no token, no finding: a text without any of the names is not cut into tokens
    names = F.array(*map(F.lit, sorted({n for _, n, _, _ in tables.DANGEROUS_CALLS} | set(tables.XSS_NAMES))))
    may = ext.isin(*calls, *tables.BACKTICK_EXTS) & F.exists(names, lambda n: F.contains(content, n))
    none = F.array().cast(HITS)
    hits = let(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), lambda parts: F.when(F.size(parts) > 0, let(placed(parts), lambda found: let(F.split(content, "\n"), lambda raw: of(found, raw)))).otherwise(none))
    return F.when(may, hits).otherwise(none)


# ---------------------------------------------------------------- taint

_STATE = "struct<tainted:array<struct<name:string,origin:int>>,hits:" + HITS + ">"


def taint_hits(content: Column, ext: Column) -> Column:
    """An ordered fold over the lines; its state is the tainted variables, each with the line of
    its source, in the order in which they were first tainted, and what has been found.

    A line's sinks are judged before its assignment. A sink reports the variable on the line
    that was tainted first, else the first source on it. An assignment passes on the taint of
    the last tainted variable on its line, else taints by a source on it; a variable tainted
    anew keeps its place. A text without any source has no flow and is not read by lines.
    """
    entry = lambda label, pattern, severity: F.struct(F.lit(label).alias("label"), F.lit(C.TEXT_FLAGS + pattern).alias("pattern"), F.lit(severity).alias("severity"))
    sources = _by_ext({e: F.array(*map(F.lit, s)) for e, s in tables.TAINT_SOURCES.items()}, ext)
    sinks = _by_ext({e: F.array(*[entry(*k) for k in s]) for e, s in tables.TAINT_SINKS.items()}, ext)
    assignment = _by_ext({e: F.lit(C.TEXT_FLAGS + tables.TAINT_ASSIGNMENTS[e]) for e in tables.TAINT_SOURCES}, ext)

    def line(raw: Column, k: Column) -> Column:
        return F.struct((k + 1).alias("line"), C.strip(raw).alias("s"))

    def parts(x: Column) -> Column:
        return F.struct(
            x["line"].alias("line"), x["s"].alias("s"), F.regexp_extract_all(x["s"], F.lit(r"(?U)\w+"), F.lit(0)).alias("words"),
            F.filter(sources, lambda w: F.contains(x["s"], w)).alias("direct"), F.call_function("regexp_extract", x["s"], assignment, F.lit(1)).alias("target"),
        )

    def hit(x: Column, culprit: Column, origin: Column, k: Column) -> Column:
        number = x["line"].cast("string")
        told = F.concat(F.lit("Taint flow: untrusted value '"), culprit, F.lit("' (line "), origin.cast("string"), F.lit(") reaches dangerous sink '"), k["label"], F.lit("' (line "), number, F.lit(")."))
        return _hit(x["line"], F.concat(F.lit("Taint: "), culprit, F.lit(" -> "), k["label"]), k["severity"], F.substring(x["s"], 1, C.SNIPPET), told, F.lit("INJECTION"), F.lit("taint"))

    def step(state: Column, x: Column) -> Column:
        def judged(present: Column) -> Column:
            culprit = F.coalesce(F.get(present, F.lit(0))["name"], F.get(x["direct"], F.lit(0)))
            origin = F.coalesce(F.get(F.filter(state["tainted"], lambda t: t["name"] == culprit), F.lit(0))["origin"], x["line"])
            found = F.when(culprit.isNotNull(), F.transform(F.filter(sinks, lambda k: F.rlike(x["s"], k["pattern"])), lambda k: hit(x, culprit, origin, k))).otherwise(F.array().cast(HITS))
            others = F.filter(present, lambda t: t["name"] != x["target"])
            passed = F.coalesce(F.try_element_at(others, F.lit(-1))["origin"], F.when(F.size(x["direct"]) > 0, x["line"]))
            own = F.struct(x["target"].alias("name"), passed.alias("origin"))
            known = F.exists(state["tainted"], lambda t: t["name"] == x["target"])
            put = F.when(known, F.transform(state["tainted"], lambda t: F.when(t["name"] == x["target"], own).otherwise(t))).otherwise(F.concat(state["tainted"], F.array(own)))
            tainted = F.when((x["target"] != "") & passed.isNotNull(), put).otherwise(state["tainted"])
            return F.struct(tainted.alias("tainted"), let(found, lambda f: F.when(F.size(f) > 0, F.concat(state["hits"], f)).otherwise(state["hits"])).alias("hits"))

        # most lines hold neither a source nor a tainted variable
        return let(F.filter(state["tainted"], lambda t: F.array_contains(x["words"], t["name"])), lambda present: F.when((F.size(present) > 0) | (F.size(x["direct"]) > 0), judged(present)).otherwise(state))

    lines = F.transform(F.filter(F.transform(F.split(content, "\n"), line), lambda x: x["s"] != ""), parts)
    zero = F.struct(F.array().cast("array<struct<name:string,origin:int>>").alias("tainted"), F.array().cast(HITS).alias("hits")).cast(_STATE)
    may = F.coalesce(F.exists(sources, lambda w: F.contains(content, w)), F.lit(False))
    return F.when(may, F.aggregate(lines, zero, lambda a, x: step(a, x).cast(_STATE), lambda a: a["hits"])).otherwise(F.array().cast(HITS))
