"""The line-level property graph: nodes and edges as DataFrames, reachability, flows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice
from operator import or_

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.schema import RANKED, STAGE

#: The languages whose files get a graph.
LANGUAGES = ("python", "javascript", "java", "php")

#: Rows that a task hands on at once.
ROWS = 65_536
#: Edges of one key that a task closes in memory; keys with more are closed by joins.
CLOSED_EDGES = 20_000


def _first_in(line: Column, names: tuple[str, ...], bare: str) -> Column:
    """The alphabetically first of ``names`` that the line holds, brackets at its end left off."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n.rstrip(bare)).alias("held")) for n in sorted(names)])
    return F.get(F.filter(known, lambda n: F.contains(line, n["held"])), F.lit(0))["name"]


def _by_language(language: Column, choose) -> Column:
    out = F.lit(None).cast("string")
    for k in LANGUAGES:
        out = F.when(language == k, choose(k)).otherwise(out)
    return out


def _group(line: Column, pattern: str, *groups: int) -> Column:
    p = C.TEXT_FLAGS + pattern
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, g), F.lit("")) for g in groups])


def _assignment(language: str) -> str:
    # the PHP pattern of the table has no group for the variable
    return r"^\s*\$(\w+)\s*=\s*(.+)" if language == "php" else tables.ASSIGNMENT_PATTERNS[language]


#: What a line must hold, one of them, to be a function's head.
_HEADS = {"python": ("def",), "javascript": ("function", "="), "java": ("(",), "php": ("function",)}


def _head(line: Column, language: str) -> Column:
    may = reduce(or_, [F.contains(line, F.lit(h)) for h in _HEADS[language]])
    return F.when(may, _group(line, tables.FUNCTION_PATTERNS[language], *_function_groups(language)))


def _function_groups(language: str) -> tuple[int, ...]:
    return (1, 2, 3) if language == "javascript" else (1,)


def nodes(files: DataFrame) -> DataFrame:
    """At most one node a line.

    What a line is: a comment; else a joined string, a source, a sink, an assignment or a
    function definition, the first of these that it is. An assignment's variable and value are
    kept whatever the node has become, as uses are looked up by them. Ids count a file's nodes.
    """
    code = files.filter(F.col("language").isin(*LANGUAGES) & (F.col("content") != "")).select("path", "language", "content")
    lang = F.col("language")

    def read(s: Column, k: Column) -> Column:
        joined = (
            F.when(lang == "python", s.rlike("f[\"']|%|\\.format\\("))
            .when(lang == "javascript", s.rlike("[`+]"))
            .when(lang == "java", F.contains(s, F.lit("+")) & (F.contains(s, F.lit('"')) | F.contains(s, F.lit("String"))))
            .otherwise(F.contains(s, F.lit(".")) & F.contains(s, F.lit('"')))
        )
        return F.struct(
            (k + 1).alias("line"),
            s.alias("s"),
            C.is_comment_line(s, lang).alias("is_comment"),
            _by_language(lang, lambda x: _head(s, x)).alias("function"),
            F.when(F.contains(s, F.lit("=")), _by_language(lang, lambda x: _group(s, _assignment(x), 1))).alias("variable"),
            F.when(F.contains(s, F.lit("=")), _by_language(lang, lambda x: _group(s, _assignment(x), 2))).alias("value"),
            _by_language(lang, lambda x: _first_in(s, tables.GRAPH_SINKS[x], "(")).alias("sink"),
            _by_language(lang, lambda x: _first_in(s, tables.GRAPH_SOURCES[x], "([")).alias("source"),
            joined.alias("joined"),
        )

    # read within the file's row: once exploded, a filter on what was read would be pushed
    # down together with all its patterns and run them again. Lines are stripped once, before
    # all that looks into them
    stripped = F.transform(F.split("content", "\n"), C.strip)
    parsed = code.select("path", "language", F.explode(F.transform(stripped, read)).alias("x")).select("path", "language", "x.*").filter("s <> ''")
    s = F.col("s")
    kind = (
        F.when(F.col("is_comment"), "comment")
        .when(F.col("joined"), "string_concat")
        .when(F.col("source").isNotNull(), "source")
        .when(F.col("sink").isNotNull(), "sink")
        .when(F.col("variable").isNotNull(), "assignment")
        .when(F.col("function").isNotNull(), "function")
    )
    k = F.col("node_type")
    label = (
        F.when(k == "comment", s)
        .when(k == "string_concat", F.left("s", F.lit(60)))
        .when(k == "source", F.rtrim(F.col("source"), F.lit("([")))
        .when(k == "sink", F.rtrim(F.col("sink"), F.lit("(")))
        .when(k == "assignment", F.concat("variable", F.lit(" = "), F.left(F.coalesce("value", F.lit("")), F.lit(50))))
        .otherwise(F.col("function"))
    )
    kept = parsed.withColumn("node_type", kind).filter("node_type IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    own = lambda c: F.when(~F.col("is_comment"), F.col(c))
    return kept.select(
        "path", F.concat(F.lit("n"), number.cast("string")).alias("id"), "node_type", label.alias("label"), "line", "language", own("variable").alias("variable"),
        own("value").alias("value"), (k == "source").alias("is_source"), (k == "sink").alias("is_sink"), "is_comment",
    )


def of_type(found: DataFrame, *kinds: str) -> DataFrame:
    return found.filter(F.col("node_type").isin(*kinds))


def control_edges(found: DataFrame) -> DataFrame:
    """Each node but comments to the next: one window a file."""
    before = F.lag("id").over(Window.partitionBy("path").orderBy("line"))
    return found.filter(~F.col("is_comment")).withColumn("source_id", before).filter("source_id IS NOT NULL").select("path", "source_id", F.col("id").alias("target_id"), F.lit("flows_to").alias("edge_type"), F.lit("").alias("label"))


_WORDS = re.compile(r"\w+")


def _uses(own: list[dict], words: bool = False) -> dict[str, list[int]]:
    """The nodes of a file that use each variable, by number from 1, in order.

    One automaton of the file's variables reads each label and stored value once, whatever the
    number of definitions. By default a use is a substring; with ``words`` a word of its own.
    """
    variables = {r["variable"] for r in own if r["variable"]}
    uses: dict[str, list[int]] = {v: [] for v in variables}
    if not variables:
        return uses
    automaton = ahocorasick.Automaton()
    for v in variables:
        automaton.add_word(v, v)
    automaton.make_automaton()
    for n, r in enumerate(own, 1):
        if not r["is_comment"]:
            found: set[str] = set()
            for text in (r["label"], r["value"] if r["node_type"] == "assignment" else None):
                if text:
                    found.update(variables.intersection(_WORDS.findall(text)) if words else (v for _, v in automaton.iter(text)))
            for v in found:
                uses[v].append(n)
    return uses


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """The nodes of each file, where a file's rows follow each other in order."""
    for path, own in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["path"]):
        yield path, list(own)


def _as_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """The nodes of each row of files: lines grow within it, so one that does not begins another row."""
    own: list[dict] = []
    for r in (r for b in batches for r in b.to_pylist()):
        if own and (r["path"] != own[-1]["path"] or r["line"] <= own[-1]["line"]):
            yield own[0]["path"], own
            own = []
        own.append(r)
    if own:
        yield own[0]["path"], own


def _in_order(found: DataFrame) -> DataFrame:
    """The nodes file by file, in their order. A window asks for that, so nodes that lie so already,
    as ``nodes`` leaves them, are not shuffled again."""
    number = F.row_number().over(Window.partitionBy("path").orderBy(F.substring("id", 2, 10).cast("int")))
    return found.select("path", number.alias("n"), *_READ).sortWithinPartitions("path", "n")


#: What is read of a file's nodes in their order.
_READ = ("node_type", "label", "line", "variable", "value", "is_source", "is_sink", "is_comment")


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, ROWS at a time: what a task holds does not grow with what it finds."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


_EDGES = "path string, source_id string, target_id string, edge_type string, label string"


def data_edges(found: DataFrame, words: bool = False) -> DataFrame:
    """Each definition to the nodes that use its variable, in time in proportion to a file's text
    and its edges (see ``_uses``). The nodes are shuffled once, by file."""

    def of(own: list[dict]) -> Iterator[tuple]:
        uses = _uses(own, words)
        for n, r in enumerate(own, 1):
            if v := r["variable"]:
                for m in uses[v]:
                    if m != n or r["node_type"] != "assignment":
                        yield r["path"], f"n{n}", f"n{m}", "data_flow", f"{v} flows to"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((e for _, own in _by_file(batches) for e in of(own)), [pa.string()] * 5, [f.split()[0] for f in _EDGES.split(", ")])

    return _in_order(found).mapInArrow(run, _EDGES)


def edges(found: DataFrame, words: bool = False) -> DataFrame:
    return control_edges(found).unionByName(data_edges(found, words))


def _components(following: dict) -> Iterator[list]:
    """Strongly connected components, each after all those that it leads to."""
    index: dict = {}
    low: dict = {}
    held, on = [], set()
    for root in following:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        work = [(root, iter(following[root]))]
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = len(index)
                    held.append(m)
                    on.add(m)
                    work.append((m, iter(following.get(m, ()))))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    found = []
                    while not found or found[-1] != n:
                        found.append(held.pop())
                    on.difference_update(found)
                    yield found


def _closure(pairs: set[tuple]) -> Iterator[tuple]:
    """All (source, target) with a walk of one or more edges, of one key's edges.

    Nodes on a common cycle reach the same ones, so what is reached is kept once a component,
    as the bits of an integer, and joined from the components that one leads to.
    """
    following: dict = defaultdict(list)
    for a, b in pairs:
        following[a].append(b)
    place: dict = {}
    names: list = []
    component: dict = {}
    reached: list[int] = []
    for own in _components(dict(following)):
        c = len(reached)
        bits = 0
        for n in own:
            place[n] = len(names)
            names.append(n)
            component[n] = c
            bits |= 1 << place[n]
        far, cyclic = 0, len(own) > 1
        for n in own:
            for m in following.get(n, ()):
                if component[m] == c:
                    cyclic = True
                else:
                    far |= (1 << place[m]) | reached[component[m]]
        reached.append(far | bits if cyclic else far)
        if reached[c] and any(n in following for n in own):
            targets, left = [], reached[c]
            while left:
                lowest = left & -left
                targets.append(names[lowest.bit_length() - 1])
                left ^= lowest
            for n in own:
                for m in targets:
                    yield n, m


def reachable(pairs: DataFrame, key: str = "path") -> DataFrame:
    """``key, source_id, target_id``: all nodes that a walk of one or more edges leads to.

    Keys of up to CLOSED_EDGES rows, as files are, meet in one task each and are closed there: one
    shuffle, no rounds. Keys with more go by joins (``_reachable_by_rounds``). Rows with a null
    are no edges.
    """
    pairs = pairs.select(key, "source_id", "target_id").dropna()
    large = pairs.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > CLOSED_EDGES).select(key)
    if not large.limit(1).count():
        return _closed(pairs, key)
    return _closed(pairs.join(large, key, "left_anti"), key).unionByName(_reachable_by_rounds(pairs.join(large, key, "left_semi"), key))


def _closed(pairs: DataFrame, key: str) -> DataFrame:
    names = [key, "source_id", "target_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for k, own in groupby(each, key=lambda r: r[0]):
            yield from ((k, *p) for p in _closure({r[1:] for r in own}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kinds = [f.type for f in first.schema]
            yield from _batches(rows(b for part in ([first], batches) for b in part), kinds, names)

    return pairs.repartition(key).sortWithinPartitions(key).mapInArrow(run, pairs.schema)


def _reachable_by_rounds(pairs: DataFrame, key: str) -> DataFrame:
    """A frontier join a round: a round adds only pairs not seen yet, so cycles end. Each round is
    written to the shared folder; there are as many as the longest of the shortest walks."""
    from scanframe.plans.stages import materialise

    steps = materialise(pairs.distinct(), "steps")
    seen = frontier = steps
    while True:
        onward = steps.select(key, F.col("source_id").alias("target_id"), F.col("target_id").alias("far"))
        following = frontier.join(onward, [key, "target_id"]).select(key, "source_id", F.col("far").alias("target_id")).distinct()
        frontier = materialise(following.join(seen, [key, "source_id", "target_id"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)


_FLOWS = "path string, source_id string, sink_id string, source string, sink string, source_line int, sink_line int, vars array<string>"
_FLOW_KINDS = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.list_(pa.string())]


def flows(found: DataFrame, words: bool = False) -> DataFrame:
    """``path, source_id, sink_id, source, sink, source_line, sink_line, vars``: for each source
    and sink of a file the shortest data-flow walk between them, if there is one.

    Edges are taken by the place of the definition and then of the use, so the walk found is
    always the same: of the shortest the one that comes first. Files without both are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (f for path, own in _by_file(batches) for f in _flows_in(path, own, words))
        return _batches(rows, _FLOW_KINDS, [f.split()[0] for f in _FLOWS.split(", ")])

    return _in_order(found).mapInArrow(run, _FLOWS)


def _tree(variable: str, uses: dict[str, list[int]], own: list[dict]) -> dict[int, int]:
    """Breadth first from a variable's definition: each node reached, with the node before it (0 for none).

    All definitions of a variable lead to the same nodes, so a variable is followed once, at the
    first of them, and no edge between definitions and uses is ever drawn.
    """
    came: dict[int, int] = {}
    queue: list[int] = []
    spent: set[str] = set()

    def follow(v: str, n: int) -> None:
        if v not in spent:
            spent.add(v)
            for m in uses[v]:
                if m not in came:
                    came[m] = n
                    queue.append(m)

    follow(variable, 0)
    for n in queue:
        if v := own[n - 1]["variable"]:
            follow(v, n)
    return came


def _flows_in(path: str, own: list[dict], words: bool = False) -> Iterator[tuple]:
    """The flows of one file. Sources of one variable share their search: what one of them
    reaches, and how, is the same for all."""
    sinks = [n for n, r in enumerate(own, 1) if r["is_sink"]]
    sources: dict[str, list[int]] = defaultdict(list)
    for n, r in enumerate(own, 1):
        if r["is_source"] and r["variable"]:
            sources[r["variable"]].append(n)
    if not (sinks and sources):
        return
    uses = _uses(own, words)
    shown = lambda r: r["variable"] if r["node_type"] == "assignment" and r["variable"] else r["label"]
    for v, starts in sources.items():
        came = _tree(v, uses, own)
        for t in sinks:
            if t not in came:
                continue
            walk = [t]
            while came[walk[-1]]:
                walk.append(came[walk[-1]])
            names, sink = [shown(own[n - 1]) for n in reversed(walk)], own[t - 1]
            for s in starts:
                source = own[s - 1]
                yield path, f"n{s}", f"n{t}", source["label"], sink["label"], source["line"], sink["line"], [shown(source), *names]


def summary(found: DataFrame, linked: DataFrame, flowing: DataFrame) -> DataFrame:
    """A row a file: nine counts, and whether it has both sources and sinks."""
    count = lambda c: F.count_if(c)
    kind = F.col("node_type")
    base = found.groupBy("path").agg(
        F.count("*").alias("total_nodes"), count(F.col("is_source")).alias("sources"), count(F.col("is_sink")).alias("sinks"), count(F.col("is_comment")).alias("comments"),
        count(kind == "string_concat").alias("string_concatenations"), count(kind == "function").alias("functions"),
    )
    joined = base.join(linked.groupBy("path").agg(F.count("*").alias("total_edges")), "path", "left").join(flowing.groupBy("path").agg(F.count("*").alias("taint_flows")), "path", "left")
    return joined.na.fill(0, ["total_edges", "taint_flows"]).withColumn("high_risk", (F.col("sources") > 0) & (F.col("sinks") > 0))


_COUNTS = ("total_nodes", "sources", "sinks", "comments", "string_concatenations", "functions", "total_edges", "taint_flows")


def summaries(files: DataFrame) -> DataFrame:
    """``summary`` of all files in one pass over the nodes and one shuffle: edges and flows are counted, not drawn."""
    kinds, names = [pa.string(), *[pa.int64()] * len(_COUNTS), pa.bool_()], ["path", *_COUNTS, "high_risk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_counts_of(path, own) for path, own in _by_file(batches)), kinds, names)

    return _whole_files(files).mapInArrow(run, ", ".join(["path string", *[f"{n} long" for n in _COUNTS], "high_risk boolean"]))


def _whole_files(files: DataFrame) -> DataFrame:
    """The nodes of each file in their order, without numbers."""
    return nodes(files).select("path", *_READ).repartition("path").sortWithinPartitions("path", "line")


def _counts_of(path: str, own: list[dict]) -> tuple:
    uses = _uses(own)
    data = 0
    for n, r in enumerate(own, 1):
        if v := r["variable"]:
            data += len(uses[v]) - (r["node_type"] == "assignment" and n in uses[v])
    comments = sum(r["is_comment"] for r in own)
    sources, sinks = sum(r["is_source"] for r in own), sum(r["is_sink"] for r in own)
    kinds = [sum(r["node_type"] == k for r in own) for k in ("string_concat", "function")]
    edges_ = data + max(0, len(own) - comments - 1)
    return path, len(own), sources, sinks, comments, *kinds, edges_, sum(1 for _ in _flows_in(path, own)), sources > 0 and sinks > 0


def findings(found: DataFrame, flowing: DataFrame) -> DataFrame:
    """Flows at their sink's line, and every joined string; both without a snippet."""
    text = lambda c: F.col(c).cast("string")
    told = F.concat(
        F.lit("Taint flow: '"), "source", F.lit("' (line "), text("source_line"), F.lit(") flows into dangerous '"), "sink", F.lit("' (line "), text("sink_line"),
        F.lit("). Path: "), C.path_text(F.col("vars")),
    )
    number = lambda c: F.substring(c, 2, 10).cast("long")
    taints = flowing.select(
        F.col("path").alias("file"), F.col("sink_line").alias("line"), F.concat(F.lit("Taint: "), "source", F.lit(" -> "), "sink").alias("type"), F.lit("CRITICAL").alias("severity"),
        told.alias("description"), (number("source_id") * (1 << 24) + number("sink_id")).alias("seq"),
    )
    joined = of_type(found, "string_concat").select(
        F.col("path").alias("file"), "line", F.lit("String Concatenation in Query").alias("type"), F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Potential injection via string concatenation: "), F.left("label", F.lit(80))).alias("description"), (F.lit(1 << 60) + number("id")).alias("seq"),
    )
    both = taints.unionByName(joined)
    return both.select(
        "file", "line", "type", "severity", F.lit("").alias("snippet"), "description", F.lit("INJECTION").alias("category"), F.lit("cpg").alias("analyzer"),
        F.lit(STAGE["graph"]).alias("stage"), "seq",
    )


def graph_findings(files: DataFrame) -> DataFrame:
    """``findings`` of all files in one pass over the nodes. A row is a whole file, whose nodes follow each
    other as they are cut out of it, so nothing is shuffled or sorted."""
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 6, pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((f for path, own in _as_cut(batches) for f in _findings_in(path, own)), kinds, RANKED.names)

    return nodes(files).select("path", *_READ).mapInArrow(run, RANKED)


def _findings_in(path: str, own: list[dict]) -> Iterator[tuple]:
    for _, s, t, source, sink, at, line, names in _flows_in(path, own):
        told = f"Taint flow: '{source}' (line {at}) flows into dangerous '{sink}' (line {line}). Path: {' -> '.join(names)}"
        yield path, line, f"Taint: {source} -> {sink}", "CRITICAL", "", told, "INJECTION", "cpg", STAGE["graph"], (int(s[1:]) << 24) + int(t[1:])
    for n, r in enumerate(own, 1):
        if r["node_type"] == "string_concat":
            told = f"Potential injection via string concatenation: {r['label'][:80]}"
            yield path, r["line"], "String Concatenation in Query", "MEDIUM", "", told, "INJECTION", "cpg", STAGE["graph"], (1 << 60) + n


def in_comment(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` (``path, line``) that are comments as a whole."""
    return lines.join(found.filter("is_comment").select("path", "line"), ["path", "line"], "left_semi")


def unreachable(files: DataFrame) -> DataFrame:
    """``path, line`` of the code right below a line that leaves its block and as deep as it."""
    lines = files.filter(F.col("language").isin(*LANGUAGES)).select("path", F.posexplode(F.split("content", "\n")).alias("k", "raw"))
    own = lines.filter(C.strip(F.col("raw")) != "").select("path", (F.col("k") + 1).alias("line"), C.strip(F.col("raw")).alias("s"), F.length(F.regexp_extract("raw", r"^[ \t]*", 0)).alias("depth"))
    w = Window.partitionBy("path").orderBy("line")
    left = F.lag("s").over(w).rlike(r"^(?:return|break|continue|raise|throw)\b") & (F.lag("depth").over(w) == F.col("depth"))
    return own.withColumn("left", left).filter(F.col("left") & ~F.col("s").rlike(r"^(?:\}|\)|else\b|elif\b|case\b|default\b|except\b|catch\b|finally\b|#|//)")).select("path", "line")
