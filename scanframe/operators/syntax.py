"""Syntax trees of Python files as rows, and searches over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import source
from scanframe.operators.rules import in_parts
from scanframe.schema import STAGE

#: Rows that a task hands on at a time.
ROWS = 8192

_TREE = "path string, node_id int, parent_id int, type string, line int, text string"
_CALLS = "path string, line int, func string, args array<string>, fed boolean"


def _rows(files: DataFrame, read, kinds: list[pa.DataType], ddl: str) -> DataFrame:
    names = [part.split()[0] for part in ddl.replace(", ", ",").split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in in_parts(batches):
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from ((path, *r) for r in read(content or ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    return files.filter("language = 'python'").select("path", "content").mapInArrow(run, ddl)


def tree(files: DataFrame) -> DataFrame:
    """``path, node_id, parent_id, type, line, text``: a tree as rows; the root's parent is -1."""
    return _rows(files, source.python_tree, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()], _TREE)


def calls(files: DataFrame) -> DataFrame:
    """``path, line, func, args, fed``: named calls; ``fed``: with untrusted input."""
    return _rows(files, source.python_calls, [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_()], _CALLS)


def functions(found: DataFrame) -> DataFrame:
    return found.filter(F.col("type").isin(*tables.TREE_FUNCTION_TYPES))


def classes(found: DataFrame) -> DataFrame:
    return found.filter(F.col("type").isin(*tables.TREE_CLASS_TYPES))


def joined_strings(found: DataFrame) -> DataFrame:
    return found.filter(F.col("type").isin(*tables.TREE_CONCAT_TYPES) & F.col("text").rlike("[+%]|f[\"']"))


def _names_danger(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, tables.TREE_DANGEROUS_NAMES)), lambda n: F.contains(text, n))


def dangerous(found: DataFrame) -> DataFrame:
    """Calls whose function's text holds a dangerous name: a call joined with its first child, if that does."""
    first = found.groupBy("path", "parent_id").agg(F.min_by(F.struct(_names_danger(F.col("text")).alias("is")), "node_id")["is"].alias("is")).filter("is")
    return found.filter("type = 'call'").join(first.select("path", F.col("parent_id").alias("node_id")), ["path", "node_id"], "left_semi")


def analysis(found: DataFrame) -> DataFrame:
    """A row a file: functions, classes, joined strings and dangerous calls."""
    is_ = lambda names: F.count_if(F.col("type").isin(*names))
    joins = F.count_if(F.col("type").isin(*tables.TREE_CONCAT_TYPES) & F.col("text").rlike("[+%]|f[\"']"))
    base = found.groupBy("path").agg(is_(tables.TREE_FUNCTION_TYPES).alias("functions"), is_(tables.TREE_CLASS_TYPES).alias("classes"), joins.alias("string_concats"))
    return base.join(dangerous(found).groupBy("path").agg(F.count("*").alias("dangerous_calls")), "path", "left").na.fill(0, ["dangerous_calls"])


def tree_findings(files: DataFrame) -> DataFrame:
    found = dangerous(tree(files))
    return found.select(
        F.col("path").alias("file"), "line", F.concat(F.lit("Tree-sitter: "), F.left("text", F.lit(60))).alias("type"), F.lit("MEDIUM").alias("severity"),
        F.left("text", F.lit(120)).alias("snippet"), F.concat(F.lit("Dangerous function call detected: "), F.left("text", F.lit(100))).alias("description"),
        F.lit("INJECTION").alias("category"), F.lit("tree_sitter").alias("analyzer"), F.lit(STAGE["tree"]).alias("stage"), F.col("node_id").cast("long").alias("seq"),
    )
