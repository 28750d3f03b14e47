"""What both jobs need: their config, the rules they run, and the redaction of what was found."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe import tables
from scanframe.functions import columns as C
from scanframe.secrets_family import SECRET_RULES

#: Rule sets by the names that configs use.
CATALOGUES = {"secret": SECRET_RULES, "config": tables.CONFIG_RULES}


def catalogue(names) -> tuple:
    """The rules of the named sets, in order."""
    if unknown := set(names) - set(CATALOGUES):
        raise ValueError(f"no such rule sets: {sorted(unknown)}")
    return tuple(rule for name in names for rule in CATALOGUES[name])


def document_files(docs: DataFrame) -> DataFrame:
    """``source, path, content`` of documents; a null source is ``none``, a null text empty."""
    source = F.coalesce("source", F.lit("none"))
    path = F.concat(source, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    return docs.select(source.alias("source"), path.alias("path"), C.unix_lines(F.coalesce("text", F.lit(""))).alias("content"))


def page_files(pages: DataFrame) -> DataFrame:
    """``source, path, content`` of web pages; the source is the host of the url, ``none`` without one."""
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit("none"))
    path = F.concat(F.lit("pages/"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(".html"))
    return pages.select(host.alias("source"), path.alias("path"), C.unix_lines(F.coalesce("html", F.lit(""))).alias("content"))


def fingerprint(match: Column) -> Column:
    """What stands for a match in reports, which must not spread the secret itself."""
    return F.concat(F.lit("sha256:"), F.sha2(match, 256))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object; the path may be any that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def command_line(name: str, run: Callable, inputs: tuple[str, ...], argv: list[str] | None = None) -> None:
    """Parse paths, start a session, run the job and stop the session."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for x in (*inputs, "output"):
        parser.add_argument(f"--{x}", required=True)
    parser.add_argument("--config", required=True, help="JSON: keyword arguments of the job")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[getattr(args, x) for x in (*inputs, "output")], **read_config(spark, args.config))
    finally:
        spark.stop()
