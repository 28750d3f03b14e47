"""Row types shared by operators, sources and sinks."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """From ``name kind, ...``; needs no session, as ``fromDDL`` does."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


FILE = _struct("path string, name string, ext string, language string, content string")

#: What a report shows of a finding.
FINDING = _struct("file string, line int, type string, severity string, snippet string, description string, category string, analyzer string")

#: A finding with its place in the scan: ``stage`` orders the detectors and ``seq`` the findings
#: of one detector in one file, so "first" has a meaning without an order of rows.
RANKED = T.StructType([*FINDING.fields, T.StructField("stage", T.IntegerType()), T.StructField("seq", T.LongType())])

TOKEN = _struct("path string, pos int, type string, value string, line int, col int")
NODE = _struct("path string, id string, node_type string, label string, line int, language string, variable string, value string, is_source boolean, is_sink boolean, is_comment boolean")
EDGE = _struct("path string, source_id string, target_id string, edge_type string, label string")

FINDING_COLUMNS = FINDING.names
RANKED_COLUMNS = RANKED.names

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

#: Detectors in the order in which their findings count.
STAGES = ("file", "secret", "config", "language", "context", "dependency", "tree", "graph", "bandit", "semgrep", "trivy", "sonar")
STAGE = {name: k for k, name in enumerate(STAGES)}
