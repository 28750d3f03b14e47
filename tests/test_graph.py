"""The property graph against plain versions of its definitions, and its time on one large file."""

import random
import time
from collections import deque

import pytest

from scanframe.operators import graph
from scanframe.sources import files

NAMES = ("a", "ab", "b", "name", "me", "x1", "e", "Ünder", "long_name")


def _program(rng: random.Random, lines: int) -> str:
    kinds = (
        lambda: f"{rng.choice(NAMES)} = {rng.choice(NAMES)}", lambda: f"{rng.choice(NAMES)} = request.args", lambda: f"eval({rng.choice(NAMES)})", lambda: f"open({rng.choice(NAMES)})",
        lambda: f"# {rng.choice(NAMES)}", lambda: f"def {rng.choice(NAMES)}():", lambda: "f'text'", lambda: "", lambda: f"{rng.choice(NAMES)} = {rng.choice(NAMES)} + {rng.choice(NAMES)}",
    )
    return "\n".join(rng.choice(kinds)() for _ in range(lines))


def _edges(own, words):
    """Every definition against every node."""
    for n, d in enumerate(own, 1):
        for m, u in enumerate(own, 1):
            if d["variable"] and not u["is_comment"] and not (m == n and d["node_type"] == "assignment"):
                texts = [u["label"], (u["value"] or "") if u["node_type"] == "assignment" else ""]
                if any(d["variable"] in (graph._WORDS.findall(t) if words else t) for t in texts):
                    yield n, m


def _shortest(own, edges, s):
    """Breadth first over drawn edges, by place."""
    following = {}
    for a, b in sorted(edges):
        following.setdefault(a, []).append(b)
    came, queue = {s: None}, deque([s])
    while queue:
        n = queue.popleft()
        for m in following.get(n, ()):
            if m not in came:
                came[m] = n
                queue.append(m)
    return came


@pytest.mark.parametrize("words", [False, True])
def test_edges_and_flows_of_random_programs(spark, words):
    rng = random.Random(5)
    programs = [(f"p{k}.py", _program(rng, rng.choice((0, 1, 5, 25)))) for k in range(60)]
    df = files.files_from_table(spark.createDataFrame(programs, "path string, content string"))
    found = graph.nodes(df)
    own: dict[str, list[dict]] = {}
    for r in sorted(found.collect(), key=lambda r: (r.path, int(r.id[1:]))):
        own.setdefault(r.path, []).append(r.asDict())
        assert int(r.id[1:]) == len(own[r.path])
    drawn = {p: set(_edges(o, words)) for p, o in own.items()}
    edges = graph.data_edges(found, words).collect()
    assert sorted((r.path, int(r.source_id[1:]), int(r.target_id[1:])) for r in edges) == sorted((p, *e) for p, d in drawn.items() for e in d)
    assert all(r.label == f"{own[r.path][int(r.source_id[1:]) - 1]['variable']} flows to" for r in edges)
    expected = []
    for p, o in own.items():
        shown = lambda n, o=o: o[n - 1]["variable"] if o[n - 1]["node_type"] == "assignment" else o[n - 1]["label"]
        for s in (n for n, r in enumerate(o, 1) if r["is_source"]):
            came = _shortest(o, drawn[p], s)
            for t in (n for n, r in enumerate(o, 1) if r["is_sink"] and n in came):
                walk = [t]
                while came[walk[-1]] is not None:
                    walk.append(came[walk[-1]])
                expected.append((p, f"n{s}", f"n{t}", [shown(n) for n in reversed(walk)]))
    got = graph.flows(found, words).collect()
    assert sorted((r.path, r.source_id, r.sink_id, r.vars) for r in got) == sorted(expected) and (expected or words)
    if not words:
        told = {(r.file, r.line, r.type, r.description) for r in graph.graph_findings(df).collect()}
        assert told == {(r.file, r.line, r.type, r.description) for r in graph.findings(found, graph.flows(found)).collect()}


def test_one_file_of_100000_nodes(spark):
    lines = [f"v{k} = v{k - 1}" if k % 50 else f"v{k} = request.args" for k in range(100_000)] + ["eval(v)", "v = request.args"]
    df = files.files_from_table(spark.createDataFrame([("big.py", "\n".join(lines))], "path string, content string"))
    began = time.monotonic()
    found = graph.nodes(df)
    assert found.count() == 100_002
    edges = graph.data_edges(found, words=True).count()
    assert edges >= 97_999
    assert graph.graph_findings(df).filter("severity = 'CRITICAL'").count() == 1  # v is a part of eval
    assert time.monotonic() - began < 60


def test_time_in_a_file_grows_with_its_text_and_edges():
    def own(n):
        rows = [{"variable": f"v{k}_", "label": f"v{k}_ = v{k // 2}_", "value": f"v{k // 2}_", "node_type": "assignment", "is_comment": False, "is_source": False, "is_sink": False, "line": k} for k in range(n)]
        rows[0] |= {"is_source": True, "node_type": "source"}
        return [*rows, rows[0] | {"variable": None, "is_source": False, "is_sink": True, "label": f"eval v{n - 1}_", "node_type": "sink"}]

    took = []
    for n in (5_000, 40_000):
        rows, began = own(n), time.monotonic()
        (flow,) = graph._flows_in("p", rows)
        took.append(time.monotonic() - began)
        assert len(flow[-1]) == (n - 1).bit_length() + 2  # from v0_ by halves to the last, and the sink
    assert took[1] < 60 * max(took[0], 0.01)


def _reach(pairs):
    found = set(pairs)
    while more := {(a, d) for a, b in found for c, d in pairs if b == c} - found:
        found |= more
    return found


def test_closure_of_random_graphs():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.choice((1, 2, 4, 9))
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n + 1))}
        got = list(graph._closure(pairs))
        assert len(got) == len(set(got)) and set(got) == _reach(pairs)


def test_closure_of_a_long_walk():
    n = 3000
    assert sum(1 for _ in graph._closure({(k, k + 1) for k in range(n)})) == n * (n + 1) // 2
    assert sum(1 for _ in graph._closure({(k, (k + 1) % n) for k in range(n)})) == n * n


def test_keys_too_large_for_one_task_go_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(p, f"a{rng.randrange(9)}", f"a{rng.randrange(9)}") for p, m in (("s", 5), ("l", 40)) for _ in range(m)] + [("s", None, "a1"), ("s", "a1", None), (None, "x", "y"), (None, "y", "z")]
    pairs = spark.createDataFrame(rows, "path string, source_id string, target_id string")
    expected = {(p, *e) for p in ("s", "l") for e in _reach({r[1:] for r in rows if r[0] == p and None not in r})}
    assert {tuple(r) for r in graph.reachable(pairs).collect()} == expected
    monkeypatch.setattr(graph, "CLOSED_EDGES", 10)
    got = [tuple(r) for r in graph.reachable(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert graph.reachable(pairs.limit(0)).count() == 0
