import json

from scanframe.operators import prompts
from scanframe.schema import FILE


def test_chat_requests(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(9)] + [(1, 90, "system", "late"), (1, -1, "system", "be brief"), (2, 0, None, None), (3, 0, "system", "alone")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, age string")
    got = {r.conv_id: json.loads(r.request) for r in prompts.chat_requests(turns, 3).collect()}
    assert got[1]["contents"] == [{"role": r, "parts": [{"text": t}]} for r, t in (("user", "t6"), ("model", "t7"), ("user", "t8"))]
    assert got[1]["systemInstruction"] == {"parts": [{"text": "be brief"}]}
    assert got[2] == {"contents": [{"role": "user", "parts": [{"text": ""}]}], "systemInstruction": {"parts": [{"text": prompts.INSTRUCTION}]}}
    assert set(got) == {1, 2} and prompts.chat_requests(turns.limit(0)).count() == 0


def test_long_conversations_are_cut_before_the_shuffle(spark):
    turns = spark.range(100_000).selectExpr("id DIV 1000000 AS conv_id", "cast(id AS int) AS turn", "'user' AS role", "cast(id AS string) AS text")
    found = prompts.chat_requests(turns)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert [c["parts"][0]["text"] for c in json.loads(found.first().request)["contents"]] == [str(k) for k in range(99_950, 100_000)]


def test_file_prompts(spark):
    df = spark.createDataFrame([("a.py", "a.py", ".py", "python", "€" * 9000), ("b.py", "b.py", ".py", "python", ""), ("c.py", "c.py", ".py", "python", None)], FILE)
    (row,) = prompts.file_prompts(df).collect()
    assert row.path == "a.py" and row.prompt.count("€") == 8000 and "```python\n" in row.prompt
