"""Requests to a language model, built as rows: what is sent, without sending it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a file that go into its request.
CODE_CHARS = 8000
#: Turns of a conversation that go into its request: the newest.
TURNS = 50
#: The instruction of conversations that bring none.
INSTRUCTION = "You review source code for security. Name each weakness, its severity and a fix."
_TASK = "\n\nReport, with line numbers:\n1. the vulnerabilities\n2. the severity of each\n3. a fix for each, with code\n4. how safe the file is as a whole"


def file_prompts(files: DataFrame, code_chars: int = CODE_CHARS) -> DataFrame:
    """``path, prompt``: a request to review each file that has content, of which the first ``code_chars`` are shown."""
    fence = F.concat(F.lit("\n```"), "language", F.lit("\n"), F.left("content", F.lit(code_chars)), F.lit("\n```"))
    head = F.concat(F.lit("Review this "), "language", F.lit(" file for security vulnerabilities.\nFile: "), "path")
    return files.filter(F.col("content") != "").select("path", F.concat(head, fence, F.lit(_TASK)).alias("prompt"))


def chat_requests(turns: DataFrame, newest: int = TURNS) -> DataFrame:
    """``conv_id, request``: a JSON request that continues each conversation of ``conv_id, turn, role, text``.

    Its contents are the ``newest`` turns in order, those of the assistant as ``model`` and all others as
    ``user``; its instruction is the conversation's first system turn, or INSTRUCTION. Turns
    are cut to the newest before they are shuffled, so no conversation is too long for a task. A
    null text is empty; conversations of system turns alone have no request.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    system = turns.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(text, "turn").alias("instruction"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = turns.filter("role IS DISTINCT FROM 'system'").withColumn("age", F.row_number().over(order)).filter(F.col("age") <= newest)
    message = F.struct(F.when(F.col("role") == "assistant", "model").otherwise("user").alias("role"), F.array(F.struct(text)).alias("parts"))
    contents = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), message.alias("m")))), lambda x: x["m"])
    built = said.groupBy("conv_id").agg(contents.alias("contents")).join(system, "conv_id", "left")
    instruction = F.struct(F.array(F.struct(F.coalesce("instruction", F.lit(INSTRUCTION)).alias("text"))).alias("parts")).alias("systemInstruction")
    return built.select("conv_id", F.to_json(F.struct("contents", instruction)).alias("request"))
