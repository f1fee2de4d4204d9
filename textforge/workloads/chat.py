"""Registered queries: messages, rendering, prompts per model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions.templates import message, render_messages, render_turn
from textforge.operators.chat import (
    build_messages,
    message_rows,
    messages_per_model,
    reference_column,
    with_registry,
)
from textforge.operators.validity import filter_valid
from textforge.options import FieldMap
from textforge.registry import get_model, get_model_for_path
from textforge.workloads.relations import (
    ANSWER,
    DEFAULT_SYSTEM,
    MERGED,
    PAIR_SAMPLES,
    PAIRS,
    RAW,
    SYSTEM,
    USER,
    block,
    pairs,
    raw_samples,
    sample_pairs,
    table,
)


def _rows(spark: SparkSession, folder: str, model, include_assistant: bool = False) -> DataFrame:
    samples = filter_valid(raw_samples(spark, folder))
    built = samples.select("sample_id", build_messages(samples, model, include_assistant).alias("messages"))
    return message_rows(built, ["sample_id"])


def prompt_messages_system(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, get_model_for_path("Qwen/Qwen2.5-1.5B-Instruct"))


def prompt_messages_merged(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, get_model("Gemma"))


def prompt_messages_titled(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, replace(get_model("mistral"), include_title_in_user=True))


def training_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, get_model("llama"), include_assistant=True)


def mapped_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Roles taken from other columns: the document's first line asks, its list answers."""
    samples = filter_valid(raw_samples(spark, folder))
    fields = FieldMap(input="title", output="ingredients")
    built = samples.select(
        "sample_id", build_messages(samples, get_model("qwen"), True, fields).alias("messages")
    )
    return message_rows(built, ["sample_id"])


def reference_text(spark: SparkSession, folder: str) -> DataFrame:
    samples = raw_samples(spark, folder)
    return samples.select("sample_id", reference_column(samples).alias("reference_full"))


def chat_render(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    text = render_turn(F.col("role"), F.col("text"), F.col("turn") == 0)
    return turns.select("conv_id", "turn", text.alias("block"))


def chat_render_generation(spark: SparkSession, folder: str) -> DataFrame:
    return (
        pairs(spark, folder)
        .withColumn("messages", F.array(message("user", F.col("request"))))
        .select("conv_id", "turn", render_messages(F.col("messages"), True).alias("prompt"))
    )


def chat_render_training(spark: SparkSession, folder: str) -> DataFrame:
    samples = sample_pairs(spark, folder)
    built = samples.withColumn("messages", build_messages(samples, get_model("qwen"), True))
    return built.select("sample_id", render_messages(F.col("messages")).alias("text_full"))


def cross_model_prompts(spark: SparkSession, folder: str) -> DataFrame:
    each = with_registry(sample_pairs(spark, folder))
    return each.withColumn("messages", messages_per_model(each)).select(
        "sample_id",
        F.col("model.model_key").alias("model_key"),
        F.size("messages").alias("n_messages"),
        render_messages(F.col("messages"), add_generation_prompt=True).alias("text_prompt"),
    )


_TOOL = {"type": "function", "function": {"name": "track", "description": "Store an event"}}
_TOOL_MESSAGE = (
    "struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>"
)


def chat_render_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tool calls: a request, the call, two tool answers in one block, a closing turn."""
    calls = F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")))

    def turn(role: str, content, with_calls: bool = False):
        made = calls if with_calls else F.lit(None)
        return F.struct(
            F.lit(role).alias("role"), content.alias("content"), made.alias("tool_calls")
        ).cast(_TOOL_MESSAGE)

    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    messages = F.array(
        turn("user", user),
        turn("assistant", F.lit(""), True),
        turn("tool", F.col("event_id").cast("string")),
        turn("tool", F.col("event_type")),
        turn("assistant", F.lit("done")),
    )
    return (
        table(spark, folder, "events")
        .select("event_id", messages.alias("messages"))
        .select(
            "event_id",
            render_messages(F.col("messages"), True, tools=[_TOOL], has_tool_calls=True).alias("text"),
        )
    )


QUERIES = {
    "prompt_messages_system": prompt_messages_system,
    "prompt_messages_merged": prompt_messages_merged,
    "prompt_messages_titled": prompt_messages_titled,
    "training_messages": training_messages,
    "mapped_messages": mapped_messages,
    "reference_text": reference_text,
    "chat_render": chat_render,
    "chat_render_generation": chat_render_generation,
    "chat_render_training": chat_render_training,
    "cross_model_prompts": cross_model_prompts,
    "chat_render_tools": chat_render_tools,
}


def _turn(position: int, role: str, content: str) -> str:
    return f"SELECT sample_id, {position}::INTEGER AS position, '{role}' AS role, {content} AS content FROM samples"


_TITLED = (
    f"{SYSTEM} || repeat(chr(10), 4) || CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) || chr(10) "
    f"ELSE '' END || {USER}"
)
_MAPPED_ANSWER = ANSWER.replace("coalesce(directions, 'None')", "coalesce(ingredients, 'None')")
_USER_ROLE, _SYSTEM_ROLE, _ASSISTANT_ROLE = "'user'", "'system'", "'assistant'"
_GENERATION = "'<|im_start|>assistant' || chr(10)"
_TOOL_HEAD = (
    DEFAULT_SYSTEM
    + " || chr(10) || chr(10) || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist"
    " with the user query.' || chr(10) || chr(10) || 'You are provided with function signatures within"
    " <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10) || '"
    '{"type": "function", "function": {"name": "track", "description": "Store an event"}}'
    "' || chr(10) || '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function"
    " name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10) || '"
    '{"name": <function-name>, "arguments": <args-json-object>}'
    "' || chr(10) || '</tool_call>'"
)

ORACLES = {
    "prompt_messages_system": f"WITH {RAW} {_turn(0, 'system', SYSTEM)} UNION ALL {_turn(1, 'user', USER)}",
    "prompt_messages_merged": f"WITH {RAW} {_turn(0, 'user', MERGED)}",
    "prompt_messages_titled": f"WITH {RAW} {_turn(0, 'user', _TITLED)}",
    "training_messages": f"""WITH {RAW} {_turn(0, 'system', SYSTEM)} UNION ALL {_turn(1, 'user', USER)}
      UNION ALL {_turn(2, 'assistant', ANSWER)}""",
    "mapped_messages": f"""WITH {RAW} {_turn(0, 'system', SYSTEM)}
      UNION ALL {_turn(1, 'user', "'Include ingredients: ' || title")}
      UNION ALL {_turn(2, 'assistant', _MAPPED_ANSWER)}""",
    "reference_text": f"WITH {RAW} SELECT sample_id, {ANSWER} AS reference_full FROM raw",
    "chat_render": f"""SELECT conv_id, turn, CASE WHEN turn = 0 AND role <> 'system'
      THEN {block(_SYSTEM_ROLE, DEFAULT_SYSTEM)} ELSE '' END || {block('role', 'text')} AS block FROM conversations""",
    "chat_render_generation": f"""WITH {PAIRS} SELECT conv_id, turn, {block(_SYSTEM_ROLE, DEFAULT_SYSTEM)}
      || {block(_USER_ROLE, 'request')} || {_GENERATION} AS prompt FROM pairs""",
    "chat_render_training": f"""WITH {PAIR_SAMPLES} SELECT sample_id, {block(_SYSTEM_ROLE, SYSTEM)}
      || {block(_USER_ROLE, '(' + USER + ')')} || {block(_ASSISTANT_ROLE, '(' + ANSWER + ')')} AS text_full FROM samples""",
    "cross_model_prompts": f"""WITH {PAIR_SAMPLES}, models AS (
        SELECT unnest(['llama', 'mistral', 'gemma', 'qwen', 'olmo']) AS model_key)
      SELECT sample_id, model_key,
        CASE WHEN model_key IN ('llama', 'qwen') THEN 2 ELSE 1 END::INTEGER AS n_messages,
        CASE WHEN model_key IN ('llama', 'qwen')
          THEN {block(_SYSTEM_ROLE, SYSTEM)} || {block(_USER_ROLE, '(' + USER + ')')}
          ELSE {block(_SYSTEM_ROLE, DEFAULT_SYSTEM)} || {block(_USER_ROLE, '(' + MERGED + ')')} END
          || {_GENERATION} AS text_prompt
      FROM samples CROSS JOIN models""",
    "chat_render_tools": f"""SELECT event_id, {block(_SYSTEM_ROLE, '(' + _TOOL_HEAD + ')')}
      || {block(_USER_ROLE, "('user ' || user_id)")}
      || '<|im_start|>assistant' || chr(10) || '<tool_call>' || chr(10) || '{{"name": "' || event_type
      || '", "arguments": ' || props || '}}' || chr(10) || '</tool_call><|im_end|>' || chr(10)
      || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || event_id || chr(10) || '</tool_response>'
      || chr(10) || '<tool_response>' || chr(10) || event_type || chr(10) || '</tool_response><|im_end|>' || chr(10)
      || {block(_ASSISTANT_ROLE, "'done'")} || {_GENERATION} AS text FROM events""",
}
