"""Chat messages and their rendering, row-local and free of Python workers."""

from __future__ import annotations

import json
from typing import Any, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textforge.functions.text import fill, shown

# Turn markers, default system text and tool wording of the chat template.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_INTRO = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query."
    "\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_OUTRO = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)

# The answer a model is trained on and scored against.
ANSWER_TEMPLATE = (
    "Certainly! Here's a delicious recipe for:\n[ {title} ]\n\n"
    "[ INGREDIENTS ]\n{ingredients}\n\n[ DIRECTIONS ]\n{output}"
)

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer_text(
    title: Column,
    ingredients: Column,
    output: Column,
    template: str = ANSWER_TEMPLATE,
    null_text: str = "None",
) -> Column:
    return fill(
        template,
        {
            "title": shown(title, null_text),
            "ingredients": shown(ingredients, null_text),
            "output": shown(output, null_text),
        },
    )


def turn_block(role: Column, content: Column) -> Column:
    """One plain turn as the template prints it."""
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END + "\n"))


def default_system_block() -> Column:
    return turn_block(F.lit("system"), F.lit(DEFAULT_SYSTEM))


def render_turn(role: Column, content: Column, is_first: Column) -> Column:
    """One turn of a conversation stored turn by turn; a conversation's text is its turns in order.

    The first turn brings the default system block unless it is a system turn. Nothing is
    gathered, so a conversation of any length stays spread over its rows.
    """
    opening = F.when(is_first & (role != "system"), default_system_block()).otherwise(F.lit(""))
    return F.concat(opening, turn_block(role, F.coalesce(content, F.lit(""))))


def generation_suffix() -> str:
    return f"{TURN_START}assistant\n"


def _tool_block(tools: Sequence[Mapping[str, Any]]) -> Column:
    listed = "".join("\n" + json.dumps(tool, ensure_ascii=False) for tool in tools)
    return F.lit(TOOLS_INTRO + listed + TOOLS_OUTRO)


def _calls_text(calls: Column, nested: bool = False) -> Column:
    """Assistant tool calls; ``arguments`` holds JSON text already, and null prints as JSON's null.

    A call is a struct of name and arguments, or holds that struct in a field ``function``.
    """

    def one(call: Column) -> Column:
        inner = call["function"] if nested else call
        name = F.coalesce(inner["name"], F.raise_error(F.lit("a tool call without a name")).cast("string"))
        arguments = F.coalesce(inner["arguments"], F.lit("null"))
        return F.concat(F.lit('\n<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))

    return F.array_join(F.transform(calls, one), "")


def render_messages(
    messages: Column,
    add_generation_prompt: bool = False,
    tools: Sequence[Mapping[str, Any]] | None = None,
    has_tool_calls: bool = False,
    nested_calls: bool = False,
) -> Column:
    """Render an array of messages to prompt text.

    ``has_tool_calls`` says that the message struct carries
    ``tool_calls ARRAY<STRUCT<name, arguments>>``; ``nested_calls`` that each call wraps the pair in
    a field ``function``.
    """
    role_at = lambda i: F.get(messages, i)["role"]
    opens_with_system = F.coalesce(role_at(F.lit(0)) == "system", F.lit(False))
    system_text = F.when(
        opens_with_system, F.coalesce(F.get(messages, F.lit(0))["content"], F.lit(""))
    ).otherwise(F.lit(DEFAULT_SYSTEM))
    if tools:
        system_text = F.concat(system_text, _tool_block(tools))
    head = turn_block(F.lit("system"), system_text)

    def one(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        plain = turn_block(m["role"], content)
        response = F.concat(
            F.when(F.coalesce(role_at(i - 1) == "tool", F.lit(False)) & (i > 0), F.lit("")).otherwise(
                F.lit(TURN_START + "user")
            ),
            F.lit("\n<tool_response>\n"),
            content,
            F.lit("\n</tool_response>"),
            F.when(F.coalesce(role_at(i + 1) == "tool", F.lit(False)), F.lit("")).otherwise(
                F.lit(TURN_END + "\n")
            ),
        )
        turn = F.when(m["role"].isin("user", "system", "assistant"), plain).when(
            m["role"] == "tool", response
        )
        if has_tool_calls:
            calling = F.concat(
                F.lit(TURN_START + "assistant"),
                F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(F.lit("")),
                _calls_text(m["tool_calls"], nested_calls),
                F.lit(TURN_END + "\n"),
            )
            calls = (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
            turn = F.when(calls, calling).otherwise(turn)
        opening = (i == 0) & (m["role"] == "system")
        return F.when(opening, F.lit("")).otherwise(F.coalesce(turn, F.lit("")))

    body = F.array_join(F.transform(messages, one), "")
    suffix = [F.lit(generation_suffix())] if add_generation_prompt else []
    return F.concat(head, body, *suffix)
