"""Prompt and training messages per model, as row-local columns."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.templates import TURN_END, answer_text, message, render_messages
from textforge.functions.text import fill, preview, shown
from textforge.options import FieldMap
from textforge.registry import DEFAULT_REGISTRY, ModelConfig, registry_array


def _merged_user(system: Column, title: Column | None, user: Column) -> Column:
    lines = [system, F.lit("")] + ([title] if title is not None else []) + [user]
    return F.concat_ws("\n\n", *lines)  # skips a null title line


def _role(df: DataFrame, name: str, absent: str) -> Column:
    """A role column, or the text that stands in when the table has no such column."""
    return F.col(name) if name in df.columns else F.lit(absent)


def build_messages(
    df: DataFrame,
    model: ModelConfig,
    include_assistant: bool = False,
    fields: FieldMap = FieldMap(),
    null_text: str = "None",
    answer_template: str | None = None,
) -> Column:
    """Messages for one model family: system + user, or both merged into the user turn."""
    user = fill(model.user_message_template, {"ner": shown(_role(df, fields.input, ""), null_text)})
    system = F.lit(model.system_message)
    if model.supports_system:
        turns = [message("system", system), message("user", user)]
    else:
        title = None
        if model.include_title_in_user and fields.title in df.columns:
            has_title = F.coalesce(F.col(fields.title), F.lit("")) != ""
            title = F.when(has_title, F.concat(F.lit(model.title_prefix + " "), F.col(fields.title)))
        turns = [message("user", _merged_user(system, title, user))]
    if include_assistant:
        turns.append(message("assistant", reference_column(df, fields, null_text, answer_template)))
    return F.array(*turns)


def reference_column(
    df: DataFrame,
    fields: FieldMap = FieldMap(),
    null_text: str = "None",
    template: str | None = None,
) -> Column:
    """The full answer text predictions are scored against."""
    extra = {"template": template} if template else {}
    return answer_text(
        _role(df, fields.title, "Recipe"),
        _role(df, fields.ingredients, ""),
        _role(df, fields.output, ""),
        null_text=null_text,
        **extra,
    )


def with_registry(df: DataFrame, registry: Sequence[ModelConfig] = DEFAULT_REGISTRY) -> DataFrame:
    """Every row once per registered model. The registry is a literal, so nothing is joined."""
    return df.withColumn("model", F.explode(registry_array(registry)))


def messages_per_model(
    df: DataFrame,
    include_assistant: bool = False,
    fields: FieldMap = FieldMap(),
    null_text: str = "None",
) -> Column:
    """Messages for rows that carry their model in a ``model`` struct (see ``with_registry``)."""
    model = F.col("model")
    ner = shown(_role(df, fields.input, ""), null_text)
    user = F.replace(model["user_message_template"], F.lit("{ner}"), ner)
    title = None
    if fields.title in df.columns:
        wanted = model["include_title_in_user"] & (F.coalesce(F.col(fields.title), F.lit("")) != "")
        title = F.when(wanted, F.concat_ws(" ", model["title_prefix"], F.col(fields.title)))
    answer = (
        [message("assistant", reference_column(df, fields, null_text))] if include_assistant else []
    )
    split_roles = F.array(message("system", model["system_message"]), message("user", user), *answer)
    merged = F.array(message("user", _merged_user(model["system_message"], title, user)), *answer)
    return F.when(model["supports_system"], split_roles).otherwise(merged)


def with_training_text(
    df: DataFrame,
    model: ModelConfig | None = None,
    fields: FieldMap = FieldMap(),
    null_text: str = "None",
) -> DataFrame:
    """Add ``text_prompt`` (ends where the answer begins) and ``text_full``.

    Without ``model`` the rows must carry a ``model`` struct. The two texts share their prefix,
    so the prompt is rendered once and the answer appended.
    """
    prompt = (
        build_messages(df, model, False, fields, null_text)
        if model is not None
        else messages_per_model(df, False, fields, null_text)
    )
    answer = reference_column(df, fields, null_text)
    return (
        df.withColumn("_messages", prompt)
        .withColumn("text_prompt", render_messages(F.col("_messages"), add_generation_prompt=True))
        .withColumn("text_full", F.concat("text_prompt", answer, F.lit(TURN_END + "\n")))
        .drop("_messages")
    )


def message_rows(df: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """One row per message, with its position."""
    return df.select(*keys, F.posexplode(messages).alias("position", "m")).select(
        *keys, "position", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def preview_rows(df: DataFrame, length: int = 100) -> DataFrame:
    """Shorten every string column for display."""
    return df.select(
        *[
            preview(F.col(f.name), length).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
