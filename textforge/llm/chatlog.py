"""Chat formatting from event logs, with built-in functions only (operator 3).

An event is ``(conv_id, seq, turn, kind, role, text)``. Kinds:

* ``delta`` appends its text to the message ``turn``;
* ``edit`` replaces that message and drops all later ones, as a user who rewrites a message does;
* ``regenerate`` does the same for a reply that is asked for again; deltas that follow fill it.

Logs are partitioned by conversation and put in order by ``seq`` (ties: turn, kind, text). A window
gives each event the last reset at or before its turn; what came earlier is dropped, and the rest of
each message is folded into its text. Messages are rendered one by one, their places are running
sums, and a conversation is put together last. A conversation is one row of the result, so the rows
of one conversation meet in one task; there is no larger unit.

The template is ``<s>role\\ntext</s>`` per turn. In texts and roles a backslash is written before
every backslash, and inside every control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) after
its first character; roles also escape line breaks. Dropping each backslash that escapes a character
gives the text back, so any text survives and none can end its turn.

Null texts and roles are empty; a null conversation id is an id; unknown kinds are an error. Repeated
events are applied twice (a delta appends twice). An empty log gives an empty table. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, CLOSE, ASSISTANT = "<s>", "</s>", "assistant"
_ESCAPES = r"(?=\\)|(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])"
_ROLE_ESCAPES = _ESCAPES + r"|(?=\n)"
_TURN = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)$"

RESETS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPES, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_from_rows(rows: DataFrame) -> DataFrame:
    """The log of a stored conversation table: each row streamed as two deltas of its text.

    Rows are in the order of ``turn``; equal turns are messages of their own, ordered by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    deltas = F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("part"), F.substring(text, half + 1, F.length(text)).alias("text")),
    ))
    numbered = rows.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    placed = numbered.select("conv_id", "turn", "role", deltas.alias("d"))
    return placed.select(
        "conv_id", (F.col("turn") * 2 + F.col("d.part")).alias("seq"), "turn", F.lit("delta").alias("kind"), "role", F.col("d.text").alias("text")
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of every log."""
    known = F.when(F.col("kind").isin("delta", *RESETS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null")))).cast("string")
    )
    named = events.select("conv_id", "seq", "turn", known.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conversation = W.partitionBy("conv_id")
    numbered = named.withColumn("_n", F.row_number().over(conversation.orderBy("seq", "turn", "kind", "text")))
    upto = conversation.orderBy("turn").rangeBetween(W.unboundedPreceding, W.currentRow)
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.col("_n"))).over(upto)
    live = numbered.withColumn("_reset", reset).where(F.col("_n") >= F.coalesce("_reset", F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("_n", "text")))
    return live.groupBy("conv_id", "turn").agg(
        F.min_by("role", "_n").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )


def format_messages(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``; the mask is spans ``(start, length)`` of code points."""
    role = F.regexp_replace(F.col("role"), _ROLE_ESCAPES, r"\\")
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    pieces = messages.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turn = F.struct(
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("text"),
        (F.col("role") == ASSISTANT).alias("trained"),
        (F.col("_at") + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_mask"),
    )


def format_log(events: DataFrame) -> DataFrame:
    return format_messages(fold_events(events))


def read_turns(formatted: Column) -> Column:
    """Turns ``(role, text)`` read back from a formatted conversation."""
    segments = F.split(formatted, CLOSE)
    inner = F.transform(F.slice(segments, 1, F.size(segments) - 1), lambda s: F.substring(s, F.lit(len(OPEN) + 1), F.length(s)))
    return F.transform(
        inner,
        lambda s: F.struct(unescape(F.regexp_extract(s, _TURN, 1)).alias("role"), unescape(F.regexp_extract(s, _TURN, 2)).alias("text")),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What :func:`format_messages` wrote, read back: turns and trained text as digests and counts."""
    turns = read_turns(F.col("formatted"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    read = formatted.withColumn("turns", turns).withColumn("loss", F.array_join(masked, ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
