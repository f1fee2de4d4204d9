"""Tokens, assistant-only labels and token statistics.

Two tokenisers share one output schema (``input_ids``, ``attention_mask``, ``labels``): a native
one made of array expressions, and any encode function of the user's own, run over batches.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions.text import preview
from textforge.operators.batched import MapBatch, map_batches
from textforge.operators.ordering import number_rows

#: Texts to (token ids, character offsets) each, and token ids back to texts.
Encode = Callable[[list[str]], Sequence[tuple[Sequence[int], Sequence[tuple[int, int]]]]]
Decode = Callable[[list[list[int]]], Sequence[str]]

IGNORED = -100

# Special tokens and their ids. The end-of-turn token also pads.
SPECIAL_TOKENS: Mapping[str, int] = {
    "<|endoftext|>": 151643,
    "<|im_start|>": 151644,
    "<|im_end|>": 151645,
    "<|object_ref_start|>": 151646,
    "<|object_ref_end|>": 151647,
    "<|box_start|>": 151648,
    "<|box_end|>": 151649,
    "<|quad_start|>": 151650,
    "<|quad_end|>": 151651,
    "<|vision_start|>": 151652,
    "<|vision_end|>": 151653,
    "<|vision_pad|>": 151654,
    "<|image_pad|>": 151655,
    "<|video_pad|>": 151656,
    "<tool_call>": 151657,
    "</tool_call>": 151658,
    "<|fim_prefix|>": 151659,
    "<|fim_middle|>": 151660,
    "<|fim_suffix|>": 151661,
    "<|fim_pad|>": 151662,
    "<|repo_name|>": 151663,
    "<|file_sep|>": 151664,
}
PAD_TOKEN = "<|im_end|>"
PAD_ID = SPECIAL_TOKENS[PAD_TOKEN]

# Special tokens, line breaks, words with the blanks before them, left-over blanks, a lone bracket.
# Together they cover every character, so tokens joined give the text back.
TOKEN_PATTERN = (
    "|".join(token.replace("|", r"\|") for token in SPECIAL_TOKENS)
    + r"|\n|[ \t\r\f\x0b]*[^ \t\n\r\f\x0b<]+|[ \t\r\f\x0b]+|<"
)
# The same tokens, found faster: words come first, since no special token begins like one, and blanks are not gone back over.
_QUICK_PATTERN = (
    r"[ \t\r\f\x0b]*+[^ \t\n\r\f\x0b<]++|\n|[ \t\r\f\x0b]++|"
    + "|".join(token.replace("|", r"\|") for token in SPECIAL_TOKENS)
    + "|<"
)
HASH_ID_DIGITS = 15  # 60 bits of the hash
FIRST_HASHED_ID = max(SPECIAL_TOKENS.values()) + 1  # keeps hashed ids clear of the table


def split_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(_QUICK_PATTERN if pattern == TOKEN_PATTERN else pattern), F.lit(0))


def token_id(token: Column) -> Column:
    """Id of one token (BIGINT): the fixed table for special tokens, else a stable 60-bit hash of its text."""
    hashed = F.conv(F.substring(F.md5(token), 1, HASH_ID_DIGITS), 16, 10).cast("bigint") + FIRST_HASHED_ID
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_TOKENS.items() for x in pair])
    return F.coalesce(F.when(token.startswith("<"), F.element_at(special, token)), hashed)


def masked_labels(ids: Column, start: Column) -> Column:
    """Token ids with everything before ``start`` replaced by the ignored label."""
    n = F.size(ids)
    kept = F.least(F.greatest(start, F.lit(0)), n)
    return F.concat(F.array_repeat(F.lit(IGNORED), kept), F.slice(ids, kept + 1, n - kept))


def start_from_offsets(offsets: Column, prompt_len: Column) -> Column:
    """Index of the first token that starts at or after ``prompt_len``; the token count if none."""
    begins = F.transform(offsets, lambda o: o["start"] >= prompt_len)
    position = F.array_position(begins, F.lit(True))
    return F.when(position > 0, position - 1).otherwise(F.size(offsets)).cast("int")


def attention(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def tokenize_native(
    df: DataFrame,
    text: str = "text_full",
    prompt: str = "text_prompt",
    max_length: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Tokenise by array expressions, all inside the JVM and linear in the text length.

    The prompt is a prefix of the text that ends between tokens or inside a plain one, so the
    number of tokens beginning before the boundary is the prompt's own token count.
    """
    keep = [c for c in df.columns if c not in (text, prompt)] if keep is None else list(keep)
    tokens = split_tokens(F.col(text))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max_length)
    return (
        df.select(
            *keep,
            tokens.alias("tokens"),
            F.size(split_tokens(F.col(prompt))).alias("_start"),
        )
        .withColumn("input_ids", F.transform("tokens", token_id))
        .withColumn("attention_mask", attention(F.col("tokens")))
        .withColumn("labels", masked_labels(F.col("input_ids"), F.col("_start")))
        .drop("_start")
    )


def count_tokens(
    df: DataFrame,
    text: str = "text_full",
    prompt: str = "text_prompt",
    max_length: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``n_tokens`` and ``n_masked`` of the native tokens, without building ids or labels."""
    keep = [c for c in df.columns if c not in (text, prompt)] if keep is None else list(keep)
    total = F.regexp_count(F.col(text), F.lit(TOKEN_PATTERN))
    if max_length is not None:
        total = F.least(total, F.lit(max_length))
    counted = df.select(
        *keep, total.alias("n_tokens"), F.regexp_count(F.col(prompt), F.lit(TOKEN_PATTERN)).alias("_start")
    )
    return counted.withColumn("n_masked", F.least("n_tokens", "_start")).drop("_start")


def _counts(df: DataFrame) -> tuple[Column, Column]:
    """Token and masked counts of a table that has them, or of one that has the arrays."""
    if {"n_tokens", "n_masked"} <= set(df.columns):
        return F.col("n_tokens"), F.col("n_masked")
    return F.size("input_ids"), masked_count(F.col("labels"))


def encode_texts(
    df: DataFrame,
    make_encode: Callable[[], Encode],
    text: str = "text_full",
    prompt: str = "text_prompt",
    max_length: int | None = 512,
    keep: Sequence[str] | None = None,
    batch_size: int = 1000,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` by an encode function of the user's own.

    The function gives ids and character offsets ``(start, end)`` per text; everything else is an expression:
    both are cut to ``max_length``, labels count from the first token that starts at or after the end of the prompt, and a
    token that straddles it stays masked. A null text is encoded as an empty one. ``keep`` names the columns
    that stay, all but the texts by default.
    """
    keep = [c for c in df.columns if c not in (text, prompt)] if keep is None else list(keep)

    def make() -> MapBatch:
        encode = make_encode()

        def run(columns: dict[str, list]) -> dict[str, list]:
            encoded = list(encode(columns["_text"]))
            ids, offsets = ([row[k] for row in encoded] for k in (0, 1))
            if wrong := [i for i, (x, y) in enumerate(zip(ids, offsets)) if len(x) != len(y)]:
                raise ValueError(f"{len(wrong)} texts with other numbers of ids and offsets, e.g. {columns['_text'][wrong[0]][:80]!r}")
            return {"_ids": ids, "_offsets": [[{"start": int(a), "end": int(b)} for a, b in row] for row in offsets]}

        return run

    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.length(prompt), F.lit(0)).alias("_plen"))
    made = map_batches(source, make, ["_text"], "_ids array<int>, _offsets array<struct<start: int, end: int>>", [*keep, "_plen"], batch_size)

    def cut(values: Column) -> Column:
        return values if max_length is None else F.slice(values, 1, max_length)

    start = start_from_offsets(cut(F.col("_offsets")), F.col("_plen"))
    cut_ids = made.select(*keep, cut(F.col("_ids")).alias("input_ids"), start.alias("_start"))
    return cut_ids.select(
        *keep, "input_ids", attention(F.col("input_ids")).alias("attention_mask"), masked_labels(F.col("input_ids"), F.col("_start")).alias("labels")
    )


def decode_ids(
    df: DataFrame, make_decode: Callable[[], Decode], ids: str, name: str = "decoded", length: int | None = None, batch_size: int = 1000
) -> DataFrame:
    """Token ids back to text by a function of the user's own; optionally shortened for display."""

    def make() -> MapBatch:
        decode = make_decode()
        return lambda columns: {name: list(decode([[] if row is None else row for row in columns[ids]]))}

    decoded = map_batches(df, make, [ids], f"`{name}` string", [c for c in df.columns if c != name], batch_size)
    return decoded.withColumn(name, preview(F.col(name), length)) if length else decoded


def is_masked(label: Column) -> Column:
    return label == IGNORED


def masked_count(labels: Column) -> Column:
    return F.size(F.filter(labels, is_masked))


def token_breakdown(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """One row per token: position, text, id, attention, label and what happens to it."""
    rows = df.select(
        *keys, F.posexplode(F.arrays_zip("tokens", "input_ids", "attention_mask", "labels"))
    )
    if max_rows is not None:
        rows = rows.where(F.col("pos") < max_rows)
    masked = is_masked(F.col("col.labels"))
    return rows.select(
        *keys,
        F.col("pos").alias("index"),
        F.col("col.tokens").alias("token"),
        F.col("col.input_ids").alias("input_id"),
        F.col("col.attention_mask").alias("attention_mask"),
        F.col("col.labels").alias("label"),
        masked.alias("masked"),
        F.when(masked, F.lit("[MASKED]")).otherwise(F.lit("[TRAINING]")).alias("training"),
    )


def label_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, masked and trained tokens per sample, with percentages (null for no tokens)."""
    total, masked = _counts(df)
    counted = df.select(*keys, total.alias("n_tokens"), masked.alias("n_masked"))
    return counted.select(
        *keys,
        "n_tokens",
        "n_masked",
        (F.col("n_tokens") - F.col("n_masked")).alias("n_training"),
        F.when(F.col("n_tokens") > 0, F.col("n_masked") / F.col("n_tokens") * 100).alias("pct_masked"),
        F.when(
            F.col("n_tokens") > 0, (F.col("n_tokens") - F.col("n_masked")) / F.col("n_tokens") * 100
        ).alias("pct_training"),
    )


def label_texts(df: DataFrame, keys: Sequence[str], length: int | None = 500) -> DataFrame:
    """The masked and the trained part of each sample as text, optionally shortened for display."""
    marked = F.transform("labels", is_masked)
    zipped = F.arrays_zip(F.col("tokens").alias("tokens"), marked.alias("m"))

    def part(wanted: bool) -> Column:
        kept = F.filter(F.col("_z"), lambda z: z["m"] == wanted)
        text = F.array_join(F.transform(kept, lambda z: z["tokens"]), "")
        return preview(text, length) if length else text

    return df.withColumn("_z", zipped).select(
        *keys, part(True).alias("masked_text"), part(False).alias("training_text")
    )


def token_statistics(df: DataFrame, group: str = "model") -> DataFrame:
    """Corpus statistics per group; the masked ratio is a ratio of means.

    Counts per row first, so only fixed-width numbers are aggregated and shuffled.
    """
    total, masked = _counts(df)
    counted = df.select(group, total.alias("n"), masked.alias("m"))
    return counted.groupBy(group).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("n").alias("avg_length"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
        F.avg("m").alias("avg_masked_tokens"),
        F.avg(F.col("n") - F.col("m")).alias("avg_training_tokens"),
        F.when(F.sum("n") > 0, F.sum("m") / F.sum("n")).alias("avg_masked_ratio"),
        F.sum((F.col("n") == F.col("m")).cast("bigint")).alias("fully_masked"),
    )


def vocabulary_sizes(df: DataFrame, group: str, text: str, approximate: bool = False) -> DataFrame:
    """Distinct tokens per group.

    Exact mode de-duplicates (group, token) pairs, first within each task, so a group holding a
    large share of the rows is spread over its tokens.
    """
    tokens = df.select(group, F.explode(split_tokens(F.col(text))).alias("token"))
    if approximate:
        return tokens.groupBy(group).agg(F.approx_count_distinct("token", 0.02).alias("vocab_size"))
    return tokens.groupBy(group, "token").agg(F.lit(1).alias("one")).groupBy(group).agg(
        F.count(F.lit(1)).alias("vocab_size")
    )


def vocabulary_report(sizes: DataFrame, group: str) -> DataFrame:
    """Sizes with their share of the largest and their place, ties by group; one row per group. No task sees all groups."""
    numbered = number_rows(sizes.select(group, "vocab_size"), F.desc("vocab_size"), group)
    largest = numbered.agg(F.max("vocab_size")).first()[0] or 0
    share = F.col("vocab_size") / F.lit(largest) * 100 if largest > 0 else F.lit(None).cast("double")
    return numbered.select(group, "vocab_size", share.alias("pct_of_max"), (F.col("position") + 1).cast("int").alias("position"))


def declared_vocabularies(loaders: Mapping[str, object], spark, paths: Mapping[str, str]) -> DataFrame:
    """Vocabulary size per tokeniser; a loader that fails counts as size 0."""
    import warnings

    rows = []
    for name, load in loaders.items():
        try:
            size = load().get_vocab_size(with_added_tokens=True)
        except Exception as problem:  # a missing tokeniser must not hide the others
            warnings.warn(f"{name}: {problem}")
            size = 0
        rows.append((name, size, paths.get(name, "")))
    return spark.createDataFrame(rows, "model string, vocab_size bigint, model_path string").orderBy(
        F.desc("vocab_size"), "model"
    )
