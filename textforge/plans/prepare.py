"""From raw samples to padded training batches."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators.batching import pad_batches
from textforge.operators.chat import with_training_text
from textforge.operators.sampling import find_cut, row_hash, subset_cut, take_cut
from textforge.operators.tokens import Encode, encode_texts, tokenize_native
from textforge.operators.validity import filter_valid, required_columns, valid
from textforge.options import PrepOptions, SampleCount
from textforge.registry import get_model_for_path
from textforge.session import materialise


@dataclass
class PreparedSplits:
    train: DataFrame
    validation: DataFrame
    test: DataFrame | None
    audit: DataFrame


def prepare_splits(samples: DataFrame, options: PrepOptions, key: str = "sample_id") -> PreparedSplits:
    """Filter, split and subset. The order matters: sizes are those of valid rows.

    The texts are read once to write a narrow table of key, split and validity; the audit, the splits
    that exist and all cuts come from it. Each split is then one scan of the samples that compares hashes.
    """
    rules = {"required": required_columns(options.fields)}
    narrow = materialise(samples.select(key, "split", valid(samples, **rules).alias("_valid")), "split-keys")
    kept = narrow.where("_valid") if options.filter_invalid else narrow
    # One row per split name.
    present = {r["split"] for r in kept.select("split").distinct().collect()}
    border = None
    if not present & {"validation", "val"}:
        border = find_cut(kept.where("split = 'train'"), key, options.seed, fraction=options.val_size)
        if not border.whole:
            raise ValueError(f"{key} must be unique: {border.tied} rows share the key at the border of the validation split")
    if "test" not in present and options.require_test:
        raise KeyError("the dataset has no test split")

    def named(df: DataFrame) -> DataFrame:
        name = F.col("split")
        if border is not None:
            moved = (name == "train") & border.keeps(row_hash(F.col(key), options.seed))
            return df.withColumn("split", F.when(moved, F.lit("validation")).otherwise(name))
        if "validation" not in present:
            return df.withColumn("split", F.when(name == "val", F.lit("validation")).otherwise(name))
        return df

    keys, rows = named(kept), named(filter_valid(samples, options.filter_invalid, **rules))

    def part(name: str, count: SampleCount) -> DataFrame:
        cut = subset_cut(keys.where(F.col("split") == name), count, key, options.seed)
        chosen = rows.where(F.col("split") == name)
        return chosen if cut is None else take_cut(chosen, cut, key, options.seed)

    counts = narrow.groupBy("split").agg(F.count(F.lit(1)).alias("n_before"), F.count_if("_valid").alias("n_after"))
    return PreparedSplits(
        train=part("train", options.train),
        validation=part("validation", options.validation),
        test=part("test", options.test) if "test" in present else None,
        audit=counts.withColumn("n_removed", F.col("n_before") - F.col("n_after")),
    )


def training_tokens(
    samples: DataFrame,
    options: PrepOptions,
    key: str = "sample_id",
    make_encode: Callable[[], Encode] | None = None,
) -> DataFrame:
    """Messages, rendered text, tokens and assistant-only labels for one model family.

    Native expressions up to the text; an encode function of the user's own adds one Arrow stage.
    """
    model = get_model_for_path(options.base_model)
    rendered = with_training_text(samples, model, options.fields).select(key, "text_prompt", "text_full")
    if make_encode is None:
        return tokenize_native(rendered, max_length=options.max_length)
    return encode_texts(rendered, make_encode, max_length=options.max_length)


def training_batches(
    tokens: DataFrame, key: str = "sample_id", batch_size: int = 4, seed: int = 42, drop_last: bool = False
) -> DataFrame:
    """Padded batches from token arrays."""
    arrays = tokens.select(key, "input_ids", "attention_mask", "labels")
    return pad_batches(arrays, key, batch_size, seed=seed, drop_last=drop_last)
