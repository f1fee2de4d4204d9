"""Quality rules with adaptive thresholds (operator 6).

Every text is measured in its own task. Instead of fixed cutoffs, each (language, source) gets
fences from the distribution of its own texts: quantiles of mergeable sketches. The sketch of a
metric is a histogram over geometric bins (every bin is ``GAMMA`` times as wide as the one before,
so a quantile is exact to that factor). Histograms of the same metric merge by adding counts,
which Spark does inside tasks before it shuffles; a source with a third of all texts therefore
costs a few hundred rows per task. Sketches of small groups are replaced by the merged sketch of
their language, and that one by the sketch of everything.

A text fails a metric if it lies beyond ``high + max(slack, reach * (high - middle))`` or the
mirror of it, where low, middle and high are the quantiles 0.1, 0.5 and 0.9 of its group. So the
rule rejects what is out of the ordinary, and no fixed share of the texts.

Null texts and texts without words have all counts 0 and fail the base rule; null languages and
sources are groups like any other. Repeated rows are measured and judged one by one. An empty
table gives an empty table. Extra columns are kept; an extra column with the name of a result
column gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textforge.llm import bytes as tb
from textforge.llm.common import aside, join_small, map_slices, materialise

GAMMA = 1.05
SCALE = 1_000_000  # a ratio below 1 / SCALE counts as zero

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must stay inside its group's fences; ``slack`` is their least width."""

    name: str
    numerator: str
    denominator: str
    slack: float
    two_sided: bool = False


#: The method's rules; slack keeps groups of nearly equal texts from having no room at all.
RULES = (
    Rule("word_length", "word_chars", "n_words", 5.0, two_sided=True),
    Rule("symbols", "n_symbols", "n_words", 0.15),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.5),
    Rule("repeats", "n_repeat_words", "n_words", 0.2),
)
REACH = 3.0
MIN_GROUP = 200


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text of a slice. Lines and word runs are compared by 64-bit hashes."""
    starts, ends, of_text = tb.words(data, offsets)
    hashes = tb.span_hashes(data, starts, ends)
    inside = ~tb.SEPARATOR[data] & ((data & 0xC0) != 0x80)
    keys, first = tb.windows(hashes, of_text)
    text = tb.owner(of_text)
    twice = first[tb.repeated(tb.pair(text[first].astype(np.uint64), keys))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + tb.WINDOW_WORDS, -1)
    covered = np.cumsum(cover)[:-1] > 0

    line_start, line_end, line_of = tb.lines(data, offsets)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_text = tb.owner(line_of)
    key = tb.pair(line_text.astype(np.uint64), tb.span_hashes(data, line_start, line_end))[worded]
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    n = len(offsets) - 1
    return {
        "n_words": np.diff(of_text),
        "word_chars": tb.count_in(inside, offsets),
        "n_symbols": tb.count_in(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_text[worded][earlier], minlength=n),
        "n_repeat_words": np.bincount(text[covered], minlength=n),
        "n_lines": np.bincount(line_text[worded], minlength=n),
    }


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the base counts of every whole text."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in COUNTS)
    wanted = dict.fromkeys((*keep, text))
    fields = [docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS]

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
        return {c: rows.column(rows.schema.get_field_index(c)) for c in keep} | text_counts(data, offsets)

    return map_slices(docs.select(*wanted), each, StructType(fields), text)


def ratio(rule: Rule) -> Column:
    return F.col(rule.numerator) / F.greatest(F.col(rule.denominator), F.lit(1))


def _bin(value: Column) -> Column:
    """Index of the geometric bin; values below 1 / SCALE share bin 0."""
    scaled = value * SCALE
    return F.when(scaled < 1, F.lit(0)).otherwise(F.ceil(F.log(scaled) / F.log(F.lit(GAMMA))) + 1).cast("int")


def _value(index: Column) -> Column:
    """The upper end of a bin."""
    return F.when(index <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), index - 1) / SCALE)


def sketches(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(lang, source, rule, bin, n)``: one histogram per group and rule, of the texts with words."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), _bin(ratio(r)).alias("bin")) for r in rules]))
    return (
        measured.where(F.col("n_words") > 0)
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.rule", "p.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """Merge histograms to ``groups`` and read low, middle and high from each: one row per group and rule."""
    merged = histogram.groupBy(*groups, "rule", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*groups, "rule")
    upto = F.sum("n").over(group.orderBy("bin"))
    counted = merged.select("*", upto.alias("upto"), F.sum("n").over(group).alias("total"))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("bin")))

    return counted.groupBy(*groups, "rule").agg(
        F.max("total").alias("total"), _value(at(0.1)).alias("low"), _value(at(0.5)).alias("middle"), _value(at(0.9)).alias("high")
    )


def fences(
    histogram: DataFrame, rules: tuple[Rule, ...] = RULES, reach: float = REACH, min_group: int = MIN_GROUP
) -> DataFrame:
    """One row per (lang, source) with ``low_<rule>`` and ``high_<rule>``."""
    slack = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.slack)])
    own = quantiles(histogram, ["lang", "source"])
    lang = quantiles(histogram, ["lang"]).select(
        F.col("lang").alias("_l"), F.col("rule").alias("_lr"), F.struct("total", "low", "middle", "high").alias("_lang")
    )
    every = quantiles(histogram, []).select(F.col("rule").alias("_er"), F.struct("total", "low", "middle", "high").alias("_every"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rule") == F.col("_lr"))).join(
        every, F.col("rule") == F.col("_er")
    )
    own_struct = F.struct("total", "low", "middle", "high")
    used = F.when(F.col("total") >= min_group, own_struct).otherwise(
        F.when(F.col("_lang.total") >= min_group, F.col("_lang")).otherwise(F.col("_every"))
    )
    q = joined.select("lang", "source", "rule", used.alias("q"))
    width = F.element_at(slack, F.col("rule"))
    fenced = q.select(
        "lang",
        "source",
        "rule",
        (F.col("q.low") - F.greatest(width, reach * (F.col("q.middle") - F.col("q.low")))).alias("lo"),
        (F.col("q.high") + F.greatest(width, reach * (F.col("q.high") - F.col("q.middle")))).alias("hi"),
    )
    picks = [F.max(F.when(F.col("rule") == r.name, F.col(c))).alias(f"{n}_{r.name}") for r in rules for c, n in (("lo", "low"), ("hi", "high"))]
    return fenced.groupBy("lang", "source").agg(*picks)


def base_failed() -> Column:
    """The fixed part: fewer than 10 words, or over a fifth of them in repeated runs."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(measured: DataFrame, bounds: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured texts by joining the fences of their group.

    The fences are one narrow row per group. They are broadcast while their number allows;
    beyond that Spark joins by group and splits hot ones.
    """
    inside = F.lit(True)
    for r in rules:
        value = ratio(r)
        within = value <= F.col(f"high_{r.name}")
        if r.two_sided:
            within = within & (value >= F.col(f"low_{r.name}"))
        inside = inside & F.coalesce(within, F.lit(True))
    joined = join_small(measured.drop("base_failed", "kept"), bounds, ["lang", "source"])
    added = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
    return added.drop(*bounds.columns[2:])


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every text: ``(doc_id, lang, source, counts, base_failed, kept)``."""
    measured = materialise(measure(docs, text, (key, "lang", "source")), "quality")
    return judge(measured, materialise(fences(sketches(measured)), "fences"))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Texts are read twice and never shuffled."""
    bounds = materialise(fences(sketches(measure(docs, text, ("lang", "source")))), "fences")
    own = {*COUNTS, "base_failed", "kept"}
    safe, names = aside(docs, lambda name: name in own or name.startswith(("low_", "high_", "_r_", "_tf_")))
    kept = judge(measure(safe, names[text]), bounds).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
