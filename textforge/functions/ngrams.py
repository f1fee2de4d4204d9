"""Word splitting and word sequences for overlap scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything but lower-case ASCII letters and digits separates words.
WORD_BREAK = "[^a-z0-9]+"


def spaced_words(text: Column, pattern: str = WORD_BREAK) -> Column:
    """Lower-cased words with blanks between them; a null text has none."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), pattern, " ")


def spaced_lines(text: Column, pattern: str = WORD_BREAK) -> Column:
    """As ``spaced_words`` for each line, with the line breaks kept."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.transform(lines, lambda line: spaced_words(line, pattern)), "\n")


def words(text: Column, pattern: str = WORD_BREAK) -> Column:
    """Lower-cased words as an array."""
    return F.filter(F.split(spaced_words(text, pattern), " "), lambda w: w != "")


def word_sequences(tokens: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by blanks; none if there are fewer."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    runs = F.slice(tokens, F.lit(1), count)
    for start in range(2, n + 1):
        following = F.slice(tokens, F.lit(start), count)
        runs = F.zip_with(runs, following, lambda left, right: F.concat_ws(" ", left, right))
    return runs


def f_measure(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))
