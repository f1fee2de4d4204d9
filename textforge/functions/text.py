"""Text predicates and formatting as native column expressions."""

from __future__ import annotations

from string import Formatter
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the source system's strip() sees it: all Unicode blanks plus the four
# ASCII separators. Spark's trim() only knows U+0020.
_WS = r"[\s\x1c-\x1f]"


def is_blank(col: Column) -> Column:
    return col.rlike(rf"(?U)\A{_WS}*\z")


def strip(col: Column) -> Column:
    """Remove blanks at both ends. The lookbehind keeps long inner blank runs linear."""
    return F.regexp_replace(col, rf"(?U)\A{_WS}+|(?<!{_WS}){_WS}++\z", "")


def shown(col: Column, null_text: str = "None") -> Column:
    """A value as it appears inside a rendered prompt: nulls become ``null_text``."""
    return F.coalesce(col.cast("string"), F.lit(null_text))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Python format-style template with ``{name}`` placeholders, as one concat."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def preview(col: Column, length: int = 100) -> Column:
    """The first ``length`` characters followed by dots, if the text is longer than that."""
    head = F.concat(F.substring(col, 1, length), F.lit("..."))
    return F.when(F.length(col) > length, head).otherwise(col)


def path_segment(col: Column) -> Column:
    return F.translate(col, "/:", "__")


def percent(col: Column, decimals: int = 1) -> Column:
    """0.305 as ``30.5%``."""
    return F.format_string(f"%.{decimals}f%%", col * 100)


def signed_percent(col: Column, decimals: int = 1) -> Column:
    """A value already in percent, with its sign."""
    return F.format_string(f"%+.{decimals}f%%", col)


def fixed(col: Column, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", col)
