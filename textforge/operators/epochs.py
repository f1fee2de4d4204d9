"""The order of training rows, another one for every epoch, without a sort.

Rows are numbered once, 0 to n - 1. The place of a row in an epoch is a keyed bijection of its number: a Feistel
network over pairs of digits to the base of the square root of n, which costs a few multiplications per row. A number
that falls outside goes through the network again until it is inside, so the whole is a bijection on 0 .. n - 1. A
job that resumes at some batch filters by place; nothing of the epochs before is needed.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = (1 << 31) - 1
WALK = 64  # beyond some 1,000 rows a number is outside with a probability of 2 / sqrt(n) per step


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below ``PRIME`` for each round."""
    digests = (hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest() for r in range(rounds))
    return [(int(d[:8], 16) % PRIME, int(d[8:16], 16) % (PRIME - 1) + 1) for d in digests]


def base_of(n: int) -> int:
    """The least base whose two-digit numbers cover 0 .. n - 1."""
    return math.isqrt(n - 1) + 1 if n > 0 else 1


def walk_length(n: int) -> int:
    """Steps that surely or all but surely lead inside: those outside are base squared minus n."""
    return min(base_of(n) ** 2 - n + 1, WALK)


def _network(x: Column, base: int, keys: list[tuple[int, int]]) -> Column:
    """One pass: of the digits (left, right), each round gives (right, left + f(right))."""

    start = F.struct(F.call_function("div", x, F.lit(base).cast("long")).alias("l"), (x % base).alias("r"))
    rounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in keys])

    def step(pair: Column, key: Column) -> Column:
        mixed = (pair["r"] + key["a"]) % PRIME
        mixed = (mixed * mixed) % PRIME * key["b"] % PRIME
        return F.struct(pair["r"].alias("l"), ((pair["l"] + mixed) % base).alias("r"))

    return F.aggregate(rounds, start, step, lambda pair: pair["l"] * base + pair["r"])


def epoch_place(number: Column, n: int, seed: int = 42, epoch: int = 0) -> Column:
    """Place (BIGINT) of row ``number`` of 0 .. n - 1 in an epoch."""
    if n < 0 or n >= PRIME**2:
        raise ValueError("the number of rows must lie between 0 and 4.6e18")
    base, keys = base_of(n), round_keys(seed, epoch)
    steps = F.sequence(F.lit(1), F.lit(walk_length(n)))
    start = F.struct(number.cast("long").alias("x"), F.lit(False).alias("done"))

    def walk(state: Column, _: Column) -> Column:
        following = _network(state["x"], base, keys)
        return F.when(state["done"], state).otherwise(F.struct(following.alias("x"), (following < n).alias("done")))

    lost = F.raise_error(F.concat(F.lit("no place found for row "), number.cast("string"))).cast("long")
    return F.aggregate(steps, start, walk, lambda state: F.when(state["done"], state["x"]).otherwise(lost))


def epoch_batches(
    rows: DataFrame, number: str, n: int, batch_size: int, seed: int = 42, epoch: int = 0, first_batch: int = 0, drop_last: bool = False
) -> DataFrame:
    """``rows`` with ``place`` and ``batch_id`` in one epoch, from ``first_batch`` on (where a run resumes).

    ``number`` is 0 .. n - 1, each once (``number_rows``). A projection and a filter: no shuffle. With ``drop_last`` the
    incomplete batch at the end of the epoch goes.
    """
    placed = rows.withColumn("place", epoch_place(F.col(number), n, seed, epoch))
    placed = placed.withColumn("batch_id", F.call_function("div", F.col("place"), F.lit(batch_size).cast("long")))
    last = n // batch_size if drop_last else math.ceil(n / batch_size)
    return placed.where((F.col("batch_id") >= first_batch) & (F.col("batch_id") < last))
