import pytest
from pyspark.sql import functions as F

from textforge.operators.epochs import PRIME, base_of, epoch_batches, epoch_place, round_keys, walk_length


def place(x, n, seed, epoch):
    m = base_of(n)
    for _ in range(walk_length(n)):
        left, right = divmod(x, m)
        for a, b in round_keys(seed, epoch):
            left, right = right, (left + ((right + a) % PRIME) ** 2 % PRIME * b % PRIME) % m
        x = left * m + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 16, 17, 26, 1000, 4999])
def test_every_row_has_one_place_in_every_epoch(spark, n):
    rows = spark.range(n).select("id", *[epoch_place(F.col("id"), n, 3, e).alias(f"e{e}") for e in range(3)]).collect()
    for e in range(3):
        assert sorted(r[f"e{e}"] for r in rows) == list(range(n))
        assert all(r[f"e{e}"] == place(r.id, n, 3, e) for r in rows[:200])
    if n >= 1000:
        assert sum(r.e0 == r.e1 for r in rows) < 20 and sum(r.e0 == r.id for r in rows) < 20
        following = {r.e0: r.id for r in rows}
        assert sum(abs(following[i + 1] - following[i]) == 1 for i in range(n - 1)) < 20


def test_large_numbers_do_not_overflow(spark):
    n = 4 * 10**18
    ids = [0, 1, n // 2, n - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", epoch_place(F.col("i"), n).alias("p")).collect()
    assert all(r.p == place(r.i, n, 42, 0) for r in got) and len({r.p for r in got}) == 4
    with pytest.raises(ValueError):
        epoch_place(F.lit(1), 1 << 63)


def test_resume_gives_the_rest_of_the_epoch(spark):
    rows = spark.range(103).withColumnRenamed("id", "n")
    whole = {(r.n, r.place, r.batch_id) for r in epoch_batches(rows, "n", 103, 10, epoch=4).collect()}
    rest = {(r.n, r.place, r.batch_id) for r in epoch_batches(rows.repartition(3), "n", 103, 10, epoch=4, first_batch=6).collect()}
    assert rest == {x for x in whole if x[2] >= 6} and len(whole) == 103 and max(x[2] for x in whole) == 10
    full = epoch_batches(rows, "n", 103, 10, epoch=4, drop_last=True)
    assert full.count() == 100 and "Exchange" not in full._jdf.queryExecution().executedPlan().toString()
    assert epoch_batches(rows.limit(0), "n", 0, 10).collect() == []
