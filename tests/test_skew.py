"""The registered queries on tables where one key holds a third of the rows or more."""

import pytest
from pyspark.sql import functions as F

import oracle
from textforge.workloads import catalog

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "filter_audit", "train_val_split", "first_n_per_group", "latest_snapshot", "chat_render", "chat_render_generation",
    "cross_model_prompts", "token_stats", "label_summary", "pad_batches", "vocab_by_group", "rouge1", "rouge_documents",
    "mc_picks", "mc_accuracy_norm", "mc_accuracy_limited", "endpoint_failures", "predict_in_waves", "suite_phases",
    "output_format_report",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("skewed")

    def change(name, df):
        df.toPandas().to_parquet(base / f"{name}.parquet", index=False, coerce_timestamps="us")

    def read(name):
        return spark.read.parquet(f"{SOURCE}/{name}.parquet")

    # One conversation of 400 turns beside 87 others.
    turns = read("conversations")
    text = F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(" the same words again"))
    role = F.when(F.col("id") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    long = spark.range(400).select(F.lit(10**6).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    change("conversations", turns.unionByName(long))
    # Half of the documents are copies of one text, in one language and from one source.
    docs = read("documents")
    copied = F.col("doc_id") % 2 == 0
    change(
        "documents",
        docs.withColumn("text", F.when(copied, F.lit("One text.\nCopied often.")).otherwise(F.col("text")))
        .withColumn("lang", F.when(copied, F.lit("en")).otherwise(F.col("lang")))
        .withColumn("source", F.when(copied, F.lit("src5")).otherwise(F.col("source"))),
    )
    # A third of the line items belong to one order, a third of the orders to one customer.
    items = read("lineitem")
    hot = F.col("l_partkey") % 3 == 0
    change("lineitem", items.withColumn("l_orderkey", F.when(hot, F.lit(7).cast("bigint")).otherwise(F.col("l_orderkey"))))
    orders = read("orders")
    change("orders", orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey"))))
    for name in set(oracle.TABLES) - {"conversations", "documents", "lineitem", "orders"}:
        change(name, read(name))
    return str(base)


@pytest.mark.parametrize("name", NAMES)
def test_whole_results(spark, folder, name):
    connection = oracle.connect(folder)
    assert oracle.compare(catalog.QUERIES[name](spark, folder), connection, catalog.ORACLES[name]) is None
