"""Registered queries: validity, sampling, splits, registry, dataset storage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions.text import path_segment
from textforge.operators.chat import preview_rows
from textforge.operators.sampling import (
    first_n,
    first_n_per_group,
    select_subset,
    split_report,
    split_validation,
)
from textforge.operators.validity import filter_audit, filter_valid
from textforge.options import PrepOptions
from textforge.plans.prepare import prepare_splits
from textforge.registry import config_for_key, config_for_path, is_default_path
from textforge.session import fresh_path
from textforge.sources.datasets import load_or_materialise
from textforge.sources.snapshots import latest_snapshot
from textforge.workloads.relations import RAW, raw_samples, table


def valid_samples(spark: SparkSession, folder: str) -> DataFrame:
    return filter_valid(raw_samples(spark, folder)).select("sample_id", "split", "title", "NER", "ingredients")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(raw_samples(spark, folder))


def seeded_subset(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return select_subset(docs, 200, "doc_id", seed=42)


def seeded_subset_large(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select_subset(orders, 12_000, "o_orderkey", seed=7)


def subset_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 501 rows of a table whose key repeats."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    chosen = select_subset(items, 501, "l_orderkey", seed=42)
    return chosen.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"))


def subset_beyond_size(spark: SparkSession, folder: str) -> DataFrame:
    return select_subset(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), 10_000_000, "c_custkey")


def prepared_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Preparation from a configuration: filter, split off validation rows, subsets, test split kept."""
    config = {"datasets": [{"path": "documents", "val_size": 0.1}], "train_samples": 300, "val_samples": 40, "seed": 7}
    done = prepare_splits(raw_samples(spark, folder), PrepOptions.from_config(config))
    parts = [part.select("sample_id", "split") for part in (done.train, done.validation, done.test)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prepared_without_test(spark: SparkSession, folder: str) -> DataFrame:
    """The other dialect, on samples that are not filtered, have a ``val`` split and no ``test`` split."""
    config = {"dataset": {"name": "documents", "splits": {"train": "all", "validation": 25}}}
    options = replace(PrepOptions.from_config(config), filter_invalid=False, require_test=False)
    renamed = F.when(F.col("split") == "test", "val").otherwise(F.col("split"))
    done = prepare_splits(raw_samples(spark, folder).withColumn("split", renamed), options)
    return done.train.select("sample_id", "split").unionByName(done.validation.select("sample_id", "split"))


def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    kept = filter_valid(raw_samples(spark, folder))
    return split_validation(kept, "sample_id", 0.05, 42).select("sample_id", "split")


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    report = split_report(train_val_split(spark, folder))
    return report.select("split", "n_rows", F.round("pct", 6).alias("pct"))


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return first_n(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), 50, ["doc_id"])


def first_rows_per_group(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", "doc_id", "n_chars")
    return first_n_per_group(docs, ["lang"], ["doc_id"], 33)


# Path texts built from part types; most types name a model family, some none.
def _paths(spark: SparkSession, folder: str) -> DataFrame:
    family = F.concat(
        F.element_at(
            F.array(*[F.lit(x) for x in ("Meta-Llama", "MISTRAL", "gemma-2", "qwen2.5-llama", "OLMoE", "phi")]),
            (F.col("p_size") % 6 + 1).cast("int"),
        ),
        F.lit("/"),
        F.col("p_brand"),
    )
    return table(spark, folder, "part").select("p_partkey", family.alias("path"))


_PATHS = """paths AS (
  SELECT p_partkey, ['Meta-Llama', 'MISTRAL', 'gemma-2', 'qwen2.5-llama', 'OLMoE', 'phi'][p_size % 6 + 1]
    || '/' || p_brand AS path
  FROM part)"""


def registry_by_path(spark: SparkSession, folder: str) -> DataFrame:
    config = config_for_path(F.col("path"))
    return _paths(spark, folder).select(
        "p_partkey",
        "path",
        config["model_key"].alias("model_key"),
        config["supports_system"].alias("supports_system"),
        is_default_path(F.col("path")).alias("is_default"),
    )


def registry_exact(spark: SparkSession, folder: str) -> DataFrame:
    names = ("Llama", "MISTRAL", "gemma", "qwen", "OLMo")
    named = table(spark, folder, "part").select(
        "p_partkey",
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_size") % 5 + 1).cast("int")).alias("name"),
    )
    config = config_for_key(F.col("name"))
    return named.select("p_partkey", config["path"].alias("path"), config["supports_system"].alias("supports_system"))


def stored_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Stores the dataset on first use, then reads the stored copy; one split is one folder."""
    base = fresh_path(spark, "datasets")

    def load() -> DataFrame:
        return load_or_materialise(spark, "demo/raw:samples", base, lambda: raw_samples(spark, folder))

    load()
    return load().where("split = 'test'").select("sample_id", "title", F.length("directions").alias("n_chars"))


def dataset_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", path_segment(F.col("url")).alias("segment"))


def sample_previews(spark: SparkSession, folder: str) -> DataFrame:
    return preview_rows(raw_samples(spark, folder)).select("sample_id", "title", "NER", "ingredients", "directions")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as snapshot names of their customer's run; cancelled ones carry another name."""
    names = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run"),
        F.concat(
            F.when(F.col("o_orderstatus") == "P", F.lit("tmp-")).otherwise(F.lit("checkpoint-")),
            F.col("o_orderkey").cast("string"),
        ).alias("name"),
    )
    return latest_snapshot(names, "name", ["run"])


QUERIES = {
    "valid_samples": valid_samples,
    "filter_audit": audit,
    "seeded_subset": seeded_subset,
    "seeded_subset_large": seeded_subset_large,
    "subset_repeated_keys": subset_repeated_keys,
    "subset_beyond_size": subset_beyond_size,
    "prepared_splits": prepared_splits,
    "prepared_without_test": prepared_without_test,
    "train_val_split": train_val_split,
    "split_report": split_sizes,
    "first_n": first_rows,
    "first_n_per_group": first_rows_per_group,
    "registry_by_path": registry_by_path,
    "registry_exact": registry_exact,
    "stored_dataset": stored_dataset,
    "dataset_names": dataset_names,
    "sample_previews": sample_previews,
    "latest_snapshot": snapshots,
}

_SPLIT = f"""{RAW},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || sample_id), sample_id::VARCHAR) AS pos,
    count(*) OVER (PARTITION BY split) AS n
  FROM samples),
split_samples AS (
  SELECT sample_id, CASE WHEN split = 'train' AND pos <= ceil(CAST(0.05 AS DOUBLE) * n) THEN 'validation'
    ELSE split END AS split
  FROM ranked)"""


def _short(column: str) -> str:
    return f"CASE WHEN length({column}) > 100 THEN {column}[1:100] || '...' ELSE {column} END AS {column}"


ORACLES = {
    "valid_samples": f"WITH {RAW} SELECT sample_id, split, title, NER, ingredients FROM samples",
    "filter_audit": f"""WITH {RAW} SELECT split, count(*) AS n_before,
      count(*) FILTER (WHERE ok) AS n_after, count(*) FILTER (WHERE NOT ok) AS n_removed
      FROM flagged GROUP BY split""",
    "seeded_subset": """SELECT doc_id, lang, n_chars FROM documents
      ORDER BY md5('42:' || doc_id), doc_id::VARCHAR LIMIT 200""",
    "seeded_subset_large": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
      ORDER BY md5('7:' || o_orderkey), o_orderkey::VARCHAR LIMIT 12000""",
    "subset_repeated_keys": """SELECT l_orderkey, count(*) AS n_rows FROM (
      SELECT l_orderkey FROM lineitem ORDER BY md5('42:' || l_orderkey) LIMIT 501) GROUP BY l_orderkey""",
    "subset_beyond_size": "SELECT c_custkey, c_nationkey FROM customer",
    "prepared_splits": f"""WITH {RAW}, placed AS (
        SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('7:' || sample_id)) AS place,
          ceil(0.1 * count(*) OVER (PARTITION BY split)) AS border FROM samples)
      SELECT sample_id, CASE WHEN split = 'train' AND place <= border THEN 'validation' ELSE split END AS split FROM placed
      WHERE split = 'test' OR place <= least(border, 40) OR (place > border AND place <= border + 300)""",
    "prepared_without_test": f"""WITH {RAW} SELECT sample_id, split FROM raw WHERE split = 'train'
      UNION ALL SELECT sample_id, 'validation' FROM (
        SELECT sample_id FROM raw WHERE split = 'test' ORDER BY md5('42:' || sample_id) LIMIT 25)""",
    "train_val_split": f"WITH {_SPLIT} SELECT sample_id, split FROM split_samples",
    "split_report": f"""WITH {_SPLIT} SELECT split, count(*) AS n_rows,
      round(count(*) / (SUM(count(*)) OVER ())::DOUBLE * 100, 6) AS pct FROM split_samples GROUP BY split""",
    "first_n": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "first_n_per_group": """SELECT lang, doc_id, n_chars FROM documents
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 33""",
    "registry_by_path": f"""WITH {_PATHS}, keyed AS (
      SELECT *, CASE WHEN contains(lower(path), 'llama') THEN 'llama' WHEN contains(lower(path), 'mistral') THEN 'mistral'
        WHEN contains(lower(path), 'gemma') THEN 'gemma' WHEN contains(lower(path), 'qwen') THEN 'qwen'
        WHEN contains(lower(path), 'olmo') THEN 'olmo' END AS k FROM paths)
      SELECT p_partkey, path, coalesce(k, 'llama') AS model_key,
        coalesce(k, 'llama') IN ('llama', 'qwen') AS supports_system, k IS NULL AS is_default FROM keyed""",
    "registry_exact": """SELECT p_partkey, ['meta-llama/Llama-3.2-1B-Instruct', 'mistralai/Mistral-7B-Instruct-v0.3',
      'google/gemma-2-9b-it', 'Qwen/Qwen2.5-7B-Instruct', 'allenai/OLMoE-1B-7B-0924-Instruct'][p_size % 5 + 1] AS path,
      p_size % 5 IN (0, 3) AS supports_system FROM part""",
    "stored_dataset": f"""WITH {RAW} SELECT sample_id, title, length(directions)::INTEGER AS n_chars
      FROM raw WHERE split = 'test'""",
    "dataset_names": "SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS segment FROM pages",
    "sample_previews": f"""WITH {RAW} SELECT sample_id, {_short('title')}, {_short('NER')},
      {_short('ingredients')}, {_short('directions')} FROM raw""",
    "latest_snapshot": """SELECT o_custkey AS run, max(o_orderkey) AS step,
      'checkpoint-' || max(o_orderkey) AS latest FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""",
}
