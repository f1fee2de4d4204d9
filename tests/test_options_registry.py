import pytest
from pyspark.sql import functions as F

from textforge.options import FieldMap, PrepOptions, SuiteOptions, dataset_path, safe_name
from textforge.registry import (
    DEFAULT_REGISTRY,
    config_for_key,
    config_for_path,
    get_model,
    get_model_for_path,
    is_default_path,
)


def test_new_dialect():
    options = PrepOptions.from_config(
        {
            "base_model": "Qwen/x",
            "sequence_len": 256,
            "dataset": {
                "name": "org/set",
                "splits": {"train": "all", "validation": 200},
                "seed": 7,
                "val_size": 0.1,
                "field_map": {"input": "I", "output": "O", "unknown": "z"},
            },
        }
    )
    assert (options.name, options.train, options.validation, options.test) == ("org/set", "all", 200, "all")
    assert (options.seed, options.val_size, options.max_length) == (7, 0.1, 256)
    assert options.fields == FieldMap(input="I", output="O")


def test_old_dialect():
    options = PrepOptions.from_config(
        {"datasets": [{"path": "org/set"}], "train_samples": 10, "val_samples": 2, "seed": 3}
    )
    assert (options.name, options.train, options.validation, options.test) == ("org/set", 10, 2, "all")
    assert (options.seed, options.val_size) == (3, 0.05)


def test_no_dialect():
    with pytest.raises(KeyError):
        PrepOptions.from_config({"datasets": "text"})


def test_suite_options():
    options = SuiteOptions.from_config(
        {"enable_benchmarks": True, "mmlu_samples": 33, "mmlu_subjects": ["a", "b", "c"], "hellaswag_samples": 100}
    )
    assert options.configured_items == 99 and options.completion_items == 100 and not options.enable_domain


def test_paths():
    assert safe_name("org/set:v1") == "org_set_v1"
    assert dataset_path("org/set", "/data/") == "/data/org_set"


PATHS = {
    "meta-llama/Llama-3.2-1B": ("llama", False),
    "MISTRALAI/M": ("mistral", False),
    "google/gemma-2": ("gemma", False),
    "Qwen/Qwen2.5": ("qwen", False),
    "allenai/OLMoE": ("olmo", False),
    "x/llama-qwen": ("llama", False),
    "x/qwen-mistral": ("mistral", False),
    "other/phi": ("llama", True),
    "": ("llama", True),
}


def test_lookup_by_path(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    rows = df.select("p", config_for_path(F.col("p")).alias("c"), is_default_path(F.col("p")).alias("d")).collect()
    assert {r.p: (r.c.model_key, r.d) for r in rows} == PATHS
    assert {p: get_model_for_path(p).model_key for p in PATHS} == {p: k for p, (k, _) in PATHS.items()}


def test_lookup_by_key(spark):
    df = spark.createDataFrame([(m.model_key.upper(),) for m in DEFAULT_REGISTRY], "k string")
    rows = df.select(config_for_key(F.col("k")).alias("c")).collect()
    assert [r.c.path for r in rows] == [m.path for m in DEFAULT_REGISTRY]
    assert get_model("GEMMA").supports_system is False


def test_unknown_key_fails(spark):
    with pytest.raises(ValueError, match="llama, mistral"):
        get_model("phi")
    df = spark.createDataFrame([("phi",)], "k string")
    with pytest.raises(Exception, match="unknown model phi"):
        df.select(config_for_key(F.col("k"))).collect()


def test_lookups_do_not_join(spark):
    df = spark.range(5).select(config_for_path(F.col("id").cast("string")).alias("c"))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
