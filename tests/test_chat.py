from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textforge.functions.templates import DEFAULT_SYSTEM, TOOLS_INTRO, TOOLS_OUTRO, render_messages, render_turn
from textforge.operators.chat import (
    build_messages,
    message_rows,
    messages_per_model,
    preview_rows,
    reference_column,
    with_registry,
    with_training_text,
)
from textforge.options import FieldMap
from textforge.registry import DEFAULT_REGISTRY, SYSTEM_MESSAGE, get_model

SAMPLE = "sample_id int, title string, NER string, ingredients string, directions string"
ANSWER = "Certainly! Here's a delicious recipe for:\n[ T ]\n\n[ INGREDIENTS ]\ni\n\n[ DIRECTIONS ]\nd"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, "T", "salt", "i", "d"), (2, None, None, None, None)], SAMPLE)


def built(samples, model, **options):
    rows = samples.select("sample_id", build_messages(samples, model, **options).alias("m")).collect()
    return {r.sample_id: [(m.role, m.content) for m in r.m] for r in rows}


def test_system_model(samples):
    got = built(samples, get_model("qwen"))
    assert got[1] == [("system", SYSTEM_MESSAGE), ("user", "Include ingredients: salt")]
    assert got[2][1] == ("user", "Include ingredients: None")
    assert built(samples, get_model("qwen"), null_text="")[2][1] == ("user", "Include ingredients: ")


def test_merged_model(samples):
    assert built(samples, get_model("gemma"))[1] == [("user", SYSTEM_MESSAGE + "\n\n\n\nInclude ingredients: salt")]


def test_title_line(samples):
    titled = replace(get_model("gemma"), include_title_in_user=True)
    got = built(samples, titled)
    assert got[1][0][1] == SYSTEM_MESSAGE + "\n\n\n\nTitle: T\n\nInclude ingredients: salt"
    assert got[2][0][1] == SYSTEM_MESSAGE + "\n\n\n\nInclude ingredients: None"


def test_assistant_turn(samples):
    got = built(samples, get_model("llama"), include_assistant=True)
    assert got[1][2] == ("assistant", ANSWER)
    assert "[ None ]" in got[2][2][1]


def test_absent_columns(samples):
    bare = samples.select("sample_id")
    assert built(bare, get_model("qwen"))[1][1] == ("user", "Include ingredients: ")
    text = bare.select(reference_column(bare).alias("t")).first().t
    assert text.startswith("Certainly! Here's a delicious recipe for:\n[ Recipe ]\n\n")


def test_field_map(spark):
    df = spark.createDataFrame([(1, "x", "y", "T", "N")], "sample_id int, list string, steps string, title string, NER string")
    fields = FieldMap(input="title", output="steps", title="list")
    row = df.select(build_messages(df, get_model("qwen"), True, fields).alias("m")).first().m
    assert row[1].content == "Include ingredients: T" and "[ x ]" in row[2].content and "y" in row[2].content


def test_every_model_agrees_with_single_builds(samples):
    for registry in (DEFAULT_REGISTRY, [replace(m, include_title_in_user=True) for m in DEFAULT_REGISTRY]):
        each = with_registry(samples, registry)
        rows = each.select("sample_id", "model.model_key", messages_per_model(each, True).alias("m")).collect()
        assert len(rows) == 2 * len(registry)
        for model in registry:
            single = built(samples, model, include_assistant=True)
            for r in rows:
                if r.model_key == model.model_key:
                    assert [(m.role, m.content) for m in r.m] == single[r.sample_id]


def test_training_text_has_prompt_as_prefix(samples):
    each = with_training_text(with_registry(samples))
    one = with_training_text(samples, get_model("qwen"))
    for r in each.collect() + one.collect():
        assert r.text_full.startswith(r.text_prompt)
        assert r.text_prompt.endswith("<|im_start|>assistant\n")
    full = samples.withColumn("m", build_messages(samples, get_model("qwen"), True)).select(
        "sample_id", render_messages(F.col("m")).alias("t")
    )
    assert {r.sample_id: r.t for r in full.collect()} == {r.sample_id: r.text_full for r in one.collect()}


# Message lists and the texts that the template gives for them, typed out; {S} is the default system text.
TEMPLATE_CASES = [
    ([("user", "hi")], "<|im_start|>system\n{S}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"),
    (
        [("system", "s"), ("user", "hi"), ("assistant", "yo")],
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n",
    ),
    (
        [("user", "hi"), ("system", "late"), ("assistant", "yo")],
        "<|im_start|>system\n{S}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>system\nlate<|im_end|>\n"
        "<|im_start|>assistant\nyo<|im_end|>\n",
    ),
    (
        [("tool", "alone")],
        "<|im_start|>system\n{S}<|im_end|>\n<|im_start|>user\n<tool_response>\nalone\n</tool_response><|im_end|>\n",
    ),
    (
        [("user", "q"), ("assistant", "", [("f", '{"a": 1}'), ("g", "{}")]), ("tool", "1"), ("tool", "2"), ("assistant", "ok")],
        "<|im_start|>system\n{S}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<tool_call>\n"
        '{"name": "f", "arguments": {"a": 1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n"
        "<|im_start|>assistant\nok<|im_end|>\n",
    ),
    (
        [("user", "q"), ("assistant", "wait", [("f", None)]), ("tool", "1"), ("user", "and"), ("tool", "2")],
        "<|im_start|>system\n{S}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nwait\n<tool_call>\n"
        '{"name": "f", "arguments": null}\n</tool_call><|im_end|>\n'
        "<|im_start|>user\n<tool_response>\n1\n</tool_response><|im_end|>\n<|im_start|>user\nand<|im_end|>\n"
        "<|im_start|>user\n<tool_response>\n2\n</tool_response><|im_end|>\n",
    ),
]
CALLS = "name:string,arguments:string"


def rendered(spark, nested=False, **options):
    wrap = (lambda call: (call,)) if nested else (lambda call: call)
    rows = [(i, [(m[0], m[1], [wrap(c) for c in m[2]] if len(m) > 2 else None) for m in c]) for i, (c, _) in enumerate(TEMPLATE_CASES)]
    call = f"struct<function:struct<{CALLS}>>" if nested else f"struct<{CALLS}>"
    df = spark.createDataFrame(rows, f"i int, messages array<struct<role:string,content:string,tool_calls:array<{call}>>>")
    text = render_messages(F.col("messages"), has_tool_calls=True, nested_calls=nested, **options)
    return [r.t for r in df.select("i", text.alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("nested", [False, True])
def test_template(spark, nested):
    want = [text.replace("{S}", DEFAULT_SYSTEM) for _, text in TEMPLATE_CASES]
    assert rendered(spark, nested) == want
    assert rendered(spark, nested, add_generation_prompt=True) == [w + "<|im_start|>assistant\n" for w in want]


def test_template_with_tools(spark):
    tool = '\n{"name": "f", "x": [1, "é"]}'
    for got, (messages, text) in zip(rendered(spark, tools=[{"name": "f", "x": [1, "é"]}]), TEMPLATE_CASES):
        system = "s" if messages[0][0] == "system" else DEFAULT_SYSTEM
        head = f"<|im_start|>system\n{system}"
        assert got == head + TOOLS_INTRO + tool + TOOLS_OUTRO + text.replace("{S}", DEFAULT_SYSTEM).removeprefix(head)


def test_a_call_needs_a_name(spark):
    df = spark.createDataFrame([([("assistant", "", [(None, "{}")])],)], f"m array<struct<role:string,content:string,tool_calls:array<struct<{CALLS}>>>>")
    with pytest.raises(Exception, match="without a name"):
        df.select(render_messages(F.col("m"), has_tool_calls=True)).collect()


def test_turn_blocks_join_to_the_conversation(spark):
    for case in (0, 1, 2):
        messages, text = TEMPLATE_CASES[case]
        df = spark.createDataFrame([(i, *m) for i, m in enumerate(messages)], "i int, r string, c string")
        blocks = df.select("i", render_turn(F.col("r"), F.col("c"), F.col("i") == 0).alias("b")).orderBy("i").collect()
        assert "".join(b.b for b in blocks) == text.replace("{S}", DEFAULT_SYSTEM)


def test_message_rows_and_preview(samples):
    rows = message_rows(samples.select("sample_id", build_messages(samples, get_model("qwen")).alias("messages")), ["sample_id"])
    assert [(r.position, r.role) for r in rows.where("sample_id = 1").orderBy("position").collect()] == [
        (0, "system"), (1, "user")
    ]
    assert preview_rows(samples, 1).where("sample_id = 1").first().NER == "s..."
