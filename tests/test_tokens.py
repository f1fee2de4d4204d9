import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textforge.operators import tokens as tk
from textforge.operators.batching import assign_batches, pad_batches
from textforge.operators.chat import with_training_text
from textforge.registry import get_model

OFFSETS = "array<struct<start:int,end:int>>"
MASK_CASES = [
    ([5, 6, 7, 8], [0, 3, 6, 9], 6, [-100, -100, 7, 8]),
    ([5, 6, 7, 8], [0, 3, 6, 9], 7, [-100, -100, -100, 8]),
    ([5, 6], [0, 3], 50, [-100, -100]),
    ([5, 6], [0, 3], 0, [5, 6]),
    ([], [], 3, []),
]


@pytest.mark.parametrize("ids,starts,boundary,labels", MASK_CASES)
def test_labels_from_offsets(spark, ids, starts, boundary, labels):
    df = spark.createDataFrame([(ids, [(s, s + 1) for s in starts], boundary)], f"i array<int>, o {OFFSETS}, p int")
    start = tk.start_from_offsets(F.col("o"), F.col("p"))
    assert df.select(tk.masked_labels(F.col("i"), start).alias("l")).first().l == labels


TEXTS = st.text(alphabet="ab<| \t\n\xa0é>", max_size=30)


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_tokens_cover_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tk.split_tokens(F.col("t")).alias("x")).first().x
    assert "".join(got) == text
    assert got == re.findall(tk.TOKEN_PATTERN, text)


@settings(max_examples=40, deadline=None)
@given(TEXTS, TEXTS, st.one_of(st.none(), st.integers(0, 8)))
def test_boundary_from_token_count_equals_offsets(spark, prompt, answer, limit):
    full = prompt + answer
    df = spark.createDataFrame([(1, prompt, full)], "id int, text_prompt string, text_full string")
    row = tk.tokenize_native(df, max_length=limit).first()
    tokens = re.findall(tk.TOKEN_PATTERN, full)[:limit]
    begins, position = [], 0
    for token in tokens:
        begins.append(position)
        position += len(token)
    start = next((i for i, b in enumerate(begins) if b >= len(prompt)), len(tokens))
    assert row.tokens == tokens
    assert row.labels == [-100] * start + row.input_ids[start:]
    assert row.attention_mask == [1] * len(tokens)
    counted = tk.count_tokens(df, max_length=limit).first()
    assert (counted.n_tokens, counted.n_masked) == (len(tokens), start)


def test_ids(spark):
    df = spark.createDataFrame([("<|im_start|>",), ("<|im_end|>",), ("word",), (" word",)], "t string")
    ids = [r.i for r in df.select(tk.token_id(F.col("t")).alias("i")).collect()]
    assert ids[:2] == [151644, 151645]
    assert ids[2] != ids[3] and min(ids[2:]) >= tk.FIRST_HASHED_ID


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(str(i), f"title {i}", "salt é", "i", "step " * i) for i in range(1, 24)]
    return spark.createDataFrame(rows, "sample_id string, title string, NER string, ingredients string, directions string")


@pytest.fixture(scope="module")
def rendered(samples):
    return with_training_text(samples, get_model("qwen")).select("sample_id", "text_prompt", "text_full")


def piece_encoder():
    """Words cut into pieces of up to four characters, with offsets; blanks belong to no token."""

    def make():
        def encode(texts):
            spans = [[(i, min(i + 4, m.end())) for m in re.finditer(r"\S+", t) for i in range(m.start(), m.end(), 4)] for t in texts]
            return [([ord(t[a]) * 100 + b - a for a, b in at], at) for t, at in zip(texts, spans)]

        return encode

    return make


@pytest.mark.parametrize("limit", [None, 512, 40, 1])
def test_encoded_labels_against_offsets(rendered, limit):
    got = {r.sample_id: r for r in tk.encode_texts(rendered, piece_encoder(), max_length=limit, batch_size=5).collect()}
    assert len(got) == 23
    encode = piece_encoder()()
    for r in rendered.collect():
        ((ids, offsets),) = encode([r.text_full])
        ids, begins = ids[:limit], [o[0] for o in offsets[:limit]]
        start = next((i for i, b in enumerate(begins) if b >= len(r.text_prompt)), len(ids))
        assert got[r.sample_id].input_ids == ids
        assert got[r.sample_id].labels == [-100] * start + ids[start:]
        assert got[r.sample_id].attention_mask == [1] * len(ids)


def test_straddling_and_far_boundaries(spark):
    cases = [("", [1, 2, 3]), ("a", [-100, 2, 3]), ("aa", [-100, 2, 3]), ("aa ", [-100, 2, 3]),
             ("aa bb c", [-100, -100, -100]), ("x" * 50, [-100, -100, -100]), (None, [1, 2, 3])]
    df = spark.createDataFrame([(p, "aa bb cc") for p, _ in cases], "text_prompt string, text_full string")
    df = df.withColumn("p", F.col("text_prompt"))

    def make():
        return lambda texts: [([1, 2, 3], [(0, 2), (3, 5), (6, 8)]) for _ in texts]

    assert {r.p: r.labels for r in tk.encode_texts(df, make).collect()} == dict(cases)


def test_encoded_null_and_empty_texts_and_wrong_offsets(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "", "abcdefgh")], "k int, text_prompt string, text_full string")
    got = {r.k: r for r in tk.encode_texts(df, piece_encoder()).collect()}
    assert [got[k].input_ids for k in (1, 2)] == [[], []] and len(got[3].labels) == 2
    with pytest.raises(Exception, match="other numbers of ids and offsets"):
        tk.encode_texts(df, lambda: lambda texts: [([1], []) for _ in texts]).collect()


def test_decode(rendered):
    def make_encode():
        return lambda texts: [([ord(c) for c in t], [(i, i + 1) for i in range(len(t))]) for t in texts]

    def make_decode():
        return lambda rows: ["".join(map(chr, ids)) for ids in rows]

    tokens = tk.encode_texts(rendered.withColumn("full", F.col("text_full")), make_encode, max_length=None)
    for r in tk.decode_ids(tokens, make_decode, "input_ids").collect():
        assert r.decoded == r.full
    short = tk.decode_ids(tokens, make_decode, "input_ids", length=10).first()
    assert short.decoded == short.full[:10] + "..."


def test_statistics(spark):
    rows = [("m", [1, 2, 3], [-100, 2, 3]), ("m", [1], [-100]), ("n", [], [])]
    df = spark.createDataFrame(rows, "model string, input_ids array<int>, labels array<int>")
    stats = {r.model: r for r in tk.token_statistics(df).collect()}
    m = stats["m"]
    assert (m.num_samples, m.avg_length, m.min_length, m.max_length) == (2, 2.0, 1, 3)
    assert (m.avg_masked_tokens, m.avg_training_tokens, m.avg_masked_ratio, m.fully_masked) == (1.0, 1.0, 0.5, 1)
    assert stats["n"].avg_masked_ratio is None


def test_breakdown_and_texts(rendered):
    tokens = tk.tokenize_native(rendered.where("sample_id = '3'"))
    rows = tk.token_breakdown(tokens, ["sample_id"]).orderBy("index").collect()
    prompt = rendered.where("sample_id = '3'").first()
    assert "".join(r.token for r in rows) == prompt.text_full
    assert "".join(r.token for r in rows if r.training == "[MASKED]") == prompt.text_prompt
    assert all(r.masked == (r.label == -100) for r in rows)
    assert len(tk.token_breakdown(tokens, ["sample_id"], 5).collect()) == 5
    texts = tk.label_texts(tokens, ["sample_id"], None).first()
    assert texts.masked_text + texts.training_text == prompt.text_full
    summary = tk.label_summary(tokens, ["sample_id"]).first()
    assert summary.n_masked + summary.n_training == summary.n_tokens == len(rows)


def test_vocabulary(spark):
    df = spark.createDataFrame([("x", "a b"), ("x", "a a"), ("y", "c")], "g string, t string")
    sizes = tk.vocabulary_sizes(df, "g", "t")
    assert {r.g: r.vocab_size for r in sizes.collect()} == {"x": 3, "y": 1}  # "a", " b", " a"
    assert {r.g: r.vocab_size for r in tk.vocabulary_sizes(df, "g", "t", True).collect()} == {"x": 3, "y": 1}
    report = {r.g: (round(r.pct_of_max, 3), r.position) for r in tk.vocabulary_report(sizes, "g").collect()}
    assert report == {"x": (100.0, 1), "y": (33.333, 2)}
    many = spark.range(500).selectExpr("id AS g", "id % 7 AS vocab_size")
    got = [r.g for r in tk.vocabulary_report(many, "g").orderBy("position").collect()]
    assert got == sorted(range(500), key=lambda i: (-(i % 7), i))
    assert tk.vocabulary_report(many.limit(0), "g").collect() == []


def test_declared_vocabularies(spark):
    class Fixed:
        def get_vocab_size(self, with_added_tokens):
            return 7

    def broken():
        raise OSError("no file")

    with pytest.warns(UserWarning, match="no file"):
        df = tk.declared_vocabularies({"a": broken, "b": Fixed}, spark, {"b": "org/b"})
    assert [tuple(r) for r in df.collect()] == [("b", 7, "org/b"), ("a", 0, "")]


@pytest.mark.parametrize("drop_last,kept", [(False, 23), (True, 20)])
def test_batches(rendered, drop_last, kept):
    tokens = tk.tokenize_native(rendered)
    rows = pad_batches(tokens, "sample_id", 4, drop_last=drop_last).collect()
    plain = {r.sample_id: r for r in tokens.collect()}
    assert len(rows) == kept and len({r.sample_id for r in rows}) == kept
    groups = {}
    for r in rows:
        groups.setdefault(r.batch_id, []).append(r)
    assert sorted(groups) == list(range(-(-kept // 4)))
    for members in groups.values():
        longest = max(len(plain[m.sample_id].input_ids) for m in members)
        for m in members:
            source, gap = plain[m.sample_id], longest - len(plain[m.sample_id].input_ids)
            assert m.input_ids == source.input_ids + [tk.PAD_ID] * gap
            assert m.labels == source.labels + [-100] * gap
            assert m.attention_mask == source.attention_mask + [0] * gap
    assert sorted(len(m) for m in groups.values())[:1] == ([4] if drop_last else [3])


def test_single_row_batch(rendered):
    one = tk.tokenize_native(rendered.where("sample_id = '1'"))
    assert pad_batches(one, "sample_id", 4).first().input_ids == one.first().input_ids
    assert pad_batches(one, "sample_id", 4, drop_last=True).count() == 0


def test_batch_assignment_moves_no_arrays(rendered):
    tokens = tk.tokenize_native(rendered).select("sample_id", F.size("input_ids").alias("n_tokens"))
    assert set(assign_batches(tokens, "sample_id").columns) == {"sample_id", "batch_id", "batch_length"}


def test_batches_of_null_and_repeated_keys(spark):
    rows = [(None, [1]), ("a", [2, 2]), ("a", [3, 3, 3]), ("b", [4]), (None, [1])]
    df = spark.createDataFrame(rows, "k string, input_ids array<int>").selectExpr("*", "input_ids as attention_mask", "input_ids as labels")
    got = pad_batches(df, "k", 2).collect()
    assert sorted((str(r.k), [x for x in r.labels if x != -100]) for r in got) == sorted((str(k), ids) for k, ids in rows)
    sizes = [sum(r.batch_id == b for r in got) for b in range(3)]
    assert sizes == [2, 2, 1] and all(len(r.input_ids) == max(len(s.input_ids) for s in got if s.batch_id == r.batch_id) for r in got)
    assert len(pad_batches(df, "k", 2, drop_last=True).collect()) == 4
    one_key = spark.range(500).selectExpr("'x' as k", "array(cast(id as int)) as input_ids", "array(1) as attention_mask", "array(1) as labels")
    assert sorted(r.input_ids[0] for r in pad_batches(one_key, "k", 3).collect()) == list(range(500))
