from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.operators import vocabulary as vocabulary_module
from textforge.operators.tokens import SPECIAL_TOKENS, TOKEN_PATTERN, split_tokens
from textforge.operators.vocabulary import build_vocabulary, decode_vocabulary, encode_vocabulary
from textforge.session import materialise


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the cat sat", "the  dog\n the cat", "", None, "é 日本 <x> <|im_end|> the", "the " * 50, "the cat sat"]
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("_more", F.lit("m"))


def test_ids_are_dense_and_by_frequency(spark, docs):
    rows = build_vocabulary(docs.repartition(4)).orderBy("token_id").collect()
    assert [r.token_id for r in rows] == list(range(len(rows)))
    order = [(-r.n, r.token.encode()) for r in rows]
    assert order == sorted(order) and len({r.token for r in rows}) == len(rows)
    assert {r.token for r in build_vocabulary(docs, min_count=2).collect()} == {r.token for r in rows if r.n >= 2}
    assert build_vocabulary(docs.limit(0)).collect() == []


@pytest.mark.parametrize("head", [0, 3, 1 << 16])
def test_decoding_gives_the_text_back(spark, docs, head):
    vocabulary = build_vocabulary(docs)
    encoded = encode_vocabulary(docs.unionAll(docs), vocabulary, head=head)
    assert encoded.columns == ["k", "text", "_more", "ids"]
    back = decode_vocabulary(encoded, vocabulary, head=head).collect()
    assert len(back) == 14 and all(r.decoded == (r.text or "") for r in back)
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    assert Counter(i for r in back for i in r.ids) == {ids[r.token]: 2 * r.n for r in vocabulary.collect()}


def test_tokens_and_ids_that_are_not_there(spark, docs):
    vocabulary = build_vocabulary(docs.where("k < 2"))
    known = encode_vocabulary(docs, vocabulary, unknown=-1, head=2)
    assert {r.k: r.ids.count(-1) for r in known.where("k in (0, 4)").collect()} == {0: 0, 4: 7}  # all but " the"
    with pytest.raises(Exception, match="not in the vocabulary"):
        encode_vocabulary(docs, vocabulary, head=2).collect()
    with pytest.raises(Exception, match="no token has the id 999"):
        decode_vocabulary(spark.createDataFrame([([0, 999],)], "ids array<long>"), vocabulary).collect()
    assert decode_vocabulary(spark.createDataFrame([(None,)], "ids array<long>"), vocabulary).first().decoded is None


def test_only_the_rows_are_written(spark, docs, monkeypatch):
    """Token lists are made where they are needed: they would be written and shuffled at several times the size of the text."""
    written = []
    monkeypatch.setattr(vocabulary_module, "materialise", lambda df, name, **options: written.append(df.columns) or materialise(df, name, **options))
    vocabulary = build_vocabulary(docs)
    encoded = encode_vocabulary(docs, vocabulary, head=2)
    back = decode_vocabulary(encoded, vocabulary, head=2).collect()
    assert written == [["k", "text", "_more", "_row"], ["k", "text", "_more", "ids", "_row"]]
    assert [r.decoded for r in sorted(back, key=lambda r: r.k)] == [r.text or "" for r in docs.orderBy("k").collect()]


def test_a_block_asks_once(spark, monkeypatch):
    """Rows with the same rarer tokens ask for them once a block, not once a row; blocks are neighbours of a bounded size."""
    texts = [f"a b{i % 3} c{i}" for i in range(40)] + [None, "a " * 200, "b1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").coalesce(1)
    for size, least in ((1 << 25, 1), (64, 5)):
        monkeypatch.setattr(vocabulary_module, "BLOCK", size)
        blocks, n = vocabulary_module._in_blocks(rows, F.octet_length("text"))
        placed = [(r["_block"], r["text"]) for r in blocks.select("_block", "text").collect()]
        assert placed == sorted(placed, key=lambda p: p[0]) and [t for _, t in placed] == texts
        members = {b: [t for x, t in placed if x == b] for b, _ in placed}
        assert sorted(members) == list(range(n)) and n >= least
        assert all(sum(len(t or "") for t in ts[:-1]) < size for ts in members.values())
        lists = blocks.select("_block", split_tokens(F.col("text")).alias("_values"))
        asked = vocabulary_module._asked(lists, T.StringType(), pa.array(["a", " a"])).collect()
        wanted = lists.select("_block", F.explode("_values").alias("value")).where("trim(value) != 'a'").distinct().collect()
        assert sorted(asked) == sorted(wanted) and len(wanted) > 30


@pytest.mark.parametrize("size", [1, 40, 1 << 25])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, size):
    """Nulls, empty texts and lists, repeated rows, and columns named like those of a lookup."""
    texts = [None, "", "the cat", "the cat", "x" * 100, " <b> <|im_end|>\n\r\n  ", None, "the dog"] * 5
    docs = spark.createDataFrame([(i, t, [i] * (i % 3), None) for i, t in enumerate(texts)], "value int, text string, found array<int>, part map<string, int>").repartition(3)
    monkeypatch.setattr(vocabulary_module, "BLOCK", size)
    vocabulary = build_vocabulary(docs)
    encoded = encode_vocabulary(docs, vocabulary, head=1)
    back = decode_vocabulary(encoded.withColumn("ids", F.when(F.col("text").isNotNull(), F.col("ids"))), vocabulary, head=2).collect()
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    assert sorted((r.value, r.text, r.decoded, r.found) for r in back) == sorted(((i, t, t, [i] * (i % 3)) for i, t in enumerate(texts)), key=lambda r: r[0])
    tokens = dict(docs.select("value", split_tokens(F.col("text"))).collect())
    assert {r.value: r.ids for r in encoded.collect()} == {i: [ids[w] for w in ws or ()] for i, ws in tokens.items()}


def test_the_quick_pattern_cuts_alike(spark):
    """Any mix of blanks, breaks, brackets and special tokens."""
    import random

    pick, pieces = random.Random(3), [" ", "\t", "\r", "\n", "\f", "\x0b", "<", ">", "a", "é", "\u00a0", "\u2028", "😀", "|", *SPECIAL_TOKENS, "<|im_", "<tool"]
    texts = ["".join(pick.choices(pieces, k=pick.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))
    assert df.where(split_tokens(F.col("text")) != plain).count() == 0 and df.where(F.array_join(plain, "") != F.col("text")).count() == 0
