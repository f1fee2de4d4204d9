import random
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textforge.functions.lcs import lcs_indices, lcs_length, union_hits
from textforge.functions.ngrams import word_sequences, words
from textforge.operators.choice import accuracy, macro_average, pick_choices
from textforge.operators.matching import best_matches, embed_and_match, greedy_match, match_corpus
from textforge.operators.rouge import clipped_overlap, corpus_scores, rouge_lsum, rouge_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = st.lists(st.sampled_from("abcd"), max_size=14)


def table(a, b):
    lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lengths[i + 1][j + 1] = lengths[i][j] + 1 if x == y else max(lengths[i][j + 1], lengths[i + 1][j])
    return lengths


def walk_back(a, b):
    lengths, found, i, j = table(a, b), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found, i, j = [i - 1] + found, i - 1, j - 1
        elif lengths[i][j - 1] > lengths[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


@settings(max_examples=300, deadline=None)
@given(TOKENS, TOKENS)
def test_lcs(a, b):
    assert lcs_length(a, b) == table(a, b)[-1][-1] == lcs_length(b, a)
    assert lcs_indices(a, b) == walk_back(a, b)


def test_lcs_of_long_texts():
    generator = random.Random(1)
    a = [generator.choice("abcdefgh") for _ in range(20_000)]
    assert lcs_length(a, a[5_000:]) == 15_000


def brute(prediction, reference):
    import re

    p, r = ([w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split(" ") if w] for t in (prediction, reference))

    def f(hits, n, m):
        precision, recall = hits / max(n, 1), hits / max(m, 1)
        return 2 * precision * recall / (precision + recall) if precision + recall else 0.0

    def overlap(k):
        left = Counter(zip(*[p[i:] for i in range(k)]))
        right = Counter(zip(*[r[i:] for i in range(k)]))
        return f(sum((left & right).values()), sum(left.values()), sum(right.values()))

    return overlap(1), overlap(2), f(table(p, r)[-1][-1], len(p), len(r))


CASES = [
    ("a b c d", "b x d", 4 / 7, 0, 4 / 7),
    ("a a a", "a", 1 / 2, 0, 1 / 2),
    ("", "a b", 0, 0, 0),
    ("A-b!", "a b", 1, 1, 1),
    ("b a", "a b", 1, 0, 1 / 2),
    ("", "", 0, 0, 0),
    ("a", "a", 1, 0, 1),
    (None, "a", 0, 0, 0),
]


def test_fixture_cases(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "id int, prediction string, reference string")
    got = {r.id: (r.rouge1, r.rouge2, r.rougeL) for r in rouge_scores(df, ["id"]).collect()}
    assert len(got) == len(CASES)
    for i, case in enumerate(CASES):
        assert got[i] == pytest.approx(case[2:])


def test_random_texts_against_counting(spark):
    generator = random.Random(3)
    rows = [
        (i, *(" ".join(generator.choices(["a", "b", "c", "Dé", "x-y", "\n", "9"], k=generator.randrange(30))) for _ in "pr"))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    scores = {r.id: r for r in rouge_scores(df, ["id"]).collect()}
    for r in scores.values():
        assert (r.rouge1, r.rouge2, r.rougeL) == pytest.approx(brute(*rows[r.id][1:]))
        assert r.rougeL <= r.rouge1 + 1e-12
    for native in (True, False):
        for r in rouge_scores(df, ["id"], sizes=(1, 2, 3), subsequence=False, native=native).collect():
            assert (r.n_pred, r.n_ref, r.rouge1, r.rouge2) == (
                scores[r.id].n_pred, scores[r.id].n_ref, scores[r.id].rouge1, scores[r.id].rouge2
            )
    with pytest.raises(ValueError):
        rouge_scores(df, ["id"], native=True)


def test_symmetry_identity_and_larger_runs(spark):
    df = spark.createDataFrame([(1, "a b c a b", "a b c x"), (2, "q w e", "q w e")], "id int, prediction string, reference string")
    swapped = df.select("id", F.col("prediction").alias("reference"), F.col("reference").alias("prediction"))
    a = {r.id: r for r in rouge_scores(df, ["id"], sizes=(1, 2, 3)).collect()}
    b = {r.id: r for r in rouge_scores(swapped, ["id"], sizes=(1, 2, 3)).collect()}
    for i in (1, 2):
        assert a[i].rouge1 == b[i].rouge1 and a[i].rouge1_p == b[i].rouge1_r
    assert (a[2].rouge1, a[2].rouge2, a[2].rouge3, a[2].rougeL) == (1, 1, 1, 1)
    assert a[1].rouge3_p == pytest.approx(1 / 3)


@settings(max_examples=40, deadline=None)
@given(TOKENS, TOKENS)
def test_overlap(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(clipped_overlap(F.col("a"), F.col("b")).alias("n")).first().n == (Counter(a) & Counter(b)).total()


def test_runs_and_pattern(spark):
    df = spark.createDataFrame([("Été a-b",)], "t string")
    default, unicode_words = df.select(words(F.col("t")).alias("a"), words(F.col("t"), r"[^\p{L}\p{N}]+").alias("b")).first()
    assert default == ["t", "a", "b"] and unicode_words == ["été", "a", "b"]
    arrays = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.x for r in arrays.select(word_sequences(F.col("w"), 2).alias("x")).collect()] == [["a b", "b c"], [], []]


def test_scoring_is_a_projection(spark):
    df = spark.range(4).select("id", F.lit("a").alias("prediction"), F.lit("b").alias("reference"))
    assert "Exchange" not in rouge_scores(df, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_line_sums(spark):
    generator = random.Random(5)
    make = lambda: "\n".join(
        " ".join(generator.choices("abcde", k=generator.randrange(8))) for _ in range(generator.randrange(5))
    )
    rows = [(i, make(), make()) for i in range(60)] + [(99, "a b\nc d", "a c\nb d")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = {r.id: r for r in rouge_lsum(df, ["id"]).collect()}
    for i, prediction, reference in rows:
        p, r = ([line.split() for line in t.split("\n") if line] for t in (prediction, reference))
        left, right, hits = Counter(sum(p, [])), Counter(sum(r, [])), 0
        for sentence in r:
            union = sorted(set().union(*[walk_back(sentence, other) for other in p]) if p else [])
            for token in (sentence[k] for k in union):
                if left[token] and right[token]:
                    hits, left[token], right[token] = hits + 1, left[token] - 1, right[token] - 1
        assert union_hits(r, p) == hits
        assert got[i].rougeLsum_p == pytest.approx(hits / max(sum(map(len, p)), 1))
        assert got[i].rougeLsum_r == pytest.approx(hits / max(sum(map(len, r)), 1))


def test_corpus(spark):
    df = spark.createDataFrame([("m", 0.2), ("m", 0.4), ("n", 1.0)], "model string, rouge1 double")
    got = {r.model: (r.rouge1, r.num_samples) for r in corpus_scores(df, ["rouge1"], ["model"]).collect()}
    assert got["m"] == (pytest.approx(0.3), 2) and got["n"] == (1.0, 1)


def cosine_brute(a, b):
    def cosine(x, y):
        x, y = np.array(x), np.array(y)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    p = np.mean([max(cosine(x, y) for y in b) for x in a])
    r = np.mean([max(cosine(x, y) for x in a) for y in b])
    return p, r, 2 * p * r / (p + r)


def test_matching(spark, monkeypatch):
    generator = np.random.default_rng(1)
    rows = [(i, generator.normal(size=(i + 1, 4)).tolist(), generator.normal(size=(7 - i, 4)).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, candidate array<array<float>>, reference array<array<float>>")
    got = {r.id: (r.bert_precision, r.bert_recall, r.bert_f1) for r in greedy_match(df, ["id"]).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(cosine_brute(a, b), abs=1e-5)
    from textforge.operators import matching

    monkeypatch.setattr(matching, "TILE", 2)
    assert best_matches(rows[3][1], rows[3][2]) == pytest.approx(cosine_brute(rows[3][1], rows[3][2]))
    means = match_corpus(greedy_match(df, ["id"])).first()
    assert means.bert_f1 == pytest.approx(np.mean([v[2] for v in got.values()]))
    assert means.num_samples == 6


def test_matching_empty_side(spark):
    df = spark.createDataFrame([(1, [], [[1.0]]), (2, None, None)], "id int, candidate array<array<float>>, reference array<array<float>>")
    assert [list(r)[1:] for r in greedy_match(df, ["id"]).collect()] == [[0, 0, 0]] * 2


def make_letter_embedder():
    def embed(texts):
        return [[[float(c == letter) for letter in "abc"] for c in t if c in "abc"] for t in texts]

    return embed


def test_embed_and_match(spark):
    df = spark.createDataFrame([(1, "ab", "abc"), (2, "", "a")], "id int, prediction string, reference string")
    rows = {r.id: r for r in embed_and_match(df, ["id"], make_letter_embedder).collect()}
    assert rows[1].bert_precision == 1 and rows[1].bert_recall == pytest.approx(2 / 3)
    assert rows[2].bert_f1 == 0


CHOICES = "subject string, item_id int, choice_index int, choice_text string, loglik double, gold_index int"


def test_choices(spark):
    rows = [
        ("s", 1, 0, "aa", -4.0, 0), ("s", 1, 1, "bbbb", -6.0, 0),
        ("s", 2, 0, "a", -1.0, 1), ("s", 2, 1, "b", -1.0, 1),
        ("t", 3, 0, "a", -5.0, 1), ("t", 3, 1, "b", -1.0, 1),
    ]
    df = spark.createDataFrame(rows, CHOICES)
    item = ["subject", "item_id", "gold_index"]
    plain = {r.item_id: r.pick for r in pick_choices(df, item).collect()}
    assert plain == {1: 0, 2: 0, 3: 1}
    assert {r.item_id: r.pick for r in pick_choices(df, item, normalise=True).collect()} == {1: 1, 2: 0, 3: 1}
    by_subject = accuracy(pick_choices(df, item), ["subject"])
    assert {r.subject: (r.accuracy, r.samples) for r in by_subject.collect()} == {"s": (0.5, 2), "t": (1.0, 1)}
    macro = macro_average(by_subject, "subject", 66).first()
    assert (macro.accuracy, macro.samples, macro.n_subjects, macro.configured_samples) == (0.75, 3, 2, 66)
    assert macro_average(by_subject.where("false"), "subject").count() == 0
