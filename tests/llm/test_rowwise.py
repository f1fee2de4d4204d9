"""Operators that judge or encode each text: packing, quality rules, toxicity, BPE, language model."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import cases
from textforge.llm import bpe, packing, quality, suffix_tree, toxicity
from textforge.llm import bytes as tb


@pytest.fixture(scope="module")
def edge(spark):
    return cases.docs(spark)


# -- packing ---------------------------------------------------------------------------------


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice(np.arange(1, 60), 9, replace=False).tolist())
    counts = rng.integers(1, 20, 9).tolist()
    for buckets in (1, 2, 3, 4, 9, 20):
        bounds = packing.optimal_boundaries(lengths, counts, buckets)
        assert bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1] and len(bounds) <= buckets
        best = min(
            padding(lengths, counts, (*cut, lengths[-1]))
            for k in range(min(buckets, 9))
            for cut in itertools.combinations(lengths[:-1], k)
        )
        assert padding(lengths, counts, bounds) == best


def test_packing(spark, edge):
    budget = 512
    got = packing.pack(edge, budget=budget, buckets=3).collect()
    expected = Counter((i, len(cases.words(t)) + 1) for i, t in cases.edge_texts())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == expected
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), members in batches.items():
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert len({m.padded_tokens for m in members}) == 1 or members[0].n_tokens > budget
        assert all(m.n_tokens <= m.padded_tokens for m in members)
        assert len(members) == 1 or len(members) * members[0].padded_tokens <= budget
        if (bucket, batch + 1) in batches and members[0].n_tokens <= budget:
            assert len(members) == budget // members[0].padded_tokens
    assert packing.pack(cases.empty(spark)).collect() == []


# -- quality ---------------------------------------------------------------------------------


def brute_counts(text):
    found, symbols = cases.words(text), sum(c in "#*$%&|<>" for c in text or "")
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    worded = [x for x in (text or "").split("\n") if cases.words(x)]
    return len(found), sum(map(len, found)), symbols, len(worded) - len(set(worded)), len(hit)


def test_quality_counts(edge):
    got = quality.assess(edge).collect()
    texts = defaultdict(list)
    for i, t in cases.edge_texts():
        texts[i].append(brute_counts(t))
    seen = defaultdict(list)
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        seen[r.doc_id].append(counts)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in texts.items()}


def test_quality_thresholds_adapt(spark):
    """A source full of symbols keeps them; in another source the same text is out of the ordinary."""
    plain = [(i, cases.prose(i, 40), "en", "plain", 1) for i in range(300)]
    tables = [(1000 + i, " | ".join(cases.prose(i, 40).split()), "en", "tables", 1) for i in range(300)]
    odd = [(5000, " | ".join(cases.prose(5000, 40).split()), "en", "plain", 1)]
    docs = spark.createDataFrame(plain + tables + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality.assess(docs).collect()}
    assert not kept.pop(5000) and all(kept.values())
    assert quality.filter_quality(docs).count() == 600


def test_quality_quantiles_near_exact(spark):
    docs = spark.createDataFrame([(i, cases.prose(i, 20 + i), "en", "s", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    measured = quality.measure(docs)
    got = {r.rule: r for r in quality.quantiles(quality.sketches(measured), ["lang", "source"]).collect()}["word_length"]
    exact = np.quantile([r.word_chars / r.n_words for r in measured.collect()], [0.1, 0.5, 0.9], method="inverted_cdf")
    for value, want in zip((got.low, got.middle, got.high), exact):
        assert want <= value * (1 + 1e-9) and value <= want * quality.GAMMA * (1 + 1e-9)


def test_quality_filter_keeps_columns(spark, edge):
    kept = quality.filter_quality(edge)
    assert kept.schema == edge.schema
    assert all(r.kept == "x" and r.n_words == "x" for r in kept.collect())
    assert quality.filter_quality(cases.empty(spark)).collect() == [] and quality.assess(cases.empty(spark)).collect() == []


# -- toxicity --------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        text = cases.prose(i, int(rng.integers(30, 200))).split()
        toxic = i % 9 == 0
        if toxic:
            for at in rng.choice(len(text), max(2, len(text) // 20), replace=False):
                text[at] = ["Rotter###", "beast", "Rotter"][int(at) % 3]
        rows.append((i, " ".join(text), "en", "s", 1))
        if i < 600:
            labels += [(i, 1, int(toxic ^ (i % 50 == 1)))] * (1 + i % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.doc_id >= 600]
    assert sum(r.toxic == (r.doc_id % 9 == 0) for r in held) >= 0.97 * len(held)
    severity = lambda bad: np.mean([r.expected_severity for r in held if (r.doc_id % 9 == 0) == bad])
    assert severity(True) > severity(False) + 0.5
    assert all(0 <= r.expected_severity <= 3 for r in got)


def brute_features(text):
    """Counts of the words (letters and bytes above 0x7F, lower case) and of the beginnings of longer words."""
    found = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    named = Counter((w, 0) for w in found)
    for size in toxicity.PREFIXES:
        named.update((w[:size], size) for w in found if len(w) > size)
    return named, len(found)


def feature_hash(name):
    data = np.frombuffer(name[0], np.uint8)
    return int(tb.span_hashes(data, np.array([0]), np.array([len(data)]))[0] + np.uint64(name[1]))


def test_toxicity_equals_brute_force(spark):
    """Feature counts, the choice of features, and the scores of every text, against plain loops."""
    rows = [(i, t) for i, t in cases.edge_texts() if i != 14]
    rows += [(100 + i, cases.prose(i, 12 + i) + (" Awful beasts! awful-BEAST été" if i % 3 == 0 else " Mild été")) for i in range(40)]
    docs = cases.docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 1)) for i in range(100, 140)] + [(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    counts = defaultdict(lambda: [0, 0])
    for i, t in rows:
        if i in toxic:
            for name in brute_features(t)[0]:
                counts[name][toxic[i]] += 1
    n = Counter(toxic[i] for i, _ in rows if i in toxic)
    want = {}
    for name, (in0, in1) in counts.items():
        gap, total = in1 * (n[0] - in0) - in0 * (n[1] - in1), in0 + in1
        if sum(n.values()) * gap**2 / max(total * (sum(n.values()) - total) * n[0] * n[1], 1) >= toxicity.SIGNIFICANT:
            want[feature_hash(name)] = (in1, in0)
    texts = toxicity.training_texts(docs, labels)
    got = toxicity.select_features(texts, n[1], n[0], 10**6)
    assert {r.feature & (2**64 - 1): (r.in1, r.in0) for r in got} == want and len(want) > 5

    model = toxicity.fit(docs, labels)
    assert model.features.tolist() == sorted(want)
    weight = dict(zip(model.features.tolist(), model.weights))
    expected = []
    for i, t in rows:
        named, words = brute_features(t)
        score = sum(weight.get(feature_hash(name), 0.0) * k for name, k in named.items()) / math.sqrt(max(words, 1))
        score += model.weights[-1] * math.sqrt(words) / 10
        upto = [1 / (1 + math.exp(score - c)) for c in model.cuts]
        expected.append((i, sum(1 - p for p in upto)))
    result = [(r.doc_id, r.expected_severity) for r in toxicity.score(docs, model).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (i, x), (j, y) in zip(sorted(result, key=order), sorted(expected, key=order), strict=True):
        assert i == j and abs(x - y) < 1e-9


def test_toxicity_gradient():
    """The fit climbs: a numeric derivative of the likelihood vanishes at the result."""
    rng = np.random.default_rng(0)
    x = rng.random(400)
    grades = np.clip((x * 3 + rng.normal(0, 0.5, 400)).astype(int), 0, 3)
    weights, cuts = toxicity.fit_ordinal(np.arange(400), np.zeros(400, int), x, grades, 1)

    def likelihood(w):
        p = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.array([w]), cuts).probabilities(w * x)
        return np.log(p[np.arange(400), grades]).mean()

    assert weights[0] > 1 and likelihood(weights[0]) >= max(likelihood(weights[0] - 0.5), likelihood(weights[0] + 0.5)) - 1e-3


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, labels)
    assert len(toxicity.score(edge, model).collect()) == len(cases.edge_texts())
    none = toxicity.fit(cases.empty(spark), labels.limit(0))
    assert toxicity.score(cases.empty(spark), none).collect() == []
    assert all(not r.toxic and r.expected_severity < 0.01 for r in toxicity.score(edge, none).collect())


# -- BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("frequent", [0, 50])
def test_bpe(spark, edge, ranks, monkeypatch, frequent):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = Counter()
    for i, t in cases.edge_texts():
        ids = library.encode_ordinary(t or "")
        texts[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digest(edge, ranks, public_tokenizers.PATTERN).collect())) == texts


def test_words_merge_alike_at_any_length_and_with_a_full_cache(ranks, monkeypatch):
    rng = random.Random(8)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choices("aeinrst ouü語", k=n)) for n in (1, 2, 3, 9, 60, 63, 64, 65, 127, 128, 129, 400) for _ in range(8)] + ["a" * 300]
    want = [tuple(library.encode_ordinary(w)) for w in words]
    assert [bpe.merge_word(w.encode(), ranks) for w in words] == want
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert [bpe.merge_word(w.encode(), ranks) for w in words] == want
    made = []
    cache = bpe.WordCache(lambda w: made.append(w) or w.upper(), 5)
    assert [cache.all(x) for x in (["a", "b"], ["b", "c"], ["a", "d", "e", "f"], ["f"])] == [["A", "B"], ["B", "C"], ["A", "D", "E", "F"], ["F"]]
    assert made == ["a", "b", "c", "a", "d", "e", "f"]


def test_bpe_round_trip(spark, ranks):
    texts = ["", None, "don't  stop\n\n now 1234 ÀÉ\U0001f600 <|endoftext|>", "a" * 120, "\x00\x07 tabs\t\t\tend   "]
    docs = cases.docs(spark, list(enumerate(texts)))
    back = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digest(cases.empty(spark), ranks, public_tokenizers.PATTERN).collect() == []


# -- language model --------------------------------------------------------------------------


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_base_scores(spark, edge, monkeypatch, frequent):
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    got = suffix_tree.score(edge).collect()
    tokens = [(i, cases.words(lower(t)), i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in cases.edge_texts()]
    counts, n = Counter(), 0
    for _, found, held in tokens:
        if not held:
            counts.update(found)
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + 1
    want = defaultdict(list)
    for i, found, held in tokens:
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in [counts[w] for w in found] + [n])
        want[i].append((len(found) + 1, sum(counts[w] > 0 for w in found) + 1, held, base))
    seen = defaultdict(list)
    for r in got:
        assert r.train_tokens == total and r.score < 0
        seen[r.doc_id].append((r.n_tokens, r.n_known, r.held_out, r.base_score))
    for i in want:
        for a, b in zip(sorted(want[i]), sorted(seen[i])):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)


def test_tree_is_a_distribution_and_learns(spark):
    """Next symbols add up to one in any context, and held-out text of the same source scores better."""
    rng = np.random.default_rng(3)
    make = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"], 60))
    docs = spark.createDataFrame([(i, make(), "en", "s", 1) for i in range(80)] + [(1000 + i, cases.prose(i, 60), "en", "s", 1) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    tree = suffix_tree.fit_tree(suffix_tree.with_split(docs.where("doc_id < 1000")))
    for past in (b"\n\n\n\n\n", b"alpha", b"bet", b"zzzzz", b"a gam"):
        context = int.from_bytes(past.rjust(5, b"\n"), "big")
        keys = np.array([(context << 8) | s for s in range(256)], np.uint64)
        assert np.sum(10 ** tree.log10(keys)) == pytest.approx(1)
    got = [r for r in suffix_tree.score(docs.where("doc_id < 1000")).collect() if r.held_out]
    assert np.mean([r.score / r.n_tokens for r in got]) > -0.75  # three words: log10(1/3) = -0.48 each


def brute_tree(training, texts):
    """log10 of each text by a tree built from plain counts of all contexts."""
    depth = suffix_tree.DEPTH
    stream = lambda t: b"\n" * depth + b"".join(w.encode() + b" " for w in cases.words(lower(t))) + b"\n"
    counts = defaultdict(Counter)
    for t in training:
        s = stream(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[i - d : i]][s[i]] += 1
    states = {b""}
    for context in sorted(counts, key=len):
        if context and context[1:] in states:
            own, less = counts[context], counts[context[1:]]
            n, m = sum(own.values()), sum(less.values())
            if sum(c * math.log(c * m / (n * less[x])) for x, c in own.items()) >= suffix_tree.GAIN * len(own):
                states.add(context)

    def chance(context, symbol):
        lower_ = chance(context[1:], symbol) if context else 1 / 256
        own = counts[context]
        n = sum(own.values())
        return (own[symbol] + len(own) * lower_) / (n + len(own)) if n else lower_

    def log10(t):
        s, total = stream(t), 0.0
        for i in range(depth, len(s)):
            context = next(s[i - d : i] for d in range(depth, -1, -1) if s[i - d : i] in states)
            total += math.log10(chance(context, s[i]))
        return total

    return states, [log10(t) for t in texts]


@pytest.mark.parametrize("cached", [1 << 21, 700, 40, 3])
def test_tree_equals_brute_force_whatever_is_cached(spark, monkeypatch, cached):
    """Kept contexts and scores equal plain counting; states outside the cache of the tasks are joined, not lost."""
    monkeypatch.setattr(suffix_tree, "CACHED", cached)
    rng = np.random.default_rng(8)
    vocabulary = [cases.prose(i, 1) for i in range(25)] + ["Über", "ß"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 70)))) for i in range(150)] + [(None, "alone"), (7, ""), (8, None)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    states, want = brute_tree([t for i, t in rows if not held(i)], [t for _, t in rows])
    split = suffix_tree.with_split(cases.docs(spark, rows))
    tree = suffix_tree.fit_tree(split)
    kept = {int(r.context).to_bytes(d, "big") for d in range(suffix_tree.DEPTH + 1) for r in tree.states[d].select("context").collect()}
    assert kept == states and len(states) > 50
    got = suffix_tree.score(cases.docs(spark, rows)).collect()
    left, right = sorted((str(i), s) for (i, _), s in zip(rows, want)), sorted((str(r.doc_id), r.score) for r in got)
    assert [i for i, _ in left] == [i for i, _ in right]
    assert [s for _, s in right] == pytest.approx([s for _, s in left], rel=1e-9)


def test_language_model_edges(spark):
    assert suffix_tree.score(cases.empty(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = suffix_tree.score(cases.docs(spark, [(held, "never trained")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)
    assert row.score == pytest.approx((len("never trained ") + 1) * math.log10(1 / 256))
