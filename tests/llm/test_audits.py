"""Divergence audit, filter audit and spot signatures against brute force on tables of edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

import cases
from textforge.llm import divergence, filter_audit, spotsigs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_with_terms():
    rng = random.Random(5)
    words = ["Aa", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "Ünder", "日本", "zz", "b"]
    texts = [" ".join(rng.choices(words, range(10, 0, -1), k=rng.randint(0, 40))) for _ in range(60)]
    keys = [("en", "s"), ("en", "t"), ("en", None), (None, "s"), ("", ""), ("fr", "only"), ("xx", "none")]
    out = [(i, t, *keys[i % 5 if i % 3 else 0]) for i, t in enumerate(texts)]
    return out + [(7, texts[7], "en", "t"), (None, texts[8], "en", "u"), (61, None, "xx", "none"), (62, "12 34", "xx", "more"), (63, "b b", "fr", "only")]


def brute_divergence(rows):
    docs = [((lang or ""), (source or ""), [w.translate(LOWER) for w in TERM.findall(text or "")]) for _, text, lang, source in rows]
    found = set()
    for lang in {d[0] for d in docs}:
        seen, every, own = Counter(), Counter(), defaultdict(Counter)
        for lang_, source, terms in docs:
            if lang_ == lang:
                seen.update(set(terms))
                own[source].update(terms)
        kept = [t for t, n in seen.items() if n >= 3]
        for source in own:
            every.update(own[source])

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept))

        for a in own:
            pairs = [(b, sum((p(own[a], t) - p(own[b], t)) ** 2 // p(own[b], t) for t in kept)) for b in own if b != a]
            terms = [(t, (p(own[a], t) - p(every, t)) ** 2 // p(every, t)) for t in kept if own[a][t] and p(own[a], t) > p(every, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    found.add((lang, a, part, item, value, rank))
    return found


def test_divergence(spark):
    rows = rows_with_terms()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1L as n", "'x' as term", "'y' as gid")
    got = divergence.audit(docs.repartition(3)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_divergence(rows)
    assert divergence.audit(docs.limit(0)).collect() == []
    every_null = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert divergence.audit(every_null).collect() == []


def test_divergence_of_edge_texts(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in cases.docs(spark).collect()]
    assert {tuple(r) for r in divergence.audit(cases.docs(spark)).collect()} == brute_divergence(rows)


def test_pointer_sort_orders_terms_and_numbers_runs():
    rng = random.Random(3)
    terms = [bytes(rng.choices(b"ab\xc3", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3000)]
    terms += [t + b"a" for t in terms[:200]]
    data = np.frombuffer(b" ".join(terms), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    starts = ends - [len(t) for t in terms]
    order, run = divergence.pointer_sort(data, starts, ends)
    ordered = [terms[i] for i in order]
    assert ordered == sorted(terms)
    assert [run[i] != run[i - 1] for i in range(1, len(run))] == [a != b for a, b in zip(ordered, ordered[1:])]


def test_share_does_not_overflow(spark):
    cases_ = [(0, 1), (5, 6), (8 * 10**15, 8 * 10**15 + 1), (3, 7 * 10**15), (10**12, 3 * 10**12 + 7)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(cases_, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in got)


def brute_filters(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    texts = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""].append(i)
    parts = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        w = cases.words(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and min(texts[text]) < i,
        }
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                shapley[f] += len(gone)
                alone = sum(d[0] == {f} for d in docs)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


def test_filter_audit(spark):
    docs = cases.docs(spark)
    more = [(3, "A B C# " * 50, "fr"), (40, cases.prose(1, 300), "fr"), (41, "ÀÉ Ab", None), (None, "", ""), (40, cases.prose(1, 300), "fr"), (None, None, "fr")]
    rows = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    rows = rows.selectExpr("*", "'x' as mask", "1 as good", "2 as digest")
    labels = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, 0), (40, 1, 0), (None, 1, 1), (20, 0, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(rows, table).collect()
    want = brute_filters([(r.doc_id, r.text, r.lang) for r in rows.collect()], labels)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert filter_audit.audit(rows.limit(0), table).collect() == []
    assert {r.good_lost for r in filter_audit.audit(rows, table.limit(0)).collect()} == {0}


def test_gray_walk_visits_every_set():
    rng = np.random.default_rng(1)
    masks, counts = np.arange(32), rng.integers(0, 50, (32, 3))
    states = filter_audit.gray_walk(masks, counts)
    for chosen in range(32):
        assert (states[chosen] == counts[(masks & chosen) == 0].sum(axis=0)).all()


def spots(text):
    w = re.findall(r"[^\W_]+", text.lower())
    found = set()
    for i, word in enumerate(w):
        if word in spotsigs.ANCHORS:
            content = [x for x in w[i + 1 : i + 1 + spotsigs.LOOK] if x not in spotsigs.COMMON][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                found.add(" ".join([word, *content]))
    return {hashlib.md5(x.encode()).hexdigest()[: spotsigs.DIGITS] for x in found or {text}}


def anchored(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "a", "is", "die", *(f"w{rng.randint(0, 9999)}é" for _ in range(9))]) for _ in range(n))


def test_fingerprint_edits(spark):
    extra = [(50 + i, anchored(i, 30 * i), "en", "s", 1) for i in range(8)] + [(70, "the " * 9000 + "end word", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = cases.docs(spark)
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    docs = docs.selectExpr("*", "'k' as key", "'g' as given", "'a' as after", "3 as rank")
    got = spotsigs.fingerprint_edits(docs.repartition(5)).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)

    def digest(i, text):
        return hashlib.md5(f"{'null' if i is None else i}:{text}".encode()).hexdigest()

    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), digest(*r)))
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = spots(text), spots(edited), spots(after)
        want[i, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), len(a & b) / len(a | b), len(a & c) / len(a | c))
    texts = defaultdict(set)
    for i, text in rows:
        texts[i].add(text)
    expected = Counter((i, *want[i, t]) for i, t in rows)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == expected
    assert spotsigs.fingerprint_edits(docs.limit(0)).collect() == []
    alone = spotsigs.fingerprint_edits(docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    plan = spotsigs.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("like", [0.8, 0.5])
def test_near_pairs(spark, like):
    rng = random.Random(4)
    base = [[f"{rng.randrange(16**10):010x}" for _ in range(n)] for n in (1, 2, 5, 9, 10, 11, 30, 40)]
    sets = {tuple(sorted(b)) for b in base}
    for b in base:
        for _ in range(12):
            changed = [x for x in b if rng.random() > 0.15] + [f"{rng.randrange(40):010x}" for _ in range(rng.randint(0, 3))]
            if changed:
                sets.add(tuple(sorted(set(changed))))
    prints = spark.createDataFrame([("".join(s),) for s in [*sets, *list(sets)[:9]]], "fingerprint string")
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(prints, like).collect()}
    want = {}
    for a in sets:
        for b in sets:
            alike = len({*a} & {*b}) / len({*a} | {*b})
            if (len(a), "".join(a)) < (len(b), "".join(b)) and alike >= like:
                want["".join(a), "".join(b)] = alike
    assert got == want and len(want) > 20
