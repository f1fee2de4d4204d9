"""The whole pipeline against a version of it in plain Python on a small table."""

import math
from collections import Counter, defaultdict

import cases
import corpus_pipeline
from test_across import brute_links, brute_runs
from test_rowwise import brute_counts
from textforge.llm import quality


def brute_quality(rows):
    """Texts that the base rule or the fences reject go. The table is small, so all texts share one sketch of each rule."""
    measured = []
    for i, t in rows:
        counts = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), brute_counts(t)))
        measured.append(counts | {"n_lines": sum(bool(cases.words(x)) for x in (t or "").split("\n"))})
    worded = [m for m in measured if m["n_words"]]
    assert len(worded) < quality.MIN_GROUP
    kept = [m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] for m in measured]
    for rule in quality.RULES:
        of = lambda m: m[rule.numerator] / max(m[rule.denominator], 1)  # noqa: E731, B023
        # The upper end of the geometric bin of each value, in order.
        ends = sorted(0.0 if of(m) * 1e6 < 1 else 1.05 ** math.ceil(math.log(of(m) * 1e6) / math.log(1.05)) / 1e6 for m in worded)
        low, middle, high = (ends[math.ceil(q * len(ends)) - 1] for q in (0.1, 0.5, 0.9))
        most = high + max(rule.slack, 3 * (high - middle))
        least = low - max(rule.slack, 3 * (middle - low)) if rule.two_sided else -math.inf
        kept = [k and least <= of(m) <= most for k, m in zip(kept, measured)]
    return [r for r, k in zip(rows, kept) if k]


def brute_cut(rows, length):
    """Bytes inside a string of ``length`` bytes that starts twice or more go; a character stays if a byte of it does."""
    texts = [t.encode() for _, t in rows]
    times = Counter(x[k : k + length] for x in texts for k in range(len(x) - length + 1))
    out = []
    for (i, t), x in zip(rows, texts):
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if times[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        at, kept = 0, []
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        out.append((i, "".join(kept)))
    return out


def corpus():
    """Every stage finds something: junk, shared lines, copies, near copies, shared passages, emptied texts."""
    rows = [(i, cases.lines_of(2000 + i, 4 + i % 9)) for i in range(24)]
    shared = [cases.lines_of(3000 + g, 2 + g) for g in range(4)]
    rows += [(100 + 10 * g + k, cases.lines_of(3100 + 10 * g + k, 3) + "\n" + shared[g] + "\n" + cases.lines_of(3200 + 10 * g + k, 2 + k)) for g in range(4) for k in range(3)]
    rows += [(150 + k, cases.lines_of(3300, 7)) for k in range(3)]  # two of three are emptied line by line
    one = cases.prose(3400, 160)
    changed = one.split()
    changed[80] = "other"
    rows += [(200, one), (201, one), (202, " ".join(changed)), (203, one + " tail")]
    passage = "é" + cases.prose(3500, 48) + "ß"
    rows += [(300 + k, cases.prose(3600 + k, 70 + k) + passage + cases.prose(3700 + k, 60)) for k in range(4)]
    short = cases.prose(3800, 30)[:150]
    rows += [(310 + k, cases.prose(3900 + k, 50) + short + cases.prose(4000 + k, 40)) for k in range(3)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "five words are too few"), (404, "same words again and more " * 12)]
    rows += [(405, " # ".join(cases.prose(4100, 40).split())), (406, "日本語 テキスト " + cases.prose(4101, 30))]
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    good = brute_quality(rows)
    assert {i for i, _ in rows} - {i for i, _ in good} == {400, 401, 402, 403, 404, 405}
    lined = [(i, t) for i, t, _ in brute_runs(good)]
    worded = [r for r in lined if cases.words(r[1])]
    assert len(lined) - len(worded) == 2 and lined != good
    _, group = brute_links(worded)
    single = [worded[g] for g in sorted(set(group))]
    assert {i for i, _ in worded} - {i for i, _ in single} == {201, 202, 203}
    cut = [r for r in brute_cut(single, corpus_pipeline.PASSAGE) if cases.words(r[1])]
    assert [i for i, t in cut if (i, t) not in single] == [300, 301, 302, 303]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, (good, lined, single, cut)):
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test-stage")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == Counter((i, len(cases.words(t)) + 1) for i, t in cut)
    buckets = defaultdict(list)
    for r in packed:
        buckets[r.bucket].append(r)
    for members in buckets.values():
        assert {r.padded_tokens for r in members} == {max(r.n_tokens for r in members)}
