"""Operators that compare texts, vectors and events: line dedup, Jaccard join, suffix dedup, search, chat."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import cases
from textforge.llm import bytes as tb
from textforge.llm import chatlog, components, lines, near, nearest, suffixes


@pytest.fixture(scope="module")
def edge(spark):
    return cases.docs(spark)


# -- suffix dedup ----------------------------------------------------------------------------


def brute_repeats(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(x[k : k + length] for _, x in texts for k in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if times[x[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages():
    """Shared passages with other surroundings, of lengths around the limit, and edits inside copies."""
    long = cases.prose(50, 400)
    rows = [(i, cases.prose(60 + i, 20 + i) + long[i * 30 : i * 30 + 380 + 7 * i] + cases.prose(90 + i, 15)) for i in range(12)]
    edited = list(cases.prose(51, 500))
    rows.append((100, "".join(edited)))
    for at in (450, 900, 1301, 1702, 2104):
        edited[at] = "#"
    return rows + [(101, "".join(edited)), (102, long[:399]), (103, long[:400]), (104, "x" + long[:400] + "y"), (105, cases.prose(120, 90))]


@pytest.mark.parametrize("which", ["edges", "passages"])
def test_suffix_dedup(spark, which):
    rows = cases.edge_texts() if which == "edges" else passages()
    found = suffixes.digest_repeats(cases.docs(spark, rows)).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute_repeats(rows)
    # Anchors shared with other texts: some if 256 bytes are shared, none if 128 are not.
    own = [(i, t or "") for i, t in rows]
    most, least = shared_with_others(own, suffixes.SHORTER), shared_with_others(own, suffixes.GRAM)
    sizes = defaultdict(list)
    for r in found:
        sizes[r.doc_id, r.n_bytes].append(r.n_shared)
    for row in own:
        counts = sizes[row[0], len(row[1].encode())]
        assert row not in most or max(counts) > 0
        assert row in least or min(counts) == 0
    assert most and set(own) - least


def shared_with_others(rows, length):
    """Rows that have a string of ``length`` bytes in common with a row of another id or text."""
    where = defaultdict(set)
    for i, t in rows:
        x = t.encode()
        for k in range(len(x) - length + 1):
            where[x[k : k + length]].add((i, t))
    return {row for owners in where.values() if len(owners) > 1 for row in owners}


def test_suffix_dedup_cuts_whole_characters(spark, edge):
    cut = suffixes.cut_repeats(edge)
    assert cut.schema == edge.schema and cut.count() == len(cases.edge_texts())
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[4] is None
    # Every string of 400 bytes inside the 1,400 of "é" but the last repeats; the bytes of "ß" stay.
    assert texts[10] == "ß" * 3
    assert suffixes.digest_repeats(cases.empty(spark)).collect() == [] and suffixes.cut_repeats(cases.empty(spark)).collect() == []


# -- line dedup ------------------------------------------------------------------------------


def brute_lines(rows):
    def chunks(text):
        parts = text.encode().split(b"\n")
        hashes = [tb.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in parts]
        out, current = [], []
        for j in range(len(parts)):
            current.append(j)
            before = hashes[j - 1] if j else np.zeros(1, np.uint64)
            if int(tb.pair(before, hashes[j])[0]) % lines.MEAN_LINES == 0 or len(current) == lines.MAX_LINES:
                out.append(current)
                current = []
        return parts, out + [current] * bool(current)

    first = {}
    whole = {}
    for i, t in rows:
        parts, found = chunks(t or "")
        whole[i] = (parts, found)
        for c in found:
            if sum(bool(parts[k].split()) for k in c) >= lines.MIN_LINES:
                key = b"\n".join(parts[k] for k in c)
                first[key] = min(first.get(key, (i, c[0])), (i, c[0]))
    out = {}
    for i, (parts, found) in whole.items():
        kept = [k for c in found for k in c if first.get(b"\n".join(parts[k] for k in c), (i, c[0])) == (i, c[0]) or sum(bool(parts[k].split()) for k in c) < lines.MIN_LINES]
        out[i] = b"\n".join(parts[k] for k in kept).decode()
    return out


def test_line_dedup(spark):
    shared = cases.lines_of(5, 40)
    rows = [(i, cases.lines_of(20 + i, i % 7) + "\n" + shared + "\n" + cases.lines_of(40 + i, 3)) for i in range(8)]
    rows += [(50, shared), (51, shared + "\n" + shared), (52, "\n\n\n"), (53, None), (54, ""), (55, cases.lines_of(7, 200))]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(cases.docs(spark, rows), count="gone").collect()}
    want = brute_lines(rows)
    assert got.pop(53) is None
    want.pop(53)
    assert got == want
    assert sum(len(t) for t in got.values()) < 0.6 * sum(len(t or "") for _, t in rows)


def test_line_dedup_edges(spark, edge):
    out = lines.drop_repeated_lines(edge)
    assert out.schema == edge.schema and out.count() == len(cases.edge_texts())
    assert Counter(r.text for r in out.where("doc_id = 20").collect())[cases.prose(16, 100)] == 2
    assert lines.drop_repeated_lines(cases.empty(spark)).collect() == []


def brute_runs(rows):
    """Every two neighbouring worded lines that occur again go but for their first place."""
    pairs, cut = {}, {}
    for n, (i, t) in enumerate(rows):
        cut[n] = (t or "").split("\n")
        worded = [k for k, x in enumerate(cut[n]) if cases.words(x)]
        for a, b in zip(worded, worded[1:]):
            pairs.setdefault("\n".join(cut[n][a : b + 1]), []).append((i, n, a, b))
    again, stay = set(), set()
    for places in pairs.values():
        places.sort()
        for k, (_, n, a, b) in enumerate(places):
            if len(places) > 1:
                (again if k else stay).update((n, j) for j in range(a, b + 1))
    gone = again - stay
    return [(i, None if t is None else "\n".join(x for j, x in enumerate(cut[n]) if (n, j) not in gone), sum(m == n for m, _ in gone)) for n, (i, t) in enumerate(rows)]


def test_line_dedup_takes_whole_runs(spark):
    """Short passages inside other texts, blank lines, runs of one line: all that brute force finds goes."""
    rows = []
    for g in range(8):  # passages of 2 to 6 lines, each in three texts
        shared = cases.lines_of(500 + g, 2 + g % 5).replace("\n", "\n\n" if g % 3 == 0 else "\n")
        rows += [(10 * g + k, cases.lines_of(600 + 3 * g + k, 3 + k) + "\n" + shared + "\n" + cases.lines_of(700 + 3 * g + k, 4)) for k in range(3)]
    alone = cases.prose(900, 7)
    rows += [(200, "\n".join([alone] * 40)), (201, "head\n" + "\n".join([alone] * 6) + "\ntail"), (202, alone)]
    chain = cases.lines_of(901, 5).split("\n")
    rows += [(210, "\n".join(chain[:3])), (211, "\n".join(chain)), (212, "\n".join(chain[2:]))]
    rows += [(220, None), (221, ""), (222, "\n\n"), (223, " \nword\n"), (224, "\r\n".join(chain))]
    got = [tuple(r) for r in lines.drop_repeated_runs(cases.docs(spark, rows), count="gone").select("doc_id", "text", "gone").collect()]
    want = brute_runs(rows)
    assert sorted(got, key=lambda r: r[0]) == want
    texts = {i: t for i, t, _ in got}
    before = dict(rows)
    for g in range(8):
        head, tail = cases.lines_of(600 + 3 * g + 2, 5), cases.lines_of(700 + 3 * g + 2, 4)
        assert texts[10 * g] == before[10 * g] and texts[10 * g + 2] == head + "\n" + tail
    assert texts[200] == alone + "\n" + alone and texts[201] == "head\ntail" and texts[202] == alone
    # What a repeated pair is first in stays whole.
    assert texts[211] == "\n".join(chain[2:]) and texts[212] == ""


def test_line_dedup_runs_edges(spark, edge):
    out = lines.drop_repeated_runs(edge)
    assert out.schema == edge.schema and out.count() == len(cases.edge_texts())
    assert Counter(r.text for r in out.where("doc_id = 20").collect())[cases.prose(16, 100)] == 2
    twice = [(1, cases.lines_of(5, 6))] * 2 + [(None, cases.lines_of(6, 4)), (None, cases.lines_of(6, 4) + "\nmore")]
    got = Counter(r.n for r in lines.drop_repeated_runs(cases.docs(spark, twice).drop("n"), count="n").collect())
    assert got == Counter({0: 3, 4: 1})
    assert lines.drop_repeated_runs(cases.empty(spark)).collect() == []


# -- Jaccard join ----------------------------------------------------------------------------


def brute_links(rows):
    sets = []
    for i, t in rows:
        found = cases.words(t)
        sets.append({tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set())
    similar = [[k for k in range(len(sets)) if k != j and sets[j] and sets[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])] for j in range(len(sets))]
    group = list(range(len(rows)))
    for _ in rows:
        for j, others in enumerate(similar):
            for k in others:
                group[j] = group[k] = min(group[j], group[k])
    return similar, group


def copies():
    """Texts with a growing number of edits: links on both sides of the threshold."""
    rows = list(cases.edge_texts())
    for g in range(6):
        base = cases.prose(300 + g, 150).split()
        for e in range(12):
            changed = list(base)
            for k in range(e):
                changed[(k * 37 + e) % 150] = f"edit{g}{e}{k}"
            rows.append((1000 + 20 * g + e, " ".join(changed)))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_TEXTS", block)
    rows = copies()
    similar, group = brute_links(rows)
    got = near.near_duplicates(cases.docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, len(s)) for (i, _), s in zip(rows, similar))
    members = defaultdict(set)
    for r in got:
        if r.doc_id not in (None, 20):
            members[r.class_id].add(r.doc_id)
    want = defaultdict(set)
    for (i, _), g in zip(rows, group):
        if i not in (None, 20):
            want[g].add(i)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(m) for c, m in members.items())


def test_keep_one(spark):
    rows = [r for r in copies() if r[0] not in (None, 20)]
    _, group = brute_links(rows)
    kept = near.keep_one(cases.docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[g][0] for g in set(group))
    assert near.keep_one(cases.empty(spark)).collect() == [] and near.near_duplicates(cases.empty(spark)).collect() == []


def test_keep_one_by_group_not_by_id(spark):
    """Unrelated documents with null or repeated ids stay; one of each group of similar ones stays."""
    rows = list(dict.fromkeys(copies()))
    _, group = brute_links(rows)
    of = {r: g for r, g in zip(rows, group)}
    got = [(r.doc_id, r.text) for r in near.keep_one(cases.docs(spark, rows)).collect()]
    assert sorted(of[r] for r in got) == sorted(set(group))
    found = near.near_duplicates(cases.docs(spark, rows)).where("n_runs > 0")
    sizes = sorted(r["count"] for r in found.groupBy("set_id").count().collect())
    assert sizes == sorted(n for g, n in Counter(group).items() if cases.words(rows[g][1]))
    alone = [(None, cases.prose(700 + k, 60)) for k in range(9)] + [(3, cases.prose(720 + k, 60)) for k in range(4)]
    assert near.keep_one(cases.docs(spark, alone)).count() == 13
    # A group takes its id from a member that has one.
    both = near.near_duplicates(cases.docs(spark, [(None, alone[0][1]), (5, alone[0][1])])).collect()
    assert [r.class_id for r in both] == [5, 5]


def test_repeated_rows_reach_packing_once(spark):
    """A document that was loaded twice goes on as one row, with its whole text."""
    import corpus_pipeline

    rows = [(i, cases.prose(800 + i, 90 + i)) for i in range(1, 7)]
    for many in (2, 5):
        docs = cases.docs(spark, rows + [rows[2]] * (many - 1) + [(None, rows[4][1])] * many)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
        assert sorted(tuple(r) for r in docs.select("doc_id", "text").collect()) == rows
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert sorted(r.doc_id for r in packed.collect()) == [i for i, _ in rows]
    blank = [(1, ""), (1, ""), (2, None), (2, None), (2, " ")]
    kept = [(r.doc_id, r.text) for r in near.keep_one(cases.docs(spark, blank)).collect()]
    assert Counter(kept) == Counter(set(blank))


def test_least_matches_is_the_posterior():
    """The least number of matches agrees with the posterior integrated numerically."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    least = near.least_matches(0.8, 1e-3)
    for step in (2, 10, 23):
        n = near.ROWS * (step + 1)
        for m in (least[step] - 1, least[step]):
            if m >= 0:
                density = grid**m * (1 - grid) ** (n - m)
                chance = density[grid >= 0.8].sum() / density.sum()
                assert (chance >= 1e-3) == (m >= least[step])


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- nearest neighbours ----------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 24))) * rng.uniform(0.5, 2, (1500, 1))
    x[200:500] = x[199]  # one vector that is everywhere
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [None] + [1.0] * 23), (5080, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += [(i, v, 1, 2, "x") for i, v in bad] + [rows[40], rows[41]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h int, block int, ids string")
    got = nearest.search(df, lambda i: i % 20 == 0).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        score = x @ x[q]
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert np.allclose([r.score for r in found], score[[r.vec_id for r in found]], rtol=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in found})
    assert hits >= 0.95 * 20 * len(by)


def test_search_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert nearest.search(df.limit(0), lambda i: i % 20 == 0).collect() == []
    with pytest.raises(ValueError):
        nearest.search(df.union(spark.createDataFrame([(9, [1.0])], df.schema)), lambda i: i % 20 == 0)


def test_search_breaks_ties_by_id(spark):
    """Vectors of few small whole numbers: most scores tie, so the ids decide."""
    rng = np.random.default_rng(11)
    vectors = rng.integers(-2, 3, (3000, 6)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in range(0, 3000, 20) if vectors[i].any()]
    assert sorted(got) == asked
    for i in asked:
        score = vectors @ vectors[i]
        order = [j for j in np.lexsort((np.arange(3000), -score)) if j != i and vectors[j].any()][:20]
        assert sorted(got[i]) == [(n, j, score[j]) for n, j in enumerate(order, 1)]


def test_best_entries_keep_every_tie_until_ids_are_compared():
    rng = np.random.default_rng(2)
    x, queries, ids = rng.integers(0, 2, (500, 8)).astype(float), rng.integers(0, 2, (40, 8)).astype(float), rng.permutation(500)
    for most in (1, 7, 500):
        row, col, score = nearest.best_entries(queries, x, ids, most)
        for q in range(40):
            want = np.lexsort((ids, -(x @ queries[q])))[:most]
            assert (col[row == q] == want).all() and (score[row == q] == x[want] @ queries[q]).all()


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(500, 16))
    points = rng.normal(size=(200, 16))
    ids, dist = nearest.CentroidGraph.build(centres).search(points, 8)
    exact = ((points[:, None] - centres[None]) ** 2).sum(2)
    want = np.argsort(exact, axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, want)]) > 0.95
    assert np.allclose(dist, np.take_along_axis(exact, ids, 1)) and (np.diff(dist, axis=1) >= 0).all()


def test_queries_visit_a_share_of_all_lists():
    """Isotropic vectors: with ten times the lists, a query visits more of them, the nearest first."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.normal(size=(n, 32)))
    asked = unit(30)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(30)), pa.array(range(30)), pa.array(asked.tolist(), pa.list_(pa.float64()))], names=["first_id", "h", "v"]
    )
    for n in (200, 2000):
        centres = nearest._lifted(0.5 * unit(n), 1.0)
        routed = pa.Table.from_batches(nearest._route(nearest.CentroidGraph.build(centres), 1.0)([batch]))
        visits = Counter(routed["first_id"].to_pylist())
        assert sorted(visits) == list(range(30)) and min(visits.values()) >= n // nearest.LIST_SHARE
        mine = {x for x, q in zip(routed["list"].to_pylist(), routed["first_id"].to_pylist()) if q == 0}
        if n == 2000:
            exact = np.argsort(((np.append(asked[0], 0.0) - centres) ** 2).sum(1))
            assert mine == set(exact[: len(mine)].tolist())


# -- chat ------------------------------------------------------------------------------------

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, head string"


def test_fold(spark):
    log = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, "delta", "user", "lo"),
        (1, 3, 2, "delta", "assistant", "bad "), (1, 4, 2, "delta", "assistant", "reply"),
        (1, 5, 2, "regenerate", "assistant", ""), (1, 6, 2, "delta", "assistant", "good"),
        (1, 7, 3, "delta", "user", "more"), (1, 8, 4, "delta", "assistant", "lost"),
        (1, 9, 3, "edit", "user", "other"), (1, 10, 4, "delta", "assistant", None), (1, 11, 4, "delta", "assistant", "end"),
        (2, 1, 1, "delta", None, "no role"), (None, 1, 1, "delta", "user", "null id"),
        (3, 2, 1, "delta", "user", "b"), (3, 1, 1, "delta", "user", "a"),
    ]
    events = spark.createDataFrame([(*r, "x") for r in log], EVENTS)
    got = [tuple(r) for r in chatlog.fold_events(events).orderBy("conv_id", "turn").collect()]
    assert got == [
        (None, 1, "user", "null id"),
        (1, 1, "user", "Hello"), (1, 2, "assistant", "good"), (1, 3, "user", "other"), (1, 4, "assistant", "end"),
        (2, 1, "", "no role"), (3, 1, "user", "ab"),
    ]
    with pytest.raises(Exception, match="unknown event kind"):
        chatlog.fold_events(spark.createDataFrame([(1, 1, 1, "odd", "user", "x", "x")], EVENTS)).collect()
    assert chatlog.digest(chatlog.format_log(events.limit(0))).collect() == []


NASTY = [
    "", " ", None, "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "<\\s>", "<\\/s>", "<", "</", "</s", "[", "<<s>>", "</s></s>",
    "<s>user\nhi</s>", "a\nb", "\n", "\\n", "[\\INST]", "\\</s>\\", "é\U0001f600</s>é", "x" * 5000 + "</s>",
]


def test_any_text_survives(spark):
    rows = [(c, t, "assistant" if t % 2 else ("user" if c % 3 else "us\ner\\</s>"), NASTY[(c * 7 + t) % len(NASTY)], "x") for c in range(25) for t in range(4)]
    rows += [(7, 3, "assistant", "tie", "x"), (7, 3, "user", "tie", "x"), (8, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    formatted = chatlog.format_log(chatlog.events_from_rows(df))
    got = {r.conv_id: r for r in chatlog.digest(formatted).collect()}
    groups = defaultdict(list)
    for c, t, role, text, _ in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(turns), digest, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        assert r.formatted.count("</s>") == len(groups[r.conv_id]) and len(r.formatted) == got[r.conv_id].formatted_chars


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chatlog.digest(chatlog.format_log(chatlog.events_from_rows(df)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
