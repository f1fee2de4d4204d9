"""Line dedup by its method: content-defined chunks, compared by their bytes, then line by line what chunks leave."""

import random
from collections import Counter

import cases
import pyarrow as pa
from pyspark.sql import functions as F
from test_across import brute_runs
from textforge.llm import lines


def test_chunks_hold_every_pair_once_and_depend_on_content(spark):
    shared = cases.lines_of(60, 40)
    rows = [(i, cases.lines_of(70 + i, 1 + i) + "\n" + shared.replace("\n", "\n \n") + "\n" + cases.lines_of(80 + i, 2)) for i in range(4)]
    rows += [(10, "\n".join([cases.prose(90, 7)] * 200)), (11, "one\n\n"), (12, None), (13, "a\n\nb")]
    found = lines.run_chunks(cases.docs(spark, rows)).collect()
    texts = dict(rows)
    pairs = Counter()
    for c in found:
        whole = texts[c.doc_id].split("\n")[c.line : c.line + c.n_lines]
        assert texts[c.doc_id].encode()[c.start : c.start + c.size].decode() == "\n".join(whole)
        assert len(c.pairs) == sum(bool(cases.words(x)) for x in whole) - 1 <= lines.MAX_LINES
        pairs.update((c.doc_id, p.line, p.n_lines) for p in c.pairs)
    want = Counter()
    for i, t in rows:
        worded = [k for k, x in enumerate((t or "").split("\n")) if cases.words(x)]
        want.update((i, a, b - a + 1) for a, b in zip(worded, worded[1:]))
    assert pairs == want
    # Chunks of the shared passage are the same in all four texts, whatever stands before it.
    everywhere = [h for h, n in Counter((c.h1, c.h2) for c in found if c.doc_id < 4).items() if n == 4]
    assert len(everywhere) >= 3 and len(found) < 0.7 * sum(want.values())


def test_lines_go_only_if_their_bytes_are_the_same(spark):
    """Equal digests are not enough."""
    pieces = [(1, 2, b"a\nb", True), (1, 2, b"a\nb", False), (1, 2, b"a\nc", False), (3, 4, b"d\ne", True), (5, 6, b"f\ng", False)]
    pieces = spark.createDataFrame(pieces, "h1 long, h2 long, piece binary, is_first boolean")
    assert [(r.h1, bytes(r.piece)) for r in lines.same_bytes(pieces).collect()] == [(1, b"a\nb")]


def test_runs_inside_chunks_equal_brute_force(spark):
    """Texts out of few lines: repeated runs begin and end anywhere in a chunk, and overlap."""
    rng = random.Random(5)
    few = [cases.prose(100 + k, 3) for k in range(30)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(few) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, "\n".join(few * 6)), (201, "x\n" + "\n".join(few * 3))]
    got = [tuple(r) for r in lines.drop_repeated_runs(cases.docs(spark, rows), count="gone").select("doc_id", "text", "gone").collect()]
    assert sorted(got) == sorted(brute_runs(rows))


def test_cut_sends_back_slices_of_whole_texts(spark):
    """What a task holds is one slice, not the many texts of a batch; null texts and texts without a list stay."""
    names = {c: c for c in ("doc_id", "text", "n")}
    docs = spark.createDataFrame([], "doc_id long, text string, n int")
    texts = [None if k % 50 == 3 else "\n".join([f"één {k}", "x" * 4000, "end"]) for k in range(2000)]
    spans = [[{"line": 1, "n_lines": 2}, {"line": 2, "n_lines": 1}] if t and k % 2 else None for k, t in enumerate(texts)]
    listed = pa.array(spans, pa.list_(pa.struct([("line", pa.int32()), ("n_lines", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts), pa.array([7] * 2000, pa.int32()), listed], names=[*names, "_tf_removed"])

    class Joined:
        def mapInArrow(self, cut, schema):
            return list(cut(iter([batch])))

    out = lines._take_out(Joined(), docs, names, "text", "gone")
    assert max(b.nbytes for b in out) < 1.1 * lines.tb.SLICE_BYTES
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(k, f"één {k}" if s else t, 7, 2 if s else 0) for k, (t, s) in enumerate(zip(texts, spans))]


def test_only_texts_with_a_find_pass_python(spark):
    shared = cases.lines_of(300, 3)
    rows = [(1, shared), (2, "a b\n" + shared), (6, "c d\n" + shared), (3, cases.lines_of(301, 5)), (4, None), (None, ""), (None, "a b\nc d")]
    docs = cases.docs(spark, rows).withColumn("more", F.lit(5)).withColumn("gone", F.lit("old"))
    for count in ("gone", None):
        found = lines.drop_repeated_runs(docs, count=count)
        assert found.columns == ([c for c in docs.columns if c != "gone"] + ["gone"] if count else docs.columns)
        assert sorted(tuple(r) for r in found.select("doc_id", "text").fillna("null").fillna(-1).collect()) == sorted(
            (-1 if i is None else i, "null" if t is None else t) for i, t, _ in brute_runs(rows)
        )
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and sorted("MapInArrow" in plan.children().apply(k).toString() for k in range(2)) == [False, True]
