"""Tables whose other columns have the names that operators use themselves keep them as they are."""

import pytest

import cases
from textforge.llm import lines, near, quality, suffixes

STAGES = {
    "quality": quality.filter_quality,
    "lines": lines.drop_repeated_runs,
    "jaccard": near.keep_one,
    "suffixes": suffixes.cut_repeats,
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_clashing_names_pass_through(spark, name):
    docs = cases.docs(spark)
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    got, plain = out.collect(), STAGES[name](docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, got)) == sorted(map(key, plain)) and got
    assert all(r["_tf_id"] == r["_TF_h"] == r["in__tf_id"] == r["high_symbols"] == r["LOW_x"] == "x" for r in got)


def test_id_and_text_may_have_such_names_too(spark):
    shared = cases.prose(1, 120)
    docs = spark.createDataFrame([(1, shared), (2, "before " + shared), (None, None)], "_tf_id long, _tf_spans string")
    got = {r["_tf_id"]: r["_tf_spans"] for r in suffixes.cut_repeats(docs, "_tf_id", "_tf_spans").collect()}
    assert got == {1: "", 2: "before ", None: None}
