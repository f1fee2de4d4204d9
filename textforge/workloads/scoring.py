"""Registered queries: overlap, embedding match and multiple-choice scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.operators.choice import accuracy, macro_average, pick_choices
from textforge.operators.matching import greedy_match, match_corpus
from textforge.operators.rouge import corpus_scores, rouge_lsum, rouge_scores
from textforge.operators.sampling import first_n_per_group
from textforge.workloads.relations import (
    PREDICTIONS,
    documents,
    lcs_sql,
    model_predictions,
    pairs,
    rouge_sql,
    table,
    words_sql,
)

_KEYS = ["conv_id", "turn"]


def _pair_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The reply read as a prediction of the request."""
    return pairs(spark, folder).withColumnsRenamed({"reply": "prediction", "request": "reference"})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _one(spark: SparkSession, folder: str, name: str, sizes, subsequence: bool = False) -> DataFrame:
    scores = rouge_scores(
        _pair_texts(spark, folder), _KEYS, sizes=sizes, subsequence=subsequence, native=not subsequence
    )
    wanted = [f"{name}_p", f"{name}_r", name]
    return _rounded(scores.select(*_KEYS, *wanted), *wanted)


def rouge1(spark: SparkSession, folder: str) -> DataFrame:
    return _one(spark, folder, "rouge1", (1,))


def rouge2(spark: SparkSession, folder: str) -> DataFrame:
    return _one(spark, folder, "rouge2", (2,))


def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return _one(spark, folder, "rougeL", (1,), subsequence=True)


def rouge_line_sums(spark: SparkSession, folder: str) -> DataFrame:
    scores = rouge_lsum(_pair_texts(spark, folder), _KEYS)
    return _rounded(scores, "rougeLsum_p", "rougeLsum_r", "rougeLsum")


def rouge_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of three stand-in models."""
    scores = rouge_scores(model_predictions(spark, folder), [*_KEYS, "model"])
    means = corpus_scores(scores, ["rouge1", "rouge2", "rougeL"], ["model"])
    return _rounded(means, "rouge1", "rouge2", "rougeL")


def _document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference"))
    return docs.select("doc_id", F.col("text").alias("prediction")).join(following, "doc_id")


def rouge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents against the document stored after them, for overlap on long texts."""
    scores = rouge_scores(_document_pairs(spark, folder), ["doc_id"], subsequence=False)
    return _rounded(scores.select("doc_id", "n_pred", "n_ref", "rouge1", "rouge2"), "rouge1", "rouge2")


def rouge_lsum_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs line by line. No SQL: the length tables of all pairs of lines are too many for it."""
    scores = rouge_lsum(_document_pairs(spark, folder), ["doc_id"])
    return _rounded(scores, "rougeLsum_p", "rougeLsum_r", "rougeLsum")


WIDTH = 10  # token embeddings per pseudo-sentence


def _sentence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ten consecutive vectors form a sentence, which is compared with the next one.

    Every vector goes to its own sentence as candidate and to the one before as reference, so one
    shuffle builds both matrices. Each place holds one vector: a sentence never exceeds its ten
    places, whatever the table looks like.
    """
    sentence = F.expr(f"vec_id div {WIDTH}")
    roles = F.array(
        F.struct(sentence.alias("sentence"), F.lit("candidate").alias("role")),
        F.struct((sentence - 1).alias("sentence"), F.lit("reference").alias("role")),
    )
    placed = table(spark, folder, "embeddings").select(
        (F.col("vec_id") % WIDTH).alias("place"), "embedding", F.inline(roles)
    )

    def matrix(role: str):
        here = [(F.col("role") == role) & (F.col("place") == i) for i in range(WIDTH)]
        return F.array_compact(F.array(*[F.max(F.when(h, F.col("embedding"))) for h in here])).alias(role)

    built = placed.groupBy("sentence").agg(matrix("candidate"), matrix("reference"))
    return built.where((F.size("candidate") > 0) & (F.size("reference") > 0))


def greedy_match_score(spark: SparkSession, folder: str) -> DataFrame:
    scores = greedy_match(_sentence_pairs(spark, folder), ["sentence"])
    return _rounded(scores, "bert_precision", "bert_recall", "bert_f1")


def greedy_match_means(spark: SparkSession, folder: str) -> DataFrame:
    means = match_corpus(greedy_match(_sentence_pairs(spark, folder), ["sentence"]))
    return _rounded(means, "bert_precision", "bert_recall", "bert_f1")


def _choices(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored choices of their order's question."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("choice_index"),
        F.col("l_partkey").cast("string").alias("choice_text"),
        (-F.col("l_extendedprice")).alias("loglik"),
    )


def _answered(spark: SparkSession, folder: str, normalise: bool) -> DataFrame:
    """The pick per item joined to subject and gold answer.

    Choices shrink to one row per item before the join, and both sides use the item as key.
    """
    questions = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderpriority").alias("subject"),
        (F.col("o_custkey") % 7 + 1).cast("int").alias("gold_index"),
    )
    return pick_choices(_choices(spark, folder), ["item_id"], normalise).join(questions, "item_id")


def mc_picks(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(spark, folder, False).select("item_id", "pick", "gold_index", "subject")


def mc_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(accuracy(_answered(spark, folder, False), ["subject"]), "accuracy")


def mc_accuracy_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(accuracy(_answered(spark, folder, True), ["subject"]), "accuracy")


def mc_accuracy_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The first 33 items of every subject."""
    limited = first_n_per_group(_answered(spark, folder, False), ["subject"], ["item_id"], 33)
    return _rounded(accuracy(limited, ["subject"]), "accuracy")


def macro_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    by_subject = accuracy(_answered(spark, folder, False), ["subject"])
    macro = macro_average(by_subject, "subject", configured=5 * 33)
    return _rounded(macro, "accuracy")


QUERIES = {
    "rouge1": rouge1,
    "rouge2": rouge2,
    "rouge_l": rouge_l,
    "rouge_lsum": rouge_line_sums,
    "rouge_corpus": rouge_corpus,
    "rouge_documents": rouge_documents,
    "rouge_lsum_documents": rouge_lsum_documents,
    "greedy_match_score": greedy_match_score,
    "greedy_match_corpus": greedy_match_means,
    "mc_picks": mc_picks,
    "mc_accuracy": mc_accuracy,
    "mc_accuracy_norm": mc_accuracy_norm,
    "mc_accuracy_limited": mc_accuracy_limited,
    "macro_accuracy": macro_accuracy,
}

_TEXTS = """texts AS (
  SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS reference
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _score_columns(name: str) -> str:
    return f"conv_id, turn, round(p, 6) AS {name}_p, round(r, 6) AS {name}_r, round(f, 6) AS {name}"


# Every cell of the length table holds the reference positions the walk back from it collects, so
# the last cell is the subsequence; a reference position counts once however often it is covered.
_LINE_UNION = f"""ref_lines AS (
  SELECT conv_id, turn, generate_subscripts(l, 1) AS line, unnest(l) AS t
  FROM (SELECT conv_id, turn, list_filter(string_split(reference, chr(10)), lambda x: x <> '') AS l FROM texts)),
pred_lines AS (
  SELECT conv_id, turn, unnest(list_filter(string_split(prediction, chr(10)), lambda x: x <> '')) AS t FROM texts),
ref_words AS (SELECT conv_id, turn, line, {words_sql('t')} AS a FROM ref_lines),
pred_words AS (SELECT conv_id, turn, {words_sql('t')} AS b FROM pred_lines),
walks AS (
  SELECT conv_id, turn, line, a, list_reduce(
    range(1, len(a) + 1),
    lambda acc, i: list_reduce(
      range(1, len(b) + 1),
      lambda cells, j: list_append(cells, CASE WHEN b[j] = a[i] THEN list_append(acc[j], i)
        WHEN len(cells[j]) > len(acc[j + 1]) THEN cells[j] ELSE acc[j + 1] END),
      [CAST([] AS BIGINT[])]),
    list_transform(range(0, len(b) + 1), lambda z: CAST([] AS BIGINT[])))[-1] AS found
  FROM ref_words JOIN pred_words USING (conv_id, turn)),
covered AS (
  SELECT conv_id, turn, token, count(*) AS n FROM (
    SELECT DISTINCT conv_id, turn, line, i, a[i] AS token
    FROM (SELECT conv_id, turn, line, a, unnest(found) AS i FROM walks)) GROUP BY ALL),
predicted AS (
  SELECT conv_id, turn, token, count(*) AS c FROM (SELECT conv_id, turn, unnest(b) AS token FROM pred_words) GROUP BY ALL),
hits AS (
  SELECT conv_id, turn, sum(least(n, c)) AS h FROM covered JOIN predicted USING (conv_id, turn, token) GROUP BY ALL),
line_sizes AS (
  SELECT conv_id, turn, len({words_sql('prediction')}) AS n, len({words_sql('reference')}) AS m FROM texts),
s_m AS (
  SELECT conv_id, turn, coalesce(h, 0) / greatest(n, 1)::DOUBLE AS p, coalesce(h, 0) / greatest(m, 1)::DOUBLE AS r
  FROM line_sizes LEFT JOIN hits USING (conv_id, turn)),
s AS (SELECT conv_id, turn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM s_m)"""

_MODEL_KEYS = "conv_id, turn, model"
CORPUS_CTES = f"""{PREDICTIONS}, {rouge_sql('predictions', _MODEL_KEYS, 1, 'r1')},
  {rouge_sql('predictions', _MODEL_KEYS, 2, 'r2')}, {lcs_sql('predictions', _MODEL_KEYS, 'rl')},
  per_model AS (
    SELECT model, avg(r1.f) AS rouge1, avg(r2.f) AS rouge2, avg(rl.f) AS rougeL, count(*) AS num_samples
    FROM r1 JOIN r2 USING ({_MODEL_KEYS}) JOIN rl USING ({_MODEL_KEYS}) GROUP BY model)"""

_DOC_TEXTS = """texts AS (
  SELECT a.doc_id, a.text AS prediction, b.text AS reference
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""

_MATCH = """sentences AS (
  SELECT vec_id // 10 AS sentence, vec_id % 10 AS place, embedding::DOUBLE[] AS v FROM embeddings),
close_by AS (
  SELECT a.sentence, a.place AS i, b.place AS j, list_cosine_similarity(a.v, b.v) AS c
  FROM sentences a JOIN sentences b ON b.sentence = a.sentence + 1),
sides AS (
  SELECT sentence, p, r FROM
    (SELECT sentence, avg(c) AS p FROM (SELECT sentence, i, max(c) AS c FROM close_by GROUP BY ALL) GROUP BY sentence)
    JOIN (SELECT sentence, avg(c) AS r FROM (SELECT sentence, j, max(c) AS c FROM close_by GROUP BY ALL) GROUP BY sentence)
    USING (sentence)),
scored AS (
  SELECT sentence, p AS bert_precision, r AS bert_recall, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END AS bert_f1
  FROM sides)"""


def _answers_sql(score: str) -> str:
    return f"""picked AS (
  SELECT l_orderkey AS item_id, l_linenumber AS pick FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {score} DESC, l_linenumber) = 1),
answered AS (
  SELECT item_id, pick, (o_custkey % 7 + 1)::INTEGER AS gold_index, o_orderpriority AS subject
  FROM picked JOIN orders ON o_orderkey = item_id)"""


_PLAIN = _answers_sql("-l_extendedprice")
_NORMALISED = _answers_sql("-l_extendedprice / length(l_partkey::VARCHAR)::DOUBLE")
_BY_SUBJECT = """SELECT subject, round(avg((pick = gold_index)::INTEGER), 6) AS accuracy, count(*) AS samples
  FROM answered GROUP BY subject"""

ORACLES = {
    "rouge1": f"WITH {_TEXTS}, {rouge_sql('texts', 'conv_id, turn', 1, 's')} SELECT {_score_columns('rouge1')} FROM s",
    "rouge2": f"WITH {_TEXTS}, {rouge_sql('texts', 'conv_id, turn', 2, 's')} SELECT {_score_columns('rouge2')} FROM s",
    "rouge_l": f"WITH {_TEXTS}, {lcs_sql('texts', 'conv_id, turn', 's')} SELECT {_score_columns('rougeL')} FROM s",
    "rouge_lsum": f"""WITH {_TEXTS}, {_LINE_UNION} SELECT {_score_columns('rougeLsum')} FROM s""",
    "rouge_corpus": f"""WITH {CORPUS_CTES} SELECT model, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2,
      round(rougeL, 6) AS "rougeL", num_samples FROM per_model""",
    "rouge_documents": f"""WITH {_DOC_TEXTS}, {rouge_sql('texts', 'doc_id', 1, 'r1')}, {rouge_sql('texts', 'doc_id', 2, 'r2')}
      SELECT doc_id, len(r1_g.p)::INTEGER AS n_pred, len(r1_g.r)::INTEGER AS n_ref, round(r1.f, 6) AS rouge1,
        round(r2.f, 6) AS rouge2
      FROM r1 JOIN r2 USING (doc_id) JOIN r1_g USING (doc_id)""",
    "greedy_match_score": f"""WITH {_MATCH} SELECT sentence, round(bert_precision, 6) AS bert_precision,
      round(bert_recall, 6) AS bert_recall, round(bert_f1, 6) AS bert_f1 FROM scored""",
    "greedy_match_corpus": f"""WITH {_MATCH} SELECT round(avg(bert_precision), 6) AS bert_precision,
      round(avg(bert_recall), 6) AS bert_recall, round(avg(bert_f1), 6) AS bert_f1, count(*) AS num_samples FROM scored""",
    "mc_picks": f"WITH {_PLAIN} SELECT item_id, pick, gold_index, subject FROM answered",
    "mc_accuracy": f"WITH {_PLAIN} {_BY_SUBJECT}",
    "mc_accuracy_norm": f"WITH {_NORMALISED} {_BY_SUBJECT}",
    "mc_accuracy_limited": f"""WITH {_PLAIN.replace('answered AS', 'everything AS')}, answered AS (
      SELECT * FROM everything QUALIFY row_number() OVER (PARTITION BY subject ORDER BY item_id) <= 33) {_BY_SUBJECT}""",
    "macro_accuracy": f"""WITH {_PLAIN}, by_subject AS (
        SELECT subject, avg((pick = gold_index)::INTEGER) AS accuracy, count(*) AS samples FROM answered GROUP BY subject)
      SELECT round(avg(accuracy), 6) AS accuracy, sum(samples)::BIGINT AS samples,
        count(DISTINCT subject) AS n_subjects, 165::BIGINT AS configured_samples FROM by_subject""",
}
