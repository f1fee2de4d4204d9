"""Registered queries: tokens, labels, batches, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.operators.batching import pad_batches
from textforge.operators.chat import messages_per_model, reference_column, with_registry, with_training_text
from textforge.operators.epochs import PRIME, epoch_batches, round_keys
from textforge.operators.ordering import number_rows
from textforge.operators.sampling import extremes
from textforge.operators.tokens import (
    SPECIAL_TOKENS,
    TOKEN_PATTERN,
    count_tokens,
    label_summary,
    label_texts,
    token_breakdown,
    token_statistics,
    tokenize_native,
    vocabulary_report,
    vocabulary_sizes,
)
from textforge.operators.validity import filter_valid
from textforge.operators.vocabulary import build_vocabulary, decode_vocabulary, encode_vocabulary
from textforge.options import FieldMap, PrepOptions
from textforge.plans.prepare import prepare_splits, training_batches, training_tokens
from textforge.registry import get_model
from textforge.session import materialise
from textforge.workloads.relations import (
    ANSWER,
    DEFAULT_SYSTEM,
    MERGED,
    PAIR_SAMPLES,
    RAW,
    SYSTEM,
    TRAINING_TEXT,
    USER,
    block,
    documents,
    raw_samples,
    sample_pairs,
)


def _pair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rendered = with_training_text(sample_pairs(spark, folder), get_model("qwen"))
    return tokenize_native(rendered.select("sample_id", "text_prompt", "text_full"))


def _document_tokens(spark: SparkSession, folder: str, max_length: int | None = None) -> DataFrame:
    samples = filter_valid(raw_samples(spark, folder, heavy=True))
    rendered = with_training_text(samples, get_model("qwen"))
    return tokenize_native(rendered.select("sample_id", "split", "text_prompt", "text_full"), max_length=max_length)


def _document_counts(spark: SparkSession, folder: str, max_length: int | None = None) -> DataFrame:
    samples = filter_valid(raw_samples(spark, folder, heavy=True))
    rendered = with_training_text(samples, get_model("qwen"))
    return count_tokens(rendered.select("sample_id", "split", "text_prompt", "text_full"), max_length=max_length)


def tokenize_words(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_tokens(spark, folder).select(
        "sample_id",
        F.size("tokens").alias("n_tokens"),
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"),
    )


def mask_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_tokens(spark, folder).select(
        "sample_id", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels")
    )


def mapped_training_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of prepared training rows whose input is the title and whose output the list."""
    options = PrepOptions("documents", base_model="Qwen/x", max_length=None, fields=FieldMap(input="title", output="ingredients"))
    train = prepare_splits(raw_samples(spark, folder), options).train
    return training_tokens(train, options).select("sample_id", F.size("input_ids").alias("n_tokens"))


def tokenize_truncated(spark: SparkSession, folder: str) -> DataFrame:
    summed = label_summary(_document_counts(spark, folder, 512), ["sample_id"])
    return summed.select("sample_id", "n_tokens", "n_masked", "n_training")


def breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return token_breakdown(_pair_tokens(spark, folder), ["sample_id"])


def breakdown_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return token_breakdown(_pair_tokens(spark, folder), ["sample_id"], max_rows=50)


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return label_summary(_document_counts(spark, folder), ["sample_id"]).select(
        "sample_id",
        "n_tokens",
        "n_masked",
        "n_training",
        F.round("pct_masked", 6).alias("pct_masked"),
        F.round("pct_training", 6).alias("pct_training"),
    )


def masked_and_trained_text(spark: SparkSession, folder: str) -> DataFrame:
    return label_texts(_pair_tokens(spark, folder), ["sample_id"], length=500)


def _stats(tokens: DataFrame, group: str) -> DataFrame:
    stats = token_statistics(tokens, group)
    rounded = {"avg_length", "avg_masked_tokens", "avg_training_tokens", "avg_masked_ratio"}
    return stats.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in stats.columns])


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(_document_counts(spark, folder), "split")


def token_stats_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """The same samples prepared for every registered model, side by side."""
    each = with_training_text(with_registry(sample_pairs(spark, folder)))
    keyed = each.select(F.col("model.model_key").alias("model"), "text_prompt", "text_full")
    return _stats(count_tokens(keyed), "model")


def make_chunk_encoder():
    """A stand-in tokeniser: every three characters are a token, whose id is the code of its first one."""

    def encode(texts):
        starts = [range(0, len(t), 3) for t in texts]
        return [([ord(t[i]) for i in at], [(i, min(i + 3, len(t))) for i in at]) for t, at in zip(texts, starts)]

    return encode


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and labels by an encode function with offsets; tokens that straddle the end of the prompt stay masked."""
    options = PrepOptions("pairs", base_model="Qwen/x", max_length=400)
    tokens = training_tokens(sample_pairs(spark, folder), options, make_encode=make_chunk_encoder)
    joined = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "labels")]
    return tokens.select("sample_id", *joined, F.size("attention_mask").alias("n_tokens"))


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of all documents in three epochs, the last one resumed at its third batch."""
    rows = number_rows(documents(spark, folder).select("doc_id"), "doc_id", name="number")
    n = rows.count()
    parts = [epoch_batches(rows, "number", n, 16, seed=7, epoch=e, first_batch=2 if e == 2 else 0).withColumn("epoch", F.lit(e)) for e in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("doc_id", "epoch", "place", "batch_id")


def padded_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of rows whose keys repeat or are null: per key, as many rows and tokens come out as go in."""
    counts = _document_tokens(spark, folder, 64)
    key = F.when(F.col("sample_id") % 7 > 0, F.col("sample_id") % 50).alias("sample_key")
    arrays = ("input_ids", "attention_mask", "labels")
    padded = pad_batches(counts.select(key, *arrays), "sample_key", 8)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return padded.groupBy("sample_key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(real).alias("n_tokens"))


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _padded(training_batches(_pair_tokens(spark, folder)))


def padded_batches_full_only(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tokenize_native(
        with_training_text(sample_pairs(spark, folder), get_model("qwen")).select(
            "sample_id", "text_prompt", "text_full"
        )
    )
    return _padded(training_batches(tokens, batch_size=6, seed=1, drop_last=True))


def _padded(batches: DataFrame) -> DataFrame:
    return batches.select(
        "sample_id",
        "batch_id",
        F.size("input_ids").alias("n_padded"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
    )


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary_sizes(documents(spark, folder), "lang", "text")


def vocab_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder)


def vocabulary_ids(spark: SparkSession, folder: str) -> DataFrame:
    return build_vocabulary(documents(spark, folder))


def vocabulary_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as dense ids and back; ids are told by a sum that depends on their order."""
    docs = documents(spark, folder).select("doc_id", "text")
    encoded = encode_vocabulary(docs, build_vocabulary(docs), head=1000)
    back = decode_vocabulary(materialise(encoded, "dense-ids", compression="zstd"), build_vocabulary(docs), head=500)
    weighted = F.aggregate(F.transform("ids", lambda x, i: x * (i % 1000 + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), weighted.alias("checksum"), (F.col("decoded") == F.col("text")).alias("same"))


def vocab_share(spark: SparkSession, folder: str) -> DataFrame:
    report = vocabulary_report(_vocabulary(spark, folder), "lang")
    return report.withColumn("pct_of_max", F.round("pct_of_max", 6))


def vocab_extremes(spark: SparkSession, folder: str) -> DataFrame:
    found = extremes(_vocabulary(spark, folder), "lang", "vocab_size")
    return found.withColumn("mean_value", F.round("mean_value", 6))


def vocab_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens of each model's rendered prompts."""
    each = with_registry(sample_pairs(spark, folder))
    content = each.select(
        F.col("model.model_key").alias("model"), F.explode(messages_per_model(each)).alias("m")
    ).select("model", F.col("m.content").alias("content"))
    return vocabulary_sizes(content, "model", "content")


QUERIES = {
    "tokenize_words": tokenize_words,
    "mask_labels": mask_labels,
    "tokenize_truncated": tokenize_truncated,
    "token_breakdown": breakdown,
    "token_breakdown_first_rows": breakdown_first_rows,
    "label_summary": summaries,
    "label_texts": masked_and_trained_text,
    "token_stats": token_stats,
    "token_stats_by_model": token_stats_by_model,
    "encode_offsets": encoded,
    "epoch_batches": epochs,
    "pad_batches": padded_batches,
    "pad_batches_repeated_keys": padded_repeated_keys,
    "pad_batches_full_only": padded_batches_full_only,
    "vocab_by_group": vocab_by_group,
    "vocabulary_ids": vocabulary_ids,
    "vocabulary_round_trip": vocabulary_round_trip,
    "vocab_share": vocab_share,
    "vocab_extremes": vocab_extremes,
    "vocab_by_model": vocab_by_model,
    "mapped_training_tokens": mapped_training_tokens,
}

_PATTERN = f"'{TOKEN_PATTERN}'"
_SPECIAL = " ".join(f"WHEN '{token}' THEN {number}" for token, number in SPECIAL_TOKENS.items())


def _tokens(source: str, keys: str, limit: int | None = None) -> str:
    """CTE ``tok``: tokens, ids and labels of ``text_full``, masked up to the prompt's length.

    The boundary is found from character offsets, unlike the Spark plan's token counts.
    """
    cut = f"[1:{limit}]" if limit else ""
    return f"""split_up AS (
  SELECT {keys}, length(text_prompt) AS plen, regexp_extract_all(text_full, {_PATTERN}){cut} AS t FROM {source}),
one AS (
  SELECT {keys}, plen, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS idx FROM split_up),
placed AS (
  SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY {keys} ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM one),
tok AS (
  SELECT {keys}, idx, token, begins < plen AS masked,
    CASE token {_SPECIAL} ELSE ('0x' || substr(md5(token), 1, 15))::BIGINT + 151665 END AS id
  FROM placed)"""


_TOK = f"{PAIR_SAMPLES}, {TRAINING_TEXT}, {_tokens('texts', 'sample_id')}"
_DOC_TEXT = f"{RAW}, {TRAINING_TEXT}"
_DOC_TOK = f"{_DOC_TEXT}, {_tokens('texts', 'sample_id, split')}"
_LABEL = "CASE WHEN masked THEN -100 ELSE id END"
_BREAKDOWN = f"""SELECT sample_id, idx::INTEGER AS "index", token, id::BIGINT AS input_id, 1::INTEGER AS attention_mask,
  ({_LABEL})::BIGINT AS label, masked, CASE WHEN masked THEN '[MASKED]' ELSE '[TRAINING]' END AS training FROM tok"""
_COUNTS = """counts AS (
  SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE masked) AS m FROM tok GROUP BY {keys})"""


def _statistics(group: str) -> str:
    return f"""SELECT {group}, count(*) AS num_samples, round(avg(n), 6) AS avg_length, min(n)::INTEGER AS min_length,
      max(n)::INTEGER AS max_length, round(avg(m), 6) AS avg_masked_tokens, round(avg(n - m), 6) AS avg_training_tokens,
      round(avg(m) / avg(n), 6) AS avg_masked_ratio, count(*) FILTER (WHERE n = m) AS fully_masked
      FROM counts GROUP BY {group}"""


def _padded_sql(batch: int, seed: int, limit: int | None, drop_last: bool) -> str:
    keep = f"WHERE members = {batch}" if drop_last else ""
    return f"""WITH {PAIR_SAMPLES}, {TRAINING_TEXT}, {_tokens('texts', 'sample_id', limit)},
    arrays AS (
      SELECT sample_id, list(id ORDER BY idx) AS ids, list({_LABEL} ORDER BY idx) AS labels FROM tok GROUP BY sample_id),
    numbered AS (
      SELECT *, (row_number() OVER (ORDER BY md5('{seed}:' || sample_id), sample_id) - 1) // {batch} AS batch_id FROM arrays),
    sized AS (
      SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest, count(*) OVER (PARTITION BY batch_id) AS members
      FROM numbered)
    SELECT sample_id, batch_id, longest::INTEGER AS n_padded, len(ids)::INTEGER AS n_real,
      array_to_string(list_concat(ids, list_transform(range(len(ids), longest), lambda x: 151645)), ' ') AS ids,
      array_to_string(list_concat(labels, list_transform(range(len(ids), longest), lambda x: -100)), ' ') AS labels
    FROM sized {keep}"""


_VOCAB = f"""vocab AS (
  SELECT lang, count(DISTINCT token) AS vocab_size
  FROM (SELECT lang, unnest(regexp_extract_all(text, {_PATTERN})) AS token FROM documents) GROUP BY lang)"""
_DENSE = f"""dense AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_PATTERN})) AS token FROM documents) GROUP BY token))"""
_MODEL_TEXT = (
    f"CASE WHEN model IN ('llama', 'qwen') THEN {block(chr(39) + 'system' + chr(39), SYSTEM)} || "
    f"{block(chr(39) + 'user' + chr(39), '(' + USER + ')')} ELSE {block(chr(39) + 'system' + chr(39), DEFAULT_SYSTEM)} || "
    f"{block(chr(39) + 'user' + chr(39), '(' + MERGED + ')')} END || '<|im_start|>assistant' || chr(10)"
)
_MODELS = "models AS (SELECT unnest(['llama', 'mistral', 'gemma', 'qwen', 'olmo']) AS model)"

# Title as input and list as output; the validation rows are those with the smallest hashes.
_MAPPED = RAW.replace("samples AS (", "kept AS (") + """,
samples AS (
  SELECT sample_id, split, title, title AS NER, ingredients, ingredients AS directions FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id)) AS place, count(*) OVER () AS n FROM kept WHERE split = 'train')
  WHERE place > ceil(0.05 * n))"""



def _epochs_sql() -> str:
    """A recursive walk per epoch, every round a subquery so that the expression stays short."""
    parts = []
    for epoch in range(3):
        step = f"SELECT doc_id, n, m, steps, x // m AS l, x % m AS r FROM walk{epoch} WHERE steps = 0 OR x >= n"
        for a, b in round_keys(7, epoch):
            step = f"SELECT doc_id, n, m, steps, r AS l, (l + (((r + {a}) % {PRIME}) * ((r + {a}) % {PRIME})) % {PRIME} * {b} % {PRIME}) % m AS r FROM ({step})"
        parts.append(f"""walk{epoch}(doc_id, n, m, steps, x) AS (
      SELECT doc_id, n, m, 0, number FROM numbered UNION ALL SELECT doc_id, n, m, steps + 1, l * m + r FROM ({step}))""")
    found = " UNION ALL ".join(f"SELECT doc_id, {e} AS epoch, x AS place FROM walk{e} WHERE steps > 0 AND x < n" for e in range(3))
    return f"""WITH RECURSIVE numbered AS (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number, count(*) OVER () AS n,
        ceil(sqrt(count(*) OVER ()))::BIGINT AS m FROM documents),
    {", ".join(parts)}
    SELECT doc_id, epoch::INTEGER AS epoch, place, place // 16 AS batch_id FROM ({found}) WHERE epoch < 2 OR place // 16 >= 2"""


ORACLES = {
    "epoch_batches": _epochs_sql(),
    "mapped_training_tokens": f"""WITH {_MAPPED}, {TRAINING_TEXT}
      SELECT sample_id, len(regexp_extract_all(text_full, {_PATTERN}))::INTEGER AS n_tokens FROM texts""",
    "tokenize_words": f"""WITH {_TOK} SELECT sample_id, count(*)::INTEGER AS n_tokens,
      string_agg(id::VARCHAR, ' ' ORDER BY idx) AS ids, repeat('1', count(*)) AS mask FROM tok GROUP BY sample_id""",
    "mask_labels": f"""WITH {_TOK} SELECT sample_id, string_agg(({_LABEL})::VARCHAR, ' ' ORDER BY idx) AS labels
      FROM tok GROUP BY sample_id""",
    "tokenize_truncated": f"""WITH {_DOC_TEXT}, {_tokens('texts', 'sample_id', 512)}, {_COUNTS.format(keys='sample_id')}
      SELECT sample_id, n::INTEGER AS n_tokens, m::INTEGER AS n_masked, (n - m)::INTEGER AS n_training FROM counts""",
    "token_breakdown": f"WITH {_TOK} {_BREAKDOWN}",
    "token_breakdown_first_rows": f"WITH {_TOK} {_BREAKDOWN} WHERE idx < 50",
    "label_summary": f"""WITH {_DOC_TOK}, {_COUNTS.format(keys='sample_id')}
      SELECT sample_id, n::INTEGER AS n_tokens, m::INTEGER AS n_masked, (n - m)::INTEGER AS n_training,
        round(m / n::DOUBLE * 100, 6) AS pct_masked, round((n - m) / n::DOUBLE * 100, 6) AS pct_training FROM counts""",
    "label_texts": f"""WITH {_TOK}, parts AS (
        SELECT sample_id, coalesce(string_agg(token, '' ORDER BY idx) FILTER (WHERE masked), '') AS a,
          coalesce(string_agg(token, '' ORDER BY idx) FILTER (WHERE NOT masked), '') AS b FROM tok GROUP BY sample_id)
      SELECT sample_id, CASE WHEN length(a) > 500 THEN a[1:500] || '...' ELSE a END AS masked_text,
        CASE WHEN length(b) > 500 THEN b[1:500] || '...' ELSE b END AS training_text FROM parts""",
    "token_stats": f"WITH {_DOC_TOK}, {_COUNTS.format(keys='sample_id, split')} {_statistics('split')}",
    "token_stats_by_model": f"""WITH {PAIR_SAMPLES}, {_MODELS}, texts AS (
        SELECT sample_id, model, {_MODEL_TEXT} AS text_prompt,
          {_MODEL_TEXT} || {ANSWER} || '<|im_end|>' || chr(10) AS text_full
        FROM samples CROSS JOIN models),
      {_tokens('texts', 'sample_id, model')}, {_COUNTS.format(keys='sample_id, model')} {_statistics('model')}""",
    "encode_offsets": f"""WITH {PAIR_SAMPLES}, {TRAINING_TEXT}, cut AS (
        SELECT sample_id, text_full, length(text_prompt) AS plen, least((length(text_full) + 2) // 3, 400) AS n FROM texts),
      coded AS (SELECT *, list_transform(range(0, n), lambda i: unicode(text_full[3 * i + 1 : 3 * i + 1])) AS ids FROM cut)
      SELECT sample_id, array_to_string(ids, ' ') AS input_ids, n::INTEGER AS n_tokens,
        array_to_string(list_transform(range(0, n), lambda i: CASE WHEN 3 * i >= plen THEN ids[i + 1] ELSE -100 END), ' ') AS labels FROM coded""",
    "pad_batches_repeated_keys": f"""WITH {_DOC_TEXT}, {_tokens('texts', 'sample_id', 64)}
      SELECT CASE WHEN sample_id % 7 > 0 THEN sample_id % 50 END AS sample_key, count(DISTINCT sample_id) AS n_rows, count(*) AS n_tokens
      FROM tok GROUP BY 1""",
    "pad_batches": _padded_sql(4, 42, None, False),
    "pad_batches_full_only": _padded_sql(6, 1, None, True),
    "vocab_by_group": f"WITH {_VOCAB} SELECT lang, vocab_size FROM vocab",
    "vocabulary_ids": f"WITH {_DENSE} SELECT token, n, token_id FROM dense",
    "vocabulary_round_trip": f"""WITH {_DENSE}, placed AS (
        SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS i FROM (
          SELECT doc_id, regexp_extract_all(text, {_PATTERN}) AS t FROM documents))
      SELECT doc_id, coalesce(count(token_id), 0)::INTEGER AS n_tokens, coalesce(sum(token_id * (i % 1000 + 1)), 0)::BIGINT AS checksum, true AS same
      FROM documents LEFT JOIN placed USING (doc_id) LEFT JOIN dense USING (token) GROUP BY doc_id""",
    "vocab_share": f"""WITH {_VOCAB} SELECT lang, vocab_size,
      round(vocab_size / (max(vocab_size) OVER ())::DOUBLE * 100, 6) AS pct_of_max,
      (rank() OVER (ORDER BY vocab_size DESC, lang))::INTEGER AS position FROM vocab""",
    "vocab_extremes": f"""WITH {_VOCAB} SELECT
      (SELECT lang FROM vocab ORDER BY vocab_size DESC, lang LIMIT 1) AS largest, max(vocab_size) AS largest_value,
      (SELECT lang FROM vocab ORDER BY vocab_size, lang LIMIT 1) AS smallest, min(vocab_size) AS smallest_value,
      round(avg(vocab_size), 6) AS mean_value, max(vocab_size) - min(vocab_size) AS value_range FROM vocab""",
    "vocab_by_model": f"""WITH {PAIR_SAMPLES}, {_MODELS}, contents AS (
        SELECT model, {SYSTEM} AS content FROM models WHERE model IN ('llama', 'qwen')
        UNION ALL SELECT model, {USER} FROM samples CROSS JOIN models WHERE model IN ('llama', 'qwen')
        UNION ALL SELECT model, {MERGED} FROM samples CROSS JOIN models WHERE model NOT IN ('llama', 'qwen'))
      SELECT model, count(DISTINCT token) AS vocab_size
      FROM (SELECT model, unnest(regexp_extract_all(content, {_PATTERN})) AS token FROM contents) GROUP BY model""",
}
