"""Relations the registered queries share, each once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn with the assistant turn right after it.

    An equi-join on (conversation, turn), unique on both sides, rather than a window per
    conversation: a conversation with very many turns is spread over all tasks.
    """
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("request")
    )
    answered = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    # Where the scan has too few splits, both sides are spread by the join key itself, which
    # then is the join's own partitioning.
    keys = ["conv_id", "turn"]
    return spread(asked, *keys).join(spread(answered, *keys), keys)


PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, u.text AS request, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def raw_samples(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Documents in the shape of raw samples; some sources lack a title, a list or a marker.

    ``heavy`` spreads them for costly row-local work.
    """
    source, lang, text = F.col("source"), F.col("lang"), F.col("text")
    docs = documents(spark, folder) if heavy else table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        F.when(source.isin("src0", "src1"), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.when(source == "src3", F.lit(None))
        .when(source == "src7", F.lit("\t \n"))
        .otherwise(F.substring_index(text, "\n", 1))
        .alias("title"),
        F.when(lang != "es", F.concat(source, F.lit(", "), lang)).alias("NER"),
        F.when(source == "src11", F.lit("")).otherwise(F.concat(source, F.lit(" "), lang)).alias("ingredients"),
        text.alias("directions"),
        F.when(source == "src13", F.concat(F.lit("[INST] "), lang))
        .when(source == "src17", F.concat(F.lit("[inst] "), lang, F.lit(" [/inst]")))
        .otherwise(F.concat(F.lit("[INST] "), lang, F.lit(" [/INST]")))
        .alias("prompt"),
    )


RAW = r"""raw AS (
  SELECT doc_id AS sample_id,
    CASE WHEN source IN ('src0', 'src1') THEN 'test' ELSE 'train' END AS split,
    CASE source WHEN 'src3' THEN NULL WHEN 'src7' THEN chr(9) || ' ' || chr(10)
      ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN lang <> 'es' THEN source || ', ' || lang END AS NER,
    CASE source WHEN 'src11' THEN '' ELSE source || ' ' || lang END AS ingredients,
    text AS directions,
    CASE source WHEN 'src13' THEN '[INST] ' || lang WHEN 'src17' THEN '[inst] ' || lang || ' [/inst]'
      ELSE '[INST] ' || lang || ' [/INST]' END AS prompt
  FROM documents),
flagged AS (
  SELECT *, coalesce(
      title IS NOT NULL AND NOT regexp_full_match(title, '\s*')
      AND ingredients IS NOT NULL AND NOT regexp_full_match(ingredients, '\s*')
      AND directions IS NOT NULL AND NOT regexp_full_match(directions, '\s*')
      AND contains(prompt, '[INST]') AND contains(prompt, '[/INST]'), false) AS ok
  FROM raw),
samples AS (SELECT * EXCLUDE (ok) FROM flagged WHERE ok)"""

# The texts of prompts and answers, as SQL expressions over the columns of ``samples``.
SYSTEM = (
    "'You will generate one cooking recipe. List all necessary ingredients and give detailed steps.'"
)
USER = "'Include ingredients: ' || coalesce(NER, 'None')"
MERGED = f"{SYSTEM} || chr(10) || chr(10) || chr(10) || chr(10) || {USER}"
ANSWER = (
    "'Certainly! Here''s a delicious recipe for:' || chr(10) || '[ ' || coalesce(title, 'None') || ' ]'"
    " || chr(10) || chr(10) || '[ INGREDIENTS ]' || chr(10) || coalesce(ingredients, 'None')"
    " || chr(10) || chr(10) || '[ DIRECTIONS ]' || chr(10) || coalesce(directions, 'None')"
)
DEFAULT_SYSTEM = "'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.'"


def block(role: str, content: str) -> str:
    """SQL for one rendered turn; both arguments are SQL expressions."""
    return f"('<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10))"


SYSTEM_PROMPT_TEXT = (
    f"{block(chr(39) + 'system' + chr(39), SYSTEM)} || {block(chr(39) + 'user' + chr(39), '(' + USER + ')')}"
    " || '<|im_start|>assistant' || chr(10)"
)


def sample_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation pairs in the shape of samples, with one text key."""
    return pairs(spark, folder).select(
        F.concat_ws("-", "conv_id", "turn").alias("sample_id"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        F.col("request").alias("NER"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("ingredients"),
        F.col("reply").alias("directions"),
    )


PAIR_SAMPLES = f"""{PAIRS},
samples AS (
  SELECT conv_id || '-' || turn AS sample_id, 'Conversation ' || conv_id AS title, request AS NER,
    'turn ' || turn AS ingredients, reply AS directions
  FROM pairs)"""

# Training text of ``samples`` for a model with system messages.
TRAINING_TEXT = f"""texts AS (
  SELECT *, {SYSTEM_PROMPT_TEXT} AS text_prompt,
    {SYSTEM_PROMPT_TEXT} || {ANSWER} || '<|im_end|>' || chr(10) AS text_full
  FROM samples)"""


def model_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three stand-in models over all pairs: repeat the request, drop every third word of the reply, or turn it round."""
    reply_words = F.split("reply", " ")
    options = F.array(
        F.struct(F.lit("org/Qwen-echo").alias("model"), F.lit("base").alias("variant"), F.col("request").alias("prediction")),
        F.struct(
            F.lit("org/Llama-lead").alias("model"),
            F.lit("finetuned").alias("variant"),
            F.concat_ws(" ", F.filter(reply_words, lambda w, i: (i + 1) % 3 != 0)).alias("prediction"),
        ),
        F.struct(
            F.lit("org/gemma-tail").alias("model"),
            F.lit("other").alias("variant"),
            F.concat_ws(" ", F.reverse(reply_words)).alias("prediction"),
        ),
    )
    return (
        pairs(spark, folder)
        .select("conv_id", "turn", F.col("reply").alias("reference"), F.explode(options).alias("m"))
        .select("conv_id", "turn", "reference", "m.*")
    )


PREDICTIONS = f"""{PAIRS},
predictions AS (
  SELECT conv_id, turn, reply AS reference, 'org/Qwen-echo' AS model, 'base' AS variant, request AS prediction FROM pairs
  UNION ALL
  SELECT conv_id, turn, reply, 'org/Llama-lead', 'finetuned',
    array_to_string(list_filter(string_split(reply, ' '), lambda w, i: i % 3 <> 0), ' ') FROM pairs
  UNION ALL
  SELECT conv_id, turn, reply, 'org/gemma-tail', 'other',
    array_to_string(list_reverse(string_split(reply, ' ')), ' ') FROM pairs)"""


def words_sql(text: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), "
        "lambda w: w <> '')"
    )


def rouge_sql(source: str, keys: str, n: int, prefix: str) -> str:
    """CTEs ending in ``{prefix}`` with p, r and f of word runs of size n per key.

    ``source`` has the keys, ``prediction`` and ``reference``.
    """
    gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))

    def runs(column: str) -> str:
        t = words_sql(column)
        return f"(SELECT list_transform(range(1, len(t) - {n} + 2), lambda i: {gram}) FROM (SELECT {t} AS t))"

    return f"""{prefix}_g AS (
  SELECT {keys}, {runs('prediction')} AS p, {runs('reference')} AS r FROM {source}),
{prefix}_c AS (
  SELECT {keys}, g, sum(a) AS a, sum(b) AS b FROM (
    SELECT {keys}, unnest(p) AS g, 1 AS a, 0 AS b FROM {prefix}_g
    UNION ALL SELECT {keys}, unnest(r), 0, 1 FROM {prefix}_g)
  GROUP BY {keys}, g),
{prefix}_o AS (SELECT {keys}, sum(least(a, b)) AS o FROM {prefix}_c GROUP BY {keys}),
{prefix}_m AS (
  SELECT {keys}, coalesce(o, 0) / greatest(len(p), 1)::DOUBLE AS p, coalesce(o, 0) / greatest(len(r), 1)::DOUBLE AS r
  FROM {prefix}_g LEFT JOIN {prefix}_o USING ({keys})),
{prefix} AS (
  SELECT {keys}, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM {prefix}_m)"""


def lcs_sql(source: str, keys: str, prefix: str) -> str:
    """CTEs ending in ``{prefix}``: p, r, f of the longest common subsequence, by its length table."""
    return f"""{prefix}_t AS (
  SELECT {keys}, {words_sql('prediction')} AS a, {words_sql('reference')} AS b FROM {source}),
{prefix}_l AS (
  SELECT {keys}, len(a) AS n, len(b) AS m, list_reduce(
    a,
    lambda acc, tok: list_reduce(
      range(1, len(b) + 1),
      lambda line, j: list_append(line, CASE WHEN b[j] = tok THEN acc[j] + 1 ELSE greatest(acc[j + 1], line[j]) END),
      [0::BIGINT]),
    list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT))[-1] AS l
  FROM {prefix}_t),
{prefix}_m AS (
  SELECT {keys}, l / greatest(n, 1)::DOUBLE AS p, l / greatest(m, 1)::DOUBLE AS r FROM {prefix}_l),
{prefix} AS (
  SELECT {keys}, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM {prefix}_m)"""
