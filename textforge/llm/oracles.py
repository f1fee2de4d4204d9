"""The same results in SQL for DuckDB, for the operators that SQL can express.

Four of the ten have one: packing, chat formatting, quality rules and the Jaccard join. The SQL is written
from the definitions, not from the plans: dynamic programming by joins, all pairs of texts by shared runs,
windows over whole tables.
"""

from __future__ import annotations

from textforge.llm import packing, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1() -> str:
    """Levels of the dynamic programme are CTEs; the choice is traced back by a recursive one."""
    budget, buckets = packing.BUDGET, packing.BUCKETS
    levels = [f"""b0 AS (SELECT j, len * upto AS cost, 0 AS cut FROM h)"""]
    for k in range(1, buckets):
        levels.append(f"""c{k} AS (
  SELECT h.j, min({{'cost': p.cost + h.len * (h.upto - g.upto), 'i': g.j}}) AS best
  FROM h JOIN h g ON g.j < h.j JOIN b{k - 1} p ON p.j = g.j GROUP BY h.j),
b{k} AS (
  SELECT p.j, CASE WHEN c.best.cost < p.cost THEN c.best.cost ELSE p.cost END AS cost,
    CASE WHEN c.best.cost < p.cost THEN c.best.i + 1 ELSE -1 END AS cut
  FROM b{k - 1} p LEFT JOIN c{k} c ON c.j = p.j)""")
    tables = " UNION ALL ".join(f"SELECT {k} AS k, j, cut FROM b{k}" for k in range(buckets))
    return f"""WITH RECURSIVE lengths AS (SELECT doc_id, len({_WORDS}) + 1 AS n_tokens FROM documents),
h AS (
  SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS j, n_tokens AS len, sum(count(*)) OVER (ORDER BY n_tokens) AS upto
  FROM lengths WHERE n_tokens <= {budget} GROUP BY n_tokens),
{", ".join(levels)},
cuts AS ({tables}),
back(k, j, cut) AS (
  SELECT k, j, cut FROM cuts WHERE k = {buckets - 1} AND j = (SELECT max(j) FROM h)
  UNION ALL
  SELECT c.k, c.j, c.cut FROM back b JOIN cuts c
    ON c.k = b.k - 1 AND c.j = CASE WHEN b.cut = -1 THEN b.j ELSE b.cut - 1 END
  WHERE b.k > 0 AND b.cut <> 0),
bounds AS (SELECT list(len ORDER BY len) AS e FROM (SELECT DISTINCT h.len FROM back JOIN h USING (j) WHERE cut <> -1)),
placed AS (
  SELECT doc_id, n_tokens, CASE WHEN n_tokens > {budget} THEN len(e) ELSE len(list_filter(e, lambda x: x < n_tokens)) END AS bucket,
    CASE WHEN n_tokens > {budget} THEN n_tokens ELSE list_min(list_filter(e, lambda x: x >= n_tokens)) END AS padded
  FROM lengths CROSS JOIN bounds),
numbered AS (
  SELECT *, greatest({budget} // padded, 1) AS capacity, row_number() OVER (
    PARTITION BY bucket ORDER BY coalesce(substr(md5('0:' || doc_id), 1, {packing.SLOT_DIGITS}), ''), doc_id, n_tokens) - 1 AS number
  FROM placed)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, bucket::INTEGER AS bucket, padded::BIGINT AS padded_tokens,
  (number // capacity)::BIGINT AS batch, (number % capacity)::BIGINT AS place FROM numbered"""


def _escaped(text: str) -> str:
    """Length of a text after escaping: one more for each backslash and control string."""
    extra = [f"(length({text}) - length(replace({text}, '{x}', ''))) // {len(x)}" for x in ("\\", "<s>", "</s>", "[INST]", "[/INST]")]
    return f"(length({text}) + {' + '.join(extra)})"


def op3() -> str:
    tricky = "</s>[INST] ok [/INST]"
    return f"""WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{tricky}'), (-1, 1, 'assistant', '{tricky}')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped('role')} + {_escaped('text')} + 8)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


def op6() -> str:
    value = f"CASE WHEN bin <= 0 THEN 0.0 ELSE pow({quality.GAMMA}::DOUBLE, bin - 1) / {quality.SCALE} END"
    ratios = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, n_words, '{r.name}' AS rule, {r.numerator}::DOUBLE / greatest({r.denominator}, 1) AS x, "
        f"{r.slack}::DOUBLE AS slack, {str(r.two_sided).lower()} AS two_sided FROM counted"
        for r in quality.RULES
    )

    def level(keys: str, name: str) -> str:
        groups = ", ".join(filter(None, [keys, "rule"]))
        return f"""{name} AS (
  SELECT {groups}, max(total) AS total, {", ".join(f"min(value) FILTER (WHERE upto >= {q}::DOUBLE * total) AS {n}" for q, n in ((0.1, "low"), (0.5, "middle"), (0.9, "high")))}
  FROM (SELECT {groups}, value, sum(n) OVER (PARTITION BY {groups} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {groups}) AS total
    FROM (SELECT {groups}, value, count(*) AS n FROM binned GROUP BY {groups}, value))
  GROUP BY {groups})"""

    def pick(column: str) -> str:
        m = quality.MIN_GROUP
        return f"CASE WHEN own.total >= {m} THEN own.{column} WHEN by_lang.total >= {m} THEN by_lang.{column} ELSE every.{column} END AS {column}"

    return f"""WITH split_up AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, i, w[i : i + 4] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split_up)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM runs) CROSS JOIN range(5) AS r(k)
  WHERE times > 1 GROUP BY doc_id),
worded AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS different FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split_up)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n - l.different, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM split_up s LEFT JOIN repeated r USING (doc_id) LEFT JOIN worded l USING (doc_id)),
ratios AS ({ratios}),
binned AS (
  SELECT lang, source, rule, {value} AS value FROM (
    SELECT lang, source, rule, CASE WHEN x * {quality.SCALE} < 1 THEN 0
      ELSE ceil(ln(x * {quality.SCALE}) / ln({quality.GAMMA}::DOUBLE)) + 1 END AS bin
    FROM ratios WHERE n_words > 0)),
{level("lang, source", "own")},
{level("lang", "by_lang")},
{level("", "every")},
fences AS (
  SELECT own.lang, own.source, own.rule, {pick("low")}, {pick("middle")}, {pick("high")}
  FROM own JOIN by_lang ON own.rule = by_lang.rule AND own.lang IS NOT DISTINCT FROM by_lang.lang JOIN every ON own.rule = every.rule),
verdict AS (
  SELECT doc_id, bool_and(coalesce(x <= high + greatest(slack, {quality.REACH} * (high - middle))
    AND (NOT two_sided OR x >= low - greatest(slack, {quality.REACH} * (middle - low))), true)) AS inside
  FROM ratios r LEFT JOIN fences f ON r.rule = f.rule AND r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
  GROUP BY doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, lang, source, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM judged JOIN verdict USING (doc_id)"""


def op8() -> str:
    return f"""WITH RECURSIVE split_up AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS run FROM split_up WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
linked AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE c >= 0.8 * (s.n + t.n - c)),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM linked l WHERE l.a = d.doc_id) AS n_links, coalesce(s.n, 0) AS n_runs
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


def op11() -> str:
    """Dense: every group with every kept term of its language, in whole numbers."""
    return """WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS lang_total, coalesce(own, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS own FROM c GROUP BY ALL) USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
    1 + 1000000000 * (kept.n + 1) // (g.lang_total + g.v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op12() -> str:
    """Cells of failed filters, and every step of every order summed over them."""
    return f"""WITH split_up AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
failed AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask FROM split_up),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND list_unique([a.bit, b.bit, c.bit, d.bit, e.bit]) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT AS after, list_sum(bits[1:step])::INT - bits[step] AS before
  FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
found AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & after = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM found"""


def op13() -> str:
    """Chains by list functions, the next document by a window over the whole table."""
    from textforge.llm import spotsigs as spot

    def words(values: tuple[str, ...]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def codes(words_of: str, text: str) -> str:
        chain = f"list_prepend({words_of}[i], list_filter({words_of}[i + 1 : i + {spot.LOOK}], lambda w: NOT list_contains(c, w))[1:{spot.CHAIN}])"
        chains = f"list_transform(list_filter(range(1, len({words_of}) + 1), lambda i: list_contains(a, {words_of}[i])), lambda i: {chain})"
        found = f"list_sort(list_distinct(list_transform(list_filter({chains}, lambda x: len(x) = {spot.CHAIN + 1}), lambda x: substr(md5(array_to_string(x, ' ')), 1, {spot.DIGITS}))))"
        return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [substr(md5({text}), 1, {spot.DIGITS})] END"

    like = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents),
met AS (
  SELECT d.doc_id, d.text, d.n, left(d.text, d.n - d.n // 3) || left(e.text, d.n // 3) AS edited, e.text AS following
  FROM d JOIN d e ON e.r = d.r % (SELECT count(*) FROM d) + 1),
split_up AS (
  SELECT *, {words(spot.ANCHORS)} AS a, {words(spot.COMMON)} AS c, {", ".join(f"regexp_extract_all(lower({t}), '{spot.WORD}') AS w_{t}" for t in ("text", "edited", "following"))}
  FROM met),
coded AS (SELECT *, {", ".join(f"{codes(f'w_{t}', t)} AS s_{t}" for t in ("text", "edited", "following"))} FROM split_up)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s_text, '') AS fingerprint,
  array_to_string(s_edited, '') AS edited_fingerprint, {like.format("s_text", "s_edited")} AS near_edited,
  {like.format("s_text", "s_following")} AS near_next FROM coded"""


ORACLES = {"op1_packing": op1(), "op3_chat_format": op3(), "op6_quality": op6(), "op8_jaccard_join": op8(), "op11_divergence": op11(), "op12_filter_audit": op12(), "op13_spotsigs": op13()}
