"""Document fingerprints from spot signatures, and how alike they are (operator 13; built-in functions only).

A spot signature is an anchor, which is a very common word, and the next ``CHAIN`` content words, those
that are not common; common words in between are skipped. Text around the prose (menus, lists of names)
holds few anchors, so it says little. A fingerprint is the set of a text's signatures, each as ``DIGITS``
hexadecimal digits, in order and without a separator. A text without any signature is its own only one.

Likeness is the Jaccard similarity of two sets. Sets fall into length parts, each ``1 / LIKE`` times as
long as the one before, so sets that are alike to ``LIKE`` stand in the same part or in two that meet
(``near_pairs``). Within those, only sets that share one of their rarest signatures are compared:
of n signatures, those up to the place ``n - ceil(LIKE * n) + 1``, and only while the lengths
allow for ``LIKE``. All sets that hold the same signatures are one set.

``fingerprint_edits`` meets every document with the next one, which is the next smaller id (after the
last one the first). Ids and lengths alone are sorted, by ranges; the place in the order is a count
per range plus the place in it. Texts move once; of the next document, only the start that the edit needs
and the fingerprint move again.

Null texts are empty. Null ids stand after all others. Documents that repeat an id are in the order of a
digest of id and text; rows that repeat id and text are one document of the order and get equal results. A
single document follows itself. An empty table gives no rows. Other columns are not read. A very long
text costs a task its words as an array.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.llm.common import materialise

CHAIN = 2
LOOK = 12  # a chain lies within so many words behind its anchor
DIGITS = 10
LIKE = 0.8
WORD = r"[\p{L}\p{M}\p{N}]+"

# Common words of four languages; anchors are the articles and forms of "to be" among them.
ANCHORS = ("the", "a", "is", "was", "der", "die", "das", "ist", "le", "la", "les", "est", "el", "los", "es", "un")
COMMON = (
    *ANCHORS,
    *("of", "and", "to", "in", "that", "it", "for", "on", "with", "be", "by", "as", "this", "are", "at", "from", "an", "he", "or", "not", "have", "you"),
    *("und", "den", "von", "zu", "mit", "sich", "auf", "des", "für", "nicht", "dem", "im", "ein", "eine", "als", "er", "auch"),
    *("de", "et", "des", "en", "du", "une", "que", "pour", "qui", "par", "dans", "sur", "au", "pas", "avec", "ou", "il"),
    *("y", "se", "del", "las", "por", "no", "con", "su", "una", "para", "al", "lo", "o"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _code(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, DIGITS)


def signatures(text: Column) -> Column:
    """The signature set of a text: codes in order, each once."""

    def chains(words: Column) -> Column:
        def chain(at: Column) -> Column:
            content = F.filter(F.slice(words, at + 2, F.lit(LOOK)), lambda w: ~w.isin(*COMMON))
            return F.concat(F.array(F.get(words, at)), F.slice(content, 1, CHAIN))

        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i)), lambda i: i.isNotNull())
        return F.filter(F.transform(places, chain), lambda c: F.size(c) == CHAIN + 1)

    found = let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), chains)
    codes = F.sort_array(F.array_distinct(F.transform(found, lambda c: _code(F.array_join(c, " ")))))
    return let(codes, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(_code(text))))


def fingerprint(text: Column) -> Column:
    return F.array_join(signatures(text), "")


def members(printed: Column) -> Column:
    """The set back from a fingerprint."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(printed) - DIGITS + 1, F.lit(1)), F.lit(DIGITS))
    return F.transform(starts, lambda i: F.substring(printed, i, F.lit(DIGITS)))


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two signature sets, 0 to 1."""
    return let(F.size(F.array_intersect(left, right)), lambda n: n / (F.size(left) + F.size(right) - n))


def next_documents(docs: DataFrame) -> DataFrame:
    """``(key, after, after_id, n_chars)``: for each document the one that stands before it, and that one's length; from ``(doc_id, key, n_chars)``."""
    order = (F.desc_nulls_last("doc_id"), F.asc("key"))
    distinct = materialise(docs.select("doc_id", "key", "n_chars").distinct(), "spot-documents")
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "key", "n_chars", F.monotonically_increasing_id().alias("at"))
    placed = materialise(placed, "spot-order")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row for each range
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    spark = docs.sparkSession
    starts = spark.createDataFrame(starts, "part long, start long")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    ranked = ranked.select("doc_id", "key", "n_chars", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    before = ranked.select(F.col("key").alias("after"), F.col("doc_id").alias("after_id"), "n_chars", ((F.col("rank") + 1) % F.lit(max(total, 1))).alias("rank"))
    return ranked.select("key", "rank").join(before, "rank").select("key", "after", "after_id", "n_chars")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of the text with its last third replaced, and their likeness.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), whole)
    name = F.unhex(F.md5(name.cast("binary"))).alias("key")
    listed = docs.select(F.col(key).alias("doc_id"), name, F.length(whole).alias("n_chars"))
    follows = materialise(next_documents(listed), "spot-next")

    # Both joins read the same columns of the texts, so that one exchange serves both.
    rows = docs.select(name, whole.alias("text"))
    given = rows.join(follows, "key").select(
        F.col("after").alias("key"),
        F.struct("after_id", F.expr("substring(text, 1, n_chars div 3)").alias("start"), fingerprint(F.col("text")).alias("next_print")).alias("given"),
    )
    given = given.groupBy("key").agg(F.first("given").alias("given"))
    met = rows.join(given, "key").select(F.col("given.after_id").alias("doc_id"), "text", F.length("text").alias("n_chars"), "given.start", "given.next_print")
    met = met.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - n_chars div 3)"), F.col("start")))
    met = met.withColumn("own", signatures(F.col("text"))).withColumn("changed", signatures(F.col("edited")))
    met = met.withColumn("following", members(F.col("next_print")))
    return met.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def length_part(n: Column, like: float = LIKE) -> Column:
    """The part of a set length: sets alike to ``like`` stand in parts that differ by one at most."""
    return F.floor(F.log(n) / F.log(F.lit(1 / like)) + 1e-9).cast("int")


def near_pairs(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """``(a, b, likeness)``: different fingerprints of ``prints (fingerprint)`` that are alike to ``like`` or more.

    ``a`` and ``b`` are fingerprints, a before b by length and text; equal ones are one. Sets meet in a bucket of a
    rare signature and a length part, as the shorter of the two in its own part, as the longer in its own and the one below.
    """
    sets = materialise(prints.select("fingerprint").distinct().withColumn("s", members(F.col("fingerprint"))).withColumn("n", F.size("s")), "spot-sets")
    single = sets.select("fingerprint", "n", F.explode("s").alias("sig"))
    counts = single.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A signature of one set alone leads nowhere, but it fills a place before the common ones.
    shared = single.join(counts, "sig").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("shared"))
    lead = F.col("n") - F.ceil(F.lit(like) * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("shared"))
    rare = shared.where(lead > 0).select("fingerprint", "n", F.explode(F.slice("shared", F.lit(1), lead)).alias("x"))
    rare = materialise(rare.select("fingerprint", "n", F.col("x.sig").alias("sig")).withColumn("part", length_part(F.col("n"), like)), "spot-rare")
    shorter = rare.select(F.col("fingerprint").alias("a"), F.col("n").alias("an"), "sig", "part")
    longer = rare.select(F.col("fingerprint").alias("b"), F.col("n").alias("bn"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    fits = (F.struct("an", "a") < F.struct("bn", "b")) & (F.col("an") >= F.lit(like) * F.col("bn") - 1e-9)
    found = shorter.join(longer, ["sig", "part"]).where(fits).select("a", "b").distinct()
    alike = likeness(members(F.col("a")), members(F.col("b")))
    return found.withColumn("likeness", alike).where(F.col("likeness") >= like)
