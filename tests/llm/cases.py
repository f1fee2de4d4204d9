"""Small tables for the edge cases that every operator handles, and brute-force counterparts."""

from __future__ import annotations

import random
import re

WORDS = "the of and river stone light garden window letter morning paper yellow quiet river's".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _h string, n string, kept string, spans string, "
    "node string, bucket string, bytes string, low string, rest string, row string, n_words string, removed string, "
    "_tf_id string, _TF_h string, _tf_spans string, _tf_removed string, _tf_copies string, in__tf_id string, high_symbols string, LOW_x string, _r_lang string"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def lines_of(seed: int, n: int) -> str:
    return "\n".join(prose(seed * 1000 + i, 7) for i in range(n))


def edge_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, ties, repeats, non-ASCII, one very long text, near copies."""
    base, passage = prose(1, 300), prose(2, 120)
    near = base.split()
    near[150] = "changed"
    shared = lines_of(7, 12)
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n\r\x0b\x0c "),
        (7, "short"),
        (8, prose(3, 90) + " " + passage + " " + prose(4, 50)),
        (9, prose(5, 60) + "\n" + passage + "\n" + prose(6, 20)),
        (10, "é" * 700 + "ß" * 3),
        (11, "ab" * 900),
        (12, prose(9, 8) + "\n" + shared + "\n" + prose(10, 8)),
        (13, prose(11, 5) + "\n" + prose(12, 9) + "\n" + shared),
        (14, prose(13, 30_000)),
        (15, "one two three"),
        (16, "one two three"),
        (17, "##### $$$ %%% ||| " * 20),
        (18, "日本語 テキスト " * 40 + "\U0001f600 emoji"),
        (None, prose(14, 40)),
        (None, prose(15, 40)),
        (20, prose(16, 100)),
        (20, prose(16, 100)),
        (20, prose(17, 100)),
    ]


def docs(spark, rows=None):
    rows = edge_texts() if rows is None else rows
    extra = ("x",) * 21
    full = [(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 3 == 0 else "s", 1) + extra for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return docs(spark, [])


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
