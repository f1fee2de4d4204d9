"""Longest-common-subsequence helpers, called from Arrow batches.

Rows of the length table are kept as bit vectors in Python integers (the row-update by
addition and masking published by Hyyro, 2004), so a pair of whole documents costs
``len(a) * len(b) / 64`` machine steps and the full table of a sentence pair stays small.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain
from typing import Sequence


def _positions(tokens: Sequence[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for index, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | (1 << index)
    return masks


def _rows(outer: Sequence[str], inner: Sequence[str], masks: dict[str, int] | None = None):
    """Yield one bit vector per token of ``outer``; a zero bit j marks a length step at inner[j]."""
    masks = _positions(inner) if masks is None else masks
    full = (1 << len(inner)) - 1
    row = full
    for token in outer:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def lcs_length(left: Sequence[str], right: Sequence[str]) -> int:
    if len(left) > len(right):
        left, right = right, left
    row = (1 << len(right)) - 1
    for row in _rows(left, right):
        pass
    return len(right) - row.bit_count()


def lcs_indices(reference: Sequence[str], candidate: Sequence[str], masks: dict[str, int] | None = None) -> list[int]:
    """Reference positions on one longest common subsequence.

    Walks back from the ends; on a tie between dropping the last candidate token and
    dropping the last reference token, the reference token goes. So reference tokens that the
    candidate does not have are passed by, and need no row of the table.
    """
    masks = _positions(candidate) if masks is None else masks
    common = [i for i, token in enumerate(reference) if token in masks]
    width = len(candidate)
    table = [(1 << width) - 1, *_rows([reference[i] for i in common], candidate, masks)]
    found: list[int] = []
    i, j = len(common), width
    while i > 0 and j > 0:
        match, below = masks[reference[common[i - 1]]], (1 << j) - 1
        if not match >> (j - 1) & 1 and (table[i] & below).bit_count() < (table[i - 1] & below).bit_count():
            # The last reference token makes it longer: candidate tokens go up to a match, or a length step of this row.
            j = ((match | ~table[i]) & below).bit_length()
        if match >> (j - 1) & 1:
            found.append(common[i - 1])
            j -= 1
        i -= 1
    return found[::-1]


def _covered(sentence: Sequence[str], others: list[tuple[str, ...]], holders: dict[str, list[int]], masks: list[dict[str, int] | None]) -> list[int]:
    """Positions of ``sentence`` on its subsequences with any of ``others``.

    A sentence with one position in common covers it. Of the rest, only those are compared that could add a position.
    """
    shared: dict[int, int] = {}
    for token, places in _positions(sentence).items():
        for k in holders.get(token, ()):
            shared[k] = shared.get(k, 0) | places
    covered, several = 0, []
    for k, places in shared.items():
        if places & (places - 1):
            several.append(k)
        else:
            covered |= places
    for k in several:
        if shared[k] & ~covered:
            if masks[k] is None:
                masks[k] = _positions(others[k])
            for index in lcs_indices(sentence, others[k], masks[k]):
                covered |= 1 << index
    return [index for index in range(len(sentence)) if covered >> index & 1]


def union_hits(reference: Sequence[Sequence[str]], candidate: Sequence[Sequence[str]]) -> int:
    """Clipped number of reference tokens covered by the union of sentence-wise subsequences.

    Repeated sentences are compared once on either side, and an index of the candidate's tokens leads to the sentences
    that have some in common.
    """
    others = list(dict.fromkeys(map(tuple, candidate)))
    holders: dict[str, list[int]] = {}
    for k, other in enumerate(others):
        for token in dict.fromkeys(other):
            holders.setdefault(token, []).append(k)
    masks: list[dict[str, int] | None] = [None] * len(others)
    # Every reference position is asked for once, so only the candidate's tokens can run out.
    left = Counter(chain.from_iterable(candidate))
    known: dict[tuple[str, ...], list[int]] = {}
    hits = 0
    for sentence in map(tuple, reference):
        if sentence not in known:
            known[sentence] = _covered(sentence, others, holders, masks)
        for index in known[sentence]:
            token = sentence[index]
            if left[token] > 0:
                hits += 1
                left[token] -= 1
    return hits
