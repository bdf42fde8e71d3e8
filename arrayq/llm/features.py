"""Counts that quality operators take from whole texts, for a batch at a time."""

from __future__ import annotations

import numpy as np

from . import words as W


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


SYMBOLS = _table("#*$%&|<>")
UPPER, DIGIT, MARKS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("!?")


def per_text(w: W.Words, at: np.ndarray) -> np.ndarray:
    """How many of the sorted byte positions fall into each text."""
    return np.diff(np.searchsorted(at, w.offsets))


def word_chars(w: W.Words) -> np.ndarray:
    """Code points in words, for each text."""
    begins = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    total = np.concatenate([[0], np.cumsum(begins[w.end] - begins[w.start])])
    return np.diff(total[w.first])


def repeats(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries have an equal one of the same owner."""
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(key), bool)
    out[order] = np.append(False, same) | np.append(same, False) if len(key) else False
    return out


def repeat_words(w: W.Words, h: np.ndarray, k: int = 8) -> np.ndarray:
    """Words inside k-word windows that a text has twice or more, for each text."""
    at = np.flatnonzero(W.inside(w.first, k, len(h)))
    hit = at[repeats(W.grams(h, k, 61)[at], w.text_of[at])] if len(at) else at
    change = np.zeros(len(h) + k + 1, np.int64)
    change[hit] += 1
    change[hit + k] -= 1
    total = np.concatenate([[0], np.cumsum(np.cumsum(change)[: len(h)] > 0)])
    return np.diff(total[w.first])


def lines(w: W.Words) -> W.Words:
    """The \\n-split lines that have a word, as byte ranges."""
    cut = np.flatnonzero(w.buf == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], cut + 1]))
    start = start[start < len(w.buf)]
    stop = np.searchsorted(cut, start)
    end = np.minimum(np.append(cut, len(w.buf))[stop], w.offsets[np.searchsorted(w.offsets, start, "right")] if len(start) else 0)
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[full], end[full]
    return W.Words(w.buf, start, end, np.searchsorted(start, w.offsets), w.offsets)


def duplicate_lines(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier line, and all lines with a word."""
    x = lines(w)
    h, owner = W.hash_words(x), x.text_of
    order = np.lexsort((h, owner))
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]))[: len(h)]
    return np.bincount(owner[order][again], minlength=len(w.first) - 1), x.counts
