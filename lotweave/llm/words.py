"""Words and runs of words of a text, in numpy."""

from __future__ import annotations

import re

import numpy as np

#: A word is one of the longest runs of letters and digits.
find_words = re.compile(r"[^\W_]+").findall


def word_ids(text: str) -> tuple[np.ndarray, int]:
    """The text's words in lower case as numbers from 0, and how many there are."""
    return number_words([w.lower() for w in find_words(text)])


def number_words(words: list[str]) -> tuple[np.ndarray, int]:
    """Words as numbers from 0, and how many different ones there are."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return ids, len(known)


def distinct_runs(ids: np.ndarray, kinds: int, length: int) -> tuple[int, int]:
    """(runs, distinct runs) of ``length`` successive words; exact for texts of any size."""
    n = len(ids) - length + 1
    if n < 1:
        return 0, 0
    runs, space = ids[:n], kinds
    for k in range(1, length):
        if space * kinds >= 1 << 62:  # name the runs so far anew, in fewer numbers
            _, runs = np.unique(runs, return_inverse=True)
            space = int(runs.max()) + 1
        runs, space = runs * kinds + ids[k : k + n], space * kinds
    return n, len(np.unique(runs))
