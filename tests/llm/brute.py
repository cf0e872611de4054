"""Plain Python versions of the operators, for small fixtures."""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text: str | None) -> dict:
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit, times = set(), Counter(grams)
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= {i, i + 1, i + 2}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
        "n_repeat_words": len(hit), "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
