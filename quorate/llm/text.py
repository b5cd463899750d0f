"""Words and contents of records, computed batch-wise in Arrow workers."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def content_of(state: str | None) -> str:
    """Claim and all evidence texts (no titles) of a JSON state, else the whole text."""
    if not state:
        return ""
    try:
        found = json.loads(state)
    except ValueError:
        return state
    if not isinstance(found, dict):
        return state
    parts = [found.get("claim")]
    evidence = found.get("evidence")
    for x in evidence if isinstance(evidence, list) else [evidence]:
        parts.append(x.get("text") if isinstance(x, dict) else x)
    return "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in parts if x is not None)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFC, lower-cased."""
    found = WORD.findall(unicodedata.normalize("NFC", text))
    return " ".join(found).lower().split(" ") if found else []


class WordHash(dict):
    """word -> 32-bit hash; bounded, so that a long-lived worker keeps a flat memory."""

    MOST = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
