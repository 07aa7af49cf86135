"""Words of many texts at once, as 64-bit hashes in one array.

A word is an unbroken run of letters and digits, after compatibility normalisation and case folding; characters
without width are dropped, and a word broken by a hyphen at a line end is one word, also across quotation
marks at the next line's start.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
BROKEN = re.compile(r"(?<=[^\W_])[-‐‑­][ \t]*(?:\r\n?|[\n\u0085  ])[ \t]*(?:[>|][ \t]*)*(?=[^\W_])")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_state: dict[str, np.ndarray] = {}


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = BROKEN.sub("", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text.casefold())


def _letters() -> np.ndarray:
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _state["letters"]


def _powers(n: int) -> np.ndarray:
    have = _state.get("powers", np.ones(1, np.uint64))
    if len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64), _MULTIPLIER, np.uint64))])
        _state["powers"] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole number."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: the words of all texts one after another, and where each text's words end."""
    joined = "\0".join(normalise(t.replace("\0", " ")) if t else "" for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_letters()[chars])
    breaks = np.flatnonzero(chars == 0)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    starts = at[first]
    place = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    parts = (chars[at].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(parts, first) + np.diff(np.append(first, len(at))).astype(np.uint64))
    return hashes, np.append(np.searchsorted(starts, breaks), len(starts))[: len(texts)]


def blocks(rows: Iterable[tuple], text_at: int, most: int = 1_000_000) -> Iterator[list[tuple]]:
    """Rows in blocks of about ``most`` characters; a longer text is a block of its own."""
    held, size = [], 0
    for row in rows:
        n = len(row[text_at] or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def document_of(ends: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))


def windows(hashes: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """For each start, the hash of the words at ``places`` after it; starts whose window would run out are left out."""
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, places[-1] + 2, dtype=np.uint64)) | np.uint64(1)
    for p in places:
        total += hashes[p : p + n] * factors[p]
    return mix(total)
