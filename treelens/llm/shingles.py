"""Hashed word shingles of many texts at once.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is a run of words,
or the whole of a shorter text. Both are 64-bit hashes, made for a few megabytes of text at a time
with array operations; a longer text is cut at white space first, so memory doesn't grow with it.
"""

from __future__ import annotations

import re

import numpy as np

from treelens.llm.tokens import _BYTES, _U64, mix, spans_hash

PART = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = _BYTES[_LOWER]
_BREAK = re.compile(rb"[\x09-\x0d\x20]")


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends, in bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    starts, ends = word_spans(data)
    return starts, spans_hash(np.frombuffer(data, np.uint8), starts, ends, _TABLE)


def _parts(text: bytes) -> list[bytes]:
    out = []
    while len(text) > PART and (m := _BREAK.search(text, PART)):
        out.append(text[: m.start()])
        text = text[m.start() :]
    return [*out, text]


def words(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
    group: list[int] = []
    size = 0

    def flush() -> None:
        starts, hashes = _hashes(b" ".join(texts[i] for i in group))
        begins = np.cumsum([0, *[len(texts[i]) + 1 for i in group]])
        cuts = np.searchsorted(starts, begins)
        for j, i in enumerate(group):
            out[i] = hashes[cuts[j] : cuts[j + 1]]
        group.clear()

    for i, text in enumerate(texts):
        if len(text) > PART:
            out[i] = np.concatenate([_hashes(p)[1] for p in _parts(text)])
            continue
        if group and size + len(text) > PART:
            flush()
            size = 0
        group.append(i)
        size += len(text) + 1
    if group:
        flush()
    return out


def of(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """The hash of every run of so many words, with repeats; of all words if there are fewer; none if there are none."""
    n = min(width, len(word_hashes))
    if not n:
        return word_hashes
    count = len(word_hashes) - n + 1
    total = np.full(count, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for j in range(n):
        total += word_hashes[j : j + count] * _U64(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
    return mix(total)
