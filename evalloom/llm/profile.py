"""Counts of one text that several quality operators share, on UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word window found twice or more among the word ids, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code, top = ids[:n].astype(np.int64), int(ids.max()) + 1
    size = top
    for j in range(1, window):
        if size > (1 << 62) // top:  # the codes would overflow: number them anew, exactly
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code = code * top + ids[j : j + n]
        size *= top
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = code[1:] == code[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge)[: len(ids)]))


def rule_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, space bytes, n_symbols, n_dup_lines, n_repeat_words, distinct words of one text."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - len(text.translate(None, SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(number) < len(words) else 0,
        len(number),
    )
