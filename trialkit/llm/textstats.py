"""Dense counts of whole texts, for classifiers: one array per count, one entry per document."""

from __future__ import annotations

import numpy as np

from trialkit.llm import words


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER = _set(bytes(range(0x41, 0x5B))), _set(bytes(range(0x61, 0x7B)))
_DIGIT, _SHOUT = _set(b"0123456789"), _set(b"!?")
_SYMBOL, _PUNCT = _set(b"#*$%&|<>@~^_=+/\\{}[]"), _set(b".,;:'\"()-")
_MASK = _set(b"0123456789@$*")
_ASCII_LETTER = _UPPER | _LOWER


def blank_words(data: np.ndarray, at: np.ndarray) -> words.Words:
    return words.split(data, at, words.BLANKS)


def per_word(mask: np.ndarray, found: words.Words, base: int) -> np.ndarray:
    """Number of marked bytes in each word."""
    if not len(found.start):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(found.start), np.int64)
    edges[0::2], edges[1::2] = found.start - base, found.end - base
    return np.add.reduceat(np.append(mask, False), edges, dtype=np.int64)[0::2]


def profile(data: np.ndarray, at: np.ndarray, found: words.Words | None = None) -> dict[str, np.ndarray]:
    """Counts of bytes, characters, letters, capitals, marks, lines, words and kinds of words of every document."""
    found = found or blank_words(data, at)
    base, body = int(at[0]), data[at[0] : at[-1]]
    total = lambda mask: words.per_document(mask, at)
    of_words = lambda mask: words.per_document(mask, found.first)
    upper, letters = per_word(_UPPER[body], found, base), per_word(_ASCII_LETTER[body] | (body >= 0x80), found, base)
    lower = per_word(_LOWER[body] | (body >= 0x80), found, base)
    masked, size = per_word(_MASK[body], found, base), found.end - found.start
    key = words.mix(found.hash + words.mix(found.doc.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
    _, once = np.unique(key, return_index=True)
    distinct = np.zeros(len(key), bool)
    distinct[once] = True
    runs = np.zeros(len(body), bool)
    runs[2:] = (body[2:] == body[1:-1]) & (body[1:-1] == body[:-2]) & ~_DIGIT[body[2:]] & (body[2:] > 0x20)
    lines = words.split(data, at, words.LINES)
    line_key = words.mix(lines.hash + words.mix(lines.doc.astype(np.uint64) + np.uint64(0x9E6C63D0876A9A47)))
    _, first = np.unique(line_key, return_index=True)
    new_line = np.zeros(len(line_key), bool)
    new_line[first] = True
    return {
        "words": found.counts, "chars": total((body & 0xC0) != 0x80), "word_bytes": of_words(size), "upper": total(_UPPER[body]), "letters": total(_ASCII_LETTER[body] | (body >= 0x80)),
        "digits": total(_DIGIT[body]), "shout": total(_SHOUT[body]), "symbols": total(_SYMBOL[body]), "punct": total(_PUNCT[body]), "beyond": total(body >= 0xC0),
        "capital_words": of_words((upper > 1) & (lower == 0)), "mixed_words": of_words((letters > 1) & (masked > 0) & (letters > masked) & (size < 24)),
        "distinct": of_words(distinct), "runs": total(runs), "lines": np.diff(lines.first), "new_lines": words.per_document(new_line, lines.first),
        "bare_words": of_words(letters == 0), "long_words": of_words(size > 24), "one_byte": of_words(size == 1),
    }
