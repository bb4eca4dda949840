import random
import re

import regex

from trialkit.llm import bpe


def test_latin_texts_are_cut_alike_by_the_plain_pattern():
    """All characters up to U+00FF, alone and in random company; other texts keep the pattern of Unicode classes."""
    plain, full = re.compile(bpe.LATIN_PIECES), regex.compile(bpe.PIECES)
    every, rng = [chr(i) for i in range(256)], random.Random(1)
    often = [*" \t\n\r'aZé0²« \u0085\x1c", "'re", "'ll", "'s", "  ", " \n"]
    texts = ["", *every, *(a + b for a in every for b in " 'a0.\n "), *("".join(rng.choices(often, k=rng.randrange(40))) for _ in range(5000)), *("".join(rng.choices(every, k=40)) for _ in range(2000))]
    for text in texts:
        assert bpe._latin(text) and plain.findall(text) == full.findall(text), repr(text)
    assert not bpe._latin("aĀ") and not bpe._latin("日本")
