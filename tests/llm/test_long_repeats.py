"""The labeller of repeats on texts of any length."""

import random

from semlake.llm import quality


def test_length_does_not_hide_repeats():
    at = quality.JUNK.index("repeats")
    rng = random.Random(1)
    some, many = [f"w{i}" for i in range(60)], [f"w{i}" for i in range(1500)]
    for n in (300, 399, 400, 401, 2000, 20_000):
        assert quality.votes(" ".join(rng.choice(some) for _ in range(n)).encode())[0][at] == "-"
    for n in (300, 400, 20_000):  # of a language's frequent words, few are different in a long clean text
        assert quality.votes(" ".join(rng.choice(many) for _ in range(n)).encode())[0][at] == "0"
