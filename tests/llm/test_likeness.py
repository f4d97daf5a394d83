"""Likeness of fingerprints (operator 7) where order alone differs."""

import random

from reelspark.llm.fingerprints import fingerprint, likeness


def test_equal_roots_alone_are_wholly_alike():
    rng = random.Random(6)
    lines = [f"Line {k} says {rng.randrange(1000)}. It ends here." for k in range(400)]
    one = fingerprint("\n".join(lines))
    half = fingerprint("\n".join(lines[200:] + lines[:200]))
    assert one != half and 0.9 < likeness(one, half) == likeness(half, one) < 1
    assert fingerprint("\n".join(lines)) == one and likeness(one, one) == 1.0
    for a, b in (("", "a"), ("a\nb", "b\na"), ("a. b", "b. a"), ("", "\n")):
        x, y = fingerprint(a), fingerprint(b)
        assert (likeness(x, y) == 1.0) == (x.split(":")[0] == y.split(":")[0]) and 0 <= likeness(x, y) <= 1
