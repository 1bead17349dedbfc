"""Likeness of long texts with shifts and scattered edits."""

import random

import pytest

from veritext.llm.fingerprints import PrefixHash, code_points, likeness


def near(a, b):
    return likeness(*(PrefixHash(code_points(t)).fingerprint() for t in (a, b)))


@pytest.fixture(scope="module")
def text():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(words) for _ in range(20_000))[:100_000]


@pytest.mark.parametrize("at", [0, 1, 10_000, 50_000, 99_999])
def test_insertions_and_deletions(text, at):
    assert 0.95 < near(text, text[:at] + "#" + text[at:]) < 1
    assert 0.95 < near(text, text[:at] + text[at + 1:]) < 1


@pytest.mark.parametrize(("edits", "least"), [(100, 0.95), (300, 0.88)])
def test_scattered_edits(text, edits, least):
    rng = random.Random(edits)
    codes = list(text)
    for i in rng.sample(range(len(codes)), edits):
        codes[i] = rng.choice(["#", "", "##"])
    assert least < near(text, "".join(codes)) < 1


def test_shares_of_moved_and_strange_text(text):
    rng = random.Random(5)
    other = "".join(rng.choice("abcdefghij ") for _ in range(100_000))
    assert near(text, other) < 0.02
    assert near(text, text[50_000:] + text[:50_000]) > 0.95
    assert near(text, "#" + text[:60_000]) == pytest.approx(0.6, abs=0.1)
    assert near(text, text[:70_000] + other[:30_000]) == pytest.approx(0.7, abs=0.02)
    assert near("x" * 100_000, "x" * 50_000) == pytest.approx(0.5, abs=0.02)
    assert near(text[:500], "#" + text[:500]) > 0.95
