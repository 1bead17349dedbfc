"""Levenshtein automata over tries, against the edit table."""

import random

import numpy as np
import pytest

from veritext.operators import trie


def edits(a, b):
    """Damerau-Levenshtein distance by the full table with the last places of the letters."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        row = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), row
            same = a[i - 1] == b[j - 1]
            row = j if same else row
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def walked(queries, allowed, vocabulary):
    got = {}
    for q, v, cost in trie.walk(trie.Trie(vocabulary), trie._codes(queries), np.array([len(t) for t in queries]), np.array(allowed, "i1")):
        for a, b, c in zip(q, v, cost, strict=True):
            assert (queries[a], vocabulary[b]) not in got
            got[queries[a], vocabulary[b]] = int(c)
    return got


@pytest.mark.parametrize("seed", range(6))
def test_walk_equals_the_edit_table(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "WALK", rng.choice([3, 50, 400_000]))
    letters = rng.choice(["ab", "abcd", "aż漢😀"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 9)))
    vocabulary, queries = sorted({word() for _ in range(150)}), sorted({word() for _ in range(30)})
    allowed = [rng.randrange(3) for _ in queries]
    want = {(q, v): e for q, n in zip(queries, allowed, strict=True) for v in vocabulary if (e := edits(q, v)) <= n}
    assert walked(queries, allowed, vocabulary) == want


def test_swaps_with_a_letter_between():
    assert edits("ca", "abc") == 2 and edits("abc", "ca") == 2
    assert walked(["ca", "abc"], [2, 2], ["abc", "ca"]) == {("ca", "abc"): 2, ("ca", "ca"): 0, ("abc", "abc"): 0, ("abc", "ca"): 2}


def test_expansions_are_the_same_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    vocabulary = spark.createDataFrame([(w,) for w in words] + [("long" * 100,), ("",)], "vterm string").repartition(5)
    queries = spark.createDataFrame([(w, 1 + len(w) % 2) for w in words[::7]] + [("long" * 99 + "lung", 2), ("", 0)], "term string, k int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(trie.expansions(queries, vocabulary))
    assert ("long" * 99 + "lung", "long" * 100, 1) in want and ("", "", 0) in want and len(want) > 500
    monkeypatch.setattr(trie, "QUERY_BLOCK", 10)
    monkeypatch.setattr(trie, "BLOCK_TERMS", 17)
    assert rows(trie.expansions(queries, vocabulary)) == want
    assert rows(trie.expansions(queries.limit(0), vocabulary)) == [] == rows(trie.expansions(queries, vocabulary.limit(0)))


def test_a_step_makes_bounded_rows(monkeypatch):
    """Rows of a step are bounded after its children are listed, not before."""
    from veritext.operators import trie as TR

    terms = sorted({a + b + c for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl"})
    queries = sorted({a + b + "xy" for a in "abcd" for b in "abcd"})
    codes, length, edits = TR._codes(queries), np.array([len(q) for q in queries]), np.full(len(queries), 2, "i1")
    found = lambda: sorted((int(q), int(v), int(c)) for qs, vs, cs in TR.walk(TR.Trie(terms), codes, length, edits) for q, v, c in zip(qs, vs, cs, strict=True))
    whole, sizes, real = found(), [], TR._step
    monkeypatch.setattr(TR, "WALK", 50)
    monkeypatch.setattr(TR, "_step", lambda codes, length, query, *a: sizes.append(len(query)) or real(codes, length, query, *a))
    assert found() == whole and whole and max(sizes) <= 50
