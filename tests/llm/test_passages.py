"""Repeated passages against windows compared word by word."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritext.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """Per row: words, removed, intervals, kept text."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for j in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[j:j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = np.zeros(len(w) + 2, bool)
        for j in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[j:j + window])] < i:
                gone[j + 1:j + window + 1] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        spans = [tuple(x) for x in edge.reshape(-1, 2).tolist()]
        out.append((i, len(w), int(gone.sum()), spans, " ".join(x for x, g in zip(w, gone[1:], strict=False) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def found(df):
    rows = [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept_text) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "A", "é", "x\x85y", f"w{rng.randrange(400)}"])
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (6, 7, 9, 40, 300)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(0, 30))
            parts += p[:rng.randrange(1, len(p) + 1)] if p and rng.random() < 0.3 else p
        out.append((i - 5, "".join(w + rng.choice([" ", "\n", " \t", "\x0b"]) for w in parts)))
    copy = out[50][1]
    return out + [(900 + i, copy) for i in range(30)] + [(901, copy), (901, copy + " tail of another text here"), (None, copy), (950, None), (951, ""), (952, " \n"), (953, "a " * 5000), (954, "a " * 4000)]


@pytest.mark.parametrize("chunk, ranges", [(1_000_000, 1_000_000), (200, 100)])
def test_passages_equal_brute_force(spark, docs, monkeypatch, chunk, ranges):
    """One chunk, and many that must meet in many ranges."""
    monkeypatch.setattr(passages, "CHUNK_WORDS", chunk)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id long, text string, id string, key long, spans string").repartition(6)
    want = brute(docs, 8)
    assert sum(r[2] > 0 for r in want) > 60
    assert found(passages.without_passages(df, window=8, range_windows=ranges)) == want


def test_shuffled_removals_equal_broadcast_ones(spark, docs, monkeypatch):
    monkeypatch.setattr(passages, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(docs, "doc_id int, text string")
    assert found(passages.without_passages(df, window=8)) == brute(docs, 8)


def test_empty_table(spark):
    got = passages.without_passages(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "removed", "kept_text"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=80), st.integers(1, 20))
def test_equal_windows_have_equal_hashes(words, window):
    main, check = passages.window_hashes(passages._word_hashes([b"%d" % w for w in words]), window)
    windows = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    assert len(main) == len(windows)
    assert len(set(zip(main.tolist(), check.tolist(), strict=True))) == len(set(windows))
