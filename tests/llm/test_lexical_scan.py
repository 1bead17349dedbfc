"""The automaton scan against scores computed document by document."""

import math
import random
import re
from collections import Counter

import pytest

from veritext.llm import lexical_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, c, sum(c.values())) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c, n in bags:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    word = lambda: f"{rng.choice(['W', 'w', 'é', 'x\x85', 'İ', 'ǅ'])}{int(rng.paretovariate(0.6)) % 200}"
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "--", "_", "\x00", "'", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)] + [(500, None), (501, ""), (502, " -- "), (503, text(20_000)), (7, "w1 w2"), (None, "w1 w2"), (None, "w1 w2")]
    docs += [(600 + i, "w1 w1 w3 W1") for i in range(70)]                     # ties beyond k
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (3, "w1 w2 w3"), (None, "w1"), (93, "w1 w1 W1"), (94, "w"), (95, "1")]
    return docs, items


@pytest.mark.parametrize("k", [1, 50])
def test_ranks_equal_brute_force(spark, tables, k, monkeypatch):
    docs, items = tables
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, n long").repartition(5)
    i = spark.createDataFrame([(*r, "x", 2) for r in items], "item_id long, text string, doc_id string, score long").repartition(3)
    want = brute(docs, items, k)
    assert found(lexical_scan.ranked_search(d, i, k)) == want and len(want) > 25
    for name, value in (("CELLS", 100), ("HELD", 40)):
        monkeypatch.setattr(lexical_scan, name, value)
    assert found(lexical_scan.ranked_search(d, i, k, block_chars=60, block_items=4)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs, asked in ((none, items), (blank, items), (blank, items.limit(0)), (blank.limit(0), items.limit(0))):
        got = lexical_scan.ranked_search(docs, asked)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_keep_their_bounds():
    assert lexical_scan.terms_of("Ab\x00aB-é\x85É x".encode()) == ["ab", "ab", "é\x85É", "x"]
    assert lexical_scan.terms_of(None) == []
