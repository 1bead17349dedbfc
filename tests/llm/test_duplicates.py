"""Components, near-duplicate documents and fuzzy lines, against brute force."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from veritext.llm import candidates, components, lines, neardup, queries

class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def close(items, similar):
    """Smallest member of every item's component, comparing all pairs."""
    u, keys = Union(items), list(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if similar(items[a], items[b]):
                u.join(a, b)
    return {k: u.find(k) for k in keys}


def jaccard(percent):
    return lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("find", [components.star_components, components.union_find])
def test_components(spark, find):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)] + [(5, 5)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in find(spark.createDataFrame(edges + edges[:9], "u long, v long")).collect()}
    assert got == {n: u.find(n) for e in edges if e[0] != e[1] for n in e}
    assert find(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\né\x85", max_size=40))
def test_shingle_set_size(text):
    assert len(neardup.shingle_set(text)) == len(word_shingles(text))


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies, one larger than a small bucket, with outsiders; odd texts."""
    rng = random.Random(5)
    base = lambda n: " ".join(f"t{rng.randrange(10 ** 5)}" for _ in range(n))
    texts = [None, "", " \n", "one", "One", "one two three", "a b c d e", "A b c d\te", "x " * 4000, "x " * 4001]
    for n, changes in ((3, 2), (70, 9), (70, 4), (8, 3)):
        texts += variants(rng, base(80), n, changes)
    texts += [base(60) for _ in range(30)]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows = [(i + 10, t, "x", i) for i, t in enumerate(corpus)] + [(None, corpus[5], "x", 0), (10, corpus[0], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, signature long").repartition(7)
    got = neardup.near_duplicates(df).collect()
    sets = {i + 10: word_shingles(t) for i, t in enumerate(corpus)}
    right = close(sets, jaccard(75))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), right[r.doc_id], right[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_outsiders_are_compared_in_blocks(spark, corpus, monkeypatch):
    """With small buckets of two and one centre, blocks must find the rest."""
    monkeypatch.setattr(candidates, "SMALL_BUCKET", 2)
    monkeypatch.setattr(candidates, "CENTRES", 1)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 5)
    sets = {i: word_shingles(t) for i, t in enumerate(corpus)}
    right = close(sets, jaccard(75))
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == right


def test_near_duplicates_of_driver_documents(spark):
    docs = {r.doc_id: word_shingles(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    right = close(docs, jaccard(75))
    assert {r.doc_id: r.component_id for r in queries.op6_near_duplicates(spark, SF_SMALL).collect()} == right


def line_shingles(norm):
    """Every window of five characters; of a shorter line the line."""
    return frozenset(norm[i:i + 5] for i in range(max(1, len(norm) - 4)))


def keepers(docs, percent=80):
    """The kept line for every line, comparing all pairs of distinct lines."""
    first = {}
    for key in sorted(docs):
        for i, line in enumerate((docs[key] or "").split("\n")):
            norm = line.strip(" \t\r").lower()
            if norm:
                first.setdefault(norm, (key, i))
    sets = {n: line_shingles(n) for n in first}
    label = close(sets, jaccard(percent))
    head = {}
    for n, c in label.items():
        head[c] = min(head.get(c, first[n]), first[n])
    return {n: head[c] for n, c in label.items()}


@pytest.fixture(scope="module")
def line_docs():
    rng = random.Random(9)
    base = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    pool = [v for n, changes in ((4, 2), (60, 6), (60, 2)) for v in variants(rng, base(40), n, changes)] + [base(12) for _ in range(60)]
    pool += ["Yes.", " yes. ", "", "  ", "https://example.com/a/very/long/path", "https://example.com/a/very/long/road", "z" * 20_000, "\x85  odd"]
    rng.shuffle(pool)
    docs = {i: "\n".join(pool[j] for j in range(i, len(pool), 40)) for i in range(40)}
    docs |= {90: None, 91: "", 92: pool[3], 93: docs[0], 94: docs[0] + "\nnew line of its own here"}
    return docs


def test_lines_equal_brute_force(spark, line_docs):
    right = keepers(line_docs)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in line_docs.items()] + [(None, "Yes.", "x", 1)], "doc_id long, text string, key string, node long").repartition(5)
    got = lines.line_components(df).collect()
    assert len(got) == 1 + sum(len((t or "").split("\n")) for t in line_docs.values())
    for r in got:
        if r.id is None:
            assert r.kept
            continue
        norm = (line_docs[r.id] or "").split("\n")[r.line_no].strip(" \t\r").lower()
        want = right[norm] if norm else (r.id, r.line_no)
        assert (r.keeper_id, r.keeper_line_no, r.kept) == (*want, want == (r.id, r.line_no))
    assert lines.line_components(df.limit(0)).count() == 0


def test_dedup_lines_rewrites_documents(spark, line_docs):
    right = keepers(line_docs)
    df = spark.createDataFrame([(k, t, "x") for k, t in line_docs.items()] + [(None, "Yes.", "y")], "doc_id long, text string, mask string")
    want = {None: "Yes."}
    for k, t in line_docs.items():
        all_lines = (t or "").split("\n")
        own = lambda i, line: not line.strip(" \t\r") or right[line.strip(" \t\r").lower()] == (k, i)  # noqa: B023, E731
        kept = [x for i, x in enumerate(all_lines) if own(i, x)]
        if len(kept) == len(all_lines) or any(x.strip(" \t\r") for x in kept):
            want[k] = t if len(kept) == len(all_lines) else "\n".join(kept)
    got = lines.dedup_lines(df)
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == want


def test_lines_of_driver_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    right, seen = keepers(docs), defaultdict(int)
    for r in queries.op9_lines(spark, SF_SMALL).collect():
        norm = docs[r.doc_id].split("\n")[r.line_no].strip(" \t\r").lower()
        seen[r.kept] += 1
        if norm:
            assert (r.keeper_doc_id, r.keeper_line_no) == right[norm]
    assert seen[True] and seen[False]


def test_main_path_of_lines_and_mixing_is_native(spark):
    for query in (queries.op8_mixing, queries.op9_lines):
        plan = query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
