"""The prefix trie against a trie built conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

from tests.conftest import SF_SMALL
from veritext.llm import prefix_trie, queries


def rebuilt(turns_of):
    out = {}
    for c, own in turns_of.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(turns_of.get(base, ())[:h]) + tuple(own[h:])
    return out


def brute(rows):
    """rows: (conv, turn, role, text), turns of one number in no particular order are not tested here."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    whole = rebuilt({c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in by.items()})
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    nodes = {p: [min(m), len(p), min(members[p[:-1]]) if p else None, len(m), 0, 0, 0, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()] for p, m in members.items()}
    for p in nodes:
        if p:
            nodes[p[:-1]][4] += 1
    for p, row in nodes.items():
        gain = (row[3] - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            nodes[p[:d]][5] += row[4] == 0
            nodes[p[:d]][6] += gain
    return sorted(map(tuple, nodes.values()), key=lambda r: (r[1], r[0]))


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def conversations(rng):
    rows, say = [], lambda: rng.choice(["", "yes", "no", "żółć 😀", "a longer text that many share", f"own {rng.randrange(10 ** 6)}"])
    for c in [*range(0, 40), *range(100, 140), 205, -3, -250, 10 ** 12 + 7, 10 ** 12]:
        n = rng.choice([1, 1, 2, 3, 6, 9]) if c != 13 else 60
        rows += [(c, rng.choice([None, 0]) if i == 0 else 3 * i, "user" if i % 2 == 0 else rng.choice(["assistant", None]), say() if rng.random() < 0.9 else None) for i in range(n)]
    return rows + [(None, 0, "user", "belongs to none")]


def test_trie_equals_brute_force(spark, monkeypatch):
    """Small chunks and blocks, so that prefix digests, list ranking and prefix sums run across them."""
    rows = conversations(random.Random(8))
    schema = "conv_id long, turn long, role string, text string, depth string, node long, at string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).repartition(6)
    want = brute(rows)
    assert len(want) > 150 and any(r[4] > 5 for r in want)      # the fixture branches
    assert found(prefix_trie.prefix_trie(df)) == want
    for name, value in (("PREFIX_CHUNK", 4), ("BLOCK_BITS", 3), ("TOUR_CHUNK", 16)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert found(prefix_trie.prefix_trie(df)) == want


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    # a conversation whose turns all come after the lead it lacks, or that has none of its own left
    only = [(1, 5, "user", "x")]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(only, schema))) == brute(only)
    same = [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (300, 1, "user", "z" * 100_000)]     # repeated rows are turns each
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(same, schema))) == brute(same)


def test_turns_of_one_number_have_one_order(spark):
    rows = [(100, 1, r, t) for r in "ab" for t in ("x", "y", None)] + [(100, None, "c", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.prefix_trie(df)) == found(prefix_trie.prefix_trie(df.repartition(5)))


def test_list_ranking(spark, monkeypatch):
    """A list in random order over many blocks: nearly every block is entered."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 1)
    arcs = list(range(300))
    random.Random(1).shuffle(arcs)
    pairs = [(a, b) for a, b in zip(arcs, [*arcs[1:], None], strict=True)]
    got = {r.arc: r["rank"] for r in prefix_trie.rank_list(spark.createDataFrame(pairs, "arc long, succ long"), 300).collect()}
    assert got == {a: 299 - i for i, a in enumerate(arcs)}


def test_driver_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, SF_SMALL)) == brute(rows)
