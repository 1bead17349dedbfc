"""Quality classifier, mixing, fingerprints and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from veritext.llm import fingerprints, lines, mixing, neardup, packing, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_on_labels_it_never_saw(spark):
    """The labelled table is not used in training: it is held out as a whole."""
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in queries.op5_quality(spark, SF).collect()}
    hits = Counter((label[d], kept[d]) for d in label)
    assert hits[1, False] <= 0.01 * (hits[1, True] + hits[1, False])
    assert hits[0, True] <= 0.1 * (hits[0, True] + hits[0, False])


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = []
    for g in good:
        row = [quality.GOOD if g == (rng.random() < a) else quality.BAD for a in (0.95, 0.9, 0.85)]
        row.append(quality.NONE if rng.random() < 0.5 else quality.GOOD if g == (rng.random() < 0.8) else quality.BAD)
        votes.append("".join(map(str, row)))
    post = quality.label_model(Counter(votes))
    right = np.mean([(post[v] >= 0.5) == g for v, g in zip(votes, good, strict=True)])
    assert right > np.mean([(v[0] == str(quality.GOOD)) == g for v, g in zip(votes, good, strict=True)])   # better than the best labeller
    assert quality.label_model({}) == {}


def test_quality_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (4, "A short clean line.", 1.0), (4, "A short clean line.", 1.0), (None, "x " * 50_000, 1.0), (5, "\x00é漢", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    got = quality.with_quality(df)
    assert got.columns == df.columns
    score = {r.doc_id: r.quality_score for r in got.collect()}
    assert score[1] == score[2] == score[3] == 0 and all(0 <= s <= 1 for s in score.values()) and got.count() == len(rows)
    assert quality.with_quality(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def domains_of(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(["news", "news", "news", "code"])
        special = ["report", "minister", "city"] if kind == "news" else ["def", "return", "import"]
        rows.append((i, " ".join(rng.choice(special) if rng.random() < 0.3 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))), "x"))
        if i % 2:
            labels.append((i, kind))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "def", "x"), (3, rows[3][1], "x"), (1002, "w1 " * 20_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, p string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mixing_meets_targets(spark, domains_of):
    docs, labelled = domains_of
    got = mixing.mixing_rates(docs, labelled, {"news": 0.4, "code": 0.6, "never": 0.5}).collect()
    total = sum(r.tokens for r in got)
    assert len(got) == docs.select("doc_id").distinct().count() and all(r.rate >= 0 and abs(sum(r.p.values()) - 1) < 1e-9 for r in got)
    for name, share in (("news", 0.4), ("code", 0.6)):
        assert abs(sum(r.rate * r.tokens * r.p[name] for r in got) / total - share) < 1e-4
    kind = {r.doc_id: r.domain for r in labelled.collect()}
    assert np.mean([max(r.p, key=r.p.get) == kind[r.doc_id] for r in got if r.doc_id in kind]) > 0.9
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].tokens == 0 and by_id[1000].p == by_id[1001].p


def test_rates_equal_least_squares(spark):
    """Against projected gradient in numpy on the same posteriors."""
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.5] * 3, 300), rng.integers(0, 50, 300)
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(300)], "id long, tokens long, p array<double>")
    for targets in ([0.2, 0.5, 0.3], [0.0, 0.0, 1.0]):
        rates = mixing.fit_rates(df, targets, rounds=50)        # more than a stretch, and not a whole number of them
        got = np.array([r.rate for r in df.join(rates, "p").orderBy("id").collect()])
        start, wanted = (n[:, None] * p).sum(0), np.array(targets) * n.sum()
        miss = lambda r: ((n * r)[:, None] * p).sum(0) - wanted  # noqa: E731, B023
        rate, before, speed = np.ones(300), np.ones(300), 1.0
        for _ in range(50):
            if abs(miss(rate)).max() <= mixing.MISS * n.sum():
                break
            faster = (1 + (1 + 4 * speed ** 2) ** 0.5) / 2
            ahead = rate + (speed - 1) / faster * (rate - before)
            rate, before = np.maximum(0, ahead - p @ (miss(ahead) / start)), rate
            speed = faster if (miss(rate) ** 2 / start).sum() <= (miss(before) ** 2 / start).sum() else 1.0
        assert np.allclose(got, rate, atol=1e-8) and (got >= 0).all()
    assert abs(((n * got)[:, None] * p).sum(0) - wanted).max() < 0.3 * n.sum()


def test_mix_uses_rows_as_often_as_rated(spark, domains_of):
    docs, labelled = domains_of
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, labelled, {"news": 0.4, "code": 0.6}).collect()}
    mixed = mixing.mix(docs, labelled, {"news": 0.4, "code": 0.6})
    assert mixed.columns == docs.columns
    uses, rows = Counter(r.doc_id for r in mixed.collect()), Counter(r.doc_id for r in docs.collect())
    for key, times in rows.items():
        assert uses[key] in (times * int(rates[key]), times * (int(rates[key]) + 1))


def test_mixing_without_labels_or_rows(spark, domains_of):
    docs, labelled = domains_of
    got = mixing.mixing_rates(docs, labelled.limit(0), {"news": 1.0}).collect()
    assert {r.rate for r in got} == {1.0} and {len(r.p) for r in got} == {0}
    assert mixing.mixing_rates(docs.limit(0), labelled, {"news": 1.0}).count() == 0
    assert mixing.mix(docs, labelled.limit(0), {"news": 1.0}).count() == docs.count()


def test_prefix_hash_spans_and_extensions():
    rng = random.Random(6)
    for _ in range(200):
        s, t = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 50))) for _ in range(2))
        a, b = (fingerprints.PrefixHash(fingerprints.code_points(x)) for x in (s, t))
        i, k = rng.randrange(len(s)), rng.randrange(len(t))
        right = next((x for x in range(min(len(s) - i, len(t) - k)) if s[i + x] != t[k + x]), min(len(s) - i, len(t) - k))
        assert a.lce(i, b, k) == right
        for length in range(6):
            assert a.equal(i, b, k, length) == (i + length <= len(s) and k + length <= len(t) and s[i:i + length] == t[k:k + length])
        at = rng.randrange(len(s) + 1)
        assert a.spliced(at, fingerprints.code_points(t)).fingerprint() == fingerprints.PrefixHash(fingerprints.code_points(s[:at] + t)).fingerprint()


def test_likeness():
    fp = lambda t: fingerprints.PrefixHash(fingerprints.code_points(t)).fingerprint()
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef \U0001f600") for _ in range(5000))
    changed = text[:2500] + ("y" if text[2500] != "y" else "z") + text[2501:]
    assert fingerprints.likeness(fp(text), fp(text)) == 1 and fingerprints.likeness(fp(text), fp("")) == 0 and fingerprints.likeness(fp(""), fp("")) == 1
    assert 0.95 < fingerprints.likeness(fp(text), fp(changed)) < 1
    assert fingerprints.likeness(fp(text), fp(text[:3000])) == pytest.approx(0.6, abs=0.03)
    assert fingerprints.likeness(fp(text), fp(text[::-1])) < 0.05


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprint_edits_equal_brute_force(spark, parts):
    rng = random.Random(7)
    texts = [None, "", "a", "ab", "abc", "żółć漢\U0001f600" * 9, "x" * 200_000] + ["".join(rng.choice("abc \n") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i * i * 1000 - 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, 1, True) for k, t in rows], "doc_id long, text string, bucket int, halo boolean").repartition(parts)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[key]
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        prints = [fingerprints.PrefixHash(fingerprints.code_points(t)).fingerprint() for t in (text, edited, after)]
        assert (r.n_chars, r.edited_text, r.fingerprint, r.edited_fingerprint) == (len(text), edited, prints[0], prints[1])
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(*prints[:2]), fingerprints.likeness(prints[0], prints[2]))


def test_fingerprint_edits_odd_tables(spark):
    schema = "doc_id long, text string"
    rows = lambda data: sorted((str(r.doc_id), r.edited_text) for r in fingerprints.fingerprint_edits(spark.createDataFrame(data, schema)).collect())
    assert rows([]) == []
    assert rows([(5, "abcdef")]) == [("5", "abcdab")]
    assert rows([(None, "abcdef"), (1, "xyz")]) == [("1", "xya"), ("None", "abcdxy")]
    assert [k for k, _ in rows([(None, "a"), (2 ** 60 + 1, "b")])] == [str(2 ** 60 + 1), "None"]
    assert rows([(1, "bbb"), (1, "aaa"), (2, "ccc")]) == [("1", "aab"), ("1", "bbc"), ("2", "cca")]


def test_op10_query_columns(spark):
    df = queries.op10_fingerprints(spark, SF_SMALL)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in df.collect():
        n = len(text[r.doc_id]) // 3
        assert r.edited_sha256 == hashlib.sha256((text[r.doc_id][:len(text[r.doc_id]) - n] + text[after[r.doc_id]][:n]).encode()).hexdigest()


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name == "packing":
            assert out.agg(F.sum("length")).head()[0] == packing.pack(docs, queries.tokenizer_path()).agg(F.sum("length")).head()[0]
            break
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, Counter(r.doc_id for r in out.collect())
        if name == "quality":
            scored = {r.doc_id for r in quality.with_quality(docs).filter("quality_score >= 0.5").collect()}
            assert set(after) == scored and 0 < len(after) < len(before)
        elif name == "line_dedup":
            assert set(after) == {r.doc_id for r in lines.dedup_lines(docs).collect()}
            assert all(len(r.text) == r.n_chars for r in out.collect())
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in neardup.near_duplicates(docs).filter("kept").collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline_on_empty_and_odd_documents(spark):
    empty = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "Some clean words. " * 9, "en", "s", 162), (2, "Some clean words. " * 9, "en", "s", 162)], empty.schema)
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns
            out.collect()
        assert packing.pack(docs, queries.tokenizer_path()).count() >= 0
