"""Tables that are rebuilt while they are read; the stored vector cache; failing rows."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.operators import embed as E
from veritext.sources import snapshots as S


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def put(spark, base, rows):
    return S.publish(spark, base, lambda path: spark.createDataFrame([(i,) for i in rows], "id long").write.parquet(path))


def test_a_reader_keeps_its_version(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        with S.pinned(spark, base):
            pass
    first = put(spark, base, [1, 2])
    with S.pinned(spark, base) as old:
        second = put(spark, base, [3])
        third = put(spark, base, [4, 5])
        assert S.remove_unread(spark, base) == [second]
        assert ids(old) == [1, 2]
        with S.pinned(spark, base) as new:
            assert ids(new) == [4, 5]
    assert S.remove_unread(spark, base) == [first] and S.current_version(spark, base) == third
    assert os.listdir(f"{tmp_path}/t/versions") == [third] and not [f for f in os.listdir(f"{tmp_path}/t/pins") if not f.endswith(".crc")]


def test_a_failed_build_changes_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    first = put(spark, base, [1])

    def fail(path):
        spark.createDataFrame([(9,)], "id long").write.parquet(path)
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        S.publish(spark, base, fail)
    assert S.current_version(spark, base) == first and os.listdir(f"{tmp_path}/t/versions") == [first]


def test_dead_readers_hold_nothing_back(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/t"
    first = put(spark, base, [1])
    S._write(spark, f"{base}/pins/{first}.dead", "")
    put(spark, base, [2])
    assert S.remove_unread(spark, base) == []
    monkeypatch.setattr(S, "PIN_SECONDS", -60)
    assert S.remove_unread(spark, base) == [first]


def test_republished_index(spark, tmp_path):
    base = f"file://{tmp_path}/index"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "id long, embedding array<double>")
    valid = E.validate_vectors(vectors, "embedding", 2)
    assert E.republish_index(valid, base).collect() == [(2, 1)]
    with S.pinned(spark, base) as old:
        assert E.republish_index(valid.filter("id = 1"), base).collect() == [(1, 0)]
        assert ids(old) == [1, 3]
    E.republish_index(valid, base)
    assert len(os.listdir(f"{tmp_path}/index/versions")) == 1


@pytest.fixture(scope="module")
def counting():
    class Counting:
        """Notes every call and its texts; fails on a batch that holds the text 'bad'."""

        dims = 2

        def __init__(self, folder):
            self.folder = folder

        def encode(self, texts):
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            if "bad" in texts:
                raise RuntimeError("cannot encode")
            return np.array([[len(t), 1.0] for t in texts])

    return Counting


def calls(folder):
    return [open(os.path.join(folder, f)).read().split("\n") for f in os.listdir(folder)]


def test_one_failing_row_of_a_thousand(spark, tmp_path, counting):
    texts = [(i, "bad" if i == 617 else f"text {i}") for i in range(1000)] + [(1000, " "), (1001, None)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    got = {r.id: r for r in E.embed_texts(df, "text", (counting, (str(tmp_path),)), error="why").collect()}
    assert [i for i in got if got[i].embedding is None] == [617, 1000, 1001]
    assert got[617].why == "RuntimeError: cannot encode" and got[1000].why is None and got[5].embedding == [6.0, 1.0]
    assert len(calls(tmp_path)) <= 2 * 11 + 1                     # a call a half, on the way down to the row


def test_second_batch_encodes_misses_only(spark, tmp_path, counting):
    (tmp_path / "calls").mkdir()
    spec, cache = (counting, (str(tmp_path / "calls"),)), f"file://{tmp_path}/cache"
    one = spark.createDataFrame([(1, "a"), (2, "bb"), (3, " a "), (4, ""), (5, None), (6, "bad")], "id long, text string").coalesce(1)
    vectors = lambda df: {r.id: r.embedding for r in df.collect()}
    want = {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None, 5: None, 6: None}
    assert vectors(E.embed_cached(one, cache, spec=spec)) == want
    before = len(calls(tmp_path / "calls"))
    assert vectors(E.embed_cached(one.filter("id < 6"), cache, spec=spec)) == {i: v for i, v in want.items() if i < 6}
    assert len(calls(tmp_path / "calls")) == before               # nothing is encoded again
    two = one.filter("id < 3").union(spark.createDataFrame([(9, "ccc"), (10, "ccc")], "id long, text string"))
    assert vectors(E.embed_cached(two, cache, spec=spec)) == {1: [1.0, 1.0], 2: [2.0, 1.0], 9: [3.0, 1.0], 10: [3.0, 1.0]}
    assert sorted(x for c in calls(tmp_path / "calls")[0:] for x in c if x == "ccc") == ["ccc"]
    other = (E.HashingEncoder, (8,))                              # another encoder's vectors are its own
    assert all(len(v) == 8 for v in vectors(E.embed_cached(two, cache, spec=other)).values())


def test_writers_of_one_text_give_no_double_rows(spark, tmp_path):
    cache, spec = f"file://{tmp_path}/cache", (E.HashingEncoder, (4,))
    df = spark.createDataFrame([(1, "x y")], "id long, text string")
    E.embed_cached(df, cache, spec=spec).count()
    E._cached(spark, cache).write.parquet(f"{cache}/batch-other")   # as a second writer of the same text leaves it
    assert E._cached(spark, cache).count() == 2
    assert E.embed_cached(df, cache, spec=spec).count() == 1
    kept = E._cached(spark, cache).agg(F.countDistinct("h")).first()[0]
    assert kept == 1
