"""JSON arrays read in byte ranges against Python's own parser."""

import json
import random
from collections import Counter

from veritext.sources import files as S
from veritext.sources import json_arrays as J

HARD = ['}', '{', '"', '\\', '\\\\"}{', '},{"id": "x"}', "a\nb\t ", "\U0001f600 żółć", "", None, '"}', '\\"', "]}[", "\r\n}", "{{{{"]


def chunks(rng, n):
    text = lambda: "".join(rng.choice([*(h or "" for h in HARD), "word ", "x"]) for _ in range(rng.randrange(12)))
    return [{"id": str(i), "title": rng.choice(HARD), "text": text(), "article": rng.choice(HARD), "paragraph": text()} for i in range(n)]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def as_rows(records):
    return Counter(tuple(r.get(k) for k in ("id", "title", "text", "article", "paragraph")) for r in records)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    records = chunks(rng, 400)
    for name, style in (("flat", {}), ("escaped", {"ensure_ascii": True}), ("pretty", {"indent": 2}), ("tight", {"separators": (",", ":")})):
        (tmp_path / f"{name}.json").write_text(json.dumps(records, **{"ensure_ascii": False, **style}), encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = {name: J.json_array_records(spark, str(tmp_path / f"{name}.json")) for name in ("flat", "escaped", "pretty", "tight")}
        parts = spark.read.option("lineSep", "}").text(str(tmp_path / "flat.json")).rdd.getNumPartitions()
        assert parts > 40
        for name, got in found.items():
            path = str(tmp_path / f"{name}.json")
            assert [json.loads(r.record) for r in got.orderBy("number").collect()] == records, name
            assert sorted(r.number for r in got.collect()) == list(range(400))
            assert rows(S.read_chunks_json_array(spark, path)) == as_rows(records)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nested_odd_and_empty_files(spark, tmp_path):
    nested = [{"id": "1", "text": "a}", "more": {"x": [{"y": "}"}, {}]}}, 5, None, "a {string}", {"id": "2", "text": "b"}, {}]
    (tmp_path / "a.json").write_text(json.dumps(nested), encoding="utf-8")
    (tmp_path / "b.json").write_text("", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]", encoding="utf-8")
    (tmp_path / "d.json").write_text('﻿[\n{"id": "3"}\n]\n', encoding="utf-8")
    got = [json.loads(r.record) for r in J.json_array_records(spark, str(tmp_path)).orderBy("file", "number").collect()]
    assert got == [nested[0], nested[4], nested[5], {"id": "3"}]
    (tmp_path / "e.json").write_text('[{"id": "4"}, {"id": "5", "text": "cut', encoding="utf-8")
    table = J.read_json_array(spark, str(tmp_path / "e.json"), S.CHUNK_SCHEMA)
    assert rows(table.select("id")) == Counter({("4",): 1, (None,): 1})


def test_written_arrays_round_trip(spark, tmp_path):
    records = chunks(random.Random(5), 200)
    df = spark.createDataFrame([tuple(r.values()) for r in records], S.CHUNK_SCHEMA).repartition(5)
    S.write_chunks_json_array(df, str(tmp_path / "out"))
    for f in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(f.read_text(encoding="utf-8")), list)
    assert rows(S.read_chunks_json_array(spark, str(tmp_path / "out"))) == as_rows(records)
    S.write_chunks_json_array(df.limit(0), str(tmp_path / "none"))
    assert S.read_chunks_json_array(spark, str(tmp_path / "none")).count() == 0
