"""Token counts and packing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from veritext.llm import packing, pretokens, queries, token_counts

PATH = queries.tokenizer_path()
TEXTS = ["", " ", "  ", " a", "a ", "a  ", "a  b", "a   b", "a \nb", "a\n b", "a\n\n  b", "x<|endoftext|>y <|endoftext|> z", "a <|endoftext|>",
         "it's we'll 12²³ ½ ñandú 漢字 テスト   x y   z", "a\t b", "\n\n", "œuvre ʰ", "word " * 3000, "x" * 30_000, None]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "n") for i, t in enumerate(TEXTS)] + [(3, " a", 1, "n"), (None, "no id here", 1, "n"), (2 ** 60 + 1, "big id", 1, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, size long, ids string")


@pytest.mark.parametrize("alike", [True, False])
def test_encoder_equals_the_library(library, alike):
    encoder, counter = pretokens.Encoder(PATH, alike), pretokens.Counter(PATH, alike)
    for text in TEXTS:
        assert encoder.ids_of(text or "").tolist() == library(text) and counter(text or "") == len(library(text))


def test_merges_alike():
    assert pretokens.merges_alike(PATH)


def test_cache_generations():
    made = []
    cache = pretokens.Cache(lambda k: made.append(k) or len(k), 2, {"freq": 9})
    assert [cache[k] for k in ("a", "bb", "ccc", "a", "freq")] == [1, 2, 3, 1, 9] and made == ["a", "bb", "ccc"]


def test_counts(spark, docs, library):
    got = token_counts.with_token_counts(docs, PATH)
    assert sorted((str(r.doc_id), r.text or "", r.n_tokens) for r in got.collect()) == sorted((str(r.doc_id), r.text or "", len(library(r.text))) for r in docs.collect())
    assert token_counts.with_token_counts(docs.limit(0), PATH).count() == 0
    assert token_counts.with_token_counts(docs, PATH, out_col="size").columns == docs.columns


def test_counts_of_driver_documents(spark, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, SF_SMALL).collect():
        n = len(library(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)


def layout(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    used = padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        used, padded = used + at, padded + (capacity - at if at & (at - 1) else 0)
    return padded / max(1, used + padded)


@pytest.mark.parametrize("capacity", [1024, 64, 7])
def test_packing_is_exact(spark, docs, library, capacity):
    rows = packing.pack(docs, PATH, capacity=capacity).collect()
    layout(rows, capacity)
    pieces = defaultdict(list)
    for r in rows:
        pieces[str(r.doc_id)].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for r in docs.collect():
        if r.doc_id == 3:
            continue                                        # its row is there twice
        ids, at = library(r.text) + [0], 0
        for start, length, raw, n in sorted(pieces[str(r.doc_id)]):
            assert (start, n) == (at, len(ids)) and raw == np.array(ids[at:at + length], "<u4").tobytes()
            at += length
        assert at == len(ids)
    assert sum(p[1] for p in pieces["3"]) == 2 * (len(library(" a")) + 1)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_of_driver_documents(spark, library):
    text = {r.doc_id: library(r.text) + [0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op2_pack(spark, SF_SMALL).collect()
    assert layout(rows, 1024) < 0.01
    for r in rows:
        ids = text[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, text.values()))


def test_cut_uses_class_sizes():
    sizes = packing.class_sizes(1024)
    for n in (1, 31, 511, 1000, 1024, 1025, 5000):
        pieces = packing.cut(n, 1024, sizes)
        assert sum(s for _, s in pieces) == n and all(s in sizes for _, s in pieces) and [a for a, _ in pieces] == list(np.cumsum([0] + [s for _, s in pieces])[:-1])
