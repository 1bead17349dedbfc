"""Removal of passages that repeat across documents, by Rabin-Karp windows.

1. A task hashes every window of ``window`` words of its documents (a
   polynomial over word hashes, modulo two primes, with bits of a third).
   Windows that repeat within a chunk of its documents are settled there: all
   but those of the smallest id are marked, and only the latter travel, so a
   passage that a third of all documents share is one entry a chunk.
2. The entries are dealt by ranges of the hash, packed by chunk and range.
   A group counts the windows of its range and marks all but those of the
   smallest id.
3. The marks are dealt back by document, packed again, and merged into the
   maximal intervals of words to remove, which meet the texts.

Two windows count as equal if 80 bits of their hashes are; among n windows
n * n / 2^81 pairs of different ones may be expected to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.shared import stored, text_or_empty

#: Words of a window.
WINDOW = 50
#: Windows that a range of hashes holds about, and words that a task gathers before it sends their windows.
RANGE_WINDOWS, CHUNK_WORDS = 1_000_000, 1_000_000
#: Intervals are broadcast to the documents up to this size, else both are shuffled.
BROADCAST_BYTES = 64 << 20

#: Primes below 2^32, and the bases of their polynomials.
_FIELDS = ((4294967291, 2654435761), (4294967279, 2246822519), (4294967231, 3266489917))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs without ASCII white space."""
    return text.split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A row of two 64-bit numbers a word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _polynomial(words: np.ndarray, window: int, prime: int, base: int) -> np.ndarray:
    """Hash of the ``window`` words from each place on, by doubling."""
    p = np.uint64(prime)
    power, run, size = base % prime, (words % p), 1            # of ``size`` words from each place
    total, taken = np.zeros(len(words), "u8"), 0               # of the first ``taken`` words
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            # total * base^size + run, run starting where total ends
            ahead = run[taken:]
            total = (total[:len(ahead)] * np.uint64(pow(base, size, prime))) % p + ahead if taken else ahead.copy()
            total %= p
            taken += size
        if window >> (bit + 1):
            ahead = run[size:]
            run = (run[:len(ahead)] * np.uint64(power)) % p + ahead
            run %= p
            size, power = 2 * size, power * power % prime
    return total


def window_hashes(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 16 more) of every window; empty with fewer words than one."""
    if len(words) < window:
        return np.zeros(0, "u8"), np.zeros(0, "u2")
    low, high = words[:, 0].copy(), words[:, 1].copy()
    a, b, c = (_polynomial(w, window, *field) for w, field in zip((low, high, low ^ (high >> np.uint64(7))), _FIELDS, strict=True))
    return (a << np.uint64(32)) | b, c.astype("u2")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The hash spread evenly, so that its ranges hold about as much each."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _later(main: np.ndarray, check: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of a smaller owner."""
    later = np.zeros(len(main), bool)
    if not len(main):
        return later
    order = np.argsort(main)
    same = main[order][1:] == main[order][:-1]
    twins = order[np.r_[same, False] | np.r_[False, same]]      # the rest is alone
    twins = twins[np.lexsort((owner[twins], check[twins], main[twins]))]
    m, c, o = main[twins], check[twins], owner[twins]
    start = np.r_[True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])][:len(m)]
    later[twins] = o > o[np.flatnonzero(start)][np.cumsum(start) - 1] if len(m) else False
    return later


class _Chunk:
    """Windows of some documents: rows of (id, key) and, per window, its row, place and hash."""

    def __init__(self):
        self.ids, self.keys, self.words, self.hashes, self.seen = [], [], 0, [], set()

    def add(self, key_id: int, key: int, text: bytes, window: int) -> None:
        if (key_id, key) in self.seen:                         # a repeated row has the same windows
            return
        words = words_of(text)
        if len(words) < window:
            return
        self.seen.add((key_id, key))
        self.ids.append(key_id)
        self.keys.append(key)
        self.hashes.append(window_hashes(_word_hashes(words), window))
        self.words += len(words)

    def rows(self, ranges: int) -> Iterator[tuple]:
        """(range, packed columns): the windows of each range; range -1 are those settled here."""
        sizes = np.array([len(m) for m, _ in self.hashes])
        row = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        main, check = _mixed(np.concatenate([m for m, _ in self.hashes])), np.concatenate([c for _, c in self.hashes])
        ids, keys = np.array(self.ids, "i8"), np.array(self.keys, "i8")
        at = ((main >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype("i2" if ranges < 32_000 else "i8")
        at[_later(main, check, ids[row])] = -1
        for value, mine in _parts(at):
            yield value, *_packed(ids, keys, row[mine], place[mine]), main[mine[:0] if value < 0 else mine].tobytes(), check[mine[:0] if value < 0 else mine].tobytes()


def _parts(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its places, in order."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    for part in np.split(order, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1):
        if len(part):
            yield int(values[part[0]]), part


def _packed(ids: np.ndarray, keys: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """ids, keys, counts, places of windows that are given row by row; ids and keys are those of the rows."""
    held, counts = np.unique(row, return_counts=True)
    small = not len(place) or place.max() < 1 << 16
    return ids[held].astype("<i8").tobytes(), keys[held].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), place.astype("<u2" if small else "<u4").tobytes()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, row, place) of all packed rows: row is the place of a window's document in ids and keys."""
    column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    counts, places = [np.frombuffer(c, "<u4") for c in table["counts"].to_pylist()], []
    for c, packed in zip(counts, table["places"].to_pylist(), strict=True):
        places.append(np.frombuffer(packed, "<u2" if len(packed) == 2 * int(c.sum()) else "<u4").astype("<u4"))
    row = np.repeat(np.arange(sum(map(len, counts)), dtype="i4"), np.concatenate(counts))
    return column("ids", "<i8"), column("keys", "<u4"), row, np.concatenate(places)


_PLACES = ["ids", "keys", "counts", "places"]


def _table(numbers: dict[str, list], packed: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(v, "int64") for k, v in numbers.items()} | {k: pa.array(v, "binary") for k, v in packed.items()})


def packed_windows(docs: DataFrame, window: int, ranges: int) -> DataFrame:
    """(range, spread, packed columns) of the windows of ``docs`` (id, key, text); ``spread`` deals the settled ones out."""
    out, names = T.StructType().add("range", "long").add("spread", "long"), [*_PLACES, "main", "check"]
    for name in names:
        out = out.add(name, "binary")

    def rows(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        made = list(chunk.rows(ranges)) if chunk.ids else []
        columns = {name: [r[i + 1] for r in made] for i, name in enumerate(names)}
        yield from _table({"range": [r[0] for r in made], "spread": [chunk.keys[0] if r[0] < 0 else 0 for r in made]}, columns).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for key_id, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                chunk.add(key_id, key, text.as_py(), window)
                if chunk.words >= CHUNK_WORDS:
                    yield from rows(chunk)
                    chunk = _Chunk()
        yield from rows(chunk)

    return docs.mapInArrow(run, out)


def marked_windows(docs: DataFrame, window: int, ranges: int) -> DataFrame:
    """(owner, packed columns): the windows that a document of smaller id has too, by a hash of their documents."""
    owners, out = max(1, ranges // 2), T.StructType().add("owner", "long")
    for name in _PLACES:
        out = out.add(name, "binary")

    def marked(table: pa.Table) -> pa.Table:
        ids, keys, row, place = _unpacked(table)
        if table["range"][0].as_py() >= 0:
            main, check = (np.frombuffer(b"".join(table[name].to_pylist()), kind) for name, kind in (("main", "<u8"), ("check", "<u2")))
            later = _later(main, check, ids[row])
            row, place = row[later], place[later]
        owner = (_mixed(ids.view("u8") + np.uint64(0x9E3779B97F4A7C15) * keys) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        parts = [(value, *_packed(ids, keys, row[mine], place[mine])) for value, mine in _parts(owner[row])]
        return _table({"owner": [p[0] for p in parts]}, {name: [p[i + 1] for p in parts] for i, name in enumerate(_PLACES)})

    return packed_windows(docs, window, ranges).groupBy("range", "spread").applyInArrow(marked, out)


def removals(marks: DataFrame, window: int) -> DataFrame:
    """(id, key, spans): the maximal intervals to remove, one row a document that has any; spans is pairs of 32-bit numbers."""
    def merged(table: pa.Table) -> pa.Table:
        ids, keys, row, place = _unpacked(table)
        order = np.lexsort((place, keys[row], ids[row]))
        row, place = row[order], place[order].astype("i8")
        i, k = ids[row], keys[row]
        new = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])][:len(i)]
        start = np.flatnonzero(new)
        lists = [np.array(intervals(p, window), "<u4").tobytes() for p in np.split(place, start[1:])] if len(i) else []
        return pa.table({"id": pa.array(i[start], "int64"), "key": pa.array(k[start], "int64"), "spans": pa.array(lists, "binary")})

    return marks.groupBy("owner").applyInArrow(merged, T.StructType().add("id", "long").add("key", "long").add("spans", "binary"))


def intervals(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal intervals (start, end) of words that windows at sorted places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > window)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + window).tolist(), strict=True))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """One row a document: ``id_col``, n_words, n_removed, removed (array of
    word intervals start, end), kept_text (the kept words joined by a blank).

    A word goes if a window of ``window`` words that covers it starts in a
    document of smaller id as well; windows are judged on the texts given.
    Ids are integers.  Null and empty texts and texts shorter than a window
    lose nothing.  Rows without id have no smaller or larger id: they lose
    nothing and take nothing from others.  Rows of one id take nothing from
    each other; rows that repeat id and text get the same result each.  An
    empty table gives no rows; a text of any length is taken whole; further
    columns are left out, so their names cannot clash.
    """
    text = text_or_empty(text_col)
    # key tells rows of one id apart
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).alias("key"), text.cast("binary").alias("text"))
    # a word and its blank take two bytes at least, six on the average of most languages
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).head()["n"] or 0
    ranges = max(1, -(-size // (6 * range_windows)))
    known = rows.filter(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
    gone = stored(removals(marked_windows(known, window, ranges), window), "passage-removals")
    gone = gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), "spans")
    held = gone.agg(F.sum(F.octet_length("spans") + 40).alias("n")).head()["n"] or 0
    side = F.broadcast(gone) if held <= BROADCAST_BYTES else gone
    joined = rows.join(side, (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left").select("id", "text", "spans")
    span = T.StructType().add("start", "long").add("end", "long")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(span)).add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, cut in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = words_of(text.as_py())
                cuts = np.frombuffer(cut.as_py() or b"", "<u4").reshape(-1, 2).tolist()
                parts, at = [], 0
                for a, b in cuts:
                    parts += words[at:a]
                    at = b
                parts = parts + words[at:] if cuts else words
                sizes.append(len(words))
                gone.append(len(words) - len(parts))
                spans.append([{"start": a, "end": b} for a, b in cuts])
                kept.append(b" ".join(parts).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, "int64"), pa.array(gone, "int64"), pa.array(spans, kind), pa.array(kept, "string")],
                                             names=[id_col, "n_words", "n_removed", "removed", "kept_text"])

    return joined.mapInArrow(run, out)
