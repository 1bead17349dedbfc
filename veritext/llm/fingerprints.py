"""Document fingerprints from prefix polynomial hashes.

For a text's code points c_0, c_1, ... and a base B, the prefix array holds
H[i] = sum of (c_j + 1) * B^j for j < i, modulo the prime P.  Two array reads
give the hash of any span, so spans of one text or of two are compared in
constant time, and the longest common extension of two places is found by
binary search.  Two bases make a false match unlikely (about 2^-62 a test).

A fingerprint keeps the length, the two full hashes, the prefix hashes (of both
bases) at the multiples of a power of two, 64 at most, and a sample of the
text's short windows.  The prefix hashes of a coarser step are among them, so
fingerprints of texts of different lengths compare.  They tell which spans
agree in place.  The windows are chosen by their content, so text that an edit
has shifted, and text between scattered edits, is found again by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.shared import text_or_empty

P = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_069)
#: Prefix hashes that a fingerprint holds at most.
MARKS = 64
#: Code points of a window, and windows that a fingerprint holds at most.
WINDOW, WINDOWS = 12, 128

_POWERS = np.ones((2, 1), "u8")
_INVERSES = np.ones(1, "u8")


def powers(n: int) -> np.ndarray:
    """B^0 .. B^n at least, for both bases; kept and doubled when too short."""
    global _POWERS
    while _POWERS.shape[1] <= n:
        last = _POWERS[:, -1:] * np.array(BASES, "u8")[:, None] % P
        _POWERS = np.concatenate([_POWERS, _POWERS * last % P], axis=1)
    return _POWERS


def inverses(n: int) -> np.ndarray:
    """B^0 .. B^-n at least, for the first base; kept and doubled when too short."""
    global _INVERSES
    while len(_INVERSES) <= n:
        last = _INVERSES[-1] * np.uint64(pow(BASES[0], P - 2, P)) % P
        _INVERSES = np.concatenate([_INVERSES, _INVERSES * last % P])
    return _INVERSES


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of the 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")


class PrefixHash:
    """The prefix arrays of one text."""

    def __init__(self, codes: np.ndarray, start: np.ndarray | None = None, at: int = 0):
        """``start``: columns H[0..at] of a text that begins with the same ``at`` code points."""
        n = len(codes)
        pw = powers(max(n, 1))
        sums = np.cumsum((codes[at:] + np.uint64(1)) * pw[:, at:n] % P, axis=1)
        if start is None:
            start = np.zeros((2, 1), "u8")
        self.n, self.codes = n, codes
        self.h = np.concatenate([start, (sums + start[:, -1:]) % P], axis=1)

    def spliced(self, at: int, tail: np.ndarray) -> PrefixHash:
        """The arrays of the first ``at`` code points followed by ``tail``."""
        return PrefixHash(np.concatenate([self.codes[:at], tail]), self.h[:, :at + 1], at)

    def span(self, i: int, length: int) -> np.ndarray:
        """B^i times the span's own hash, for both bases."""
        return (self.h[:, i + length] + np.uint64(P) - self.h[:, i]) % P

    def equal(self, i: int, other: PrefixHash, k: int, length: int) -> bool:
        """Whether ``length`` code points from i here and from k there agree."""
        if i + length > self.n or k + length > other.n:
            return False
        pw = powers(abs(i - k))[:, abs(i - k)]
        a, b = self.span(i, length), other.span(k, length)
        return bool(np.array_equal(a * pw % P, b) if i <= k else np.array_equal(a, b * pw % P))

    def lce(self, i: int, other: PrefixHash, k: int) -> int:
        """Longest common extension from place i here and k there."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low

    def fingerprint(self) -> str:
        step = step_of(self.n)
        marks = self.h[:, step::step].T.astype(">u4").tobytes().hex()
        values, places = self.windows()
        windows = values.astype(">u8").tobytes().hex() + (places // step).astype("u1").tobytes().hex()
        return f"{self.n:x}.{int(self.h[0, -1]):08x}{int(self.h[1, -1]):08x}.{marks}.{windows}"

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The ``WINDOWS`` least values of windows, ascending, and their places.

        A value is a mix of the window's hash and of how many equal windows
        come before it, so that repeated text counts as often as it is there.
        """
        n = max(0, self.n - WINDOW + 1)
        own = (self.h[0, WINDOW:] + np.uint64(P) - self.h[0, :n]) % P * inverses(n)[:n] % P
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        index = np.arange(n)
        first = np.ones(n, bool)
        first[1:] = ranked[1:] != ranked[:-1]
        earlier = index - np.maximum.accumulate(np.where(first, index, 0)) if n else index
        values = mixed(ranked | earlier.astype("u8") << np.uint64(31))
        least = np.argpartition(values, WINDOWS)[:WINDOWS] if n > WINDOWS else index
        least = least[np.argsort(values[least])]
        return values[least], order[least]


def step_of(n: int) -> int:
    """The least power of two of which n holds ``MARKS`` at most."""
    step = 1
    while n // step > MARKS:
        step *= 2
    return step


def _parsed(fingerprint: str) -> tuple[int, str, np.ndarray, np.ndarray, np.ndarray]:
    """Length, full hashes, marks (of both bases), window values and the spans that the windows begin in."""
    n, full, marks, windows = fingerprint.split(".")
    raw = bytes.fromhex(windows)
    count = len(raw) // 9
    return (int(n, 16), full, np.frombuffer(bytes.fromhex(marks), ">u4").astype("i8").reshape(-1, 2),
            np.frombuffer(raw[:8 * count], ">u8"), np.frombuffer(raw[8 * count:], "u1").astype("i8"))


def likeness(a: str, b: str) -> float:
    """Share of the longer text that is in the other too, from fingerprints alone.

    The common prefix is found by binary search over the marks; behind it,
    spans between neighbouring marks (and the last part of texts of equal
    length) that agree count too.  Of what does not agree in place, the share
    is estimated by the sampled windows: exact but for the windows that an edit
    cuts while a text has ``WINDOWS`` of them, else with a standard error of
    0.04 at most.  Equal fingerprints: 1; an empty and a filled text: 0.
    """
    if a == b:
        return 1.0
    (n, full_a, marks_a, values_a, spans_a), (m, full_b, marks_b, values_b, spans_b) = _parsed(a), _parsed(b)
    if not n or not m:
        return 0.0
    step = max(step_of(n), step_of(m))
    count = min(n, m) // step
    x, y = (np.concatenate([np.zeros((1, 2), "i8"), marks[step // step_of(k) - 1::step // step_of(k)][:count]]) for marks, k in ((marks_a, n), (marks_b, m)))
    low, high = 0, count
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if (x[mid] == y[mid]).all() else (low, mid - 1)
    same = np.zeros(max(n, m) // step + 1, bool)           # by span; the last is the part behind all marks
    same[:low] = True
    same[low:count] = ((np.diff(x[low:], axis=0) - np.diff(y[low:], axis=0)) % P == 0).all(axis=1)
    agreed = int(np.count_nonzero(same)) * step
    ends = [np.array([int(f[:8], 16), int(f[8:], 16)]) - z[-1] for f, z in ((full_a, x), (full_b, y))]
    if n == m and count * step < n and ((ends[0] - ends[1]) % P == 0).all():
        same[count] = True
        agreed += n - count * step
    rest_n, rest_m = n - agreed, m - agreed
    bound = min((int(v[-1]) for v in (values_a, values_b) if len(v) == WINDOWS), default=(1 << 64) - 1)
    left = [v[(v <= np.uint64(bound)) & ~same[spans // (step // step_of(k))]]
            for v, spans, k in ((values_a, spans_a, n), (values_b, spans_b, m))]
    common = len(np.intersect1d(*left, assume_unique=True))
    every = len(left[0]) + len(left[1]) - common
    if common:                                             # common / every is shared / (rest_n + rest_m - shared)
        agreed += min(common / (every + common) * (rest_n + rest_m), rest_n, rest_m)
    return min(agreed, max(n, m) - 1) / max(n, m)          # the texts differ somewhere


def _buckets(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """``docs`` with ``bucket``: n ranges of ids of about as many rows each.

    The n - 1 cut points come from one approximate-percentile aggregate and
    are looked up on two levels.
    """
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, shares, 20 * n)).head()[0] or []))
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    if not groups:
        return docs.withColumn("bucket", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    at_or_below = lambda cut: cut <= F.col(id_col)
    coarse = F.size(F.filter(F.lit([g[0] for g in groups]), at_or_below))
    fine = F.size(F.filter(F.element_at(F.lit([g + [cuts[-1] + 1] * (width - len(g)) for g in groups]), F.greatest(coarse, F.lit(1))), at_or_below))
    return docs.withColumn("bucket", F.when(F.col(id_col).isNull(), F.lit(-1)).when(coarse == 0, F.lit(0))
                           .otherwise(coarse * (width + 1) + fine))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document, in descending ``id_col``
    (integers); the last document's next is the first.  Returns ``id_col``,
    n_chars, edited_text, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the edited text's and the next document's).

    Null texts are empty.  Null ids come after all others; rows of one id are
    in the order of their texts.  One document is its own next.  An empty
    table gives no rows; further columns are left out.

    Texts move once: they are range-partitioned by id, and the first document
    of each range is also sent to the range before it, as its "next".
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _buckets(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), "id", n)
    heads = sorted(((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("id").alias("head")).collect()),
                   reverse=True)                                                  # one row a range
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]       # the first range's head ends the last
    halo = F.broadcast(spark.createDataFrame(before, "head long, head_bucket int"))
    sent = rows.join(halo, F.col("id").eqNullSafe(F.col("head")), "left")
    own, ahead = F.struct(F.col("bucket"), F.lit(False).alias("halo")), F.struct(F.col("head_bucket").alias("bucket"), F.lit(True).alias("halo"))
    sent = (sent.withColumn("to", F.explode(F.when(F.col("head_bucket").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
            .select("id", "text", "to.bucket", "to.halo"))
    placed = (sent.repartitionByRange(n, F.col("bucket"))
              .sortWithinPartitions("bucket", "halo", F.col("id").desc_nulls_last(), "text"))
    placed = placed.withColumn("id", F.col("id").cast("string"))      # beside a null, pandas would make numbers floats
    out = (T.StructType().add("id", "string").add("n_chars", "long").add("edited_text", "string").add("fingerprint", "string")
           .add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                                        # the document whose next is the coming row
        for pdf in batches:
            done = []
            for key, text, bucket, halo in zip(pdf["id"], pdf["text"], pdf["bucket"], pdf["halo"], strict=True):
                if halo and held is None:
                    continue
                codes = code_points(text)
                hashed = PrefixHash(codes)
                print_ = hashed.fingerprint()
                if held is not None:
                    h_key, h_text, h, h_print, h_bucket = held
                    assert h_bucket == bucket, "a range lacks the head of the range after it"
                    swap = h.n // 3
                    edited = h.spliced(h.n - swap, codes[:swap])
                    e_print = edited.fingerprint()
                    done.append((h_key, h.n, h_text[:h.n - swap] + text[:swap], h_print, e_print,
                                 likeness(h_print, e_print), likeness(h_print, print_)))
                held = None if halo else (key, text, hashed, print_, bucket)
            frame = pd.DataFrame(done, columns=out.names)
            yield frame.astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    found = placed.mapInPandas(run, out)
    return found.select(F.col("id").cast("long").alias(id_col), *found.columns[1:])
