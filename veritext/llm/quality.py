"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  A label
model (each labeller has its own probabilities of voting, given the unknown
class) is fitted by expectation-maximisation on the counts of the vote
patterns of all documents: the counts are aggregated by Spark, and there are
4^labellers patterns at most.  The posterior of a document's pattern is its
soft label.  A linear scorer on hashed features learns those labels from a
bounded sample and then decides on every document.  No true label is used.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.shared import text_or_empty

#: Documents (expected number) that the scorer is fitted on.
SAMPLE_DOCS = 4000
#: Buckets of hashed features, steps and step size of the fit, weight of its penalty.
BUCKETS, STEPS, RATE, PENALTY = 4096, 250, 2.0, 1e-5
EM_ROUNDS = 60
#: Words that a labeller on word statistics wants.
FEW_WORDS = 20
#: A labeller votes, finds nothing, or cannot judge so short a text.
NONE, GOOD, BAD, SHORT = 0, 1, 2, 3

#: Character classes of the hashed features: letters, digits and white space are
#: one each, other ASCII characters keep their own.
_CLASS = np.full(256, 1, "i8")
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = (1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 5 if _s == "\n" else 4 if _s.isspace() or _c < 32
                  else 6 + _c % 32)
_WIDTH = 38
_BUCKET = (np.arange(_WIDTH ** 3, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype("i8") % BUCKETS


def classes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text and their character classes."""
    raw = np.frombuffer(text.encode(), "u1")
    return raw, _CLASS[raw]


def statistics(text: str, raw: np.ndarray | None = None, code: np.ndarray | None = None) -> dict[str, float]:
    """Shares that the labellers look at, over the whole text."""
    if raw is None:
        raw, code = classes_of(text)
    words = text.split()
    n, counts = max(1, len(words)), np.bincount(code, minlength=_WIDTH)
    visible, letters = max(1, len(code) - counts[4] - counts[5]), max(1, counts[1] + counts[2])
    blank, symbol, upper = (code == 4) | (code == 5), code >= 6, code == 2
    before = np.r_[True, blank[:-1]]                                     # a word begins here
    last = ~blank & np.r_[blank[1:], True]                               # a word ends here
    second = np.r_[False, symbol[:-1]]                                   # the character before is a symbol
    ends = raw[last & ~second & ~before]
    shapes = Counter(words)
    return {
        "words": len(words),
        "symbols": counts[6:].sum() / visible,
        "upper": counts[2] / letters,
        "repeated": sum(map(operator.eq, words, words[1:])) / n,
        "top": max(shapes.values(), default=0) / n,
        "distinct": len(shapes) / n ** 0.8,                              # vocabulary grows slower than the text
        "bare": np.count_nonzero(last & symbol & before) / n,
        "marked": np.count_nonzero(last & symbol & second) / n,
        "shouted": np.count_nonzero(upper[1:] & upper[:-1]) / letters,
        "stops": (np.count_nonzero(ends == 46) + np.count_nonzero(ends == 33) + np.count_nonzero(ends == 63)) / n,
    }


def _bad(s: dict[str, float], name: str, limit: float, few: int = 0) -> int:
    return SHORT if s["words"] < few else BAD if s[name] >= limit else NONE


def _good(s: dict[str, float], holds: bool, few: int = 0) -> int:
    return SHORT if s["words"] < few else GOOD if holds else NONE


#: The labellers, each on the statistics of a text.  Most know one fault and
#: are silent otherwise; the last three know what prose looks like.
LABELLERS = {
    "symbols": lambda s: _bad(s, "symbols", 0.1, FEW_WORDS),
    "upper": lambda s: _bad(s, "upper", 0.35),
    "shouted": lambda s: _bad(s, "shouted", 0.2),
    "marked": lambda s: _bad(s, "marked", 0.15),
    "bare": lambda s: _bad(s, "bare", 0.15),
    "top": lambda s: _bad(s, "top", 0.25, FEW_WORDS),
    "repeated": lambda s: _bad(s, "repeated", 0.2, FEW_WORDS),
    "distinct": lambda s: SHORT if s["words"] < FEW_WORDS else BAD if s["distinct"] <= 0.3 else NONE,
    "plain": lambda s: _good(s, s["symbols"] <= 0.06 and s["upper"] <= 0.12, FEW_WORDS),
    "varied": lambda s: _good(s, s["repeated"] <= 0.03 and s["top"] <= 0.15, FEW_WORDS),
    "sentences": lambda s: _good(s, 0.02 <= s["stops"] <= 0.5 and s["bare"] <= 0.01, FEW_WORDS),
}


def votes(stats: dict[str, float]) -> str:
    """One digit a labeller."""
    return "".join(str(f(stats)) for f in LABELLERS.values())


def label_model(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """The posterior probability of "good" of every vote pattern.

    Expectation-maximisation of the class's share and of each labeller's
    probability of each vote given the class, from a start where votes are
    more often right than not.
    """
    names = sorted(patterns)
    if not names:
        return {}
    v = np.array([[int(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    start = np.array([[0.4, 0.55, 0.05, 1.0], [0.4, 0.15, 0.45, 1.0]])
    likely = np.tile(start, (v.shape[1], 1, 1))                                              # labeller, class, vote
    prior, labellers = np.array([0.7, 0.3]), np.arange(v.shape[1])
    for _ in range(rounds):
        log = np.log(prior) + np.log(likely[labellers[None], :, v]).sum(1)                   # pattern, class
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * weight[:, None]
        prior = (mass.sum(0) + 1) / (mass.sum() + 2)
        for vote in range(3):
            likely[:, :, vote] = ((v == vote)[:, :, None] * mass[:, None, :]).sum(0) + 0.1
        likely[:, :, :SHORT] /= likely[:, :, :SHORT].sum(2, keepdims=True)                   # SHORT says nothing: 1
    return dict(zip(names, post[:, 0].tolist(), strict=True))


def features(codes: np.ndarray, stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of character-class trigrams, and the statistics in tenths."""
    counts = np.zeros(BUCKETS)
    if len(codes) > 2:
        trigram = (codes[:-2] * _WIDTH + codes[1:-1]) * _WIDTH + codes[2:]
        counts += np.bincount(_BUCKET[trigram], minlength=BUCKETS) / len(trigram) * 4
    for name, value in stats.items():
        if name != "words":
            counts[xxhash.xxh3_64_intdigest(f"{name}:{min(10, round(value * 10))}") % BUCKETS] += 0.5
    where = np.flatnonzero(counts)
    return where, counts[where]


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels; each class weighs the same in total."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = (y / share + (1 - y) / (1 - share)) / 2 / len(y)
    speed_w, speed_b = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        score = 1 / (1 + np.exp(-(np.bincount(row, val * w[col], len(rows)) + bias)))
        error = (score - y) * weight
        speed_w = 0.9 * speed_w - RATE * (np.bincount(col, val * error[row], BUCKETS) + PENALTY * w)
        speed_b = 0.9 * speed_b - RATE * error.sum()
        w, bias = w + speed_w, bias + speed_b
    return w, bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Fit the label model on all documents and the scorer on the sample."""
    texts = docs.select(text_or_empty(text_col).alias("text"))

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            seen.update(votes(statistics(t)) for t in pdf["text"])
        yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    counted = texts.mapInPandas(patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # one row a pattern
    posterior = label_model({r["pattern"]: r["n"] for r in counted})
    total = sum(r["n"] for r in counted)

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = [statistics(t) for t in pdf["text"]]
            both = [features(classes_of(t)[1], s) for t, s in zip(pdf["text"], stats, strict=True)]
            yield pd.DataFrame({"pattern": [votes(s) for s in stats], "at": [a for a, _ in both], "value": [v for _, v in both]})

    rows = (texts.sample(min(1.0, sample_docs / max(1, total)), seed=11)
            .mapInPandas(sampled, "pattern string, at array<long>, value array<double>").toPandas())
    return fit([(np.asarray(a), np.asarray(v), posterior[p]) for p, a, v in rows.itertuples(index=False) ])


def with_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality_score",
                 threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``score_col``: the scorer's probability that the text is
    good; documents below ``threshold`` are to be rejected.

    Null texts and texts without words score 0.  Repeated rows score alike,
    an empty table stays empty, all other columns pass through, and a column
    already called ``score_col`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, sample_docs))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = model.value
        for texts in batches:
            scores = []
            for text in texts:
                raw, codes = classes_of(text)
                stats = statistics(text, raw, codes)
                at, value = features(codes, stats)
                scores.append(1 / (1 + np.exp(-(w[at] @ value + bias))) if stats["words"] else 0.0)
            yield pd.Series(scores, dtype="float64")

    return docs.withColumn(score_col, score(text_or_empty(text_col)))
