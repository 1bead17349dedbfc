"""Mixing documents to target domain weights by soft membership, in DataFrame
operations only.

A naive Bayes classifier on hashed words and runs of marks, fitted on the
labelled table, gives every document a posterior over the domains.  It uses
the words that are clearly more common in some domain, and both their presence
and their absence.  Documents get nonnegative rates
(how often each is to be used), fitted by projected-gradient least squares so
that the domains' expected tokens - the sum of rate x tokens x posterior -
meet their targets.  A rate depends on the posterior alone, so documents of one
posterior are one row with their tokens summed; a gradient step needs one
number a domain, so a round is one aggregate over those rows, which are
rewritten with their rates every few rounds.  Tokens here are words.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.shared import discard, stored, text_or_empty
from veritext.session import side

#: Labelled documents (expected number) that the classifier is fitted on.
SAMPLE_DOCS = 20_000
#: Hash buckets of words, and the pseudo-documents that pull a bucket's share in a domain to its share overall.
BUCKETS, PULL = 1 << 16, 4.0
#: A bucket counts if it is in so many labelled documents, and in some domain so many
#: standard deviations and so much (log ratio) above its share overall; smaller domains don't select.
LEAST_DOCS, LEAST_SCORE, LEAST_RATIO, LEAST_DOMAIN = 10, 5.0, 0.7, 20
#: Rounds at most, and the relative miss of the targets at which they end; or, if the targets
#: cannot be met, the relative change of the misses over a stretch of rounds after which the rates are written.
ROUNDS, MISS, STRETCH, STALL = 600, 1e-6, 20, 1e-9


def words_of(text: Column) -> Column:
    """Lower-case words, punctuation taken as space."""
    marks = ".,;:!?*#$%&|\"'()[]<>"
    return F.filter(F.split(F.translate(F.lower(text), marks, " " * len(marks)), "\\s+"), lambda w: w != "")


def _bags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n words, bag): bag is the distinct buckets of words and runs of marks."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", words_of(text).alias("words"), F.array_distinct(F.split(text, "[\\p{L}\\p{N}\\s]+")).alias("runs"))
    bucket = lambda kind: lambda x: F.pmod(F.xxhash64(F.lit(kind), x), F.lit(BUCKETS))
    marks = F.transform(F.array_remove("runs", ""), bucket("marks"))
    return rows.select("id", F.size("words").cast("long").alias("n"), F.array_distinct(F.concat(F.transform("words", bucket("word")), marks)).alias("bag"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, label_col: str,
                sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, list[float], list[str]]:
    """The classifier: (bucket, w_0, w_1, ...) with a domain's log odds if the
    bucket is there, the domains' log odds if none is, and the domains that
    have a labelled document.  Labelled texts with equal bags count once."""
    known = labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("domain"))
    known = known.filter(F.col("domain").isin(domains) & F.col("id").isNotNull()).dropDuplicates(["id"])
    sample = known.sample(min(1.0, sample_docs / max(1, known.count())), seed=17)              # bounded by its parameter
    texts = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(sample.withColumnRenamed("id", id_col).drop("domain")), id_col, "left_semi")
    bags = _bags(stored(texts, "mix-sample"), id_col, text_col).join(F.broadcast(sample), "id")
    bags = stored(bags.select("domain", "bag").dropDuplicates(["domain", "bag"]), "mix-bags")
    sizes = {r["domain"]: r["n"] for r in bags.groupBy("domain").agg(F.count("*").alias("n")).collect()}   # one row a domain
    found = [d for d in domains if sizes.get(d)]
    total = max(1, sum(sizes.values()))
    counts = (bags.select("domain", F.explode("bag").alias("bucket")).groupBy("bucket")
              .agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(found)]))
    counts = counts.filter((F.col("n") >= LEAST_DOCS) & (F.col("n") < total)).withColumn("base", F.col("n") / total)
    for i, d in enumerate(found):
        counts = counts.withColumn(f"share_{i}", (F.col(f"n_{i}") + PULL * F.col("base")) / (sizes[d] + PULL))
    base, share = F.col("base"), lambda i: F.col(f"share_{i}")
    score = lambda i, d: (F.col(f"n_{i}") - sizes[d] * base) / F.sqrt(sizes[d] * base * (1 - base) + 1)
    marks = [(score(i, d) >= LEAST_SCORE) & (F.log(share(i) / base) >= LEAST_RATIO) for i, d in enumerate(found) if sizes[d] >= LEAST_DOMAIN]
    telling = F.lit(False)
    for m in marks:
        telling = telling | m
    absent = lambda i: F.log((1 - share(i)) / (1 - base))
    weights = stored(counts.filter(telling).select("bucket", *[(F.log(share(i) / base) - absent(i)).alias(f"w_{i}") for i in range(len(found))],
                                                   *[absent(i).alias(f"a_{i}") for i in range(len(found))]), "mix-weights")
    none = weights.agg(*[F.sum(f"a_{i}").alias(f"a_{i}") for i in range(len(found))]).head() if found else []
    return weights, [math.log(sizes[d] / total) + (a or 0.0) for d, a in zip(found, none, strict=True)], found


def posteriors(docs: DataFrame, weights: DataFrame, start: list[float], id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, p array): every document's words and domain posterior."""
    k = range(len(start))
    telling = sorted(r["bucket"] for r in weights.select("bucket").collect())                  # at most BUCKETS rows
    wanted = F.split(F.lit(",".join(map(str, telling))), ",").cast("array<bigint>") if telling else F.array().cast("array<bigint>")
    # one pass over the texts leaves their word counts and the few telling buckets
    rows = stored(_bags(docs, id_col, text_col).select("id", "n", F.array_intersect("bag", wanted).alias("hits")), "mix-hits")
    scores = (rows.select("id", F.explode("hits").alias("bucket")).join(F.broadcast(weights), "bucket").groupBy("id")
              .agg(*[F.sum(f"w_{i}").alias(f"s_{i}") for i in k]))                              # at most BUCKETS rows are broadcast
    tokens = rows.groupBy("id").agg(F.sum("n").alias("tokens"))
    joined = stored(tokens, "mix-tokens").join(stored(scores.withColumnRenamed("id", "s_id"), "mix-scores"), F.col("id").eqNullSafe(F.col("s_id")), "left")
    log = F.array(*[F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) + F.lit(start[i]) for i in k])
    odds = joined.select("id", "tokens", log.alias("log")).select("id", "tokens", F.transform("log", lambda x: F.exp(x - F.array_max("log"))).alias("odds"))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return odds.select("id", "tokens", F.transform("odds", lambda x: x / total).alias("p"))


def after_steps(steps: list[list[float]], least: float = 0.0) -> Column:
    """[rate, the rate before] of a row (p, rate, before) after some rounds.

    A step is its momentum and one number a domain: the rate moves on by the
    momentum of its last change, loses the posterior mean of the numbers and
    is projected to ``least`` or more.
    """
    state = F.array("rate", "before")
    if not steps:
        return state
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def step(now: Column, s: Column) -> Column:
        rate, before = F.element_at(now, 1), F.element_at(now, 2)
        move = F.aggregate(F.zip_with("p", F.slice(s, 2, F.size("p")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.array(F.greatest(F.lit(float(least)), rate + F.element_at(s, 1) * (rate - before) - move), rate)

    return F.aggregate(history, state, step)


def fit_rates(table: DataFrame, targets: list[float], total: float | None = None, rounds: int = ROUNDS, keep: int | None = None) -> DataFrame:
    """(p, rate) for every posterior of ``table`` (tokens, p), so that sum(rate * tokens * p_k) comes to target_k * total.

    With ``keep`` no other domain gets more than its tokens at rate 1; the
    domain ``keep`` gets what they leave, its own tokens at least.

    Least squares of the misses, each over the domain's tokens at rate 1, by
    projected gradient in the metric that weighs a document by its tokens;
    in it the steepest curvature is 1 at most, so a full step never overshoots.
    Steps have Nesterov's momentum, which starts anew when the misses grow; as
    the sums are linear in the rates, those of the moved point need no pass.
    Rounds go on until every target is met to ``MISS`` of all tokens, or, if
    no rates meet them, until the misses stay as they are; ``rounds`` without
    either is reported as a warning with the miss left.
    """
    k = range(len(targets))

    def sums(rows: DataFrame, steps: list[list[float]]) -> list[float]:
        used = F.col("tokens") * F.element_at(after_steps(steps), 1)
        row = rows.agg(*[F.sum(used * F.element_at("p", i + 1)).alias(f"s_{i}") for i in k]).head()
        return [float(x or 0.0) for x in row]

    rows = stored(table.groupBy("p").agg(F.sum("tokens").alias("tokens")).withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)}), "mix-groups")
    start = sums(rows, [])
    total = sum(start) if total is None else total
    wanted = [t / sum(targets) * total for t in targets]
    if keep is not None:
        wanted = [min(w, s) for w, s in zip(wanted, start, strict=True)]
        wanted[keep] = max(start[keep], total - sum(w for i, w in enumerate(wanted) if i != keep))
    worst = lambda now: max(abs(s - w) for s, w in zip(now, wanted, strict=True)) / max(total, 1.0)
    square = lambda now: sum((s - w) ** 2 / b for s, w, b in zip(now, wanted, start, strict=True) if b)
    steps, now, last, speed, done, before = [], start, start, 1.0, 0, worst(start)
    while worst(now) > MISS:
        if done == rounds:
            warnings.warn(f"{rounds} rounds leave a target missed by {worst(now):.3g} of all tokens", stacklevel=2)
            break
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        momentum = (speed - 1) / faster
        moved = [s + momentum * (s - x) for s, x in zip(now, last, strict=True)]
        steps.append([momentum, *[(s - w) / b if b else 0.0 for s, w, b in zip(moved, wanted, start, strict=True)]])
        last, now, done = now, sums(rows, steps), done + 1
        speed = faster if square(now) <= square(last) else 1.0
        if len(steps) == STRETCH:
            state = rows.withColumn("state", after_steps(steps))
            written, rows, steps = rows, stored(state.select("p", "tokens", F.element_at("state", 1).alias("rate"), F.element_at("state", 2).alias("before")), "mix-groups"), []
            discard(written)
            if before - worst(now) < STALL:                                             # no rates come nearer
                break
            before = min(before, worst(now))
    return rows.select("p", F.element_at(after_steps(steps), 1).alias("rate"))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "domain", total: float | None = None, sample_docs: int = SAMPLE_DOCS, keep: str | None = None) -> DataFrame:
    """One row an id: ``id_col``, tokens (words), p (map: domain to posterior)
    and rate, nonnegative, so that the domains' expected tokens meet
    ``targets`` (weights) times ``total`` (default: the tokens at rate 1).
    With the domain ``keep``, no other is used more often than it is there, and
    ``keep`` gets what they leave, so its documents' rates do not fall below 1.

    Domains that no labelled document of ``docs`` has cannot be told and are
    left out; the others' targets keep their proportions.  Without any labelled
    document, or for an empty table, every rate is 1 and p is empty.  Null
    texts have no tokens and the prior as posterior.  Rows that repeat an id
    (or have none) share one posterior and one rate, their tokens add up.
    """
    weights, priors, found = fit_domains(docs, labelled, list(targets), id_col, text_col, label_col, sample_docs)
    if not found:
        tokens = _bags(docs, id_col, text_col).groupBy(F.col("id").alias(id_col)).agg(F.sum("n").alias("tokens"))
        return tokens.select(id_col, "tokens", F.create_map().cast("map<string,double>").alias("p"), F.lit(1.0).alias("rate"))
    table = stored(posteriors(docs, weights, priors, id_col, text_col), "mix-posteriors")
    rates = fit_rates(table, [targets[d] for d in found], total, keep=found.index(keep) if keep in found else None)
    names = F.array(*[F.lit(d) for d in found])
    rated = table.join(side(rates, 16 * len(found) + 40), "p").select(F.col("id").alias(id_col), "tokens", F.map_from_arrays(names, "p").alias("p"), F.round("rate", 9).alias("rate"))
    return rated


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "domain", total: float | None = None, keep: str | None = None) -> DataFrame:
    """``docs``, each row as often as its rate says; same columns.

    The whole part of a rate is used as it is, the rest by chance: a hash of
    the id is the draw, so a run repeats.  Rows of a rate of 1 or more stay.
    """
    rates = mixing_rates(docs, labelled, targets, id_col, text_col, label_col, total, keep=keep)
    rates = stored(rates.select(F.col(id_col).alias("__mix_id"), F.col("rate").alias("__mix_rate")), "mix-rates")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("__mix_id")), F.lit(1_000_000_007)) / 1_000_000_007
    uses = F.floor("__mix_rate") + F.when(draw < F.col("__mix_rate") - F.floor("__mix_rate"), 1).otherwise(0)
    used = docs.join(rates.withColumn("__mix_uses", uses.cast("int")), F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return used.withColumn("__mix_use", F.explode(F.array_repeat(F.lit(0), F.col("__mix_uses")))).select(*docs.columns)
