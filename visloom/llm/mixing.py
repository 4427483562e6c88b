"""Mixing sources to target weights with soft domain membership.

A multinomial naive Bayes classifier over hashed words learns the label classes (quality and toxicity of the
label table) and gives every document a posterior over these domains.  Nonnegative document rates r then minimise
the squared distance between the expected domain token totals, sum(r * tokens * posterior), and the targets, by accelerated
projected gradient.  DataFrame functions only; the fit is distributed: each step is one aggregation over (tokens, posterior) rows.

Distances are weighed by the inverse second moment of the posteriors and changes of rates by tokens, so the gradient is 1-Lipschitz and
a step of length 1 that leaves no rate at zero is exact.  Rates are not stored between steps.  The change of a rate in a step depends on the
document only through its posterior, so a rate is the fold of "go on by a part of the last change, subtract, cut at zero" over the steps
so far, a few numbers each; each aggregation recomputes it inside the scan.

Gradient steps get slow where the best rates are zero for most documents, above all where targets are out of reach (README has figures).
What ``GRADIENT`` steps leave is therefore closed by proximal Newton steps.

Defined results: null or empty texts have 0 tokens and the prior as posterior, and get a rate like any other;
labels with a null are not learned from; without usable labels there is one domain "all" and every rate is 1;
very long texts count by all their words; equal rows get equal rates; of a repeated label id the first domain by name counts;
repeated rows count each; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from visloom.llm.rows import maybe_smallest, smallest
from visloom.storage import discard, noting, written

BUCKETS, SPACES = 4096, r"[ \t-\r]+"
GRADIENT = 40  # steps of projected gradient
NEAR = 1e-4  # weight of a Newton step's change of rates against the squared distance


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain, one row an id."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    name = F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))
    return ok.groupBy("doc_id").agg(F.min(name).alias("domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 2000) -> tuple[list[str], list[float], DataFrame]:
    """(domains, log priors, table of bucket and one log likelihood a domain).

    Word counts come from the ``max_rows`` labelled documents of each domain whose ids have the smallest hashes (a
    hard bound, so the sample is broadcast and texts stay where they are); priors come from all labels.  The table has BUCKETS rows, whatever the corpus.
    """
    lab = domains(labels)
    sizes = {r["domain"]: r["count"] for r in lab.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return ["all"], [0.0], docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0.0).alias("l0"))
    key = F.xxhash64("doc_id", F.lit("mixing"))
    few = lab.where(maybe_smallest(F.col("domain"), sizes, key, max_rows)).withColumn("_key", key)
    lab = smallest(few, "domain", ["_key", "doc_id"], max_rows).drop("_key")
    words = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("w"))
    counts = words.groupBy(_bucket(F.col("w")).alias("bucket")).agg(*[F.count(F.when(F.col("domain") == k, 1)).alias(f"c{i}") for i, k in enumerate(names)])
    counts = written(docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0), "mixing-counts")
    total = counts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))]).head()
    table = counts.select("bucket", *[(F.log(F.col(f"c{i}") + 1.0) - math.log(total[f"c{i}"] + BUCKETS)).alias(f"l{i}") for i in range(len(names))])
    n = sum(sizes.values())
    return names, [math.log(sizes[k] / n) for k in names], table


def posteriors(docs: DataFrame, names: list[str], priors: list[float], table: DataFrame) -> DataFrame:
    """doc_id, n_tokens, p0..pK per input row; evidence is tempered by the square root of the length."""
    k = range(len(names))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    keyed = numbered.select("_row", "doc_id", F.explode_outer(_words(F.col("text"))).alias("w"))
    sums = (
        keyed.withColumn("bucket", _bucket(F.col("w")))
        .join(F.broadcast(table), "bucket", "left")  # BUCKETS rows: a fixed bound
        .groupBy("_row", "doc_id")
        .agg(F.count("w").alias("n_tokens"), *[F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col(f"l{i}"))), F.lit(0.0)).alias(f"s{i}") for i in k])
    )
    soft = [F.lit(priors[i]) + F.col(f"s{i}") / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1))) for i in k]
    sums = sums.select("doc_id", "n_tokens", *[x.alias(f"z{i}") for i, x in enumerate(soft)])
    top = F.greatest(*[F.col(f"z{i}") for i in k]) if len(names) > 1 else F.col("z0")
    e = sums.select("doc_id", "n_tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in k])
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return e.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def rate_after(steps: list[list[float]], n: int) -> Column:
    """Rate of a row after these steps from 1, each a number b and a vector: add b times the last change, subtract posterior . vector, cut at 0."""
    if not steps:
        return F.lit(1.0)
    flat = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    both = lambda r, last: F.struct(r.alias("r"), last.alias("last"))

    def move(at: Column, s: Column) -> Column:
        ahead = at["r"] + s[0] * (at["r"] - at["last"])
        return both(F.greatest(F.lit(0.0), ahead - sum((F.col(f"p{i}") * s[i + 1] for i in range(n)), F.lit(0.0))), at["r"])

    return F.aggregate(flat, both(F.lit(1.0), F.lit(1.0)), move)["r"]


def _newton(measured: Callable, first: tuple, goal: np.ndarray, ridge: np.ndarray, near: Callable) -> tuple[np.ndarray, tuple]:
    """One proximal step: (its vector, what ``measured`` says after it); ``first`` is what it says before.

    The step minimises the squared distance to ``goal`` plus NEAR times the token-weighted squared change of rates.  Its dual is
    a convex function of one small vector, whose second derivative is the second moment of the rows with a positive rate.
    """
    at, (half, reached, active) = np.zeros(len(goal)), first
    value, weigh = half, np.linalg.inv(ridge)
    while not near(reached):
        slope, gap = reached - goal + NEAR * ridge @ at, reached - goal
        if slope @ weigh @ slope <= 1e-8 * (gap @ weigh @ gap):
            break
        move = -np.linalg.solve(active + NEAR * ridge, slope)
        down, length = float(slope @ move), 1.0
        while True:  # back off while the dual rises
            trial = at + length * move
            found = measured(trial)
            new = found[0] - float(goal @ trial) + 0.5 * NEAR * float(trial @ ridge @ trial)
            if new <= value + 1e-4 * length * down + 1e-12 * (1 + abs(value)):
                break
            length /= 2
        at, value, (half, reached, active) = trial, new, found
    return at, (half, reached, active)


def fit_rates(rows: DataFrame, n: int, targets: list[float] | None = None, tolerance: float = 1e-3, limit: int = 500) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps as ``rate_after`` takes them, target shares, reached shares) for rows with n_tokens and p0..pn-1.

    Targets are shares of the present token total; by default each domain's present share to the power 0.5,
    rescaled to sum to 1.  Distances are weighed by the inverse second moment of the posteriors (one small matrix).
    The fit ends when every share is within ``tolerance`` of its target, relative to it (absolute tolerance**2 below a share
    of ``tolerance``), or when the squared distance is proven to be within ``tolerance`` of the least that any rates have, relative to it:
    then no rates meet the targets.  Neither after ``limit`` aggregations is an error.
    """
    tokens = F.sum("n_tokens")
    pair = [(i, j) for i in range(n) for j in range(i, n)]
    moment = lambda w: [F.sum(w * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i, j in pair]
    base = rows.agg(tokens.alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"u{i}") for i in range(n)], *moment(F.col("n_tokens"))).head()
    total = float(base["n"] or 0)
    if not total:
        return [], [0.0] * n, [0.0] * n
    share = [max(base[f"u{i}"] / total, 1e-9) for i in range(n)]
    root = [math.sqrt(x) for x in share]
    goal = np.array(targets or [x / sum(root) for x in root])
    history: list[list[float]] = []
    reached, used = np.array(share), 1

    def square(got: Row) -> np.ndarray:
        m = np.zeros((n, n))
        for i, j in pair:
            m[i, j] = m[j, i] = (got[f"m{i}_{j}"] or 0.0) / total
        return m

    def near(x: np.ndarray) -> bool:
        return bool(np.all(np.abs(x - goal) <= tolerance * np.maximum(goal, tolerance)))

    def count() -> None:
        nonlocal used
        if used >= limit:
            raise RuntimeError(f"rates are not fitted after {used} aggregations: targets {goal.tolist()}, reached {reached.tolist()}")
        used += 1

    def measured(step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the mean squared rate, the shares, and the second moments of rows with a positive rate after one more step."""
        count()
        part = rows.select("n_tokens", *[f"p{i}" for i in range(n)], rate_after([*history, [0.0, *(-step)]], n).alias("r"))
        r, t = F.col("r"), F.col("n_tokens")
        got = part.agg((F.sum(r * r * t) / 2).alias("half"), *[F.sum(r * t * F.col(f"p{i}")).alias(f"u{i}") for i in range(n)], *moment(F.when(r > 0, t))).head()
        return got["half"] / total, np.array([got[f"u{i}"] / total for i in range(n)]), square(got)

    def shares() -> np.ndarray:
        """After the steps so far."""
        count()
        part = rows.select("n_tokens", *[f"p{i}" for i in range(n)], rate_after(history, n).alias("r"))
        got = part.agg(*[F.sum(F.col("r") * F.col("n_tokens") * F.col(f"p{i}")).alias(f"u{i}") for i in range(n)]).head()
        return np.array([got[f"u{i}"] / total for i in range(n)])

    def least(ridge: np.ndarray) -> float:
        """A lower bound on half the squared distance: posteriors sum to 1, so one number makes any slope a feasible dual."""
        count()
        slope = np.linalg.solve(ridge, goal - reached)
        top = rows.where("n_tokens > 0").agg(F.max(sum((F.col(f"p{i}") * float(slope[i]) for i in range(n)), F.lit(0.0)))).head()[0]
        bound = slope - top
        return float(goal @ bound - 0.5 * bound @ ridge @ bound)

    moments = square(base)
    ridge = moments + 1e-9 * np.trace(moments) * np.eye(n)
    last, speed = reached, 1.0
    while not near(reached) and len(history) < GRADIENT:
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead = (speed - 1) / faster
        slope = np.linalg.solve(ridge, reached + ahead * (reached - last) - goal)  # shares are linear in the rates
        history.append([ahead, *slope.tolist()])
        last, reached = reached, shares()
        speed = 1.0 if slope @ (reached - last) > 0 else faster  # start again where the last change went uphill
    now = None if near(reached) else measured(np.zeros(n))
    while not near(reached):
        step, now = _newton(measured, now, goal, ridge, near)
        history.append([0.0, *(-step).tolist()])
        reached = now[1]
        gap = 0.5 * float((goal - reached) @ np.linalg.solve(ridge, goal - reached))
        if not near(reached) and gap - least(ridge) <= tolerance * gap:
            break
    return history, goal.tolist(), reached.tolist()


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior (array, domains in name order), rate (nonnegative), expected_tokens, target, reached.

    ``target`` and ``reached`` are the shares of ``fit_rates``, the same in each row, so that a gap which no rates close is seen.
    """
    with noting() as made:
        names, priors, table = fit_classifier(docs, labels)
    rows = written(posteriors(docs, names, priors, table), "mixing-posteriors")
    discard(*made)
    n = len(names)
    history, goal, reached = fit_rates(rows, n, [targets.get(k, 0.0) for k in names] if targets else None)
    out = rows.withColumn("rate", rate_after(history, n))
    shares = [F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in (("target", goal), ("reached", reached))]
    return out.select("doc_id", "n_tokens", F.array(*[f"p{i}" for i in range(n)]).alias("posterior"), "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"), *shares)
