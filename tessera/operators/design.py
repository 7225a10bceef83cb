"""Adjusted outcome models: a design of columns, its rank, and an unpenalised logit with clustered errors.

Statistics, Newton steps and both parts of the sandwich are aggregations of k x k sums (k design columns); rows never
reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import MISSING
from tessera.operators import batched, resample
from tessera.operators.models import save

MOST_LEVELS = 1000


def columns(rows: DataFrame, numeric=(), amounts=(), binary=(), categorical=(), years: str = "follow_year") -> dict[str, Column]:
    """Design columns by name: intercept, treated, dummies of all years but the first; numbers with nulls set to their
    median (amounts as log(1 + x), negative ones as 0), centred and scaled; flags with nulls set to the mode (the
    least of ties); a missing flag where nulls occur; dummies of all levels but the first, null being a level.
    More than MOST_LEVELS levels raise ValueError."""
    numbers = [*numeric, *amounts]
    first = [F.percentile(F.col(c).cast("double"), 0.5).alias(f"f_{c}") for c in numbers] + [F.mode(F.col(c).cast("double"), True).alias(f"f_{c}") for c in binary]
    first += [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in [*numbers, *binary]] + [F.approx_count_distinct(c).alias(f"d_{c}") for c in categorical]
    got = rows.agg(F.count("*").alias("rows"), *first).first()
    if wide := [c for c in categorical if got[f"d_{c}"] > MOST_LEVELS]:
        raise ValueError(f"too many levels: {', '.join(wide)}")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(got[f"f_{c}"] or 0.0))) for c in [*numbers, *binary]}
    filled |= {c: F.log1p(F.greatest(F.lit(0.0), filled[c])) for c in amounts}
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    second = rows.agg(F.array_sort(F.collect_set(years)).alias("_years"), *(f(filled[c]).alias(f"{n}_{c}") for c in numbers for n, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.array_sort(F.collect_set(level(c))).alias(f"l_{c}") for c in categorical)).first()
    out = {"intercept": F.lit(1.0), "treated": F.col("treated").cast("double")}
    out |= {f"year_{y}": (F.col(years) == y).cast("double") for y in second["_years"][1:]}
    for c in numbers:
        spread = second[f"s_{c}"] or 0.0
        out[c] = (filled[c] - F.lit(float(second[f"m_{c}"] or 0.0))) / F.lit(spread if spread > 1e-12 else 1.0)
    out |= {c: filled[c] for c in binary}
    out |= {f"{c}_missing": F.col(c).isNull().cast("double") for c in [*numbers, *binary] if got[f"n_{c}"]}
    return out | {f"{c}_{v}": (level(c) == v).cast("double") for c in categorical for v in second[f"l_{c}"][1:]}


def _sums(frame: DataFrame, part) -> np.ndarray:
    """Sum over batches of the vector that part(batch) makes, added up by position."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                v = part(pdf)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total.tolist()]})

    got = frame.mapInPandas(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()  # k * (k + 1) numbers
    return np.array([r.v for r in got])


def pivoted(gram: np.ndarray, always: int | None = None, constant: tuple[int, ...] = (), tolerance: float = 1e-9) -> list[int]:
    """Columns of full rank, in their order, by the pivots of a QR decomposition with column exchange, read off the Gram matrix
    (its Cholesky decomposition with the same exchange): the next column is the one with the longest rest beyond the columns chosen, until
    rests are within tolerance of their columns' squared lengths.

    always: a column that takes the last one's place where it isn't chosen, and comes first of all where it depends on the others.
    constant: columns that don't vary (none is chosen).
    """

    def exchange(first: int | None = None) -> list[int]:
        left, chosen = gram.astype(float).copy(), []
        while len(chosen) < len(gram):
            rest = np.where(np.diag(left) > tolerance * np.diag(gram), np.diag(left), 0.0)
            rest[[*chosen, *constant]] = 0.0
            j = int(np.argmax(rest)) if chosen or first is None else first
            if rest[j] <= 0:
                break
            chosen.append(j)
            left -= np.outer(left[:, j], left[j]) / left[j, j]
        return chosen

    chosen = exchange()
    if always is not None and always not in chosen and gram[always, always] > 0:
        chosen = [*chosen[:-1], always]
        own = gram[np.ix_(chosen, chosen)] / np.sqrt(np.outer(np.diag(gram)[chosen], np.diag(gram)[chosen]))
        if np.linalg.eigvalsh(own)[0] <= tolerance:
            chosen = exchange(always)
    return sorted(chosen)


def unvaried(gram: np.ndarray, intercept: int = 0) -> tuple[int, ...]:
    """Columns but the intercept whose variance is nothing, by sums and squares."""
    n = gram[intercept, intercept]
    mean = gram[intercept] / max(n, 1)
    return tuple(j for j in range(len(gram)) if j != intercept and gram[j, j] / max(n, 1) - mean[j] ** 2 <= 1e-12)


def resampled(flat: DataFrame, xs: list[str], which: str, replicates: int, seed: int) -> tuple[float, float, float, int] | None:
    """(standard deviation, 2.5 % and 97.5 % quantile, fits) of a coefficient over resamples of clusters g, all fitted together by
    passes over the rows; None with fewer than half of the replicates, or 20."""
    clusters = save(flat.select("g").distinct())
    data = save(flat.join(resample.weights(clusters, "g", range(1, replicates + 1), seed), "g"))

    def prepare(batch):
        frame = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*xs, "y"]} | {"all": np.ones(batch.num_rows, bool)}
        drawn = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return frame, drawn * batch.column("w").to_numpy(zero_copy_only=False)[:, None]

    plain = batched.Design(binary={c: (0.0, False) for c in xs}, intercept=False)
    fit = batched.fit(data, prepare, [batched.Model("y", "binary", "y", "all", plain)], replicates)["y"]
    got = fit.coefficients[:, xs.index(which)][fit.converged]
    if len(got) < max(20, replicates // 2):
        return None
    return float(got.std(ddof=1)), float(np.quantile(got, 0.025)), float(np.quantile(got, 0.975)), len(got)


def logit(rows: DataFrame, outcome: str, design: dict[str, Column], cluster: str = "match_group", weight: str | None = None, steps: int = 50, replicates: int = 200, seed: int = 13) -> DataFrame:
    """term, coefficient, se, odds_ratio, ci_low, ci_high, p, method: one row per design column that is kept.

    Columns are kept by pivoting, the treatment always.  method is `newton`; where the likelihood has no finite maximum, the rung of
    batched.LADDER that settled.  Where that is so, or there are no more clusters than columns + 1, the clustered covariance doesn't
    hold: the treatment's se and limits are then of `replicates` resamples of clusters (method ends in `bootstrap`), and
    null where too few of them can be fitted; other terms have none.  No rows: no terms.
    """
    names = list(design)
    # each Newton step is a pass: they read a table of the design
    flat = save(rows.select(F.col(cluster).alias("g"), F.col(outcome).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *(c.alias(f"x{i}") for i, c in enumerate(design.values()))))
    schema = "term string, coefficient double, se double, odds_ratio double, ci_low double, ci_high double, p double, method string"
    every = [f"x{i}" for i in range(len(names))]

    def squares(pdf):
        x = pdf[every].to_numpy(float)
        return (x.T @ x).ravel()

    gram = _sums(flat, squares)
    if not len(gram):
        return rows.sparkSession.createDataFrame([], schema)
    gram = gram.reshape(len(names), -1)
    treated = names.index("treated") if "treated" in names else None
    keep = pivoted(gram, treated, tuple(j for j in unvaried(gram) if j != treated))
    xs, k = [every[i] for i in keep], len(keep)
    flat = flat.select("g", "y", "w", *xs)

    def fit(ridge: float) -> tuple[np.ndarray, np.ndarray, bool]:
        b = np.zeros(k)
        for _ in range(steps):

            def slopes(pdf, b=b):
                x, w = pdf[xs].to_numpy(float), pdf.w.to_numpy(float)
                p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
                return np.concatenate([((x * (w * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (w * (pdf.y.to_numpy(float) - p))])

            both = _sums(flat, slopes)
            h = both[: k * k].reshape(k, k) + ridge * np.eye(k)
            step = np.linalg.pinv(h) @ (both[k * k :] - ridge * b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                return b, h, bool(ridge or np.abs(b).max() < 15)
        return b, h, False

    for penalty, name in batched.LADDER:
        b, h, done = fit(penalty)
        method = name if penalty else "newton"
        if done:
            break
    else:
        method += ", not settled"
    margin = sum((F.col(c) * float(v) for c, v in zip(xs, b)), F.lit(0.0))
    e = F.col("w") * (F.col("y") - 1 / (1 + F.exp(-margin)))
    scores = flat.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(e * F.col(c)).alias(c) for c in xs))

    def outer(pdf):
        s = pdf[xs].to_numpy(float)
        return np.concatenate([(s.T @ s).ravel(), [len(s), float(pdf.n.sum())]])

    both = _sums(scores, outer)
    groups, n = both[-2:]
    se = [None] * k
    if method == "newton" and groups > k + 1:
        bread = np.linalg.pinv(h)
        cov = bread @ both[:-2].reshape(k, k) @ bread * groups / (groups - 1) * (n - 1) / max(n - k, 1)
        se = [float(math.sqrt(max(v, 0.0))) or None for v in np.diag(cov)]
    drawn = None
    if treated in keep and se[keep.index(treated)] is None:
        method += ", bootstrap"
        drawn = resampled(flat, xs, every[treated], replicates, seed)
    odds, out = lambda v: float(np.exp(np.clip(v, -50, 50))), []
    for i, c, s in zip(keep, b, se):
        low, high = (c - 1.96 * s, c + 1.96 * s) if s else (None, None)
        if drawn and i == treated:
            s, low, high, _ = drawn
        tail = math.erfc(abs(c / s) / math.sqrt(2)) if s else None
        limits = (None, None) if low is None else (odds(low), odds(high))
        out.append((names[i], float(c), s, odds(c), *limits, tail, method))
    return rows.sparkSession.createDataFrame(out, schema)
