"""Yearly histories for g-computation: models of income status, amounts and binary states, and draws from them.

Fitted models are columns of their inputs, so a drawn year is a projection: no exchange, no Python, and each draw
depends on the seed and the row's keys alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators.gcomp import Logit
from tessera.operators.models import save, uniform

EARNED, PENSIONED = ("earnings_only", "both"), ("pension_only", "both")
KEPT_BY = {"entgelt": EARNED, "rtzb": PENSIONED}


def specs(plan: dict[str, list[str]], earnings: bool = True, binary: tuple[str, ...] = ("rehab",)) -> dict[str, list[str]]:
    """Predictors of the yearly models by role: those of the baseline plan, last year's state, arm and mediator."""
    amounts = ["prior_entgelt"] * earnings + ["prior_rtzb"]
    unique = lambda *names: list(dict.fromkeys(names))
    return {
        "numeric": unique(*plan.get("numeric", ()), *amounts),
        "binary": unique(*plan.get("binary", ()), *(f"prior_{b}" for b in binary), "treated", "mediator_prev"),
        "categorical": unique(*plan.get("categorical", ()), *plan.get("exact", ()), "prior_income", "follow_year"),
    }


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(x.MISSING))


def design(rows: DataFrame, roles: dict[str, list[str]]) -> dict[str, Column]:
    """Model inputs by name: numbers in standard deviations from the mean of rows (null: the mean), flags (null: 0), and an
    indicator for each level but the first (null is a level; one that rows don't have has no indicator)."""
    found = rows.agg(
        *(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in roles["numeric"] for n, f in (("mean", F.avg), ("sd", F.stddev_pop))),
        *(F.sort_array(F.collect_set(_level(c))).alias(f"levels_{c}") for c in roles["categorical"]),
        F.count("*").alias("n"),
    ).first()
    out = {}
    for c in roles["numeric"]:
        mean, sd = found[f"mean_{c}"] or 0.0, found[f"sd_{c}"] or 0.0
        if sd > 0:
            out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(mean)) - mean) / sd
    out |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in roles["binary"]}
    out |= {f"{c}={v}": (_level(c) == v).cast("double") for c in roles["categorical"] for v in found[f"levels_{c}"][1:]}
    return out


def _assembled(rows: DataFrame, y: Column, inputs: dict[str, Column], weight: str | None) -> tuple[DataFrame, list[str]]:
    """y, w and features; inputs go by number, as their names can hold any character."""
    names = [f"x{i}" for i in range(len(inputs))]
    data = rows.select(y.alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *(c.alias(n) for n, c in zip(names, inputs.values())))
    return VectorAssembler(inputCols=names, outputCol="features").transform(data), names


def _margin(intercept: float, coefficients, inputs: dict[str, Column]) -> Column:
    out = F.lit(float(intercept))
    for c, v in zip(coefficients, inputs.values()):
        out = out + v * float(c)
    return out


class Multinomial:
    """A multinomial logit with a slight ridge.  One class: a constant.  No rows: ValueError."""

    def __init__(self, rows: DataFrame, label: str, inputs: dict[str, Column], weight: str | None = None, penalty: float = 1e-4):
        self.inputs = inputs
        size = rows.agg(F.sort_array(F.collect_set(_level(label))).alias("classes"), F.count("*").alias("n")).first()
        if not size.n:
            raise ValueError(f"no rows for the model of {label}")
        self.classes = size.classes
        if len(self.classes) > 1:
            place = F.array_position(F.array(*map(F.lit, self.classes)), _level(label)).cast("double") - 1
            data, _ = _assembled(rows, place, inputs, weight)
            model = LogisticRegression(family="multinomial", labelCol="y", weightCol="w", regParam=penalty / size.n, standardization=False, maxIter=300, tol=1e-9).fit(data)
            self.intercepts, self.coefficients = model.interceptVector.toArray(), model.coefficientMatrix.toArray()

    def draw(self, df: DataFrame, name: str, u: Column) -> DataFrame:
        """df with a class drawn: the first whose cumulative probability reaches u, a number in [0, 1)."""
        if len(self.classes) == 1:
            return df.withColumn(name, F.lit(self.classes[0]))
        add = lambda a, b: a + b
        margins = F.array(*(_margin(i, c, self.inputs) for i, c in zip(self.intercepts, self.coefficients)))
        shares = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
        total = F.aggregate("_shares", F.lit(0.0), add)
        passed = F.filter(F.sequence(F.lit(1), F.lit(len(self.classes))), lambda k: F.aggregate(F.slice("_shares", F.lit(1), k), F.lit(0.0), add) < u * total)
        place = F.least(F.size(passed) + 1, F.lit(len(self.classes)))
        return df.withColumn("_margins", margins).withColumn("_shares", shares).withColumn(name, F.element_at(F.array(*map(F.lit, self.classes)), place)).drop("_margins", "_shares")


class LogAmount:
    """log(1 + amount), linear in its inputs with normal residuals.  Draws are at most headroom over the largest
    log seen, and at least 0.  A null or negative amount counts as 0.  No rows: ValueError."""

    def __init__(self, rows: DataFrame, label: str, inputs: dict[str, Column], weight: str | None = None, headroom: float = 3.0):
        self.inputs = inputs
        y = F.log1p(F.greatest(F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.lit(0.0)))
        size = rows.agg(F.count("*").alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        if not size.n:
            raise ValueError(f"no rows for the model of {label}")
        self.cap = size.hi + headroom
        if size.lo == size.hi:
            self.intercept, self.coefficients, self.sd = size.lo, [0.0] * len(inputs), 0.0
            return
        data, _ = _assembled(rows, y, inputs, weight)
        model = LinearRegression(labelCol="y", weightCol="w", maxIter=300, tol=1e-9).fit(data)
        self.intercept, self.coefficients = float(model.intercept), [float(c) for c in model.coefficients]
        left = y - self.mean()
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        s = rows.agg(F.sum(w).alias("w"), F.sum(w * left).alias("a"), F.sum(w * left * left).alias("b")).first()
        spread = max(0.0, s.b / s.w - (s.a / s.w) ** 2)
        self.sd = math.sqrt(spread if weight else spread * size.n / max(size.n - 1, 1))

    def mean(self) -> Column:
        return _margin(self.intercept, self.coefficients, self.inputs)

    def draw(self, z: Column) -> Column:
        """An amount for a standard normal number z."""
        return F.greatest(F.lit(0.0), F.expm1(F.least(F.lit(self.cap), self.mean() + z * self.sd)))


def normal(*keys) -> Column:
    """A fixed standard normal number of the keys (Box and Muller's transform of two uniform ones)."""
    return F.sqrt(-2 * F.ln(1 - uniform(F.lit(1), *keys))) * F.cos(2 * math.pi * uniform(F.lit(2), *keys))


@dataclass
class History:
    """Models in the order of the draws: status, amounts given the status, binary states given all before them."""

    status: Multinomial
    amounts: dict[str, LogAmount]
    binary: dict[str, tuple[Logit, dict[str, Column]]]

    def update(self, frame: DataFrame, seed: int, *keys: str) -> DataFrame:
        """frame with a year drawn: current_* by the models, then prior_* set to them.  Amounts that the drawn status
        doesn't have are 0.  A draw depends on (seed, its place, keys)."""
        at = lambda k: (F.lit(seed), F.lit(k), *keys)
        out = self.status.draw(frame, "current_income", uniform(*at("income")))
        for name, model in self.amounts.items():
            out = out.withColumn(f"current_{name}", model.draw(normal(*at(name))))
        has = lambda name: F.col("current_income").isin(*KEPT_BY[name])
        out = out.withColumns({f"current_{name}": F.when(has(name), F.col(f"current_{name}")).otherwise(0.0) for name in self.amounts if name in KEPT_BY})
        for name, (model, inputs) in self.binary.items():
            out = out.withColumn(f"current_{name}", (uniform(*at(name)) < model(inputs)).cast("int"))
        return out.withColumns({f"prior_{n}": F.col(f"current_{n}") for n in ("income", *self.amounts, *self.binary)})


def fit(rows: DataFrame, roles: dict[str, list[str]], amounts: tuple[str, ...] = ("entgelt", "rtzb"), binary: tuple[str, ...] = ("rehab",), weight: str | None = None, headroom: float = 3.0) -> History:
    """rows: the predictors of roles (see specs), mediator_now, current_income, and current_* of amounts and binary states."""
    rows = save(rows)
    base = {**roles, "binary": [*roles["binary"], "mediator_now"]}
    status = Multinomial(rows, "current_income", design(rows, base), weight)
    given = {**base, "categorical": [*base["categorical"], "current_income"]}
    fitted = {a: LogAmount(rows, f"current_{a}", design(rows, given), weight, headroom) for a in amounts}
    given = {**given, "numeric": [*given["numeric"], *(f"current_{a}" for a in amounts)]}
    states = {}
    for name in binary:
        inputs = design(rows, given)
        states[name] = (_logit(rows, f"current_{name}", inputs, weight), inputs)
        given = {**given, "binary": [*given["binary"], f"current_{name}"]}
    return History(status, fitted, states)


def _logit(rows: DataFrame, label: str, inputs: dict[str, Column], weight: str | None) -> Logit:
    model = Logit(rows, label, {f"x{i}": c for i, c in enumerate(inputs.values())}, weight, 1e-4)
    if model.constant is None:
        model.names = list(inputs)
    return model
