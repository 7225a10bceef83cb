"""G-computation of mediation: fitted yearly models, censoring weights, simulated mediator times and expected risks."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import followup
from tessera.operators.models import save, uniform

CLIP = 1e-9


class Logit:
    """A fitted penalised logit as a column of its inputs; a constant where the outcome has one value."""

    def __init__(self, rows: DataFrame, label: str, inputs: dict[str, Column], weight: str | None = None, penalty: float = 1.0):
        w = F.col(weight) if weight else F.lit(1.0)
        some = rows.select(F.col(label).cast("double").alias("y"), w.alias("w"), *(c.cast("double").alias(k) for k, c in inputs.items())).na.drop()
        size = some.agg(F.sum("w").alias("w"), F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        self.names, self.constant = list(inputs), None
        if size.w is None or size.lo == size.hi:
            self.constant = float(size.mean or 0.0)
            return
        data = VectorAssembler(inputCols=self.names, outputCol="features").transform(some)
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=penalty / size.w, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
        self.intercept, self.coefficients = float(model.intercept), [float(c) for c in model.coefficients]

    def __call__(self, inputs: dict[str, Column]) -> Column:
        if self.constant is not None:
            return F.lit(min(1 - CLIP, max(CLIP, self.constant)))
        margin = F.lit(self.intercept)
        for name, c in zip(self.names, self.coefficients):
            margin = margin + inputs[name].cast("double") * c
        return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), 1 / (1 + F.exp(-margin))))


def _inputs(treated: Column, year: Column, mediator: Column | None = None) -> dict[str, Column]:
    out = {"treated": treated, "year": year, "age": F.col("age") / 10}
    if mediator is not None:
        out |= {"mediator": mediator, "both": treated * mediator}
    return out


def weighted_grid(grid: DataFrame, floor: float, cap: float) -> DataFrame:
    """Observed rows with their capped inverse probability of being observed so far."""
    seen = grid.withColumn("observed", (F.col("gap_year").isNull() | (F.col("follow_year") < F.col("gap_year"))).cast("int")).filter("gap_year is null or follow_year <= gap_year")
    model = Logit(seen, "observed", _inputs(F.col("treated"), F.col("follow_year")))
    rows = seen.withColumn("p", F.when(F.col("observed") == 1, model(_inputs(F.col("treated"), F.col("follow_year")))).otherwise(1.0)).withColumn("match_group", F.struct("simple_id", "t0"))
    return followup.ipcw(rows, floor, cap).filter("observed = 1").drop("match_group")


def simulate(grid: DataFrame, horizon: int = followup.HORIZON, simulations: int = 25, seed: int = 5, floor: float = 0.02, cap: float = 20.0) -> DataFrame:
    """grid: simple_id, t0, treated, age, follow_year, gap_year, mediator_before, mediator_new, mediator_now, y.

    q_am is the risk over the horizon of the treated people under arm a, with mediator times of arm m.  Times are drawn
    person by person from the mediator model, reduced to their distribution (horizon + 1 numbers), and given out anew by
    hash: a permutation over people without a global order.  Draws depend on (seed, person, simulation) alone.
    """
    grid = save(grid)
    rows = save(weighted_grid(grid, floor, cap))
    mediator = Logit(rows.filter("mediator_before = 0"), "mediator_new", _inputs(F.col("treated"), F.col("follow_year")), "weight")
    outcome = Logit(rows, "y", _inputs(F.col("treated"), F.col("follow_year"), F.col("mediator_now")), "weight")
    people = grid.filter("treated = 1 and follow_year = 1").select("simple_id", "t0", "age").withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
    shares = {}
    for m in (0, 1):
        time = F.lit(horizon + 1)
        for t in range(horizon, 0, -1):
            hit = uniform(F.lit(seed), F.lit(m), F.lit(t), "simple_id", "t0", "sim") < mediator(_inputs(F.lit(m), F.lit(t)))
            time = F.when(hit, F.lit(t)).otherwise(time)
        counts = {r.time: r["count"] for r in people.select(time.alias("time")).groupBy("time").count().collect()}  # horizon + 1 rows
        total = sum(counts.values())
        shares[m] = [counts.get(t, 0) / total if total else 0.0 for t in range(1, horizon + 1)]
    columns = {}
    for a in (0, 1):
        for m in (0, 1):
            u, time, below = uniform(F.lit(seed + 1), F.lit(m), "simple_id", "t0", "sim"), F.lit(horizon + 1), sum(shares[m])
            for t in range(horizon, 0, -1):
                time = F.when(u < below, F.lit(t)).otherwise(time)
                below -= shares[m][t - 1]
            alive = F.lit(1.0)
            for t in range(1, horizon + 1):
                alive = alive * (1 - outcome(_inputs(F.lit(a), F.lit(t), (time <= t).cast("int"))))
            columns[f"q{a}{m}"] = F.avg(1 - alive)
    q = people.agg(*(c.alias(k) for k, c in columns.items())).first()
    if q.q11 is None:
        values = [(k, None) for k in ("q00", "q01", "q10", "q11", "total", "direct", "indirect", "proportion")]
    else:
        total = q.q11 - q.q00
        values = [("q00", q.q00), ("q01", q.q01), ("q10", q.q10), ("q11", q.q11), ("total", total), ("direct", q.q10 - q.q00), ("indirect", q.q11 - q.q10), ("proportion", (q.q11 - q.q10) / total if abs(total) > 1e-12 else None)]
    return grid.sparkSession.createDataFrame(values, "effect string, value double")


def landmark(members: DataFrame, panel: DataFrame, covariates: tuple[str, ...] = (), landmark: int = 1, horizon: int = 1) -> DataFrame:
    """Natural effects by plug-in at a landmark: effect, value.

    members: match_group, t0, simple_id, treated and the covariates (null: 0).  Pairs count whose members both have a
    row in each year up to the landmark and live past it; the mediator is any such year's event.  Unpenalised logits
    give the mediator by arm and the yearly death hazard by arm, mediator, their product and year.  y{a}_m{b} is the
    mean over people of the risk over the whole horizon under arm a, with the mediator's probability under arm b.
    Without pairs all values are null.
    """
    deaths = panel.groupBy("simple_id").agg(F.max("death_year").alias("dy"))
    so_far = members.select("match_group", "treated", "t0", "simple_id").join(panel.select("simple_id", "ja", "msk"), "simple_id").filter((F.col("ja") > F.col("t0")) & (F.col("ja") <= F.col("t0") + landmark))
    state = so_far.groupBy("match_group", "treated").agg(F.countDistinct("ja").alias("n"), F.max("msk").alias("mediator"))
    alive = members.join(state, ["match_group", "treated"]).join(deaths, "simple_id", "left").filter((F.col("n") == landmark) & (F.col("dy").isNull() | (F.col("dy") > F.col("t0") + landmark)))
    both = alive.groupBy("match_group").agg(F.countDistinct("treated").alias("arms")).filter("arms = 2").select("match_group")
    people = save(alive.join(both, "match_group", "left_semi").select("match_group", "treated", "simple_id", "mediator", (F.col("dy") - F.col("t0") - landmark).alias("left"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in covariates)))
    own = {c: F.col(c) for c in covariates}
    rows = people.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).filter("left is null or year <= left").withColumn("y", F.coalesce((F.col("left") == F.col("year")).cast("int"), F.lit(0)))

    def hazard_inputs(a: Column, m: Column, year: Column) -> dict[str, Column]:
        return {"treated": a, "mediator": m, "both": a * m} | {f"year_{t}": (year == t).cast("int") for t in range(2, horizon + 1)} | own

    mediator = Logit(people, "mediator", {"treated": F.col("treated")} | own, penalty=0.0)
    hazard = Logit(rows, "y", hazard_inputs(F.col("treated"), F.col("mediator"), F.col("year")), penalty=0.0)

    def risk(a: int, m: int) -> Column:
        stay = F.lit(1.0)
        for t in range(1, horizon + 1):
            stay = stay * (1 - hazard(hazard_inputs(F.lit(a), F.lit(m), F.lit(t))))
        return 1 - stay

    chance = {b: mediator({"treated": F.lit(b)} | own) for b in (0, 1)}
    q = people.agg(*(F.avg(chance[b] * risk(a, 1) + (1 - chance[b]) * risk(a, 0)).alias(f"y{a}_m{b}") for a, b in ((0, 0), (1, 0), (1, 1)))).first()
    less = lambda x, y: None if x is None or y is None else x - y
    values = [*q.asDict().items(), ("total", less(q.y1_m1, q.y0_m0)), ("direct", less(q.y1_m0, q.y0_m0)), ("indirect", less(q.y1_m1, q.y1_m0))]
    return people.sparkSession.createDataFrame(values, "effect string, value double")
