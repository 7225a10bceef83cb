"""Follow-up grids, curves, event studies, mediation grids and multiple testing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.models import save

HORIZON, REGISTRY_END = 5, 2001
GROUP = ["match_group", "treated"]


def grid(members: DataFrame, panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Years 1..horizon after t0 of each pair member, cut after the first event (1) or death (2); an event wins a tie."""
    years = members.withColumn("follow_year", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ja", F.col("t0") + F.col("follow_year"))
    deaths = panel.groupBy("simple_id").agg(F.max("death_year").alias("death_year"))
    rows = years.join(panel.select("simple_id", "ja", "rehab", F.lit(1).alias("seen")), ["simple_id", "ja"], "left").join(deaths, "simple_id", "left")
    kind = F.when(F.col("rehab") == 1, 1).when(F.col("death_year") <= F.col("ja"), 2).otherwise(0)
    w = Window.partitionBy(*GROUP).orderBy("follow_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"observed": F.coalesce("seen", F.lit(0)), "event_type": kind}).withColumn("so_far", F.sum((F.col("event_type") > 0).cast("int")).over(w))
    return out.filter((F.col("so_far") - (F.col("event_type") > 0).cast("int")) == 0).select(*GROUP, "t0", "simple_id", "follow_year", "ja", "observed", "event_type")


def pair_censor(follow: DataFrame) -> DataFrame:
    """Both members end before the first unobserved year of either."""
    gap = F.min(F.when(F.col("observed") == 0, F.col("follow_year"))).over(Window.partitionBy("match_group"))
    return follow.withColumn("gap", gap).filter("gap is null or follow_year < gap").drop("gap")


def mortality_grid(members: DataFrame, panel: DataFrame, horizon: int = 5, end: int = REGISTRY_END) -> DataFrame:
    deaths = panel.groupBy("simple_id").agg(F.max("death_year").alias("death_year"))
    last = F.least(F.col("t0") + horizon, F.lit(end), F.col("death_year"))
    rows = members.join(deaths, "simple_id", "left").withColumn("last", last).filter("last > t0")
    return rows.withColumn("ja", F.explode(F.sequence(F.col("t0") + 1, F.col("last")))).select(*GROUP, "t0", "simple_id", "ja", (F.col("ja") - F.col("t0")).alias("follow_year"), F.coalesce((F.col("death_year") == F.col("ja")).cast("int"), F.lit(0)).alias("death_event"))


def counts(follow: DataFrame, weight: str | None = None) -> DataFrame:
    if weight is None:
        return follow.groupBy("treated", "follow_year").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("d1"), F.count_if(F.col("event_type") == 2).alias("d2"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col(weight))), F.lit(0))
    return follow.groupBy("treated", "follow_year").agg(F.sum(weight).alias("n"), of(1).alias("d1"), of(2).alias("d2"))


def survival(c: DataFrame, hazard, group: str = "treated") -> DataFrame:
    """Product of 1 - hazard up to and before each year; a hazard of 1 makes 0 (ln 0 is avoided)."""
    w = Window.partitionBy(group).orderBy("follow_year")
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    h = c.withColumn("h", hazard)
    factor = lambda win: F.when(F.coalesce(F.max((F.col("h") >= 1).cast("int")).over(win), F.lit(0)) == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("h") < 1, F.ln(1 - F.col("h")))).over(win), F.lit(0.0))))
    return h.withColumns({"surv": factor(upto), "surv_before": factor(before)})


def incidence(follow: DataFrame, weight: str | None = None) -> DataFrame:
    """Aalen-Johansen incidence of event 1 against competing event 2, of rows or of their weights."""
    s = survival(counts(follow, weight), (F.col("d1") + F.col("d2")) / F.col("n"))
    w = Window.partitionBy("treated").orderBy("follow_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn("cif", F.sum(F.col("surv_before") * F.col("d1") / F.col("n")).over(w))


def kaplan_meier(grid_: DataFrame) -> DataFrame:
    c = grid_.groupBy("treated", "follow_year").agg(F.count("*").alias("n"), F.sum("death_event").alias("d"))
    return survival(c, F.col("d") / F.col("n")).withColumn("risk", 1 - F.col("surv"))


def event_panel(pairs: DataFrame, panel: DataFrame, low: int = -3, high: int = 5) -> DataFrame:
    """Complete pairs by event time: both arms' values side by side, and their difference."""
    from tessera.operators.pairs import assignment

    rows = assignment(pairs).join(panel.select("simple_id", "ja", "rehab"), "simple_id").withColumn("event_time", F.col("ja") - F.col("t0")).filter(F.col("event_time").between(low, high))
    wide = rows.groupBy("match_group", "t0", "event_time").agg(F.max(F.when(F.col("treated") == 1, F.col("rehab"))).alias("treated_rehab"), F.max(F.when(F.col("treated") == 0, F.col("rehab"))).alias("control_rehab"), F.countDistinct("treated").alias("arms"))
    return wide.filter("arms = 2").select("match_group", "t0", "event_time", "treated_rehab", "control_rehab", (F.col("treated_rehab") - F.col("control_rehab")).alias("pair_diff"))


def pair_means(panel: DataFrame, least: int = 20) -> DataFrame:
    """Means of both arms and pairs by event time, and whether a count that made them is small: under `least` pairs, or
    from 1 to least - 1 positive or zero values of an arm."""
    arms = ("treated_rehab", "control_rehab")
    some = panel.filter(" and ".join(f"{a} is not null" for a in arms))
    g = some.groupBy("event_time").agg(*(F.avg(a).alias(a.replace("rehab", "mean")) for a in arms), F.count("*").alias("n_pairs"), *(F.count_if(F.col(a) > 0).alias(f"_p_{a}") for a in arms), *(F.count_if(F.col(a) == 0).alias(f"_z_{a}") for a in arms))
    few = F.col("n_pairs") < least
    for a in arms:
        for k in ("p", "z"):
            few = few | F.col(f"_{k}_{a}").between(1, least - 1)
    return g.select("event_time", "treated_mean", "control_mean", "n_pairs", few.alias("review"))


def event_study(panel: DataFrame, reference: int = -1) -> DataFrame:
    """OLS of pair differences on event-time dummies: mean_k - mean_reference, with errors clustered by pair.

    A cluster's influence on the coefficient is its residual sum at k over n_k less that at the reference over
    n_ref, so the sandwich is a sum of squares over clusters, in two aggregations."""
    panel = save(panel.select("match_group", "event_time", "pair_diff"))
    # a row an event time reaches the driver, of a window of a few years
    means = {r.event_time: r for r in panel.groupBy("event_time").agg(F.count("*").alias("n"), F.avg("pair_diff").alias("mean")).collect()}
    schema = "event_time int, n long, estimate double, se double"
    if reference not in means:
        return panel.sparkSession.createDataFrame([], schema)
    at = F.create_map(*[F.lit(v) for k, r in means.items() for v in (k, float(r["mean"]))])
    resid = panel.withColumn("e", F.col("pair_diff") - at[F.col("event_time")])
    e_ref = F.coalesce(F.max(F.when(F.col("event_time") == reference, F.col("e"))).over(Window.partitionBy("match_group")), F.lit(0.0))
    sums = resid.withColumn("e_ref", e_ref).groupBy("event_time").agg(F.sum(F.col("e") * F.col("e")).alias("ss"), F.sum(F.col("e") * F.col("e_ref")).alias("cross")).collect()
    g = panel.agg(F.countDistinct("match_group")).first()[0]
    rows, k, ref = sum(r.n for r in means.values()), len(means), means[reference]
    ss_ref = next(r.ss for r in sums if r.event_time == reference)
    scale = g / max(g - 1, 1) * (rows - 1) / max(rows - k, 1)
    out = []
    for r in sums:
        if r.event_time != reference:
            n = means[r.event_time].n
            var = r.ss / n**2 + ss_ref / ref.n**2 - 2 * r.cross / (n * ref.n)
            out.append((r.event_time, n, float(means[r.event_time]["mean"] - ref["mean"]), max(0.0, scale * var) ** 0.5))
    return panel.sparkSession.createDataFrame(sorted(out), schema)


def pretrend(panel: DataFrame, reference: int = -1) -> DataFrame:
    """Joint Wald test that all coefficients before the reference are 0, with the pair-clustered covariance.

    A pair's influence on coefficient k is its residual at k over n_k less that at the reference over n_ref; their
    cross products by event times make the covariance in one aggregation."""
    import numpy as np

    from tessera.functions.stats import chi2_tail

    panel = save(panel.select("match_group", "event_time", "pair_diff"))
    means = {r.event_time: r for r in panel.groupBy("event_time").agg(F.count("*").alias("n"), F.avg("pair_diff").alias("mean")).collect()}  # a row an event time
    early = sorted(k for k in means if k < reference)
    schema = "chi2 double, df int, p double"
    if reference not in means or not early:
        return panel.sparkSession.createDataFrame([(None, 0, None)], schema)
    e = lambda k: F.sum(F.when(F.col("event_time") == k, F.col("pair_diff") - float(means[k]["mean"])).otherwise(0.0))
    per = panel.groupBy("match_group").agg(*((e(k) / means[k].n - e(reference) / means[reference].n).alias(f"f{i}") for i, k in enumerate(early)))
    m = len(early)
    sums = per.agg(F.count("*").alias("g"), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"m{i}_{j}") for i in range(m) for j in range(i, m))).first()
    rows, k = sum(r.n for r in means.values()), len(means)
    cov = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) * sums.g / max(sums.g - 1, 1) * (rows - 1) / max(rows - k, 1)
    b = np.array([means[t]["mean"] - means[reference]["mean"] for t in early])
    chi2, df = float(b @ np.linalg.pinv(cov) @ b), int(np.linalg.matrix_rank(cov))
    return panel.sparkSession.createDataFrame([(chi2, df, chi2_tail(chi2, df) if df else None)], schema)


def ipcw(rows: DataFrame, floor: float = 0.02, cap: float = 20.0) -> DataFrame:
    """Inverse probability weights: capped product of 1 / max(p, floor) over the years so far."""
    w = Window.partitionBy(*GROUP).orderBy("follow_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("weight", F.least(F.lit(cap), F.exp(F.sum(-F.ln(F.greatest(F.col("p"), F.lit(floor)))).over(w))))


def mediation_grid(risk: DataFrame, panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Full grid, not cut at death: the first gap year, the mediator before, new and now, and values a year before."""
    years = risk.select("simple_id", "t0", "treated").withColumn("follow_year", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ja", F.col("t0") + F.col("follow_year"))
    rows = years.join(panel.select("simple_id", "ja", "msk", "rehab", F.lit(1).alias("seen")), ["simple_id", "ja"], "left")
    w = Window.partitionBy("simple_id", "t0")
    o = w.orderBy("follow_year")
    out = rows.withColumn("gap_year", F.min(F.when(F.col("seen").isNull(), F.col("follow_year"))).over(w)).withColumn("m", F.coalesce("msk", F.lit(0)))
    before = F.coalesce(F.max("m").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("simple_id", "t0", "treated", "follow_year", "gap_year", before.alias("mediator_before"), F.when((before == 0) & (F.col("m") == 1), 1).otherwise(0).alias("mediator_new"), F.greatest(before, F.col("m")).alias("mediator_now"), F.coalesce(F.lag("rehab").over(o), F.lit(0)).alias("prior_rehab"))


def holm(tests: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """Holm's step-down: running maximum of min(1, (m - r + 1) p) in the order of p."""
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    o = w.orderBy(p, "test")
    out = tests.withColumns({"_m": F.count("*").over(w), "_r": F.row_number().over(o)})
    return out.withColumn("p_holm", F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_m", "_r")
