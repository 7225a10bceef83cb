"""Fitted models, draws and simulations.  Draws are hashes of (seed, replicate, slot), so they don't depend on partitions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.exprs import MISSING
from tessera.functions.stats import normal_two_sided
from tessera.operators import resample

FIT_CAP, CLIP = 500_000, 1e-6
PROPENSITY_NUMBERS = ("lag1_age", "lag1_entgelt", "lag1_rtzb", "lag1_cum_rehab")
LEAST_LEVEL, MOST_LEVELS, RARE = 10, 1000, "__RARE__"


def root_of(spark) -> str:
    """The folder for tables between stages: spark.checkpoint.dir; where that is unset, a local session (tests) uses its
    warehouse, and on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def delete_at_end(spark, path: str) -> str:
    """path, which the driver's file system removes at the end of the application."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(fs.makeQualified(at))
    return path


def save(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, read again."""
    spark = df.sparkSession
    path = delete_at_end(spark, f"{root_of(spark)}/saved-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(*keys):
    """A fixed pseudo-random number in [0, 1) of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def hash_sample(risk: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """All treated, and controls whose hash falls under the share."""
    return risk.filter((F.col("treated") == 1) | (uniform("simple_id", F.lit(seed)) < share)).select("simple_id", "t0", "treated")


def _pooled(rows: DataFrame, name: str, least: int):
    """The levels of a category that at least `least` rows have, in order, and the category as a column: null is a
    level, and rarer levels are one more."""
    level = F.coalesce(F.col(name).cast("string"), F.lit(MISSING))
    kept = [r.level for r in rows.groupBy(level.alias("level")).count().filter(F.col("count") >= least).orderBy("level").limit(MOST_LEVELS + 1).collect()]
    if len(kept) > MOST_LEVELS:
        raise ValueError(f"too many levels: {name}")
    return kept, F.when(level.isin(kept), level).otherwise(F.lit(RARE))


def propensity(risk: DataFrame, cap: int = FIT_CAP, numbers: tuple[str, ...] = PROPENSITY_NUMBERS, binary: tuple[str, ...] = (), categories: tuple[str, ...] = ("lag1_ge",), least: int = LEAST_LEVEL, keep: tuple[str, ...] = ("lag1_ge", "lag1_ever_rehab")) -> DataFrame | None:
    """One logistic model a year with the objective of C = 1, and each row's clipped score.

    Numbers: nulls set to the median, unit scale without centring; binary: nulls set to the mode (the least of ties);
    both get missing flags.  Categories: a flag a level, null being one, with levels of under `least` fitted rows as one;
    a level that the fit has not seen counts as rare.  Controls beyond the cap are hash-sampled and the margin gets
    log(share).  A year without both arms has no scores; no such year at all: None.
    """
    names = ["simple_id", "t0", "treated", *numbers, *binary, *categories, *keep]
    risk, out = save(risk.select(*dict.fromkeys(names))), None
    sizes = risk.groupBy("t0").agg(F.count_if(F.col("treated") == 0).alias("c"), F.sum("treated").alias("t")).orderBy("t0").collect()  # a row a year
    for row in sizes:
        if not row.t or not row.c:
            continue
        year = risk.filter(F.col("t0") == row.t0)
        share = min(1.0, max(1, cap - row.t) / row.c)
        fitted = year if share == 1.0 else year.filter((F.col("treated") == 1) | (uniform("simple_id", F.lit(7)) < share))
        both = [*numbers, *binary]
        stats = fitted.agg(F.count("*").alias("n"), *(F.percentile(c, 0.5).alias(f"m_{c}") for c in numbers), *(F.mode(F.col(c), True).alias(f"m_{c}") for c in binary), *(F.max(F.col(c).isNull().cast("int")).alias(f"i_{c}") for c in both)).first()
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(stats[f"m_{c}"] or 0.0))) for c in both}
        spread = fitted.agg(*(F.stddev_pop(filled[c]).alias(c) for c in numbers)).first() if numbers else {}
        cols = {f"x_{c}": filled[c] / F.lit(float(spread[c] or 0.0) or 1.0) if c in numbers else filled[c] for c in both} | {f"x_i_{c}": F.col(c).isNull().cast("double") for c in both if stats[f"i_{c}"]}
        for c in categories:
            levels, value = _pooled(fitted, c, least)
            cols |= {f"x_{c}_{i}": (value == v).cast("double") for i, v in enumerate([*levels, RARE])}
        assemble = VectorAssembler(inputCols=list(cols), outputCol="features")
        model = LogisticRegression(labelCol="treated", regParam=1.0 / stats.n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(assemble.transform(fitted.withColumns(cols)))
        margin = vector_to_array(F.col("rawPrediction"))[1] + F.lit(float(np.log(share)))
        scored = model.transform(assemble.transform(year.withColumns(cols))).withColumn("pscore", F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), 1 / (1 + F.exp(-margin))))).select(*dict.fromkeys(["simple_id", "t0", "treated", *keep]), "pscore")
        out = scored if out is None else out.unionByName(scored)
    return out


def hazard(follow: DataFrame) -> DataFrame:
    """Discrete-time logit of event 1 on year dummies and treatment, with errors clustered by pair.

    Rows with equal covariates are counted first, so Newton steps and both sandwich parts are aggregations over
    year x arm; only those few counts, and k x k matrices, reach the driver."""
    follow = save(follow.select("match_group", "treated", "follow_year", "event_type"))
    cells = follow.groupBy("follow_year", "treated").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("d")).orderBy("follow_year", "treated").collect()
    years = sorted({r.follow_year for r in cells})
    x = np.array([[float(r.follow_year == y) for y in years] + [float(r.treated)] for r in cells])
    n, d = np.array([r.n for r in cells], float), np.array([r.d for r in cells], float)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(len(b)), x.T @ (d - n * p))
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-x @ b))
    spark = follow.sparkSession
    fitted = spark.createDataFrame([(r.follow_year, r.treated, float(q)) for r, q in zip(cells, p)], "follow_year int, treated int, p double")
    resid = follow.join(F.broadcast(fitted), ["follow_year", "treated"]).withColumn("e", (F.col("event_type") == 1).cast("double") - F.col("p"))  # a row a cell
    parts = [F.sum(F.when(F.col("follow_year") == y, F.col("e")).otherwise(0.0)) for y in years] + [F.sum(F.col("e") * F.col("treated"))]
    scores = resid.groupBy("match_group").agg(*(q.alias(f"s{i}") for i, q in enumerate(parts)))
    k = len(b)
    meat_row = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    meat = np.array([[meat_row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    bread = np.linalg.pinv((x * (n * p * (1 - p))[:, None]).T @ x)
    g, rows = meat_row.g, n.sum()
    cov = bread @ meat @ bread * g / max(g - 1, 1) * (rows - 1) / max(rows - k, 1)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    names = [f"year_{y}" for y in years] + ["treated"]
    rows_out = [(a, float(round(c, 8)), float(round(e, 8)), float(round(np.exp(c), 8)), float(round(np.exp(c - 1.96 * e), 8)), float(round(np.exp(c + 1.96 * e), 8))) for a, c, e in zip(names, b, se)]
    return spark.createDataFrame(rows_out, "term string, coefficient double, se double, odds_ratio double, ci_low double, ci_high double")


def hazard_scores(follow: DataFrame) -> DataFrame:
    """term, score: the sum of residuals times the term's column at the hazard's estimates, from counts by cell."""
    terms = {r.term: r.coefficient for r in hazard(follow).collect()}  # a row a year, and treatment
    margin = F.col("treated") * F.lit(terms["treated"])
    for name, c in terms.items():
        if name != "treated":
            margin = margin + (F.col("follow_year") == int(name.removeprefix("year_"))).cast("int") * F.lit(c)
    cells = follow.groupBy("follow_year", "treated").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("d"))
    left = cells.withColumn("e", F.col("d") - F.col("n") / (1 + F.exp(-margin)))
    by_year = left.groupBy(F.concat(F.lit("year_"), "follow_year").alias("term")).agg(F.sum("e").alias("score"))
    return by_year.unionByName(left.agg(F.lit("treated").alias("term"), F.sum(F.col("e") * F.col("treated")).alias("score")))


def replicate_curves(follow: DataFrame, groups: list[str], replicates: int = 200, seed: int = 11, strata: str | None = None) -> DataFrame:
    """rep, groups, treated, follow_year, n, d1, d2, risk (the year's share of the incidence): curves by replicate, where
    replicate -1 is the sample itself.

    A replicate draws as many pairs as there are, with replacement (resample.weights), within the levels of `strata` where given, which a
    pair has one of.  All groups of a pair share its draws, and weighted counts combine before they are exchanged."""
    cube = follow.groupBy("match_group", *groups, "treated", "follow_year").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("d1"), F.count_if(F.col("event_type") == 2).alias("d2"))
    level = [F.min(strata).alias(strata)] if strata else [F.lit(0).alias("_all")]
    clusters = save(follow.groupBy("match_group").agg(*level))
    drawn = resample.weights(clusters, "match_group", range(replicates), seed, strata)
    each = F.posexplode(F.concat(F.array(F.lit(1)), "weights")).alias("rep", "w")
    rows = cube.join(drawn, "match_group").select(*groups, "treated", "follow_year", "n", "d1", "d2", each).filter("w > 0").withColumn("rep", F.col("rep") - 1)
    c = rows.groupBy("rep", *groups, "treated", "follow_year").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in ("n", "d1", "d2")))
    w = Window.partitionBy("rep", *groups, "treated").orderBy("follow_year").rowsBetween(Window.unboundedPreceding, -1)
    h = (F.col("d1") + F.col("d2")) / F.col("n")
    return c.withColumn("risk", F.exp(F.coalesce(F.sum(F.ln(F.greatest(F.lit(1e-12), 1 - h))).over(w), F.lit(0.0))) * F.col("d1") / F.col("n"))


def bootstrap_curves(follow: DataFrame, groups: list[str], replicates: int = 200, seed: int = 11, strata: str | None = None) -> DataFrame:
    """Risk difference and ratio of the last year by group and replicate; the ratio is null without control events."""
    risk = lambda arm: F.sum(F.when(F.col("treated") == arm, F.col("risk")))
    return replicate_curves(follow, groups, replicates, seed, strata).groupBy("rep", *groups).agg((risk(1) - risk(0)).alias("rd"), F.when(risk(0) > 0, risk(1) / risk(0)).alias("rr"))


def pointwise_curves(follow: DataFrame, groups: tuple[str, ...] = (), replicates: int = 200, seed: int = 11) -> DataFrame:
    """groups, treated, follow_year, estimate, ci_low, ci_high, n_at_risk, replicates: the incidence of event 1 with a
    percentile interval at every year.  A replicate that has no row of an arm and year doesn't count there."""
    curves = replicate_curves(follow, list(groups), replicates, seed)
    w = Window.partitionBy("rep", *groups, "treated").orderBy("follow_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curves.withColumn("cif", F.sum("risk").over(w)).groupBy(*groups, "treated", "follow_year").agg(*_interval("cif"), F.max(F.when(F.col("rep") < 0, F.col("n"))).alias("n_at_risk"))


def _interval(value: str, *keys: str):
    drawn = F.when(F.col("rep") >= 0, F.col(value))
    return [F.max(F.when(F.col("rep") < 0, F.col(value))).alias("estimate"), F.percentile(drawn, 0.025).alias("ci_low"), F.percentile(drawn, 0.975).alias("ci_high"), F.count(drawn).alias("replicates")]


def bootstrap_risk_difference(follow: DataFrame, replicates: int = 200, seed: int = 11) -> DataFrame:
    """The sample's risk difference and ratio with their percentile intervals."""
    ratio = [c.alias(n) for c, n in zip(_interval("rr"), ("risk_ratio", "ratio_low", "ratio_high", "ratio_replicates"))]
    return bootstrap_curves(follow, [], replicates, seed).agg(*_interval("rd"), *ratio).withColumnRenamed("estimate", "risk_difference")


def contrasts(follow: DataFrame, group: str, replicates: int = 200, seed: int = 11) -> DataFrame:
    """Difference of each group's risk difference from the least group's, by draws within groups: percentile interval, two-sided bootstrap p,
    Wald p from the draws' standard error, and Holm's adjustment of the latter over groups."""
    from tessera.operators.followup import holm

    curves = save(bootstrap_curves(follow, [group], replicates, seed, group))
    base = curves.withColumn("_least", F.min(group).over(Window.partitionBy("rep"))).filter(F.col(group) == F.col("_least")).select("rep", F.col("rd").alias("base"))
    gaps = curves.join(base, "rep").withColumn("gap", F.col("rd") - F.col("base"))
    drawn = F.when(F.col("rep") >= 0, F.col("gap"))
    out = gaps.groupBy(group).agg(*_interval("gap"), F.stddev_samp(drawn).alias("se"), F.avg((drawn <= 0).cast("double")).alias("_lo"), F.avg((drawn >= 0).cast("double")).alias("_hi")).filter("se > 0")
    # a row a group reaches the driver, which has the exact normal tail
    rows = out.select(group, "estimate", "se").collect()
    tails = curves.sparkSession.createDataFrame([(r[group], normal_two_sided(r.estimate / r.se)) for r in rows], StructType([curves.schema[group], StructField("p", DoubleType())]))
    tested = out.join(F.broadcast(tails), group).withColumns({"p_bootstrap": F.least(F.lit(1.0), 2 * F.least("_lo", "_hi")), "test": F.col(group)})
    return holm(tested, []).drop("_lo", "_hi", "test")


def decomposition(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """Total, direct and indirect effects by g-computation on saturated cells: event risk by (arm, mediator state), with
    the mediator's distribution of either arm.  q_am: arm a with the mediator distribution of arm m."""
    deaths = panel.groupBy("simple_id").agg(F.max("death_year").alias("dy"))
    rows = grid.filter("gap_year is null or follow_year < gap_year").join(deaths, "simple_id", "left").withColumn("y", F.coalesce((F.col("dy") <= F.col("t0") + F.col("follow_year")).cast("double"), F.lit(0.0)))
    cells = rows.groupBy("treated", "follow_year", "mediator_now").agg(F.count("*").alias("n"), F.avg("y").alias("risk")).collect()  # arms x years x 2
    n = {(r.treated, r.follow_year, r.mediator_now): r.n for r in cells}
    risk = {(r.treated, r.follow_year, r.mediator_now): r.risk for r in cells}
    years = sorted({k[1] for k in n})

    def q(a: int, m: int) -> float:
        alive = 1.0
        for t in years:
            total = sum(n.get((m, t, s), 0) for s in (0, 1))
            h = sum(n.get((m, t, s), 0) / total * risk.get((a, t, s), risk.get((a, t, 0), 0.0)) for s in (0, 1)) if total else 0.0
            alive *= 1 - h
        return 1 - alive

    q00, q10, q11, q01 = q(0, 0), q(1, 0), q(1, 1), q(0, 1)
    total = q11 - q00
    values = [("q00", q00), ("q01", q01), ("q10", q10), ("q11", q11), ("total", total), ("direct", q10 - q00), ("indirect", q11 - q10), ("proportion", (q11 - q10) / total if abs(total) > 1e-12 else None)]
    return grid.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in values], "effect string, value double")


RULES = ("ordinary", "pair_censored")


def both_rules(follow: DataFrame) -> DataFrame:
    """The follow-up twice: as it is, and cut for both members before the first unobserved year of either; pairs are cut before any
    group is taken apart."""
    from tessera.operators.followup import pair_censor

    rules = ((RULES[0], follow), (RULES[1], pair_censor(follow)))
    first, second = (df.withColumn("rule", F.lit(name)) for name, df in rules)
    return first.unionByName(second)


def gap_counts(follow: DataFrame, group: str) -> DataFrame:
    """group, rule, pairs, and people and events by arm; gaps: pairs of the group with an unobserved year, before any cut."""
    arm = lambda a, c: F.countDistinct(F.when((F.col("treated") == a) & c, F.col("match_group")))
    event = F.col("event_type") == 1
    counts = [arm(a, c).alias(f"{n}_{who}") for a, who in ((0, "controls"), (1, "treated")) for n, c in (("people", F.lit(True)), ("events", event))]
    sums = both_rules(follow).groupBy(group, "rule").agg(F.countDistinct("match_group").alias("pairs"), *counts)
    gaps = follow.filter("observed = 0").groupBy(F.col(group).alias("_group")).agg(F.countDistinct("match_group").alias("gaps"))
    return sums.join(gaps, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group").na.fill(0, ["gaps"])


def gap_sensitivity(follow: DataFrame, group: str, most_groups: int = 50) -> DataFrame:
    """gap_counts with the treatment's odds ratio of each group under both rules: status, odds_ratio, ci_low, ci_high, log_odds, se.

    The hazard is unadjusted, of treatment and years.  No estimate takes the place of one that doesn't exist: status says which of
    two arms, events, a finite maximum or a positive variance is absent.  A group is a level of a category such as sex; more than
    most_groups raise ValueError.
    """
    rows = save(both_rules(follow).select("match_group", "treated", "follow_year", "event_type", group, "rule"))
    counts = gap_counts(follow, group)
    cells = counts.limit(2 * most_groups + 1).collect()
    if len(cells) > 2 * most_groups:
        raise ValueError(f"too many groups: {group}")
    kind, out = follow.schema[group].dataType.simpleString(), []
    for r in cells:
        events, people = (r.events_controls + r.events_treated, (r.people_controls, r.people_treated))
        status, found = "estimated", (None,) * 5
        if not all(people):
            status = "one arm"
        elif not events:
            status = "no events"
        else:
            own = rows.filter(F.col(group).eqNullSafe(F.lit(r[group])) & (F.col("rule") == r["rule"]))
            fit = hazard(own).filter("term = 'treated'").first()
            if not np.isfinite(fit.coefficient) or abs(fit.coefficient) > 10:
                status = "no finite maximum"
            elif not fit.se:
                status = "no variance"
            else:
                found = (fit.odds_ratio, fit.ci_low, fit.ci_high, fit.coefficient, fit.se)
        out.append((r[group], r["rule"], status, *found))
    schema = f"{group} {kind}, rule string, status string, odds_ratio double, ci_low double, ci_high double, log_odds double, se double"
    made = rows.sparkSession.createDataFrame(out, schema)
    named = made.withColumnRenamed(group, "_group").withColumnRenamed("rule", "_rule")
    both = counts.join(F.broadcast(named), F.col(group).eqNullSafe(F.col("_group")) & (F.col("rule") == F.col("_rule")))
    return both.drop("_group", "_rule")
