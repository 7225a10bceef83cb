"""The joined study: risk set, fitted propensity, optimal pairs without reuse, then everything that reads pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import CohortConfig
from tessera.operators import checks, covariates, followup, models, pairs, panel
from tessera.sources.files import Checkpoint


@dataclass
class Study:
    panel: DataFrame
    risk: DataFrame
    scored: DataFrame
    pairs: DataFrame
    follow: DataFrame
    mortality: DataFrame
    strata: list[str]
    plan: dict[str, list[str]] | None


EMPTY_PAIRS = "t_id long, c_id long, t0 int, distance long"


def study(
    spark: SparkSession,
    built: DataFrame,
    save: Callable[[DataFrame], DataFrame],
    first: int = panel.FIRST,
    last: int = panel.LAST,
    depth: int = 1,
    caliper: int = pairs.CALIPER,
    horizon: int = followup.HORIZON,
    cap: int = models.FIT_CAP,
    stage: Callable | None = None,
    least: int = models.LEAST_LEVEL,
    mortality_horizon: int = 5,
    registry_end: int = followup.REGISTRY_END,
    years: Checkpoint | None = None,
    config: CohortConfig | None = None,
) -> Study:
    """All stages on a built panel.  stage(name, tier, build) keeps a stage's table (Run.stage); without it save does.
    years keeps the matching's finished years.

    config: its covariates (covariates.resolve, of a panel with yearly features) fit the scores and its exact columns are the
    strata; without it the panel's basic columns are.  Scores are the fitted ones in millionths.  A panel without both arms in any
    year gives empty pairs and grids.
    """
    keep = stage or (lambda name, tier, build: save(build()))
    risk = keep("risk", 1, lambda: panel.risk_set(built, first, last, depth))
    plan = covariates.resolve(config, risk.columns) if config else None
    strata = ["t0", *plan["exact"]] if plan else pairs.STRATA

    def scores():
        own = {"numbers": plan["numeric"], "binary": plan["binary"], "categories": plan["categorical"], "keep": plan["exact"]} if plan else {}
        found = models.propensity(risk, cap, least=least, **{k: tuple(v) for k, v in own.items()})
        if found is None:
            none = risk.select("simple_id", "t0", "treated", *strata[1:]).filter("false")
            return none.withColumns({"pscore": F.lit(0.0), "score_ppm": F.lit(0).cast("long")})
        return found.withColumn("score_ppm", F.round(F.col("pscore") * 1e6).cast("long"))

    def matched_pairs():
        found = pairs.match_without_reuse(scored, save, caliper, years, strata)
        return _numbered(spark.createDataFrame([], EMPTY_PAIRS) if found is None else found)

    scored = keep("scores", 2, scores)
    matched = keep("pairs", 2, matched_pairs)
    members = pairs.assignment(matched)
    follow = keep("follow", 3, lambda: followup.grid(members, built, horizon))
    mortality = keep("mortality", 3, lambda: followup.mortality_grid(members, built, mortality_horizon, registry_end))
    return Study(built, risk, scored, matched, follow, mortality, strata, plan)


def _numbered(matched: DataFrame) -> DataFrame:
    return matched.withColumn("match_group", F.col("t_id") * 10_000 + F.col("t0"))


def checks_of(s: Study, first: int, last: int, caliper: int = pairs.CALIPER, horizon: int = followup.HORIZON) -> DataFrame:
    """check, value: sizes of the stages that the rules alone fix, and violations of matching and follow-up."""
    sizes = s.risk.agg(F.coalesce(F.sum("treated"), F.lit(0)).alias("eligible_treated"), F.coalesce(F.sum(1 - F.col("treated")), F.lit(0)).alias("eligible_controls"))
    scored = s.scored.agg(F.count("*").alias("scored"), F.count_if(~F.coalesce(F.col("pscore").between(models.CLIP, 1 - models.CLIP), F.lit(False))).alias("scores_outside"))
    out = None
    for one in (sizes, scored):
        rows = one.select([F.col(c).cast("long").alias(c) for c in one.columns]).unpivot([], one.columns, "rule", "violations")
        out = rows if out is None else out.unionByName(rows)
    out = out.unionByName(checks.matching(s.pairs, s.scored, s.strata, caliper))
    found = checks.followup(s.follow, s.pairs, horizon, first, last, last + horizon)
    return out.unionByName(found).select(F.col("rule").alias("check"), F.col("violations").alias("value"))
