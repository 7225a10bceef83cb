"""Joins with stated multiplicities, and integrity checks as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairs import assignment


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:m", indicator: str | None = None) -> DataFrame:
    """A join whose keys are checked: a side that `validate` (1:1, 1:m, m:1, m:m) calls 1 must not repeat a key, else
    ValueError.  indicator: a column that tells both, left_only or right_only."""
    for side, df, name in zip(validate.split(":"), (left, right), ("left", "right")):
        if side == "1" and df.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise ValueError(f"the {name} side repeats a key")
    if indicator is None:
        return left.join(right, on, how)
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), on, how)
    return both.withColumn(indicator, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")).drop("_l", "_r")


def followup(follow: DataFrame, pairs: DataFrame, horizon: int, first: int, last: int, end: int) -> DataFrame:
    """rule, violations of a follow-up grid against its pairs; all 0 for a sound one.  Assignments without follow-up are
    told, not added: that would change the risk sets."""
    cells = follow.agg(
        F.count_if(F.col("match_group").isNull() | F.col("treated").isNull() | F.col("simple_id").isNull() | F.col("event_type").isNull()).alias("null_cell"),
        F.count_if(~F.col("treated").isin(0, 1) | ~F.col("observed").isin(0, 1) | ~F.col("event_type").isin(0, 1, 2)).alias("unknown_value"),
        F.count_if(~F.col("follow_year").between(1, horizon) | (F.col("ja") != F.col("t0") + F.col("follow_year"))).alias("year_index"),
        F.count_if(~F.col("t0").between(first, last) | (F.col("ja") > end)).alias("outside_window"),
    )
    years = follow.groupBy("match_group", "treated", "follow_year").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_arm_year"))
    arms = follow.groupBy("match_group", "treated").agg(F.count_if(F.col("event_type") == 1).alias("e"), F.countDistinct("simple_id").alias("ids"), F.max("follow_year").alias("top"), F.max(F.when(F.col("event_type") > 0, F.col("follow_year"))).alias("stop"))
    arms = arms.agg(F.count_if(F.col("e") > 1).alias("second_event"), F.count_if(F.col("ids") > 1).alias("changing_person"), F.count_if(F.col("stop") < F.col("top")).alias("years_after_event"))
    groups = pairs.groupBy("match_group").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_pair"))
    selves = pairs.agg(F.count_if(F.col("t_id") == F.col("c_id")).alias("own_partner"))
    wanted = assignment(pairs).select("match_group", "t0", "treated", F.col("simple_id").alias("expected"))
    given = follow.select("match_group", "t0", "treated", "simple_id").distinct()
    # one side may lack rows of the other; both are bounded by the pairs
    met = given.join(wanted, ["match_group", "t0", "treated"], "full")
    met = met.agg(F.count_if(F.col("simple_id").isNotNull() & ~F.coalesce(F.col("simple_id") == F.col("expected"), F.lit(False))).alias("other_person"), F.count_if(F.col("simple_id").isNull()).alias("without_followup"))
    out = None
    for one in (cells, years, arms, groups, selves, met):
        rows = one.select([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in one.columns]).unpivot([], one.columns, "rule", "violations")
        out = rows if out is None else out.unionByName(rows)
    return out


def matching(matched: DataFrame, scored: DataFrame, strata: list[str], caliper: int) -> DataFrame:
    """rule, violations of pairs (t_id, c_id, t0) against the scored candidates: no one is used twice, strata agree, no
    pair is over the caliper, and both members are candidates of their arm."""
    used = lambda c, n: matched.groupBy(c).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(n))
    side = lambda arm, c: scored.filter(F.col("treated") == arm).select(F.col("simple_id").alias(c), F.col("t0").alias(f"{c}_t0"), F.col("score_ppm").alias(f"{c}_score"), *(F.col(k).alias(f"{c}_{k}") for k in strata if k != "t0"))
    both = matched.select("t_id", "c_id", "t0").join(side(1, "t"), (F.col("t_id") == F.col("t")) & (F.col("t0") == F.col("t_t0")), "left").join(side(0, "c"), (F.col("c_id") == F.col("c")) & (F.col("t0") == F.col("c_t0")), "left")
    other = F.lit(False)
    for k in strata:
        if k != "t0":
            other = other | ~F.col(f"t_{k}").eqNullSafe(F.col(f"c_{k}"))
    cells = both.agg(F.count_if(F.col("t").isNull() | F.col("c").isNull()).alias("no_candidate"), F.count_if(other).alias("strata_differ"), F.count_if(F.abs(F.col("t_score") - F.col("c_score")) > caliper).alias("over_caliper"))
    out = None
    for one in (used("t_id", "treated_twice"), used("c_id", "control_twice"), cells):
        rows = one.select([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in one.columns]).unpivot([], one.columns, "rule", "violations")
        out = rows if out is None else out.unionByName(rows)
    return out
