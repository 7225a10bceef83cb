"""Pooling of small cells and primary and complementary suppression."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as x

POOLED = "pooled"


def pool_small(people: DataFrame, keys: list[str], code: str, least: int) -> DataFrame:
    """people: a row an event, with simple_id.  Codes with under `least` people are pooled; where just one is, the
    smallest other code joins it (by people, events, code).  People of the pool are recounted; withheld if still few.
    The pool's row has POOLED as its code and is told from a real code of that spelling by `pooled`."""
    cells = people.groupBy(*keys, code).agg(F.countDistinct("simple_id").alias("people"), F.count("*").alias("events"))
    few = F.col("people") < least
    place = F.struct("people", "events", code)
    # a row a group, of aggregates: no group is sorted in one task
    groups = cells.groupBy(*keys).agg(F.count_if(few).alias("small"), F.min(F.when(~few, place)).alias("next"))
    marked = _beside(cells, groups, keys)
    extra = (F.col("small") == 1) & place.eqNullSafe(F.col("next"))
    marked = marked.withColumn("pooled", few | F.coalesce(extra, F.lit(False)))
    # null keys and codes are values
    named = marked.select(*(F.col(c).alias(f"_{c}") for c in (*keys, code)), "pooled")
    joined = people.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, code)])
    to = F.when(F.col("pooled"), F.lit(POOLED)).otherwise(F.col(code)).alias("_to")
    counts = F.countDistinct("simple_id").alias("people"), F.count("*").alias("events"), x.count_values(F.col(code)).alias("codes")
    out = joined.groupBy(*keys, to, "pooled").agg(*counts)
    hide = F.col("pooled") & (F.col("people") < least)
    shown = (F.when(~hide, F.col(c)).alias(c) for c in ("people", "events"))
    return out.select(*keys, F.col("_to").alias(code), "pooled", *shown, "codes")


def protect(cells: DataFrame, group: list[str], cell: str, value: str, least: int) -> DataFrame:
    """Hides values from 1 to least - 1; where a group has just one hidden value, its smallest visible one too."""
    hidden = F.coalesce((F.col(value) > 0) & (F.col(value) < least), F.lit(False))
    visible = F.coalesce(F.col(value) >= least, F.lit(False)) & (F.col(value) > 0)
    place = F.struct(value, cell)
    groups = cells.groupBy(*group).agg(F.count_if(hidden).alias("_n"), F.min(F.when(visible, place)).alias("_first"))
    second = visible & (F.col("_n") == 1) & F.coalesce(place.eqNullSafe(F.col("_first")), F.lit(False))
    status = F.when(hidden, "withheld").when(second, "complement").otherwise("reported")
    out = _beside(cells, groups, group).withColumn("status", status)
    return out.withColumn(value, F.when(F.col("status") == "reported", F.col(value))).drop("_n", "_first")


def _beside(cells: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """cells with their group's row; null keys are keys."""
    if not keys:
        one = F.broadcast(groups.withColumn("_", F.lit(1)))  # one row
        return cells.withColumn("_", F.lit(1)).join(one, "_").drop("_")
    named = groups.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    return cells.join(named, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]).drop(*(f"_key_{k}" for k in keys))
