"""Entry points of a whole study: main, second specification, comparison and mediation only.

    python -m tessera.plans.main CONFIG.yaml [main | second | compare | mediation]

Input: Parquet shards of person-years (raw_glob) with the columns of panel.REQUIRED; their physical order stands for
ord.  Stages and tables go below output_dir/sample_tag: internal tables, and released ones with small cells withheld,
as CSV under internal/ and released/.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import TIERS, CohortConfig
from tessera.operators import followup, gcomp, models, pairs, panel, release
from tessera.operators import mediation as longitudinal
from tessera.plans import chain
from tessera.plans.run import Run
from tessera.sources import align, files

Build = Callable[[], DataFrame]


def raw_rows(run: Run) -> DataFrame:
    """All shards with the needed columns.  Raises ValueError where no shard has one of them."""
    shards, needed = list(run.stamps), [c for c in panel.REQUIRED if c != "ord"]
    optional = set() if run.config.source_has_entgelt else {"entgelt"}
    if absent := set(needed) - optional - set(align.schema_union(run.spark, shards)):
        raise ValueError(f"columns are absent: {', '.join(sorted(absent))}")
    more = [c for c in panel.OPTIONAL if c in align.schema_union(run.spark, shards)]
    return align.scan_aligned(run.spark, shards, needed + more).withColumn("ord", F.struct("src_file", "src_row")).drop("src_file", "src_row")


def open_run(spark: SparkSession, config: CohortConfig, protect_matching: bool = False) -> Run:
    return Run(spark, config, [config.raw_glob], protect_matching)


def panel_of(run: Run) -> DataFrame:
    c = run.config
    built = lambda: panel.build(raw_rows(run), list(c.msk_codes))
    return run.stage("panel", 0, lambda: panel.described(built(), list(c.mental_codes), c.first_marriage_source))


def study_of(run: Run, built: DataFrame) -> chain.Study:
    """The stages of the run's configuration on a built panel."""
    c = run.config
    # by inputs and by what scores and pairs depend on: other ones have years of their own
    parts = {k: v for k, v in c.as_dict().items() if TIERS.get(k, 3) <= 2} | {"inputs": run.stamps}
    years = files.Checkpoint(run.spark, f"{run.root}/matched_years", files.fingerprint(parts))
    return chain.study(run.spark, built, models.save, c.year_start, c.year_cap, c.lag_depth, round(c.caliper * 1e6), c.followup_years, c.propensity_fit_cap, run.stage, c.min_category, c.mortality_horizon, c.death_registry_end_year, years, c)


def matching_tables(s: chain.Study, c: CohortConfig) -> dict[str, Build]:
    caliper, least = round(c.caliper * 1e6), c.minimum_cell_people
    overall = lambda: release.matching_overall(s.scored, s.pairs, caliper, s.strata)
    years = lambda: release.matching_by_year(s.scored, s.pairs, s.strata)
    return {
        "internal/checks": lambda: chain.checks_of(s, c.year_start, c.year_cap, caliper, c.followup_years),
        "internal/matching_overall": overall,
        "released/matching_overall": lambda: release.release_overall(overall(), least),
        "internal/matching_by_year": years,
        "released/matching_by_year": lambda: release.release_by_year(years(), least),
    }


def outcome_tables(s: chain.Study, c: CohortConfig) -> dict[str, Build]:
    return {
        "internal/incidence": lambda: followup.incidence(s.follow),
        "internal/mortality": lambda: followup.kaplan_meier(s.mortality),
        "internal/hazard": lambda: models.hazard(s.follow),
        "internal/risk_difference": lambda: models.bootstrap_risk_difference(s.follow, c.absolute_bootstrap),
        "internal/curves": lambda: models.pointwise_curves(s.follow, replicates=c.absolute_bootstrap),
        "internal/event_study": lambda: followup.event_study(followup.event_panel(s.pairs, s.panel)),
    }


def mediation_tables(s: chain.Study, c: CohortConfig, checkpoint: str) -> dict[str, Build]:
    roles = {"numeric": s.plan["numeric"], "binary": s.plan["binary"], "categorical": [*s.plan["categorical"], *s.plan["exact"]]}
    plan = longitudinal.Plan(
        **{r: tuple(names) for r, names in roles.items()},
        horizon=c.gcomp_horizon, simulations=c.gcomp_simulations, floor=c.ipcw_floor, cap=c.ipcw_cap, least_level=c.min_category
    )
    members = pairs.assignment(s.pairs)
    # the second call finds all replicates of the first
    both = lambda: longitudinal.mediation(members, s.panel, s.risk, plan, c.mediation_bootstrap, checkpoint)
    return {
        "internal/mediation": lambda: both()[0],
        "internal/mediation_models": lambda: both()[1],
        "internal/landmark": lambda: gcomp.landmark(members, s.panel),
    }


def write(run: Run, tables: dict[str, Build]) -> dict[str, DataFrame]:
    """The tables as stages of the last tier, each written as CSV too where it is made anew."""
    out = {}
    for name, build in tables.items():
        stage, fresh = name.replace("/", "_"), name.replace("/", "_") not in run.stages
        out[name] = run.stage(stage, 3, build)
        if fresh:
            files.write_csv(out[name], f"{run.root}/{name}")
    run.check_inputs()
    return out


def main(spark: SparkSession, config: CohortConfig, built: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole study: table by name.  Without pairs, the matching's tables alone."""
    run = open_run(spark, config)
    s = study_of(run, built if built is not None else panel_of(run))
    tables = matching_tables(s, config)
    return write(run, tables if s.pairs.isEmpty() else tables | outcome_tables(s, config) | mediation_tables(s, config, f"{run.root}/replicates"))


def specifications(config: CohortConfig) -> dict[str, CohortConfig]:
    """One lag year; the same over the years that three lag years allow; three lag years."""
    common = max(config.year_start, config.lag_comparison_common_year_start)
    return {
        "lag1": config,
        "lag1_common": replace(config, sample_tag=f"{config.sample_tag}_lag1_common", year_start=common),
        "lag3": replace(config, sample_tag=f"{config.sample_tag}_lag3", year_start=common, lag_depth=3),
    }


def second(spark: SparkSession, config: CohortConfig) -> dict[str, DataFrame]:
    """The study with three lag years, on the main run's panel."""
    return main(spark, specifications(config)["lag3"], panel_of(open_run(spark, config)))


def compare(spark: SparkSession, config: CohortConfig) -> dict[str, DataFrame]:
    """All tables of the three specifications, stacked with a column `specification`; CSV under compared/."""
    run = open_run(spark, config)
    built, out = panel_of(run), {}
    for name, one in specifications(config).items():
        for table, rows in main(spark, one, built).items():
            rows = rows.withColumn("specification", F.lit(name))
            out[table] = out[table].unionByName(rows) if table in out else rows
    for table, rows in out.items():
        files.write_csv(rows, f"{run.root}/compared/{table}")
    return out


def mediation(spark: SparkSession, config: CohortConfig) -> dict[str, DataFrame]:
    """The mediation tables alone, on a finished matching that is never rebuilt: ValueError where there is none."""
    run = open_run(spark, config, protect_matching=True)
    if absent := {"panel", "risk", "scores", "pairs"} - set(run.stages):
        raise ValueError(f"stages are absent: {', '.join(sorted(absent))}")
    return write(run, mediation_tables(study_of(run, panel_of(run)), config, f"{run.root}/replicates"))


ENTRIES = {"main": main, "second": second, "compare": compare, "mediation": mediation}


def command(arguments: list[str]) -> int:
    if not 1 <= len(arguments) <= 2 or arguments[1:] and arguments[1] not in ENTRIES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    text = spark.read.text(arguments[0], wholetext=True).first()[0]
    found = ENTRIES[arguments[1] if arguments[1:] else "main"](spark, CohortConfig.from_yaml(text))
    print("\n".join(sorted(found)))
    return 0


if __name__ == "__main__":
    sys.exit(command(sys.argv[1:]))
