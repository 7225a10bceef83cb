from pathlib import Path

import pytest

from tessera.config import CohortConfig
from tessera.plans import main
from tessera.sources.bindings import person_years

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_entry_points(spark, tmp_path):
    person_years(spark, DATA).drop("ord").repartition(2).write.parquet(f"{tmp_path}/raw")
    config = CohortConfig(raw_glob=f"{tmp_path}/raw/*.parquet", output_dir=f"{tmp_path}/out", year_start=1997, year_cap=1999, lag_comparison_common_year_start=1998, death_registry_end_year=2002, followup_years=2, gcomp_horizon=2, gcomp_simulations=2, mortality_horizon=3, caliper=0.2, absolute_bootstrap=20, mediation_bootstrap=20, msk_codes=(20,), mental_codes=(30,), minimum_cell_people=3)
    with pytest.raises(ValueError):
        main.mediation(spark, config)
    found = main.main(spark, config)
    assert {k.split("/")[0] for k in found} == {"internal", "released"} and len(found) == 14
    sizes = {r.check: r.value for r in found["internal/checks"].collect()}
    assert sizes.pop("eligible_treated") > 0 and sizes.pop("eligible_controls") > 0 and sizes.pop("scored") > 0 and not any(sizes.values())
    assert all(t.count() > 0 for t in found.values())
    written = lambda name: sorted(p.stat().st_mtime_ns for p in Path(f"{tmp_path}/out/sample/{name}").rglob("*.parquet"))
    before = written("pairs")
    effects = main.mediation(spark, config)
    assert set(effects) == {"internal/mediation", "internal/mediation_models", "internal/landmark"} and written("pairs") == before
    with pytest.raises(ValueError):
        main.mediation(spark, main.replace(config, caliper=0.1))
    assert written("pairs") == before
    both = main.compare(spark, config)
    assert {r.specification for r in both["internal/checks"].select("specification").distinct().collect()} == {"lag1", "lag1_common", "lag3"}
    assert written("pairs") == before and set(main.second(spark, config)) <= set(both)
    with pytest.raises(ValueError):
        spark.range(3).write.parquet(f"{tmp_path}/other")
        main.main(spark, main.replace(config, sample_tag="other", raw_glob=f"{tmp_path}/other/*.parquet"))


def test_command_line():
    assert main.command([]) == 2 and main.command(["config.yaml", "what"]) == 2
