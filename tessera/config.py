"""Validated parameters of a run, read from Python or YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class CohortConfig:
    raw_glob: str = ""
    output_dir: str = ""
    sample_tag: str = "sample"
    data_profile: str = "canonical"
    source_has_entgelt: bool = True
    first_marriage_source: str = "date_fields"
    year_start: int = 2012
    year_cap: int = 2018
    followup_years: int = 5
    mortality_horizon: int = 10
    death_registry_end_year: int = 2023
    lag_comparison_common_year_start: int = 2014
    lag_depth: int = 1
    control_pool: str = "not_yet_divorced"
    controls_per_treated: int = 1
    caliper: float = 0.01
    exact_covariates: tuple[str, ...] = ("sex", "age_band", "ever_rehab")
    max_iter: int = 10_000
    tol: float = 1e-4
    propensity_fit_cap: int = 500_000
    min_category: int = 10
    smd_threshold: float = 0.10
    outcome_bootstrap: int = 200
    absolute_bootstrap: int = 200
    mediation_bootstrap: int = 200
    msk_codes: tuple[int, ...] = (20, 53, 56)
    mental_codes: tuple[int, ...] = (30,)
    gcomp_horizon: int = 5
    gcomp_simulations: int = 25
    ipcw_floor: float = 0.02
    ipcw_cap: float = 20.0
    minimum_cell_people: int = 20
    exact_columns: tuple[str, ...] = ("lag1_ge_cat", "lag1_age_band", "lag1_ever_rehab_to_date")
    propensity_numeric: tuple[str, ...] = ("lag1_age", "lag1_cum_rehabs_by_year", "lag1_cum_mental_health_rehabs_by_year", "lag1_years_since_last_rehab", "lag1_byvlgs_value", "lag1_bygmgs_value", "lag1_entgelt_value", "lag1_rtzb_value")
    propensity_binary: tuple[str, ...] = ("lag1_ever_rehab_to_date", "lag1_ever_mental_health_rehab_to_date", "lag1_non_success_app_this_year", "lag1_byvlgs_missing", "lag1_bygmgs_missing")
    propensity_categorical: tuple[str, ...] = ("lag1_whot_bland_cat", "lag1_occ_l1_cat", "lag1_income_source_status", "lag1_fmsd_cat")
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        def need(ok: bool, why: str):
            if not ok:
                raise ValueError(why)

        need(self.data_profile in ("canonical", "playdata"), "data_profile: canonical or playdata")
        need(self.data_profile != "playdata" or not self.source_has_entgelt, "playdata has no earnings")
        need(self.first_marriage_source in ("date_fields", "is_first_marriage"), "first_marriage_source: date_fields or is_first_marriage")
        need(self.year_start <= self.year_cap, "year_start is after year_cap")
        need(self.lag_depth in (1, 3), "lag_depth: 1 or 3")
        need(self.control_pool == "not_yet_divorced", "control_pool: not_yet_divorced")
        need(self.controls_per_treated == 1, "controls_per_treated: 1")
        need(self.caliper > 0, "caliper must be over 0")
        need(0 <= self.smd_threshold < 1, "smd_threshold lies in [0, 1)")
        need(self.followup_years >= 1 and self.mortality_horizon >= 1, "horizons are at least 1")
        need(self.year_cap + self.gcomp_horizon <= self.death_registry_end_year, "the g-computation horizon passes the registry's end")
        need(min(self.outcome_bootstrap, self.absolute_bootstrap, self.mediation_bootstrap) >= 20, "at least 20 replicates")
        need(bool(self.msk_codes) and bool(self.mental_codes), "code sets are not empty")
        need(not set(self.msk_codes) & set(self.mental_codes), "code sets are disjoint")
        need(0 < self.ipcw_floor < 1 <= self.ipcw_cap, "ipcw_floor lies in (0, 1), ipcw_cap is at least 1")
        need(self.propensity_fit_cap >= 20 and self.max_iter >= 1 and self.tol > 0, "solver limits are positive")
        need(self.minimum_cell_people >= 0 and self.min_category >= 1, "cell limits aren't negative")
        need(bool(self.sample_tag) and not set(self.sample_tag) & set("/\\"), "sample_tag is a plain folder name")

    @classmethod
    def from_yaml(cls, text: str) -> "CohortConfig":
        import yaml

        given = yaml.safe_load(text) or {}
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def as_dict(self) -> dict:
        return asdict(self)


#: The first stage that a parameter's change rebuilds: 0 panel, 1 risk sets, 2 matching, 3 all that follows.
TIERS = {"raw_glob": 0, "data_profile": 0, "source_has_entgelt": 0, "first_marriage_source": 0, "year_start": 1, "year_cap": 1, "lag_depth": 1, "control_pool": 1, "caliper": 2, "exact_covariates": 2, "controls_per_treated": 2, "max_iter": 2, "tol": 2, "propensity_fit_cap": 2, "min_category": 2, "exact_columns": 2, "propensity_numeric": 2, "propensity_binary": 2, "propensity_categorical": 2}
IGNORED = {"output_dir"}


def changes(old: dict, new: dict) -> dict[str, int]:
    """Parameters that differ, with the tier each rebuilds from (3 unless listed)."""
    return {k: TIERS.get(k, 3) for k in sorted(set(old) | set(new)) if k not in IGNORED and _plain(old.get(k)) != _plain(new.get(k))}


def rebuild_from(old: dict, new: dict, protect_matching: bool = False) -> int | None:
    """First tier to rebuild, or None.  protect_matching refuses what would touch matching or earlier stages."""
    found = changes(old, new)
    tier = min(found.values(), default=None)
    if protect_matching and tier is not None and tier <= 2:
        raise ValueError(f"would rebuild matching: {', '.join(k for k, t in found.items() if t <= 2)}")
    return tier


def _plain(v):
    return list(v) if isinstance(v, tuple) else v
