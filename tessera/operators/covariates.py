"""Which covariates a model takes, and as what: rules by name, filtered by the configuration and the columns at hand."""

from __future__ import annotations

from typing import NamedTuple

from tessera.config import CohortConfig

ROLES = ("numeric", "binary", "categorical")


class Lagged(NamedTuple):
    """A yearly measure: its role, whether it stands for earnings, and whether longer histories model it by their own lags."""

    role: str
    earnings: bool = False
    modelled: bool = True


# Measures of years two and three before t0, by name without the prefix lag2_ or lag3_.
LAGGED = {
    "entgelt_value": Lagged("numeric", earnings=True),
    "rtzb_value": Lagged("numeric"),
    "rehab_starts_this_year": Lagged("categorical"),
    "non_success_app_this_year": Lagged("binary"),
    "income_source_status": Lagged("categorical", earnings=True),
    "byvlgs_value": Lagged("numeric", modelled=False),
    "bygmgs_value": Lagged("numeric", modelled=False),
    "cum_rehabs_by_year": Lagged("numeric", modelled=False),
    "byvlgs_missing": Lagged("binary", modelled=False),
    "bygmgs_missing": Lagged("binary", modelled=False),
}
#: The propensity model takes this one as a number, the adjusted outcome models as a category.
COUNTED = "rehab_starts_this_year"
# Parts of names that stand for earnings.
EARNINGS = {"numeric": "entgelt_value", "binary": "entgelt_missing", "categorical": "income_source_status"}


def candidates(config: CohortConfig) -> list[tuple[str, str, bool]]:
    """(column, role, of earnings) of all covariates that the configuration could use, in the order of the model."""
    listed = [(c, r, EARNINGS[r] in c) for r in ROLES for c in getattr(config, f"propensity_{r}")]
    more = [
        (f"lag{depth}_{name}", "numeric" if name == COUNTED else rule.role, rule.earnings)
        for depth in (2, 3)
        for name, rule in LAGGED.items()
        if rule.modelled and config.lag_depth == 3
    ]
    return listed + more


def resolve(config: CohortConfig, columns: list[str]) -> dict[str, list[str]]:
    """numeric, binary, categorical and exact covariates that the columns have, in order.

    A source without earnings has none of their covariates.  Three lag years add those of years two and three.  What is
    matched exactly isn't modelled.  No exact or no modelled covariate: KeyError.
    """
    have, exact = set(columns), [c for c in config.exact_columns if c in columns]
    usable = [(c, r) for c, r, earnings in candidates(config) if c in have - set(exact) and (config.source_has_entgelt or not earnings)]
    if not exact or not usable:
        raise KeyError("no covariate to match exactly" if not exact else "no covariate to model")
    return {r: [c for c, own in usable if own == r] for r in ROLES} | {"exact": exact}


def role(config: CohortConfig, name: str) -> str:
    """numeric, binary or categorical, for adjustment: as configured, else as the measure is known in years two and three; whatever
    isn't known is a category."""
    for r in ("numeric", "binary"):
        if name in getattr(config, f"propensity_{r}"):
            return r
    depth, _, base = name.partition("_")
    return LAGGED[base].role if depth in ("lag2", "lag3") and base in LAGGED else "categorical"


def by_role(config: CohortConfig, names: list[str]) -> dict[str, list[str]]:
    """The names by role, in order."""
    return {r: [n for n in names if role(config, n) == r] for r in ROLES}
