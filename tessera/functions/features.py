"""Row-level feature expressions of a person-year with two spell slots, as lists of named columns."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as x

# Labels of the marital status codes.
STATUS_LABELS = {1: "married", 2: "divorced", 3: "widowed"}


def value_and_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """c with 0 for null, and c_missing."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("byte") for c in columns} | {c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(x.MISSING)) for c in columns})


def masked_age(year: Column, birth: Column, death: Column) -> Column:
    """Age, null after the year of death and outside 0 to 125."""
    age = year - birth
    return F.when((death.isNull() | (year <= death)) & age.between(0, 125), age)


def marriage_years(day: Column, start: Column, end: Column) -> Column:
    """Whole years from start to day while the marriage lasts, else null."""
    return F.when((start <= day) & (end.isNull() | (end >= day)), F.greatest(F.year(day) - F.year(start), F.lit(0)))


def spell(year: Column, start: Column, end: Column, code: Column, codes: list[int]) -> dict[str, Column]:
    """Flags and length of a spell that starts in the year; null dates give 0 and null."""
    starts = F.coalesce(F.year(start) == year, F.lit(False))
    return {"starts": starts.cast("byte"), "subset": (starts & x.code_in(code, codes)).cast("byte"), "days": F.when(starts & (end >= start), F.datediff(end, start) + 1)}


def slots(year: Column, given: list[tuple[Column, Column, Column]], codes: list[int]) -> dict[str, Column]:
    """Sums over slots of (start, end, code)."""
    each = [spell(year, *s, codes) for s in given]
    total = lambda k: sum((F.coalesce(e[k], F.lit(0)).cast("int") for e in each), F.lit(0))
    return {"n_spells": total("starts"), "n_subset": total("subset"), "spell_days": total("days")}


def dated_in_year(year: Column, *dates: Column) -> Column:
    """1 if any date falls in the year."""
    hit = F.lit(False)
    for d in dates:
        hit = hit | F.coalesce(F.year(d) == year, F.lit(False))
    return hit.cast("byte")


def status_label(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit("missing"))
    for value, label in STATUS_LABELS.items():
        out = out.when(code == value, F.lit(label))
    return out.otherwise(F.concat(F.lit("code_"), code.cast("string")))


def decode_occupation(code: Column, labels: dict[int, str], special: list[int]) -> Column:
    """Status of an occupation code: missing, zero, special, invalid width, known or unknown."""
    group = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]) if labels else F.create_map()
    return F.when(code.isNull(), x.MISSING).when(code == 0, "zero").when(code.isin(special), "special").when(F.length(code.cast("string")) > 3, "invalid_width").when(group[code].isNotNull(), "known").otherwise("unknown")


def application_activity(failed: Column, withdrawn: Column, forwarded: Column, starts: Column, subset: Column) -> dict[str, Column]:
    """non_subset: more starts than subset starts; non_success: any application that came to nothing; n_types: kinds of
    activity, null where a flag is."""
    return {"non_subset": (starts > subset).cast("byte"), "non_success": F.greatest(failed, withdrawn, forwarded).cast("byte"), "n_types": (failed + withdrawn + forwarded + (starts > 0).cast("int")).cast("short")}


def first_marriage_ends(source: str, divorcing: Column, start: Column, first_start: Column, is_first: Column) -> Column:
    """Whether a year's divorce ends a first marriage, by dates (date_fields) or by a flag (is_first_marriage)."""
    if source not in ("date_fields", "is_first_marriage"):
        raise ValueError("source: date_fields or is_first_marriage")
    same = (start == first_start) if source == "date_fields" else (is_first == 1)
    return F.coalesce((divorcing == 1) & same, F.lit(False))


def first_marriage_dates(is_first: Column, start: Column, end: Column, decision: Column) -> dict[str, Column]:
    """Dates of the first marriage where a flag alone tells that this is one; a court's decision ends it."""
    return {"first_marriage_start": F.when(is_first == 1, start), "first_marriage_end": F.when(is_first == 1, F.coalesce(decision, end))}


def normal_sex(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isin("1", "1.0"), "1").when(text.isin("2", "2.0"), "2").otherwise("unknown")


def normal_codes(codes) -> list[int]:
    """Sorted distinct whole numbers of a scalar or a list; texts like '20.0' count, all else is left out."""
    found = set()
    for code in [codes] if isinstance(codes, (int, float, str)) else codes or []:
        try:
            found.add(int(float(str(code).strip())))
        except (ValueError, OverflowError):
            continue
    return sorted(found)


def original_code(value: Column, known: list[int], special: list[int], unspecified: list[int]) -> dict[str, Column]:
    """display, status and broad group of a source's occupation code, which may be text; missing is no occupation."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e300)
    whole = F.when(finite, number.try_cast("bigint"))
    narrow = whole.between(-(2**31), 2**31 - 1)
    group = F.when(whole < 0, "-").otherwise(F.substring(F.lpad(whole.cast("string"), F.greatest(F.lit(3), F.length(whole.cast("string"))), F.lit("0")), 1, 1))
    coded = finite & (number == whole) & whole.between(0, 999)
    status = (
        F.when(value.isNull(), "missing").when(~F.coalesce(finite, F.lit(False)), "invalid_value").when(~F.coalesce(coded, F.lit(False)), "invalid_width_or_value")
        .when(whole == 0, "zero_no_information").when(whole == 999, "no_information_999").when(whole.isin(special), "special_status")
        .when(whole.isin(unspecified), "occupation_unspecified").when(whole.isin(known), "occupation").otherwise("unrecognised_three_digit_code")
    )
    display = F.when(value.isNull(), x.MISSING).when(F.coalesce(coded, F.lit(False)), F.lpad(whole.cast("string"), 3, "0")).otherwise(text)
    return {"display": display, "status": status, "broad": F.when(F.coalesce(narrow, F.lit(False)), group).otherwise(x.MISSING)}


def lag_columns(columns: list[str], skip: tuple[str, ...] = ("_source_year",)) -> list[str]:
    """The lagged columns, but for those with one of the endings."""
    return [c for c in columns if re.match(r"lag[123]_", c) and not c.endswith(skip)]


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but the keys with a prefix."""
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))


# Yearly features by the names that configurations use, and the columns each is made of.
YEARLY = {
    "ge_cat": ("ge",),
    "age": ("ja", "gbja", "death_year"),
    "age_band": ("ja", "gbja", "death_year"),
    "rehab_starts_this_year": ("rehab",),
    "cum_rehabs_by_year": ("cum_rehab",),
    "ever_rehab_to_date": ("cum_rehab",),
    "years_since_last_rehab": ("years_since_rehab",),
    "msk_starts_this_year": ("msk",),
    "ever_msk_rehab_to_date": ("cum_msk",),
    "non_msk_rehab_this_year": ("rehab", "msk"),
    "mental_health_rehab_this_year": ("mental",),
    "cum_mental_health_rehabs_by_year": ("cum_mental",),
    "ever_mental_health_rehab_to_date": ("cum_mental",),
    "entgelt_value": ("entgelt",),
    "entgelt_missing": ("entgelt",),
    "rtzb_value": ("rtzb",),
    "rtzb_missing": ("rtzb",),
    "income_source_status": ("entgelt", "rtzb"),
    "byvlgs_value": ("byvlgs",),
    "byvlgs_missing": ("byvlgs",),
    "bygmgs_value": ("bygmgs",),
    "bygmgs_missing": ("bygmgs",),
    "whot_bland_cat": ("whot_bland",),
    "occ_l1_cat": ("ttsc1_kldb1988",),
    "fmsd_cat": ("fmsd",),
}


def yearly(columns: list[str]) -> dict[str, Column]:
    """The features of a person-year that its columns can give, by name."""
    flag, past = lambda c: F.coalesce(c.cast("int"), F.lit(0)), lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")
    level = lambda c: F.coalesce(c.cast("string"), F.lit(x.MISSING))
    age = masked_age(F.col("ja"), F.col("gbja"), F.col("death_year"))
    made = {
        "age": lambda: age,
        "age_band": lambda: x.age_band(age),
        "rehab_starts_this_year": lambda: F.col("rehab"),
        "cum_rehabs_by_year": lambda: F.col("cum_rehab"),
        "ever_rehab_to_date": lambda: past("cum_rehab"),
        "years_since_last_rehab": lambda: F.col("years_since_rehab"),
        "msk_starts_this_year": lambda: F.col("msk"),
        "ever_msk_rehab_to_date": lambda: past("cum_msk"),
        "non_msk_rehab_this_year": lambda: flag((F.col("rehab") == 1) & (F.col("msk") == 0)),
        "mental_health_rehab_this_year": lambda: F.col("mental"),
        "cum_mental_health_rehabs_by_year": lambda: F.col("cum_mental"),
        "ever_mental_health_rehab_to_date": lambda: past("cum_mental"),
        "income_source_status": lambda: x.income_status(F.col("entgelt"), F.col("rtzb")),
        "occ_l1_cat": lambda: level(x.major_group(F.col("ttsc1_kldb1988"))),
        "fmsd_cat": lambda: status_label(F.col("fmsd")),
    }
    for name, (source, *_) in YEARLY.items():
        if name.endswith("_value"):
            made[name] = lambda source=source: F.coalesce(F.col(source).cast("double"), F.lit(0.0))
        elif name.endswith("_missing"):
            made[name] = lambda source=source: F.col(source).isNull().cast("int")
        elif name.endswith("_cat") and name not in made:
            made[name] = lambda source=source: level(F.col(source))
    return {name: made[name]() for name, needed in YEARLY.items() if set(needed) <= set(columns)}
