"""Dedup, audits, history windows, relabelling and risk sets.  One exchange by person serves dedup and all windows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.functions import features

MSK, FIRST, LAST = [20], 1998, 1999


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the fewest nulls, ties by `order`.  Nulls in keys form a key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    nulls = sum((F.col(c).isNull().cast("int") for c in rest), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(nulls, *order)
    return df.repartition(keys[0]).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").orderBy(F.desc("n_rows"), *keys).limit(most)


def death_conflicts(df: DataFrame) -> DataFrame:
    """Persons with several death years, and the years."""
    years = df.filter("death_year is not null").groupBy("simple_id").agg(F.array_sort(F.collect_set("death_year")).alias("years"))
    return years.filter(F.size("years") > 1).select("simple_id", F.size("years").cast("long").alias("n_years"), F.array_join("years", "|").alias("death_years"))


def flags(df: DataFrame, codes: list[int] = MSK) -> DataFrame:
    return df.withColumns({"rehab": F.col("code").isNotNull().cast("int"), "msk": x.code_in(F.col("code"), codes).cast("int")})


def history(df: DataFrame) -> DataFrame:
    """Running counts, first exposure, ever flags and years since the last event.  exposed: 1 in a year of exposure."""
    person = Window.partitionBy("simple_id")
    so_far = person.orderBy("ja").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(F.col("exposed") == 1, F.col("ja"))
    return df.withColumns({
        "first_exposure_year": F.min(start).over(person),
        "cum_rehab": F.sum("rehab").over(so_far),
        "cum_msk": F.sum("msk").over(so_far),
        "years_since_rehab": F.col("ja") - F.last(F.when(F.col("rehab") == 1, F.col("ja")), ignorenulls=True).over(so_far),
    })


#: What is known of a person after the years so far, and how it is gathered: each is a least or a greatest value.
STATE = {"cum_rehab": F.max, "cum_msk": F.max, "last_rehab": F.max, "exposed_since": F.min, "death_low": F.min, "death_high": F.max}


def onward(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The history of new years (one row a person-year, with flags) as known in each of them, from the state that the
    years before left.

    Unlike history(), no year looks ahead: exposed_since and death_conflict say what was known by then.  The state (one row a
    person, carry()) is joined by person, which the rows' dedup and all windows share as partitioning.
    """
    known = state.select("simple_id", *(F.col(c).alias(f"_{c}") for c in STATE)) if state is not None else None
    both = rows.join(known, "simple_id", "left") if known is not None else rows.withColumns({f"_{c}": F.lit(None).cast("int") for c in STATE})
    so_far = Window.partitionBy("simple_id").orderBy("ja").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.coalesce(f"_cum_{c}", F.lit(0)) + F.sum(c).over(so_far)
    year = lambda flag, f: f(F.when(F.col(flag) == 1, F.col("ja"))).over(so_far)
    out = both.withColumns({
        "cum_rehab": total("rehab").cast("long"),
        "cum_msk": total("msk").cast("long"),
        "last_rehab": F.coalesce(year("rehab", F.max), "_last_rehab").cast("int"),
        "exposed_since": F.coalesce("_exposed_since", year("exposed", F.min)).cast("int"),
        "death_low": F.least("_death_low", F.min("death_year").over(so_far)).cast("int"),
        "death_high": F.greatest("_death_high", F.max("death_year").over(so_far)).cast("int"),
    })
    conflict = F.coalesce(F.col("death_low") != F.col("death_high"), F.lit(False))
    return out.withColumns({"years_since_rehab": F.col("ja") - F.col("last_rehab"), "death_conflict": conflict}).drop(*(f"_{c}" for c in STATE))


def carry(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after rows of onward(): one row for each person of them or of the state before."""
    new = rows.select("simple_id", *STATE)
    both = new if state is None else new.unionByName(state.select("simple_id", *STATE))
    return both.groupBy("simple_id").agg(*(f(c).alias(c) for c, f in STATE.items()))


def without_conflicts(raw: DataFrame) -> DataFrame:
    """raw without the persons that have several death years; on the person's partitioning, so dedup needs no exchange
    of its own."""
    person = Window.partitionBy("simple_id")
    two = F.min("death_year").over(person) != F.max("death_year").over(person)
    return raw.repartition("simple_id").withColumn("_two", F.coalesce(two, F.lit(False))).filter(~F.col("_two")).drop("_two")


def build(raw: DataFrame, codes: list[int] = MSK) -> DataFrame:
    """The panel: persons with conflicting death years go, one row a person-year stays, flags and history follow.
    Raises ValueError where a needed column is absent."""
    if absent := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"columns are absent: {', '.join(absent)}")
    return history(flags(dedup(without_conflicts(raw), ["simple_id", "ja"], ["ord"]), codes))


REQUIRED = ("simple_id", "ja", "ord", "gbja", "ge", "entgelt", "rtzb", "code", "death_year", "exposed")


def diagnostics(raw: DataFrame) -> DataFrame:
    """metric, value: repeated person-years and their excess rows, persons with conflicting death years, and the share of
    ever exposed persons among those and among the others."""
    keys = raw.groupBy("simple_id", "ja").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("excess_rows"))
    person = raw.groupBy("simple_id").agg((F.min("death_year") != F.max("death_year")).alias("two"), F.max("exposed").alias("exposed"))
    person = person.withColumn("two", F.coalesce("two", F.lit(False)))
    share = lambda c: F.avg(F.when(c, F.col("exposed")))
    persons = person.agg(F.count("*").alias("persons"), F.count_if("two").alias("conflicted_persons"), share(F.col("two")).alias("exposed_share_excluded"), share(~F.col("two")).alias("exposed_share_retained"))
    rows = [f.select([F.col(c).cast("double").alias(c) for c in f.columns]).unpivot([], f.columns, "metric", "value") for f in (keys, persons)]
    return rows[0].unionByName(rows[1])


def definition_audit(members: DataFrame, panel: DataFrame) -> DataFrame:
    """Matched people, by arm, whom the codes now in force would have kept out: an msk event before t0, or in it."""
    events = panel.filter("msk = 1").select("simple_id", "ja")
    per = members.join(events, "simple_id", "left").groupBy("simple_id", "t0", "match_group", "treated").agg(x.any_true(F.col("ja") < F.col("t0")).alias("before"), x.any_true(F.col("ja") == F.col("t0")).alias("now"))
    return per.groupBy("treated").agg(F.count("*").alias("matched"), F.count_if("before").alias("before_t0"), F.count_if("now").alias("in_t0"), F.count_if(F.col("before") | F.col("now")).alias("would_fail"))


def recover_codes(raw: DataFrame, keys: DataFrame, code: str = "code") -> DataFrame:
    """The code of each wanted person-year by the panel's own row rule, how many rows it has, and whether their codes
    disagree.  Only wanted rows are sorted; a key without a row keeps a null code and no rows."""
    wanted = keys.select("simple_id", "ja").distinct()
    rows = raw.join(wanted, ["simple_id", "ja"], "left_semi")
    kept = dedup(rows, ["simple_id", "ja"], ["ord"]).select("simple_id", "ja", F.col(code).alias("code"))
    many = rows.groupBy("simple_id", "ja").agg(F.count("*").alias("n_rows"), x.count_values(F.col(code)).alias("n_codes"))
    return wanted.join(kept, ["simple_id", "ja"], "left").join(many, ["simple_id", "ja"], "left").select("simple_id", "ja", "code", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("n_codes") > 1, F.lit(False)).alias("disagree"))


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_first(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


DERIVED = ("rehab", "msk", "first_exposure_year", "cum_rehab", "cum_msk", "years_since_rehab")


def relabel(panel: DataFrame, codes: list[int], mental: list[int] | None = None) -> DataFrame:
    """The panel under other code sets: same windows, without a new dedup.  Yearly features that it has are made anew; mental: their
    codes of mental health measures."""
    gone = {*DERIVED, "mental", "cum_mental", *features.YEARLY}
    out = history(flags(panel.select(*(c for c in panel.columns if c not in gone)), codes))
    return described(out, mental or []) if set(features.YEARLY) & set(panel.columns) else out


#: Columns that a source may have beyond REQUIRED, of which yearly features are made.
OPTIONAL = ("byvlgs", "bygmgs", "whot_bland", "ttsc1_kldb1988", "fmsd", "divorcing", "marriage_start", "first_marriage_start", "is_first_marriage")


def described(panel: DataFrame, mental: list[int], first_marriage: str | None = None) -> DataFrame:
    """The panel with all yearly features that its columns can give (features.YEARLY), under the names of configurations.

    first_marriage: a rule of features.first_marriage_ends; where the source has its columns, the panel says so of each year.
    """
    so_far = Window.partitionBy("simple_id").orderBy("ja").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = panel.withColumn("mental", x.code_in(F.col("code"), mental).cast("int"))
    out = out.withColumn("cum_mental", F.sum("mental").over(so_far))
    out = out.withColumns(features.yearly(out.columns))
    dates, proxy = {"divorcing", "marriage_start", "first_marriage_start"}, {"divorcing", "is_first_marriage"}
    if first_marriage and (dates if first_marriage == "date_fields" else proxy) <= set(panel.columns):
        col = lambda c: F.col(c) if c in panel.columns else F.lit(None)
        ends = features.first_marriage_ends(first_marriage, col("divorcing"), col("marriage_start"), col("first_marriage_start"), col("is_first_marriage"))
        out = out.withColumn("first_marriage_ends", ends)
    return out


def lag(panel: DataFrame, depth: int) -> DataFrame:
    """lag{depth}_* of each person-year by a join on the shifted year: a gap gives null, unlike a row offset.  Yearly features that
    the panel has are lagged too."""
    lagged = [*("ge", "gbja", "entgelt", "rtzb", "cum_rehab", "cum_msk", "rehab"), *(c for c in features.YEARLY if c in panel.columns)]
    return panel.select("simple_id", (F.col("ja") + depth).alias("t0"), F.col("ja").alias(f"lag{depth}_source_year"), *(F.col(c).alias(f"lag{depth}_{c}") for c in lagged))


def stages(panel: DataFrame, depth: int = 1) -> list[str]:
    """The rules of a risk set, in order: those of STAGES, of the treated one on their first marriage where the panel knows it, and one on
    years before the first lag."""
    marriage = ["first_marriage"] * ("first_marriage_ends" in panel.columns)
    return [*STAGES[:2], *marriage, *STAGES[2:], *["has_all_lags"] * (depth > 1)]


STAGES = ("in_window", "exposure_rule", "alive", "no_msk_now", "has_lag", "valid_age", "no_prior_msk")


def staged(panel: DataFrame, first: int = FIRST, last: int = LAST, depth: int = 1) -> DataFrame:
    """Candidates of both arms with the number of the last rule that they pass, in order.  depth: so many years before
    t0 need a row; those beyond the first make one more rule."""
    base = panel.filter(F.col("ja").between(first, last)).withColumn("t0", F.col("ja"))
    joined = base.join(lag(panel, 1), ["simple_id", "t0"], "left")
    if depth > 1:
        # rows of the years before t0, on the person's partitioning; the panel has one row a person-year
        back = Window.partitionBy("simple_id").orderBy("ja").rangeBetween(-depth, -2)
        joined = joined.join(panel.select("simple_id", F.col("ja").alias("t0"), F.count("*").over(back).alias("_back")), ["simple_id", "t0"], "left")
        known = [c for c in features.YEARLY if c in panel.columns]
        for k in range(2, depth + 1) if known else ():
            joined = joined.join(lag(panel, k).select("simple_id", "t0", *(f"lag{k}_{c}" for c in known)), ["simple_id", "t0"], "left")
    age = F.col("lag1_source_year") - F.col("lag1_gbja")
    out = joined.withColumns({"treated": F.coalesce((F.col("first_exposure_year") == F.col("t0")).cast("int"), F.lit(0)), "lag1_age": age})
    rules = [F.lit(True), F.col("first_exposure_year").isNull() | (F.col("first_exposure_year") >= F.col("t0")), F.col("death_year").isNull() | (F.col("death_year") > F.col("t0")), F.col("msk") == 0, F.col("lag1_source_year").isNotNull(), age.between(0, 125), F.col("lag1_cum_msk") == 0]
    if "first_marriage_ends" in panel.columns:
        rules.insert(2, (F.col("treated") == 0) | F.col("first_marriage_ends"))
    if depth > 1:
        rules.append(F.col("_back") == depth - 1)
    passed, ok = F.lit(0), F.lit(True)
    for rule in rules:
        ok = ok & F.coalesce(rule, F.lit(False))
        passed = passed + ok.cast("int")
    return out.withColumn("passed", passed).drop("_back")


def risk_set(panel: DataFrame, first: int = FIRST, last: int = LAST, depth: int = 1) -> DataFrame:
    """Treated and control candidates that pass all rules; controls only of years with treated ones."""
    all_ = staged(panel, first, last, depth).filter(F.col("passed") == len(stages(panel, depth))).withColumn("lag1_ever_rehab", (F.col("lag1_cum_rehab") > 0).cast("int"))
    years = all_.filter("treated = 1").select("t0").distinct()
    return all_.join(F.broadcast(years), "t0", "left_semi")  # at most one row a calendar year


def attrition(panel: DataFrame) -> DataFrame:
    """Rows and persons left after each rule, by arm, in one pass."""
    names = stages(panel)
    person = staged(panel).groupBy("treated", "simple_id").agg(F.max("passed").alias("most"), *(F.count_if(F.col("passed") > k).alias(f"n{k}") for k in range(len(names))))
    per = person.groupBy("treated").agg(*(F.sum(f"n{k}").alias(f"r{k}") for k in range(len(names))), *(F.count_if(F.col("most") > k).alias(f"p{k}") for k in range(len(names))))
    long = per.select("treated", F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(s).alias("stage"), F.col(f"r{k}").alias("n_rows"), F.col(f"p{k}").alias("n_persons")) for k, s in enumerate(names)))).alias("s")).select("treated", "s.*")
    w = Window.partitionBy("treated").orderBy("ord")
    return long.withColumn("removed", F.coalesce(F.lag("n_rows").over(w) - F.col("n_rows"), F.lit(0))).select("treated", "stage", "n_rows", "n_persons", "removed")
