"""More queries over the driver's tables: source checks, row features, release tables and integrity checks."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import CohortConfig
from tessera.functions import exprs as x
from tessera.functions import features
from tessera.operators import checks, covariates, design, followup, histories, mediation, models, pairs, panel, release, resample
from tessera.plans import chain
from tessera.plans.catalog import CODES, HORIZON, _arms, _events, _follow, _long, _pairs, _panel, _r, _risk, _samples, _spells, query
from tessera.sources import align, files
from tessera.sources.bindings import person_years, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query
def optional_columns(s, d):
    """The first spelling that a source has, and typed nulls for what it lacks."""
    f = _spells(s, d)
    slot = align.first_present(f.columns, ["m1_new", "c1", "c1_old"])
    f = align.optional_nulls(f.withColumn("slot", F.col(slot)), ["byvlgs", "whot_bland", "note", "court_decision"], dates=("court_decision",))
    return align.present(f, ["o_orderkey", "absent", "slot", "byvlgs", "whot_bland", "note", "court_decision"])


@query
def source_row_counts(s, d):
    n = align.row_counts(s, [f"{d}/{t}.parquet" for t in ("region",)])
    for t in TABLES[1:]:
        n = n.unionByName(align.row_counts(s, [f"{d}/{t}.parquet"]))
    return n.select(F.regexp_extract("path", "([a-z]+)[.]parquet", 1).alias("source"), "n_rows")


@query
def column_inventory(s, d):
    """Columns about dates, prices and segments, with the values that each has."""
    out = None
    for t in TABLES:
        found = files.matching(table(s, d, t), "date|price|segment")
        if found:
            one = table(s, d, t).agg(*(F.count(c).alias(c) for c in found)).unpivot([], found, "column", "n_values")
            one = one.select(F.lit(t).alias("source"), "column", "n_values")
            out = one if out is None else out.unionByName(one)
    return out


def _on_disk(s, name):
    """A place of its own for each call: a result is read when it is asked for."""
    return f"{models.root_of(s)}/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(s, d):
    small = _panel(s, d).groupBy("ja").agg(F.count("*").alias("n"), F.max("entgelt").alias("most"), F.max("death_year").alias("death_year"))
    at = models.delete_at_end(s, _on_disk(s, "csv"))
    files.write_csv(small, at)
    return files.read_csv(s, at, small.schema)


@query
def edge_preflight(s, d):
    """Sizes of the year's matching problems, year by year as rows of one CSV."""
    scored = pairs.score(_risk(s, d))
    cells = scored.groupBy(*pairs.STRATA).agg(F.sum("treated").alias("t"), F.sum(1 - F.col("treated")).alias("c"))
    per = cells.groupBy("t0").agg(F.count("*").alias("strata"), F.sum("t").alias("n_treated"), F.sum("c").alias("n_controls"), F.sum(F.col("t") * F.col("c")).alias("dense"), F.max(F.col("t") * F.col("c")).alias("largest"))
    at = models.delete_at_end(s, _on_disk(s, "preflight"))
    files.append_rows([per.filter(F.col("t0") == y) for y in range(panel.FIRST, panel.LAST + 1)], at)
    return files.read_csv(s, at, per.schema)


@query
def application_activity(s, d):
    k = F.col("o_orderkey")
    flag = lambda m: (k % m == 0).cast("int")
    f = table(s, d, "orders").select(*(c.alias(n) for n, c in features.application_activity(flag(5), flag(7), F.when(k % 13 != 0, flag(11)), (k % 3).cast("int"), flag(4)).items()))
    return f.groupBy("non_subset", "non_success", "n_types").agg(F.count("*").alias("n"))


@query
def first_marriage_rules(s, d):
    k, f = F.col("o_orderkey"), _spells(s, d)
    first, flag = F.when(k % 2 == 0, F.col("s1")).otherwise(F.col("s2")), F.when(k % 3 != 0, k % 2)
    divorcing = (k % 4 < 2).cast("int")
    rule = lambda name: features.first_marriage_ends(name, divorcing, F.col("s1"), first, flag).alias(name)
    dates = features.first_marriage_dates(flag, F.col("s1"), F.col("e1"), F.col("e2"))
    return f.select("o_orderkey", rule("date_fields"), rule("is_first_marriage"), *(c.alias(n) for n, c in dates.items()))


@query
def prefixed_columns(s, d):
    """Lagged columns beside the current year's, named by prefixes."""
    p = _panel(s, d).select("simple_id", "ja", "ge", "rehab")
    lagged = panel.lag(_panel(s, d), 1)
    kept = features.lag_columns(lagged.columns)
    now = features.prefixed(p.withColumnRenamed("ja", "t0"), "current_", ["simple_id", "t0"])
    return now.join(lagged.select("simple_id", "t0", *kept), ["simple_id", "t0"]).select("simple_id", "t0", "current_ge", "current_rehab", "lag1_ge", "lag1_rehab")


KNOWN, SPECIAL, UNSPECIFIED = list(range(100, 900, 7)), list(range(970, 999)), [121]


@query
def original_codes(s, d):
    k = F.col("p_partkey")
    code = F.when(k % 13 == 0, None).when(k % 11 == 0, "abc").when(k % 17 == 0, "inf").when(k % 7 == 0, "1234").when(k % 5 == 0, " 999 ").when(k % 3 == 0, "0").when(k % 2 == 0, F.concat((k % 998).cast("string"), F.lit(".0"))).when(k % 19 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise((k % 998).cast("string"))
    f = table(s, d, "part").select(*(c.alias(n) for n, c in features.original_code(code, KNOWN, SPECIAL, UNSPECIFIED).items()))
    return f.groupBy("display", "status", "broad").agg(F.count("*").alias("n"))


@query
def normal_sex(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").groupBy(features.normal_sex(F.when(k % 4 == 0, "1.0").when(k % 4 == 1, "2").when(k % 4 == 2, "3")).alias("sex")).agg(F.count("*").alias("n"))


def _conflicted(s, d):
    """Person-years in which some persons have several death years."""
    return person_years(s, d).withColumn("death_year", F.when(F.col("ord") % 50 == 0, F.col("ja")).otherwise(F.col("death_year")))


@query
def panel_without_conflicts(s, d):
    return panel.build(_conflicted(s, d)).groupBy("ja").agg(F.count("*").alias("n"), F.countDistinct("death_year").alias("death_years"), F.sum("cum_rehab").alias("cum_rehab"))


@query
def panel_diagnostics(s, d):
    return panel.diagnostics(_conflicted(s, d)).withColumn("value", _r("value"))


@query
def definition_audit(s, d):
    return panel.definition_audit(pairs.assignment(_pairs(s, d)), panel.relabel(_panel(s, d), CODES))


@query
def recovered_codes(s, d):
    """Original codes of matched persons in the year before t0."""
    keys = pairs.assignment(_pairs(s, d)).select("simple_id", (F.col("t0") - 1).alias("ja"))
    return panel.recover_codes(person_years(s, d), keys)


@query
def validated_merge(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    people = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return checks.merge(orders, people, ["k"], "full", "m:1", "side").groupBy("side", "c_nationkey").agg(F.count("*").alias("n"))


@query
def ranked_nulls_last(s, d):
    p = _panel(s, d).select("simple_id", "ja", "entgelt", "code")
    w = Window.partitionBy("ja").orderBy(F.desc_nulls_last("code"), F.asc_nulls_last("entgelt"), "simple_id")
    return p.withColumn("rank", F.row_number().over(w)).select("simple_id", "ja", "rank")


@query
def final_stage(s, d):
    stages = panel.attrition(_panel(s, d))
    order = F.array_position(F.array(*(F.lit(n) for n in panel.STAGES)), F.col("stage"))
    return panel.last_of(stages.withColumn("ord", order), ["treated"], ["ord"]).select("treated", "stage", "n_rows", "n_persons")


PLAN = CohortConfig(lag_depth=3, source_has_entgelt=True, exact_columns=("lag1_ge", "lag1_ever_rehab"), propensity_numeric=("lag1_age", "lag1_entgelt_value", "lag1_absent", "lag1_ge"), propensity_binary=("lag1_ever_rehab", "lag1_entgelt_missing"), propensity_categorical=("lag1_income_source_status",))


def _three_lags(s, d):
    """The risk set with the names of a study's covariates, and measures of years two and three before t0."""
    risk, p = _risk(s, d), _panel(s, d)
    own = risk.select(
        *("simple_id", "t0", "lag1_ge", "lag1_ever_rehab", "lag1_age"),
        F.col("lag1_entgelt").alias("lag1_entgelt_value"),
        F.col("lag1_entgelt").isNull().cast("int").alias("lag1_entgelt_missing"),
        x.income_status(F.col("lag1_entgelt"), F.col("lag1_rtzb")).alias("lag1_income_source_status"),
    )
    for k in (2, 3):
        pension, earned = F.col(f"lag{k}_rtzb"), F.col(f"lag{k}_entgelt")
        more = (pension.alias(f"lag{k}_rtzb_value"), earned.alias(f"lag{k}_entgelt_value"))
        seen = F.when(F.col(f"lag{k}_source_year").isNotNull(), x.income_status(earned, pension))
        lagged = panel.lag(p, k).select("simple_id", "t0", *more, seen.alias(f"lag{k}_income_source_status"))
        own = own.join(lagged, ["simple_id", "t0"], "left")
    return own


@query
def feature_plan(s, d):
    """The covariates that a plan finds in the risk set, with and without earnings: role, place, rows that have a value, distinct values."""
    rows, out = _three_lags(s, d), []
    used = [c for c in rows.columns if c not in ("simple_id", "t0")]
    # one pass for all columns; a row of a few numbers
    counts = rows.agg(*(f(c).alias(f"{n}_{c}") for c in used for n, f in (("some", F.count), ("levels", F.countDistinct))))
    for earnings in (True, False):
        plan = covariates.resolve(replace(PLAN, source_has_entgelt=earnings), used)
        for role, names in plan.items():
            for i, c in enumerate(names):
                said = F.lit(earnings).alias("earnings"), F.lit(role).alias("role"), F.lit(i).alias("place"), F.lit(c).alias("column")
                out.append(F.struct(*said, F.col(f"some_{c}").alias("n"), F.col(f"levels_{c}").alias("levels")))
    return counts.select(F.explode(F.array(*out)).alias("r")).select("r.*")


@query
def grouped_statistics(s, d):
    g = release.describe(_long(_samples(s, d)), ["sample", "treated", "variable"], [])
    return g.select("sample", "treated", "variable", "n", "missing", *(_r(c, 3).alias(c) for c in ("mean", "sd", "lo", "hi", "q01", "q05", "q25", "median", "q75", "q95", "q99")))


@query
def descriptives_full(s, d):
    f = _samples(s, d)
    rows = f.select("sample", "treated", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in ("lag1_age", "lag1_ever_rehab", "lag1_rtzb")))).alias("v")).select("sample", "treated", "v.*")
    return release.describe(rows, ["sample", "treated", "variable"], ["lag1_ever_rehab"]).select("sample", "treated", "variable", "n", "missing", *(_r(c, 3).alias(c) for c in ("mean", "median", "percent")))


@query
def imbalanced_covariates(s, d):
    long = pairs.weighted(_long(_samples(s, d)), ["sample", "treated", "variable"], "value")
    a = _arms(long, ["sample", "variable"])
    values = a.select("sample", "variable", x.smd(F.col("mt"), F.col("vt"), F.col("mc"), F.col("vc")).alias("smd"))
    flags = a.select("sample", F.concat("variable", F.lit("__missing")).alias("variable"), x.smd(F.col("qt"), F.col("qt") * (1 - F.col("qt")), F.col("qc"), F.col("qc") * (1 - F.col("qc"))).alias("smd"))
    return release.imbalanced(values.unionByName(flags), ["lag1_age", "lag1_entgelt", "lag1_rtzb"], 0.01).withColumn("max_abs_smd", _r("max_abs_smd", 5))


def _scored(s, d):
    return pairs.score(_risk(s, d))


def _distances(s, d):
    return release.distances(_pairs(s, d), _scored(s, d))


@query
def matching_overall(s, d):
    return release.matching_overall(_scored(s, d), _distances(s, d), pairs.CALIPER).withColumn("value", _r("value", 3))


@query
def matching_overall_released(s, d):
    return release.release_overall(release.matching_overall(_scored(s, d), _distances(s, d), pairs.CALIPER), 200).withColumn("value", _r("value", 3))


@query
def matching_by_year(s, d):
    return release.matching_by_year(_scored(s, d), _pairs(s, d)).withColumn("match_rate", _r("match_rate"))


@query
def matching_by_year_released(s, d):
    return release.release_by_year(release.matching_by_year(_scored(s, d), _pairs(s, d)), 100).withColumn("match_rate", _r("match_rate"))


@query
def attrition_released(s, d):
    order = F.array_position(F.array(*(F.lit(n) for n in panel.STAGES)), F.col("stage"))
    unmatched = release.matching_by_year(_scored(s, d), _pairs(s, d)).agg(F.sum(F.col("n_treated") - F.col("n_matched")).alias("unmatched"))
    stages = panel.attrition(_panel(s, d)).withColumn("ord", order).withColumn("_", F.lit(1)).join(unmatched.withColumn("_", F.lit(1)), "_").drop("_")  # one row
    return release.release_attrition(stages, F.col("unmatched"), 1_000_000)


@query
def overlap_detail(s, d):
    return release.overlap(pairs.assignment(_pairs(s, d)))


def _schemes(s, d):
    """Members of pairs, and the schemes that group them."""
    base = _risk(s, d).select("simple_id", "t0", "treated", F.col("lag1_ge").alias("sex"), x.income_status(F.col("lag1_entgelt"), F.col("lag1_rtzb")).alias("income"))
    members = pairs.assignment(_pairs(s, d)).join(base, ["simple_id", "t0", "treated"])
    pair = Window.partitionBy("match_group")
    same = F.when((F.min("income").over(pair) == F.max("income").over(pair)) & (F.count("*").over(pair) == 2), F.col("income"))
    own = members.withColumns({"same": same, "points": F.max(F.when(F.col("treated") == 1, F.col("simple_id") % 4 - 1)).over(pair)})
    signed = F.when(F.col("points").isNull(), "unknown").when(F.col("points") > 0, "gain").when(F.col("points") < 0, "loss").otherwise("zero")
    sex = F.col("sex")
    return own, {"all": (sex, F.lit("all")), "own_income": (sex, F.col("income")), "same_income": (sex, F.col("same")), "points": (sex, signed)}


def _groups(s, d):
    return release.group_cells(_follow(s, d), *_schemes(s, d))


@query
def group_definitions(s, d):
    return _groups(s, d)


@query
def protected_groups(s, d):
    return release.protect_groups(_groups(s, d), "all", 12).select("scheme", "part", "level", "disclosure", "treated_assigned", "treated_entered", "treated_events", "control_without")


@query
def export_six_cells(s, d):
    f = _follow(s, d).withColumn("sex", 1 + F.col("simple_id") % 2)
    on = lambda a, c: F.countDistinct(F.when((F.col("treated") == a) & c, F.col("match_group")))
    event = F.col("event_type") == 1
    rows = f.groupBy("sex", "t0").agg(*(on(a, c).alias(f"{n}_{arm}") for a, arm in ((0, "controls"), (1, "treated")) for n, c in (("people", F.lit(True)), ("events", event))))
    return release.six_cells(rows, ["sex", "t0"], 5)


@query
def code_counts_by_arm(s, d):
    """Codes of matched persons in the year before t0, with every known code."""
    members = pairs.assignment(_pairs(s, d)).select("simple_id", "treated", (F.col("t0") - 1).alias("ja"))
    rows = members.join(_panel(s, d).select("simple_id", "ja", F.coalesce(F.col("code").cast("string"), F.lit(x.MISSING)).alias("code")), ["simple_id", "ja"])
    spine = s.createDataFrame([(c,) for c in (x.MISSING, "10", "20", "30", "40")], "code string")
    return release.counts_by_arm(rows, spine, "code").select("code", "treated_n", "control_n", _r("treated_pct").alias("treated_pct"), _r("control_pct").alias("control_pct"))


@query
def weighted_incidence(s, d):
    f = _follow(s, d).withColumn("w", 1 + F.col("match_group") % 3)
    return followup.incidence(f, "w").select("treated", "follow_year", "n", "d1", "d2", _r("cif").alias("cif"))


@query
def followup_checks(s, d):
    return checks.followup(_follow(s, d), _pairs(s, d), HORIZON, panel.FIRST, panel.LAST, 2002)


@query
def event_pair_means(s, d):
    return followup.pair_means(_events(s, d), 20).withColumns({c: _r(c) for c in ("treated_mean", "control_mean")})


@query
def hazard_score_checks(s, d):
    """The hazard's score equations at its estimates: each term's residuals sum to 0."""
    return models.hazard_scores(_follow(s, d)).select("term", (F.abs("score") < 1e-3).alias("solved"))


@query
def greedy_checks(s, d):
    """Greedy pairs never exceed the smaller arm, nor the treated with a control within the caliper."""
    found, edges = pairs.greedy_benchmark(_scored(s, d)), pairs.caliper_edges(_scored(s, d))
    both = found.join(edges.select(*(F.col(k).alias(f"_{k}") for k in pairs.STRATA), "n_treated", "n_controls", "n_matchable"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in pairs.STRATA])
    return both.select(*pairs.STRATA, (F.col("n_matched") <= F.least("n_treated", "n_controls", "n_matchable")).alias("bounded"), ((F.col("n_matchable") > 0) == (F.col("n_matched") > 0)).alias("some"), (F.col("distance") <= F.col("n_matched") * pairs.CALIPER).alias("near"))


@query
def pointwise_estimates(s, d):
    """The curves' estimates and risk sets, and whether each interval is in order."""
    c = models.pointwise_curves(_follow(s, d))
    return c.select("treated", "follow_year", _r("estimate").alias("cif"), F.col("n_at_risk").cast("long").alias("n_at_risk"), (F.col("ci_low") <= F.col("ci_high")).alias("ordered"))


def _years(s, d):
    """Person-years with the year before beside them."""
    p = _panel(s, d)
    state = lambda when: [x.income_status(F.col("entgelt"), F.col("rtzb")).alias(f"{when}_income"), *(F.col(c).alias(f"{when}_{c}") for c in ("entgelt", "rtzb", "rehab"))]
    before = p.select("simple_id", (F.col("ja") + 1).alias("ja"), (F.col("cum_msk") > 0).cast("int").alias("mediator_prev"), *state("prior"))
    now = p.select("simple_id", "ja", F.col("ja").alias("follow_year"), "ge", (F.col("ja") - F.col("gbja")).alias("age"), F.coalesce((F.col("first_exposure_year") <= F.col("ja")).cast("int"), F.lit(0)).alias("treated"), F.col("msk").alias("mediator_now"), *state("current"))
    return now.join(before, ["simple_id", "ja"])


@query
def history_checks(s, d):
    """A year drawn for all person-years by the fitted histories: rows, and violations of what a drawn year keeps to."""
    rows = models.save(_years(s, d))
    model = histories.fit(rows, histories.specs({"numeric": ["age"], "categorical": ["ge"]}))
    drawn = model.update(rows, 3, "simple_id", "ja")
    status = F.col("current_income")
    rules = {
        "unknown_status": ~status.isin("both", "earnings_only", "pension_only", "neither"),
        "earnings_without_status": ~status.isin(*histories.EARNED) & (F.col("current_entgelt") != 0),
        "pension_without_status": ~status.isin(*histories.PENSIONED) & (F.col("current_rtzb") != 0),
        "negative_amount": (F.col("current_entgelt") < 0) | (F.col("current_rtzb") < 0),
        "not_binary": ~F.col("current_rehab").isin(0, 1),
        "state_not_carried": ~(F.col("prior_income").eqNullSafe(status) & F.col("prior_entgelt").eqNullSafe(F.col("current_entgelt")) & F.col("prior_rehab").eqNullSafe(F.col("current_rehab"))),
        "null_draw": status.isNull() | F.col("current_entgelt").isNull() | F.col("current_rtzb").isNull() | F.col("current_rehab").isNull(),
    }
    found = drawn.agg(F.count("*").alias("n_rows"), *(F.count_if(r).alias(n) for n, r in rules.items()))
    return found.unpivot([], found.columns, "rule", "value")


@query
def chain_checks(s, d):
    """Panel, risk set, fitted scores, optimal pairs and follow-up as one run: sizes that the rules fix, and violations."""
    study = chain.study(s, _panel(s, d), models.save, horizon=HORIZON)
    return chain.checks_of(study, panel.FIRST, panel.LAST, horizon=HORIZON)


@query
def mediation_lives(s, d):
    """Years of matched people as the mediation models take them."""
    rows = mediation.lives(pairs.assignment(_pairs(s, d)), _panel(s, d), _risk(s, d), mediation.Plan(horizon=HORIZON))
    return rows.withColumns({f"{when}_{a}": _r(f"{when}_{a}", 4) for when in ("prior", "current") for a in mediation.AMOUNTS})


@query
def mediation_effects(s, d):
    """Interventional effects of the matched treated, with intervals from 20 replicates."""
    return mediation.mediation(pairs.assignment(_pairs(s, d)), _panel(s, d), _risk(s, d), mediation.Plan(horizon=HORIZON), 20)[0]


@query
def resampled_pairs(s, d):
    """Draws of 10 replicates by sex: as many as there are pairs."""
    sex = _risk(s, d).filter("treated = 1").select(F.col("simple_id").alias("t_id"), "t0", F.col("lag1_ge").alias("sex"))
    clusters = models.save(_pairs(s, d).join(sex, ["t_id", "t0"]).select("match_group", "sex"))
    drawn = resample.weights(clusters, "match_group", range(1, 11), strata="sex").join(clusters, "match_group")
    each = drawn.select("sex", F.posexplode("weights").alias("k", "w"))
    return each.groupBy("sex", (F.col("k") + 1).alias("replicate")).agg(F.sum("w").alias("draws"), F.count("*").alias("pairs"))


@query
def aligned_shards(s, d):
    """Shards whose schemas differ, written apart and read as one table: a missing column is null, text that is no number too."""
    at = models.delete_at_end(s, _on_disk(s, "shards"))
    rows = person_years(s, d).select("simple_id", "ja", "ge", "entgelt", "code")
    text = F.when(F.col("code") == 30, "none").otherwise(F.concat(F.col("code").cast("string"), F.lit(".0")))
    shards = {
        "a": rows.filter("ja < 1997").drop("code"),
        "b": rows.filter("ja BETWEEN 1997 AND 1998").withColumn("ge", F.col("ge").cast("string")),
        "c": rows.filter("ja > 1998").withColumns({"code": text, "ja": F.col("ja").cast("string")}),
    }
    found = []
    for name, rows in shards.items():
        rows.coalesce(1).write.parquet(f"{at}/{name}")
        found.append(f"{at}/{name}")
    whole = align.scan_aligned(s, found, ["simple_id", "ja", "ge", "entgelt", "code", "absent"])
    sums = (F.sum(c).alias(f"sum_{c}") for c in ("simple_id", "code"))
    return whole.groupBy("ja", "ge").agg(F.count("*").alias("n"), F.count("code").alias("codes"), F.count("absent").alias("absent"), _r(F.sum("entgelt"), 2).alias("entgelt"), *sums)


@query
def panel_written_by_year(s, d):
    """The panel as the sink writes it, a folder a year, read back."""
    at = models.delete_at_end(s, _on_disk(s, "years"))
    align.write_panel(_panel(s, d), at, "ja")
    return s.read.parquet(at).groupBy("ja").agg(F.count("*").alias("n"), F.countDistinct("simple_id").alias("persons"), F.sum("cum_rehab").alias("cum_rehab"))


@query
def modes_and_counts(s, d):
    """The most frequent code of each year (the least of ties), its count, and how many codes there are."""
    p = _panel(s, d).filter("code IS NOT NULL")
    counts = p.groupBy("ja", "code").agg(F.count("*").alias("n"))
    first = F.max_by("code", F.struct("n", -F.col("code")))
    by_hand = counts.groupBy("ja").agg(first.alias("mode"), F.max("n").alias("n"), F.count("*").alias("codes"))
    return by_hand.join(p.groupBy("ja").agg(F.mode("code", True).alias("built_in")), "ja")


@query
def design_matrix(s, d):
    """The adjusted model's design of every row of the follow-up: its columns that aren't 0."""
    base = _risk(s, d).select("simple_id", "t0", "treated", "lag1_age", "lag1_entgelt", "lag1_rtzb", "lag1_ever_rehab", "lag1_ge")
    rows = models.save(_follow(s, d).join(base, ["simple_id", "t0", "treated"]))
    made = design.columns(rows, numeric=["lag1_age"], amounts=["lag1_entgelt", "lag1_rtzb"], binary=["lag1_ever_rehab"], categorical=["event_type"])
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), _r(c, 5).alias("value")) for n, c in made.items()))).alias("e")
    return rows.select("match_group", "treated", "follow_year", each).select("match_group", "treated", "follow_year", "e.*").filter("value != 0")


@query
def panel_features(s, d):
    """Every yearly feature that the panel's columns can give, under its configured name."""
    rows = panel.described(_panel(s, d), [30])
    named = [c for c in features.YEARLY if c in rows.columns]
    return rows.select("simple_id", "ja", *(_r(c, 4).alias(c) if c.endswith("_value") else F.col(c) for c in named))


@query
def relabelled_features(s, d):
    """The features under other code sets, by year."""
    rows = panel.relabel(panel.described(_panel(s, d), [30]), [20, 30], [10])
    summed = ("msk_starts_this_year", "ever_msk_rehab_to_date", "non_msk_rehab_this_year", "mental_health_rehab_this_year")
    summed += ("cum_mental_health_rehabs_by_year", "ever_mental_health_rehab_to_date", "cum_rehabs_by_year")
    return rows.groupBy("ja").agg(*(F.sum(c).alias(c) for c in summed))


def _compared(s, d):
    """Controls of the risk set, and whether they are matched."""
    got = _pairs(s, d).select(F.col("c_id").alias("simple_id"), "t0", F.lit(1).alias("m")).distinct()
    rows = _risk(s, d).filter("treated = 0").join(got, ["simple_id", "t0"], "left")
    income = x.income_status(F.col("lag1_entgelt"), F.col("lag1_rtzb")).alias("income")
    return rows.select(F.coalesce("m", F.lit(0)).alias("matched"), "lag1_age", "lag1_rtzb", "lag1_ever_rehab", income, x.age_band(F.col("lag1_age")).alias("band"), "t0")


GROUPS = (["lag1_age", "lag1_rtzb"], ["lag1_ever_rehab"], ["income", "band", "t0"])


@query
def matchability(s, d):
    rows = release.compare_groups(_compared(s, d), *GROUPS)
    return rows.withColumns({c: _r(c, 5) for c in ("matched_value", "unmatched_value", "smd")})


@query
def matchability_released(s, d):
    rows = release.release_groups(_compared(s, d), *GROUPS, 5)
    return rows.withColumns({c: _r(c, 5) for c in ("matched_value", "unmatched_value", "smd")})


def _by_half(s, d):
    return _follow(s, d).withColumn("half", 1 + F.col("match_group") % 2)


@query
def gap_sensitivity_counts(s, d):
    """Pairs, people and events of each group under both rules of gaps."""
    return models.gap_counts(_by_half(s, d), "half")


@query
def gap_sensitivity(s, d):
    """Odds ratios of each group under both rules of gaps, with small cells withheld."""
    return release.six_cells(models.gap_sensitivity(_by_half(s, d), "half").drop("status"), ["half", "rule"], 3)


@query
def group_risks(s, d):
    """Risks of both arms in the last year by scheme, part and level, and their difference."""
    draws = release.group_draws(_follow(s, d), *_schemes(s, d), replicates=0)
    return draws.select("scheme", "part", "level", *(_r(m).alias(m) for m in release.MEASURES))


@query
def group_effects_released(s, d):
    """Effects of groups with intervals, without those of groups that are withheld."""
    draws = release.group_draws(_follow(s, d), *_schemes(s, d), replicates=100)
    return release.protect_effects(release.group_effects(draws, 100), release.protect_groups(_groups(s, d), "all", 12))


@query
def group_contrasts_released(s, d):
    """Risk differences of incomes against earnings alone, and of gains against losses."""
    draws, protected = release.group_draws(_follow(s, d), *_schemes(s, d), replicates=100), release.protect_groups(_groups(s, d), "all", 12)
    asked = [("income", ("own_income", "1", v), ("own_income", "1", "earnings_only")) for v in ("both", "pension_only", "neither")]
    return release.contrast_rows(draws, protected, [*asked, ("points", ("points", "1", "gain"), ("points", "1", "loss"))], 100)
