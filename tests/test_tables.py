import random

import pytest
from pyspark.sql import functions as F

from tessera.config import CohortConfig
from tessera.functions import exprs, features
from tessera.operators import checks, covariates, disclosure, followup, models, pairs, panel, release
from tessera.plans import chain
from tessera.sources import align, files

RAW = "simple_id long, ja int, ord long, gbja int, ge int, entgelt double, rtzb double, code int, death_year int, exposed int"


def test_codes():
    assert features.normal_codes(None) == [] and features.normal_codes("20.0") == [20] and features.normal_codes([30, "20", None, "x", 20.0, float("inf")]) == [20, 30]
    assert features.lag_columns(["lag1_a", "lag2_source_year", "lag4_b", "a", "lag3_c"]) == ["lag1_a", "lag3_c"]


def test_original_codes(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", "nan", "-5", "7.5", "7", "1e400", "999")], "v string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in features.original_code(F.col("v"), [7], [], []).items())).collect()]
    assert got == [
        ("__MISSING__", "missing", "__MISSING__"), ("", "invalid_value", "__MISSING__"), ("nan", "invalid_value", "__MISSING__"), ("-5", "invalid_width_or_value", "-"),
        ("7.5", "invalid_width_or_value", "0"), ("007", "occupation", "0"), ("1e400", "invalid_value", "__MISSING__"), ("999", "no_information_999", "9"),
    ]


def test_first_marriage(spark):
    with pytest.raises(ValueError):
        features.first_marriage_ends("both", *[F.lit(1)] * 4)
    df = spark.createDataFrame([(1, None, None, None)], "d int, s date, f date, i int")
    assert tuple(df.select(*(features.first_marriage_ends(r, *(F.col(c) for c in "dsfi")) for r in ("date_fields", "is_first_marriage"))).first()) == (False, False)


def test_pooling_keeps_null_codes_and_keys(spark):
    rows = [(i, None if i % 2 else "s", None if i < 10 else "A") for i in range(15)]
    df = spark.createDataFrame(rows, "simple_id long, seg string, code string")
    got = disclosure.pool_small(df, ["seg"], "code", 2)
    assert got.agg(F.sum("events")).first()[0] == 15 and got.filter("code is null").agg(F.sum("events")).first()[0] == 10


def test_null_strata_are_strata(spark):
    df = spark.createDataFrame([(1, 1998, 1, None, None), (2, 1998, 0, None, None), (3, 1998, 0, 1, None)], "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int")
    assert [(r.t_id, r.c_id) for r in pairs.rank_pairs(df).collect()] == [(1, 2)]


def test_panel_drops_conflicts_and_needs_its_columns(spark):
    rows = [(1, 1998, 1, 1950, 1, 1.0, None, None, 2000, 0), (1, 1999, 2, 1950, 1, 1.0, None, 20, 2001, 1), (2, 1998, 3, 1950, 1, None, None, None, None, 1), (2, 1998, 4, 1950, 1, 5.0, None, None, None, 1), (2, 2000, 5, 1950, 1, None, None, 20, 2003, 0)]
    df = spark.createDataFrame(rows, RAW)
    got = {(r.simple_id, r.ja): r for r in panel.build(df).collect()}
    assert set(got) == {(2, 1998), (2, 2000)} and got[2, 1998].ord == 4 and got[2, 2000].first_exposure_year == 1998
    with pytest.raises(ValueError, match="exposed"):
        panel.build(df.drop("exposed"))
    assert panel.build(df.filter("false")).collect() == []
    values = {r.metric: r.value for r in panel.diagnostics(df).collect()}
    assert values == {"duplicate_keys": 1, "excess_rows": 1, "persons": 2, "conflicted_persons": 1, "exposed_share_excluded": 1, "exposed_share_retained": 1}
    assert {r.metric: r.value for r in panel.diagnostics(df.filter("false")).collect()}["persons"] == 0
    keys = spark.createDataFrame([(2, 1998), (9, 1998)], "simple_id long, ja int")
    assert sorted((r.simple_id, r.n_rows, r.disagree) for r in panel.recover_codes(df, keys).collect()) == [(2, 2, False), (9, 0, False)]


def test_nearest_quantiles(spark):
    df = spark.createDataFrame([(g, v) for g, n in (("a", 11), ("b", 1)) for v in range(n)] + [("c", None), (None, 3)], "g string, v long")
    got = {r.g: (r.lo, r.hi) for r in exprs.nearest_quantiles(df, ["g"], "v", {"lo": 0.1, "hi": 0.94}).collect()}
    assert got == {"a": (1, 9), "b": (0, 0), None: (3, 3)}


def test_merge(spark):
    a, c = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(ValueError, match="left"):
        checks.merge(a, c, ["k"], validate="1:1")
    assert sorted((r.k, r.w) for r in checks.merge(a, c, ["k"], "full", "m:1", "w").collect()) == [(1, "left_only"), (2, "both"), (2, "both"), (3, "right_only")]


FOLLOW = "match_group long, treated int, t0 int, simple_id long, follow_year int, ja int, observed int, event_type int"


def test_violations_are_found(spark):
    good = spark.createDataFrame([(1, 1998, 10, 20)], "match_group long, t0 int, t_id long, c_id long")
    rows = [(1, 1, 1998, 10, 1, 1999, 1, 0), (1, 1, 1998, 10, 2, 2000, 1, 1), (1, 0, 1998, 20, 1, 1999, 0, 0)]
    found = lambda rows, p=good: {r.rule: r.violations for r in checks.followup(spark.createDataFrame(rows, FOLLOW), p, 3, 1998, 1999, 2002).collect() if r.violations}
    assert found(rows) == {}
    assert found(rows[:2]) == {"without_followup": 1}
    assert found([*rows, rows[0]]) == {"repeated_arm_year": 1}
    assert found([*rows, (1, 1, 1998, 10, 3, 2001, 1, 0)]) == {"years_after_event": 1}
    assert found([*rows[:2], (1, 0, 1998, 21, 1, 1999, 0, 0)]) == {"other_person": 1}
    assert found([*rows, (1, 0, 1998, 20, 2, 1999, 1, 7)]) == {"unknown_value": 1, "year_index": 1}
    assert found([*rows, (1, 0, 1998, 20, 2, 2000, 1, None)]) == {"null_cell": 1}
    assert found([], good.filter("false")) == {}
    scored = spark.createDataFrame([(10, 1998, 1, 1, 0, 500), (20, 1998, 0, 2, 0, 90_500)], "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long")
    wrong = {r.rule: r.violations for r in checks.matching(good.unionByName(good.withColumn("t_id", F.lit(11))), scored, pairs.STRATA, 10_000).collect() if r.violations}
    assert wrong == {"control_twice": 1, "no_candidate": 1, "strata_differ": 2, "over_caliper": 1}


def test_release(spark):
    years = spark.createDataFrame([(1998, 50, 900, 0, 45, 5, 0.9), (1999, 500, 900, 0, 300, 200, 0.6)], "t0 int, n_treated long, n_controls long, n_without_exact long, n_matched long, n_unmatched_after long, match_rate double")
    got = {r.t0: r for r in release.release_by_year(years, 20).collect()}
    assert (got[1998].n_treated, got[1998].match_rate, got[1998].n_unmatched_after) == (None, None, None) and "total and rate" in got[1998].note
    assert (got[1999].n_treated, got[1999].n_matched, got[1999].n_without_exact, got[1999].note) == (500, 300, None, "n_without_exact withheld")
    cells = spark.createDataFrame([("1", 30, 40, 25, 10)], "sex string, people_controls long, people_treated long, events_controls long, events_treated long")
    assert release.six_cells(cells, ["sex"], 20).first().status == "withheld_small_cell" and release.six_cells(cells, ["sex"], 5).first().people_treated == 40
    zero = release.counts_by_arm(spark.createDataFrame([], "code string, treated int"), spark.createDataFrame([("10",), (None,)], "code string"), "code").collect()
    assert sorted((r.treated_n, r.treated_pct) for r in zero) == [(0, 0.0), (0, 0.0)]
    levels = [("own", "1", "a", 60), ("own", "1", "b", 70), ("own", "1", "c", 5), ("all", "1", "all", 135)]
    names = [f"{a}_{n}" for a in ("control", "treated") for n in ("assigned", "entered", "events", "deaths", "without")]
    groups = spark.createDataFrame([(s, p, v, *[n, n, 0, 0, n] * 2) for s, p, v, n in levels], "scheme string, part string, level string, " + ", ".join(f"{n} long" for n in names))
    assert {r.level: r.disclosure for r in release.protect_groups(groups, "all", 20).collect()} == {"a": "withheld", "b": "reported", "c": "withheld", "all": "reported"}
    balance = spark.createDataFrame([("post", "a", 0.05), ("post", "a__missing", -0.3), ("post", "b", 0.2), ("pre", "c", 0.9), ("post", "d", None)], "sample string, variable string, smd double")
    assert [tuple(r) for r in release.imbalanced(balance, ["a", "c", "d"]).collect()] == [("a", "a__missing", 0.3)]


def test_covariates():
    columns = ["lag1_ge_cat", "lag1_age", "lag1_entgelt_value", "lag2_rtzb_value"]
    assert covariates.resolve(CohortConfig(), columns) == {"numeric": ["lag1_age", "lag1_entgelt_value"], "binary": [], "categorical": [], "exact": ["lag1_ge_cat"]}
    assert covariates.resolve(CohortConfig(lag_depth=3, source_has_entgelt=False), columns)["numeric"] == ["lag1_age", "lag2_rtzb_value"]
    for some in (["lag1_age"], ["lag1_ge_cat"]):
        with pytest.raises(KeyError):
            covariates.resolve(CohortConfig(), some)
    assert [covariates.role(CohortConfig(), c) for c in ("lag1_age", "lag2_fmsd_cat", "lag1_x_missing", "lag2_rtzb_value")] == ["numeric", "categorical", "categorical", "numeric"]
    others = ("lag2_rehab_starts_this_year", "unlisted", "lag2_ever_rehab_to_date", "lag3_byvlgs_missing", "lag1_byvlgs_missing", "lag4_rtzb_value")
    assert [covariates.role(CohortConfig(), c) for c in others] == ["categorical", "categorical", "categorical", "binary", "binary", "categorical"]
    assert covariates.by_role(CohortConfig(), ["lag2_ge", "lag1_age", "lag3_cum_rehabs_by_year"]) == {"numeric": ["lag1_age", "lag3_cum_rehabs_by_year"], "binary": [], "categorical": ["lag2_ge"]}


def test_files(spark, tmp_path):
    box = files.Checkpoint(spark, f"{tmp_path}/c", files.fingerprint({"b": 1, "a": [2]}))
    assert box.done() == [] and box.rows() is None and files.fingerprint({"a": [2], "b": 1}) == files.fingerprint({"b": 1, "a": [2]})
    for r in (3, 1):
        box.add(r, spark.createDataFrame([(0.5,)], "v double"))
    (tmp_path / "c" / files.fingerprint({"b": 1, "a": [2]}) / "replicate=9").mkdir()  # one that was cut off
    assert box.done() == [1, 3] and sorted(r.replicate for r in box.rows().collect()) == [1, 3]
    with pytest.raises(RuntimeError):
        box.require(40)
    df = spark.createDataFrame([(1, None, "x,y"), (2, 0.5, None)], "a int, b double, c string")
    files.append_rows([df, df.filter("a = 1")], f"{tmp_path}/csv")
    assert sorted(r.a for r in files.read_csv(spark, f"{tmp_path}/csv", df.schema).collect()) == [1, 1, 2]
    import pandas as pd

    pd.DataFrame({"aa": [1.0]}).to_stata(f"{tmp_path}/s.dta", variable_labels={"aa": "month of decision"}, write_index=False)
    labels = files.stata_labels(f"{tmp_path}/s.dta")
    assert labels == {"aa": "month of decision"}
    assert [tuple(r) for r in files.inventory(spark, {"s": spark.createDataFrame([(1, 2)], "aa int, q int")}, "decision", {"s": labels}).collect()] == [("s", "aa", "month of decision")]
    df.write.parquet(f"{tmp_path}/p")
    assert files.read_optional(spark, None, ["a"]) is None and files.read_optional(spark, f"{tmp_path}/p", ["a"], ["a"], {"c": ["x,y"]}).count() == 2
    for args in ((["c"],), (["a"], ["b"]), (["a"], [], {"a": [1]}), (["z"],)):
        with pytest.raises(ValueError):
            files.read_optional(spark, f"{tmp_path}/p", *args)


def test_columns_of_sources(spark):
    df = align.optional_nulls(spark.createDataFrame([(1,)], "a int"), ["a", "entgelt", "ge", "day", "text", "u", "m1_iufzt"], ("day",), {"m1_iufzt": spark.createDataFrame([], "u long").schema["u"].dataType, "u": spark.createDataFrame([], "u long").schema["u"].dataType})
    assert dict(df.dtypes) == {"a": "int", "entgelt": "double", "ge": "int", "day": "date", "text": "string", "u": "bigint", "m1_iufzt": "string"}
    assert align.present(df, ["ge", "no", "a", "ge"]).columns == ["ge", "a"] and align.first_present(["x"], ["y"]) is None


def test_study_of_an_empty_panel(spark):
    empty = panel.build(spark.createDataFrame([], RAW))
    found = chain.study(spark, empty, models.save)
    assert found.pairs.count() == 0 and found.follow.count() == 0 and all(r.value == 0 for r in chain.checks_of(found, 1998, 1999).collect())


def test_weighted_incidence_of_equal_weights(spark):
    rows = [(i, i % 2, 1998, i, y, 1998 + y, 1, int(i % 5 == y)) for i in range(40) for y in (1, 2) if not (y == 2 and i % 5 == 1)]
    f = spark.createDataFrame(rows, FOLLOW).withColumn("w", F.lit(2))
    a, c = ([(r.treated, r.follow_year, round(r.cif, 12)) for r in followup.incidence(f, w).orderBy("treated", "follow_year").collect()] for w in (None, "w"))
    assert a == c


def test_features_of_what_a_source_has(spark):
    columns = RAW + ", byvlgs double, whot_bland int, ttsc1_kldb1988 int, fmsd int, divorcing int, is_first_marriage int"
    rows = [(1, 1997, 1, 1950, 1, 1.0, None, 30, None, 0, None, 5, 781, 2, 0, 1), (1, 1998, 2, 1950, 1, None, 3.0, 20, None, 0, 7.0, None, None, None, 1, 1), (1, 1999, 3, 1950, 1, 1.0, None, None, None, 1, 7.0, 5, 11, 1, 1, 0)]
    built = panel.described(panel.build(spark.createDataFrame(rows, columns)), [30], "is_first_marriage")
    got = {r.ja: r for r in built.collect()}
    assert [(got[y].byvlgs_value, got[y].byvlgs_missing, got[y].whot_bland_cat, got[y].occ_l1_cat, got[y].fmsd_cat) for y in (1997, 1998)] == [(0.0, 1, "5", "7", "divorced"), (7.0, 0, "__MISSING__", "__MISSING__", "missing")]
    assert [got[y].cum_mental_health_rehabs_by_year for y in (1997, 1998, 1999)] == [1, 1, 1] and [got[y].first_marriage_ends for y in (1997, 1998, 1999)] == [False, True, False]
    assert "bygmgs_value" not in built.columns and "first_marriage_ends" not in panel.described(panel.build(spark.createDataFrame(rows, columns)), [30], "date_fields").columns
    again = panel.relabel(built, [30], [20])
    assert {r.ja: (r.msk, r.mental, r.cum_mental_health_rehabs_by_year) for r in again.collect()} == {1997: (1, 0, 0), 1998: (0, 1, 1), 1999: (0, 0, 1)}
    lagged = {r.t0: r for r in panel.lag(built, 2).collect()}
    assert lagged[1999].lag2_occ_l1_cat == "7" and lagged[2001].lag2_fmsd_cat == "married"


def test_first_marriage_is_a_rule_of_the_risk_set(spark):
    """Two exposed people, of whom one ends a second marriage; a control needs no marriage."""
    person = lambda p, first, exposed: [(p, y, 10 * p + y, 1950, 1, 1.0, None, None, None, int(exposed and y == 1998), int(y == 1998), first) for y in (1996, 1997, 1998)]
    rows = person(1, 1, True) + person(2, 0, True) + person(3, 0, False)
    df = spark.createDataFrame(rows, RAW + ", divorcing int, is_first_marriage int")
    built = panel.build(df)
    plain, ruled = built, panel.described(built, [30], "is_first_marriage")
    found = lambda p: sorted((r.simple_id, r.treated) for r in panel.risk_set(p, 1998, 1998).collect())
    assert found(plain) == [(1, 1), (2, 1), (3, 0)] and found(ruled) == [(1, 1), (3, 0)]
    stages = {(r.treated, r.stage): r.n_rows for r in panel.attrition(ruled).collect()}
    assert stages[1, "exposure_rule"] == 2 and stages[1, "first_marriage"] == 1 and stages[0, "first_marriage"] == 1 and "first_marriage" not in panel.stages(plain)
    deep = panel.risk_set(ruled, 1998, 1998, 2)
    assert {"lag1_ge_cat", "lag2_entgelt_value", "lag2_income_source_status"} <= set(deep.columns) and deep.filter("treated = 1").first().lag2_entgelt_value == 1.0


def test_levels_are_pooled_in_both_groups_at_once(spark):
    spec = {"a": (30, 40), "b": (20, 2), "c": (9, 30), "d": (1, 9)}
    counts = lambda spec: spark.createDataFrame([("v", k, *n) for k, n in spec.items()], "variable string, level string, n1 long, n0 long")
    found = lambda spec, least: {r.level: (r.n1, r.n0, r.pooled) for r in release.pool_jointly(counts(spec), least).collect()}
    pool = release.POOLED_LEVELS
    assert found(spec, 5) == {"a": (30, 40, None), "c": (9, 30, None), pool: (21, 11, 2)}
    # one small level takes the smallest other with it
    assert found({k: spec[k] for k in "acd"}, 5) == {"a": (30, 40, None), pool: (10, 39, 2)}
    assert found({k: spec[k] for k in "ac"}, 5) == {"a": (30, 40, None), "c": (9, 30, None)} and found({"d": (1, 9)}, 5) == {pool: (1, 9, 1)}
    rows = [(1, 1.0, 1, "a")] * 6 + [(0, None, 0, "a")] * 6 + [(0, 2.0, 1, "b")] * 2
    df = spark.createDataFrame(rows, "matched int, n double, b int, c string")
    told = {(r.variable, r.level): r for r in release.release_groups(df, ["n"], ["b"], ["c"], 3).collect()}
    assert all(r.matched_value is None and r.matched_rest is None and r.note for r in told.values() if r.level != pool)
    assert told["c", pool].pooled == 2 and (told["c", pool].matched_count, told["c", pool].unmatched_count) == (6, 8)
    alone = release.release_groups(df.filter("matched = 1"), ["n"], [], ["c"], 3).collect()
    assert {r.note for r in alone} == {"no unmatched rows"} and all(r.matched_value is None for r in alone)


def test_gap_sensitivity(spark):
    """A group of a two-by-two table, one without events, one that is separated, and one that gaps leave without an arm's rows."""
    rows = [(i, a, 1, 1, int(i < (30 if a else 10)), "a") for i in range(100) for a in (0, 1)]
    rows += [(200 + i, a, 1, 1, 0, "b") for i in range(10) for a in (0, 1)] + [(300 + i, a, 1, 1, a, "c") for i in range(10) for a in (0, 1)]
    rows += [(400 + i, a, 1, int(not (a and i < 20)), int((i + a) % 3 == 0), None) for i in range(40) for a in (0, 1)]
    df = spark.createDataFrame(rows, "match_group long, treated int, follow_year int, observed int, event_type int, sex string")
    got = {(r.sex, r.rule): r for r in models.gap_sensitivity(df, "sex").collect()}
    assert len(got) == 8 and abs(got["a", "ordinary"].odds_ratio - (30 / 70) / (10 / 90)) < 1e-5 and got["a", "ordinary"].gaps == 0
    assert {got["b", r].status for r in models.RULES} == {"no events"} and {got["c", r].status for r in models.RULES} == {"no finite maximum"}
    assert got["c", "ordinary"].odds_ratio is None and (got[None, "ordinary"].pairs, got[None, "pair_censored"].pairs, got[None, "ordinary"].gaps) == (40, 20, 20)
    assert got[None, "pair_censored"].status == "estimated" and got["a", "pair_censored"].se == got["a", "ordinary"].se
    with pytest.raises(ValueError):
        models.gap_sensitivity(df.withColumn("sex", F.col("match_group").cast("string")), "sex")


def test_effects_of_withheld_groups_are_not_told(spark):
    rng = random.Random(3)
    rows = [(i, a, 1, int(rng.random() < (0.2 + 0.4 * a * (i % 3 == 0)))) for i in range(300) for a in (0, 1)]
    follow = spark.createDataFrame(rows, "match_group long, treated int, follow_year int, event_type int")
    members = spark.createDataFrame([(i, a, "f" if i % 2 else "m", "abc"[i % 3] if i < 297 else "few") for i in range(300) for a in (0, 1)], "match_group long, treated int, sex string, kind string")
    schemes = {"all": (F.col("sex"), F.lit("all")), "kind": (F.col("sex"), F.col("kind"))}
    draws = release.group_draws(follow, members, schemes, 60)
    protected = release.protect_groups(release.group_cells(follow, members, schemes), "all", 5)
    effects = {(r.part, r.level): r for r in release.group_effects(draws, 60).collect()}
    told = {(r.part, r.level): r for r in release.protect_effects(release.group_effects(draws, 60), protected).collect()}
    gone = {k for k, r in told.items() if r.disclosure == "withheld"}
    assert {("f", "few"), ("m", "few")} <= gone and len(gone) > 2 and all(told[k].risk_difference is None for k in gone)
    assert all(told[k].risk_difference == effects[k].risk_difference for k in told if k not in gone)
    for r in effects.values():
        assert r.risk_difference_low is None or r.risk_difference_low <= r.risk_difference <= r.risk_difference_high
    left = next(k for k in told if k not in gone and k[1] != "all")
    asked = [("sexes", ("all", "f", "all"), ("all", "m", "all")), ("kinds", ("kind", *left), ("all", left[0], "all")), ("gone", ("kind", "f", "few"), ("all", "f", "all"))]
    got = {r.test: r for r in release.contrast_rows(draws, protected, asked, 60).collect()}
    assert got["gone"].disclosure == "withheld" and got["gone"].difference is None and got["gone"].p_holm is None
    assert abs(got["sexes"].difference - (effects["f", "all"].risk_difference - effects["m", "all"].risk_difference)) < 1e-12
    assert got["sexes"].p_holm >= got["sexes"].p and max(got[k].p_holm / got[k].p for k in ("sexes", "kinds")) <= 2 + 1e-9


def test_suppression_of_one_whole_table_and_of_null_groups(spark):
    rows = [(None, "a", 9), (None, "b", 2), (None, "c", 0), ("g", "a", 7), ("g", "b", 8)]
    df = spark.createDataFrame(rows, "grp string, cell string, n long")
    got = {(r.grp, r.cell): (r.n, r.status) for r in disclosure.protect(df, ["grp"], "cell", "n", 5).collect()}
    assert got == {(None, "a"): (None, "complement"), (None, "b"): (None, "withheld"), (None, "c"): (0, "reported"), ("g", "a"): (7, "reported"), ("g", "b"): (8, "reported")}
    whole = {(r.grp, r.cell): r.status for r in disclosure.protect(df, [], "cell", "n", 5).collect()}
    assert [k for k, s in whole.items() if s != "reported"] and whole["g", "a"] == "complement" and whole[None, "b"] == "withheld"
