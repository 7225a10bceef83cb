"""All queries of the cohort operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import CohortConfig
from tessera.functions import exprs as x
from tessera.functions import features
from tessera.operators import covariates, design, disclosure, followup, gcomp, models, pairs, panel
from tessera.sources.bindings import person_years, table

CODES = [20, 30]
#: The tables hold seven years, so the queries look less far than the operators do by default.
HORIZON, WINDOW = 3, (-2, 2)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_STAGES: dict[tuple, DataFrame] = {}


def _stage(s, d, name, build):
    """The table of a stage that many queries share, written once a session and state of the input."""
    at = s._jvm.org.apache.hadoop.fs.Path(f"{d}/orders.parquet")
    fs = at.getFileSystem(s._jsc.hadoopConfiguration())
    # of a folder, all its files: its own time and length can stay while they change
    files = sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(at))
    key = (s.sparkContext.applicationId, d, tuple(files), name)
    if key not in _STAGES:
        _STAGES[key] = models.save(build())
    return _STAGES[key]


def _panel(s, d):
    return _stage(s, d, "panel", lambda: panel.build(person_years(s, d)))


def _risk(s, d):
    return _stage(s, d, "risk", lambda: panel.risk_set(_panel(s, d)))


def _pairs(s, d):
    return _stage(s, d, "pairs", lambda: pairs.rank_pairs(_risk(s, d)))


def _follow(s, d):
    return _stage(s, d, "follow", lambda: followup.grid(pairs.assignment(_pairs(s, d)), _panel(s, d), HORIZON))


#: Added before rounding, in both languages: a mean that is a tie in exact arithmetic would else round by the order of its sum.
NUDGE = 1.7e-8


def _r(c, n=6):
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), n)


@query
def dedup_least_missing(s, d):
    return panel.dedup(person_years(s, d), ["simple_id", "ja"], ["ord"]).select("simple_id", "ja", "ord", "entgelt", "rtzb", "code", "death_year")


@query
def dedup_lineitem(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("qty"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("tax"), F.col("l_extendedprice"))
    return panel.dedup(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query
def duplicate_key_audit(s, d):
    return panel.duplicate_keys(person_years(s, d), ["simple_id", "ja"])


@query
def death_conflict_audit(s, d):
    raw = person_years(s, d).withColumn("death_year", F.when(F.col("ord") % 5 == 0, F.col("ja")).otherwise(F.col("death_year")))
    return panel.death_conflicts(raw)


@query
def exclusion_balance(s, d):
    raw = person_years(s, d).withColumn("death_year", F.when(F.col("ord") % 50 == 0, F.col("ja")).otherwise(F.col("death_year")))
    out = panel.death_conflicts(raw).select("simple_id", F.lit(1).alias("excluded"))
    person = raw.groupBy("simple_id").agg(F.max(F.when(F.col("code").isNotNull(), 1).otherwise(0)).alias("flag"))
    return person.join(out, "simple_id", "left").groupBy(F.coalesce("excluded", F.lit(0)).alias("excluded")).agg(F.count("*").alias("n"), _r(F.avg("flag")).alias("share"))


@query
def age_band(s, d):
    return _panel(s, d).groupBy(x.age_band(F.col("ja") - F.col("gbja")).alias("band"), "ge").agg(F.count("*").alias("n"), F.countDistinct("simple_id").alias("persons"))


@query
def occupation_major_group(s, d):
    return table(s, d, "part").select(x.major_group(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 1200)).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query
def date_normalize(s, d):
    o, key = table(s, d, "orders"), F.col("o_orderkey") % 6
    text = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(key == 2, F.date_format("o_orderdate", "yyyyMMdd")).when(key == 3, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).when(key == 4, F.lit("00000000")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", x.normal_date(text).alias("day"))


@query
def income_source_status(s, d):
    return _panel(s, d).groupBy(x.income_status(F.col("entgelt"), F.col("rtzb")).alias("status")).agg(F.count("*").alias("n"), _r(F.coalesce(F.sum("entgelt"), F.lit(0.0)), 2).alias("earnings"))


@query
def history_windows(s, d):
    return _panel(s, d).select("simple_id", "ja", "first_exposure_year", "cum_rehab", "cum_msk", "years_since_rehab")


@query
def relabel_codes(s, d):
    return panel.relabel(_panel(s, d), CODES).select("simple_id", "ja", "msk", "cum_msk")


@query
def relabel_audit(s, d):
    p = _panel(s, d)
    count = lambda f, n: f.groupBy("ja").agg(F.sum("msk").alias(n), F.count("*").alias("n_rows"))
    return count(p, "before").join(count(panel.relabel(p, CODES), "after").drop("n_rows"), "ja", "left").withColumn("share", _r(F.expr("try_divide(after - before, n_rows)")))


@query
def panel_coverage(s, d):
    per = _panel(s, d).groupBy("simple_id").agg(F.min("ja").alias("lo"), F.max("ja").alias("hi"), F.count("*").alias("n"), F.max("death_year").alias("dy"))
    return per.select((F.col("hi") - F.col("lo") + 1).alias("span"), (F.col("hi") - F.col("lo") + 1 - F.col("n")).alias("gaps"), (F.col("dy") < F.col("hi")).alias("after")).groupBy("span", "gaps").agg(F.count("*").alias("persons"), F.count_if("after").alias("rows_after_death"))


@query
def annual_counts_full_join(s, d):
    p = _panel(s, d)
    rows = p.groupBy("ja").agg(F.count("*").alias("n"), F.sum("rehab").alias("rehabs"))
    deaths = p.select("simple_id", "death_year").distinct().filter("death_year is not null").groupBy(F.col("death_year").alias("ja")).agg(F.countDistinct("simple_id").alias("deaths"))
    return rows.join(deaths, "ja", "full").select("ja", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rehabs", F.lit(0)).alias("rehabs"), F.coalesce("deaths", F.lit(0)).alias("deaths"))


@query
def lag_self_join(s, d):
    p = _panel(s, d)
    return p.select("simple_id", F.col("ja").alias("t0")).join(panel.lag(p, 1).select("simple_id", "t0", "lag1_source_year", "lag1_cum_rehab"), ["simple_id", "t0"], "left").join(panel.lag(p, 3).select("simple_id", "t0", "lag3_source_year", "lag3_rehab"), ["simple_id", "t0"], "left")


@query
def riskset_attrition(s, d):
    return panel.attrition(_panel(s, d))


@query
def riskset_treated(s, d):
    return _risk(s, d).filter("treated = 1").select("simple_id", "t0", "lag1_ge", "lag1_age", "lag1_ever_rehab", "lag1_source_year")


@query
def riskset_controls(s, d):
    return _risk(s, d).filter("treated = 0").select("simple_id", "t0", "lag1_ge", "lag1_age", "lag1_ever_rehab", "lag1_source_year")


@query
def cohort_spine(s, d):
    years = s.range(1996, 2002).select(F.col("id").cast("int").alias("t0"))
    risk = _risk(s, d).groupBy("t0").agg(F.sum("treated").alias("treated"), F.sum(1 - F.col("treated")).alias("controls"))
    got = _pairs(s, d).groupBy("t0").agg(F.count("*").alias("pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return years.join(risk, "t0", "left").join(got, "t0", "left").select("t0", zero("treated"), zero("controls"), zero("pairs"), _r(F.expr("try_divide(pairs, treated)")).alias("match_rate"))


@query
def matched_semi(s, d):
    return _risk(s, d).filter("treated = 1").select("simple_id", "t0").join(_pairs(s, d).select(F.col("t_id").alias("simple_id"), "t0"), ["simple_id", "t0"], "left_semi")


@query
def unmatched_anti(s, d):
    return _risk(s, d).filter("treated = 0").select("simple_id", "t0").join(_pairs(s, d).select(F.col("c_id").alias("simple_id"), "t0"), ["simple_id", "t0"], "left_anti")


def _samples(s, d):
    """Risk set and pairs under each other, weight 1 each."""
    risk = _risk(s, d)
    keep = ["simple_id", "t0", "treated", "lag1_ge", "lag1_ever_rehab", *pairs.NUMBERS]
    post = pairs.assignment(_pairs(s, d)).select("simple_id", "t0", "treated").join(risk.select(*keep), ["simple_id", "t0", "treated"])
    return risk.select(F.lit("pre").alias("sample"), *keep).unionByName(post.select(F.lit("post").alias("sample"), *keep)).withColumn("w", F.lit(1.0))


def _long(frame):
    return frame.select("sample", "treated", "w", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in pairs.NUMBERS))).alias("v")).select("sample", "treated", "w", "v.*")


def _arms(frame, key):
    """Both arms of an aggregate side by side, where both are there: one pass, no join."""
    arm = lambda v, p: [F.max(F.when(F.col("treated") == v, F.col(c))).alias(f"{n}{p}") for c, n in (("mean", "m"), ("var", "v"), ("missing", "q"))]
    return frame.groupBy(*key).agg(*arm(1, "t"), *arm(0, "c"), F.countDistinct("treated").alias("arms")).filter("arms = 2").drop("arms")


@query
def weighted_smd_continuous(s, d):
    a = _arms(pairs.weighted(_long(_samples(s, d)), ["sample", "treated", "variable"], "value"), ["sample", "variable"])
    return a.select("sample", "variable", _r("mt", 4).alias("treated_value"), _r("mc", 4).alias("control_value"), _r(x.smd(F.col("mt"), F.col("vt"), F.col("mc"), F.col("vc")), 5).alias("smd"))


@query
def weighted_smd_missingness(s, d):
    a = _arms(pairs.weighted(_long(_samples(s, d)), ["sample", "treated", "variable"], "value"), ["sample", "variable"])
    return a.select("sample", "variable", _r("qt").alias("treated_missing"), _r("qc").alias("control_missing"), _r(x.smd(F.col("qt"), F.col("qt") * (1 - F.col("qt")), F.col("qc"), F.col("qc") * (1 - F.col("qc"))), 5).alias("smd"))


def _levels(s, d):
    f = _samples(s, d).withColumn("level", x.age_band(F.col("lag1_age")))
    n = f.groupBy("sample", "level").pivot("treated", [1, 0]).agg(F.sum("w")).na.fill(0)
    w = Window.partitionBy("sample")
    p = n.withColumns({"pt": F.col("1") / F.sum("1").over(w), "pc": F.col("0") / F.sum("0").over(w)})
    return p.select("sample", "level", "pt", "pc", x.smd(F.col("pt"), F.col("pt") * (1 - F.col("pt")), F.col("pc"), F.col("pc") * (1 - F.col("pc"))).alias("smd"))


@query
def weighted_smd_levels(s, d):
    return _levels(s, d).select("sample", "level", _r("pt").alias("treated_value"), _r("pc").alias("control_value"), _r("smd", 5).alias("smd"))


@query
def balance_summary(s, d):
    return _levels(s, d).groupBy("sample").agg(F.count("*").alias("n_levels"), _r(F.max(F.abs("smd")), 5).alias("max_smd"), _r(F.avg(F.abs("smd")), 5).alias("mean_smd"), F.count_if(F.abs("smd") > 0.1).alias("n_over"))


@query
def descriptives(s, d):
    return _long(_samples(s, d)).groupBy("sample", "treated", "variable").agg(F.count("value").alias("n"), _r(F.avg("value"), 4).alias("mean"), _r(F.percentile("value", 0.5), 4).alias("median"), _r(F.stddev_samp("value"), 4).alias("sd"), _r(F.min("value"), 4).alias("lo"), _r(F.max("value"), 4).alias("hi"))


@query
def score_fixed_formula(s, d):
    return pairs.score(_risk(s, d)).select("simple_id", "t0", "treated", "score_ppm")


@query
def score_distribution(s, d):
    scored, key = pairs.score(_risk(s, d)), ["t0", "treated"]
    # scores are at most a million distinct numbers, so the median's counts are bounded too
    stats = scored.groupBy(*key).agg(F.count("*").alias("n"), F.min("score_ppm").alias("lo"), F.max("score_ppm").alias("hi"), _r(F.avg("score_ppm"), 3).alias("mean"), _r(F.percentile("score_ppm", 0.5), 1).alias("median"))
    return stats.join(x.nearest_quantiles(scored, key, "score_ppm", {"q90": 0.9}), key)


@query
def score_overlap(s, d):
    sc = pairs.score(_risk(s, d))
    arms = sc.groupBy("t0").agg(*(f(F.when(F.col("treated") == a, F.col("score_ppm"))).alias(n) for n, f, a in (("tlo", F.min, 1), ("thi", F.max, 1), ("clo", F.min, 0), ("chi", F.max, 0))))
    b = arms.select("t0", F.greatest("tlo", "clo").alias("low"), F.least("thi", "chi").alias("high"))
    return sc.join(b, "t0").groupBy("t0", "low", "high").agg(*(F.count_if((F.col("treated") == a) & ~F.col("score_ppm").between(F.col("low"), F.col("high"))).alias(n) for n, a in (("treated_outside", 1), ("controls_outside", 0))))


@query
def caliper_edges(s, d):
    return pairs.caliper_edges(pairs.score(_risk(s, d)))


@query
def caliper_edge_list(s, d):
    """Every edge within half of the usual caliper."""
    return pairs.edges(pairs.score(_risk(s, d)), 5_000)


def _state(c="ja"):
    return (1 + (F.col("simple_id") + F.col(c)) % 3).cast("int")


@query
def marital_composition(s, d):
    p = _panel(s, d).select("simple_id", "ja", _state().alias("state"))
    members = pairs.assignment(_pairs(s, d))
    rows = members.select("treated", "simple_id", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), (F.col("t0") + k).alias("ja")) for k in (-1, 0, 1)))).alias("e")).select("treated", "simple_id", "e.*")
    n = rows.join(p, ["simple_id", "ja"], "left").groupBy("treated", "step", F.coalesce(F.col("state").cast("string"), F.lit(x.MISSING)).alias("state")).agg(F.count("*").alias("n"))
    return n.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("treated", "step"))))


@query
def state_sequences(s, d):
    p = _panel(s, d).select("simple_id", "ja", _state().cast("string").alias("state"))
    rows = pairs.assignment(_pairs(s, d))
    for k, name in ((-1, "a"), (0, "b"), (1, "c")):
        rows = rows.join(p.select("simple_id", (F.col("ja") - k).alias("t0"), F.col("state").alias(name)), ["simple_id", "t0"], "left")
    miss = lambda c: F.coalesce(c, F.lit("x"))
    n = rows.groupBy("treated", F.concat_ws(">", miss("a"), miss("b"), miss("c")).alias("path")).agg(F.count("*").alias("n"))
    return n.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("treated"))))


@query
def role_overlap(s, d):
    per = pairs.assignment(_pairs(s, d)).groupBy("simple_id").agg(F.count_if(F.col("treated") == 1).alias("as_treated"), F.count_if(F.col("treated") == 0).alias("as_control"), F.min(F.when(F.col("treated") == 1, F.col("t0"))).alias("ft"), F.min(F.when(F.col("treated") == 0, F.col("t0"))).alias("fc"))
    return per.groupBy("as_treated", "as_control").agg(F.count("*").alias("persons"), F.count_if(F.col("fc") < F.col("ft")).alias("control_first"))


@query
def followup_grid(s, d):
    return _follow(s, d)


@query
def pair_censor(s, d):
    return followup.pair_censor(_follow(s, d)).groupBy("treated", "follow_year").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("events"))


def _mortality(s, d):
    return followup.mortality_grid(pairs.assignment(_pairs(s, d)), _panel(s, d))


@query
def mortality_grid(s, d):
    return _mortality(s, d)


@query
def cumulative_incidence(s, d):
    return followup.incidence(_follow(s, d)).select("treated", "follow_year", "n", "d1", "d2", _r("cif").alias("cif"))


@query
def kaplan_meier(s, d):
    return followup.kaplan_meier(_mortality(s, d)).select("treated", "follow_year", "n", "d", _r("risk").alias("risk"))


def _events(s, d):
    return followup.event_panel(_pairs(s, d), _panel(s, d), *WINDOW)


@query
def event_study_panel(s, d):
    return _events(s, d)


@query
def event_study_estimates(s, d):
    return followup.event_study(_events(s, d)).select("event_time", "n", _r("estimate").alias("estimate"))


@query
def event_study_cluster_se(s, d):
    return followup.event_study(_events(s, d)).select("event_time", _r("se").alias("se"))


@query
def ipcw_cumprod(s, d):
    rows = _follow(s, d).withColumn("p", 0.01 + ((F.col("simple_id") + F.col("follow_year")) % 10) / 10.0)
    return followup.ipcw(rows).select("match_group", "treated", "follow_year", _r("weight", 5).alias("weight"))


@query
def mediation_grid(s, d):
    return followup.mediation_grid(_risk(s, d), _panel(s, d), HORIZON)


@query
def event_cells(s, d):
    return followup.mediation_grid(_risk(s, d), _panel(s, d), HORIZON).groupBy("treated", "follow_year", "mediator_now").agg(F.count("*").alias("n"), F.count_if(F.col("gap_year") <= F.col("follow_year")).alias("gaps"), F.sum("mediator_new").alias("new_events"))


@query
def pool_small_cells(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("simple_id"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % F.lit(37) * (F.col("c_custkey") % F.lit(11)) % F.lit(41)).cast("string").alias("code"))
    return disclosure.pool_small(c, ["seg"], "code", 3)


@query
def complementary_suppression(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("cell")).agg(F.count_if(F.col("c_acctbal") > 7000).alias("value"))
    return disclosure.protect(c, ["grp"], "cell", "value", 3)


@query
def holm_adjust(s, d):
    t = table(s, d, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), (((F.col("n_nationkey") * 7919) % 101) / 1000.0).alias("p"))
    return followup.holm(t, ["family"]).select("family", "test", _r("p").alias("p"), _r("p_holm").alias("p_holm"))


@query
def cluster_row_constancy(s, d):
    p = _panel(s, d)
    return p.groupBy("simple_id").agg(F.countDistinct(F.xxhash64("ge", "gbja")).alias("n")).groupBy("n").agg(F.count("*").alias("persons"))


def _spells(s, d):
    """Two spell slots and two application dates of each order, by its dates and key."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(s, d, "orders").select(
        "o_orderkey",
        day.alias("day"),
        F.year(day).alias("ja"),
        *(F.when(k % m != 0, F.date_add(day, (k % a).cast("int"))).alias(f"s{i}") for i, m, a in ((1, 3, 40), (2, 5, 300))),
        *(F.when(k % m != 0, F.date_add(day, (k % a).cast("int"))).alias(f"e{i}") for i, m, a in ((1, 4, 90), (2, 5, 350))),
        F.concat((k % 4 * 10).cast("string"), F.lit(".0")).alias("c1"),
        (k % 3 * 10).alias("c2"),
    )


@query
def spell_slots(s, d):
    f = _spells(s, d)
    y = F.col("ja")
    out = features.slots(y, [(F.col("s1"), F.col("e1"), F.col("c1")), (F.col("s2"), F.col("e2"), F.col("c2"))], CODES)
    return f.select("o_orderkey", *(c.alias(n) for n, c in out.items()), features.dated_in_year(y, F.col("e1"), F.col("e2")).alias("ended"), features.marriage_years(F.col("e2"), F.col("day"), F.col("e1")).alias("years"))


@query
def value_missing_pairs(s, d):
    f = features.value_and_missing(_panel(s, d).select("simple_id", "ja", "entgelt", "rtzb", "code", "gbja", "death_year"), ["entgelt", "rtzb"])
    return features.categories(f, ["code"]).select("simple_id", "ja", "entgelt", "rtzb", "entgelt_missing", "rtzb_missing", "code", features.masked_age(F.col("ja"), F.col("gbja"), F.col("death_year")).alias("age"))


@query
def status_labels(s, d):
    return _panel(s, d).groupBy(features.status_label(F.when(F.col("simple_id") % 9 != 0, F.col("simple_id") % 5)).alias("label")).agg(F.count("*").alias("n"))


@query
def event_time_flags(s, d):
    e = F.col("ja") - F.col("first_exposure_year")
    p = _panel(s, d).withColumns({"et": e, "pre": F.coalesce(e < 0, F.lit(False)), "post": F.coalesce(e >= 0, F.lit(False))})
    return p.groupBy("et", "pre", "post").agg(F.count("*").alias("n"), F.countDistinct("simple_id").alias("persons"), F.sum("rehab").alias("rehabs"))


@query
def sample_overview(s, d):
    one = _panel(s, d).agg(F.count("*").alias("person_years"), F.countDistinct("simple_id").alias("persons"), F.sum("rehab").alias("rehabs"), F.sum("msk").alias("msk"), F.countDistinct(F.when(F.col("first_exposure_year").isNotNull(), F.col("simple_id"))).alias("exposed"))
    return one.unpivot([], ["person_years", "persons", "rehabs", "msk", "exposed"], "metric", "value")


@query
def annual_panel(s, d):
    return _panel(s, d).groupBy("ja").agg(F.count("*").alias("rows"), F.countDistinct("simple_id").alias("persons"), F.countDistinct(F.when(F.col("msk") == 1, F.col("simple_id"))).alias("msk_persons"), F.min(F.when(F.col("rehab") == 1, F.col("simple_id"))).alias("first_rehab_person"), _r(F.avg("entgelt"), 3).alias("mean_earnings"))


@query
def matched_vs_unmatched(s, d):
    risk = _risk(s, d).filter("treated = 0")
    got = _pairs(s, d).select(F.col("c_id").alias("simple_id"), "t0", F.lit(1).alias("m")).distinct()
    f = risk.join(got, ["simple_id", "t0"], "left").withColumn("matched", F.coalesce("m", F.lit(0)))
    return f.groupBy("matched").agg(F.count("*").alias("n"), _r(F.avg("lag1_age"), 5).alias("age"), _r(F.avg("lag1_ever_rehab"), 6).alias("ever_rehab"), _r(F.percentile("lag1_entgelt", 0.5), 3).alias("median_earnings"), _r(F.avg(F.col("lag1_rtzb").isNull().cast("int")), 6).alias("no_pension"))


@query
def code_shares(s, d):
    rows = _spells(s, d)
    both = rows.select("ja", F.lit(1).alias("slot"), F.col("c1").try_cast("double").try_cast("int").alias("code")).unionByName(rows.select("ja", F.lit(2).alias("slot"), F.col("c2").cast("int").alias("code")))
    n = both.groupBy("ja", "slot", "code").agg(F.count("*").alias("n"))
    return n.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("ja", "slot"))))


@query
def sex_incidence(s, d):
    """Incidence in the last year by sex and arm, and its risk difference."""
    follow = _follow(s, d).withColumn("grp", F.col("treated") * 10 + 1 + F.col("simple_id") % 2)
    c = follow.groupBy("grp", "follow_year").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == 1).alias("d1"), F.count_if(F.col("event_type") == 2).alias("d2"))
    r = followup.survival(c, (F.col("d1") + F.col("d2")) / F.col("n"), "grp").groupBy("grp").agg(F.sum(F.col("surv_before") * F.col("d1") / F.col("n")).alias("risk"))
    arm = lambda a, n: r.filter(F.floor(F.col("grp") / 10) == a).select((F.col("grp") % 10).alias("sex"), F.col("risk").alias(n))
    return arm(1, "t").join(arm(0, "c"), "sex", "full").select("sex", _r("t").alias("treated_risk"), _r("c").alias("control_risk"), _r(F.col("t") - F.col("c")).alias("risk_difference"))


@query
def lag_comparison(s, d):
    """Cohort sizes and follow-up events of three specifications: one lag year, the same over the common years, three lag years."""
    p, out = _panel(s, d), None
    for name, first, depth in (("lag1", 1998, 1), ("lag1_common", 1999, 1), ("lag3", 1999, 3)):
        risk = panel.risk_set(p, first, 1999, depth)
        size = risk.agg(F.count_if(F.col("treated") == 1).alias("treated"), F.count_if(F.col("treated") == 0).alias("controls"))
        got = pairs.rank_pairs(risk)
        arm = lambda a: F.count_if((F.col("treated") == a) & (F.col("event_type") == 1))
        events = followup.grid(pairs.assignment(got), p, HORIZON).agg(F.countDistinct("match_group").alias("pairs"), arm(1).alias("treated_events"), arm(0).alias("control_events"))
        # one row each
        row = size.withColumn("specification", F.lit(name)).join(events.withColumn("specification", F.lit(name)), "specification")
        out = row if out is None else out.unionByName(row)
    return out


# Without SQL: fits, optimal matching, draws and simulations; tests compare with brute force or fixed invariants.


@query
def hash_partition_sample(s, d):
    return models.hash_sample(_risk(s, d), 0.25)


@query
def propensity_fit(s, d):
    return models.propensity(_risk(s, d)).select("simple_id", "t0", "treated", "pscore")


@query
def optimal_match(s, d):
    return pairs.match_without_reuse(pairs.score(_risk(s, d)), models.save)


@query
def hazard_logit(s, d):
    return models.hazard(_follow(s, d))


@query
def cluster_bootstrap_ci(s, d):
    return models.bootstrap_risk_difference(_follow(s, d))


@query
def gcomp_decomposition(s, d):
    return models.decomposition(followup.mediation_grid(_risk(s, d), _panel(s, d), HORIZON), _panel(s, d))


@query
def subgroup_contrasts(s, d):
    return models.contrasts(_follow(s, d).withColumn("grp", 1 + F.col("match_group") % 3), "grp")


@query
def gcomp_simulated(s, d):
    p, risk = _panel(s, d), _risk(s, d)
    deaths = p.groupBy("simple_id").agg(F.max("death_year").alias("dy"))
    g = followup.mediation_grid(risk, p, HORIZON).join(risk.select("simple_id", "t0", F.col("lag1_age").alias("age")), ["simple_id", "t0"]).join(deaths, "simple_id", "left")
    return gcomp.simulate(g.withColumn("y", F.coalesce((F.col("dy") == F.col("t0") + F.col("follow_year")).cast("int"), F.lit(0))), HORIZON)


ADJUSTED = CohortConfig(propensity_numeric=("lag1_age", "lag1_entgelt"), propensity_binary=("lag1_ever_rehab",), propensity_categorical=("lag1_ge",))


@query
def hazard_adjusted(s, d):
    names = ["lag1_age", "lag1_entgelt", "lag1_ever_rehab", "lag1_ge"]
    base = _risk(s, d).select("simple_id", "t0", "treated", *names)
    rows = models.save(_follow(s, d).join(base, ["simple_id", "t0", "treated"]).withColumn("y", (F.col("event_type") == 1).cast("int")))
    roles = covariates.by_role(ADJUSTED, names)
    amounts = [c for c in roles["numeric"] if c.endswith("entgelt")]
    numbers = [c for c in roles["numeric"] if c not in amounts]
    return design.logit(rows, "y", design.columns(rows, numeric=numbers, amounts=amounts, binary=roles["binary"], categorical=roles["categorical"]))


@query
def landmark_mediation(s, d):
    age = _risk(s, d).select("simple_id", "t0", "treated", (F.col("lag1_age") / 10).alias("age"))
    return gcomp.landmark(pairs.assignment(_pairs(s, d)).join(age, ["simple_id", "t0", "treated"]), _panel(s, d), ("age",))


@query
def pretrend_wald(s, d):
    return followup.pretrend(_events(s, d)).select(_r("chi2").alias("chi2"), "df", _r("p").alias("p"))


def queries():
    from tessera.plans import tables  # noqa: F401  registers its queries

    return QUERIES


def oracle_sql():
    from tessera.plans import sql

    return sql.oracle_sql()
