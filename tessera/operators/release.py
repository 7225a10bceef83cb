"""Release tables: statistics of matching and samples, with small cells withheld, and internal twins without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.functions.stats import normal_two_sided
from tessera.operators import followup, models
from tessera.operators.pairs import STRATA

LEAST = 20


def small(value: Column, least: int) -> Column:
    """A count that may not be told: from 0 to least - 1."""
    return F.coalesce((value >= 0) & (value < least), F.lit(False))


def few_but_some(value: Column, least: int) -> Column:
    return F.coalesce((value > 0) & (value < least), F.lit(False))


def distances(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """pairs with the distance of their members' scores, in millionths."""
    side = lambda arm, c: scored.filter(F.col("treated") == arm).select(F.col("simple_id").alias(c), "t0", F.col("score_ppm").alias(f"s_{c}"))
    return pairs.join(side(1, "t_id"), ["t_id", "t0"]).join(side(0, "c_id"), ["c_id", "t0"]).withColumn("distance", F.abs(F.col("s_t_id") - F.col("s_c_id"))).drop("s_t_id", "s_c_id")


def _strata(scored: DataFrame, strata: list[str] = STRATA) -> DataFrame:
    return scored.groupBy(*strata).agg(F.sum("treated").alias("t"), F.sum(1 - F.col("treated")).alias("c"))


def matching_overall(scored: DataFrame, pairs: DataFrame, caliper: int, strata: list[str] = STRATA) -> DataFrame:
    """metric, value of the whole matching.  pairs: t_id, c_id, t0, distance (millionths); shares of distances are the
    nearest values, the median lies between."""
    sizes = _strata(scored, strata).agg(F.sum("t").alias("eligible_treated"), F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("t"))), F.lit(0)).alias("treated_without_exact_control"))
    used = pairs.agg(F.count("*").alias("matched_pairs"), F.countDistinct("t_id").alias("unique_matched_treated"), F.countDistinct("c_id").alias("unique_matched_controls"), F.avg("distance").alias("mean_distance"), F.percentile("distance", 0.5).alias("median_distance"), F.max("distance").alias("max_distance"))
    ranks = x.nearest_quantiles(pairs, [], "distance", {"p90_distance": 0.9, "p95_distance": 0.95})
    # one row each
    one = sizes.withColumn("_", F.lit(1)).join(used.withColumn("_", F.lit(1)), "_").join(ranks.withColumn("_", F.lit(1)), "_", "left")
    one = one.withColumns({"unmatched_treated": F.col("eligible_treated") - F.col("unique_matched_treated"), "match_rate": F.expr("try_divide(unique_matched_treated, eligible_treated)"), "controls_reused": F.col("matched_pairs") - F.col("unique_matched_controls"), "caliper": F.lit(caliper)})
    one = one.withColumn("unmatched_after_exact", F.col("unmatched_treated") - F.col("treated_without_exact_control"))
    metrics = [c for c in one.columns if c != "_"]
    return one.select(*(F.col(c).cast("double").alias(c) for c in metrics)).unpivot([], metrics, "metric", "value")


PERSON_METRICS = ("eligible_treated", "matched_pairs", "unique_matched_treated", "unique_matched_controls", "unmatched_treated", "treated_without_exact_control", "unmatched_after_exact")
TOTALS = ("eligible_treated", "unmatched_treated", "match_rate")


def release_overall(metrics: DataFrame, least: int = LEAST) -> DataFrame:
    """The metrics with small counts of people withheld; where few are unmatched, so are the totals that would tell."""
    few = F.max(F.when(F.col("metric") == "unmatched_treated", F.col("value"))).over(Window.partitionBy(F.lit(0))) < least
    total, own = few & F.col("metric").isin(*TOTALS), F.col("metric").isin(*PERSON_METRICS) & small(F.col("value"), least)
    note = F.when(total, "complement of few unmatched").when(own, "below the limit")
    return metrics.withColumn("note", note).withColumn("value", F.when(F.col("note").isNull(), F.col("value")))


def matching_by_year(scored: DataFrame, pairs: DataFrame, strata: list[str] = STRATA) -> DataFrame:
    per = _strata(scored, strata).groupBy("t0").agg(F.sum("t").alias("n_treated"), F.sum("c").alias("n_controls"), F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("t"))), F.lit(0)).alias("n_without_exact"))
    got = pairs.groupBy("t0").agg(F.count("*").alias("n_matched"))
    out = per.join(got, "t0", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return out.withColumns({"n_unmatched_after": F.col("n_treated") - F.col("n_matched") - F.col("n_without_exact"), "match_rate": F.expr("try_divide(n_matched, n_treated)")})


def release_by_year(years: DataFrame, least: int = LEAST, counts: tuple[str, ...] = ("n_controls", "n_matched", "n_treated", "n_unmatched_after", "n_without_exact")) -> DataFrame:
    """Years with few unmatched lose total and rate; other small counts are withheld; the note lists what went."""
    few = (F.col("n_treated") - F.col("n_matched")) < least
    hidden = {c: small(F.col(c), least) for c in counts}
    parts = [F.when(hidden[c], F.lit(f"{c} withheld")) for c in counts] + [F.when(few, F.lit("total and rate withheld"))]
    noted = years.withColumn("note", F.array_join(F.array_compact(F.array(*parts)), "; "))
    gone = lambda c: hidden.get(c, F.lit(False)) | (few if c in ("n_treated", "match_rate") else F.lit(False))
    return noted.select("t0", *(F.when(~gone(c), F.col(c)).alias(c) for c in (*counts, "match_rate")), F.when(F.col("note") != "", F.col("note")).alias("note"))


def release_attrition(stages: DataFrame, unmatched: Column, least: int = LEAST) -> DataFrame:
    """Attrition (treated, ord, stage, n_rows, n_persons, removed) with removed persons and a note on units; the last
    stage of the treated is withheld where few of them are unmatched (unmatched: a column that holds their number)."""
    w = Window.partitionBy("treated").orderBy("ord")
    last = F.row_number().over(Window.partitionBy("treated").orderBy(F.desc("ord"))) == 1
    hide = last & (F.col("treated") == 1) & (unmatched < least)
    rows = stages.withColumns({"removed_persons": F.lag("n_persons").over(w) - F.col("n_persons"), "unit": F.when(F.col("treated") == 1, "assignments, one a person").otherwise("assignments, persons may repeat"), "_hide": hide})
    keep = lambda c: F.when(~F.col("_hide"), F.col(c)).alias(c)
    return rows.select("treated", "stage", *(keep(c) for c in ("n_rows", "n_persons", "removed", "removed_persons")), "unit", F.when(F.col("_hide"), "withheld: few unmatched").alias("note"))


def six_cells(rows: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """rows: keys, people_{arm}, events_{arm} for the arms controls and treated, and estimates.  A row goes wholly where
    people, events or people without an event of an arm are under the limit, 0 included."""
    cells = [F.col(f"{n}_{a}") for n in ("people", "events") for a in ("controls", "treated")] + [F.col(f"people_{a}") - F.col(f"events_{a}") for a in ("controls", "treated")]
    few = F.least(*cells) < least
    return rows.select(*keys, *(F.when(~few, F.col(c)).alias(c) for c in rows.columns if c not in keys), F.when(few, "withheld_small_cell").otherwise("reported").alias("status"))


def group_cells(follow: DataFrame, members: DataFrame, schemes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """scheme, part, level and, by arm, people assigned, with follow-up, with an event, dead, and without either.

    schemes: name -> (part, level) as columns of members; a null level is outside the scheme.  One pass over members."""
    ends = follow.groupBy("match_group", "treated").agg(F.lit(1).alias("entered"), F.max((F.col("event_type") == 1).cast("int")).alias("event"), F.max((F.col("event_type") == 2).cast("int")).alias("dead"))
    rows = members.join(ends, ["match_group", "treated"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scheme"), p.cast("string").alias("part"), v.cast("string").alias("level")) for n, (p, v) in schemes.items())))
    rows = rows.select("treated", "entered", "event", "dead", each.alias("s")).select("treated", "entered", "event", "dead", "s.*").filter("level is not null")
    on = lambda a, c: F.count_if((F.col("treated") == a) & c)
    cells = {}
    for a, arm in ((0, "control"), (1, "treated")):
        cells |= {f"{arm}_assigned": F.lit(True), f"{arm}_entered": F.col("entered") == 1, f"{arm}_events": F.col("event") == 1, f"{arm}_deaths": F.col("dead") == 1}
    per = rows.groupBy("scheme", "part", "level").agg(*(on(int(n.startswith("treated")), c).alias(n) for n, c in cells.items()))
    return per.withColumns({f"{arm}_without": F.col(f"{arm}_entered") - F.col(f"{arm}_events") - F.col(f"{arm}_deaths") for arm in ("control", "treated")})


TOLD = ("entered", "events", "deaths", "without")


def protect_groups(cells: DataFrame, whole: str, least: int = LEAST) -> DataFrame:
    """group_cells with rows withheld: those with a small count or few entered, and, within the levels of a part of a
    scheme (but `whole`), the least visible row where just one withheld row would be told by subtraction.  In rows that stay,
    assigned and entered go where they differ by a small count."""
    names = [f"{a}_{n}" for a in ("control", "treated") for n in TOLD]
    unsafe = F.lit(False)
    for n in names:
        unsafe = unsafe | few_but_some(F.col(n), least)
    for a in ("control", "treated"):
        unsafe = unsafe | (F.col(f"{a}_entered") < least)
    family = Window.partitionBy("scheme", "part")
    out = cells.withColumn("_hide", unsafe)
    # counts in turn: what an earlier one hides counts as hidden for the next
    for n in names:
        positive = F.col(n) > 0
        one = F.sum((F.col("_hide") & positive).cast("int")).over(family) == 1
        rank = F.row_number().over(family.orderBy((F.col("_hide") | ~positive).cast("int"), n, "level"))
        out = out.withColumns({"_one": one, "_rank": rank})
        out = out.withColumn("_hide", F.col("_hide") | ((F.col("scheme") != whole) & F.col("_one") & (F.col("_rank") == 1) & positive)).drop("_one", "_rank")
    keep = lambda c, more=F.lit(False): F.when(~F.col("_hide") & ~more, F.col(c)).alias(c)
    gap = {a: few_but_some(F.col(f"{a}_assigned") - F.col(f"{a}_entered"), least) for a in ("control", "treated")}
    shown = [keep(f"{a}_{n}", gap[a] if n in ("assigned", "entered") else F.lit(False)) for a in ("control", "treated") for n in ("assigned", *TOLD)]
    return out.select("scheme", "part", "level", *shown, F.when(F.col("_hide"), "withheld").otherwise("reported").alias("disclosure"))


def counts_by_arm(rows: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """Treated and control rows of each key of the spine, and shares of the arm in percent: 0 where none is.  Rows whose
    key the spine lacks count under their own."""
    n = rows.groupBy(key).agg(F.count_if(F.col("treated") == 1).alias("treated_n"), F.count_if(F.col("treated") == 0).alias("control_n"))
    full = spine.select(key).distinct().join(n, key, "full").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("treated_n", "control_n")))
    w = Window.partitionBy(F.lit(0))
    share = lambda c: F.coalesce(100 * F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)), F.lit(0.0))
    return full.withColumns({"treated_pct": share("treated_n"), "control_pct": share("control_n")})


def overlap(members: DataFrame) -> DataFrame:
    """By person: matched assignments by role, first and last years, and the order and gap of both roles."""
    role = lambda a, f: f(F.when(F.col("treated") == a, F.col("t0")))
    per = members.groupBy("simple_id").agg(F.count("*").alias("n"), F.count_if(F.col("treated") == 1).alias("n_treated"), F.count_if(F.col("treated") == 0).alias("n_control"), role(1, F.min).alias("treated_t0"), role(0, F.min).alias("first_control"), role(0, F.max).alias("last_control"), F.countDistinct("match_group").alias("n_groups"))
    both = (F.col("n_treated") > 0) & (F.col("n_control") > 0)
    gap = F.col("treated_t0") - F.col("last_control")
    return per.withColumns({"both_roles": both, "repeated_control": F.col("n_control") > 1, "control_first": F.coalesce(F.col("last_control") < F.col("treated_t0"), F.lit(False)), "years_between": F.when(both, gap)})


def describe(long: DataFrame, keys: list[str], binary: list[str]) -> DataFrame:
    """n, missing, mean, sd, quantiles and range of each variable of a long table (variable, value), and for binary ones
    the percentage of 1."""
    v, q = F.col("value"), {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    stats = long.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile(v, list(q.values())).alias("_q"), (100 * F.avg(F.when(F.col("variable").isin(binary), (v == 1).cast("int")))).alias("percent"))
    return stats.select(*keys, "n", "missing", "mean", "sd", "lo", "hi", *(F.col("_q")[i].alias(name) for i, name in enumerate(q)), "percent")


def imbalanced(balance: DataFrame, allowed: list[str], threshold: float = 0.1) -> DataFrame:
    """Covariates whose worst difference after matching is over the threshold, the difference of a missing flag
    (`name__missing`) counting for its covariate: variable, component (the first by name of ties), max_abs_smd."""
    base = F.regexp_replace("variable", "__missing$", "")
    rows = balance.filter((F.col("sample") == "post") & (F.abs("smd") > threshold)).select(base.alias("base"), "variable", F.abs("smd").alias("size")).filter(F.col("base").isin(allowed))
    return rows.groupBy("base").agg(F.max("size").alias("max_abs_smd"), F.min_by("variable", F.struct(-F.col("size"), "variable")).alias("component")).select(F.col("base").alias("variable"), "component", "max_abs_smd")


COMPARED = ("variable", "level", "kind", "matched_value", "unmatched_value", "smd", "matched_count", "unmatched_count", "matched_rest", "unmatched_rest")
POOLED_LEVELS = "__POOLED_LEVELS_BELOW_THRESHOLD__"


def _proportion_smd(a: Column, b: Column) -> Column:
    return x.smd(a, a * (1 - a), b, b * (1 - b))


def _long(rows: DataFrame, names: list[str], kind: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("value")) for c in names)))
    return rows.select("matched", each.alias("e")).select("matched", "e.*")


def compare_groups(rows: DataFrame, numeric: list[str], binary: list[str], categorical: list[str]) -> DataFrame:
    """COMPARED: matched (1) against unmatched (0) rows, for numbers their means and shares of missing ones, for flags the shares of 1, for
    categories those of each level (null is a level), with the rows behind each value and their complement.

    Each kind of variable is one unpivot and one aggregation; a variable's levels are few."""
    arm = lambda a, c: F.count_if((F.col("matched") == a) & F.coalesce(c, F.lit(False)))
    value, out = F.col("value"), []
    if numeric or binary:
        stats = [f(F.when(F.col("matched") == a, value)).alias(f"{n}{a}") for a in (1, 0) for n, f in (("mean", F.avg), ("var", F.var_pop))]
        stats += [arm(a, c).alias(f"{n}{a}") for a in (1, 0) for n, c in (("some", value.isNotNull()), ("none", value.isNull()), ("one", value == 1), ("zero", value == 0))]
        per = _long(rows, [*numeric, *binary], "double").groupBy("variable").agg(*stats)
        numbers, flags = per.filter(F.col("variable").isin(numeric)), per.filter(F.col("variable").isin(binary))
        gone = {a: F.col(f"none{a}") / F.greatest(F.col(f"none{a}") + F.col(f"some{a}"), F.lit(1)) for a in (1, 0)}
        shown = lambda df, name, level, kind, v, smd, n, rest: df.select(name.alias("variable"), F.lit(level).cast("string").alias("level"), F.lit(kind).alias("kind"), v[1].alias("matched_value"), v[0].alias("unmatched_value"), smd.alias("smd"), *(F.col(f"{c}{a}").alias(f"{g}_{s}") for c, s in ((n, "count"), (rest, "rest")) for a, g in ((1, "matched"), (0, "unmatched"))))
        means = {a: F.col(f"mean{a}") for a in (1, 0)}
        whole = x.smd(F.col("mean1"), F.col("var1"), F.col("mean0"), F.col("var0"))
        out.append(shown(numbers, F.col("variable"), None, "continuous", means, whole, "some", "none"))
        out.append(shown(numbers, F.concat("variable", F.lit("__missing")), "missing", "binary_missingness", gone, _proportion_smd(gone[1], gone[0]), "none", "some"))
        out.append(shown(flags, F.col("variable"), "1", "binary", means, _proportion_smd(means[1], means[0]), "one", "zero"))
    if categorical:
        level = F.coalesce("value", F.lit(x.MISSING))
        counts = _long(rows, categorical, "string").groupBy("variable", level.alias("level")).agg(*(arm(a, F.lit(True)).alias(f"n{a}") for a in (1, 0)))
        out.append(_levels(counts))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.select(*COMPARED)


def _levels(counts: DataFrame, *more: str) -> DataFrame:
    """counts (variable, level, n1, n0) as rows of COMPARED."""
    w = Window.partitionBy("variable")
    rest = {a: F.sum(f"n{a}").over(w) - F.col(f"n{a}") for a in (1, 0)}
    share = {a: F.col(f"n{a}") / F.greatest(F.sum(f"n{a}").over(w), F.lit(1)) for a in (1, 0)}
    columns = {"matched_value": share[1], "unmatched_value": share[0], "smd": _proportion_smd(share[1], share[0]), "matched_count": F.col("n1")}
    columns |= {"unmatched_count": F.col("n0"), "matched_rest": rest[1], "unmatched_rest": rest[0], "kind": F.lit("categorical_level")}
    return counts.select(*counts.columns, *(c.alias(n) for n, c in columns.items())).select(*COMPARED, *more)


def pool_jointly(counts: DataFrame, least: int) -> DataFrame:
    """counts (variable, level, n1, n0) with one relabelling for both groups: levels that are small in either are pooled, and where that is
    just one, the smallest other level too (by its lesser count, then its sum, then name).  pooled: levels behind a pool, else null."""
    w = Window.partitionBy("variable")
    few = (F.col("n1") < least) | (F.col("n0") < least)
    order = [few.cast("int"), F.least("n1", "n0"), F.col("n1") + F.col("n0"), F.col("level")]
    marked = counts.withColumns({"_few": few, "_n": F.sum(few.cast("int")).over(w), "_rank": F.row_number().over(w.orderBy(*order))})
    pool = F.col("_few") | ((F.col("_n") == 1) & (F.col("_rank") == 1))
    named = marked.withColumns({"_pool": pool, "level": F.when(pool, F.lit(POOLED_LEVELS)).otherwise(F.col("level"))})
    sums = [F.sum(c).alias(c) for c in ("n1", "n0")]
    return named.groupBy("variable", "level", "_pool").agg(*sums, F.when(F.col("_pool"), F.count("*")).alias("pooled")).drop("_pool")


def release_groups(rows: DataFrame, numeric: list[str], binary: list[str], categorical: list[str], least: int = LEAST) -> DataFrame:
    """COMPARED, pooled and note of what may be told: nothing where a group has under `least` rows; a number where both groups have
    enough values; a share where neither it nor its complement is small in either group; levels pooled jointly."""
    size = rows.agg(*(F.count_if(F.col("matched") == a).alias(f"_size{a}") for a in (1, 0)))
    plain = compare_groups(rows, numeric, binary, []) if numeric or binary else None
    counts = _long(rows, categorical, "string").groupBy("variable", F.coalesce("value", F.lit(x.MISSING)).alias("level"))
    counts = counts.agg(*(F.count_if(F.col("matched") == a).alias(f"n{a}") for a in (1, 0)))
    out = _levels(pool_jointly(counts, least), "pooled") if categorical else None
    if plain is not None:
        plain = plain.withColumn("pooled", F.lit(None).cast("long"))
        out = plain if out is None else plain.unionByName(out)
    cells = {g: (F.col(f"{g}_count"), F.col(f"{g}_rest")) for g in ("matched", "unmatched")}
    enough = (F.col("matched_count") >= least) & (F.col("unmatched_count") >= least)
    two_sided = F.lit(True)
    for pair in cells.values():
        for c in pair:
            two_sided = two_sided & (c >= least)
    of_level = F.col("kind") == "categorical_level"
    # a group of few rows: one row, told to every line
    sized = out.withColumn("_", F.lit(1)).join(F.broadcast(size.withColumn("_", F.lit(1))), "_").drop("_")
    small_group = (F.col("_size1") < least) | (F.col("_size0") < least)
    allowed = ~small_group & F.when((F.col("kind") == "continuous") | of_level, enough).otherwise(two_sided)
    note = F.when(F.col("_size0") == 0, "no unmatched rows").when(small_group, "a group is under the limit")
    note = note.when(~allowed, "a cell or its complement is under the limit").when(F.col("pooled").isNotNull(), F.concat(F.col("pooled").cast("string"), F.lit(" levels pooled")))
    told = [F.when(allowed, F.col(c)).alias(c) for c in COMPARED[3:]]
    return sized.select(*COMPARED[:3], *told, "pooled", note.alias("note"))


MEASURES = ("control_risk", "treated_risk", "risk_difference", "risk_ratio")


def group_draws(
    follow: DataFrame, members: DataFrame, schemes: dict[str, tuple[Column, Column]], replicates: int = 200, seed: int = 17
) -> DataFrame:
    """rep, scheme, part, level and MEASURES of the last year, where replicate -1 is the sample; saved.

    schemes as for group_cells.  All schemes and levels share a pair's draws, which are made within the parts (such as sexes) of the
    pairs; a level's arms are those of its own members, so a pair can have its members in two levels.
    """
    keys = ["scheme", "part", "level"]
    named = F.array(*(F.struct(F.lit(n).alias("scheme"), p.cast("string").alias("part"), v.cast("string").alias("level")) for n, (p, v) in schemes.items()))
    of = members.select("match_group", "treated", F.explode(named).alias("s")).select("match_group", "treated", "s.*").filter("level is not null")
    long = follow.select("match_group", "treated", "follow_year", "event_type").join(of, ["match_group", "treated"])
    curves = models.replicate_curves(long, keys, replicates, seed, "part")
    risk = lambda a: F.sum(F.when(F.col("treated") == a, F.col("risk")))
    both = curves.groupBy("rep", *keys).agg(risk(0).alias("control_risk"), risk(1).alias("treated_risk"))
    ratio = F.when(F.col("control_risk") > 0, F.col("treated_risk") / F.col("control_risk"))
    return models.save(both.withColumns({"risk_difference": F.col("treated_risk") - F.col("control_risk"), "risk_ratio": ratio}))


def _spread(value: str, replicates: int) -> list[Column]:
    """The sample's value and its percentile interval; no interval where under 95 % of the replicates have a value."""
    drawn = F.when(F.col("rep") >= 0, F.col(value))
    enough = F.count(drawn) >= -(-95 * replicates // 100)
    limits = [F.when(enough, F.percentile(drawn, q)).alias(f"{value}_{n}") for q, n in ((0.025, "low"), (0.975, "high"))]
    return [F.max(F.when(F.col("rep") < 0, F.col(value))).alias(value), *limits]


def group_effects(draws: DataFrame, replicates: int) -> DataFrame:
    """scheme, part, level, and each of MEASURES with its interval."""
    return draws.groupBy("scheme", "part", "level").agg(*(c for m in MEASURES for c in _spread(m, replicates)))


def protect_effects(effects: DataFrame, protected: DataFrame) -> DataFrame:
    """effects without the numbers of groups that protect_groups withholds (or doesn't have), and its disclosure."""
    keys = ["scheme", "part", "level"]
    told = protected.select(*(F.col(k).alias(f"_{k}") for k in keys), "disclosure")
    both = effects.join(told, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    shown = F.coalesce(F.col("disclosure") == "reported", F.lit(False))
    values = [F.when(shown, F.col(c)).alias(c) for c in effects.columns if c not in keys]
    return both.select(*keys, *values, F.when(shown, "reported").otherwise("withheld").alias("disclosure"))


def contrast_rows(draws: DataFrame, protected: DataFrame, requests: list[tuple[str, tuple[str, str, str], tuple[str, str, str]]], replicates: int) -> DataFrame:
    """test, left and right (scheme|part|level), difference of risk differences with interval, se, p and p_holm, disclosure.

    requests: (test, left group, right group).  A contrast is withheld where either group is; Holm's adjustment is over all contrasts
    that are told, as one family, and p is Wald's, from the draws' standard error.
    """
    spark = draws.sparkSession
    name = F.concat_ws("|", "scheme", "part", "level")
    asked = spark.createDataFrame([(t, "|".join(a), "|".join(b)) for t, a, b in requests], "test string, left string, right string")
    side = lambda s: draws.select("rep", name.alias(s), F.col("risk_difference").alias(f"_{s}"))
    # a few rows a replicate
    gaps = F.broadcast(asked).join(side("left"), "left").join(side("right"), ["rep", "right"]).withColumn("difference", F.col("_left") - F.col("_right"))
    drawn = F.when(F.col("rep") >= 0, F.col("difference"))
    out = gaps.groupBy("test", "left", "right").agg(*_spread("difference", replicates), F.stddev_samp(drawn).alias("se"))
    told = protected.filter("disclosure = 'reported'").select(name.alias("g"), F.lit(True).alias("ok"))
    for s in ("left", "right"):
        out = out.join(told.select(F.col("g").alias(s), F.col("ok").alias(f"ok_{s}")), s, "left")
    out = models.save(out.withColumn("ok", F.coalesce(F.col("ok_left") & F.col("ok_right"), F.lit(False))))
    # one row a contrast reaches the driver, which has the exact normal tail
    rows = [r for r in out.collect() if r.ok and r.se and r.difference is not None]
    tails = spark.createDataFrame([(r.test, r.left, r.right, normal_two_sided(r.difference / r.se)) for r in rows], "test string, left string, right string, p double")
    tested = followup.holm(tails.withColumns({"kind": F.col("test"), "test": F.concat_ws(">", "test", "left", "right")}), [])
    tested = tested.select(F.col("kind").alias("test"), "left", "right", "p", "p_holm")
    whole = out.join(F.broadcast(tested), ["test", "left", "right"], "left")
    values = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("difference", "difference_low", "difference_high", "se", "p", "p_holm")]
    return whole.select("test", "left", "right", *values, F.when(F.col("ok"), "reported").otherwise("withheld").alias("disclosure"))
