import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import followup, histories, models, pairs

SCORED = "t0 int, lag1_ge int, lag1_ever_rehab int, treated int, simple_id long, score_ppm long"


def nearest(t, c, caliper):
    """One by one: the nearest free control, the first of equals."""
    left, n, total = list(c), 0, 0
    for s in t:
        if left:
            i = min(range(len(left)), key=lambda k: abs(left[k] - s))
            if abs(left[i] - s) <= caliper:
                n, total = n + 1, total + abs(left.pop(i) - s)
    return n, total


def test_nearest_available():
    rng = random.Random(1)
    for _ in range(300):
        t, c = (sorted(rng.randrange(60) for _ in range(rng.randint(0, 12))) for _ in range(2))
        k = rng.choice((0, 3, 20))
        assert pairs.nearest_available(np.array(t, float), np.array(c, float), k) == nearest(t, c, k)


def test_greedy_benchmark(spark):
    """By stratum, null keys included; parts beyond the caliper don't change the result; one arm alone has no row."""
    rng = random.Random(2)
    rows = [(1998, ge, 0, int(rng.random() < 0.3), i, rng.choice((100, 5000, 90_000)) + rng.randrange(3000)) for i, ge in enumerate([1, None] * 60)] + [(1999, 1, 0, 1, 500, 5)]
    got = {(r.t0, r.lag1_ge): (r.n_matched, r.distance) for r in pairs.greedy_benchmark(spark.createDataFrame(rows, SCORED), 700).collect()}
    arm = lambda ge, v: sorted(r[5] for r in rows if r[0] == 1998 and r[1] == ge and r[3] == v)
    assert got == {(1998, ge): nearest(arm(ge, 1), arm(ge, 0), 700) for ge in (1, None)}
    assert pairs.greedy_benchmark(spark.createDataFrame([], SCORED)).collect() == []


def test_pointwise_curves(spark):
    rng = random.Random(3)
    rows = []
    for g in range(150):
        for arm in (0, 1):
            for y in (1, 2, 3):
                kind = rng.choices((0, 1, 2), (8, 1 + arm, 1))[0]
                rows.append((g, arm, 1998, g * 2 + arm, y, 1998 + y, 1, kind))
                if kind:
                    break
    f = spark.createDataFrame(rows, "match_group long, treated int, t0 int, simple_id long, follow_year int, ja int, observed int, event_type int").withColumn("sex", F.col("match_group") % 2)
    got = {(r.treated, r.follow_year): r for r in models.pointwise_curves(f, (), 100).collect()}
    want = {(r.treated, r.follow_year): (r.cif, r.n) for r in followup.incidence(f).collect()}
    assert set(got) == set(want) and all(abs(got[k].estimate - v[0]) < 1e-9 and got[k].n_at_risk == v[1] for k, v in want.items())
    assert all(r.ci_low <= r.estimate <= r.ci_high and 0 < r.ci_high - r.ci_low < 0.25 for r in got.values())
    one = {(r.treated, r.follow_year): r.cif for r in followup.incidence(f.filter("sex = 1")).collect()}
    by = {(r.treated, r.follow_year): r.estimate for r in models.pointwise_curves(f, ("sex",), 20).collect() if r.sex == 1}
    assert by.keys() == one.keys() and all(abs(by[k] - one[k]) < 1e-9 for k in by)
    row = models.bootstrap_risk_difference(f, 50).first()
    last = {arm: want[arm, 3][0] for arm in (0, 1)}
    assert abs(row.risk_ratio - last[1] / last[0]) < 1e-9 and row.ratio_low <= row.risk_ratio <= row.ratio_high


STATE = "simple_id long, ja int, follow_year int, age double, treated int, mediator_prev int, mediator_now int, prior_income string, prior_entgelt double, prior_rtzb double, prior_rehab int, current_income string, current_entgelt double, current_rtzb double, current_rehab int"


def people(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        treated = i % 2
        income = rng.choices(("both", "earnings_only", "neither"), (1, 6, 3) if treated else (5, 2, 3))[0]
        amount = np.expm1(8 + treated + rng.gauss(0, 0.3)) if income != "neither" else 0.0
        rows.append((i, 2000, 1 + i % 3, None if i % 50 == 0 else float(rng.randint(40, 60)), treated, 0, rng.randint(0, 1), rng.choice(("both", None)), 1.0, 2.0, 0, income, float(amount), 5.0 if income == "both" else 0.0, int(rng.random() < (0.7 if income == "neither" else 0.1))))
    return rows


def test_drawn_year_follows_the_models(spark):
    rows = spark.createDataFrame(people(3000), STATE)
    roles = histories.specs({"numeric": ["age"]})
    assert roles["binary"] == ["prior_rehab", "treated", "mediator_prev"] and roles["categorical"] == ["prior_income", "follow_year"] and "prior_entgelt" not in histories.specs({}, False)["numeric"]
    model = histories.fit(rows, roles)
    assert model.status.classes == ["both", "earnings_only", "neither"] and abs(model.amounts["entgelt"].sd) > 0.2
    drawn = models.save(model.update(rows, 7, "simple_id", "ja"))
    assert drawn.columns == rows.columns
    share = lambda df, c: {(r.treated, r[c]): r.n / 1500 for r in df.groupBy("treated", c).agg(F.count("*").alias("n")).collect()}
    for c in ("current_income", "current_rehab"):
        a, b = share(rows, c), share(drawn, c)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.06 for k in a)
    # the amounts' model has no product of arm and status, so it keeps the mean of each status
    mean = lambda df: {r.current_income: r.m for r in df.filter("current_income != 'neither'").groupBy("current_income").agg(F.avg(F.log1p("current_entgelt")).alias("m")).collect()}
    a, b = mean(rows), mean(drawn)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.1 for k in a), (a, b)
    assert drawn.filter("current_income = 'neither' and (current_entgelt != 0 or current_rtzb != 0) or current_income = 'earnings_only' and current_rtzb != 0").count() == 0
    assert drawn.filter("prior_income != current_income or prior_entgelt != current_entgelt or prior_rtzb != current_rtzb or prior_rehab != current_rehab").count() == 0
    again = model.update(rows.repartition(7), 7, "simple_id", "ja")
    assert sorted(map(str, again.collect())) == sorted(map(str, drawn.collect()))


def test_histories_of_one_value(spark):
    """One status, equal amounts and one binary value give constants; no rows are an error."""
    rows = spark.createDataFrame([(*r[:11], None, None, 3.0, 1) for r in people(40)], STATE)
    model = histories.fit(rows, histories.specs({"numeric": ["age"]}))
    got = model.update(rows, 1, "simple_id").select("current_income", "current_entgelt", "current_rtzb", "current_rehab").distinct().collect()
    assert [tuple(r) for r in got] == [("__MISSING__", 0.0, 0.0, 1)]
    with pytest.raises(ValueError):
        histories.fit(rows.filter("false"), histories.specs({}))


def test_normal_numbers(spark):
    z = [r[0] for r in spark.range(20_000).select(histories.normal("id")).collect()]
    assert abs(np.mean(z)) < 0.03 and abs(np.std(z) - 1) < 0.03 and abs(np.mean(np.abs(z) < 1.96) - 0.95) < 0.01
