"""Resampling, batched fits and the mediation's simulation, against plain versions."""

import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batched, mediation, pairs, resample
from tessera.operators.batched import Model
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("each", [10_000, 7])
def test_each_replicate_draws_as_many_as_there_are(spark, each):
    n, reps = 200, range(3, 43)
    df = spark.range(n).select(F.col("id").alias("pair"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 150, "b").alias("sex"))
    got = {r.pair: list(r.weights) for r in resample.weights(df.repartition(3), "pair", reps, 4, "sex", each).collect()}
    w = np.array([got[i] for i in range(n)])
    assert w.shape == (n, len(reps)) and (w >= 0).all() and (w.sum(0) == n).all()
    sex = np.array([r.sex or "" for r in df.orderBy("pair").collect()])
    for s in ("a", "b", ""):
        assert (w[sex == s].sum(0) == (sex == s).sum()).all()
    # counts of a draw with replacement: mean 1, variance 1 - 1 / n of the stratum
    assert abs(w.var() - 1) < 0.1 and len({tuple(c) for c in w.T}) == len(reps)
    # the same whatever the partitions, and for each replicate whatever the range
    again = {r.pair: list(r.weights) for r in resample.weights(df.repartition(7), "pair", range(10, 12), 4, "sex", each).collect()}
    assert all(again[i] == got[i][7:9] for i in range(n))
    assert resample.weights(df.filter("false"), "pair", reps).collect() == []


@pytest.fixture
def prepare():
    def one(batch):  # workers get it by value
        cols = {c: batch.column(c) for c in batch.schema.names}
        frame = {c: cols[c].to_numpy(zero_copy_only=False) for c in ("x", "g", "y", "k", "amount")} | {"all": np.ones(batch.num_rows, bool)}
        return frame, cols["w"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)

    return one


def test_fits_of_many_replicates(spark, prepare):
    rng = np.random.default_rng(1)
    n, reps = 600, 4
    x, g = rng.normal(size=n), rng.choice(list("abc"), n)
    eta = -0.5 + 0.8 * x + (g == "b")
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    k = np.array(list("pqr"))[np.minimum(2, (rng.random(n) * 2 + y).astype(int))]
    amount = np.exp(1 + 0.5 * x + rng.normal(size=n) * 0.3)
    w = rng.integers(0, 4, (n, reps))
    w[:, 3] = np.where(y == 1, w[:, 3], 0)  # one outcome only
    rows = [(float(x[i]), str(g[i]), int(y[i]), str(k[i]), float(amount[i]), w[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, g string, y int, k string, amount double, w array<int>").repartition(5)
    d = batched.design(df, ["x"], [], ["g"])
    assert d.names() == ["intercept", "x", "g=b", "g=c"]
    models = [Model("y", "binary", "y", "all", d), Model("k", "several", "k", "all", d, ["p", "q", "r"]), Model("amount", "amount", "amount", "all", d)]
    fits = batched.fit(df, prepare, models, reps)
    z = d.matrix({"x": x, "g": g}, n)
    for r in range(3):
        p = 1 / (1 + np.exp(-z @ fits["y"].coefficients[r]))
        assert np.abs(z.T @ (w[:, r] * (y - p))).max() < 1e-6 and fits["y"].method[r] == "unpenalized" and fits["y"].converged[r]
        q = batched.shares(z, fits["k"].coefficients[r : r + 1], 3)[:, :, 0]
        assert max(np.abs(z.T @ (w[:, r] * ((k == c) - q[i]))).max() for i, c in enumerate("pqr")) < 1e-6
        b = np.linalg.lstsq(z * np.sqrt(w[:, r : r + 1]), np.log1p(amount) * np.sqrt(w[:, r]), rcond=None)[0]
        assert np.allclose(fits["amount"].coefficients[r], b)
        left = np.log1p(amount) - z @ b
        assert math.isclose(fits["amount"].sd[r], math.sqrt(np.average(left**2, weights=w[:, r]) - np.average(left, weights=w[:, r]) ** 2), rel_tol=1e-6)
        assert math.isclose(fits["amount"].cap[r], np.log1p(amount[w[:, r] > 0]).max() + 3)
    assert fits["y"].method[3] == "constant" and fits["y"].chance({"x": x, "g": g}, n, 3).min() > 1 - 1e-8
    assert "p" not in set(k[w[:, 3] > 0]) or fits["k"].converged[3]


def test_columns_without_a_value_have_no_effect():
    h, g = np.array([[4.0, 0, 2], [0, 0, 0], [2, 0, 1]]), np.array([2.0, 0, 1])  # the third is half of the first
    b = batched._solve(h, g)
    assert np.allclose(h @ b, g) and b[1] == 0 and np.abs(b).max() < 1


def test_separable_rows_take_a_rung(spark, prepare):
    rows = [(float(i), "a", int(i >= 20), "p", 1.0, [1, int(i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, g string, y int, k string, amount double, w array<int>")
    d = batched.design(df, ["x"], [], [])
    f = batched.fit(df, prepare, [Model("y", "binary", "y", "all", d)], 2)["y"]
    assert f.method == ["ridge C=1e4"] * 2 and f.converged.all() and (f.steps > batched.STEPS).all()
    z = d.matrix({"x": np.arange(40.0)}, 40)
    p = 1 / (1 + np.exp(-z @ f.coefficients[0]))
    assert np.abs(z.T @ (np.array([r[2] for r in rows]) - p) - 1e-4 * np.array([0, f.coefficients[0, 1]])).max() < 1e-6


def test_designs_fill_nulls_and_pool_rare_levels(spark):
    rows = [(1.0, 1, "a")] * 12 + [(None, None, None)] * 11 + [(4.0, 0, "z")] * 2
    df = spark.createDataFrame(rows, "n double, b int, c string")
    d = batched.design(df, ["n"], ["b"], ["c"])
    assert d.names() == ["intercept", "n", "n__missing", "b", "b__missing", f"c={'a'}", f"c={batched.RARE}"] and d.known["c"] == ["__MISSING__", "a"]
    got = d.matrix({"n": np.array([np.nan, 4.0]), "b": np.array([np.nan, 0.0]), "c": np.array(["new", "a"], object)}, 2)
    median, mean, sd, _ = d.numeric["n"]
    assert np.allclose(got, [[1, (median - mean) / sd, 1, 1, 1, 0, 1], [1, (4 - mean) / sd, 0, 0, 0, 1, 0]])


class Plain:
    """The simulation by loops over people, with the same draws; designs are read term by term."""

    def __init__(self, fits, plan, r):
        self.fits, self.plan, self.r = fits, plan, r

    def eta(self, name, values, part=0):
        f = self.fits[name]
        d, names = f.model.design, f.model.design.names()
        total = 0.0
        for term, b in zip(names, f.coefficients[self.r][part * len(names) :]):
            if term == "intercept":
                v = 1.0
            elif "=" in term and term.split("=")[0] in d.levels:
                c, level = term.split("=")
                v = float(values[c] not in d.known[c] if level == batched.RARE else values[c] == level)
            elif term in d.numeric:
                median, mean, sd, _ = d.numeric[term]
                v = ((median if values[term] is None else float(values[term])) - mean) / sd
            elif term in d.binary:
                v = float(d.binary[term][0] if values[term] is None else values[term])
            else:
                v = float(values[term.removesuffix("__missing")] is None)
            total += v * b
        return total

    def chance(self, name, values):
        return min(1 - 1e-9, max(1e-9, 1 / (1 + math.exp(-self.eta(name, values)))))

    def u(self, who, rep, sim, *purpose):
        return float(mediation.uniform(np.array([who], np.uint64), self.plan.seed, *purpose, rep, np.array([sim]))[0])

    def update(self, s, who, rep, sim, *purpose):
        income = self.fits["income"].model.classes
        e = [0.0] + [self.eta("income", s, i) for i in range(len(income) - 1)]
        p = np.exp(np.array(e) - max(e))
        u, k = self.u(who, rep, sim, mediation.INCOME, *purpose), 0
        while k < len(income) - 1 and p[: k + 1].sum() / p.sum() < u:
            k += 1
        s = s | {"current_income": income[k]}
        for i, a in enumerate(mediation.AMOUNTS):
            f = self.fits[a]
            z = math.sqrt(-2 * math.log(1 - self.u(who, rep, sim, mediation.NORMAL, 2 * i, *purpose))) * math.cos(2 * math.pi * self.u(who, rep, sim, mediation.NORMAL, 2 * i + 1, *purpose))
            has = income[k] in {"entgelt": ("earnings_only", "both"), "rtzb": ("pension_only", "both")}[a]
            s[f"current_{a}"] = max(0.0, math.expm1(min(f.cap[self.r], self.eta(a, s) + z * f.sd[self.r]))) if has else 0.0
        s["current_other_rehab"] = float(self.u(who, rep, sim, mediation.STATE, 0, *purpose) < self.chance("other_rehab", s))
        return s | {f"prior_{c}": s[f"current_{c}"] for c in ("income", "entgelt", "rtzb", "other_rehab")}

    def q(self, people, rep, sims):
        H = self.plan.horizon
        lives = [(base, who, sim) for base, who in people for sim in range(sims)]
        times, order = {}, {}
        for arm in (0, 1):
            times[arm] = []
            for base, who, sim in lives:
                s, time = dict(base), H + 1
                for t in range(1, H + 1):
                    s |= {"treated": arm, "follow_year": str(t), "mediator_prev": int(time < t)}
                    if time > H and self.u(who, rep, sim, mediation.MEDIATOR, arm, t) < self.chance("mediator", s):
                        time = t
                    s |= {"mediator_now": int(time <= t), "both": arm * int(time <= t)}
                    if t < H:
                        s = self.update(s, who, rep, sim, 0, arm, t)
                times[arm].append(time)
            order[arm] = [int(mediation.key(np.array([who], np.uint64), self.plan.seed, mediation.ORDER, arm, rep, np.array([sim]))[0]) >> 1 for _, who, sim in lives]
        given = {}
        for arm in (0, 1):
            given[arm] = [0] * len(lives)
            for sim in range(sims):
                own = [i for i, x in enumerate(lives) if x[2] == sim]
                for i, t in zip(sorted(own, key=lambda i: order[arm][i]), sorted(times[arm][i] for i in own)):
                    given[arm][i] = t
        out = {f"m{m}": np.mean([t <= H for t in given[m]]) for m in (0, 1)}
        for a in (0, 1):
            for m in (0, 1):
                risks = []
                for (base, who, sim), time in zip(lives, given[m]):
                    s, alive = dict(base), 1.0
                    for t in range(1, H + 1):
                        s |= {"treated": a, "follow_year": str(t), "mediator_prev": int(time < t), "mediator_now": int(time <= t), "both": a * int(time <= t)}
                        alive *= 1 - self.chance("death", s)
                        if t < H:
                            s = self.update(s, who, rep, sim, 1, 2 * a + m, t)
                    risks.append(1 - alive)
                out[f"q{a}{m}"] = np.mean(risks)
        return out


@pytest.fixture(scope="module")
def study(spark):
    if not Path(DATA).exists():
        pytest.skip("needs the test tables")
    return pairs.assignment(catalog._pairs(spark, DATA)), catalog._panel(spark, DATA), catalog._risk(spark, DATA)


def test_simulation_equals_a_plain_loop(spark, study, monkeypatch):
    plan = mediation.Plan(horizon=3, simulations=3, replicate_simulations=2, least_level=2)
    kept = {}
    real = mediation.simulate

    def spy(people, fits, plan, reps):
        kept.update(people=people.collect(), fits=fits, reps=reps, q=real(people.repartition(3), fits, plan, reps))
        return kept["q"]

    monkeypatch.setattr(mediation, "simulate", spy)
    mediation.mediation(*study, plan, 2, f"{catalog.models.root_of(spark)}/plain-{id(kept)}")[0].collect()
    assert kept["reps"] == [0, 1, 2] and set(kept["q"]) == {0, 1, 2}
    for i, rep in enumerate(kept["reps"]):
        people = []
        for r in kept["people"]:
            first = r.years[0]
            base = {c: r[c] for c in (*plan.numeric, *plan.binary)} | {c: batched.MISSING if r[c] is None else str(r[c]) for c in plan.categorical}
            base |= {f"prior_{c}": first[f"prior_{c}"] for c in ("income", "entgelt", "rtzb", "other_rehab")}
            for copy in range(r.weights[i]):
                people.append((base, int(mediation.key(np.array([r.match_group]), np.array([copy]))[0])))
        want = Plain(kept["fits"], plan, i).q(people, rep, plan.simulations if rep == 0 else plan.replicate_simulations)
        assert {k: round(v, 9) for k, v in kept["q"][rep].items()} == {k: round(v, 9) for k, v in want.items()}


def test_margins_equal_the_matrix():
    d = batched.Design({"n": (1.0, 2.0, 3.0, True), "m": (0.0, 1.0, 2.0, False)}, {"b": (1.0, True)}, {"c": ["b", batched.RARE], "year": ["2"]}, {"c": ["a", "b"], "year": ["1", "2"]})
    n = np.array([0.5, np.nan, 4.0, 1.0, 2.0])
    texts = np.array(["a", "b", "z", "b", "new"], object)
    coded = batched.Coded(np.array([2, 0, 1, 0, 3]), ["b", "z", "a", "new"])
    assert np.asarray(coded).tolist() == texts.tolist() and np.asarray(coded[n > 1]).tolist() == ["z", "new"]
    frame = {"n": n, "m": np.float64(3.0), "b": np.array([0, 1, np.nan, 1, 0.0]), "year": np.full(5, "2", object)}
    want = d.matrix(frame | {"c": texts}, 5)
    assert d.names() == ["intercept", "n", "n__missing", "m", "b", "b__missing", "c=b", f"c={batched.RARE}", "year=2"]
    assert want[:, 6].tolist() == [0, 1, 0, 1, 0] and want[:, 7].tolist() == [0, 0, 1, 0, 1] and want[:, 8].tolist() == [1] * 5
    b = np.arange(1.0, 10)
    for c in (texts, coded):
        for year in (np.full(5, "2", object), "2"):
            f = frame | {"c": c, "year": year}
            assert (d.matrix(f, 5) == want).all() and np.allclose(d.margin(f, 5, b), want @ b, rtol=1e-14)


def test_work_is_spread_over_all_cores(spark, study, monkeypatch):
    """The table has few bytes, which adaptive execution would put into one file and thus one task."""
    plan, found = mediation.Plan(horizon=3, simulations=2, replicate_simulations=1), []

    def seen(rows, models, plan, reps):
        found.extend(rows.groupBy(F.spark_partition_id()).count().collect())
        return spark.createDataFrame([], mediation.RESULT)

    members = study[0].withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("match_group", F.col("match_group") * 100 + F.col("copy")).drop("copy")
    monkeypatch.setattr(mediation, "replicates_of", seen)
    mediation.mediation(members, *study[1:], plan, 0)
    cores = spark.sparkContext.defaultParallelism
    assert len(found) == cores > 1 and max(r["count"] for r in found) < 1.5 * sum(r["count"] for r in found) / cores
    assert [mediation.spread(members, n, 10).rdd.getNumPartitions() for n in (5, 10 * cores, 10 * cores + 1)] == [cores, cores, 2 * cores]


def test_a_stopped_run_goes_on(spark, study, monkeypatch):
    plan = mediation.Plan(horizon=3, simulations=2, replicate_simulations=1, at_once=3)
    at = f"{catalog.models.root_of(spark)}/replicates-{id(plan)}"
    real, made = mediation.replicates_of, []

    def once(rows, models, plan, reps):
        if made:
            raise RuntimeError("stopped")
        made.append(reps)
        return real(rows, models, plan, reps)

    with monkeypatch.context() as m:
        m.setattr(mediation, "replicates_of", once)
        with pytest.raises(RuntimeError, match="stopped"):
            mediation.mediation(*study, plan, 4, at)
    monkeypatch.setattr(mediation, "replicates_of", lambda *a: (made.append(a[3]), real(*a))[1])
    effects, models = mediation.mediation(*study, plan, 4, at)
    assert made == [[0, 1, 2], [3, 4]]
    # replicates don't depend on their portion, and other parameters have replicates of their own
    whole = mediation.mediation(*study, replace(plan, at_once=30), 4, at)
    assert made[2:] == [[0, 1, 2, 3, 4]]
    key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert key(effects) == key(whole[0]) and key(models) == key(whole[1])
    rows = {r.effect: r for r in effects.collect()}
    assert rows["total"].replicates == 4 and rows["total"].ci_low <= rows["total"].ci_high
    assert math.isclose(rows["total"].value, rows["direct"].value + rows["indirect"].value, abs_tol=1e-12)
    assert {r.method for r in models.collect()} <= {"constant", "least squares", *(m for _, m in batched.LADDER)}


def test_no_pairs_no_effects(spark, study):
    members, panel, risk = study
    effects, models = mediation.mediation(members.filter("false"), panel, risk, replicates=2)
    assert effects.collect() == [] and models.collect() == []
