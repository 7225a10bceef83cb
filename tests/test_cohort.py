import itertools
import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import CohortConfig, changes, rebuild_from
from tessera.functions import exprs, features, stats
from tessera.operators import design, disclosure, followup, gcomp, models, pairs, panel
from tessera.plans import catalog
from tessera.plans.run import Run
from tessera.sources import align, files

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else int(v) if isinstance(v, bool) else v
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns, name
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key), name


def test_every_query_without_sql_is_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"hash_partition_sample", "propensity_fit", "optimal_match", "hazard_logit", "cluster_bootstrap_ci", "gap_sensitivity", "gcomp_decomposition", "gcomp_simulated", "group_contrasts_released", "group_effects_released", "hazard_adjusted", "landmark_mediation", "mediation_effects", "pretrend_wald", "subgroup_contrasts"}


def best_matching(t, c, caliper):
    best = (0, 0.0)
    for k in range(min(len(t), len(c)), 0, -1):
        costs = [sum(abs(t[i] - c[j]) for i, j in zip(a, b)) for a in itertools.combinations(range(len(t)), k) for b in itertools.permutations(range(len(c)), k) if all(abs(t[i] - c[j]) <= caliper for i, j in zip(a, b))]
        if costs:
            return k, min(costs)
    return best


def test_matching_is_optimal():
    rng = random.Random(1)
    for _ in range(150):
        t, c = (np.array(sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 4))), float) for _ in range(2))
        c = np.sort(np.append(c, rng.randint(0, 30)))
        got = pairs.solve(t, c, 5)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert all(abs(t[i] - c[j]) <= 5 for i, j in got)
        assert (len(got), sum(abs(t[i] - c[j]) for i, j in got)) == best_matching(t, c, 5)


def dense(t, c, caliper):
    """Number and total distance by the whole table."""
    best = [[(0, 0)] * (len(c) + 1) for _ in range(len(t) + 1)]
    for i, x in enumerate(t):
        for j, y in enumerate(c):
            ways = [best[i][j + 1], best[i + 1][j]]
            if abs(x - y) <= caliper:
                ways.append((best[i][j][0] + 1, best[i][j][1] - abs(x - y)))
            best[i + 1][j + 1] = max(ways)
    n, d = best[-1][-1]
    return n, -d


def test_windowed_matching_equals_the_whole_table():
    rng = np.random.default_rng(2)
    for case in range(120):
        top = int(rng.choice((20, 300, 5000)))
        t, c = (np.sort(rng.integers(0, top, int(rng.integers(0, n)))) for n in (60, 90))
        for caliper in (0, 3, 40):
            got = pairs.solve(t, c, caliper)
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and got == sorted(got)
            assert all(abs(t[i] - c[j]) <= caliper for i, j in got)
            assert (len(got), sum(abs(int(t[i] - c[j])) for i, j in got)) == dense(t.tolist(), c.tolist(), caliper)
    # 100,000 x 200,000 rows, with 20 million pairs within the caliper
    t, c = np.sort(rng.integers(0, 10**6, 100_000)), np.sort(rng.integers(0, 10**6, 200_000))
    got = pairs.solve(t, c, 500)
    assert len(got) == 100_000 and len({j for _, j in got}) == len(got)


def test_edges(spark):
    rng = random.Random(8)
    rows = [(i, 1998 + i % 2, int(rng.random() < 0.4), rng.choice((1, None)), rng.choice((0, None)), rng.choice((None, *range(-30, 90)))) for i in range(200)]
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long")
    for caliper in (0, 1, 7, 500):
        want = sorted((a[0], b[0], abs(a[5] - b[5])) for a in rows for b in rows if a[2] == 1 and b[2] == 0 and a[1] == b[1] and a[3:5] == b[3:5] and None not in (a[5], b[5]) and abs(a[5] - b[5]) <= caliper)
        assert sorted((r.t_id, r.c_id, r.distance) for r in pairs.edges(df, caliper).collect()) == want


def test_no_control_twice(spark):
    rows = [(i, t0, int(i < 20), 1, 0, 1000 * (i % 37)) for t0 in (1998, 1999) for i in range(60)]
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long")
    got = pairs.match_without_reuse(df, models.save).collect()
    assert got and len({r.c_id for r in got}) == len(got) and all(r.distance <= pairs.CALIPER for r in got)
    assert pairs.match_without_reuse(df.filter("false"), models.save) is None


def test_matching_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, t0, int(i < 15), 1, 0, rng.randrange(60_000)) for t0 in (1998, 1999, 2000) for i in range(60)]
    schema = "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long"
    df, kept = spark.createDataFrame(rows, schema), files.Checkpoint(spark, f"{tmp_path}/years", "same")
    want = sorted(map(tuple, pairs.match_without_reuse(df, models.save).select("t_id", "c_id", "t0", "distance").collect()))
    real, matched = pairs.match_year, []

    def once(left, caliper, strata):
        if len(matched) == 2:
            raise RuntimeError("stopped")
        matched.append(left.first().t0)
        return real(left, caliper, strata)

    with monkeypatch.context() as m:
        m.setattr(pairs, "match_year", once)
        with pytest.raises(RuntimeError):
            pairs.match_without_reuse(df, models.save, kept=kept)
    assert kept.done() == [1998, 1999]
    monkeypatch.setattr(pairs, "match_year", lambda left, caliper, strata: (matched.append(left.first().t0), real(left, caliper, strata))[1])
    got = pairs.match_without_reuse(df, models.save, kept=kept)
    assert matched == [1998, 1999, 2000] and sorted(map(tuple, got.select("t_id", "c_id", "t0", "distance").collect())) == want
    changed = df.withColumn("score_ppm", F.when(F.col("simple_id") == 20, 1).otherwise(F.col("score_ppm")))
    with pytest.raises(ValueError, match="1998"):
        pairs.match_without_reuse(changed, models.save, kept=kept)


def test_candidates_keep_the_best_matching(spark):
    """Each t0 is a case of its own: the reduced and split strata give the count and distance of the whole ones."""
    rng, rows, want = random.Random(4), [], {}
    for case in range(60):
        scores = {a: [rng.randint(0, rng.choice((25, 120))) for _ in range(rng.randint(0, n))] for a, n in ((1, 6), (0, 60))}
        rows += [(i + 1000 * (1 - a), case, a, None if case % 2 else 1, 0, v) for a in (0, 1) for i, v in enumerate(scores[a])]
        t, c = (np.array(sorted(scores[a]), float) for a in (1, 0))
        got = pairs.solve(t, c, 5)
        want[case] = (len(got), sum(abs(t[i] - c[j]) for i, j in got))
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long")
    found = {r.t0: (r.n, r.d) for r in pairs.match_year(df, 5).groupBy("t0").agg(F.count("*").alias("n"), F.sum("distance").alias("d")).collect()}
    assert {k: v for k, v in want.items() if v[0]} == found
    left = pairs.candidates(df, 5)
    assert left.filter("treated = 1").count() == df.filter("treated = 1").count() and left.filter("treated = 0").count() < df.filter("treated = 0").count() / 2


def test_dense_scores_take_near_linear_time(spark):
    """All scores within one caliper: 16 billion pairs in one stratum."""
    rng = np.random.default_rng(6)
    t, c = (np.sort(rng.integers(0, 10_000, n)) for n in (40_000, 400_000))
    began = time.process_time()
    got = pairs.solve(t, c, 10_000)
    assert len(got) == 40_000 and time.process_time() - began < 20
    # there are ten controls of each score for each treated one, and where there are few, a split problem equals the whole one
    rows = [(i, 1998, int(i % 11 == 0), 1, 0, int(rng.integers(0, 2000)) * (5 if i % 11 else 4)) for i in range(6000)]
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, lag1_ge int, lag1_ever_rehab int, score_ppm long")
    left = {bundle: pairs.candidates(df, 10_000, bundle=bundle).collect() for bundle in (1, 100)}
    treated = sum(r[2] for r in rows)
    assert len(left[1]) == len(left[100]) <= 3 * treated and len({r.part for r in left[1]}) > treated / 4 > len({r.part for r in left[100]}) > 3
    scores = lambda found, arm: np.array(sorted(r.score_ppm for r in found if r.treated == arm))
    cost = lambda t, c: (len(got := pairs.solve(t, c, 10_000)), sum(abs(int(t[i] - c[j])) for i, j in got))
    whole = cost(*(np.array(sorted(r[5] for r in rows if r[2] == arm)) for arm in (1, 0)))
    for found in left.values():
        each = [cost(*(scores([r for r in found if r.part == p], arm) for arm in (1, 0))) for p in {r.part for r in found}]
        assert tuple(map(sum, zip(*each))) == whole


def people(spark, spec):
    rows, k = [], 0
    for code, n in spec:
        for _ in range(n):
            rows.append((k, "s", code))
            k += 1
    return spark.createDataFrame(rows, "simple_id long, seg string, code string")


def test_pooling(spark):
    run = lambda spec, k: {r.code: (r.people, r.codes) for r in disclosure.pool_small(people(spark, spec), ["seg"], "code", k).collect()}
    assert run([("A", 6), ("B", 4), ("C", 2), ("D", 2)], 3) == {"A": (6, 1), "B": (4, 1), "pooled": (4, 2)}
    assert run([("A", 6), ("B", 4), ("C", 1)], 3) == {"A": (6, 1), "pooled": (5, 2)}
    assert run([("A", 6), ("C", 1), ("D", 1)], 4) == {"A": (6, 1), "pooled": (None, 2)}
    assert run([("A", 6), ("C", 1), ("D", 1)], 0) == {"A": (6, 1), "C": (1, 1), "D": (1, 1)}


def test_suppression(spark):
    df = spark.createDataFrame([(7, "701", 3), (7, "781", 100), (8, "853", 50)], "grp int, cell string, value long")
    assert {r.cell: r.status for r in disclosure.protect(df, ["grp"], "cell", "value", 20).collect()} == {"701": "withheld", "781": "complement", "853": "reported"}


def test_shards_align_and_dedup(spark, tmp_path):
    a = spark.createDataFrame([(1, 2011, "781", 1.0), (1, 2011, "853", 10.0), (2, 2011, "555", 10.0), (3, 2011, None, 10.0)], "simple_id long, ja int, job string, earn double")
    c = spark.createDataFrame([(1, "2011.0", 911, 10), (2, "2011", 666, None)], "simple_id int, ja string, job int, earn int")
    for name, df in (("a", a), ("b", c)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    files = [str(p) for d in ("a", "b") for p in Path(tmp_path, d).glob("*.parquet")]
    union = align.schema_union(spark, files)
    assert set(union) == {"simple_id", "ja", "job", "earn"}
    files = sorted(files)
    got = align.scan_aligned(spark, files)
    assert got.count() == 6 and got.filter("ja = 2011").count() == 6
    one = {r.simple_id: r.job for r in panel.dedup(got, ["simple_id", "ja"], ["src_file", "src_row"]).collect()}
    assert one[1] in ("781", "911")  # complete rows tie; the first file by path wins
    assert one[2] == "555"
    assert set(align.scan_aligned(spark, files, ["simple_id", "absent"]).columns) == {"simple_id", "absent", "src_file", "src_row"}


def test_competing_risks(spark):
    rows = [(1, 1, 1)] * 10 + [(1, 1, 2)] * 20 + [(1, 1, 0)] * 70 + [(1, 2, 1)] * 7 + [(1, 2, 0)] * 63
    df = spark.createDataFrame(rows, "treated int, follow_year int, event_type int")
    got = {r.follow_year: round(r.cif, 9) for r in followup.incidence(df).collect()}
    assert got == {1: 0.1, 2: 0.17}


def test_survival_can_reach_zero(spark):
    df = spark.createDataFrame([(1, 1, 4, 1), (1, 2, 3, 3), (1, 3, 1, 0)], "treated int, follow_year int, n int, d int")
    assert [round(r.surv, 9) for r in followup.survival(df, F.col("d") / F.col("n")).orderBy("follow_year").collect()] == [0.75, 0.0, 0.0]


def test_expressions(spark):
    df = spark.createDataFrame([("2001-02-03",), ("03.02.2001",), ("20010203",), ("20010203.0",), ("00000000",), ("",), ("2001-13-40",), (None,), ("x",)], "t string")
    assert [str(r[0]) for r in df.select(exprs.normal_date(F.col("t"))).collect()] == ["2001-02-03"] * 4 + ["None"] * 5
    codes = spark.createDataFrame([("20.0",), ("20",), ("x",), (None,)], "c string")
    assert [r[0] for r in codes.select(exprs.code_in(F.col("c"), [20])).collect()] == [True, True, False, False]
    ages = spark.createDataFrame([(19,), (20,), (24,), (89,), (90,), (None,)], "a int")
    assert [r[0] for r in ages.select(exprs.age_band(F.col("a"))).collect()] == ["<20", "20-24", "20-24", "85-89", "90+", None]
    jobs = spark.createDataFrame([(11,), (781,), (0,), (555,), (None,), (12345,), (4,)], "c int")
    assert [r[0] for r in jobs.select(features.decode_occupation(F.col("c"), {11: "a", 781: "b"}, [555, 666])).collect()] == ["known", "known", "zero", "special", "__MISSING__", "invalid_width", "unknown"]
    none = spark.createDataFrame([], "x int")
    assert none.agg(exprs.sum0("x"), exprs.any_true(F.col("x") > 1)).first() == (0, False)


def test_relabel_equals_rebuild(spark):
    if not Path(DATA).exists():
        pytest.skip("needs the test tables")
    from tessera.sources.bindings import person_years

    raw = person_years(spark, DATA)
    one, two = panel.relabel(panel.build(raw), [20, 30]), panel.build(raw, [20, 30])
    assert one.select(two.columns).exceptAll(two).count() == 0 == two.exceptAll(one.select(two.columns)).count()


def pivots(x, always):
    """Column exchange by Gram-Schmidt on the rows themselves."""

    def run(first=None):
        left, chosen, size = x.astype(float).copy(), [], (x.astype(float) ** 2).sum(0)
        while True:
            rest = (left**2).sum(0)
            rest[chosen] = 0
            j = first if first is not None and not chosen else int(np.argmax(rest))
            if rest[j] <= 1e-9 * max(size[j], 1e-300):
                return chosen
            chosen.append(j)
            q = left[:, j] / np.sqrt(rest[j])
            left = left - np.outer(q, q @ left)

    chosen = run()
    if always not in chosen:
        chosen[-1] = always
        if np.linalg.matrix_rank(x[:, chosen]) < len(chosen):
            chosen = run(always)
    return sorted(chosen)


def test_rank_reduction_by_pivots():
    rng = np.random.default_rng(5)
    for case in range(60):
        n, k = 40, int(rng.integers(3, 9))
        x = rng.normal(size=(n, k)) * rng.choice((0.1, 1, 20), k)
        x[:, 0] = 1
        for _ in range(int(rng.integers(0, 4))):
            a, b, c = rng.integers(0, k, 3)
            x[:, a] = x[:, b] * 2 - 0.7 * x[:, c] if a not in (0, b, c) else x[:, a]
        got = design.pivoted(x.T @ x, 1)
        assert got == pivots(x, 1) and 1 in got and np.linalg.matrix_rank(x[:, got]) == len(got) == np.linalg.matrix_rank(x)
    x = np.stack([np.ones(9), np.arange(9.0), np.full(9, 7.0), np.zeros(9)], 1)
    assert design.unvaried(x.T @ x) == (2, 3) and design.pivoted(x.T @ x, 1, (2, 3)) == [0, 1]


def test_hazard_model(spark):
    """One year, no clusters: the odds ratio is that of the two-by-two table."""
    rows = [(i, 1, 1, int(i < 30)) for i in range(100)] + [(i, 0, 1, int(i < 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "match_group long, treated int, follow_year int, event_type int")
    got = {r.term: r for r in models.hazard(df).collect()}
    assert abs(got["treated"].odds_ratio - (30 / 70) / (10 / 90)) < 1e-5 and got["treated"].se > 0


def test_propensity_pools_rare_levels(spark):
    """Levels of under ten rows share one flag: they get one score, as do unseen and null levels of their own."""
    rng = random.Random(12)
    rows = [(i, 1998, int(rng.random() < (0.6 if i % 3 == 0 else 0.2)), ["a", "b", None][i % 3] if i > 12 else f"rare{i % 3}", 1, 0) for i in range(600)]
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, job string, flag int, lag1_ever_rehab int")
    run = lambda least: models.propensity(df, numbers=(), binary=("flag",), categories=("job",), least=least, keep=("job",)).select("job", F.round("pscore", 9).alias("p")).distinct().collect()
    pooled, apart = ({r.job: r.p for r in run(n)} for n in (10, 1))
    assert len(pooled) == len(apart) == 6 and len(set(pooled.values())) == 4 and pooled["rare0"] == pooled["rare1"] == pooled["rare2"]
    assert len(set(apart.values())) > 4 and pooled["a"] > pooled["b"] + 0.2
    assert models.propensity(df.filter("treated = 0"), numbers=(), categories=(), keep=()) is None
    numbers = df.withColumn("age", F.when(F.col("simple_id") % 5 > 0, F.col("simple_id") % 50))
    assert models.propensity(numbers, numbers=("age",), categories=(), keep=()).filter("pscore > 0 and pscore < 1").count() == 600


def test_adjusted_model(spark):
    """Against Newton steps and the sandwich over all rows, with a constant, a doubled and a missing-flagged column."""
    rng, rows = random.Random(9), []
    for i in range(400):
        age = rng.choice((None, 30.0, 41.0, 55.5, 60.0))
        for a in (0, 1):
            for y in (1, 2):
                rows.append((i, a, y, age, rng.choice((0.0, 10.0, 500.0)), rng.choice((0, 1, None)), rng.choice(("a", "b", None)), int(rng.random() < 0.15 + 0.2 * a)))
    df = spark.createDataFrame([(*r, r[3], 7) for r in rows], "match_group long, treated int, follow_year int, age double, pay double, flag int, kind string, y int, age2 double, same int")
    got = {r.term: r for r in design.logit(df, "y", design.columns(df, ["age", "age2", "same"], ["pay"], ["flag"], ["kind"])).collect()}
    assert set(got) == {"intercept", "treated", "year_2", "age", "pay", "flag", "age_missing", "flag_missing", "kind_a", "kind_b"}
    ages = [r[3] for r in rows if r[3] is not None]
    flags = [r[5] for r in rows if r[5] is not None]
    mode = min((0, 1), key=lambda v: (-flags.count(v), v))
    z = lambda v: (v - v.mean()) / v.std()
    col = lambda f: np.array([float(f(r)) for r in rows])
    x = np.stack([col(lambda r: 1), col(lambda r: r[1]), col(lambda r: r[2] == 2), z(col(lambda r: np.median(ages) if r[3] is None else r[3])), z(col(lambda r: math.log1p(r[4]))), col(lambda r: mode if r[5] is None else r[5]), col(lambda r: r[3] is None), col(lambda r: r[5] is None), col(lambda r: r[6] == "a"), col(lambda r: r[6] == "b")], 1)
    y, g, b = col(lambda r: r[7]), np.array([r[0] for r in rows]), np.zeros(10)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    s = np.array([(x * (y - p)[:, None])[g == v].sum(0) for v in np.unique(g)])
    cov = np.linalg.inv(h) @ (s.T @ s) @ np.linalg.inv(h) * 400 / 399 * (len(y) - 1) / (len(y) - 10)
    for i, name in enumerate(("intercept", "treated", "year_2", "age", "pay", "flag", "age_missing", "flag_missing", "kind_a", "kind_b")):
        assert abs(got[name].coefficient - b[i]) < 1e-6 and abs(got[name].se - cov[i, i] ** 0.5) < 1e-6, name
    assert got["treated"].method == "newton" and got["treated"].p < 0.01
    alone = df.withColumn("y", F.col("treated"))
    # no finite maximum: the first rung that settles, and the treatment's limits from resampled clusters
    terms = {r.term: r for r in design.logit(alone, "y", design.columns(alone), replicates=30).collect()}
    assert {r.method for r in terms.values()} == {"ridge C=1e4, bootstrap"}
    assert terms["treated"].ci_low > 100 and terms["treated"].se is not None and terms["year_2"].se is None
    # fewer clusters than columns: the same, of an ordinary fit
    few = design.logit(df.filter("match_group < 5"), "y", {"intercept": F.lit(1.0), "treated": F.col("treated").cast("double"), **{f"z{i}": F.hash("match_group", F.lit(i)) / 2.0**31 for i in range(4)}}, replicates=40)
    assert {r.method.split(", ")[-1] for r in few.collect()} == {"bootstrap"}
    assert design.logit(df.filter("false"), "y", {"intercept": F.lit(1.0)}).count() == 0
    with pytest.raises(ValueError):
        wide = spark.range(3000).select(F.col("id").alias("match_group"), F.lit(1).alias("treated"), F.lit(1).alias("follow_year"), F.col("id").cast("string").alias("k"))
        design.columns(wide, categorical=["k"])


def test_bootstrap_and_partitions(spark):
    rows = [(i, a, 1, int((i * 7 + a) % 5 == 0)) for i in range(200) for a in (0, 1)]
    df = spark.createDataFrame(rows, "match_group long, treated int, follow_year int, event_type int")
    one, two = models.bootstrap_risk_difference(df, 50).first(), models.bootstrap_risk_difference(df.repartition(7), 50).first()
    assert abs(one.ci_low - two.ci_low) < 1e-12 and one.ci_low <= one.risk_difference <= one.ci_high


def test_contrasts(spark):
    rng = random.Random(2)
    rows = [(i, a, 1, int(rng.random() < (0.5 if a and i % 3 == 2 else 0.1)), i % 3) for i in range(900) for a in (0, 1)]
    df = spark.createDataFrame(rows, "match_group long, treated int, follow_year int, event_type int, grp int")
    got = {r.grp: r for r in models.contrasts(df, "grp", 100).collect()}
    assert set(got) == {1, 2} and got[2].estimate > 0.25 and got[2].p_holm < 0.01 and got[1].p > 0.01
    for r in got.values():
        assert abs(r.p - stats.normal_two_sided(r.estimate / r.se)) < 1e-6 and r.p_holm >= r.p and r.ci_low <= r.estimate <= r.ci_high


def test_tails():
    assert abs(stats.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    for x in (0.1, 1.0, 5.0, 30.0):
        assert abs(stats.chi2_tail(x, 2) - math.exp(-x / 2)) < 1e-12 and abs(stats.chi2_tail(x, 1) - stats.normal_two_sided(math.sqrt(x))) < 1e-12


def test_pretrend(spark):
    """With one early year the Wald statistic is the squared estimate over its variance."""
    rng = random.Random(3)
    rows = [(g, 1998, t, 0, 0, rng.choice((-1, 0, 0, 1, 1))) for g in range(80) for t in (-2, -1, 0, 1)]
    df = spark.createDataFrame(rows, "match_group long, t0 int, event_time int, treated_rehab int, control_rehab int, pair_diff int")
    one = {r.event_time: r for r in followup.event_study(df).collect()}[-2]
    got = followup.pretrend(df).first()
    assert got.df == 1 and abs(got.chi2 - (one.estimate / one.se) ** 2) < 1e-9


def test_simulated_decomposition(spark):
    """Treatment brings the mediator, and the mediator alone brings the outcome: the effect is indirect."""
    rng, rows = random.Random(6), []
    for i in range(1500):
        treated, had = i % 2, 0
        for t in (1, 2, 3):
            new = int(not had and rng.random() < (0.5 if treated else 0.1))
            now = max(had, new)
            rows.append((i, 2000, treated, 40 + i % 20, t, None, had, new, now, int(rng.random() < (0.3 if now else 0.05))))
            had = now
    df = spark.createDataFrame(rows, "simple_id long, t0 int, treated int, age int, follow_year int, gap_year int, mediator_before int, mediator_new int, mediator_now int, y int")
    got = {r.effect: r.value for r in gcomp.simulate(df, 3, simulations=10).collect()}
    assert got["total"] > 0.15 and abs(got["direct"]) < 0.07 and got["proportion"] > 0.7
    again = {r.effect: r.value for r in gcomp.simulate(df.repartition(5), 3, simulations=10).collect()}
    assert all(abs(got[k] - again[k]) < 1e-4 for k in got)
    assert all(r.value is None for r in gcomp.simulate(df.filter("false")).collect())


def test_landmark(spark):
    """Without covariates the logits are saturated, so the effects are those of plain cell means."""
    rng, members, years = random.Random(8), [], []
    for i in range(800):
        a = i % 2
        m = int(rng.random() < (0.5 if a else 0.2))
        dead = rng.random() < (0.4 if m else 0.1)
        members.append((i // 2, 2000, i, a))
        if i != 7:
            years.append((i, 2001, m, (2002 if dead else None) if i != 11 else 2001))
    df = spark.createDataFrame(members, "match_group long, t0 int, simple_id long, treated int")
    panel_ = spark.createDataFrame(years, "simple_id long, ja int, msk int, death_year int")
    got = {r.effect: r.value for r in gcomp.landmark(df, panel_).collect()}
    kept = [(i % 2, m, d == 2002) for i, _, m, d in years if i // 2 not in (3, 5)]
    mean = lambda v: sum(v) / len(v)
    p = {a: mean([m for b, m, _ in kept if b == a]) for a in (0, 1)}
    r = {(a, m): mean([y for b, n, y in kept if (b, n) == (a, m)]) for a in (0, 1) for m in (0, 1)}
    q = lambda a, b: p[b] * r[a, 1] + (1 - p[b]) * r[a, 0]
    want = {"y0_m0": q(0, 0), "y1_m0": q(1, 0), "y1_m1": q(1, 1), "total": q(1, 1) - q(0, 0), "direct": q(1, 0) - q(0, 0), "indirect": q(1, 1) - q(1, 0)}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-4 for k, v in want.items())
    assert all(r.value is None for r in gcomp.landmark(df.filter("false"), panel_).collect())


def test_runs(spark, tmp_path):
    made, raw = [], f"{tmp_path}/raw"
    spark.range(5).coalesce(1).write.parquet(raw)

    def stages(run):
        step = lambda name, tier, f: run.stage(name, tier, lambda: made.append(name) or f())
        p = step("panel", 0, lambda: spark.read.parquet(raw))
        m = step("pairs", 2, lambda: p.filter("id > 1"))
        return step("curves", 3, lambda: m.selectExpr("count(*) AS n")).first().n

    start = lambda protect=False, **c: Run(spark, CohortConfig(output_dir=f"{tmp_path}/out", **c), [raw], protect)
    assert stages(start()) == 3 and made == ["panel", "pairs", "curves"]
    made.clear()
    assert stages(start()) == 3 and made == []
    assert stages(start(smd_threshold=0.2)) == 3 and made == ["curves"]
    with pytest.raises(ValueError):
        start(True, smd_threshold=0.2, caliper=0.02)
    made.clear()
    run = start(smd_threshold=0.2, caliper=0.02)
    assert stages(run) == 3 and made == ["pairs", "curves"]
    run.check_inputs()
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(raw)
    with pytest.raises(RuntimeError):
        run.check_inputs()
    made.clear()
    last = start(smd_threshold=0.2, caliper=0.02)
    assert stages(last) == 7 and made == ["panel", "pairs", "curves"]
    last.clear()
    assert not Path(tmp_path, "out", "sample").exists()
    for inside in (f"{tmp_path}/out/sample/raw", f"{tmp_path}"):
        with pytest.raises(ValueError):
            Run(spark, CohortConfig(output_dir=f"{tmp_path}/out"), [inside])


def test_config():
    assert CohortConfig.from_yaml("lag_depth: 3\nmsk_codes: [20]").lag_depth == 3
    for bad in ({"lag_depth": 2}, {"caliper": 0}, {"msk_codes": (30,)}, {"outcome_bootstrap": 5}, {"sample_tag": "a/b"}, {"year_cap": 2022}):
        with pytest.raises(ValueError):
            CohortConfig(**bad)
    with pytest.raises(ValueError):
        CohortConfig.from_yaml("nonsense: 1")
    a, c = CohortConfig().as_dict(), CohortConfig(caliper=0.02, smd_threshold=0.2).as_dict()
    assert changes(a, c) == {"caliper": 2, "smd_threshold": 3} and rebuild_from(a, c) == 2 and rebuild_from(a, a) is None
    with pytest.raises(ValueError):
        rebuild_from(a, c, protect_matching=True)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_mediation_grid_covers_the_risk_set(spark):
    """All persons of the risk set have a row a year, as in the table that the SQL of both grid queries stands on."""
    import duckdb

    from tessera.plans import sql

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(f"WITH {sql.BIND} SELECT * FROM med")
    columns = [c[0] for c in want.description]
    got = catalog.queries()["mediation_grid"](spark, DATA).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    whole = {(r.simple_id, r.t0) for r in catalog._risk(spark, DATA).collect()}
    assert {(r.simple_id, r.t0) for r in got} == whole and len(got) == catalog.HORIZON * len(whole)
