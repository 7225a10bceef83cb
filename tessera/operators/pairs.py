"""Scores, matched pairs, balance and descriptive statistics."""

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.sources.files import Checkpoint, fingerprint

STRATA = ["t0", "lag1_ge", "lag1_ever_rehab"]
CALIPER = 10_000  # in millionths
NUMBERS = ("lag1_age", "lag1_entgelt", "lag1_rtzb", "lag1_cum_rehab")


def score(risk: DataFrame) -> DataFrame:
    """A fixed logistic formula, clipped, in millionths, so that both engines agree."""
    eta = -4 + 0.03 * F.col("lag1_age") + 0.5 * F.col("lag1_ever_rehab") + 0.2 * F.col("lag1_ge")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-eta))))
    return risk.withColumn("score_ppm", F.round(p * 1e6).cast("long"))


def caliper_edges(scored: DataFrame, caliper: int = CALIPER, strata: list[str] = STRATA) -> DataFrame:
    """Number of treated-control edges within the caliper by stratum: a range window over distinct scores, no pairs."""
    arms = scored.groupBy(*strata, "score_ppm").agg(F.sum("treated").alias("t"), F.sum(1 - F.col("treated")).alias("c"))
    w = Window.partitionBy(*strata).orderBy("score_ppm").rangeBetween(-caliper, caliper)
    near = arms.withColumn("near", F.sum("c").over(w))
    return near.groupBy(*strata).agg(F.sum("t").alias("n_treated"), F.sum("c").alias("n_controls"), F.sum(F.col("t") * F.col("near")).alias("n_edges"), F.sum(F.when(F.col("near") > 0, F.col("t")).otherwise(0)).alias("n_matchable")).filter("n_treated > 0")


def rank_pairs(risk: DataFrame) -> DataFrame:
    """Deterministic pairs for downstream tables: the k-th treated with the k-th control of its stratum, by id."""
    w = Window.partitionBy(*STRATA, "treated").orderBy("simple_id")
    ranked = risk.select(*STRATA, "treated", "simple_id", F.row_number().over(w).alias("k"))
    t = ranked.filter("treated = 1").select(*STRATA, "k", F.col("simple_id").alias("t_id"))
    c = ranked.filter("treated = 0").select(*STRATA, "k", F.col("simple_id").alias("c_id"))
    c = c.select("c_id", *(F.col(k).alias(f"_{k}") for k in (*STRATA, "k")))
    return t.join(c, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*STRATA, "k")]).select((F.col("t_id") * 10_000 + F.col("t0")).alias("match_group"), "t0", "t_id", "c_id")


def assignment(pairs: DataFrame) -> DataFrame:
    arm = lambda c, v: pairs.select("match_group", "t0", F.col(c).alias("simple_id"), F.lit(v).alias("treated"))
    return arm("t_id", 1).unionByName(arm("c_id", 0))


def edges(scored: DataFrame, caliper: int = CALIPER, strata: list[str] = STRATA) -> DataFrame:
    """strata keys, t_id, c_id, distance: every treated and control row of a stratum (null-safe) whose scores are within the caliper.

    Scores fall into cells as wide as the caliper, so a treated row meets the controls of its own cell and of both neighbours only:
    an equi-join by stratum and cell, with no product of a stratum.  Both sides are plain exchanges, which adaptive execution
    splits where a cell is hot.
    """
    cell = F.floor(F.col("score_ppm") / F.lit(max(1, caliper)))
    own = scored.select(*strata, "treated", "simple_id", "score_ppm")
    near = F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")
    t = own.filter("treated = 1").select(*strata, F.col("simple_id").alias("t_id"), F.col("score_ppm").alias("_t"), near)
    keys = [F.col(k).alias(f"_{k}") for k in strata]
    c = own.filter("treated = 0").select(*keys, F.col("simple_id").alias("c_id"), F.col("score_ppm").alias("_c"), cell.alias("_own"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in strata] + [F.col("_cell") == F.col("_own")]
    distance = F.abs(F.col("_t") - F.col("_c"))
    return t.join(c, same).withColumn("distance", distance).filter(F.col("distance") <= caliper).select(*strata, "t_id", "c_id", "distance")


class _Slopes:
    """Slopes of one side of a concave function on whole numbers, nearest to 0 last: sorted keys, how many of each, their total."""

    def __init__(self):
        self.keys, self.counts, self.total = [], [], 0

    def add(self, key, n: int) -> None:
        if n:
            i = bisect_left(self.keys, key)
            if i < len(self.keys) and self.keys[i] == key:
                self.counts[i] += n
            else:
                self.keys.insert(i, key)
                self.counts.insert(i, n)
            self.total += n

    def take(self, most: int) -> tuple:
        """(key, number) of the slope nearest to 0, at most so many of it"""
        key, n = self.keys[-1], min(most, self.counts[-1])
        self.counts[-1] -= n
        if not self.counts[-1]:
            self.keys.pop()
            self.counts.pop()
        self.total -= n
        return key, n

    def above(self, key) -> int:
        return sum(self.counts[bisect_right(self.keys, key) :])

    def keep(self, most: int) -> None:
        """Only so many, those nearest to 0."""
        gone, over = 0, self.total - most
        if over <= 0:
            return
        while over and self.counts[gone] <= over:
            over -= self.counts[gone]
            gone += 1
        del self.keys[:gone], self.counts[:gone]
        if over:
            self.counts[0] -= over
        self.total = most


def taken(score: np.ndarray, t: np.ndarray, c: np.ndarray, caliper: float) -> tuple[np.ndarray, np.ndarray]:
    """How many treated and how many controls of each of the distinct, ascending scores a best matching pairs: t and c are their
    numbers there, and the i-th treated one taken goes with the i-th control taken.

    Best is the most pairs within the caliper, then the least total distance.  Between two scores, a best matching has k treated
    waiting for controls further right, or -k controls waiting for treated ones, never both, and the distance between the scores
    costs |k| times.  Those that wait can be the latest of their arm, as a nearer one is never worse, so k is at most the number
    of them within the caliper.  The value of each k so far is a concave function: a treated one adds a slope of `big` (its loss
    if it is left out), a control one of 0, and a distance lowers the slopes of k > 0 and raises the others.  Its greatest
    places, kept for each score, give the way back.  Time is that of sorting, times the slopes of a caliper to shift in a list.
    """
    whole = score.dtype.kind in "iu"
    if whole:
        score = score.astype(np.int64)
    before = lambda n: (sums := np.concatenate([[0], np.cumsum(n)]))[:-1] - sums[np.searchsorted(score, score - caliper, "left")]
    most_t, most_c = before(t).tolist(), before(c).tolist()
    big = (int(t.sum()) + 1) * (int(caliper) + 1) * 2 if whole else (int(t.sum()) + 1) * (caliper + 1e-9) * 2
    # the value of a slope is its key on the right, and minus its key on the left, with the distance so far taken off or put on
    left, right, last, places = _Slopes(), _Slopes(), None, []
    origin = score[0].item() if len(score) else 0
    for at, nt, nc, mt, mc in zip(score.tolist(), t.tolist(), c.tolist(), most_t, most_c):
        far = at - origin
        right.keep(mt)
        left.keep(mc)
        free, full = right.above(far) if nc else 0, 0
        moved = 0
        while moved < nc and right.keys and right.keys[-1] > far:
            key, n = right.take(nc - moved)
            left.add(far - (key - far), n)
            moved += n
        left.add(far, nc - moved)
        right.add(far, moved)
        if nt:
            full, moved = -left.above(far - big), 0
            while moved < nt and left.keys and left.keys[-1] > far - big:
                key, n = left.take(nt - moved)
                right.add(far + (far - key), n)
                moved += n
            right.add(far + big, nt - moved)
            left.add(far - big, moved)
        places.append((free, full))
    took_t, took_c, k = np.zeros(len(score), np.int64), np.zeros(len(score), np.int64), 0
    for i in range(len(places) - 1, -1, -1):
        (free, full), nt, nc = places[i], int(t[i]), int(c[i])
        was = min(max(full, k - nt), k) if nt else k
        took_t[i] = k - was
        k = min(max(free, was), was + nc) if nc else was
        took_c[i] = k - was
    return took_t, took_c


def solve(t: np.ndarray, c: np.ndarray, caliper: float) -> list[tuple[int, int]]:
    """Maximum number of pairs within the caliper, then least total distance, of two sorted score arrays: places of treated and
    control, in order.  Whole numbers are added exactly."""
    kind = np.int64 if t.dtype.kind == c.dtype.kind == "i" else float
    t, c = t.astype(kind), c.astype(kind)
    score = np.unique(np.concatenate([t, c]))
    first = [np.searchsorted(arm, score, "left") for arm in (t, c)]
    own = [np.searchsorted(arm, score, "right") - low for arm, low in zip((t, c), first)]
    got = []
    for low, n in zip(first, taken(score, *own, caliper)):
        got.append((np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())).tolist())
    return list(zip(*got))


BUNDLE = 20_000


def candidates(scored: DataFrame, caliper: int = CALIPER, strata: list[str] = STRATA, bundle: int = BUNDLE) -> DataFrame:
    """Treated rows, and the controls that a best matching can need, with `part`: some best matching pairs within parts only.

    No pair that crosses a score passes a free control: taking that one is nearer.  So at most as many treated ones look for a control
    further right as are left over when all that came so far, from the last place where none was left, take every control they
    meet (`l`, a running sum less its least value so far); likewise further left (`r`).  A score needs no more controls than its
    own treated ones and those that come from both sides, which makes at most two for each treated one; of equal controls the least
    ids stay.  Where nobody looks across, and where neighbouring scores are over a caliper apart, a part can
    end; parts are joined to about `bundle` rows.  Windows run over distinct scores (at most a million a stratum), not over rows,
    and only ever from one end up to a row, which takes one step a score.
    """
    arms = scored.groupBy(*strata, "score_ppm").agg(F.sum("treated").alias("t"), F.sum(1 - F.col("treated")).alias("c"))
    by = Window.partitionBy(*strata).orderBy("score_ppm")
    apart = F.coalesce((F.col("score_ppm") - F.lag("score_ppm").over(by) > caliper).cast("int"), F.lit(0))
    some = arms.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*strata, "run")
    for name, w in (("l", run.orderBy("score_ppm")), ("r", run.orderBy(F.desc("score_ppm")))):
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        some = some.withColumn("sum", F.sum(F.col("t") - F.col("c")).over(so_far))
        some = some.withColumn(name, F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
        some = some.withColumn(f"_{name}", F.lag(name, 1, 0).over(w))
    quota = some.withColumn("quota", F.least("c", F.col("_l") + F.col("t") + F.col("_r"))).filter("t > 0 or quota > 0")
    # a score that the filter dropped is needed by nobody, so nobody looks across it
    ends = (F.col("apart") == 1) | ((F.col("_l") == 0) & (F.col("r") == 0))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    quota = quota.withColumn("upto", F.sum(F.col("t") + F.col("quota")).over(so_far) - F.col("t") - F.col("quota"))
    start = F.coalesce(F.max(F.when(ends, F.col("upto"))).over(so_far), F.lit(0))
    parts = quota.select(*(F.col(k).alias(f"_{k}") for k in [*strata, "score_ppm"]), F.floor(start / bundle).alias("part"), "quota")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*strata, "score_ppm"]]
    rank = F.row_number().over(Window.partitionBy(*strata, "score_ppm", "treated").orderBy("simple_id"))
    return scored.select(*strata, "treated", "simple_id", "score_ppm").withColumn("k", rank).join(parts, same).filter("treated = 1 or k <= quota").select(*strata, "part", "treated", "simple_id", "score_ppm")


def nearest_available(t: np.ndarray, c: np.ndarray, caliper: float) -> tuple[int, float]:
    """Pairs and total distance where each treated score, in order, takes the nearest control that is still free (the
    lower one of equals).  Both arrays are sorted; links skip taken controls, so all treated together take near-linear time."""
    # control i is below[i + 1] and above[i]; a taken one points to its neighbour, and below[0] and above[-1] stand for "none"
    below, above = list(range(len(c) + 1)), list(range(len(c) + 1))

    def free(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while i != root:
            links[i], i = root, links[i]
        return root

    pairs, total = 0, 0.0
    for score, place in zip(t.tolist(), np.searchsorted(c, t).tolist()):
        low, high = free(below, place) - 1, free(above, place)
        gap_low = score - c[low] if low >= 0 else np.inf
        gap_high = c[high] - score if high < len(c) else np.inf
        gap, taken = (gap_low, low) if gap_low <= gap_high else (gap_high, high)
        if gap <= caliper:
            pairs, total = pairs + 1, total + float(gap)
            below[taken + 1], above[taken] = taken, taken + 1
    return pairs, total


def greedy_benchmark(scored: DataFrame, caliper: int = CALIPER, strata: list[str] = STRATA) -> DataFrame:
    """t0, strata keys, n_matched, distance of nearest-available matching by stratum: a yardstick for the optimal pairs.

    Strata are cut where neighbouring scores are over a caliper apart, which no pair crosses; such a part is a
    task's unit.  Strata without both arms have no row."""
    w = Window.partitionBy(*strata).orderBy("score_ppm")
    cut = F.coalesce((F.col("score_ppm") - F.lag("score_ppm").over(w) > caliper).cast("int"), F.lit(0))
    scores = scored.select(*strata, "score_ppm").distinct().withColumn("cut", cut).select(*(F.col(k).alias(f"_{k}") for k in [*strata, "score_ppm"]), F.sum("cut").over(w).alias("part"))
    rows = scored.select(*strata, "treated", "score_ppm").join(scores, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*strata, "score_ppm"]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arm = [np.sort(pdf.score_ppm[pdf.treated == v].to_numpy(float)) for v in (1, 0)]
        n, distance = nearest_available(*arm, caliper)
        return pdf[strata].head(1).assign(n_matched=n, distance=int(distance))

    kinds = ", ".join(f"{k} {scored.schema[k].dataType.simpleString()}" for k in strata)
    parts = rows.select(*strata, "part", "treated", "score_ppm").groupBy(*strata, "part").applyInPandas(run, f"{kinds}, n_matched long, distance long")
    both = scored.groupBy(*strata).agg(F.countDistinct("treated").alias("arms")).filter("arms = 2").select(*(F.col(k).alias(f"_{k}") for k in strata))
    return parts.groupBy(*strata).agg(F.sum("n_matched").alias("n_matched"), F.sum("distance").alias("distance")).join(both, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in strata], "left_semi")


def match_year(scored: DataFrame, caliper: int = CALIPER, strata: list[str] = STRATA) -> DataFrame:
    """Optimal one-to-one pairs within each stratum (null-safe keys), solved by part of a stratum on its candidates, which takes nearly
    as long as sorting them."""

    def solve_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score_ppm", "simple_id"])
        t, c = pdf[pdf.treated == 1], pdf[pdf.treated == 0]
        got = solve(t.score_ppm.to_numpy(np.int64), c.score_ppm.to_numpy(np.int64), caliper)
        i, j = [g[0] for g in got], [g[1] for g in got]
        a, b = t.iloc[i], c.iloc[j]
        return pd.DataFrame({"t_id": a.simple_id.to_numpy(), "c_id": b.simple_id.to_numpy(), "t0": a.t0.to_numpy(), "distance": np.abs(a.score_ppm.to_numpy() - b.score_ppm.to_numpy())})

    return candidates(scored, caliper, strata).groupBy(*strata, "part").applyInPandas(solve_part, "t_id long, c_id long, t0 int, distance long")


def stamp(rows: DataFrame) -> str:
    """What a year's matching depends on: number and hash of its rows, and its columns."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns) % 1_000_003).alias("h")).first()
    return fingerprint({"columns": rows.columns, "n": got.n, "h": got.h})


def match_without_reuse(scored: DataFrame, save, caliper: int = CALIPER, kept: Checkpoint | None = None, strata: list[str] = STRATA) -> DataFrame | None:
    """Years in order; a control that an earlier year used is out.  save writes a frame and reads it back, which cuts
    the lineage of the year loop (at most as many rounds as calendar years).

    kept: finished years with the stamps of what they matched.  A run that stopped reads them and matches the years that are left; a
    finished year whose candidates aren't those of its stamp raises ValueError.
    """
    years = [r.t0 for r in scored.select("t0").distinct().orderBy("t0").collect()]
    done, finished = None, set(kept.done()) if kept else set()
    for year in years:
        left = scored.filter(F.col("t0") == year)
        if done is not None:
            left = left.join(done.select(F.col("c_id").alias("simple_id"), F.lit(0).alias("treated")), ["simple_id", "treated"], "left_anti")
        if kept is None:
            now = match_year(left, caliper, strata)
        else:
            left = left.select(*sorted({*strata, "treated", "simple_id", "score_ppm"}))
            expected = fingerprint({"rows": stamp(left), "caliper": caliper})
            if year not in finished:
                kept.add(year, match_year(left, caliper, strata).withColumn("stamp", F.lit(expected)))
            now = kept.one(year)
            other = now.filter(F.col("stamp") != expected).limit(1).count()
            if other:
                raise ValueError(f"year {year} was matched from other candidates")
            now = now.drop("stamp")
        done = save(now if done is None else done.unionByName(now))
    return done


def weighted(frame: DataFrame, group: list[str], value: str, w: str = "w") -> DataFrame:
    """Weighted mean, population variance (at least 0) and missing share of a value, by group."""
    some = F.col(value).isNotNull()
    sw = F.sum(F.when(some, F.col(w)))
    mean = F.sum(F.col(w) * F.col(value)) / sw
    return frame.groupBy(*group).agg(mean.alias("mean"), F.greatest(F.lit(0.0), F.sum(F.col(w) * F.col(value) * F.col(value)) / sw - mean * mean).alias("var"), (x.sum0(F.when(~some, F.col(w))) / F.sum(w)).alias("missing"))
