"""Mediation over several years by g-computation, with yearly histories, permuted mediator times and bootstrap intervals.

Each year goes: history so far, first mediator event, death, history of the year (for use in the next).  Models of all replicates
are fitted together (batched.fit); a simulated life is a loop over years inside a task, for a batch of people, so nothing
is exchanged but sums.  All draws are hashes of (seed, purpose, year, replicate, simulation, person): they don't depend on
partitions.  Under arm a with mediator times of arm m, q_am is the treated people's risk of death within the horizon.

Times of an arm's source run are given out anew by a true permutation over people: each person has a random key, and the
people with the least keys get the earliest times, as many as the source run has of each.  The keys that divide them are found by
counting keys in buckets and then ranking within the few buckets that hold a divide; no sort of all people is made.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import batched, resample
from tessera.operators.batched import Coded, Fit, Frame, Model
from tessera.operators.histories import EARNED, KEPT_BY, specs
from tessera.operators.models import delete_at_end, root_of, save
from tessera.sources.files import Checkpoint, fingerprint

AMOUNTS, STATES = ("entgelt", "rtzb"), ("other_rehab",)
BUCKETS = 1024
#: Pair members in a file, at most; see spread().
EACH = 20_000


@dataclass(frozen=True)
class Plan:
    """Baseline covariates (columns of the risk set) and parameters."""

    numeric: tuple[str, ...] = ("lag1_age", "lag1_cum_rehab")
    binary: tuple[str, ...] = ("lag1_ever_rehab",)
    categorical: tuple[str, ...] = ("lag1_ge",)
    horizon: int = 5
    simulations: int = 25
    replicate_simulations: int = 5
    floor: float = 0.02
    cap: float = 20.0
    least_level: int = 10
    seed: int = 5
    at_once: int = 50

    def baseline(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]


def lives(members: DataFrame, panel: DataFrame, risk: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row a pair member and year: baseline, last year's history, the year's events and its own history.

    at_risk: alive when the year begins and seen in all years before; used: also seen in this year, or dying in it; a death needs no
    record.  mediator: the first msk measure after t0.
    """
    deaths = panel.groupBy("simple_id").agg(F.max("death_year").alias("dy"))
    base = members.select("match_group", "treated", "simple_id", "t0")
    own = risk.select("simple_id", "t0", "treated", *plan.baseline(), *(F.col(f"lag1_{a}").alias(f"_{a}") for a in AMOUNTS))
    year = F.explode(F.sequence(F.lit(1), F.lit(plan.horizon))).alias("follow_year")
    rows = base.join(own, ["simple_id", "t0", "treated"]).join(deaths, "simple_id", "left").select("*", year)
    rows = rows.withColumn("ja", F.col("t0") + F.col("follow_year"))
    other = ((F.col("rehab") == 1) & (F.col("msk") == 0)).cast("int").alias("other_rehab")
    rows = rows.join(panel.select("simple_id", "ja", "msk", other, *AMOUNTS, F.lit(1).alias("seen")), ["simple_id", "ja"], "left")
    w = Window.partitionBy("match_group", "treated")
    o = w.orderBy("follow_year")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    dies = F.col("dy") == F.col("ja")
    rows = rows.withColumns({
        "death": F.coalesce(dies.cast("int"), F.lit(0)),
        "alive": F.col("dy").isNull() | (F.col("dy") >= F.col("ja")),
        "observed": (F.col("seen").isNotNull() | F.coalesce(dies, F.lit(False))).cast("int"),
        "m": F.coalesce("msk", F.lit(0)),
    })
    seen_so_far = F.coalesce(F.min("observed").over(before), F.lit(1)) == 1
    prev = F.coalesce(F.max("m").over(before), F.lit(0))
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    income = x.income_status(F.col("entgelt"), F.col("rtzb"))
    lagged = lambda c, first: F.when(F.col("follow_year") == 1, first).otherwise(F.lag(c).over(o))
    return rows.withColumn("income", income).select(
        *("match_group", "treated", "simple_id", "t0", "follow_year", "death", "observed"),
        *plan.baseline(),
        (F.col("alive") & seen_so_far).cast("int").alias("at_risk"),
        (F.col("alive") & seen_so_far & (F.col("observed") == 1)).cast("int").alias("used"),
        prev.alias("mediator_prev"),
        F.when((prev == 0) & (F.col("m") == 1), 1).otherwise(0).alias("mediator_new"),
        F.greatest(prev, F.col("m")).alias("mediator_now"),
        lagged("income", x.income_status(F.col("_entgelt"), F.col("_rtzb"))).alias("prior_income"),
        *(lagged(filled(a), filled(f"_{a}")).alias(f"prior_{a}") for a in AMOUNTS),
        lagged(filled("other_rehab"), F.lit(0.0)).alias("prior_other_rehab"),
        F.col("income").alias("current_income"),
        *(filled(a).alias(f"current_{a}") for a in AMOUNTS),
        filled("other_rehab").alias("current_other_rehab"),
    )


YEARLY = ["follow_year", "death", "observed", "at_risk", "used", "mediator_prev", "mediator_new", "mediator_now"]
YEARLY += [f"{w}_{c}" for w in ("prior", "current") for c in ("income", *AMOUNTS, *STATES)]


def models_of(rows: DataFrame, plan: Plan) -> dict[str, Model]:
    """The models by name, with designs fixed on the sample's used rows (an unpenalised fit doesn't depend on scales)."""
    roles = specs({r: list(getattr(plan, r)) for r in ("numeric", "binary", "categorical")}, binary=STATES)
    used = save(rows.filter("used = 1"))

    def made(name: str, kind: str, label: str, flag: str, numeric=(), binary=(), categorical=(), classes=()) -> Model:
        r = [[*roles["numeric"], *numeric], [*roles["binary"], *binary], [*roles["categorical"], *categorical]]
        return Model(name, kind, label, flag, batched.design(used, *r, plan.least_level), list(classes))

    used = used.withColumn("both", F.col("treated") * F.col("mediator_now"))
    level = F.coalesce(F.col("current_income"), F.lit(batched.MISSING)).alias("v")
    classes = sorted(r.v for r in used.select(level).distinct().collect())  # four kinds of income
    now = {"binary": ["mediator_now"]}
    found = [
        made("observation", "binary", "observed", "at_risk"),
        made("mediator", "binary", "mediator_new", "first"),
        made("death", "binary", "death", "used", binary=["mediator_now", "both"]),
        made("income", "several", "current_income", "survived", classes=classes, **now),
    ]
    found += [made(a, "amount", f"current_{a}", "survived", categorical=["current_income"], **now) for a in AMOUNTS]
    amounts = [f"current_{a}" for a in AMOUNTS]
    found += [made(s, "binary", f"current_{s}", "survived", numeric=amounts, categorical=["current_income"], **now) for s in STATES]
    return {m.name: m for m in found}


def wide(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row a pair member, with its years in order (at most the horizon)."""
    year = F.struct(*YEARLY).alias("y")
    keys = ["match_group", "treated", "simple_id", "t0", *plan.baseline()]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(year)).alias("years"))


def _plain(column: pa.Array) -> np.ndarray | Coded:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.fill_null(batched.MISSING).dictionary_encode()
        return Coded(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist())
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    """(members, replicates)"""
    column = batch.column("weights")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _frame(batch: pa.RecordBatch, plan: Plan) -> tuple[Frame, np.ndarray]:
    """All years of a batch of members under each other, and the member of each."""
    years = batch.column("years")
    size = np.diff(years.offsets.to_numpy())
    member, flat = np.repeat(np.arange(len(size)), size), years.flatten()
    frame = {c: _plain(flat.field(c)) for c in YEARLY}
    frame |= {c: _plain(_text_if(batch.column(c), c in plan.categorical))[member] for c in ("treated", *plan.baseline())}
    return _flags(frame), member


def _text_if(column: pa.Array, text: bool) -> pa.Array:
    return column.cast(pa.string()) if text else column


def _flags(frame: Frame) -> Frame:
    used = frame["used"] == 1
    frame["both"] = frame["treated"] * frame["mediator_now"]
    frame["first"] = used & (frame["mediator_prev"] == 0)
    frame["survived"] = used & (frame["death"] == 0)
    year = frame["follow_year"].astype(int)
    frame["follow_year"] = Coded(year, [str(t) for t in range(year.max(initial=0) + 1)])
    return frame


def observation_weights(frame: Frame, member: np.ndarray, fit: Fit, plan: Plan) -> np.ndarray:
    """(rows, replicates): the capped inverse of the chance to be seen in all years so far."""
    z = fit.model.design.matrix(frame, len(member))
    p = np.clip(batched.shares(z, fit.coefficients, 2)[1], plan.floor, 1.0)
    log = np.where((frame["observed"] == 1)[:, None], -np.log(p), 0.0)
    for t in range(2, plan.horizon + 1):
        # rows of a member are neighbours, in the order of years
        at = np.flatnonzero(frame["follow_year"].codes == t)
        log[at] += log[at - 1]
    return np.minimum(plan.cap, np.exp(log))


# Simulation


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def key(person: np.ndarray, *numbers: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of persons and numbers."""
    with np.errstate(over="ignore"):
        return _mixed(_mix(np.asarray(person).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), *map(_salt, numbers))


def _salt(n: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(n).astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray, *salts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for salt in salts:
            h = _mix(h ^ salt)
        return h


def uniform(person: np.ndarray, *numbers: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each person."""
    return _unit(key(person, *numbers))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


# Purposes of draws: each has streams of its own.
MEDIATOR, INCOME, NORMAL, STATE, ORDER = 1, 2, 3, 4, 5


@dataclass
class People:
    """Treated people of one replicate, as often as it drew them, once for each simulation."""

    base: Frame
    person: np.ndarray
    sim: np.ndarray
    rep: int

    def draw(self, seed: int, *purpose: int) -> np.ndarray:
        """uniform(person, seed, *purpose, rep, sim), whose first and last steps are those of all draws"""
        if seed not in self._begun:
            self._begun[seed] = key(self.person, seed)
        return _unit(_mixed(self._begun[seed], *map(_salt, (*purpose, self.rep)), self._sims))

    def __post_init__(self):
        self._begun, self._sims = {}, _salt(self.sim)


def people_of(batch: pa.RecordBatch, plan: Plan, r: int, rep: int, simulations: int) -> People:
    """rep: the replicate's number; r: its place among the weights."""
    years = batch.column("years")
    first = years.flatten().take(pa.array(years.offsets.to_numpy()[:-1] - years.offsets[0].as_py()))
    treated = _plain(batch.column("treated")) == 1
    w = _weights(batch)[:, r] * treated
    idx = np.repeat(np.arange(len(w)), w)
    copy = np.arange(len(idx)) - np.repeat(np.cumsum(w) - w, w)
    who = key(batch.column("match_group").cast(pa.int64()).to_numpy(zero_copy_only=False)[idx], copy)
    idx, who, sim = np.repeat(idx, simulations), np.repeat(who, simulations), np.tile(np.arange(simulations), len(idx))
    base = {c: _plain(_text_if(batch.column(c), c in plan.categorical))[idx] for c in plan.baseline()}
    base |= {f"prior_{c}": _plain(first.field(f"prior_{c}"))[idx] for c in ("income", *AMOUNTS, *STATES)}
    return People(base, who, sim, rep)


def _year(state: Frame, arm: int, t: int, prev: np.ndarray, now: np.ndarray | None = None) -> Frame:
    out = state | {"treated": np.float64(arm), "follow_year": str(t), "mediator_prev": prev.astype(float)}
    return out if now is None else out | {"mediator_now": now.astype(float), "both": arm * now.astype(float)}


def history_update(fits: dict[str, Fit], frame: Frame, p: People, r: int, plan: Plan, *purpose: int) -> Frame:
    """The year's status, then amounts given it, then states given all; they are the next year's prior history."""
    n, out = len(p.person), dict(frame)
    classes = fits["income"].model.classes
    place = (np.cumsum(fits["income"].shares(out, n, r), 0) < p.draw(plan.seed, INCOME, *purpose)).sum(0)
    out["current_income"] = Coded(np.minimum(place, len(classes) - 1), classes)
    for i, a in enumerate(AMOUNTS):
        f = fits[a]
        u, v = p.draw(plan.seed, NORMAL, 2 * i, *purpose), p.draw(plan.seed, NORMAL, 2 * i + 1, *purpose)
        z = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * math.pi * v)
        log = np.minimum(f.model.design.margin(out, n, f.coefficients[r]) + z * f.sd[r], f.cap[r])
        has = out["current_income"].mapped(lambda v: v in KEPT_BY.get(a, EARNED))  # noqa: B023
        out[f"current_{a}"] = np.where(has, np.maximum(0.0, np.expm1(log)), 0.0)
    for i, s in enumerate(STATES):
        out[f"current_{s}"] = (p.draw(plan.seed, STATE, i, *purpose) < fits[s].chance(out, n, r)).astype(float)
    return {c: out[c] for c in plan.baseline()} | {f"prior_{c}": out[f"current_{c}"] for c in ("income", *AMOUNTS, *STATES)}


def source_times(fits: dict[str, Fit], p: People, arm: int, r: int, plan: Plan) -> np.ndarray:
    """The year of each person's first mediator event under an arm if nobody died; horizon + 1 for none."""
    state, n = p.base, len(p.person)
    prev, time = np.zeros(n, bool), np.full(n, plan.horizon + 1)
    for t in range(1, plan.horizon + 1):
        hit = ~prev & (p.draw(plan.seed, MEDIATOR, arm, t) < fits["mediator"].chance(_year(state, arm, t, prev), n, r))
        time[hit] = t
        now = prev | hit
        if t < plan.horizon:
            state = history_update(fits, _year(state, arm, t, prev, now), p, r, plan, 0, arm, t)
        prev = now
    return time


def risk_of(fits: dict[str, Fit], p: People, arm: int, time: np.ndarray, purpose: int, r: int, plan: Plan) -> np.ndarray:
    """Each person's risk of death within the horizon under an arm, with given mediator times."""
    state, n = p.base, len(p.person)
    alive = np.ones(n)
    for t in range(1, plan.horizon + 1):
        frame = _year(state, arm, t, time < t, time <= t)
        alive *= 1 - fits["death"].chance(frame, n, r)
        if t < plan.horizon:
            state = history_update(fits, frame, p, r, plan, 1, purpose, t)
    return 1 - alive


def order_keys(p: People, arm: int, plan: Plan) -> np.ndarray:
    """Random keys, whose order gives out an arm's times."""
    return (key(p.person, plan.seed, ORDER, arm, p.rep, p.sim) >> np.uint64(1)).astype(np.int64)


SUMS = pa.schema([("name", pa.string()), ("rep", pa.int32()), ("v", pa.list_(pa.float64()))])


def _summed(rows: DataFrame, work) -> dict[tuple[str, int], np.ndarray]:
    """work: batch -> {(name, rep): numbers}; their sums over all batches.  As many numbers as replicates and simulations ask for
    reach the driver, whatever the number of people."""

    def part(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for k, v in work(batch).items():
                total[k] = total[k] + v if k in total else np.asarray(v, float)
        columns = [[k[0] for k in total], [k[1] for k in total], [v.tolist() for v in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS)], schema=SUMS)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": group["name"].iloc[:1], "rep": group["rep"].iloc[:1], "v": [np.sum(group["v"].to_list(), axis=0)]})

    schema = "name string, rep int, v array<double>"
    got = rows.mapInArrow(part, schema).groupBy("name", "rep").applyInPandas(add, schema).collect()
    return {(r.name, r.rep): np.array(r.v) for r in got}


def dividing_keys(people: DataFrame, plan: Plan, reps: list[int], counted: dict[tuple[str, int], np.ndarray]) -> np.ndarray:
    """(replicates, arm, simulation, year): the greatest key whose person has its time by that year; -1 for nobody.

    counted: counts of times (time0, time1) and of keys in buckets (key0, key1) of each replicate.
    """
    out = np.full((len(reps), 2, max(plan.simulations, plan.replicate_simulations), plan.horizon), -1, np.int64)
    wanted: dict[tuple[int, int, int, int], list[tuple[int, int]]] = {}
    for i, rep in enumerate(reps):
        for arm in (0, 1):
            for s in range(_simulations(plan, rep)):
                due = np.cumsum(counted[f"time{arm}", i].reshape(-1, plan.horizon + 1)[s])[:-1]
                upto = np.cumsum(counted[f"key{arm}", i].reshape(-1, BUCKETS)[s])
                for t, c in enumerate(due):
                    if c > 0:
                        b = int(np.searchsorted(upto, c))
                        wanted.setdefault((i, arm, s, b), []).append((t, int(c - (upto[b - 1] if b else 0))))
    if not wanted:
        return out

    def pick(batches):
        for batch in batches:
            for i, rep in enumerate(reps):
                p = people_of(batch, plan, i, rep, _simulations(plan, rep))
                for arm in (0, 1):
                    k = order_keys(p, arm, plan)
                    bucket = k >> 53
                    asked = np.zeros((_simulations(plan, rep), BUCKETS), bool)
                    for j, a, s, b in wanted:
                        if (j, a) == (i, arm):
                            asked[s, b] = True
                    at = np.flatnonzero(asked[p.sim, bucket])
                    made = [np.full(len(at), i), np.full(len(at), arm), p.sim[at], bucket[at], k[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["i", "arm", "s", "b", "k"])

    w = Window.partitionBy("i", "arm", "s", "b").orderBy("k")
    ranked = people.mapInArrow(pick, "i long, arm long, s long, b long, k long").withColumn("rank", F.row_number().over(w))
    places = [(*at, rank) for at, asked in wanted.items() for rank in {c for _, c in asked}]
    want = people.sparkSession.createDataFrame(places, "i long, arm long, s long, b long, rank int")
    # a divide for each replicate, arm, simulation and year
    for r in ranked.join(F.broadcast(want), ["i", "arm", "s", "b", "rank"]).collect():
        for t, c in wanted[r.i, r.arm, r.s, r.b]:
            if c == r["rank"]:
                out[r.i, r.arm, r.s, t] = r.k
    return out


def _simulations(plan: Plan, rep: int) -> int:
    return plan.simulations if rep == 0 else plan.replicate_simulations


def simulate(people: DataFrame, fits: dict[str, Fit], plan: Plan, reps: list[int]) -> dict[int, dict[str, float]]:
    """q00 to q11 and the mediator's risks m0 and m1 of each replicate (None where it drew nobody)."""

    def source(batch):
        out = {}
        for i, rep in enumerate(reps):
            p, sims = people_of(batch, plan, i, rep, _simulations(plan, rep)), _simulations(plan, rep)
            for arm in (0, 1):
                time = source_times(fits, p, arm, i, plan)
                out[f"time{arm}", i] = np.bincount(p.sim * (plan.horizon + 1) + time - 1, minlength=sims * (plan.horizon + 1))
                out[f"key{arm}", i] = np.bincount(p.sim * BUCKETS + (order_keys(p, arm, plan) >> 53), minlength=sims * BUCKETS)
        return out

    counted = _summed(people, source)
    if not counted:
        return {}
    divides = dividing_keys(people, plan, reps, counted)

    def outcome(batch):
        out = {}
        for i, rep in enumerate(reps):
            p = people_of(batch, plan, i, rep, _simulations(plan, rep))
            sums = []
            for m in (0, 1):
                time = 1 + (order_keys(p, m, plan)[:, None] > divides[i, m][p.sim]).sum(1)
                sums += [risk_of(fits, p, a, time, 2 * a + m, i, plan).sum() for a in (0, 1)] + [(time <= plan.horizon).sum()]
            out["q", i] = np.array([*sums, len(p.person)])
        return out

    found = _summed(people, outcome)
    names = ("q00", "q10", "m0", "q01", "q11", "m1")
    return {rep: dict(zip(names, found["q", i][:-1] / found["q", i][-1])) for i, rep in enumerate(reps) if found["q", i][-1] > 0}


def effects_of(q: dict[str, float]) -> dict[str, float | None]:
    total = q["q11"] - q["q00"]
    out = {"total": total, "direct": q["q10"] - q["q00"], "indirect": q["q11"] - q["q10"]}
    return q | out | {"proportion": out["indirect"] / total if abs(total) > 1e-12 else None}


EFFECT = "effect string, value double, ci_low double, ci_high double, replicates long"
METHOD = "rep int, model string, steps int, method string"
RESULT = "rep int, name string, value double, note string"


def replicates_of(rows: DataFrame, models: dict[str, Model], plan: Plan, reps: list[int]) -> DataFrame:
    """Effects of each replicate, and each model's steps (value) and method (note).  rows: wide(), with weights."""

    def seen(batch):
        frame, member = _frame(batch, plan)
        return frame, _weights(batch)[member].astype(float)

    first = batched.fit(rows, seen, [models["observation"]], len(reps))

    def weighted(batch):
        frame, member = _frame(batch, plan)
        return frame, _weights(batch)[member] * observation_weights(frame, member, first["observation"], plan)

    fits = first | batched.fit(rows, weighted, [m for m in models.values() if m.name != "observation"], len(reps))
    found = simulate(rows.filter("treated = 1"), fits, plan, reps)
    out: list[tuple] = []
    for i, rep in enumerate(reps):
        failed = any(f.method[i] == "no rows" for f in fits.values())
        if rep in found and not failed:
            out += [(rep, n, None if v is None else float(v), None) for n, v in effects_of(found[rep]).items()]
        out += [(rep, f"model {f.model.name}", float(f.steps[i]), f.method[i]) for f in fits.values()]
    return rows.sparkSession.createDataFrame(out, RESULT)


def spread(rows: DataFrame, n: int, each: int = EACH) -> DataFrame:
    """n rows of wide() in as many even parts as the session has cores, or a multiple of it where a part would have over `each` rows.

    Their bytes are few and the work on each is long, so sizes in bytes, by which adaptive execution joins parts, would put them all in one
    or two tasks.  A scan deals a multiple of the cores out evenly.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, math.ceil(n / (cores * each))), "match_group")


def mediation(
    members: DataFrame, panel: DataFrame, risk: DataFrame, plan: Plan = Plan(), replicates: int = 200, checkpoint: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Effects (effect, value, ci_low, ci_high, replicates) and models (rep, model, steps, method).

    Replicate 0 is the sample; the others draw as many pairs as there are, with replacement.  They are made in portions of
    plan.at_once, each kept below `checkpoint` under a fingerprint of input and parameters: a run that stopped goes on with the
    portions that are left.  Intervals need a value in half of the replicates and in 20 at least; fewer raise RuntimeError.
    No pairs: no effects.
    """
    spark = panel.sparkSession
    rows = save(lives(members, panel, risk, plan))
    people = save(wide(rows, plan))
    stamp = people.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*people.columns) % 1_000_003).alias("h")).first()
    if not stamp.n:
        return spark.createDataFrame([], EFFECT), spark.createDataFrame([], METHOD)
    at = checkpoint or delete_at_end(spark, f"{root_of(spark)}/mediation-{uuid.uuid4().hex}")
    parts = {k: v for k, v in vars(plan).items()} | {"rows": stamp.n, "hash": stamp.h, "replicates": replicates}
    kept, clusters = Checkpoint(spark, at, fingerprint(parts)), None
    done, models = set(kept.done()), None
    for low in range(0, replicates + 1, plan.at_once):
        if low in done:
            continue
        reps = list(range(low, min(low + plan.at_once, replicates + 1)))
        if models is None:
            models, clusters = models_of(rows, plan), save(people.select("match_group").distinct())
        drawn = [r for r in reps if r > 0]
        own = F.array(F.lit(1)) if low == 0 else F.array().cast("array<int>")
        w: Column = own
        data = people
        if drawn:
            data = people.join(resample.weights(clusters, "match_group", range(drawn[0], drawn[-1] + 1), plan.seed), "match_group")
            w = F.concat(own, "weights")
        kept.add(low, replicates_of(save(spread(data.withColumn("weights", w), stamp.n)), models, plan, reps))
    found = kept.rows().select("rep", "name", "value", "note")
    effects = found.filter(~F.col("name").startswith("model "))
    drawn = F.when(F.col("rep") > 0, F.col("value"))
    table = effects.groupBy(F.col("name").alias("effect")).agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("value"),
        F.percentile(drawn, 0.025).alias("ci_low"),
        F.percentile(drawn, 0.975).alias("ci_high"),
        F.count(drawn).alias("replicates"),
    )
    if replicates:
        got = effects.filter("rep > 0 AND name = 'total'").count()
        if got < max(min(20, replicates), replicates // 2):
            raise RuntimeError(f"{got} of {replicates} replicates succeeded")
    tried = found.filter(F.col("name").startswith("model "))
    return table, tried.select("rep", F.expr("substring(name, 7)").alias("model"), F.col("value").cast("int").alias("steps"), F.col("note").alias("method"))
