"""Models of many replicates at once: each pass over the rows sums the Newton parts of all replicates and models.

A replicate is a column of weights.  A pass turns each Arrow batch into a design matrix once; the sums of all replicates are then
matrix products, and only they (a few thousand numbers a replicate) leave a task.  A replicate's system is solved where its
sums meet.  A fit that doesn't settle goes down a ladder of penalties; which rung it took is recorded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties (1 / C) of the rungs, and their names.
LADDER = ((0.0, "unpenalized"), (1e-4, "ridge C=1e4"), (1e-2, "ridge C=1e2"), (1e-1, "ridge C=1e1"), (1.0, "ridge C=1"))
STEPS, TOLERANCE, FAR = 10, 1e-8, 30.0
MISSING, RARE = "__MISSING__", "__RARE__"


@dataclass
class Coded:
    """A column of texts as places in a short list of them; np.asarray gives the texts."""

    codes: np.ndarray
    texts: list[str]
    ndim = 1

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, at) -> Coded:
        return Coded(self.codes[at], self.texts)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.array(self.texts, object)[self.codes]

    def mapped(self, values: Callable[[str], object]) -> np.ndarray:
        """A value for each row, asked for once a text."""
        return np.array([values(v) for v in self.texts])[self.codes]


def mapped(column, values: Callable[[str], object]) -> np.ndarray:
    """A value for each text of a column, which is coded, an array or one text for all rows (then one value)."""
    if isinstance(column, Coded):
        return column.mapped(values)
    column = np.asarray(column)
    if not column.ndim:
        return np.asarray(values(column.item()))
    found, places = np.unique(column, return_inverse=True)
    return np.array([values(v) for v in found.tolist()])[places]


Frame = dict[str, np.ndarray | Coded]


@dataclass
class Design:
    """Columns of a model: an intercept, numbers in standard deviations (null: the median, with a flag where there are any), flags
    (null: the mode, likewise) and a column for each level but the first (null is a level, rare ones are one)."""

    numeric: dict[str, tuple[float, float, float, bool]] = field(default_factory=dict)  # median, mean, sd, flag
    binary: dict[str, tuple[float, bool]] = field(default_factory=dict)  # mode, flag
    levels: dict[str, list[str]] = field(default_factory=dict)  # all but the first
    known: dict[str, list[str]] = field(default_factory=dict)
    intercept: bool = True

    def names(self) -> list[str]:
        out = ["intercept"] * self.intercept
        out += [n for c, v in self.numeric.items() for n in ([c, f"{c}__missing"] if v[3] else [c])]
        out += [n for c, v in self.binary.items() for n in ([c, f"{c}__missing"] if v[1] else [c])]
        return out + [f"{c}={v}" for c, vs in self.levels.items() for v in vs]

    def matrix(self, frame: Frame, n: int) -> np.ndarray:
        out = [np.ones(n)] * self.intercept
        for c, (median, mean, sd, flag) in self.numeric.items():
            v = np.asarray(frame[c], float)
            out.append((np.where(np.isnan(v), median, v) - mean) / sd)
            if flag:
                out.append(np.isnan(v).astype(float))
        for c, (mode, flag) in self.binary.items():
            v = np.asarray(frame[c], float)
            out.append(np.where(np.isnan(v), mode, v))
            if flag:
                out.append(np.isnan(v).astype(float))
        for c, vs in self.levels.items():
            place = mapped(frame[c], self._place(c))
            out += [(place == i).astype(float) for i in range(len(vs))]
        full = np.empty((n, len(out)))
        for i, v in enumerate(out):
            full[:, i] = v
        return full

    def _place(self, c: str) -> Callable[[str], int]:
        """The place of a text among a category's columns; -1 for none."""
        vs, known = self.levels[c], set(self.known[c])
        places = {v: i for i, v in enumerate(vs) if v != RARE}
        rare = vs.index(RARE) if RARE in vs else -1
        return lambda v: places.get(v, -1 if v in known else rare)

    def margin(self, frame: Frame, n: int, b: np.ndarray) -> np.ndarray:
        """matrix() @ b, term by term without the matrix: a row's value doesn't depend on the rows beside it, and what is the same for
        all rows is a number."""
        out, b = np.zeros(n), iter(b.tolist())
        if self.intercept:
            out += next(b)
        for c, (median, mean, sd, flag) in self.numeric.items():
            v = np.asarray(frame[c], float)
            none = np.isnan(v)
            out += (((np.where(none, median, v) if none.any() else v) - mean) / sd) * next(b)
            if flag:
                out += none * next(b)
        for c, (mode, flag) in self.binary.items():
            v = np.asarray(frame[c], float)
            none = np.isnan(v)
            out += (np.where(none, mode, v) if none.any() else v) * next(b)
            if flag:
                out += none * next(b)
        for c, vs in self.levels.items():
            own, place = [*(next(b) for _ in vs), 0.0], self._place(c)
            out += mapped(frame[c], lambda v: own[place(v)])
        return out


def design(rows: DataFrame, numeric: Iterable[str], binary: Iterable[str], categorical: Iterable[str], least: int = 10, most: int = 1000) -> Design:
    """The design of a sample's rows, in one aggregation and a count of levels for each category."""
    value = lambda c: F.col(c).cast("double")
    numeric, binary = list(numeric), list(binary)
    found = rows.agg(
        F.count("*").alias("n"),
        *(f(value(c)).alias(f"{n}_{c}") for c in numeric for n, f in (("median", F.median), ("mean", F.avg), ("sd", F.stddev_pop))),
        *(F.mode(value(c), True).alias(f"mode_{c}") for c in binary),
        *(F.max(F.col(c).isNull().cast("int")).alias(f"flag_{c}") for c in [*numeric, *binary]),
    ).first()
    out = Design()
    for c in numeric:
        out.numeric[c] = (found[f"median_{c}"] or 0.0, found[f"mean_{c}"] or 0.0, found[f"sd_{c}"] or 1.0, bool(found[f"flag_{c}"]))
    for c in binary:
        out.binary[c] = (found[f"mode_{c}"] or 0.0, bool(found[f"flag_{c}"]))
    for c in categorical:
        level = F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")
        counts = rows.groupBy(level).count().orderBy(F.desc("count"), "level").limit(most + 1).collect()
        if len(counts) > most:
            raise ValueError(f"too many levels: {c}")
        known = sorted(r.level for r in counts if r["count"] >= least)
        out.known[c] = known
        out.levels[c] = (known + [RARE] * (len(known) < len(counts)))[1:]
    return out


@dataclass
class Model:
    """kind: binary, several (classes) or amount (log(1 + y), least squares).  used: the frame's flag of its rows."""

    name: str
    kind: str
    label: str
    used: str
    design: Design
    classes: list[str] = field(default_factory=list)

    def width(self) -> int:
        return len(self.design.names()) * (len(self.classes) - 1 if self.kind == "several" else 1)


Prepare = Callable[["object"], tuple[Frame, np.ndarray]]


def _pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of all pairs of columns, each once, and which they are."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j], i, j


def shares(x: np.ndarray, b: np.ndarray, classes: int) -> np.ndarray:
    """(classes, rows, replicates): probabilities by coefficients (replicates, (classes - 1) * columns); the first class is the
    reference."""
    k = x.shape[1]
    eta = np.stack([np.zeros((len(x), len(b)))] + [x @ b[:, c * k : (c + 1) * k].T for c in range(classes - 1)])
    p = np.exp(eta - eta.max(0))
    return p / p.sum(0)


def _sums(model: Model, frame: Frame, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(replicates, numbers): gradient and upper triangle of the information at b; for amounts, of X'WX, X'Wy, y'Wy, W and y'W."""
    some = np.asarray(frame[model.used], bool)
    own = {c: v[some] if np.ndim(v) else v for c, v in frame.items()}
    x, w = model.design.matrix(own, int(some.sum())), w[some]
    z, i, j = _pairs(x)
    if model.kind == "amount":
        y = np.log1p(np.maximum(0, np.nan_to_num(np.asarray(own[model.label], float))))
        top = np.where((w > 0).any(0), np.where(w > 0, y[:, None], 0).max(0, initial=0), 0)
        return np.concatenate([z.T @ w, x.T @ (w * y[:, None]), [(y * y) @ w, w.sum(0), y @ w, top]]).T
    if model.kind == "binary":
        y = np.asarray(own[model.label], float)[None, :]
        p = shares(x, b, 2)[1:]
    else:
        classes = {c: i for i, c in enumerate(model.classes)}
        place = mapped(own[model.label], lambda v: classes.get(v, -1))
        y = np.stack([place == i for i in range(1, len(classes))]).astype(float)
        p = shares(x, b, len(model.classes))[1:]
    parts = [x.T @ (w * (y[c][:, None] - p[c])) for c in range(len(p))]
    for c in range(len(p)):
        parts += [z.T @ (w * p[c] * ((c == d) - p[d])) for d in range(c, len(p))]
    return np.concatenate([*parts, y @ w, w.sum(0)[None]]).T


def _unpack(model: Model, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradient, information, weight of each class but the first, weight of all."""
    k = len(model.design.names())
    classes = len(model.classes) - 1 if model.kind == "several" else 1
    g, at, i, j = v[: k * classes], k * classes, *np.triu_indices(k)
    h = np.zeros((k * classes, k * classes))
    for c in range(classes):
        for d in range(c, classes):
            block = np.zeros((k, k))
            block[i, j] = block[j, i] = v[at : at + len(i)]
            h[c * k : (c + 1) * k, d * k : (d + 1) * k] = block
            h[d * k : (d + 1) * k, c * k : (c + 1) * k] = block
            at += len(i)
    return g, h, v[at : at + classes], float(v[-1])


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least-norm solution: dependent columns share their effect, and columns without a value have none."""
    d = np.diag(h)
    on = d > 1e-12 * d.max(initial=0)
    scale = np.sqrt(d[on])
    out = np.zeros(len(g))
    out[on] = np.linalg.lstsq(h[np.ix_(on, on)] / np.outer(scale, scale), g[on] / scale, rcond=1e-9)[0] / scale
    return out


@dataclass
class Fit:
    """Coefficients of a model by replicate (rows), and how each was found.  amount: residual sd and cap of the log too."""

    model: Model
    coefficients: np.ndarray
    method: list[str]
    converged: np.ndarray
    steps: np.ndarray
    sd: np.ndarray | None = None
    cap: np.ndarray | None = None

    def chance(self, frame: Frame, n: int, rep: int) -> np.ndarray:
        """Probabilities of a binary model for replicate number rep, away from 0 and 1."""
        eta = self.model.design.margin(frame, n, self.coefficients[rep])
        e = np.exp(-np.abs(eta))
        return np.clip(np.where(eta >= 0, 1.0, e) / (1 + e), 1e-9, 1 - 1e-9)

    def shares(self, frame: Frame, n: int, rep: int) -> np.ndarray:
        """(classes, rows): probabilities of a model of several classes for replicate number rep."""
        d = self.model.design
        k, b = len(d.names()), self.coefficients[rep]
        eta = np.stack([np.zeros(n)] + [d.margin(frame, n, b[c * k : (c + 1) * k]) for c in range(len(self.model.classes) - 1)])
        p = np.exp(eta - eta.max(0))
        return p / p.sum(0)


SUMS = pa.schema([("model", pa.string()), ("rep", pa.int32()), ("v", pa.list_(pa.float64()))])


def _merged(kind: str, parts: list[np.ndarray]) -> np.ndarray:
    """The sum of parts; an amount's last number is the greatest value instead."""
    out = np.sum(parts, axis=0)
    if kind == "amount":
        out[..., -1] = np.max([p[..., -1] for p in parts], axis=0)
    return out


def _gather(rows: DataFrame, prepare: Prepare, models: list[Model], fits: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums of all models and replicates, added up over the rows."""

    def part(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            frame, w = prepare(batch)
            for m in models:
                s = _sums(m, frame, w, fits[m.name])
                total[m.name] = _merged(m.kind, [total[m.name], s]) if m.name in total else s
        rows = [(name, r, v.tolist()) for name, s in total.items() for r, v in enumerate(s)]
        columns = zip(*rows) if rows else [[]] * len(SUMS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS)], schema=SUMS)

    kinds = {m.name: m.kind for m in models}

    def add(group: pd.DataFrame) -> pd.DataFrame:
        v = _merged(kinds[group["model"].iloc[0]], group["v"].to_list())
        return pd.DataFrame({"model": group["model"].iloc[:1], "rep": group["rep"].iloc[:1], "v": [v]})

    schema = "model string, rep int, v array<double>"
    summed = rows.mapInArrow(part, schema).groupBy("model", "rep").applyInPandas(add, schema)
    # a few thousand numbers for each model and replicate, whatever the number of rows
    got = summed.toPandas()
    return {m.name: np.stack(got[got["model"] == m.name].sort_values("rep")["v"].to_list()) for m in models}


def fit(rows: DataFrame, prepare: Prepare, models: list[Model], replicates: int) -> dict[str, Fit]:
    """All models for all replicates.  prepare: an Arrow batch to a frame of columns and its weights (rows, replicates)."""
    zeros = lambda: np.zeros(replicates, int)
    out = {m.name: Fit(m, np.zeros((replicates, m.width())), [LADDER[0][1]] * replicates, zeros() > 0, zeros()) for m in models}
    state = {m.name: (zeros(), zeros(), zeros() > 0) for m in models}  # rung, steps on it, done
    left = list(models)
    while left:
        sums = _gather(rows, prepare, left, {m.name: out[m.name].coefficients for m in left})
        for m in left:
            if m.kind == "amount":
                _least_squares(out[m.name], sums[m.name])
                state[m.name][2][:] = True
            else:
                for r in np.flatnonzero(~state[m.name][2]):
                    _step(out[m.name], *state[m.name], r, sums[m.name][r])
        left = [m for m in left if not state[m.name][2].all()]
    return out


def _step(f: Fit, rung: np.ndarray, since: np.ndarray, done: np.ndarray, r: int, sums: np.ndarray) -> None:
    """A Newton step of replicate r.  A class that no row has keeps a chance of nearly 0; where just one has rows, or no row is
    there at all, nothing is fitted."""
    g, h, per, total = _unpack(f.model, sums)
    k = len(f.model.design.names())
    seen = per > 0
    if total <= 0 or (seen.sum() == (total - per.sum() <= 1e-9 * total)) and seen.sum() < 2:
        f.coefficients[r] = 0.0
        f.coefficients[r, ::k] = np.where(seen, FAR, -FAR)
        f.method[r], f.converged[r], done[r] = ("constant", True, True) if total > 0 else ("no rows", False, True)
        return
    on = np.repeat(seen, k)
    f.coefficients[r, ~on] = np.where(np.arange((~on).sum()) % k == 0, -FAR, 0.0)
    penalty = np.full(len(g), LADDER[rung[r]][0])
    penalty[::k] = 0  # intercepts go free
    b = f.coefficients[r]
    step = _solve((h + np.diag(penalty))[np.ix_(on, on)], (g - penalty * b)[on])
    step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
    b[on] += step
    f.steps[r] += 1
    since[r] += 1
    if np.abs(step).max() < TOLERANCE:
        f.converged[r] = done[r] = True
    elif since[r] >= STEPS * (1 + 2 * (rung[r] > 0)) or (rung[r] == 0 and np.abs(b[on]).max() > FAR):
        if rung[r] == len(LADDER) - 1:
            f.method[r] += ", not settled"
            done[r] = True
            return
        # from where the last rung stopped: a weak penalty's solution lies in that direction
        rung[r] += 1
        since[r] = 0
        b[:] = b if np.isfinite(b).all() else 0.0
        f.method[r] = LADDER[rung[r]][1]


def _least_squares(f: Fit, sums: np.ndarray, headroom: float = 3.0) -> None:
    k = len(f.model.design.names())
    i, j = np.triu_indices(k)
    f.sd, f.cap = np.zeros(len(sums)), np.zeros(len(sums))
    for r, v in enumerate(sums):
        h = np.zeros((k, k))
        h[i, j] = h[j, i] = v[: len(i)]
        xy, (yy, w, y, top) = v[len(i) : len(i) + k], v[-4:]
        b = _solve(h, xy)
        f.coefficients[r] = b
        mean = (y - h[0] @ b) / max(w, 1e-12)  # the intercept's row of X'WX
        f.sd[r] = max(0.0, (yy - 2 * b @ xy + b @ h @ b) / max(w, 1e-12) - mean**2) ** 0.5
        f.cap[r] = top + headroom
        f.converged[r], f.method[r], f.steps[r] = True, "least squares", 1
