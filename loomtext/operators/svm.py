"""Support vector machines: model files, prediction over columns, training.

Models are small and travel to the executors with the function that applies
them; rows are scored in Arrow batches with one matrix product each. Training
takes a problem that fits the driver (it is of the size of a hand-labelled
sample); a grid search trains one cell on each task.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtext.operators.frames import mapped
from loomtext.operators.pairs import met
from loomtext.runtime import read_text, write_text

KERNELS = ("linear", "polynomial", "rbf", "sigmoid", "precomputed")
TYPES = ("c_svc", "nu_svc", "one_class", "epsilon_svr", "nu_svr")


@dataclass
class Parameter:
    svm_type: str = "c_svc"
    kernel: str = "rbf"
    degree: int = 3
    gamma: float = 0.0
    coef0: float = 0.0
    C: float = 1.0
    nu: float = 0.5
    p: float = 0.1
    eps: float = 1e-3
    probability: bool = False

    def check(self, rows: int) -> None:
        if self.svm_type not in TYPES or self.kernel not in KERNELS:
            raise ValueError("unknown type or kernel")
        if self.gamma < 0 or self.C <= 0 or not 0 < self.nu <= 1 or self.p < 0 or self.eps <= 0 or not rows:
            raise ValueError("parameter out of range or empty problem")


@dataclass
class Model:
    parameter: Parameter
    labels: list[int]
    rho: np.ndarray
    sv: np.ndarray
    coef: np.ndarray  # [classes - 1, vectors], or one row
    counts: list[int] = field(default_factory=list)
    prob_a: np.ndarray | None = None
    prob_b: np.ndarray | None = None

    @property
    def classes(self) -> int:
        return len(self.labels)


def kernel_matrix(x: np.ndarray, y: np.ndarray, p: Parameter) -> np.ndarray:
    dot = x @ y.T
    if p.kernel == "linear":
        return dot
    if p.kernel == "polynomial":
        return (p.gamma * dot + p.coef0) ** p.degree
    if p.kernel == "rbf":
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * dot
        return np.exp(-p.gamma * np.maximum(d, 0))
    if p.kernel == "sigmoid":
        return np.tanh(p.gamma * dot + p.coef0)
    return x[:, y[:, 0].astype(int)]


def smo(k: np.ndarray, y: np.ndarray, linear: np.ndarray, upper: np.ndarray, alpha: np.ndarray, eps: float, most: int = 100_000) -> tuple[np.ndarray, float]:
    """Minimise a'Qa/2 + linear'a with y'a fixed and 0 <= a <= upper, where Q is
    y y' k: the pair of most violation moves until none exceeds ``eps``. A warning
    tells where ``most`` steps did not do."""
    g = linear + y * (k @ (alpha * y))
    for _ in range(most):
        up = (y > 0) & (alpha < upper) | (y < 0) & (alpha > 0)
        low = (y > 0) & (alpha > 0) | (y < 0) & (alpha < upper)
        v = -y * g
        i = int(np.where(up, v, -np.inf).argmax())
        j = int(np.where(low, v, np.inf).argmin())
        if not up.any() or not low.any() or v[i] - v[j] < eps:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        room_i = upper[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else upper[j] - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        alpha[[i, j]] = np.clip(alpha[[i, j]], 0, upper[[i, j]])
        g += y * (k[:, i] - k[:, j]) * step
    else:
        warnings.warn(f"no optimum within {most} steps", RuntimeWarning, stacklevel=2)
    up = (y > 0) & (alpha < upper) | (y < 0) & (alpha > 0)
    low = (y > 0) & (alpha > 0) | (y < 0) & (alpha < upper)
    free = (alpha > 1e-12) & (alpha < upper - 1e-12)
    v = -y * g
    if free.any():
        rho = -v[free].mean()
    else:
        rho = -((np.where(up, v, -np.inf).max() if up.any() else 0.0) + (np.where(low, v, np.inf).min() if low.any() else 0.0)) / 2
    return alpha, float(rho)


def _binary(k: np.ndarray, y: np.ndarray, p: Parameter) -> tuple[np.ndarray, float]:
    """Signed coefficients and rho of one two-class machine."""
    n = len(y)
    if p.svm_type == "nu_svc":
        each = p.nu * n / 2
        if each > min((y > 0).sum(), (y < 0).sum()):
            raise ValueError("nu is infeasible")
        alpha = np.zeros(n)
        for sign in (1, -1):
            left = each
            for i in np.flatnonzero(y == sign):
                alpha[i] = min(1.0, left)
                left -= alpha[i]
        # two constraints: pairs move within a class only
        g = y * (k @ (alpha * y))
        for _ in range(100_000):
            best = (p.eps, 0, 0)
            for sign in (1, -1):
                mine = y == sign
                up, low = mine & (alpha < 1), mine & (alpha > 0)
                if up.any() and low.any():
                    i, j = int(np.where(up, -g, -np.inf).argmax()), int(np.where(low, -g, np.inf).argmin())
                    best = max(best, (g[j] - g[i], i, j))
            gap, i, j = best
            if i == j:
                break
            step = min(gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), 1 - alpha[i], alpha[j])
            alpha[i] += step
            alpha[j] -= step
            g += y * y[i] * (k[:, i] - k[:, j]) * step
        level = []
        for sign in (1, -1):
            mine = y == sign
            free = mine & (alpha > 1e-12) & (alpha < 1 - 1e-12)
            level.append(g[free].mean() if free.any() else (g[mine & (alpha <= 0)].min(initial=np.inf) + g[mine & (alpha >= 1)].max(initial=-np.inf)) / 2)
        scale = (level[0] + level[1]) / 2
        return alpha * y / scale, (level[0] - level[1]) / 2 / scale
    alpha, rho = smo(k, y, -np.ones(n), np.full(n, p.C), np.zeros(n), p.eps)
    return alpha * y, rho


def _regression(k: np.ndarray, y: np.ndarray, p: Parameter) -> tuple[np.ndarray, float]:
    n = len(y)
    big = np.block([[k, k], [k, k]])
    sign = np.r_[np.ones(n), -np.ones(n)]
    alpha, rho = smo(big, sign, np.r_[p.p - y, p.p + y], np.full(2 * n, p.C), np.zeros(2 * n), p.eps)
    return alpha[:n] - alpha[n:], rho


def _one_class(k: np.ndarray, p: Parameter) -> tuple[np.ndarray, float]:
    n = len(k)
    alpha = np.zeros(n)
    full = int(p.nu * n)
    alpha[:full] = 1
    if full < n:
        alpha[full] = p.nu * n - full
    return smo(k, np.ones(n), np.zeros(n), np.ones(n), alpha, p.eps)


def train(x: np.ndarray, y: np.ndarray, p: Parameter, *, seed: int = 0) -> Model:
    """One machine for each pair of classes, or one for the other types."""
    p.check(len(x))
    if p.gamma == 0:
        p = Parameter(**{**p.__dict__, "gamma": 1 / x.shape[1]})
    k = kernel_matrix(x, x, p)
    if p.svm_type in ("epsilon_svr", "nu_svr", "one_class"):
        if p.svm_type == "nu_svr":
            # the tube whose width leaves a share nu of the rows outside
            lo, hi = 0.0, float(np.ptp(y)) or 1.0
            for _ in range(20):
                mid = (lo + hi) / 2
                c, rho = _regression(k, y, Parameter(**{**p.__dict__, "p": mid}))
                outside = np.mean(np.abs(k @ c - rho - y) > mid)
                lo, hi = (mid, hi) if outside > p.nu else (lo, mid)
        else:
            c, rho = _one_class(k, p) if p.svm_type == "one_class" else _regression(k, y, p)
        on = np.abs(c) > 1e-12
        return Model(p, [1] if p.svm_type == "one_class" else [], np.array([rho]), x[on], c[on][None, :])
    labels = [int(v) for v in dict.fromkeys(y.tolist())]
    pairs, a, b, rho = {}, [], [], []
    for i in range(len(labels)):
        for j in range(i + 1, len(labels)):
            rows = np.flatnonzero((y == labels[i]) | (y == labels[j]))
            sign = np.where(y[rows] == labels[i], 1.0, -1.0)
            c, r = _binary(k[np.ix_(rows, rows)], sign, p)
            pairs[i, j] = dict(zip(rows.tolist(), c))
            rho.append(r)
            if p.probability:
                s = _sigmoid_fit(*_held_out(k[np.ix_(rows, rows)], sign, p, seed))
                a.append(s[0])
                b.append(s[1])
    used = [n for v in labels for n in np.flatnonzero(y == v).tolist() if any(abs(q.get(n, 0.0)) > 1e-12 for q in pairs.values())]
    coef = np.zeros((max(1, len(labels) - 1), len(used)))
    for (i, j), q in pairs.items():
        for at, n in enumerate(used):
            if n in q:
                coef[(j - 1) if y[n] == labels[i] else i, at] = q[n]
    counts = [sum(y[n] == v for n in used) for v in labels]
    return Model(p, labels, np.array(rho), x[used], coef, counts, np.array(a) if a else None, np.array(b) if b else None)


def _held_out(k: np.ndarray, y: np.ndarray, p: Parameter, seed: int, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    d = np.zeros(len(y))
    for f in range(folds):
        a, b = np.flatnonzero(part != f), np.flatnonzero(part == f)
        if len(set(y[a])) < 2:
            d[b] = y[a][0] if len(a) else 0
            continue
        c, rho = _binary(k[np.ix_(a, a)], y[a], p)
        d[b] = k[np.ix_(b, a)] @ c - rho
    return d, y


def _sigmoid_fit(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A and B of 1 / (1 + exp(A d + B)) by Newton's method on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    loss = lambda a, b: float((np.logaddexp(0, a * d + b) - (1 - t) * (a * d + b)).sum())
    now = loss(a, b)
    for _ in range(100):
        q = 1 / (1 + np.exp(np.clip(a * d + b, -500, 500)))
        w = q * (1 - q)
        h11, h22, h21 = (d * d * w).sum() + 1e-12, w.sum() + 1e-12, (d * w).sum()
        g1, g2 = (d * (t - q)).sum(), (t - q).sum()
        if abs(g1) < 1e-5 and abs(g2) < 1e-5:
            break
        det = h11 * h22 - h21 * h21
        da, db = -(h22 * g1 - h21 * g2) / det, -(-h21 * g1 + h11 * g2) / det
        step = 1.0
        while step > 1e-10:
            new = loss(a + step * da, b + step * db)
            if new < now + 1e-4 * step * (g1 * da + g2 * db):
                a, b, now = a + step * da, b + step * db, new
                break
            step /= 2
        else:
            break
    return a, b


def decisions(m: Model, x: np.ndarray) -> np.ndarray:
    """[rows, pairs]: the value of each two-class machine (or the one there is)."""
    k = kernel_matrix(x, m.sv, m.parameter) if len(m.sv) else np.zeros((len(x), 0))
    if m.classes < 2:
        return k @ m.coef.T - m.rho
    at = np.r_[0, np.cumsum(m.counts)]
    out = []
    for i in range(m.classes):
        for j in range(i + 1, m.classes):
            a, b = slice(at[i], at[i + 1]), slice(at[j], at[j + 1])
            out.append(k[:, a] @ m.coef[j - 1, a] + k[:, b] @ m.coef[i, b] - m.rho[len(out)])
    return np.stack(out, axis=1)


def votes(m: Model, x: np.ndarray) -> np.ndarray:
    d, v, at = decisions(m, x), np.zeros((len(x), m.classes), dtype=np.int64), 0
    for i in range(m.classes):
        for j in range(i + 1, m.classes):
            v[:, i] += d[:, at] > 0
            v[:, j] += d[:, at] <= 0
            at += 1
    return v


def predict(m: Model, x: np.ndarray) -> np.ndarray:
    """Labels by most votes (the first in a tie), or regression values, or 1 and -1."""
    if m.classes < 2:
        d = decisions(m, x)[:, 0]
        return np.where(d > 0, 1.0, -1.0) if m.parameter.svm_type == "one_class" else d
    return np.array(m.labels, dtype=float)[votes(m, x).argmax(1)]


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """[rows, classes] by pairwise coupling of clipped sigmoids."""
    d, k = decisions(m, x), m.classes
    r = np.zeros((len(x), k, k))
    at = 0
    for i in range(k):
        for j in range(i + 1, k):
            p = np.clip(1 / (1 + np.exp(np.clip(m.prob_a[at] * d[:, at] + m.prob_b[at], -500, 500))), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
            at += 1
    q = -np.transpose(r, (0, 2, 1)) * r
    i = np.arange(k)
    q[:, i, i] = (np.transpose(r, (0, 2, 1)) ** 2).sum(2) - np.transpose(r, (0, 2, 1))[:, i, i] ** 2
    p = np.full((len(x), k), 1 / k)
    for _ in range(max(100, k)):
        qp = np.einsum("nij,nj->ni", q, p)
        pqp = (p * qp).sum(1)
        if np.abs(qp - pqp[:, None]).max(initial=0) < 0.005 / k:
            break
        for t in range(k):
            diff = (-qp[:, t] + pqp) / q[:, t, t]
            p[:, t] += diff
            pqp = (pqp + diff * (diff * q[:, t, t] + 2 * qp[:, t])) / (1 + diff) ** 2
            qp = (qp + diff[:, None] * q[:, t, :]) / (1 + diff)[:, None]
            p /= (1 + diff)[:, None]
    return p


def scored(df: DataFrame, m: Model, features: str = "features", *, probability: bool = False) -> DataFrame:
    """``df`` with prediction, votes (array) and, on request, probability (array)."""
    names = ["prediction", "votes", *(["probability"] if probability else [])]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "prediction double", "votes array<int>", *(["probability array<double>"] if probability else [])])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.schema.get_field_index(features))
            x = c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1) if len(c) else np.zeros((0, m.sv.shape[1]))
            new = [pa.array(predict(m, x)), pa.array(votes(m, x).tolist() if m.classes > 1 else [[]] * len(x), pa.list_(pa.int32()))]
            if probability:
                new.append(pa.array(probabilities(m, x).tolist(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return mapped(df, f, ddl)


def cross_validation(x: np.ndarray, y: np.ndarray, p: Parameter, folds: int = 5, seed: int = 0) -> np.ndarray:
    """Held-out predictions; rows of each class are spread over the folds."""
    part = np.zeros(len(y), dtype=int)
    rng = np.random.default_rng(seed)
    kinds = np.unique(y) if p.svm_type in ("c_svc", "nu_svc") else [None]
    for v in kinds:
        rows = rng.permutation(np.flatnonzero(y == v) if v is not None else np.arange(len(y)))
        part[rows] = np.arange(len(rows)) % folds
    out = np.zeros(len(y))
    for f in range(folds):
        on = part == f
        if on.any():
            out[on] = predict(train(x[~on], y[~on], p), x[on])
    return out


def powers(low: float, high: float, step: float) -> list[float]:
    return [2.0**e for e in np.arange(low, high + step / 2, step)]


def grid(spark: SparkSession, x: np.ndarray, y: np.ndarray, p: Parameter, cs: list[float] | None = None, gammas: list[float] | None = None, folds: int = 5) -> DataFrame:
    """C, gamma, score: cross-validated accuracy (or minus the squared error) of
    each cell, one task a cell; the problem is broadcast, as it is of driver size."""
    shared = spark.sparkContext.broadcast((x, y))
    cells = [(float(c), float(g)) for c in cs or powers(-5, 15, 2) for g in gammas or powers(-15, 3, 2)]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        for b in batches:
            out = []
            for c, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q = Parameter(**{**p.__dict__, "C": c, "gamma": g, "probability": False})
                got = cross_validation(x, y, q, folds)
                out.append(float((got == y).mean() if p.svm_type in ("c_svc", "nu_svc") else -((got - y) ** 2).mean()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=["C", "gamma", "score"])

    df = spark.createDataFrame(cells, "C double, gamma double").repartition(min(len(cells), 4 * spark.sparkContext.defaultParallelism))
    return mapped(df, f, "C double, gamma double, score double")


def smart_grid(x: np.ndarray, y: np.ndarray, p: Parameter, folds: int = 5, start: tuple[float, float] = (1.0, 0.1), factor: float = 4.0, most: int = 60) -> tuple[float, float, float]:
    """C, gamma, score: from ``start`` on to the best neighbour until none is better."""
    known: dict[tuple[int, int], float] = {}

    def score(at: tuple[int, int]) -> float:
        if at not in known:
            q = Parameter(**{**p.__dict__, "C": start[0] * factor ** at[0], "gamma": start[1] * factor ** at[1], "probability": False})
            got = cross_validation(x, y, q, folds)
            known[at] = float((got == y).mean() if p.svm_type in ("c_svc", "nu_svc") else -((got - y) ** 2).mean())
        return known[at]

    now = (0, 0)
    score(now)
    while len(known) < most:
        best = max(((now[0] + i, now[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda a: (score(a), a == now))
        if best == now:
            break
        now = best
    return start[0] * factor ** now[0], start[1] * factor ** now[1], known[now]


def write_model(m: Model, path: str, spark: SparkSession | None = None) -> None:
    """The text format of libsvm; with a session, on any file system it knows."""
    p = m.parameter
    out = [f"svm_type {p.svm_type}", f"kernel_type {p.kernel}"]
    if p.kernel == "polynomial":
        out.append(f"degree {p.degree}")
    if p.kernel in ("polynomial", "rbf", "sigmoid"):
        out.append(f"gamma {p.gamma!r}")
    if p.kernel in ("polynomial", "sigmoid"):
        out.append(f"coef0 {p.coef0!r}")
    row = lambda name, v: f"{name} " + " ".join(repr(float(x)) for x in v)
    out += [f"nr_class {max(2, m.classes)}", f"total_sv {len(m.sv)}", row("rho", m.rho)]
    if m.classes > 1:
        out.append("label " + " ".join(map(str, m.labels)))
    if m.prob_a is not None:
        out += [row("probA", m.prob_a), row("probB", m.prob_b)]
    if m.classes > 1:
        out.append("nr_sv " + " ".join(map(str, m.counts)))
    out.append("SV")
    for c, v in zip(m.coef.T, m.sv):
        out.append(" ".join([*(repr(float(x)) for x in c), *(f"{i + 1}:{float(x)!r}" for i, x in enumerate(v) if x)]))
    _put("\n".join(out) + "\n", path, spark)


def _put(text: str, path: str, spark: SparkSession | None) -> None:
    if spark is None:
        Path(path).write_text(text)
    else:
        write_text(spark, path, text)


def _get(path: str, spark: SparkSession | None) -> str:
    text = Path(path).read_text() if spark is None else read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return text


def read_model(path: str, width: int | None = None, spark: SparkSession | None = None) -> Model:
    head: dict[str, list[str]] = {}
    lines = iter(_get(path, spark).splitlines())
    for line in lines:
        if line.strip() == "SV":
            break
        k, *v = line.split()
        head[k] = v
    rows = [line.split() for line in lines if line.strip()]
    coef = np.array([[float(t) for t in r if ":" not in t] for r in rows]).T
    entries = [[(int(i), float(v)) for i, v in (t.split(":") for t in r if ":" in t)] for r in rows]
    sv = np.zeros((len(rows), width or max((i for e in entries for i, _ in e), default=0)))
    for at, e in enumerate(entries):
        for i, v in e:
            sv[at, i - 1] = v
    one = lambda k, d, kind: kind(head[k][0]) if k in head else d
    p = Parameter(head["svm_type"][0], head["kernel_type"][0], one("degree", 3, int), one("gamma", 0.0, float), one("coef0", 0.0, float), probability="probA" in head)
    many = lambda k: np.array([float(v) for v in head[k]]) if k in head else None
    return Model(p, [int(v) for v in head.get("label", [])], many("rho"), sv, coef, [int(v) for v in head.get("nr_sv", [])], many("probA"), many("probB"))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    """The RBF kernel of two array columns, inside whole-stage code."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.exp(-gamma * d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def kernel_column(a: Column, b: Column, p: Parameter) -> Column:
    """The kernel of two array columns, inside whole-stage code."""
    if p.kernel == "rbf":
        return rbf(a, b, p.gamma)
    if p.kernel == "linear":
        return dot(a, b)
    z = p.gamma * dot(a, b) + p.coef0
    if p.kernel == "polynomial":
        return F.pow(z, F.lit(p.degree))
    if p.kernel == "sigmoid":
        return F.tanh(z)
    raise ValueError(f"no column for the kernel {p.kernel}")


def deviation(x: np.ndarray, y: np.ndarray, p: Parameter, folds: int = 5, seed: int = 0) -> float:
    """Scale of the Laplace density of a regression's errors: the mean absolute
    held-out residual, without those beyond five standard deviations."""
    if p.svm_type not in ("epsilon_svr", "nu_svr"):
        raise ValueError("only regressions have a deviation")
    r = np.abs(y - cross_validation(x, y, p, folds, seed))
    near = r[r <= 5 * math.sqrt(2 * r.mean() ** 2)] if len(r) else r
    return float(near.mean()) if len(near) else 0.0


def interval(predicted: Column, scale: float, share: float = 0.9) -> Column:
    """(low, high) that hold the true value with that probability."""
    half = -scale * math.log(1 - share)
    return F.struct((predicted - half).alias("low"), (predicted + half).alias("high"))


def range_transform(df: DataFrame, features: str, lower: float = -1.0, upper: float = 1.0) -> dict:
    """Least and greatest of each place of an array column, one aggregate."""
    each = df.select(F.posexplode(features).alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect()
    return {"lower": lower, "upper": upper, "lo": [float(r.lo) for r in each], "hi": [float(r.hi) for r in each]}


def ranged(c: Column, t: dict) -> Column:
    """Scaled to the bounds; 0 where a feature never changes."""
    lo, hi = (F.array(*map(F.lit, t[k])) for k in ("lo", "hi"))
    span = F.zip_with(hi, lo, lambda h, lw: h - lw)
    z = F.zip_with(F.zip_with(c, lo, lambda v, lw: v - lw), span, lambda d, s: F.when(s != 0, t["lower"] + d * (t["upper"] - t["lower"]) / s).otherwise(0.0))
    return z


def gaussian_transform(df: DataFrame, features: str) -> dict:
    each = df.select(F.posexplode(features).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).orderBy("i").collect()
    return {"mean": [float(r.m) for r in each], "sd": [float(r.s or 0.0) for r in each]}


def standardised(c: Column, t: dict) -> Column:
    mean, sd = (F.array(*map(F.lit, t[k])) for k in ("mean", "sd"))
    return F.zip_with(F.zip_with(c, mean, lambda v, m: v - m), sd, lambda d, s: F.when(s != 0, d / s).otherwise(0.0))


def save_transform(t: dict, path: str, spark: SparkSession | None = None) -> None:
    _put(json.dumps(t), path, spark)


def load_transform(path: str, spark: SparkSession | None = None) -> dict:
    return json.loads(_get(path, spark))


#: rows that a group of ``kernel_table`` has, about
KERNEL_ROWS = 2048


def kernel_table(rows: DataFrame, columns: DataFrame, gamma: float, *, most_columns: int = 10_000) -> DataFrame:
    """row, column, value of every pair of (id, features): about ``most_columns``
    columns meet ``KERNEL_ROWS`` rows in a group, whatever their numbers. The value
    is null where features are null, hold a null or differ in width, as in ``rbf``."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (rows, columns)]
    kind = kinds[0] if kinds[0] == kinds[1] else "bigint"
    ddl = f"row {kind}, column {kind}, value double"
    types = to_arrow_schema(StructType.fromDDL(ddl))
    named = lambda df: df.select(F.lit(0).alias("key"), F.col("id").cast(kind).alias("id"), F.col("features").cast("array<double>").alias("value"))

    def f(c: pa.Table, r: pa.Table) -> Iterator[pa.RecordBatch]:
        row, column = (t.column("id").combine_chunks() for t in (r, c))
        for i, x in _by_width(r.column("value")):
            for j, y in _by_width(c.column("value")):
                step = max(1, (1 << 14) // len(i))
                for some in range(0, len(j), step):
                    at = j[some : some + step]
                    if x is None or y is None or x.shape[1] != y.shape[1]:
                        value = pa.nulls(len(at) * len(i), pa.float64())
                    else:
                        d = np.zeros((len(at), len(i)))
                        for n in range(x.shape[1]):  # summed in the order of the features
                            t = x[:, n] - y[some : some + step, n, None]
                            t *= t
                            d += t
                        value = pa.array(np.exp(-gamma * d).ravel())
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(np.tile(i, len(at)))), column.take(pa.array(np.repeat(at, len(i)))), value], schema=types)

    out = met(named(columns), named(rows), f, ddl, most_queries=most_columns, most_rows=KERNEL_ROWS)
    return out.select(F.col("row").cast(kinds[0]), F.col("column").cast(kinds[1]), "value")


def _by_width(vectors: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places and matrix of the vectors of each width; no matrix for those with a null."""
    v = vectors.combine_chunks()
    width = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).copy()
    if v.flatten().null_count:
        width[[k for k, x in enumerate(v.to_pylist()) if x is not None and None in x]] = -1
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        yield at, None if w < 0 else v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)


def split(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(rest, test): rows whose key hashes into the share are the test; the same on every run."""
    test = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
    return df.where(~test), df.where(test)
