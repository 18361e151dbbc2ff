"""Customer value from the published closed forms: BG/NBD, Pareto/NBD and Gamma-Gamma.

Scoring is built from column expressions, the hypergeometric series included. Fitting collapses customers to distinct
(frequency, recency, T) rows with counts; each pass over that table sums the log-likelihood of a whole batch of candidate
parameters, so the driver only moves a handful of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NEAR, TERMS = 0.9, 60


def _gauss_series(a: Column, b: Column, c: Column, z: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    last = (F.ceil(F.lit(40.0) / -F.ln(F.greatest(z, F.lit(1e-300)))) + 30).cast("int")

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), last), lambda k: k.cast("double")), start, step)["total"]


def hyp2f1(a: Column, b: Column, c: Column, z: Column) -> Column:
    """Gauss hypergeometric function for 0 <= z < 1.

    Up to 0.9 its own series is summed. Beyond, the function and its derivative are carried towards 1 by Taylor steps
    of its differential equation, each half the distance that is left, so the work grows with the logarithm of 1 / (1 - z).
    """
    a, b, c, z = (x.cast("double") for x in (a, b, c, z))
    far = z > NEAR
    base = F.when(far, F.lit(NEAR)).otherwise(z)
    near = _gauss_series(a, b, c, base)
    slope = a * b / c * _gauss_series(a + 1, b + 1, c + 1, base)
    # Taylor numbers of places from NEAR on: 1 - z halves with each, and the last one is z itself.
    halvings = F.floor(F.log2(F.lit(1 - NEAR) / (1 - z))).cast("int")
    places = F.concat(
        F.transform(F.sequence(F.lit(0), F.greatest(halvings, F.lit(0))), lambda k: 1 - F.lit(1 - NEAR) * F.pow(F.lit(2.0), -k)),
        F.array(z),
    )
    hops = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda k: F.struct(
        F.get(places, k - 1).alias("at"), F.get(places, k).alias("to")))
    counted = F.array(*[F.lit(float(n)) for n in range(TERMS)])

    def hop(s: Column, h: Column) -> Column:
        # Coefficients are kept times the step's powers, since alone they leave the range of doubles near 1.
        at, step = h["at"], h["to"] - h["at"]
        start = F.struct(s["f"].alias("u"), (s["g"] * step).alias("v"), F.lit(0.0).alias("f"), F.lit(0.0).alias("g"))

        def term(t: Column, n: Column) -> Column:
            bend = (1 - 2 * at) * n + c - (a + b + 1) * at
            after = step * ((n + a) * (n + b) * t["u"] * step - (n + 1) * bend * t["v"])
            after = after / (at * (1 - at) * (n + 1) * (n + 2))
            return F.struct(
                t["v"].alias("u"), after.alias("v"), (t["f"] + t["u"]).alias("f"), (t["g"] + (n + 1) * t["v"]).alias("g")
            )

        done = F.aggregate(counted, start, term)
        return F.struct(done["f"].alias("f"), F.when(step > 0, done["g"] / step).otherwise(s["g"]).alias("g"))

    carried = F.aggregate(hops, F.struct(near.alias("f"), slope.alias("g")), hop)["f"]
    return F.when(far, carried).otherwise(near)


def bgnbd_alive(x: Column, tx: Column, T: Column, p: dict[str, float]) -> Column:
    """P(alive) of the BG/NBD model."""
    ratio = F.pow((F.lit(p["alpha"]) + T) / (F.lit(p["alpha"]) + tx), F.lit(p["r"]) + x)
    gone = F.lit(p["a"]) / (F.lit(p["b"]) + F.greatest(x, F.lit(1)) - 1) * ratio
    return F.when(x > 0, 1 / (1 + gone)).otherwise(F.lit(1.0))


def bgnbd_purchases(x: Column, tx: Column, T: Column, t: float, p: dict[str, float]) -> Column:
    """Expected purchases in the next t days under BG/NBD.

    The series is used after Euler's transformation: the power of x then cancels, so a busy customer cannot overflow it.
    """
    r, alpha, a, b = (F.lit(float(p[k])) for k in ("r", "alpha", "a", "b"))
    z = F.lit(float(t)) / (alpha + T + t)
    series = hyp2f1(a + b - 1 - r, a - 1, a + b + x - 1, z)
    return (a + b + x - 1) / (a - 1) * (1 - F.pow(1 - z, a - 1) * series) * bgnbd_alive(x, tx, T, p)


def pareto_alive(x: Column, tx: Column, T: Column, p: dict[str, float]) -> Column:
    """P(alive) of the Pareto/NBD model, its two series in Euler's form."""
    r, alpha, s, beta = (float(p[k]) for k in ("r", "alpha", "s", "beta"))
    power, gap, big = F.lit(r + s) + x, abs(alpha - beta), max(alpha, beta)
    second = F.lit(r) + x if alpha >= beta else F.lit(s + 1.0)

    def part(u: Column) -> Column:
        lead = F.pow((alpha + T) / (alpha + u), F.lit(r) + x) * F.pow((beta + T) / (beta + u), F.lit(s))
        edge = F.lit(1.0) if alpha >= beta else (alpha + u) / (beta + u)
        return lead * edge * hyp2f1(F.lit(1.0), second, power + 1, F.lit(gap) / (big + u))

    return 1 / (1 + F.lit(s) / power * (part(tx) - part(T)))


def pareto_purchases(x: Column, tx: Column, T: Column, t: float, p: dict[str, float]) -> Column:
    r, alpha, s, beta = (float(p[k]) for k in ("r", "alpha", "s", "beta"))
    rate = (F.lit(r) + x) * (beta + T) / ((alpha + T) * (s - 1))
    return pareto_alive(x, tx, T, p) * rate * (1 - F.pow((beta + T) / (beta + T + t), F.lit(s - 1)))


def expected_spend(x: Column, m: Column, p: dict[str, float]) -> Column:
    """Expected mean spend under Gamma-Gamma."""
    return F.lit(p["p"]) * (F.lit(p["v"]) + x * m) / (F.lit(p["p"]) * x + F.lit(p["q"]) - 1)


def score(df: DataFrame, bgnbd: dict[str, float], spend: dict[str, float], t: float) -> DataFrame:
    """P(alive), expected purchases, expected spend and their product for a recency table."""
    x, tx, T = (F.col(c).cast("double") for c in ("frequency", "recency", "T"))
    return df.withColumns(
        {
            "p_alive": bgnbd_alive(x, tx, T, bgnbd),
            "expected_purchases": bgnbd_purchases(x, tx, T, t, bgnbd),
            "expected_spend": expected_spend(x, F.col("monetary_value"), spend),
        }
    ).withColumn("expected_clv", F.col("expected_purchases") * F.col("expected_spend"))


def _lgamma(values: np.ndarray) -> np.ndarray:
    seen, place = np.unique(values, return_inverse=True)
    return np.array([math.lgamma(v) for v in seen])[place].reshape(values.shape)


def _digamma(values: np.ndarray) -> np.ndarray:
    """Derivative of the log-gamma function: eight steps up, then its series."""
    values = np.asarray(values, float)
    low = sum(1 / (values + k) for k in range(8))
    z = values + 8
    q = 1 / (z * z)
    return np.log(z) - 0.5 / z - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - low


# A likelihood maps rows and parameters to the value per row and its derivatives by the logarithms of the parameters.


def _bgnbd_loglik(pdf: pd.DataFrame, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, alpha, a, b = np.exp(theta)
    x, tx, T = (pdf[c].to_numpy(float) for c in ("frequency", "recency", "T"))
    head = _lgamma(r + x) - math.lgamma(r) + r * math.log(alpha)
    mix = math.lgamma(a + b) + _lgamma(b + x) - math.lgamma(b) - _lgamma(a + b + x)
    alive = -(r + x) * np.log(alpha + T)
    gone = math.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + tx)
    tail = np.where(x > 0, np.logaddexp(alive, gone), alive)
    left = np.where(x > 0, np.exp(gone - tail), 0.0)  # share of the second way
    stay = 1 - left
    ends = _digamma(a + b) - _digamma(a + b + x)
    grad = [
        r * (_digamma(r + x) - _digamma(r) + math.log(alpha) - stay * np.log(alpha + T) - left * np.log(alpha + tx)),
        r - alpha * (r + x) * (stay / (alpha + T) + left / (alpha + tx)),
        a * ends + left,
        b * (ends + _digamma(b + x) - _digamma(b) - left / (b + np.maximum(x, 1) - 1)),
    ]
    return head + mix + tail, np.array(grad)


def _spend_loglik(pdf: pd.DataFrame, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q, v = np.exp(theta)
    x, m = pdf["frequency"].to_numpy(float), pdf["monetary_value"].to_numpy(float)
    shape = _lgamma(p * x + q) - _lgamma(p * x) - math.lgamma(q) + q * math.log(v)
    far = np.log(x * m + v)
    grad = [
        p * x * (_digamma(p * x + q) - _digamma(p * x) + np.log(m) + np.log(x) - far),
        q * (_digamma(p * x + q) - _digamma(q) + math.log(v) - far),
        q - v * (p * x + q) / (x * m + v),
    ]
    return shape + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * far, np.array(grad)


def _batch(df: DataFrame, loglik: Callable, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-likelihood and its gradient at every row of ``points``, in one pass."""
    d = points.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = pdf["n"].to_numpy(float)
            out = []
            for i, theta in enumerate(points):
                value, grad = loglik(pdf, theta)
                out.append((i, float((w * value).sum()), *(grad @ w).tolist(), w.sum()))
            yield pd.DataFrame(out, columns=["i", "ll", *[f"g{k}" for k in range(d)], "w"])

    shape = ", ".join(["i long", "ll double", *[f"g{k} double" for k in range(d)], "w double"])
    parts = df.mapInPandas(partial, shape)
    means = [(F.sum(c) / F.sum("w")).alias(c) for c in ["ll", *[f"g{k}" for k in range(d)]]]
    values, grads = np.full(len(points), -np.inf), np.zeros((len(points), d))
    for row in parts.groupBy("i").agg(*means).collect():
        if row["ll"] is not None and math.isfinite(row["ll"]):
            values[row["i"]] = row["ll"]
            grads[row["i"]] = [row[f"g{k}"] for k in range(d)]
    return values, grads


def _maximise(
    df: DataFrame, loglik: Callable, start: Sequence[float], rounds: int, tol: float, penalty: float
) -> tuple[np.ndarray, bool, float]:
    """Quasi-Newton ascent in the logarithms of the parameters, less ``penalty`` times their sum of squares.

    One pass per round measures value and gradient at every step length tried.
    """
    theta, d = np.array(start, float), len(start)  # gradient below tol, or no rise left: converged
    lengths = 4.0 ** -np.arange(0, 6)

    def measure(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, grads = _batch(df, loglik, centres)
        squares = np.exp(centres) ** 2
        return values - penalty * squares.sum(axis=1), grads - 2 * penalty * squares

    value, grads = measure(theta[None, :])
    best, grad, inverse = value[0], grads[0], np.eye(d)
    converged = False
    for _ in range(rounds):
        if np.abs(grad).max() < tol:
            converged = True
            break
        heading = inverse @ grad
        heading *= min(1.0, 2.0 / np.abs(heading).max())
        centres = theta + np.outer(lengths, heading)
        values, grads = measure(centres)
        pick = int(values.argmax())
        if values[pick] - best <= 1e-12 * max(1.0, abs(best)):
            converged = True
            break
        moved, change = centres[pick] - theta, grad - grads[pick]
        along = float(moved @ change)
        if along > 1e-12:
            side = np.eye(d) - np.outer(moved, change) / along
            inverse = side @ inverse @ side.T + np.outer(moved, moved) / along
        theta, best, grad = centres[pick], values[pick], grads[pick]
    return theta, converged, float(np.abs(grad).max())


def _counted(rfm: DataFrame, model: str) -> tuple[DataFrame, Callable, list[str]]:
    if model == "bgnbd":
        keys, loglik, names = ["frequency", "recency", "T"], _bgnbd_loglik, ["r", "alpha", "a", "b"]
    else:
        keys, loglik, names = ["frequency", "monetary_value"], _spend_loglik, ["p", "q", "v"]
        rfm = rfm.filter("frequency > 0 AND monetary_value > 0")
    return rfm.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), loglik, names


def likelihood(rfm: DataFrame, model: str, points: Sequence[Sequence[float]]) -> DataFrame:
    """Mean log-likelihood of ``bgnbd`` or ``gamma_gamma`` at given parameters, with its derivatives by their logarithms."""
    counts, loglik, names = _counted(rfm, model)
    values, grads = _batch(counts, loglik, np.log(np.array(points, float)))
    rows = [(i, float(v), *map(float, g)) for i, (v, g) in enumerate(zip(values, grads))]
    return rfm.sparkSession.createDataFrame(rows, "point long, loglik double, " + ", ".join(f"d_{n} double" for n in names))


def _as_table(df: DataFrame, names: Sequence[str], values: Sequence[float], converged: bool, gradient: float, strict: bool) -> DataFrame:
    """Parameters, then ``converged`` (1 or 0) and the largest part of the last ``gradient``."""
    if strict and not converged:
        raise RuntimeError(f"the fit has not converged: a gradient of {gradient} is left")
    rows = [(n, float(v)) for n, v in zip([*names, "converged", "gradient"], [*values, converged, gradient])]
    return df.sparkSession.createDataFrame(rows, "parameter string, value double")


def fit_bgnbd(rfm: DataFrame, rounds: int = 40, tol: float = 1e-5, penalty: float = 0.0, strict: bool = False) -> DataFrame:
    """BG/NBD parameters as a (parameter, value) table: of most likelihood, or of the penalised one if a penalty is given.

    ``rounds`` bounds the passes; the table says if they were enough, and ``strict`` raises if not.
    """
    counts = rfm.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("n")).persist()
    scale = 10.0 / (counts.agg(F.max("T")).first()[0] or 1)
    scaled = counts.withColumns({"recency": F.col("recency") * scale, "T": F.col("T") * scale})
    theta, converged, gradient = _maximise(scaled, _bgnbd_loglik, [0.0, 0.0, 0.0, 0.0], rounds, tol, penalty)
    theta = np.exp(theta)
    counts.unpersist()
    theta[1] /= scale
    return _as_table(rfm, ["r", "alpha", "a", "b"], theta, converged, gradient, strict)


def fit_gamma_gamma(rfm: DataFrame, rounds: int = 40, tol: float = 1e-5, penalty: float = 0.0, strict: bool = False) -> DataFrame:
    """Gamma-Gamma parameters of the repeat buyers, fitted and reported as by ``fit_bgnbd``."""
    buyers = rfm.filter("frequency > 0 AND monetary_value > 0")
    counts = buyers.groupBy("frequency", "monetary_value").agg(F.count(F.lit(1)).alias("n")).persist()
    mean = counts.agg(F.sum(F.col("monetary_value") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    scaled = counts.withColumn("monetary_value", F.col("monetary_value") / mean)
    theta, converged, gradient = _maximise(scaled, _spend_loglik, [1.0, 1.0, 1.0], rounds, tol, penalty)
    theta = np.exp(theta)
    counts.unpersist()
    theta[2] *= mean
    return _as_table(rfm, ["p", "q", "v"], theta, converged, gradient, strict)


_REPORT = ("converged", "gradient")


def parameters(fitted: DataFrame) -> dict[str, float]:
    """The handful of fitted numbers as plain values."""
    return {row["parameter"]: row["value"] for row in fitted.collect() if row["parameter"] not in _REPORT}


def convergence(fitted: DataFrame) -> dict[str, float]:
    """Whether a fit converged, and the gradient it left."""
    return {row["parameter"]: row["value"] for row in fitted.collect() if row["parameter"] in _REPORT}
