"""Logistic regressions of many folds in one plan.

A row holds its vector, its label (0 or 1) and `weights`, an array with its weight in the training of each fold (0: not in it). All folds are fitted by one iteratively reweighted least squares: a pass over the
rows adds up every fold's loss, gradient and curvature by tasks, so the number of jobs is that of the slowest fold's steps, not that of folds times steps. A step that does not lower its fold's
loss is halved, for that fold alone. Medians for missing values and scales of columns, where asked for, are each fold's own, from its training rows.

What a task holds, and what comes to the driver, is a square of (columns + 1) numbers for each of the folds fitted together: as many folds as BLOCK numbers allow, at least one, the others in further blocks.

Defined results: rows without a vector or label, or with weights of 0 only, train nothing; a row without a vector has null scores. Repeated rows count as often as they are there. A fold whose training side has no row is an
error. Without a penalty, classes that a plane separates have no finite fit: steps then end where the gradient is as good as zero. Of an empty table of rows nothing can be fitted (an error).
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import _summed, lister

#: Numbers of all curvatures that are added up together (32 MB); a fit ends where no gradient is over TOLERANCE times its fold's weight and its column's root mean square.
BLOCK, TOLERANCE = 1 << 22, 1e-9


@dataclass
class Folds:
    """coef: intercept and weights of each fold; fill, mean, scale: what each fold does to vectors first; jobs: passes over the rows."""

    coef: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    jobs: int


def _passer():
    """How tasks add up a block of folds; made anew so that workers get it with the job."""
    lists = lister()

    def summed(rows: DataFrame, state, each, length: int, width: int) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(state)

        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x, w = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in (0, 2))
                    z = each(x, b.column(1).to_numpy(zero_copy_only=False), w, sent.value)
                    total = z if total is None else total + z
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lists(total)], names=["i", "z"])

        out = _summed(rows.mapInArrow(run, "i long, z array<double>"), length, width)
        sent.unpersist()
        return out

    return summed


def _curvature(x, y, w, state):
    """For each fold: rows of the curvature, then the gradient with the loss behind it."""
    folds, coef, fill, mean, scale = state
    d = x.shape[1] + 1
    out = np.zeros((len(folds), d + 1, d + 1))
    for k, f in enumerate(folds):
        own = w[:, f] > 0
        if own.any():
            z, t, v = (np.hstack([np.ones((int(own.sum()), 1)), (np.where(np.isnan(x[own]), fill[f], x[own]) - mean[f]) / scale[f]]), y[own], w[own, f])
            u = z @ coef[k]
            p = 0.5 * (1 + np.tanh(u / 2))
            out[k, :d, :d] = (z * (v * p * (1 - p))[:, None]).T @ z
            out[k, d, :d] = z.T @ (v * (p - t))
            out[k, d, d] = v @ (np.logaddexp(0, u) - t * u)
    return out.reshape(-1, d + 1)


def _moments(x, y, w, state):
    """For each fold: sums of the training rows' values, or of squares about the means, and the number of rows."""
    fill, mean = state
    out = np.zeros((w.shape[1], x.shape[1] + 1))
    for f in range(w.shape[1]):
        own = w[:, f] > 0
        z = np.where(np.isnan(x[own]), fill[f], x[own])
        out[f, :-1] = z.sum(0) if mean is None else ((z - mean[f]) ** 2).sum(0)
        out[f, -1] = own.sum()
    return out


def _medians(rows: DataFrame, folds: int, d: int) -> np.ndarray:
    """Each fold's lower median of the columns that miss a value somewhere; 0 for the others, which need none, and where a fold has no value."""
    some = rows.select(F.posexplode("embedding").alias("at", "v")).groupBy("at").agg(F.count_if(F.col("v").isNull() | F.isnan("v")).alias("gone")).where("gone > 0")
    at = [r["at"] for r in some.collect()]
    out = np.zeros((folds, d))
    if at:
        x = rows.select("weights", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("embedding")[i].alias("v")) for i in at])).alias("e")).where("e.v is not null and not isnan(e.v)")
        x = x.select("e.*", F.posexplode("weights").alias("fold", "w")).where("w > 0")
        for r in x.groupBy("fold", "at").agg(F.percentile_approx("v", 0.5, 10_000).alias("m")).collect():
            out[r["fold"], r["at"]] = r["m"]
    return out


def fit_folds(rows: DataFrame, folds: int, penalty: float = 0.0, standardise: bool = False, most: int = 200) -> Folds:
    """rows(embedding, label, weights of `folds` numbers); penalty: times half the squared length of the weights (not of the intercept), 1 / C of other libraries.

    standardise: missing values get the fold's (lower) median, columns its mean and sample deviation (a constant column is left as 0). Otherwise a missing value is an error."""
    rows = rows.where("embedding is not null and label is not null").select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"), F.col("weights").cast("array<double>").alias("weights"))
    first = rows.select(F.size("embedding")).first()
    if first is None:
        raise ValueError("no row to fit")
    d, summed = first[0], _passer()
    fill, mean, scale = np.zeros((folds, d)), np.zeros((folds, d)), np.ones((folds, d))
    jobs = 1
    if standardise:
        fill = _medians(rows, folds, d)
        s = summed(rows, (fill, None), _moments, folds, d + 1)
        mean = s[:, :-1] / np.maximum(s[:, -1:], 1)
        q = summed(rows, (fill, mean), _moments, folds, d + 1)
        scale = np.sqrt(q[:, :-1] / np.maximum(q[:, -1:] - 1, 1))
        scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = np.inf  # a constant column says nothing
        jobs += 4
    r = rows.select(F.max(F.size("weights")), F.min(F.size("weights")), F.count_if(F.size("embedding") != d), F.min("label"), F.max("label"), F.count_if(F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))).first()
    if (r[0], r[1], r[2]) != (folds, folds, 0) or r[3] < 0 or r[4] > 1 or (r[5] and not standardise):
        raise ValueError("weights of each fold, vectors of one length, labels of 0 and 1, and no missing values are wanted")
    total = np.asarray([x["s"] for x in rows.select(F.posexplode("weights").alias("f", "w")).groupBy("f").agg(F.sum("w").alias("s")).orderBy("f").collect()])
    if (total <= 0).any():
        raise ValueError(f"folds without a training row: {np.flatnonzero(total <= 0).tolist()}")
    ridge, coef = np.r_[0.0, np.full(d, penalty)], np.zeros((folds, d + 1))
    at_once = max(1, BLOCK // (d + 2) ** 2)
    for a in range(0, folds, at_once):
        block = np.arange(a, min(folds, a + at_once))
        coef[block], n = _newton(rows, summed, block, total[block], ridge, (fill, mean, scale), most)
        jobs += n
    return Folds(coef, fill, mean, scale, jobs + 2)


def _newton(rows, summed, block, total, ridge, prepare, most) -> tuple[np.ndarray, int]:
    """Coefficients of a block of folds, and the passes that took."""
    m, d = len(block), len(ridge)
    at, step, size, unit = np.zeros((m, d)), np.zeros((m, d)), np.ones(m), np.ones((m, d))
    loss, slope = np.full(m, np.inf), np.zeros(m)
    left = np.arange(m)
    for jobs in range(1, most + 1):
        trial = at[left] + size[left, None] * step[left]
        z = summed(rows, (block[left], trial, *prepare), _curvature, len(left) * (d + 1), d + 1).reshape(len(left), d + 1, d + 1)
        still = []
        for k, i in enumerate(left):
            value = z[k, d, d] + 0.5 * ridge @ trial[k] ** 2
            if value <= loss[i] + 1e-4 * size[i] * slope[i] + 1e-13 * total[i] or size[i] < 1e-9:
                at[i], loss[i], size[i] = trial[k], value, 1.0
                gradient = z[k, d, :d] + ridge * trial[k]
                if jobs == 1:  # at 0 every row's curvature is a quarter of its square: the columns' usual sizes
                    usual = np.sqrt(4 * np.diagonal(z[k])[:d] / total[i])
                    unit[i] = np.where(usual > 0, usual, 1.0)
                if (np.abs(gradient) / unit[i]).max() <= TOLERANCE * total[i]:
                    continue
                # columns of one size, so that large ones don't hide small ones
                curve = (z[k, :d, :d] + np.diag(ridge)) / np.outer(unit[i], unit[i])
                curve[np.diag_indices(d)] += 1e-12 * np.diagonal(curve) + 1e-200
                step[i] = -np.linalg.solve(curve, gradient / unit[i]) / unit[i]
                slope[i] = min(0.0, gradient @ step[i])
            else:
                size[i] /= 2
            still.append(i)
        left = np.asarray(still, dtype=int)
        if not len(left):
            return at, jobs
    raise ArithmeticError(f"{len(left)} of {m} folds have not settled in {most} passes")


def scored(rows: DataFrame, model: Folds, name: str = "scores") -> DataFrame:
    """rows with an array of the chance of label 1 by each fold's fit."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def chances(v: pd.Series) -> pd.Series:
        m = sent.value
        own = v.notna().to_numpy()
        out = np.full((len(v), len(m.coef)), np.nan)
        if own.any():
            x = np.stack([np.asarray(a, dtype=float) for a in v[own]])
            for f, c in enumerate(m.coef):
                u = c[0] + ((np.where(np.isnan(x), m.fill[f], x) - m.mean[f]) / m.scale[f]) @ c[1:]
                out[own, f] = 0.5 * (1 + np.tanh(u / 2))
        return pd.Series([a if k else None for a, k in zip(out, own, strict=True)], index=v.index, dtype=object)

    return rows.withColumn(name, chances(F.col("embedding").cast("array<double>")))


def balanced(rows: DataFrame, folds: int) -> DataFrame:
    """Weights times n / (2 x the class's share of n) in each fold, so that both classes weigh the same."""
    each = rows.select("label", F.posexplode("weights").alias("f", "w")).groupBy("f").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)).alias("n1"))
    found = {r["f"]: (r["n"], r["n1"]) for r in each.collect()}
    n, n1 = (np.asarray([found.get(f, (0.0, 0.0))[k] for f in range(folds)], dtype=float) for k in (0, 1))
    of = [F.array(*[F.lit(float(v)) for v in n / (2 * np.maximum(c, 1e-300))]) for c in (n - n1, n1)]
    return rows.withColumn("weights", F.zip_with("weights", F.when(F.col("label") == 1, of[1]).otherwise(of[0]), lambda w, c: F.when(w > 0, w * c).otherwise(0.0)))
