"""Comparing two populations of vectors: moments, Frechet and kernel distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import emd_profile, wasserstein_bins
from ..sources.scratch import stored


def profile_mean(rows: DataFrame, column: str) -> DataFrame:
    """(pos, value): the mean of each position, divided by their sum. As many rows as positions."""
    means = rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("value"))
    s = means.agg((F.sum("value") + 1e-12).alias("s"))
    return means.crossJoin(F.broadcast(s)).select("pos", (F.col("value") / F.col("s")).alias("value"))


def mean_as_row(mean: DataFrame) -> DataFrame:
    """One row with the mean profile as an array."""
    return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("reference"))


def with_distances(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Adds wasserstein and emd to the one-row reference, which is broadcast."""
    joined = rows.crossJoin(F.broadcast(reference))
    return joined.withColumns({"wasserstein": wasserstein_bins(F.col(column), F.col("reference")), "emd": emd_profile(F.col(column), F.col("reference"))}).drop("reference")


def moments(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance). Tasks add up x and x xT; one row per cell and group comes back, which
    grows with the vectors' length and not with the rows."""

    def part(frames):
        n, s, ss = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy()).astype(float)
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            flat = np.concatenate([[n], s, ss.ravel()])
            yield pd.DataFrame({"at": np.arange(len(flat)), "value": flat})

    cells = rows.select(F.col(column).cast("array<double>").alias("x")).mapInPandas(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
    if not len(cells):
        return 0, np.zeros(0), np.zeros((0, 0))
    v = cells["value"].to_numpy()
    d = int(round((np.sqrt(4 * len(v) - 3) - 1) / 2))
    n, mean, ss = int(v[0]), v[1 : d + 1] / v[0], v[d + 1 :].reshape(d, d)
    return n, mean, (ss - n * np.outer(mean, mean)) / max(1, n - 1)


def frechet(a: tuple, b: tuple) -> float | None:
    """Between (n, mean, covariance) of two populations; None if one has fewer than two rows."""
    if a[0] < 2 or b[0] < 2:
        return None
    root = np.sqrt(np.linalg.eigvals(a[2] @ b[2]).astype(complex)).real.sum()
    return float(((a[1] - b[1]) ** 2).sum() + np.trace(a[2]) + np.trace(b[2]) - 2 * root)


def kernel_moments(rows: DataFrame) -> DataFrame:
    """(i, j, k, value): sums over all rows of x_i x_j x_k with i <= j <= k, where -1 stands for a factor of one; i of -2
    is the sum of each row's kernel with itself. Tasks add up their rows; there are about d cubed / 6 sums, which stay in
    the cluster."""

    def part(frames):
        own, d, sums = 0.0, 0, None
        for f in frames:
            for lo in range(0, len(f), 1024):
                x = np.stack(f["x"].to_numpy()[lo : lo + 1024]).astype(float)
                d = x.shape[1]
                one = np.concatenate([np.ones((len(x), 1)), x], 1)
                i, j = np.triu_indices(d + 1)
                add = (one[:, i] * one[:, j]).T @ one
                own, sums = own + ((((x * x).sum(1) / d) + 1) ** 3).sum(), add if sums is None else sums + add
        if sums is not None:
            i, j = np.triu_indices(d + 1)
            at, k = np.nonzero(np.arange(d + 1)[None] >= j[:, None])
            yield pd.DataFrame({"i": np.append(i[at], -1) - 1, "j": np.append(j[at], 0) - 1, "k": np.append(k, 0) - 1, "value": np.append(sums[at, k], own)})

    return rows.select(F.col("x").cast("array<double>").alias("x")).mapInPandas(part, "i int, j int, k int, value double").groupBy("i", "j", "k").agg(F.sum("value").alias("value"))


def kernel_distance(a: DataFrame, b: DataFrame) -> float | None:
    """Unbiased squared MMD with (x.y / d + 1) cubed, over all rows: the kernel's sum over pairs is one of products of moments of order
    0 to 3, each as often as its factors can be ordered, added up where the moments meet. None if a side has fewer than two
    rows. Rows are told apart as rows, not by item."""
    both = kernel_moments(a).withColumnRenamed("value", "u").join(kernel_moments(b).withColumnRenamed("value", "v"), ["i", "j", "k"], "full").na.fill(0.0, ["u", "v"])
    both = stored(both, "kernel-moments")
    sizes = both.agg(F.max("k").alias("last"), *[F.sum(F.when(where, F.col(c))).alias(f"{name}_{c}") for c in "uv" for name, where in (("n", F.col("i").eqNullSafe(-1) & (F.col("k") == -1)), ("own", F.col("i") == -2))]).first()
    n, m, d = round(sizes["n_u"] or 0), round(sizes["n_v"] or 0), (sizes["last"] if sizes["last"] is not None else -1) + 1
    if n < 2 or m < 2:
        return None
    factors = sum(((F.col(c) >= 0).cast("int") for c in "jk"), (F.col("i") >= 0).cast("int"))
    orders = F.when((F.col("i") == F.col("j")) & (F.col("j") == F.col("k")), 1).when((F.col("i") == F.col("j")) | (F.col("j") == F.col("k")), 3).otherwise(6)
    weight = orders / F.pow(F.lit(float(d)), factors)
    sums = both.filter("i > -2").agg(F.sum(weight * F.col("u") * F.col("u")).alias("uu"), F.sum(weight * F.col("v") * F.col("v")).alias("vv"), F.sum(weight * F.col("u") * F.col("v")).alias("uv")).first()
    return (sums.uu - sizes["own_u"]) / (n * (n - 1)) + (sums.vv - sizes["own_v"]) / (m * (m - 1)) - 2 * sums.uv / (n * m)


def mahalanobis(rows: DataFrame, reference: DataFrame, column: str, keep: int = 10, ridge: float = 1e-3, least: int = 30) -> DataFrame:
    """d2 and score exp(-d2 / 2) in the reference's first principal components; null and .5 if the reference
    has fewer than `least` rows."""
    n, mean, cov = moments(reference, column)
    if n < least:
        return rows.withColumns({"d2": F.lit(None).cast("double"), "radiomics_score": F.lit(0.5)})
    values, basis = np.linalg.eigh(cov)
    basis = basis[:, ::-1][:, :keep]
    inverse = np.linalg.inv(np.diag(values[::-1][:keep]) + ridge * np.eye(keep))

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        delta = (np.stack(x.to_numpy()).astype(float) - mean) @ basis if len(x) else np.zeros((0, keep))
        return pd.Series(np.einsum("ni,ij,nj->n", delta, inverse, delta))

    return rows.withColumn("d2", distance(F.col(column))).withColumn("radiomics_score", F.exp(-F.col("d2") / 2))
