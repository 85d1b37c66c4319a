"""Logistic fits: Newton steps whose sums are one distributed aggregate per step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.operators.survival import (COMPARISON_MODELS, EXPECTED_DIRECTION, FEATURES, clipped_z,
                                             feature_scaling, sigmoid, wald_p)

MAX_GROUPS = 10_000


def _betas_frame(samples: DataFrame, by: str, betas: Mapping, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """Current coefficients as a table with one row per group: groups x (features+1) numbers."""
    spark = samples.sparkSession
    fields = [samples.schema[by]] + [T.StructField(f"b_{m}_{j}", T.DoubleType())
                                     for m, cols in models.items() for j in range(len(cols) + 1)]
    rows = [(g, *[float(v) for m, cols in models.items() for v in betas[g, m]]) for g in {k[0] for k in betas}]
    return spark.createDataFrame(rows, T.StructType(fields))


def _step_sums(model: str, cols: Sequence[str], label: str) -> list[Column]:
    x = [F.lit(1.0), *[F.col(c) for c in cols]]
    eta = F.col(f"b_{model}_0")
    for j, c in enumerate(cols):
        eta = eta + F.col(f"b_{model}_{j + 1}") * F.col(c)
    p = sigmoid(eta)
    w = p * (1 - p)
    grad = [F.sum(xi * (F.col(label) - p)).alias(f"g_{model}_{i}") for i, xi in enumerate(x)]
    info = [F.sum(w * x[i] * x[j]).alias(f"h_{model}_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return grad + info


def fit_logistic(samples: DataFrame, models: Mapping[str, Sequence[str]], by: str = "industry_code",
                 label: str = "label", max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """Unregularised logistic fit of every model in every group, all in the same passes.

    Per step the cluster reduces the rows to k + k(k+1)/2 sums per group and model; only the
    k x k solve happens on the driver. Standard errors come from the information matrix at
    the converged coefficients. Columns: group, model, term (0 = intercept), name, beta, se,
    iterations, converged.
    """
    groups = [r[0] for r in samples.select(by).distinct().limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups to fit")
    betas = {(g, m): np.zeros(len(c) + 1) for g in groups for m, c in models.items()}
    iterations = dict.fromkeys(betas, 0)
    open_fits = set(betas)
    final: dict = {}
    for step in range(max_iter + 1):
        joined = samples.join(F.broadcast(_betas_frame(samples, by, betas, models)), by)   # at most MAX_GROUPS rows
        sums = joined.groupBy(by).agg(*[e for m, c in models.items() for e in _step_sums(m, c, label)]).collect()
        for row in sums:
            for m, cols in models.items():
                key, k = (row[by], m), len(cols) + 1
                info = np.empty((k, k))
                for i in range(k):
                    for j in range(i, k):
                        info[i, j] = info[j, i] = row[f"h_{m}_{i}_{j}"]
                if key not in open_fits or iterations[key] >= max_iter:
                    final.setdefault(key, info)
                    continue
                delta = np.linalg.solve(info, np.array([row[f"g_{m}_{i}"] for i in range(k)]))
                betas[key] = betas[key] + delta
                iterations[key] += 1
                if np.abs(delta).max() < tol:
                    open_fits.discard(key)
        if len(final) == len(betas):
            break
    out = []
    for (g, m), info in final.items():
        se = np.sqrt(np.diag(np.linalg.inv(info)))
        for i, name in enumerate(["intercept", *models[m]]):
            out.append((g, m, i, name, float(betas[g, m][i]), float(se[i]), iterations[g, m], (g, m) not in open_fits))
    fields = [samples.schema[by], *[T.StructField(n, t) for n, t in (
        ("model", T.StringType()), ("term", T.IntegerType()), ("name", T.StringType()), ("beta", T.DoubleType()),
        ("std_error", T.DoubleType()), ("iterations", T.IntegerType()), ("converged", T.BooleanType()))]]
    return samples.sparkSession.createDataFrame(out, T.StructType(fields))


def standardise(samples: DataFrame, scaling: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Replace features by clipped z-values of the training rows."""
    j = samples.join(scaling, "industry_code")
    return j.select(*[c for c in samples.columns if c not in features],
                    *[clipped_z(F.col(f), F.col(f"mean_{f}"), F.col(f"std_{f}")).alias(f) for f in features])


def compare_models(samples: DataFrame, models: Mapping[str, Sequence[str]] = COMPARISON_MODELS) -> DataFrame:
    """Fit every model on the same training rows (``part = 'train'``), with p-values."""
    train = samples.where("part = 'train'")
    z = standardise(train, feature_scaling(train)).select("industry_code", "label", *FEATURES).persist()
    try:
        fits = fit_logistic(z, models)
    finally:
        z.unpersist()
    return fits.withColumn("p_value", wald_p(F.col("beta"), F.col("std_error")))


def model_table(fits: DataFrame, scaling: DataFrame, model: str, features: Sequence[str]) -> DataFrame:
    """One row per industry, the shape ``score_rows`` reads."""
    b = fits.where(F.col("model") == model).groupBy("industry_code").agg(
        F.max(F.when(F.col("name") == "intercept", F.col("beta"))).alias("intercept"),
        *[F.max(F.when(F.col("name") == f, F.col("beta"))).alias(f"beta_{f}") for f in features])
    return b.join(scaling, "industry_code")


def sign_agreement(fits: DataFrame) -> DataFrame:
    """Coefficients with the sign the definition expects of the score (score falls as beta rises)."""
    expected = None
    for name, d in EXPECTED_DIRECTION.items():
        expected = F.when(F.col("name") == name, d) if expected is None else expected.when(F.col("name") == name, d)
    sign = F.when(-F.col("beta") > 0, 1).when(-F.col("beta") < 0, -1).otherwise(0)
    return fits.withColumn("expected", expected).withColumn(
        "agrees", F.when(F.col("expected").isNull() | (F.col("expected") == 0), F.lit(None).cast("boolean"))
        .otherwise(F.col("expected") == sign))
