"""Exact least squares with one intercept per category.

The category's effect is taken out first: with all inputs and the label measured from their means within the category,
the normal equations only hold the other inputs. Their sums come from one aggregate per category; the driver solves a
system as large as the number of inputs, and each category's intercept follows from its means. So any number of
categories has its own exact coefficient, and none is shared or dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.session import cut_lineage


@dataclass
class LinearFit:
    """``intercepts`` (category, intercept) is a table, as there may be many categories."""

    category: str
    inputs: list[str]
    slopes: dict[str, float]
    intercepts: DataFrame
    overall: float  # for categories that the fit has not seen
    output: str = "prediction"

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction; NULL inputs give NULL."""
        slope = sum((F.lit(b) * F.col(x) for x, b in self.slopes.items()), F.lit(0.0))
        known = self.intercepts.withColumnRenamed("intercept", "_intercept")
        joined = rows.drop(self.output).join(known, self.category, "left")
        return joined.withColumn(self.output, F.coalesce("_intercept", F.lit(self.overall)) + slope).drop("_intercept")


def fit_linear(rows: DataFrame, category: str, inputs: list[str], label: str, output: str = "prediction") -> LinearFit:
    """Least squares of ``label`` on ``inputs`` and the category. Rows with a NULL among them are ignored; inputs that
    depend on each other get the solution of least length; no rows give zeros."""
    x = {c: F.col(c).cast("double") for c in inputs}
    y = F.col(label).cast("double")
    known = rows.select(category, *[v.alias(c) for c, v in x.items()], y.alias("_y")).dropna()
    sums: list[Column] = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("_sy")]
    sums += [F.sum(c).alias(f"_s{i}") for i, c in enumerate(inputs)]
    sums += [F.sum(F.col(c) * F.col("_y")).alias(f"_y{i}") for i, c in enumerate(inputs)]
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i, len(inputs))]
    sums += [F.sum(F.col(inputs[i]) * F.col(inputs[j])).alias(f"_x{i}_{j}") for i, j in pairs]
    each = cut_lineage(known.groupBy(category).agg(*sums))
    n = F.col("n")
    totals = each.agg(
        F.sum("n"), F.sum("_sy"), *[F.sum(f"_s{i}") for i in range(len(inputs))],
        *[F.sum(F.col(f"_y{i}") - F.col(f"_s{i}") * F.col("_sy") / n) for i in range(len(inputs))],
        *[F.sum(F.col(f"_x{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / n) for i, j in pairs],
    ).first()
    k = len(inputs)
    if not totals[0]:
        return LinearFit(category, inputs, dict.fromkeys(inputs, 0.0), each.select(category, F.lit(0.0).alias("intercept")), 0.0, output)
    right, left = np.array(totals[2 + k : 2 + 2 * k]), np.zeros((k, k))
    for (i, j), value in zip(pairs, totals[2 + 2 * k :], strict=True):
        left[i, j] = left[j, i] = value
    slopes = np.linalg.lstsq(left, right, rcond=1e-12)[0].tolist()
    explained = sum((F.lit(b) * F.col(f"_s{i}") for i, b in enumerate(slopes)), F.lit(0.0))
    intercepts = each.select(category, ((F.col("_sy") - explained) / n).alias("intercept"))
    overall = (totals[1] - sum(b * s for b, s in zip(slopes, totals[2 : 2 + k], strict=True))) / totals[0]
    return LinearFit(category, inputs, dict(zip(inputs, slopes, strict=True)), intercepts, overall, output)
