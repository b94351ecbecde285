"""Registers functions for use in SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from tapeworks.functions import diagrams as D
from tapeworks.session import ship

POINTS = "array<array<double>>"


def _stack(points) -> np.ndarray:
    return np.stack([np.asarray(p, float) for p in points]) if points is not None and len(points) else np.zeros((0, 2))


@udtf(returnType="dim int, birth double, pers double")
class RipsDiagram:
    """SELECT * FROM rips_diagram(points): one row for each feature."""

    def eval(self, points: list[list[float]]) -> Iterator[tuple[int, float, float]]:
        for dim, found in enumerate(D.rips(_stack(points))):
            for birth, pers in found:
                yield dim, float(birth), float(pers)


def register(spark: SparkSession) -> list[str]:
    """landscape_mean(diagram, levels), image_sum(diagram, size, sigma), vr_epsilon(points, share), rips_diagram(points)."""

    ship(spark)

    @pandas_udf("array<double>")
    def landscape_mean(diagram: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([D.landscape(_stack(x), int(k)).tolist() for x, k in zip(diagram, levels, strict=True)], dtype=object)

    @pandas_udf("array<double>")
    def image_sum(diagram: pd.Series, size: pd.Series, sigma: pd.Series) -> pd.Series:
        return pd.Series([D.image(_stack(x), int(n), float(s)).tolist() for x, n, s in zip(diagram, size, sigma, strict=True)], dtype=object)

    @pandas_udf("double")
    def vr_epsilon(points: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series([D.epsilon_for_share(_stack(x), float(q)) for x, q in zip(points, share, strict=True)])

    for name, f in (("landscape_mean", landscape_mean), ("image_sum", image_sum), ("vr_epsilon", vr_epsilon)):
        spark.udf.register(name, f)
    spark.udtf.register("rips_diagram", RipsDiagram)
    return ["landscape_mean", "image_sum", "vr_epsilon", "rips_diagram"]
