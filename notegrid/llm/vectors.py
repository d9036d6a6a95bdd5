"""What the vector operators share: which vectors count, and how they travel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, has finite components only, at least one of them not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def width_counts(rows: DataFrame, vector: str = "embedding") -> dict[int, int]:
    """Number of vectors per number of components. d different widths need about d * d / 2 components
    of data, so this table stays small; vectors are compared only with those of their own width."""
    return {r.d: r.n for r in rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()}


def matrix(lists, width: int) -> np.ndarray:
    """An Arrow or pandas column of equally long lists as a float64 matrix."""
    if not len(lists):
        return np.zeros((0, width))
    return np.stack([np.asarray(x, np.float64) for x in lists]).reshape(len(lists), width)
