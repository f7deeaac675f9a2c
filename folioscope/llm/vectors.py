"""Vector columns for the embedding operators: which rows are sound, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(column: str) -> Column:
    """True for a vector that is not null and has only finite entries; an empty one is sound."""
    broken = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~broken, F.lit(False))


def usual_size(df: DataFrame, column: str) -> int:
    """The commonest positive length of a vector column; of equally common ones the greatest; 0 if there is none."""
    sizes = df.select(F.size(column).alias("d")).where("d > 0").groupBy("d").count()
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column without nulls whose lists all have `width` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)
