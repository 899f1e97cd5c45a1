"""What the vector operators share: which vectors take part, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plain(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec of every usable row: floats stay floats, all else becomes double; no negative zeros."""
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    vector = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    return df.filter(usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vec"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def of_width(df: DataFrame) -> list[tuple[int, int]]:
    """Every length of vectors in ``df`` and how many there are."""
    rows = df.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).collect()
    return sorted((r.width, r.n) for r in rows)
