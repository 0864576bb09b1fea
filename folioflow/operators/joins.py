"""Helpers around joins.

Joins here are plain equi-joins. A key that holds a large share of the facts makes one
shuffle partition large, and adaptive execution splits that partition by the files it
comes from and reads the other side once per split, for any number of such keys. This
needs the settings of `session.SETTINGS`; with `forceOptimizeSkewedJoin` the split is
also made where it costs a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unroll(df: DataFrame, keep: list[str], array: str, position: str, value: str) -> DataFrame:
    """One row per array element, with its position.

    The outer form keeps Catalyst from adding a size check on the array below, which
    would compute an expensive array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.where(F.col(position).isNotNull())
