"""Top-N per group (per window end).

``row_number() <= n`` over ``partitionBy(group)`` is planned by Spark with a
partial ``WindowGroupLimit`` before the shuffle: each map task forwards at most
``n`` rows per group, so a window holding a huge number of keys never lands in
one task.  Ties are broken by the key ascending, which makes the output
deterministic (the stream-order tie-break of the original jobs is arbitrary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topn_per_group(df: DataFrame, group_cols, order_col: str, tie_cols, n: int,
                   *, rank_col: str = "rank", descending: bool = True) -> DataFrame:
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    tie_cols = [tie_cols] if isinstance(tie_cols, str) else list(tie_cols)
    if n <= 0:
        raise ValueError("n must be positive")
    primary = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*group_cols).orderBy(primary, *[F.col(c).asc() for c in tie_cols])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
