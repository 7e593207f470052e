"""Positions inside groups of any size: ranges of the order, counted and shifted.

A window numbers a group in one task. Here rows are range-partitioned by group and order, so that a
group that holds most rows is spread over most tasks; each task numbers its own rows, and one row per
task and group says how many come before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

#: Task and place in it of a row once its layout is settled; see ``monotonically_increasing_id``.
_PLACE = "__place"
_TASK_BITS = 33


def number_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    weight: str | None = None,
    size: str | None = None,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """1-based position of each row of ``df`` inside its group, as a long, by columns ``order`` (nulls first).

    With ``weight`` a row takes that many places and gets the first of them; ``size`` names a column
    for the places of the whole group. Null keys are a group of
    their own. Rows that agree on ``keys`` and ``order`` stay in one task, so ``order`` should tell
    most rows of a group apart; between equal rows the order is any. An empty table gives none.

    Ranges come from a sample, so the sorted rows are settled by ``cut`` before they are counted: a
    second look at them, or a task that runs again, meets the same ranges.
    """
    by = [*keys, *order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PLACE, F.monotonically_increasing_id())
    laid = cut(laid).withColumn("__task", F.shiftright(F.col(_PLACE), _TASK_BITS))
    places = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sizes = laid.groupBy("__task", *keys).agg(F.sum(places).alias("__n"), F.min(_PLACE).alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    # own names, as both sides stem from one table
    base = F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base")
    sizes = sizes.select(F.col("__task").alias("__t"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__first", base, F.sum("__n").over(Window.partitionBy(*keys)).alias("__size"))
    if weight is not None:
        inside = Window.partitionBy("__task", *keys).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
        laid = laid.withColumn("__before", F.coalesce(F.sum(places).over(inside), F.lit(0)))
    condition = F.col("__task") == F.col("__t")
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    before = F.col("__base") + (F.col(_PLACE) - F.col("__first") if weight is None else F.col("__before"))
    whole = [F.col("__size").alias(size)] if size else []
    return laid.join(sizes, condition).select(*df.columns, (before + 1).alias(name), *whole)
