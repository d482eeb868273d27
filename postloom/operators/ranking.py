"""Row numbers that do not pass a hot group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import broadcast_if_small, checkpointed

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: upper bits partition, lower 33 bits row


def positions(df: DataFrame, keys: list[str], order: list[Column | tuple[Column, bool]],
              group: str | None = None, name: str = "position") -> DataFrame:
    """Rows of `keys` (plus `group`) numbered 1..n in `order`, per group or overall.

    `row_number()` over a window would sort a whole group in one task. Here the rows are sorted globally
    (range partitions split a hot group), and a row's number is its place in its partition plus the
    number of rows of its group in earlier partitions. The second part has one row per partition and
    group. `order` must be total (a pair `(column, True)` sorts descending) and the group not null. The sorted keys are written to the checkpoint folder, because both
    parts must see the same partitions.
    """
    group_col = F.lit(0) if group is None else F.col(group)
    slim = df.select(*[F.col(k) for k in keys], group_col.alias("_group"), *[c.alias(f"_o{i}")
                     for i, (c, _) in enumerate(_split(order))])
    directions = [F.desc(f"_o{i}") if desc else F.asc(f"_o{i}") for i, (_, desc) in enumerate(_split(order))]
    placed = slim.orderBy("_group", *directions).select(*keys, "_group", F.monotonically_increasing_id().alias("_at"))
    placed = checkpointed(placed.select(*keys, "_group", F.shiftrightunsigned("_at", 33).alias("_slot"),
                                        F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)).alias("_row")))
    earlier = Window.partitionBy("_group").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (placed.groupBy("_group", "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
              .select("_group", "_slot", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
                      .alias("_shift")))
    numbered = placed.join(broadcast_if_small(checkpointed(pieces)), ["_group", "_slot"])
    columns = [F.col(k) for k in keys] + [(F.col("_row") + F.col("_shift")).cast("bigint").alias(name)]
    if group is not None and group not in keys:
        columns.insert(0, F.col("_group").alias(group))
    return numbered.select(*columns)


def _split(order: list[Column | tuple[Column, bool]]) -> list[tuple[Column, bool]]:
    """Order items as (column, descending)."""
    return [item if isinstance(item, tuple) else (item, False) for item in order]


def newest_first_order() -> list[tuple[Column, bool]]:
    return [(F.col("saved_at"), True), (F.col("id"), False)]
