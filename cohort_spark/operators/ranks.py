"""Order-dependent operators without a single-partition window.

An un-partitioned window (global row number, global running sum) would pull
the whole table into one task. Here the table is range-partitioned on the
order keys, frozen with a reliable checkpoint (range bounds come from a
sample, so re-evaluation must not move rows), and per-partition totals are
turned into offsets. Only the offsets table (one row per partition and group)
is broadcast; its size is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """Columns of a one-row aggregate as scalar values in another plan.

    All fields travel in one struct-valued scalar subquery; every use refers
    to the same subquery, which Spark runs once (no join, no cross join)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return {c: packed.getField(c) for c in one_row.columns}


def _range(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    """Range-partition on ``keys``. Without an explicit count AQE coalesces
    adjacent ranges (order is kept), so a small table does not spread over
    thousands of near-empty partitions; ids are frozen afterwards."""
    return df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order, computed in parallel.

    ``order`` must be a total order (add a key as the last tie-break)."""
    ranged = cut_lineage(_range(df, order, partitions).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranged.join(offsets, "_pid")
            .withColumn(name, (F.col("_off") + local + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def running_totals(df: DataFrame, group: list[str], order: str, values: list[str], descending: bool = False,
                   partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Per ``group``, totals of ``values`` over all rows strictly before each
    row in ``order`` (``order`` unique within a group, e.g. after a
    ``groupBy(group, order)``). Adds ``{prefix}{v}_before`` columns.

    The groups may be skewed: a hot group spans several range partitions,
    each summed by its own task. The partition id is frozen by the
    checkpoint: range bounds come from a sample seeded per execution, so two
    runs of the same exchange may place a row differently."""
    okey = F.col(order).desc() if descending else F.col(order).asc()
    gcols = [F.col(g) for g in group]
    ranged = cut_lineage(_range(df, [*gcols, okey], partitions).withColumn("_pid", F.spark_partition_id()))
    keys = group + ["_pid"]
    part_tot = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wp = (Window.partitionBy(*gcols) if group else Window.partitionBy(F.lit(0))).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, partition): bounded by groups + partitions
    offsets = part_tot.select(*keys, *[F.coalesce(F.sum(f"_t_{v}").over(wp), F.lit(0)).alias(f"_o_{v}")
                                       for v in values])
    wl = Window.partitionBy(*(gcols + [F.col("_pid")])).orderBy(okey).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(wl), F.lit(0)).alias(f"_l_{v}") for v in values])
    out = local.join(offsets, keys)
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{prefix}{v}_before") for v in values],
    )
