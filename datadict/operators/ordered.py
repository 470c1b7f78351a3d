"""Positions and running sums inside groups of any size.

A plain `row_number() over (partition by g order by o)` hands each group to one task, so a group
holding a third of all rows would be one task's work. Both forms here cut a group into slices that
follow the order, number the rows inside a slice, and add the sizes of the earlier slices, which
are few and already counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datadict.storage import store

# Members that one task sorts before the slices of a list are put together.
LIST_SLICE = 4096

# Rows of a group that one task sorts whole; only larger groups are cut into slices.
HOT_GROUP = 1 << 20

# Counters that tell whether a group can be that large, before groups are counted one by one.
HOT_BUCKETS = 1 << 16

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def slice_of(position: Column, size: int = LIST_SLICE) -> Column:
    """Slice number of a 1-based position."""
    return F.floor((position - 1) / size).cast("int")


def ordered_lists(df: DataFrame, key: Sequence[str], position: str, fields: Sequence[str | Column], name: str,
                  size: int = LIST_SLICE) -> DataFrame:
    """One row per key: its members as structs (position, fields) in order, however many they are.

    Slices of a list are collected and sorted by tasks of their own; what meets in the key's task are
    sorted arrays in the order of their slices, which are only put one after the other. Null positions
    come first. `position` is the name of a whole-number column, 1 for the first member.
    """
    members = F.array_sort(F.collect_list(F.struct(position, *fields)))
    sorted_slices = df.groupBy(*key, slice_of(F.col(position), size).alias("_slice")).agg(members.alias("_members"))
    in_order = F.array_sort(F.collect_list(F.struct("_slice", "_members")))
    return sorted_slices.groupBy(*key).agg(F.flatten(F.transform(in_order, lambda s: s["_members"])).alias(name))


def named_lists(df: DataFrame, key: Sequence[str], fields: Sequence[str | Column], name: str) -> DataFrame:
    """One row per key: its members as structs, in the order of the first field. Map tasks collect their own members."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _met(names: Sequence[str]) -> Column:
    """Null-safe equality of rows `r` and marks `m`."""
    return reduce(lambda a, b: a & b, [F.col(f"r.{n}").eqNullSafe(F.col(f"m.{n}")) for n in names])


def _earlier(counts: DataFrame, group: Sequence[str], slice_col: str, size_col: str, name: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(size_col).over(before), F.lit(0)))


def _hot_groups(df: DataFrame, group: Sequence[str], hot: int) -> DataFrame:
    """Groups of more than `hot` rows. Only groups that share a hash bucket of more rows are counted themselves."""
    bucket = F.pmod(F.xxhash64(*group), F.lit(HOT_BUCKETS))
    full = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot)
    near = df.select(*group, bucket.alias("_bucket")).join(F.broadcast(full.select("_bucket")), "_bucket", "left_semi")
    return near.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot).select(*group)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], slice_by: Column,
                name: str = "rn", hot: int | None = None) -> DataFrame:
    """1-based row number per group; `slice_by` must not decrease along `order`.

    Group columns may not be null (they are the key of a table, an index or a constraint); rows with
    a null there drop out. The rows are shuffled once, on (group, slice). A group of more than `hot` rows
    is cut into slices, all others are one. Which groups are that large, and the sizes of their slices, come
    from narrow scans that are aggregated before their shuffle; they are few, so the rows meet them without another.
    """
    known = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group]))
    large = _hot_groups(known, group, hot or HOT_GROUP).withColumn("_hot", F.lit(True))
    rows = known.join(F.broadcast(large), list(group), "left").withColumn(
        "_slice", F.when(F.col("_hot"), F.coalesce(slice_by.cast("bigint"), F.lit(-(1 << 62)))).otherwise(F.lit(0)))
    counts = rows.where("_hot").groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = _earlier(counts, group, "_slice", "_size", "_before").drop("_size")
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        rows.withColumn("_at", F.row_number().over(local))
        .join(F.broadcast(offsets), [*group, "_slice"], "left")
        .withColumn(name, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_slice", "_at", "_before", "_hot")
    )


def arrange(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partitioned by (group, order), sorted and stored, with `_slice` and `_row`.

    A hot group spreads over as many slices as its rows need. Storing them fixes the slices: computing
    the range bounds twice may give other bounds. Later uses read only the columns they need.
    """
    sorted_rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    stored = store(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "arranged")
    return (
        stored.withColumn("_slice", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id")
    )


def number_rows_by_range(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based row number per group for any sortable order, without a window over the rows."""
    rows = arrange(df, group, order)
    marks = rows.groupBy(*group, "_slice").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    # Stored marks have a known size: where they are few, the rows meet them without a shuffle.
    marks = store(_earlier(marks, group, "_slice", "_size", "_before").drop("_size"), "marks").alias("m")
    rows = rows.alias("r")
    kept = [F.col(f"r.{n}") for n in df.columns]
    return rows.join(marks, _met([*group, "_slice"])).select(
        *kept, (F.col("_row") - F.col("_first") + F.col("_before") + 1).cast("bigint").alias(name))


def sum_before(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str) -> DataFrame:
    """Sum of `weight` over the earlier rows of the group (0 for the first)."""
    rows = arrange(df, group, order)
    sizes = rows.groupBy(*group, "_slice").agg(F.sum(weight).alias("_size"))
    marks = _earlier(sizes, group, "_slice", "_size", "_before").drop("_size").alias("m")
    inside = (Window.partitionBy(*group, "_slice").orderBy("_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).alias("r")
    kept = [F.col(f"r.{n}") for n in df.columns]
    return rows.join(marks, _met([*group, "_slice"])).select(
        *kept, (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))
