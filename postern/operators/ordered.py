"""Ordered computations that stay bounded when one key holds most of the rows.

A plain window `partitionBy(key).orderBy(x)` puts a whole key into one task. Here the rows of every key
fall into ordered *blocks*, each block is windowed on its own, and the block totals (few rows) carry the
state from one block to the next. The results are those of the plain window, at every size by one path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"max": F.max, "sum": F.sum, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column | str | None,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Running max/min/sum of each `aggs` entry over the rows before (or up to) the current one.

    `block` must not decrease along `order`; given as a column name it is kept, so that several
    calls in a row share one partitioning. Without a block it is the plain window. A running *last
    non-null* is a running max of `struct(order columns, value)`.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumns({name: _AGG[fn](value).over(w) for name, (fn, value) in aggs.items()})
    kept = isinstance(block, str)
    blk = block if kept else "_blk"
    src = df if kept else df.withColumn("_blk", block)
    for name, (_, value) in aggs.items():
        src = src.withColumn(f"_v_{name}", value)
    totals = src.groupBy(*keys, blk).agg(*[_AGG[fn](f"_v_{name}").alias(f"_t_{name}") for name, (fn, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, blk, *[_AGG[fn](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (fn, _) in aggs.items()])
    # a first block carries nothing, so keys of one block stay out of the join
    carry = carry.where(reduce(or_, [F.col(f"_c_{name}").isNotNull() for name in aggs]))
    inside = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for name, (fn, _) in aggs.items():
        src = src.withColumn(f"_l_{name}", _AGG[fn](f"_v_{name}").over(inside))
    out = src.join(carry, [*keys, blk], "left")
    for name, (fn, _) in aggs.items():
        local, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if fn == "sum":
            value = F.when(local.isNull() & carried.isNull(), None).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        else:
            value = (F.greatest if fn == "max" else F.least)(local, carried)
        out = out.withColumn(name, value)
    drop = ([] if kept else ["_blk"]) + [f"_{p}_{n}" for n in aggs for p in "vlc"]
    return out.drop(*drop)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    blocks: Sequence[Column],
    name: str = "rn",
) -> DataFrame:
    """1-based row number of each row within `keys` along `order`.

    `blocks` are ascending block columns that agree with `order` (its leading part, coarsened).
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    src = df
    for n, expr in zip(names, blocks):
        src = src.withColumn(n, expr)
    sizes = src.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        src.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, *names])
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_rn", "_off", *names)
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Occurrences of each non-null value per key: the pre-aggregation ranks work on."""
    return df.where(value.isNotNull()).groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def scale_block(value: Column, per_octave: int = 32) -> Column:
    """Ascending block of a number, fine at every scale: `per_octave` blocks between a value and its double."""
    far = 1100 * per_octave  # above any logarithm of a double
    size = F.floor(F.log2(F.abs(value)) * per_octave) + far
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def exact_median(df: DataFrame, keys: Sequence[str], value: Column, per_octave: int = 32) -> DataFrame:
    """Exact median per key, without holding a key's values in one task.

    Counts per distinct value are summed in value order; the one or two middle values are the
    rows whose cumulative count spans the middle positions.
    """
    counts = value_counts(df, keys, value.cast("double"))
    ranked = running(counts, keys, ["value"], scale_block(F.col("value"), per_octave), {"upto": ("sum", F.col("n"))}, inclusive=True)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    lo = F.floor((F.col("total") + 1) / 2)
    hi = F.floor((F.col("total") + 2) / 2)
    first = F.col("upto") - F.col("n") + 1
    hit = ranked.join(totals, list(keys))
    return (
        hit.where((first <= hi) & (F.col("upto") >= lo))
        .groupBy(*keys)
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"), F.first("total").alias("total"))
    )


def dominant(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the value seen first along `order`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value).alias("value"), "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_top"),
        F.sum("n").alias("total"),
    ).select(*keys, F.col("_top.value").alias("value"), F.col("_top.n").alias("n"), "total")
