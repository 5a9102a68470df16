"""Column helpers for counts, shares and half-even rounding; NULL means not assessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share(n: Column, d: Column) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def pct(n: Column, d: Column, digits: int = 1) -> Column:
    return F.when(d > 0, F.bround(F.lit(100.0) * n.cast("double") / d.cast("double"), digits))


def pct_score(n: Column, d: Column) -> Column:
    return pct(n, d, 0).cast("int")


def server_key() -> Column:
    return F.concat_ws(":", F.col("server_ip"), F.col("server_port").cast("string"))


def text(array: Column | str) -> Column:
    """Array as comma separated text, NULL staying NULL."""
    col = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")
