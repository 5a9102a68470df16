"""Grading of an analysis against scenario truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.functions.scores import count_if


def grade_counts(truth: DataFrame, got: DataFrame, scenario: Sequence[str], value: str) -> DataFrame:
    """Multiset difference per scenario and value: how many are missing, how many are extra."""
    keys = [*scenario, value]
    t = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    g = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    out = t.join(g, keys, "full_outer").na.fill(0, ["expected", "actual"])
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("actual"))).withColumn(
        "extra", F.greatest(F.lit(0), F.col("actual") - F.col("expected"))
    )


def grade_findings(expected: DataFrame, found: DataFrame, scenario: Sequence[str]) -> DataFrame:
    """Categories found less often than expected, and expected evidence frames no finding cites.

    `expected` = (scenario, category, session_id, frames); `found` carries `frames` as well.
    """
    keys = [*scenario, "category"]
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    a = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    pairs = expected.withColumnRenamed("frames", "want").join(found.select(*keys, "session_id", "frames"), [*keys, "session_id"])
    off = pairs.groupBy(*keys).agg(count_if((F.size("want") > 0) & ~F.arrays_overlap("want", "frames")).alias("wrong_frames"))
    out = e.join(a, keys, "left").join(off, keys, "left").na.fill(0, ["actual", "wrong_frames"])
    return out.withColumn("missed", F.col("actual") < F.col("expected"))


def grade_controls(labels: DataFrame, found: DataFrame, scenario: Sequence[str]) -> DataFrame:
    """Clean scenarios must carry nothing above INFO; incomplete ones must carry an UNKNOWN verdict."""
    agg = found.groupBy(*scenario).agg(count_if(F.col("severity") != "INFO").alias("noisy"), count_if(F.col("verdict") == "UNKNOWN").alias("unknown"))
    rows = labels.join(agg, list(scenario), "left").na.fill(0, ["noisy", "unknown"])
    clean = F.col("label").isin("secure", "secure_implicit") & (F.col("noisy") > 0)
    blind = (F.col("label") == "incomplete_evidence") & (F.col("unknown") == 0)
    problem = F.when(clean, F.lit("false_positive")).when(blind, F.lit("no_unknown_verdict"))
    return rows.withColumn("problem", problem)
