"""Outlier search per capture: isolation forest scores and robust attribution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern.operators.ordered import exact_median, running, scale_block, value_counts
from postern.session import stage

# Fixed values of the method
TREES = 200
SUBSAMPLE = 256
CONTAMINATION = 0.08
MIN_ROWS = 20
TOP_FEATURES = 4


def mad_attribution(df: DataFrame, group: Sequence[str], row_key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Features furthest from their population median, in units of the median absolute deviation.

    Medians are exact and come from value counts, so a population of any size is only ever summed.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*group, *row_key, F.explode(pairs).alias("p")).select(*group, *row_key, "p.feature", "p.value")
    keys = [*group, "feature"]
    med = exact_median(long, keys, F.col("value")).select(*keys, F.col("median").alias("population_median"))
    counts = value_counts(long, keys, F.col("value")).join(med, keys)
    away = counts.select(*keys, F.abs(F.col("value") - F.col("population_median")).alias("d"), "n").groupBy(*keys, "d").agg(F.sum("n").alias("n"))
    upto = running(away, keys, ["d"], scale_block(F.col("d")), {"upto": ("sum", F.col("n"))}, inclusive=True)
    total = away.groupBy(*keys).agg(F.sum("n").alias("total"))
    first = F.col("upto") - F.col("n") + 1
    mad = (
        upto.join(total, keys)
        .where((first <= F.floor((F.col("total") + 2) / 2)) & (F.col("upto") >= F.floor((F.col("total") + 1) / 2)))
        .groupBy(*keys)
        .agg(((F.min("d") + F.max("d")) / 2).alias("mad"))
    )
    unit = F.when(F.col("mad") < 1e-9, F.lit(1.0)).otherwise(F.col("mad"))
    stats = med.join(mad, keys).select(*keys, "population_median", unit.alias("unit"))
    scored = long.join(stats, keys).withColumn("deviation_mad", F.abs(F.col("value") - F.col("population_median")) / F.col("unit"))
    # rows have at most as many entries as there are features
    w = Window.partitionBy(*group, *row_key).orderBy(F.desc("deviation_mad"), F.asc("feature"))
    return scored.where(F.col("deviation_mad") > 1.0).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TOP_FEATURES).drop("unit")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as rows (node, feature, threshold, size); feature -1 marks a leaf."""
    nodes: list[tuple] = []
    queue = [(0, np.arange(len(x)), 0)]
    while queue:
        node, rows, depth = queue.pop()
        spread = np.flatnonzero(x[rows].max(axis=0) > x[rows].min(axis=0)) if len(rows) > 1 and depth < limit else []
        if not len(spread):
            nodes.append((node, -1, 0.0, len(rows), depth))
            continue
        f = int(rng.choice(spread))
        lo, hi = x[rows, f].min(), x[rows, f].max()
        t = float(rng.uniform(lo, hi))
        nodes.append((node, f, t, len(rows), depth))
        left = x[rows, f] <= t
        queue.append((2 * node + 1, rows[left], depth + 1))
        queue.append((2 * node + 2, rows[~left], depth + 1))
    return nodes


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
    return out


def forest(df: DataFrame, group: str, columns: Sequence[str], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """Isolation trees per group: (group, tree, node, feature, threshold, size, depth).

    Each tree needs only a fixed-size random subsample: a hash-thinned pool of bounded size is offered to
    the trees, each takes its `subsample` smallest hashes, and trees grow as independent small groups.
    """
    cols = list(columns)
    mod = 1 << 53

    def uniform(*parts) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(mod)) / F.lit(float(mod))

    drawn = df.select(group, *cols, F.xxhash64(F.struct(*[F.col(c) for c in df.columns])).alias("_id"))
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    # Pool: one hash per row keeps about four times what all trees need; small groups stay whole.
    need = trees * subsample
    pool = drawn.join(total, group).where(uniform(F.lit(seed), "_id") < F.lit(4.0 * need) / F.col("_n"))
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_u", uniform(F.lit(seed + 1), "tree", "_id"))
    each = each.where(F.col("_u") < F.lit(4.0 * subsample) / F.least(F.col("_n"), F.lit(4.0 * need)))
    w = Window.partitionBy(group, "tree").orderBy("_u", "_id")
    sample = each.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= subsample)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "_id"])
        x = pdf[cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, int(key[1])])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        rows = pd.DataFrame(_grow(x, rng, limit), columns=["node", "feature", "threshold", "size", "depth"])
        rows.insert(0, "tree", int(key[1]))
        rows.insert(0, group, key[0])
        rows["sample"] = len(x)
        return rows

    schema = f"{group} bigint, tree int, node bigint, feature int, threshold double, size int, depth int, sample int"
    return sample.select(group, "tree", "_u", "_id", *cols).groupBy(group, "tree").applyInPandas(grow, schema)


def scores(df: DataFrame, model: DataFrame, group: str, keys: Sequence[str], columns: Sequence[str], rows_per_task: int = 100_000) -> DataFrame:
    """Isolation score of every row (higher is more isolated).

    A group's rows are salted into tasks of a bounded size and its forest (of a size fixed by the method)
    is sent once to each of them, so neither a large group nor many groups pile up anywhere.
    """
    cols = list(columns)
    out_cols = list(dict.fromkeys([*keys, group]))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in out_cols) + ", anomaly_raw double"
    salts = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).cast("int").alias("_salts"))
    rows = df.join(salts, group).withColumn("_salt", F.pmod(F.xxhash64(*out_cols), F.col("_salts")).cast("int")).drop("_salts")
    copies = salts.select(group, F.col("_salts").alias("_copies"))
    sent = model.join(copies, group).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")

    def grade(sub: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        res = sub[out_cols].copy()
        x = sub[cols].to_numpy(dtype=float)
        total = np.zeros(len(x))
        sizes = _expected_path(nodes["size"].to_numpy())
        trees: dict[int, dict[int, tuple]] = {}
        for t, n, f, th, d, e in zip(nodes["tree"], nodes["node"], nodes["feature"], nodes["threshold"], nodes["depth"], sizes):
            trees.setdefault(t, {})[n] = (f, th, d + e)
        for tree in trees.values():
            stack = [(0, np.arange(len(x)))]
            while stack:
                node, idx = stack.pop()
                if not len(idx):
                    continue
                f, th, length = tree[node]
                if f < 0:
                    total[idx] += length
                    continue
                left = x[idx, f] <= th
                stack.append((2 * node + 1, idx[left]))
                stack.append((2 * node + 2, idx[~left]))
        unit = float(_expected_path(np.array([nodes["sample"].max()]))[0]) or 1.0
        res["anomaly_raw"] = np.power(2.0, -(total / max(len(trees), 1)) / unit)
        return res

    return rows.groupBy(group, "_salt").cogroup(sent.groupBy(group, "_salt")).applyInPandas(grade, schema)


def isolation_forest(df: DataFrame, group: str, keys: Sequence[str], columns: Sequence[str], trees: int = TREES, contamination: float = CONTAMINATION) -> DataFrame:
    """Score in 0..1 within each group and the outlier flag; groups under the floor are not scored."""
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_ROWS).select(group)
    base = df.join(large, group, "left_semi")
    raw = scores(base, forest(base, group, columns, trees), group, keys, columns)
    raw = stage(raw)
    # threshold: linear percentile of the scores, from counts per distinct score (equal rows stay one row)
    counts = stage(raw.groupBy(group, "anomaly_raw").agg(F.count(F.lit(1)).alias("n")))
    upto = running(counts, [group], ["anomaly_raw"], F.floor(F.col("anomaly_raw") * 1000), {"upto": ("sum", F.col("n"))}, inclusive=True)
    totals = counts.groupBy(group).agg(F.sum("n").alias("_n"), F.min("anomaly_raw").alias("_lo"), F.max("anomaly_raw").alias("_hi"))
    at = F.lit(1.0 - contamination) * (F.col("_n") - 1)
    first = F.col("upto") - F.col("n") + 1
    marks = upto.join(totals, group).where((first <= F.ceil(at) + 1) & (F.col("upto") >= F.floor(at) + 1))
    cut = marks.groupBy(group, "_n", "_lo", "_hi").agg(F.min("anomaly_raw").alias("_a"), F.max("anomaly_raw").alias("_b"))
    threshold = F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    out = raw.join(cut, group)
    return out.select(*raw.columns, ((F.col("anomaly_raw") - F.col("_lo")) / span).alias("anomaly_score"), (F.col("anomaly_raw") > threshold).alias("is_outlier"))
