"""Client-stack clusters: density clustering of hello features, novelty and a two-dimensional projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import cut_lineage, stage

# Fixed values of the method
EPS = 1.2
MIN_POINTS = 2
#: Boxes of a coarse cell that one task compares at a time with as many of the cell and its neighbours
BLOCK = 4096


def standardise(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Zero mean and unit population deviation in each population (rows of equal `within`); constant columns become zero."""
    stats = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    if within:
        rows = df.join(df.groupBy(*within).agg(*stats), list(within))
        return rows.select(*[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) if c in columns else F.col(c) for c in df.columns])
    row = df.agg(*stats).first()
    cols = {}
    for c in columns:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        cols[c] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
    return df.withColumns(cols)


def _sum_of_squares(gaps: Column) -> Column:
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _outside(lo: Column | str, hi: Column | str, other_lo: Column | str, other_hi: Column | str) -> Column:
    """Squared distance of two boxes, given as arrays of their bounds; a point is a box of its own."""
    over, under = F.zip_with(lo, other_hi, lambda a, b: a - b), F.zip_with(other_lo, hi, lambda a, b: a - b)
    return _sum_of_squares(F.zip_with(over, under, lambda a, b: F.greatest(F.lit(0.0), a, b)))


def _cells(points: DataFrame, columns: Sequence[str], eps: float, grid: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Points with their fine cell (`cell`) and its coarse one (`_g0`, `_g1`, ...).

    A fine cell has the side eps / sqrt(d) over all d columns, so its points are all within `eps` of each other: a clique
    that needs no pairs. A coarse cell is ceil(sqrt(d)) fine ones wide, `eps` at least, over the `grid` columns.
    """
    side, wide = eps / math.sqrt(len(columns)), math.ceil(math.sqrt(len(columns)))
    fine = lambda x: F.floor(x / F.lit(side))
    coarse = {f"_g{i}": F.floor(fine(F.col(g)) / F.lit(wide)) for i, g in enumerate(grid)}
    at = F.transform(F.array(*[F.col(c) for c in columns]), lambda x: fine(x).cast("string"))
    return points.withColumn("cell", F.concat_ws(",", *[F.col(w).cast("string") for w in within], F.array_join(at, ","))).withColumns(coarse)


def _near_boxes(eps: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of a block's own boxes and the boxes that visit it, at most `eps` apart, and whether their farthest corners are too.

    Only centres are multiplied as matrices; with a margin for rounding they rule out most pairs, and the bounds of the
    others decide, summed column by column as Spark does.
    """
    limit = eps * eps

    def run(table: pa.Table) -> pa.Table:
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        lo, hi = flat("_lo"), flat("_hi")
        ids, visits, same = (table.column(c).to_numpy() for c in ("_id", "_visits", "_same"))
        usable = np.isfinite(lo).all(1) & np.isfinite(hi).all(1)
        own, other = np.flatnonzero(usable & ~visits), np.flatnonzero(usable & visits)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own) and len(other):
            mid = (lo + hi) / 2
            mid -= mid[own].mean(0)
            square, reach = (mid * mid).sum(1), np.sqrt(((hi - lo) ** 2).sum(1)) / 2
            for start in range(0, len(own), 256):
                mine = own[start : start + 256]
                both = square[mine][:, None] + square[other]
                apart = both - 2 * (mid[mine] @ mid[other].T)
                near = apart <= (eps + reach[mine][:, None] + reach[other]) ** 2 * (1 + 1e-9) + 1e-9 * both
                near &= ~same[other] | (ids[mine][:, None] < ids[other])
                i, j = np.nonzero(near)
                i, j = mine[i], other[j]
                gap, far = np.zeros(len(i)), np.zeros(len(i))
                for k in range(lo.shape[1]):
                    up, down = lo[i, k] - hi[j, k], lo[j, k] - hi[i, k]
                    gap += np.maximum(0.0, np.maximum(up, down)) ** 2
                    far += np.maximum(np.abs(up), np.abs(down)) ** 2
                kept = gap <= limit
                found.append((ids[i[kept]], ids[j[kept]], far[kept] <= limit))
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, bool))]
        return pa.table(columns, names=["_a", "_b", "sure"])

    return run


def _met(boxes: DataFrame, eps: float, grids: Sequence[str], within: Sequence[str]) -> DataFrame:
    """(cell, other, sure): boxes of the same or an adjacent coarse cell that are at most `eps` apart, each pair once.

    A coarse cell is dealt into blocks of its own boxes, and what visits it (half of its neighbours, and itself) into parts.
    A task compares one block with one part at a time, so it holds a bounded number of boxes however full a cell is.
    """
    at = [*within, *grids]
    steps = [s for s in product((-1, 0, 1), repeat=len(grids)) if s >= (0,) * len(grids)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(g) for g, x in zip(grids, s, strict=True)]) for s in steps])).alias("_s")

    def visiting(rows: DataFrame) -> DataFrame:
        """Rows in each cell that they visit; `_same` if it is their own."""
        own = [c for c in rows.columns if c not in grids]
        stay = F.lit(True)
        for g in grids:
            stay = stay & (F.col(f"_s.{g}") == 0)
        return rows.select("*", step).select(*own, *[(F.col(g) - F.col(f"_s.{g}")).alias(g) for g in grids], stay.alias("_same"))

    boxes = stage(boxes.withColumn("_id", F.monotonically_increasing_id()))
    counts = stage(boxes.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")))
    guests = visiting(counts).groupBy(*at).agg(F.sum("_n").alias("_guests"))
    many = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    dealt = stage(counts.join(guests, at).select(*at, many("_n").alias("_blocks"), many("_guests").alias("_parts")))
    place = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bounds = ["_id", "_lo", "_hi"]
    own = boxes.join(dealt, at).select(*at, place("_blocks").alias("_block"), each("_parts").alias("_part"), *bounds, F.lit(False).alias("_visits"), F.lit(True).alias("_same"))
    guest = visiting(boxes).join(dealt, at).select(*at, each("_blocks").alias("_block"), place("_parts").alias("_part"), *bounds, F.lit(True).alias("_visits"), "_same")
    pairs = own.unionByName(guest).groupBy(*at, "_block", "_part").applyInArrow(_near_boxes(eps), "_a bigint, _b bigint, sure boolean")
    named = lambda i, name: boxes.select(F.col("_id").alias(i), F.col("cell").alias(name))
    return pairs.join(named("_a", "cell"), "_a").join(named("_b", "other"), "_b").select("cell", "other", "sure")


def _linked_cells(points: DataFrame, columns: Sequence[str], eps: float, grid: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(cell, label): fine cells that a chain of steps of at most `eps` connects, by the smallest of their names.

    Cells of the same or an adjacent coarse cell meet as boxes. Boxes whose farthest corners lie within `eps` are linked,
    boxes farther apart than `eps` are not. The rest matters only where it would join two groups of cells; there the
    points of both that lie near the other's box are compared.
    """
    # Bounds and points are arrays: expressions over many columns by name are what the optimizer is slow at.
    vector = F.array(*[F.col(c) for c in columns])
    placed = stage(_cells(points, columns, eps, grid, within).withColumn("_v", vector))
    grids = [f"_g{i}" for i in range(len(grid))]
    bounds = [F.array(*[f(c) for c in columns]).alias(n) for n, f in (("_lo", F.min), ("_hi", F.max))]
    boxes = stage(placed.groupBy(*within, *grids, "cell").agg(*bounds))
    limit = F.lit(eps * eps)
    met = stage(_met(boxes, eps, grids, within))
    nodes = boxes.select(F.col("cell").alias("pid"))
    first = components(nodes, met.where("sure").select(F.col("cell").alias("pid"), "other"))
    named = lambda side, label: first.select(F.col("pid").alias(side), F.col("label").alias(label))
    unsure = stage(met.where("NOT sure").join(named("cell", "_ga"), "cell").join(named("other", "_gb"), "other").where("_ga <> _gb").select("cell", "other", "_ga", "_gb"))

    def side_points(pairs: DataFrame, own: str, of: str, name: str) -> DataFrame:
        """Points of one side's cells that lie within `eps` of the other side's box."""
        box = boxes.select(F.col("cell").alias(of), "_lo", "_hi")
        rows = pairs.join(placed.select(F.col("cell").alias(own), "_v"), own).join(box, of)
        return rows.where(_outside("_lo", "_hi", "_v", "_v") <= limit).select("cell", "other", "_ga", "_gb", F.col("_v").alias(name))

    both = side_points(unsure, "cell", "other", "_x").join(side_points(unsure, "other", "cell", "_y"), ["cell", "other", "_ga", "_gb"])
    compared = both.where(_sum_of_squares(F.zip_with("_x", "_y", lambda a, b: a - b)) <= limit)
    links = compared.select(F.col("_ga").alias("pid"), F.col("_gb").alias("other")).distinct()
    final = components(first.select(F.col("label").alias("pid")).distinct(), links)
    return first.select(F.col("pid").alias("cell"), F.col("label").alias("pid")).join(final, "pid").select("cell", "label")


def components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by spreading the smallest label along edges, with label shortcuts.

    Every round is checkpointed. Distinct stacks are few and shortcuts halve the remaining distance, so
    rounds grow with the logarithm of the longest chain. It ends when no label moves.
    """
    both = cut_lineage(edges.select("pid", "other").unionByName(edges.select(F.col("other").alias("pid"), F.col("pid").alias("other"))))
    labels = cut_lineage(points.select("pid", F.col("pid").alias("label")))
    while True:
        near = both.join(labels.select(F.col("pid").alias("other"), F.col("label").alias("near")), "other").groupBy("pid").agg(F.min("near").alias("near"))
        spread = labels.join(near, "pid", "left").select("pid", "label", F.least("label", "near").alias("better"))
        up = spread.select(F.col("pid").alias("better"), F.col("better").alias("jump"))
        new = cut_lineage(spread.join(up, "better", "left").select("pid", "label", F.least("better", "jump").alias("next")))
        moved = new.where(F.col("next") < F.col("label")).isEmpty()
        labels = new.select("pid", F.col("next").alias("label"))
        if moved:
            return labels


def cluster_clients(df: DataFrame, keys: Sequence[str], columns: Sequence[str], eps: float = EPS, grid: Sequence[str] | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Cluster of each row, its size and share of its population, and whether the stack is novel.

    With two points making a cluster, density clusters are exactly the connected components of the
    eps-graph. Identical vectors are merged first, and stacks of one fine cell are one group without comparing them, so
    the graph is over the cells of distinct stacks; a stack is named by its population and its values.
    """
    z = stage(standardise(df.select(*dict.fromkeys([*within, *keys, *columns])), columns, within))
    name = F.to_json(F.array(*[F.col(c).cast("string") for c in [*within, *columns]]))
    stacks = stage(z.groupBy(*within, *columns).agg(F.count(F.lit(1)).alias("n")).withColumn("pid", name))
    axes = list(grid or columns[:3])
    cells = _linked_cells(stacks, columns, eps, axes, within)
    grouped = _cells(stacks.select("pid", *within, "n", *columns), columns, eps, axes, within).join(cells.withColumnRenamed("label", "_group"), "cell")
    # A group is named by its smallest stack.
    first = grouped.groupBy("_group").agg(F.min("pid").alias("label"))
    sized = grouped.join(first, "_group").select("pid", *within, "n", "label")
    size = sized.groupBy("label").agg(F.sum("n").alias("size"))
    if within:
        sized = sized.join(z.groupBy(*within).agg(F.count(F.lit(1)).alias("total")), list(within))
    else:
        sized = sized.withColumn("total", F.lit(z.count()))
    noise = F.col("size") < MIN_POINTS
    share = F.col("size") / F.col("total").cast("double")
    named = sized.join(size, "label").select(
        "pid", F.sha2("label", 256).alias("cluster"), "size", share.alias("share"), noise.alias("is_noise"), (noise | ((share < 0.1) & (F.col("total") >= 10))).alias("novel")
    )
    return z.withColumn("pid", name).select(*keys, "pid").join(named, "pid").drop("pid")


def _loadings(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for flat in batch.column("cov").to_pylist():
                full = np.zeros((n, n))
                full[np.tril_indices(n)] = flat
                _, vectors = np.linalg.eigh(full)  # reads the lower triangle
                for out, v in ((first, vectors[:, -1]), (second, vectors[:, -2])):
                    out.append((v * (1.0 if v[np.abs(v).argmax()] >= 0 else -1.0)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first, pa.list_(pa.float64())), pa.array(second, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "_axis1", "_axis2"])

    return run


def project_2d(df: DataFrame, keys: Sequence[str], columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """First two principal components of each population, each with the sign that makes its largest loading positive.

    A population is reduced to the covariances of its columns; only those small rows are decomposed.
    """
    z = stage(standardise(df.select(*dict.fromkeys([*within, *keys, *columns])), columns, within))
    # means are zero, so the covariance of two columns is the mean of their product
    cov = F.array(*[F.avg(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[: i + 1]])
    rows = z.groupBy(*within).agg(cov.alias("cov"))
    schema = ", ".join([f"{c} {dict(z.dtypes)[c]}" for c in within] + ["_axis1 array<double>", "_axis2 array<double>"])
    axes = rows.mapInArrow(_loadings(len(columns)), schema)
    dot = lambda side: F.aggregate(F.zip_with(F.array(*columns), side, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    if within:
        joined = z.join(axes, list(within))
    else:
        one = axes.first()
        joined = z.withColumns({k: F.array(*[F.lit(x) for x in one[k]]) for k in ("_axis1", "_axis2")})
    return joined.select(*keys, dot("_axis1").alias("x"), dot("_axis2").alias("y"))
