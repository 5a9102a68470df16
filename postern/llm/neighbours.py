"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Index, over every row. Equal vectors are one class. A class's vector, less the centre of all rows, is rotated by a seeded
random matrix (padded to `BITS` dimensions at least) and kept as the signs of its components, packed, with three
correction scalars: the residual's length over its agreement with its own code, the length of its error, and its inner
product with the centre.

Search. Queries in blocks against the whole index in blocks; a block of either is bounded by rows and bytes, so a task
never holds more than one of each, and a common vector is one class there. In a pair of blocks the codes give an
estimate and an error bound (`EPSILON` standard deviations) for each inner product. The classes of the largest estimates
are computed exactly; every other class whose upper bound reaches the least of those is computed, too. A block pair
hands on the exact best of each query, and the best of those are the result. Exact inner products are sums in the order
of the components, in double precision.

Nothing is fitted but the centre, a mean over all rows. Recall is 1 but for bounds that fail, and is measured in
tests/llm against brute force. The work is the number of queries times the number of rows, on codes.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows without a vec_id, take
no part; vectors of different lengths are never compared; ties go to the smaller vec_id; repeated rows are rows of their
own, so a query leaves out one row of its own id and vector; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from postern.session import stage

NEAREST, EVERY = 20, 20
BITS, EPSILON, SEED = 256, 2.5, 20_250
#: Rows and bytes of vectors that one block holds at most, and the rows below which a table is not cut further.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 16_384, 64 << 20, 2_048
#: Queries estimated at a time.
_STRIP = 128

_INDEX = StructType(
    [
        StructField("row", LongType()), StructField("dim", IntegerType()), StructField("vector", ArrayType(DoubleType())), StructField("ids", ArrayType(LongType())),
        StructField("code", BinaryType()), StructField("scale", DoubleType()), StructField("error", DoubleType()), StructField("offset", DoubleType()),
    ]
)


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int = BITS) -> np.ndarray:
    """Orthonormal columns: dim -> max(bits, dim rounded up to whole words of 64)."""
    wide = max(bits, -(-dim // 64) * 64)
    return np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((wide, dim)))[0]


def valid_rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector and its hashes, of the rows that take part."""
    v = F.col("vector")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("vec_id"), vectors[vector].alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0))
    return rows.select("vec_id", "vector", F.xxhash64("vector").alias("one"), F.xxhash64(F.lit(1), "vector").alias("two"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors, each with its `keep` smallest vec_ids; the window limits rows before the shuffle."""
    along = Window.partitionBy("one", "two").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(along)).where(F.col("k") <= keep)
    found = few.groupBy("one", "two").agg(F.any_value("vector").cast("array<double>").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.monotonically_increasing_id().alias("row"), "one", "two", F.size("vector").alias("dim"), "vector", "ids")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def centres(found: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector by length: partial sums of each task, one row a length and task."""

    arrow = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64())])

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = _matrix(batch.filter(pa.array(dims == dim)).column(1), dim)
                n, s = sums.get(dim, (0, 0.0))
                sums[dim] = n + len(part), s + part.sum(0)
        for dim, (n, s) in sums.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "i": i, "n": n, "s": x} for i, x in enumerate(s.tolist())], schema=arrow)

    parts = found.select("dim", "vector").mapInArrow(run, "dim int, i int, n bigint, s double")
    means = parts.groupBy("dim", "i").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).collect()
    # Rounded, so that the order of summation leaves no trace.
    return {r["dim"]: np.nan_to_num(np.array([float(f"{x['m']:.4g}") for x in r["c"]]), posinf=0.0, neginf=0.0) for r in means}


def index(found: DataFrame, means: dict[int, np.ndarray], bits: int = BITS) -> DataFrame:
    """Codes and correction scalars of every class."""
    shared = found.sparkSession.sparkContext.broadcast(means)
    arrow = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("code", pa.binary()), ("scale", pa.float64()), ("error", pa.float64()), ("offset", pa.float64())])

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                centre, turn = shared.value[dim], rotation(dim, bits)
                rest = _matrix(own.column(2), dim) - centre
                length = np.linalg.norm(rest, axis=1)
                turned = rest @ turn.T
                code = np.packbits(turned > 0, axis=1)
                with np.errstate(all="ignore"):
                    wide = turned.shape[1]
                    agree = np.abs(turned).sum(1) / np.sqrt(wide) / length
                    scale = np.where(length > 0, length / agree / np.sqrt(wide), 0.0)
                    error = np.where(length > 0, length * np.sqrt(np.maximum(0, 1 / agree**2 - 1) / max(1, wide - 1)), 0.0)
                columns = [*(own.column(j) for j in range(4)), pa.array([c.tobytes() for c in code], pa.binary()), scale, error, rest @ centre]
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return found.select("row", "dim", "vector", "ids").mapInArrow(run, _INDEX)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * vectors[:, j]
    return total


def best_of_block(queries: np.ndarray, block: dict[str, np.ndarray], centre: np.ndarray, turn: np.ndarray, keep: int, epsilon: float = EPSILON) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and exact scores of its `keep` best rows of a block; `first` decides ties."""
    vectors, first = block["vector"], block["first"]
    signs = np.unpackbits(block["code"], axis=1, count=turn.shape[0]).astype(np.float32) * 2 - 1
    out = []
    for lo in range(0, len(queries), _STRIP):
        q = queries[lo : lo + _STRIP]
        apart = q - centre
        with np.errstate(all="ignore"):
            guess = (apart @ turn.T).astype(np.float32) @ signs.T * block["scale"] + block["offset"] + (q @ centre)[:, None]
            slack = np.linalg.norm(apart, axis=1)[:, None] * (epsilon * block["error"] + 1e-6 * (np.abs(block["scale"]) * np.sqrt(turn.shape[0])))
            most = np.where(np.isfinite(guess + slack), guess + slack, np.inf)
        n = guess.shape[1]
        for i in range(len(q)):
            if n > keep:
                ahead = np.argpartition(most[i], n - keep)[n - keep :]
                least = exact(np.broadcast_to(q[i], (keep, q.shape[1])), vectors[ahead]).min()
                reach = ~(most[i] < least)
                reach[ahead] = True
                at = np.flatnonzero(reach)
            else:
                at = np.arange(n)
            score = exact(np.broadcast_to(q[i], (len(at), q.shape[1])), vectors[at])
            order = np.lexsort((first[at], -score))[:keep]
            out.append((at[order], score[order]))
    return out


def _blocks(n: int, nbytes: int, cores: int) -> int:
    least = max(-(-n // BLOCK_ROWS), -(-nbytes // BLOCK_BYTES), 1)
    return max(least, min(cores, -(-n // LEAST_ROWS)))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = EVERY, bits: int = BITS, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    keep = k + 1
    rows = valid_rows(vectors, vec_id, vector)
    found = stage(classes(rows, keep))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "one", "two")
    asked = stage(asked.join(found.select("row", "one", "two"), ["one", "two"]).select(F.col("vec_id").alias("query_id"), "row"))
    means = centres(found)
    coded = stage(index(found, means, bits))
    probes = stage(found.join(asked.select("row").distinct(), "row", "left_semi").select(F.col("row").alias("probe"), "dim", "vector"))

    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.col("dim").cast("bigint")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    across, down = _blocks(*size(coded), 2 * cores), _blocks(*size(probes), 1)
    shared = spark.sparkContext.broadcast(means)
    key = ["dim", "across", "down"]
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select("*", F.pmod(F.xxhash64("row"), F.lit(across)).cast("int").alias("across"), every_block(down).alias("down"))
    right = probes.select("*", every_block(across).alias("across"), F.pmod(F.xxhash64("probe"), F.lit(down)).cast("int").alias("down"))
    tasks = across * down
    arrow = pa.schema([("probe", pa.int64()), ("row", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def search(block: pa.Table, own: pa.Table) -> pa.Table:
        if not len(block) or not len(own):
            return arrow.empty_table()
        dim = block.column("dim")[0].as_py()
        number = lambda c: block.column(c).to_numpy()
        code = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(block), -1)
        ids = block.column("ids").combine_chunks()
        first = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        parts = {"vector": _matrix(block.column("vector"), dim), "code": code, "first": first, **{c: number(c) for c in ("scale", "error", "offset")}}
        best = best_of_block(_matrix(own.column("vector"), dim), parts, shared.value[dim], rotation(dim, bits), keep, epsilon)
        at = np.concatenate([b[0] for b in best])
        probe = np.repeat(own.column("probe").to_numpy(), [len(b[0]) for b in best])
        return pa.Table.from_arrays([pa.array(probe), pa.array(number("row")[at]), pa.array(np.concatenate([b[1] for b in best])), ids.take(pa.array(at))], schema=arrow)

    dealt = lambda df: df.repartition(tasks, *key).groupBy(*key)
    met = dealt(left).cogroup(dealt(right)).applyInArrow(search, "probe bigint, row bigint, score double, ids array<bigint>")
    along = Window.partitionBy("probe").orderBy(F.desc("score"), F.col("ids")[0])
    best = met.withColumn("at", F.row_number().over(along)).where(F.col("at") <= keep)
    # A class's rows, in the order of their ids; k + 1 rows hold the k others of any of its queries.
    spread = best.select("probe", "score", F.explode("ids").alias("vec_id"), (F.col("row") == F.col("probe")).alias("own"))
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    top = spread.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep)
    lists = stage(top.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("at", "score", "vec_id", "own"))).alias("found")))
    return _without_itself(asked, lists, k)


def _without_itself(asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Each query's list less one row of its own vector and id."""
    mine = lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))
    row = asked.join(lists, asked["row"] == lists["probe"])
    itself: Column = F.array_min(F.transform(F.filter("found", mine), lambda x: x["at"]))
    others = F.slice(F.filter("found", lambda x: ~x["at"].eqNullSafe(itself)), 1, k)
    listed = row.select("query_id", F.posexplode(others).alias("rank", "x"))
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
