"""Prefix scan of a small state machine over ordered rows, by composing its steps.

A step is a map from state to state. Maps compose associatively, so the rows of a block are scanned on their own: sorted
rows stream through a task, which gives each the map of the rows before it in its block, and the last one the map of the whole block.
Only flows of several blocks need more: their blocks, one map each, are scanned in the same way, and joined to their rows.
A task holds one batch of rows, however long a flow or a block is, and rows are shuffled once.

A map of up to 15 states is one bigint of four bits a state, so composing and applying it are shifts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postern.session import stage

BITS = 4


def packed(after: Sequence[int]) -> int:
    """The map that takes state i to after[i]."""
    return sum(s << (BITS * i) for i, s in enumerate(after))


def apply(step: Column, state: Column) -> Column:
    moved = F.call_function("shiftrightunsigned", step, (state * BITS).cast("int"))
    return moved.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def compose(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The maps of both steps, one after the other, over n states."""
    out, mask = np.zeros_like(first), (1 << BITS) - 1
    for s in range(n):
        middle = (first >> (BITS * s)) & mask
        out |= ((second >> (BITS * middle)) & mask) << (BITS * s)
    return out


def _scanned(maps: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """The map of each row and those before it in its run; `begins` is the place of its run's first row."""
    out, reach, at = maps.copy(), 1, np.arange(len(maps))
    while len(far := np.flatnonzero(at - begins >= reach)):
        out[far] = compose(out[far - reach], out[far], n)
        reach *= 2
    return out


def _prefixes(keys: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by their first `keys` columns, the last column a map: `_pre` and, on a run's last row, `_all` take its place."""
    identity = packed(range(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray] | None = None

        def finished(last_ends: bool) -> pa.RecordBatch:
            batch, before, upto, ends = held
            ends[-1] = last_ends
            arrays = [*batch.columns[:-1], pa.array(before), pa.array(upto, mask=~ends)]
            return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "_pre", "_all"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for c in batch.columns[:keys]:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            maps = batch.columns[-1].to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            upto = _scanned(maps, begins, n)
            carried = np.full(1, identity, np.int64)
            if held is not None:
                whole = held[0]
                same = all(whole.column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(keys))
                yield finished(not same)
                if same:
                    carried = held[2][-1:]
                    first = begins == 0
                    upto[first] = compose(np.broadcast_to(carried, int(first.sum())).copy(), upto[first], n)
            before = np.where(new, identity, np.concatenate([carried, upto[:-1]]))
            before[0] = carried[0]
            held = batch, before, upto, np.append(new[1:], False)
        if held is not None:
            yield finished(True)

    return run


def _scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """`_pre`, the map of the rows before each within `keys`, and on the last of them `_all`, the map of all, in place of `_f`."""
    rest = [c for c in rows.columns if c not in (*keys, *order, "_f")]
    dealt = rows.select(*keys, *order, *rest, "_f").repartition(*keys).sortWithinPartitions(*keys, *order, "_f", *rest)
    out = StructType([StructField(f.name, f.dataType) for f in dealt.schema.fields[:-1]] + [StructField("_pre", LongType()), StructField("_all", LongType())])
    return dealt.mapInArrow(_prefixes(len(keys), n), out)


def states_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, step: Column, start: DataFrame | int, n: int) -> DataFrame:
    """`rows` with `state`, the state before each: of the flows in `start` (keys, start), or of all from one state.

    `block` must not decrease along `order`; a block is scanned by one task. `step` is a packed map. Rows without a key
    belong to no flow.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    rows = rows.withColumn("_f", step.cast("bigint")).withColumn("_b", block.cast("bigint")).dropna(subset=[*keys, "_b"])
    # read several times: maps of the blocks, then the rows
    scanned = stage(_scan(rows, [*keys, "_b"], order, n))
    blocks = scanned.where(F.col("_all").isNotNull()).select(*keys, "_b", F.col("_all").alias("_f"))
    long = blocks.groupBy(*keys).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")).where(F.col("_lo") < F.col("_hi")).select(*keys)
    entries = _scan(blocks.join(long, keys, "left_semi"), keys, ["_b"], n).select(*keys, "_b", F.col("_pre").alias("_entry"))
    found = scanned.join(entries, [*keys, "_b"], "left")
    found = found.withColumn("start", F.lit(start)) if isinstance(start, int) else found.join(start.select(*keys, "start"), keys)
    entry = F.coalesce("_entry", F.lit(packed(range(n))).cast("bigint"))
    return found.select(*keys, *order, *rest, apply(F.col("_pre"), apply(entry, F.col("start"))).alias("state"))
