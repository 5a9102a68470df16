"""Maps scanned over sorted batches are those of a plain walk, wherever a batch or a run ends."""

from __future__ import annotations

import random

import pyarrow as pa

from postern.operators.scan import BITS, _prefixes, packed


def test_prefixes_are_those_of_a_walk_over_any_batches():
    r, n = random.Random(3), 7
    rows = [(flow, packed([r.randrange(n) for _ in range(n)])) for flow in range(12) for _ in range(r.choice([1, 2, 5, 40]))]
    after = lambda step, s: step >> (BITS * s) & 15
    want, ends = [], {}
    for flow, step in rows:
        want.append(ends.get(flow, list(range(n))))
        ends[flow] = [after(step, s) for s in want[-1]]
    for size in (1, 3, 16, len(rows)):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in p]), pa.array([x[1] for x in p])], names=["flow", "_f"]) for p in parts]
        got = [row for b in _prefixes(1, n)(iter(batches)) for row in b.to_pylist()]
        assert [[after(x["_pre"], s) for s in range(n)] for x in got] == want
        assert {x["flow"]: [after(x["_all"], s) for s in range(n)] for x in got if x["_all"] is not None} == ends
        assert sum(x["_all"] is not None for x in got) == 12
