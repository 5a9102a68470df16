"""Boxes that meet, against all pairs, with blocks so small that every coarse cell has several."""

import numpy as np

from postern.ml import clusters


def test_met_boxes_are_all_pairs_within_reach(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    rng, eps = np.random.default_rng(5), 0.9
    lo = rng.normal(size=(60, 5)) * 0.8
    hi = lo + rng.random((60, 5)) * 0.2 * (np.arange(60) % 2)[:, None]
    rows = [(i % 2, *[int(np.floor(x / 0.9)) for x in a[:2]], f"c{i}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
    rows.append((0, 0, 0, "null", [None] * 5, [None] * 5))
    df = spark.createDataFrame(rows, "g int, _g0 bigint, _g1 bigint, cell string, _lo array<double>, _hi array<double>")
    got = [(frozenset((r["cell"], r["other"])), r["sure"]) for r in clusters._met(df, eps, ["_g0", "_g1"], ["g"]).collect()]
    want = set()
    for i in range(60):
        for j in range(i):
            near = abs(rows[i][1] - rows[j][1]) <= 1 and abs(rows[i][2] - rows[j][2]) <= 1
            gap = np.maximum(0, np.maximum(lo[i] - hi[j], lo[j] - hi[i]))
            far = np.maximum(abs(lo[i] - hi[j]), abs(hi[i] - lo[j]))
            if i % 2 == j % 2 and near and (gap**2).sum() <= eps * eps:
                want.add((frozenset((f"c{i}", f"c{j}")), bool((far**2).sum() <= eps * eps)))
    assert len(got) == len(set(got)) and set(got) == want and len({s for _, s in want}) == 2
