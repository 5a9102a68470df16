"""Staging needs a folder that all executors share, and cleans up."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from postern import session


def test_a_cluster_without_a_shared_folder_is_refused():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)


def test_staged_tables_are_read_back_and_removed(spark):
    session.clear_staged(spark)
    df = session.stage(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert sorted(map(tuple, df.collect())) == [(i, i % 3) for i in range(10)]
    assert session.clear_staged(spark) == 1 and session.clear_staged(spark) == 0
