"""Registry of runnable queries: name, Spark job and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, oracle: str | None = None) -> Callable[[Job], Job]:
    """Register a job; `covers` lists the survey items it exercises."""

    def add(fn: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    from postern.plans import jobs_evidence, jobs_ml, jobs_sessions, jobs_traffic, jobs_whatif, jobs_wire  # noqa: F401
