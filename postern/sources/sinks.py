"""Writers: idempotent result tables and JSON documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, partition: str = "capture_id", rows_per_file: int = 2_000_000) -> None:
    """Replace only the captures in `df`; other partitions of the table stay as they are.

    Rows of one capture are spread over as many tasks as the shuffle has (a capture may be a third of
    everything), and files are capped by row count.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(partition)
        .parquet(path)
    )


def write_documents(df: DataFrame, path: str, document: str = "document") -> None:
    """One JSON document per row, as text lines."""
    df.select(F.col(document).alias("value")).write.mode("overwrite").text(path)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    fs, folder = _files(spark, f"{out}/_manifests")
    if not fs.exists(folder):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")), p) for n, p in names if n.endswith(".json"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> int:
    """Write tables and documents as one new version of `out`, all or nothing; returns its number.

    Each version has a folder of its own. Readers find it only through its manifest, which is written after every table
    and created exclusively, so a run that fails, or loses against another, leaves the last version as it is. One row count
    per table goes into the manifest.
    """
    folder = f"versions/{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{out}/{folder}/{name}")
        counts[name] = spark.read.parquet(f"{out}/{folder}/{name}").count()
    number = (_manifests(spark, out) or [(0, "")])[-1][0] + 1
    fs, path = _files(spark, f"{out}/_manifests/{number}.json")
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(json.dumps({"version": number, "folder": folder, "rows": counts}).encode()))
    finally:
        stream.close()
    return number


def published(spark: SparkSession, out: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last version, or of a given one; nothing before the first is complete."""
    found = dict(_manifests(spark, out))
    if not found:
        return {}
    path = found[max(found) if version is None else version]
    manifest = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return {name: spark.read.parquet(f"{out}/{manifest['folder']}/{name}") for name in manifest["rows"]}
