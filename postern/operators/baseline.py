"""Per-server behavioural baselines: value profiles, dominant values and deviations from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, server_key
from postern.operators.ordered import exact_median

SERVER = ["capture_id", "server_ip", "server_port"]


def population(sessions: DataFrame) -> DataFrame:
    """Sessions that may speak about a server: a known protocol and a determinate outcome."""
    return sessions.where(F.col("protocol").isNotNull() & ~F.col("is_indeterminate"))


def profile(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], order: str) -> DataFrame:
    """Long value distribution: (keys, dim, value) with count, first position and share.

    Counting is a partial aggregation, so a server that owns most sessions is combined on the
    map side; the share window then runs over distinct values only.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counts = (
        df.select(*keys, F.col(order).alias("_o"), F.explode(pairs).alias("p"))
        .where("p.value IS NOT NULL")
        .groupBy(*keys, F.col("p.dim").alias("dim"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("_o").alias("first_seen"))
    )
    total = F.sum("cnt").over(Window.partitionBy(*keys, "dim"))
    return counts.withColumn("share", F.col("cnt").cast("double") / total)


def dominant_values(prof: DataFrame, keys: Sequence[str], threshold: float | None = dims.DOMINANCE) -> DataFrame:
    """One row per (keys, dim): the most frequent value, first seen winning ties."""
    top = prof.groupBy(*keys, "dim").agg(
        F.max_by(F.struct("value", "cnt", "share"), F.struct(F.col("cnt"), -F.col("first_seen"))).alias("t")
    )
    out = top.select(*keys, "dim", "t.value", "t.cnt", "t.share")
    return out if threshold is None else out.where(F.col("share") >= F.lit(threshold))


def expectations(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], order: str) -> DataFrame:
    """One row per key: session count and, per dimension, the expected value and its share."""
    dom = dominant_values(profile(df, keys, dimensions, order), keys)
    wide = dom.groupBy(*keys).agg(
        *[F.max(F.when(F.col("dim") == d, F.struct("value", "share"))).alias(f"exp_{d}") for d in dimensions]
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("server_sessions"))
    return sizes.join(wide, list(keys), "left")


def with_deviations(
    df: DataFrame,
    keys: Sequence[str] = tuple(SERVER),
    dimensions: Sequence[str] = tuple(dims.BASELINE_DIMS),
    order: str = "first_frame",
    min_rows: int = dims.MIN_BASELINE_SESSIONS,
) -> DataFrame:
    """Add `has_baseline`, the `deviations` array and `deviation_score` to every row of the population.

    The expectations are one narrow row per server; joining them to the rows needs no salting
    because AQE splits the rows of a hot server and the other side has a single match.
    """
    exp = expectations(df, keys, dimensions, order)
    ready = F.col("server_sessions") >= F.lit(min_rows)

    def entry(d: str) -> Column:
        observed = F.col(d).cast("string")
        differs = ready & observed.isNotNull() & (F.col(f"exp_{d}.value") != observed)
        return F.when(
            differs,
            F.struct(
                F.lit(d).alias("dimension"),
                F.col(f"exp_{d}.value").alias("expected"),
                F.col(f"exp_{d}.share").alias("expected_share"),
                observed.alias("observed"),
            ),
        )

    total = F.aggregate("deviations", F.lit(0.0), lambda acc, x: acc + x["expected_share"])
    return (
        df.join(exp, list(keys), "left")
        .withColumn("has_baseline", ready)
        .withColumn("deviations", F.array_compact(F.array(*[entry(d) for d in dimensions])))
        .withColumn("deviation_score", F.bround(F.least(total / F.lit(float(len(dimensions))), F.lit(1.0)), 3))
        .drop(*[f"exp_{d}" for d in dimensions])
    )


def server_stats(sessions: DataFrame) -> DataFrame:
    """Sessions, protocol mix, first banner and exact median handshake per server."""
    base = population(sessions)
    stats = base.groupBy(*SERVER).agg(
        F.count(F.lit(1)).alias("sessions"),
        *[count_if(F.col("protocol") == p).alias(f"{p.lower()}_sessions") for p in ("SMTP", "IMAP", "POP3")],
        F.min_by("server_banner", F.when(F.col("server_banner").isNotNull(), F.col("first_frame"))).alias("banner"),
    )
    med = exact_median(base, SERVER, F.col("handshake_ms")).select(*SERVER, F.bround("median", 2).alias("median_handshake_ms"))
    return stats.join(med, SERVER, "left")


def identify_software(text: Column, protocol: Column) -> Column:
    """Struct (key, version) of the first matching signature, or the generic key of the protocol.

    The version is looked for in the 40 characters after the match.
    """
    key, version = None, None
    for name, _, pattern in dims.SOFTWARE:
        hit = text.rlike(pattern)
        tail = F.regexp_extract(text, f"{pattern.replace('(?i)', '(?is)(?:')})(.{{0,40}})", 1)
        found = F.regexp_extract(tail, r"(\d+\.\d+(?:\.\d+)?)", 1)
        version_here = F.when(found != "", found)
        key = F.when(hit, F.lit(name)) if key is None else key.when(hit, F.lit(name))
        version = F.when(hit, version_here) if version is None else version.when(hit, version_here)
    generic = F.when(protocol == "SMTP", F.lit("generic_smtp")).otherwise(F.lit("generic_mailbox"))
    return F.struct(F.coalesce(key, generic).alias("key"), version.alias("version"))


def hostname() -> Column:
    """SNI, else a dotted non-numeric first banner word, else the address."""
    word = F.get(F.split(F.trim(F.col("server_banner")), r"\s+"), F.lit(0))
    named = F.contains(word, F.lit(".")) & ~word.rlike("^[0-9]")
    return F.coalesce(F.col("sni"), F.when(named, word), F.col("server_ip"))


def software_by_server(sessions: DataFrame) -> DataFrame:
    """Majority software key, hostname and protocol per server; version from the first session of that key."""
    rows = (
        sessions.where(F.col("protocol").isNotNull())
        .withColumn("_sw", identify_software(F.coalesce("server_banner", F.lit("")), F.col("protocol")))
        .select(*SERVER, "first_frame", F.col("_sw.key").alias("software"), "_sw.version", hostname().alias("hostname"), "protocol")
    )
    prof = profile(rows, SERVER, ["software", "hostname", "protocol"], "first_frame")
    wide = dominant_values(prof, SERVER, None).groupBy(*SERVER).agg(
        *[F.max(F.when(F.col("dim") == d, F.col("value"))).alias(d) for d in ("software", "hostname", "protocol")]
    )
    version = rows.groupBy(*SERVER, "software").agg(F.min_by(F.struct("version"), "first_frame").alias("v"))
    return wide.join(version, [*SERVER, "software"], "left").select(*SERVER, "software", F.col("v.version").alias("version"), "hostname", "protocol")


def server_text(df: DataFrame) -> DataFrame:
    return df.withColumn("server", server_key())
