"""Posture score: six dimensions, each with the evidence it rests on; NULL is not assessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, pct, pct_score
from postern.operators import baseline


def cert_penalty() -> Column:
    """Worst applicable penalty of one examined certificate, 0 when none applies."""
    parts = []
    for flag, points in dims.CERT_PENALTIES:
        cond = F.col("cert_hostname_match").eqNullSafe(F.lit(False)) if flag == "cert_hostname_mismatch" else F.col(flag)
        parts.append(F.when(cond, F.lit(points)).otherwise(F.lit(0)))
    return F.greatest(*parts)


def _mean_score(n: Column, total: Column) -> Column:
    return F.when(n > 0, F.bround(total.cast("double") / n, 0).cast("int"))


def dimension_scores(sessions: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Uncapped score, assessed and total per (capture, dimension), from one grouped pass.

    `sessions` carry the suite facts; the behavioural dimension needs each server's baseline, so
    deviations are joined first and everything is then counted per capture with partial aggregation.
    """
    ek = list(extra_keys or [])
    keys = [*ek, "capture_id"]
    base = baseline.population(sessions)
    exp = baseline.expectations(base, [*ek, *baseline.SERVER], dims.BASELINE_DIMS, "first_frame")
    joined = sessions.join(exp, [*ek, *baseline.SERVER], "left")
    determinate = ~F.col("is_indeterminate")
    ready = determinate & (F.col("server_sessions") >= dims.MIN_BASELINE_SESSIONS)
    differs = F.lit(False)
    for d in dims.BASELINE_DIMS:
        differs = differs | F.coalesce(F.col(f"exp_{d}.value") != F.col(d).cast("string"), F.lit(False))
    tls, suite = F.col("tls_version").isNotNull(), F.col("cipher_suite").isNotNull()
    weak = F.size("weaknesses") > 0
    seen = tls & F.col("cert_observable") & F.coalesce(F.col("cert_seen"), F.lit(False))
    agg = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(determinate).alias("n_det"),
        count_if(determinate & F.col("encryption_state").isin(*dims.PROTECTED)).alias("n_prot"),
        count_if(tls).alias("n_tls"),
        F.sum(F.when(tls, dims.lookup("tls_version", dims.VERSION_SCORE, 50))).alias("s_ver"),
        count_if(suite).alias("n_suite"),
        F.sum(F.when(suite, F.when(weak, 40).when(F.col("aead"), 100).otherwise(70))).alias("s_suite"),
        count_if(F.col("forward_secrecy").isNotNull()).alias("n_kex"),
        count_if(F.col("forward_secrecy")).alias("n_pfs"),
        count_if(seen).alias("n_cert"),
        F.sum(F.when(seen, F.lit(100) - cert_penalty())).alias("s_cert"),
        count_if(ready).alias("n_base"),
        count_if(ready & differs).alias("n_dev"),
    )
    c = F.col

    def row(dim: str, score: Column, assessed: str, total: str) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), score.cast("int").alias("score"), c(assessed).alias("assessed"), c(total).alias("total"))

    rows = F.array(
        row("transport", pct_score(c("n_prot"), c("n_det")), "n_det", "n"),
        row("tls_version", _mean_score(c("n_tls"), c("s_ver")), "n_tls", "n"),
        row("crypto", _mean_score(c("n_suite"), c("s_suite")), "n_suite", "n"),
        row("pfs", pct_score(c("n_pfs"), c("n_kex")), "n_kex", "n"),
        row("certificate", _mean_score(c("n_cert"), c("s_cert")), "n_cert", "n_tls"),
        row("behaviour", pct_score(c("n_base") - c("n_dev"), c("n_base")), "n_base", "n"),
    )
    return agg.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").withColumn("coverage_pct", pct(c("assessed"), c("total")))


def apply_ceilings(scores: DataFrame, found: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Cap each dimension by its most severe related finding, whatever the verdict; INFO never caps."""
    ek = list(extra_keys or [])
    bridge = dims.dimension_categories(scores.sparkSession)
    worst = (
        found.groupBy(*ek, "capture_id", "category", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(bridge), "category")
        .groupBy(*ek, "capture_id", "dimension")
        .agg(F.min(dims.lookup("severity", dims.SEVERITY_CEILING)).alias("ceiling"))
    )
    return (
        scores.join(worst, [*ek, "capture_id", "dimension"], "left")
        .withColumn("uncapped", F.col("score"))
        .withColumn("score", F.when(F.col("score").isNotNull(), F.least("score", "ceiling")))
    )


def overall(capped: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Weighted mean over the assessed dimensions, with its terms and what was left out."""
    keys = [*(extra_keys or []), "capture_id"]
    w = dims.lookup("dimension", dims.POSTURE_WEIGHTS)
    ok = F.col("score").isNotNull() & (F.col("assessed") > 0)
    scaled = capped.withColumn("_w", w).withColumn("_ok", ok)
    # Weights are multiples of 0.05: sum them as integers, so the order of the sum cannot matter.
    wi = F.bround(F.col("_w") * 100, 0).cast("int")
    agg = scaled.groupBy(*keys).agg(
        F.sum(F.when(F.col("_ok"), F.col("score") * wi)).alias("num"),
        F.sum(F.when(F.col("_ok"), wi)).alias("den"),
        count_if(F.col("_ok")).alias("dimensions_assessed"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("dimension")))).alias("excluded"),
    )
    num, den = F.col("num").cast("double"), F.col("den").cast("double")
    return agg.select(
        *keys,
        F.when(F.col("den") > 0, F.bround(num / den, 0).cast("int")).alias("overall"),
        (num / 100).alias("numerator"),
        (F.coalesce(den, F.lit(0.0)) / 100).alias("assessed_weight"),
        "dimensions_assessed",
        "excluded",
    )


def posture(sessions: DataFrame, found: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    return overall(apply_ceilings(dimension_scores(sessions, extra_keys), found, extra_keys), extra_keys)


def overview(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Landing numbers of a capture: outcomes, crypto, coverage and findings in two grouped passes."""
    tls = F.col("tls_version").isNotNull()
    s = sessions.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        count_if(F.col("encryption_state").isin(*dims.PROTECTED)).alias("protected"),
        count_if(F.col("encryption_state").isin(*dims.CLEARTEXT)).alias("cleartext"),
        count_if(F.col("is_indeterminate")).alias("indeterminate"),
        count_if(tls).alias("tls_sessions"),
        count_if(tls & F.coalesce("forward_secrecy", F.lit(False))).alias("forward_secrecy"),
        count_if(tls & F.col("pqc_offered")).alias("pqc_offered"),
        count_if(tls & F.col("pqc_selected")).alias("pqc_selected"),
        count_if(tls & F.col("cert_observable")).alias("cert_observable"),
        count_if(F.col("session_complete")).alias("complete"),
    )
    f = found.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("findings"),
        *[count_if(F.col("severity") == sev).alias(f"{sev.lower()}_findings") for sev in dims.SEVERITY_RANK],
        count_if(F.col("verdict") == "UNKNOWN").alias("unknown_verdicts"),
    )
    return (
        s.join(f, "capture_id", "left")
        .withColumn("certificate_coverage_pct", pct(F.col("cert_observable"), F.col("tls_sessions")))
        .withColumn("session_coverage_pct", pct(F.col("complete"), F.col("sessions")))
    )


def tls_stats(sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suite table, key-group breakdown with its fallback label, and estate counts per capture."""
    tls = sessions.where(F.col("tls_version").isNotNull())
    suites = (
        tls.where(F.col("cipher_suite").isNotNull())
        .groupBy("capture_id", "cipher_suite")
        .agg(F.count(F.lit(1)).alias("sessions"), F.array_sort(F.collect_set("tls_version")).alias("versions"))
    )
    label = F.coalesce(
        F.col("key_group"), F.when(F.col("forward_secrecy").eqNullSafe(F.lit(False)), F.lit("RSA key transport")), F.lit("not visible")
    )
    groups = tls.groupBy("capture_id", label.alias("group_label")).agg(F.count(F.lit(1)).alias("sessions"))
    estate = (
        sessions.where(F.col("protocol").isNotNull())
        .groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("email_sessions"),
            count_if(F.col("tls_version").isNotNull()).alias("tls_sessions"),
            F.count_distinct("server_ip", "server_port").alias("servers"),
            F.count_distinct("client_ip").alias("clients"),
        )
    )
    return suites, groups, estate
