"""Drift between captures: metrics, server attributes and finding categories, for any set of pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, pct
from postern.operators import baseline, funnel, posture, readiness
from postern.operators.ordered import numbered
from postern.session import stage

SERVER_ATTRIBUTES = ["protocol", "tls_version", "cipher_suite", "cipher_strength", "key_group", "pqc", "ja4s", "outcome", "starttls_advertised"]
COMPARED = SERVER_ATTRIBUTES[1:]


def metrics_wide(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """The 13 metrics of each capture, one row per capture. `sessions` carry the suite facts."""
    base = baseline.population(sessions)
    tls = F.col("tls_version").isNotNull()
    n_tls, n = count_if(tls), F.count(F.lit(1))
    kex = tls & F.col("forward_secrecy").isNotNull()
    agg = base.groupBy("capture_id").agg(
        n.alias("sessions"),
        pct(count_if(~F.col("encryption_state").isin(*dims.CLEARTEXT)), n).alias("encrypted_pct"),
        pct(count_if(F.col("tls_version") == "TLS 1.3"), n_tls).alias("tls13_pct"),
        pct(count_if(F.col("tls_version").isin(*dims.DEPRECATED_VERSIONS)), n_tls).alias("deprecated_tls_pct"),
        pct(count_if(kex & F.col("forward_secrecy")), count_if(kex)).alias("pfs_pct"),
        pct(count_if(tls & F.col("aead")), n_tls).alias("aead_pct"),
        pct(count_if(tls & F.col("pqc_selected")), n_tls).alias("pqc_selected_pct"),
        pct(count_if(tls & F.col("pqc_offered")), n_tls).alias("pqc_offered_pct"),
        count_if(F.col("cleartext_auth")).cast("double").alias("credential_exposures"),
    )
    fail = F.col("verdict") == "FAIL"
    sev = found.groupBy("capture_id").agg(
        count_if(fail & (F.col("severity") == "CRITICAL")).cast("double").alias("critical_findings"),
        count_if(fail & (F.col("severity") == "HIGH")).cast("double").alias("high_findings"),
    )
    score = posture.posture(sessions, found).select("capture_id", F.col("overall").cast("double").alias("posture"))
    pqc = readiness.readiness(sessions).select("capture_id", F.col("score").cast("double").alias("pqc_readiness"))
    adopt = funnel.summary(sessions).select("capture_id", F.col("adoption_pct").alias("starttls_adoption"))
    out = agg.join(sev, "capture_id", "left").na.fill(0.0, ["critical_findings", "high_findings"])
    for part in (score, pqc, adopt):
        out = out.join(part, "capture_id", "left")
    return out


def metrics(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Long form: (capture, metric, value); NULL value when the metric could not be assessed."""
    wide = metrics_wide(sessions, found)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in dims.METRIC_BETTER])
    return wide.select("capture_id", F.explode(rows).alias("r")).select("capture_id", "r.*")


def with_attributes(sessions: DataFrame) -> DataFrame:
    tls = F.col("tls_version").isNotNull()
    strength = F.when(F.col("cipher_suite").isNotNull(), F.when(F.size("weaknesses") > 0, F.lit("weak")).when(F.col("aead"), F.lit("aead")).otherwise(F.lit("legacy")))
    return (
        sessions.withColumn("cipher_strength", strength)
        .withColumn("pqc", F.when(tls, F.when(F.col("pqc_selected"), F.lit("hybrid")).otherwise(F.lit("classical"))))
        .withColumn("outcome", F.col("encryption_state"))
        .withColumn(
            "starttls_advertised",
            F.when(F.col("encryption_state") != "IMPLICIT_TLS", F.when(F.col("upgrade_advertised"), F.lit("yes")).otherwise(F.lit("no"))),
        )
    )


def server_snapshot(sessions: DataFrame) -> DataFrame:
    """Dominant value of each attribute per server, one row per (capture, server)."""
    rows = with_attributes(baseline.population(sessions))
    prof = baseline.profile(rows, baseline.SERVER, SERVER_ATTRIBUTES, "first_frame")
    dom = baseline.dominant_values(prof, baseline.SERVER, None)
    return dom.groupBy(*baseline.SERVER).agg(*[F.max(F.when(F.col("dim") == a, F.col("value"))).alias(a) for a in SERVER_ATTRIBUTES])


def category_snapshot(found: DataFrame) -> DataFrame:
    return (
        found.where(F.col("verdict") == "FAIL")
        .groupBy("capture_id", "category")
        .agg(F.count(F.lit(1)).alias("count"), F.min_by("severity", "severity_rank").alias("severity"))
    )


def capture_pairs(captures: DataFrame, seconds_per_block: float = 86400.0) -> DataFrame:
    """Neighbouring captures in time: (from_capture, to_capture), no driver loop and no global window."""
    ranked = numbered(
        captures.withColumn("series", F.lit("all")),
        ["series"],
        [F.col("observed_at"), F.col("capture_id")],
        [F.floor(F.col("observed_at") / F.lit(seconds_per_block))],
        "position",
    )
    later = ranked.select((F.col("position") - 1).alias("position"), F.col("capture_id").alias("to_capture"))
    return ranked.select("position", F.col("capture_id").alias("from_capture")).join(later, "position").drop("position")


def _sides(rows: DataFrame, pairs: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Before and after payload per (pair, keys): the full outer join of two captures, for all pairs in one aggregation."""
    body = F.struct(*payload)
    before = pairs.join(rows, pairs["from_capture"] == rows["capture_id"]).select("from_capture", "to_capture", *keys, body.alias("b"), F.lit(None).alias("a"))
    after = pairs.join(rows, pairs["to_capture"] == rows["capture_id"]).select("from_capture", "to_capture", *keys, F.lit(None).alias("b"), body.alias("a"))
    return before.unionByName(after).groupBy("from_capture", "to_capture", *keys).agg(F.max("b").alias("before"), F.max("a").alias("after"))


def compare_metrics(values: DataFrame, pairs: DataFrame) -> DataFrame:
    both = _sides(values, pairs, ["metric"], ["value"])
    before, after = F.col("before.value"), F.col("after.value")
    higher = dims.lookup("metric", dims.METRIC_BETTER) == "higher"
    improved = F.when(higher, after > before).otherwise(after < before)
    direction = (
        F.when(before.isNull() | after.isNull(), F.lit("not_comparable"))
        .when(F.abs(after - before) < dims.DRIFT_DEAD_BAND, F.lit("unchanged"))
        .when(improved, F.lit("improved"))
        .otherwise(F.lit("regressed"))
    )
    return both.select(
        "from_capture", "to_capture", "metric", before.alias("baseline"), after.alias("current"), F.bround(after - before, 1).alias("delta"), direction.alias("direction")
    )


def _rank(attribute: str, value: Column) -> Column | None:
    if attribute == "tls_version":
        return dims.lookup(value, dims.VERSION_RANK)
    if attribute == "cipher_strength":
        return dims.lookup(value, {"weak": 0, "legacy": 1, "aead": 2})
    if attribute == "pqc":
        return dims.lookup(value, {"classical": 0, "hybrid": 1})
    if attribute == "outcome":
        return F.when(value.isin(*dims.PROTECTED), 1).otherwise(0)
    if attribute == "starttls_advertised":
        return dims.lookup(value, {"no": 0, "yes": 1})
    return None


def compare_servers(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and server: status and the changed attributes with their direction."""
    both = _sides(snapshots, pairs, ["server_ip", "server_port"], SERVER_ATTRIBUTES)
    changes = []
    for a in COMPARED:
        old, new = F.col(f"before.{a}"), F.col(f"after.{a}")
        direction = F.lit("changed")
        r_old, r_new = _rank(a, old), _rank(a, new)
        if r_old is not None:
            direction = F.when(r_new > r_old, F.lit("improved")).when(r_new < r_old, F.lit("regressed")).otherwise(F.lit("changed"))
        changes.append(F.when(old != new, F.struct(F.lit(a).alias("attribute"), old.alias("old"), new.alias("new"), direction.alias("direction"))))
    rows = both.withColumn("changes", F.array_compact(F.array(*changes)))

    def any_is(direction: str) -> Column:
        return F.exists("changes", lambda x: x["direction"] == direction)

    has = {d: any_is(d) for d in ("regressed", "improved")}
    status = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.size("changes") == 0, F.lit("unchanged"))
        .when(has["regressed"] & ~has["improved"], F.lit("regressed"))
        .when(has["improved"] & ~has["regressed"], F.lit("improved"))
        .when(has["regressed"], F.lit("mixed"))
        .otherwise(F.lit("changed"))
    )
    return rows.withColumn("status", status)


def compare_findings(categories: DataFrame, pairs: DataFrame) -> DataFrame:
    both = _sides(categories, pairs, ["category"], ["count", "severity"])
    before, after = F.col("before.count"), F.col("after.count")
    status = (
        F.when(before.isNull(), F.lit("new"))
        .when(after.isNull(), F.lit("resolved"))
        .when(after > before, F.lit("worse"))
        .when(after < before, F.lit("better"))
        .otherwise(F.lit("persisting"))
    )
    return both.select(
        "from_capture",
        "to_capture",
        "category",
        F.coalesce("after.severity", "before.severity").alias("severity"),
        status.alias("status"),
        F.coalesce(before, F.lit(0)).alias("baseline_count"),
        F.coalesce(after, F.lit(0)).alias("current_count"),
    )


def summary(metric_rows: DataFrame, server_rows: DataFrame, finding_rows: DataFrame) -> DataFrame:
    """Verdict and counters per pair of captures."""
    pair = ["from_capture", "to_capture"]
    m = metric_rows.groupBy(*pair).agg(
        count_if(F.col("direction") == "regressed").alias("m_reg"), count_if(F.col("direction") == "improved").alias("m_imp")
    )

    def n(direction: str) -> Column:
        return F.size(F.filter("changes", lambda x: x["direction"] == direction)).cast("bigint")

    compared = ~F.col("status").isin("added", "removed")
    s = server_rows.groupBy(*pair).agg(
        F.sum(F.when(compared, n("regressed")).otherwise(0)).alias("s_reg"),
        F.sum(F.when(compared, n("improved")).otherwise(0)).alias("s_imp"),
        F.sum(F.when(compared, n("changed")).otherwise(0)).alias("neutral_changes"),
        count_if(compared).alias("servers_compared"),
        count_if(F.col("status") == "added").alias("servers_added"),
        count_if(F.col("status") == "removed").alias("servers_removed"),
    )
    f = finding_rows.groupBy(*pair).agg(
        count_if(F.col("status").isin("new", "worse")).alias("f_reg"), count_if(F.col("status").isin("resolved", "better")).alias("f_imp")
    )
    out = m.join(s, pair, "full_outer").join(f, pair, "full_outer").na.fill(0)
    reg, imp = F.col("m_reg") + F.col("s_reg") + F.col("f_reg"), F.col("m_imp") + F.col("s_imp") + F.col("f_imp")
    verdict = (
        F.when((reg == 0) & (imp == 0) & (F.col("neutral_changes") == 0), F.lit("stable"))
        .when((reg > 0) & (imp == 0), F.lit("regressed"))
        .when((imp > 0) & (reg == 0), F.lit("improved"))
        .when(reg > 0, F.lit("mixed"))
        .otherwise(F.lit("changed"))
    )
    return out.select(
        *pair, verdict.alias("verdict"), reg.alias("regressions"), imp.alias("improvements"), "neutral_changes", "servers_compared", "servers_added", "servers_removed"
    )


def timeline(sessions: DataFrame, found: DataFrame, captures: DataFrame) -> DataFrame:
    """Step-by-step drift over all captures in time order, every step computed in the same job."""
    pairs = stage(capture_pairs(captures))
    return summary(
        compare_metrics(stage(metrics(sessions, found)), pairs),
        compare_servers(stage(server_snapshot(sessions)), pairs),
        compare_findings(category_snapshot(found), pairs),
    )
