"""Post-quantum readiness, exposure tiers and the crypto inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, pct
from postern.operators.baseline import SERVER, population
from postern.operators.ordered import dominant


def tier() -> Column:
    """Exposure tier of one session, NULL when neither cleartext nor a handshake was seen."""
    return (
        F.when(F.col("encryption_state").isin(*dims.CLEARTEXT), F.lit("cleartext"))
        .when(F.col("tls_version").isNull(), None)
        .when(F.col("pqc_selected"), F.lit("pqc_hybrid"))
        .when(F.col("forward_secrecy").eqNullSafe(F.lit(False)), F.lit("static_rsa"))
        .otherwise(F.lit("classical"))
    )


def level(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for floor, key in dims.READINESS_LEVELS:
        out = out.when(score >= floor, F.lit(key))
    return out


def _counts(sessions: DataFrame, keys: list[str]) -> DataFrame:
    tls = F.col("tls_version").isNotNull()
    tiers = [count_if(F.col("_tier") == t).alias(f"t_{t}") for t in dims.TIERS]
    return (
        population(sessions)
        .withColumn("_tier", tier())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_email"),
            count_if(tls).alias("n_tls"),
            count_if(tls & F.col("pqc_selected")).alias("g_pqc_key_exchange"),
            count_if(tls & (F.col("tls_version") == "TLS 1.3")).alias("g_tls13"),
            count_if(tls & F.col("pqc_offered")).alias("g_client_capability"),
            count_if(tls & F.col("forward_secrecy")).alias("g_forward_secrecy"),
            count_if(tls & F.col("forward_secrecy").isNotNull()).alias("n_kex"),
            count_if(~F.col("encryption_state").isin(*dims.CLEARTEXT)).alias("g_encrypted"),
            *tiers,
        )
    )


_TOTAL = {"pqc_key_exchange": "n_tls", "tls13": "n_tls", "client_capability": "n_tls", "forward_secrecy": "n_kex", "encrypted": "n_email"}


def readiness(sessions: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Weighted component score per capture, capped when no hybrid exchange was ever negotiated."""
    keys = [*(extra_keys or []), "capture_id"]
    agg = _counts(sessions, keys)
    for name, total in _TOTAL.items():
        agg = agg.withColumn(f"c_{name}", pct(F.col(f"g_{name}"), F.col(total), 0).cast("int"))
    num, den = F.lit(0), F.lit(0)
    for name, w in dims.READINESS_WEIGHTS.items():
        wi = F.lit(round(w * 100))
        num = num + F.coalesce(F.col(f"c_{name}") * wi, F.lit(0))
        den = den + F.when(F.col(f"c_{name}").isNotNull(), wi).otherwise(F.lit(0))
    raw = F.when(den > 0, F.bround(num.cast("double") / den, 0).cast("int"))
    capped = F.when((F.col("n_tls") > 0) & (F.col("g_pqc_key_exchange") == 0), F.least(raw, F.lit(dims.READINESS_NO_PQC_CAP))).otherwise(raw)
    hndl = F.col("t_static_rsa") + F.col("t_classical")
    return (
        agg.withColumn("score", capped)
        .withColumn("level", level(F.col("score")))
        .withColumn("hndl_sessions", hndl)
        .withColumn("hndl_pct", pct(hndl, F.col("n_email")))
    )


def exposure(sessions: DataFrame) -> DataFrame:
    """One row per capture and tier, tiers with no session included."""
    agg = _counts(sessions, ["capture_id"])
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"t_{t}").alias("sessions")) for t in dims.TIERS])
    return agg.select("capture_id", "n_email", F.explode(rows).alias("r")).select(
        "capture_id", "r.tier", "r.sessions", pct(F.col("r.sessions"), F.col("n_email")).alias("pct")
    )


def server_readiness(sessions: DataFrame) -> DataFrame:
    """Worst tier, dominant group and migration gap per server."""
    base = population(sessions).withColumn("_tier", tier())
    tls = F.col("tls_version").isNotNull()
    rank = dims.lookup("_tier", {t: i for i, t in enumerate(dims.TIERS)})
    agg = base.groupBy(*SERVER).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min_by("_tier", rank).alias("worst_tier"),
        count_if(tls & F.col("pqc_selected")).alias("pqc_selected"),
        count_if(tls & F.col("pqc_offered")).alias("clients_offering_pqc"),
        count_if(tls & (F.col("tls_version") == "TLS 1.3")).alias("tls13"),
    )
    groups = dominant(base.where(tls), SERVER, "key_group", "first_frame").select(*SERVER, F.col("value").alias("dominant_group"))
    return agg.join(groups, SERVER, "left").withColumn("migration_gap", (F.col("clients_offering_pqc") > 0) & (F.col("pqc_selected") == 0))


def group_usage(sessions: DataFrame, offers: DataFrame) -> DataFrame:
    """Offered against selected, per capture and key group. `offers` has one row per session and `groups_offered`."""
    offered = (
        offers.select("capture_id", F.explode(F.array_distinct("groups_offered")).alias("key_group"))
        .groupBy("capture_id", "key_group")
        .agg(F.count(F.lit(1)).alias("offered"))
    )
    selected = (
        sessions.where(F.col("key_group").isNotNull()).groupBy("capture_id", "key_group").agg(F.count(F.lit(1)).alias("selected"))
    )
    totals = sessions.groupBy("capture_id").agg(F.greatest(count_if(F.col("tls_version").isNotNull()), F.lit(1)).alias("total"))
    name = F.lower("key_group")
    return (
        offered.join(selected, ["capture_id", "key_group"], "full_outer")
        .na.fill(0, ["offered", "selected"])
        .join(totals, "capture_id")
        .select(
            "capture_id",
            "key_group",
            (F.contains(name, F.lit("mlkem")) | F.contains(name, F.lit("kyber"))).alias("pqc"),
            "offered",
            pct(F.col("offered"), F.col("total")).alias("offered_pct"),
            "selected",
            pct(F.col("selected"), F.col("total")).alias("selected_pct"),
        )
    )


def actions(sessions: DataFrame) -> DataFrame:
    """Ordered migration steps, each emitted only while something blocks it."""
    gaps = server_readiness(sessions).groupBy("capture_id").agg(count_if(F.col("migration_gap")).alias("gap_servers"))
    base = _counts(sessions, ["capture_id"]).join(gaps, "capture_id", "left")
    c = F.col
    conds = {
        1: (c("t_cleartext") > 0, c("t_cleartext")),
        2: (c("t_static_rsa") > 0, c("t_static_rsa")),
        3: (c("g_tls13") < c("n_tls"), c("n_tls") - c("g_tls13")),
        4: (c("gap_servers") > 0, c("gap_servers")),
        5: ((c("g_pqc_key_exchange") < c("n_tls")) & (c("gap_servers") == 0), c("n_tls") - c("g_pqc_key_exchange")),
    }
    rows = [
        F.when(conds[p][0], F.struct(F.lit(p).alias("priority"), F.lit(t).alias("title"), conds[p][1].alias("affected")))
        for p, t in dims.MIGRATION_ACTIONS
    ]
    return base.select("capture_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("capture_id", "r.*")


def inventory(sessions: DataFrame) -> DataFrame:
    """Observed algorithms per capture, typed as assets; one explode, one aggregation."""
    kinds = {"suite": "cipher_suite", "group": "key_group", "kex": "key_exchange", "auth": "authentication", "version": "tls_version"}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).alias("name")) for k, v in kinds.items()])
    pqc = F.col("name").isin(*dims.PQC_HYBRID_NAMES)
    primitive = (
        F.when(F.col("kind") == "suite", F.lit("ae"))
        .when((F.col("kind") == "group") & pqc, F.lit("kem"))
        .when(F.col("kind").isin("group", "kex"), F.lit("key-agree"))
        .when(F.col("kind") == "auth", F.lit("signature"))
    )
    return (
        sessions.where(F.col("tls_version").isNotNull())
        .select("capture_id", F.explode(pairs).alias("p"))
        .where("p.name IS NOT NULL")
        .groupBy("capture_id", F.col("p.kind").alias("kind"), F.col("p.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("sessions"))
        .withColumn("primitive", primitive)
        .withColumn("bom_ref", F.concat(F.lit("crypto/"), F.col("kind"), F.lit("/"), F.lower(F.replace(F.col("name"), F.lit(" "), F.lit("-")))))
        .withColumn("nist_level", F.when(F.col("primitive") == "kem", F.lit(3)))
    )


def cbom(sessions: DataFrame, serial: str, as_of: str) -> DataFrame:
    """CycloneDX-shaped JSON document per capture. `serial` and `as_of` are parameters, never clock values.

    A document lists distinct algorithms (bounded by the registries), so the collect per capture is small.
    """
    parts = inventory(sessions).where(F.col("kind") != "version")
    component = F.struct(
        F.lit("cryptographic-asset").alias("type"),
        F.col("bom_ref").alias("bom-ref"),
        "name",
        F.struct(
            F.lit("algorithm").alias("assetType"),
            F.struct(
                "primitive",
                F.when(F.col("primitive") == "kem", F.array(F.lit("keygen"))).otherwise(F.array(F.lit("encrypt"))).alias("cryptoFunctions"),
                F.col("nist_level").alias("nistQuantumSecurityLevel"),
            ).alias("algorithmProperties"),
        ).alias("cryptoProperties"),
        F.col("sessions"),
    )
    docs = parts.groupBy("capture_id").agg(F.sort_array(F.collect_list(component)).alias("components"))
    tls = sessions.where(F.col("tls_version").isNotNull()).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("tls_sessions"),
        count_if(F.col("pqc_offered")).alias("pqc_offered"),
        count_if(F.col("pqc_selected")).alias("pqc_selected"),
        count_if(F.col("forward_secrecy").eqNullSafe(F.lit(False))).alias("no_forward_secrecy"),
    )
    body = F.to_json(
        F.struct(
            F.lit("CycloneDX").alias("bomFormat"),
            F.lit("1.6").alias("specVersion"),
            F.concat(F.lit("urn:uuid:"), F.lit(serial)).alias("serialNumber"),
            F.struct(F.lit(as_of).alias("timestamp")).alias("metadata"),
            "components",
            F.struct("tls_sessions", "pqc_offered", "pqc_selected", "no_forward_secrecy").alias("readiness"),
        )
    )
    return docs.join(tls, "capture_id").select("capture_id", F.size("components").alias("component_count"), "tls_sessions", body.alias("document"))
