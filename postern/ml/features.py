"""Numeric features of sessions and client hellos, and the analyst label of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto

# Feature order of the outlier search and of the risk classifier
ANOMALY_FEATURES = [
    "is_smtp", "is_imap", "is_pop3", "server_port", "tls_established", "implicit_tls", "tls_version_rank", "forward_secrecy", "aead", "cipher_is_known", "pqc_offered",
    "cert_observable", "upgrade_advertised", "upgrade_requested", "upgrade_mangled", "cleartext_auth", "cleartext_mail", "handshake_ms", "frame_span", "event_count", "session_complete",
]
RISK_FEATURES = [
    "is_smtp", "is_imap", "is_pop3", "implicit_tls_port", "tls_established", "implicit_tls", "tls_version_rank", "forward_secrecy", "aead", "cipher_key_bits", "cipher_weakness_count",
    "pqc_offered", "pqc_selected", "upgrade_advertised", "upgrade_requested", "upgrade_mangled", "upgrade_rejected", "cleartext_auth", "cleartext_mail", "cert_observable", "cert_expired",
    "cert_not_yet_valid", "cert_days_to_expiry", "cert_key_bits", "cert_weak_key", "cert_broken_signature", "cert_hostname_mismatch", "cert_self_signed", "cert_chain_incomplete", "cert_chain_invalid",
]
CLIENT_GROUPS = ["x25519", "secp256r1", "secp384r1", "secp521r1", "x448", "ffdhe2048", "ffdhe3072"]
CLIENT_FEATURES = ["max_version", "versions", "ciphers", "extensions", "groups", "offers_pqc", "sni", "alpn", *[f"group_{g}" for g in CLIENT_GROUPS]]
KEYS = ["capture_id", "session_id"]


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def _common() -> dict[str, Column]:
    c = F.col
    return {
        **{f"is_{p.lower()}": flag(c("protocol") == p) for p in ("SMTP", "IMAP", "POP3")},
        "tls_established": flag(c("tls_established")),
        "implicit_tls": flag(c("encryption_state") == "IMPLICIT_TLS"),
        "tls_version_rank": dims.lookup("tls_version", dims.VERSION_RANK, 0).cast("double"),
        "forward_secrecy": flag(c("forward_secrecy")),
        "aead": flag(c("aead")),
        "pqc_offered": flag(c("pqc_offered")),
        "upgrade_advertised": flag(c("upgrade_advertised")),
        "upgrade_requested": flag(c("upgrade_requested")),
        "upgrade_mangled": flag(c("upgrade_advertised_mangled")),
        "cleartext_auth": flag(c("cleartext_auth")),
        "cleartext_mail": flag(c("cleartext_mail")),
    }


def usable(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("protocol").isNotNull() & ~F.col("is_indeterminate"))


def anomaly_features(sessions: DataFrame) -> DataFrame:
    c = F.col
    cols = {
        **_common(),
        "server_port": c("server_port").cast("double"),
        "cipher_is_known": flag(c("cipher_suite").isin(*dims.CIPHER_SUITES.values())),
        "cert_observable": flag(c("cert_observable")),
        "handshake_ms": F.coalesce(c("handshake_ms"), F.lit(0.0)),
        "frame_span": F.greatest(c("last_frame") - c("first_frame"), F.lit(0)).cast("double"),
        "event_count": c("event_count").cast("double"),
        "session_complete": flag(c("session_complete")),
    }
    return sessions.select(*KEYS, *[cols[f].alias(f) for f in ANOMALY_FEATURES])


def risk_features(sessions: DataFrame) -> DataFrame:
    """30 facts; certificate days are clamped to 0..400, 400 unseen, 0 when seen without a day count."""
    c = F.col
    seen = F.coalesce(c("cert_seen"), F.lit(False))
    days = F.when(~seen, F.lit(400.0)).when(c("cert_days_to_expiry").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0), F.least(c("cert_days_to_expiry"), F.lit(400))).cast("double"))
    weak = F.size(F.filter("weaknesses", lambda w: w != F.lit(dims.NO_FORWARD_SECRECY_NOTE)))
    cols = {
        **_common(),
        "implicit_tls_port": flag(c("server_port").isin(*dims.IMPLICIT_TLS_PORTS)),
        "cipher_key_bits": F.coalesce(c("key_size").cast("double"), F.lit(0.0)),
        "cipher_weakness_count": F.when(c("weaknesses").isNotNull(), weak.cast("double")).otherwise(F.lit(0.0)),
        "pqc_selected": flag(c("pqc_selected")),
        "upgrade_rejected": flag((c("encryption_state") == "PLAINTEXT_AFTER_FAILURE") | c("at_rejected").isNotNull()),
        "cert_observable": flag(seen),
        "cert_days_to_expiry": days,
        "cert_key_bits": F.when(seen, F.coalesce(c("cert_key_bits").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)),
        "cert_hostname_mismatch": flag(c("cert_hostname_match").eqNullSafe(F.lit(False))),
    }
    for f in ("cert_expired", "cert_not_yet_valid", "cert_weak_key", "cert_broken_signature", "cert_self_signed", "cert_chain_incomplete", "cert_chain_invalid"):
        cols[f] = flag(c(f))
    return sessions.select(*KEYS, *[cols[f].alias(f) for f in RISK_FEATURES])


def client_features(facts: DataFrame) -> DataFrame:
    """15 facts of a ClientHello from the handshake facts (`versions_offered`, `groups_offered`, `ja4`)."""
    parts = crypto.ja4_parts(F.col("ja4"))
    groups = F.transform("groups_offered", F.lower)
    ranks = F.transform("versions_offered", lambda v: dims.lookup(v, dims.VERSION_RANK, 0))
    cols = {
        "max_version": F.coalesce(F.array_max(ranks), F.lit(0)).cast("double"),
        "versions": F.size("versions_offered").cast("double"),
        "ciphers": parts["ciphers"].cast("double"),
        "extensions": parts["extensions"].cast("double"),
        "groups": F.size("groups_offered").cast("double"),
        "offers_pqc": flag(F.col("pqc_offered")),
        "sni": flag(parts["sni"]),
        "alpn": flag(parts["alpn"]),
        **{f"group_{g}": flag(F.array_contains(groups, g)) for g in CLIENT_GROUPS},
    }
    return facts.where(F.col("ja4").isNotNull()).select(*KEYS, "ja4", *[cols[f].alias(f) for f in CLIENT_FEATURES])


def drop_constant(df: DataFrame, columns: list[str], floor: float = 1e-9) -> list[str]:
    """Columns whose population variance exceeds `floor`: one aggregate row comes to the driver."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > floor]


def variances(df: DataFrame, columns: list[str], floor: float = 1e-9) -> DataFrame:
    agg = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])
    return agg.select(F.explode(rows).alias("r")).select("r.feature", "r.variance", (F.col("r.variance") > floor).alias("kept"))


def analyst_label() -> Column:
    """Severity 0..4 an analyst gives the true configuration of a session."""
    c = F.col
    open_risk = F.when(c("upgrade_advertised_mangled") | (c("encryption_state") == "PLAINTEXT_AFTER_FAILURE") | c("cleartext_auth"), 4).otherwise(3)
    version = F.when(c("tls_version").isin("TLS 1.0", "TLS 1.1"), 3).when(c("tls_version") == "TLS 1.2", 1).otherwise(0)
    broken = c("cipher_suite").contains("3DES") | c("cipher_suite").contains("RC4")
    cipher = F.when(c("key_exchange").eqNullSafe("RSA") | F.coalesce(broken, F.lit(False)), 3).when(F.coalesce(c("cipher_suite").contains("CBC"), F.lit(False)), 2).otherwise(0)
    cert = F.greatest(
        *[
            F.when(F.coalesce(cond, F.lit(False)), F.lit(dims.CERT_RISK[k])).otherwise(F.lit(0))
            for k, cond in [
                ("expired", c("cert_expired")),
                ("not_yet_valid", c("cert_not_yet_valid")),
                ("expiring_soon", c("cert_expiring_soon")),
                ("self_signed", c("cert_self_signed")),
                ("wrong_host", c("cert_hostname_match").eqNullSafe(F.lit(False))),
                ("weak_key", c("cert_weak_key")),
                ("sha1_signed", c("cert_broken_signature")),
            ]
        ]
    )
    return F.when(~c("tls_established"), open_risk).otherwise(F.greatest(version, cipher, cert))
