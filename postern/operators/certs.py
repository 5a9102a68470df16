"""Certificate checks against capture time, chain links, trust anchors and the per-session verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import server_key

SESSION = ["capture_id", "session_id"]
DAY = 86400


def validity(certs: DataFrame) -> DataFrame:
    """Flags of each certificate at `capture_ts` (all times are epoch seconds, days are whole 86,400 s)."""
    t, nb, na = F.col("capture_ts"), F.col("not_before"), F.col("not_after")
    expired, early = t > na, (t <= na) & (t < nb)
    left = F.floor((na - t) / DAY)
    days = F.when(~expired & ~early, left).cast("int")
    return certs.withColumns(
        {
            "cert_expired": expired,
            "cert_not_yet_valid": early,
            "cert_days_to_expiry": days,
            "cert_expiring_soon": F.coalesce(days <= dims.EXPIRY_WARNING_DAYS, F.lit(False)),
        }
    )


def _clean(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.+$", "")


def _dots(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def name_matches(host: Column, pattern: Column) -> Column:
    """Exact match, or one leftmost wildcard label."""
    h, p = _clean(host), _clean(pattern)
    suffix = F.substr(p, F.lit(2))
    wildcard = p.startswith("*.") & F.endswith(h, suffix) & (_dots(h) == _dots(p))
    return (h == p) | wildcard


def hostname_match(host: Column, san: Column, common_name: Column) -> Column:
    """NULL without a host to check; alternative names first, the common name only when there are none."""
    names = F.when(F.size(san) > 0, san).otherwise(F.array_compact(F.array(common_name)))
    return F.when(host.isNotNull(), F.exists(names, lambda n: name_matches(host, n)))


def weak_key(alg: Column, bits: Column) -> Column:
    return F.coalesce((bits > 0) & (bits < dims.lookup(alg, dims.MIN_KEY_BITS)), F.lit(False))


def broken_hash(sig_alg: Column) -> Column:
    """First broken hash named by the signature algorithm, NULL when none is."""
    low = F.lower(sig_alg)
    out = None
    for token in dims.BROKEN_HASHES:
        cond = F.contains(low, F.lit(token))
        out = F.when(cond, F.lit(token)) if out is None else out.when(cond, F.lit(token))
    return out


def chain_shape(certs: DataFrame) -> DataFrame:
    """Self-signed or incomplete, which exclude each other, and the chain length per session."""
    leaf_self = F.max(F.when(F.col("idx") == 0, F.col("subject") == F.col("issuer")))
    agg = certs.groupBy(*SESSION).agg(F.count(F.lit(1)).cast("int").alias("chain_length"), leaf_self.alias("cert_self_signed"))
    return agg.withColumn("cert_chain_incomplete", ~F.col("cert_self_signed") & (F.col("chain_length") == 1))


def chain_links(certs: DataFrame) -> DataFrame:
    """One row per link of a presented chain.

    The issuer of certificate i is certificate i+1 of the same session: an equi-join on (session, index).
    The signature check itself is an input bit (`link_verified` of the issuer row).
    """
    parent = certs.select(
        *SESSION,
        (F.col("idx") - 1).alias("idx"),
        F.col("subject").alias("p_subject"),
        F.col("is_ca").alias("p_is_ca"),
        F.col("not_before").alias("p_nb"),
        F.col("not_after").alias("p_na"),
        F.col("link_verified").alias("p_verified"),
    ).where(F.col("idx") >= 0)
    rows = certs.join(parent, [*SESSION, "idx"])
    named = F.col("issuer") == F.col("p_subject")
    holds = named & F.coalesce("p_verified", F.lit(False))
    in_time = F.col("capture_ts").between(F.col("p_nb"), F.col("p_na"))
    ok = holds & F.col("p_is_ca")
    problems = F.array_compact(
        F.array(
            F.when(~named, F.lit("issuer_name")),
            F.when(named & ~holds, F.lit("signature")),
            F.when(holds & ~F.col("p_is_ca"), F.lit("issuer_not_ca")),
            F.when(~in_time, F.lit("issuer_validity")),
        )
    )
    status = F.when(~ok, F.lit("invalid")).when(~in_time, F.lit("warning")).otherwise(F.lit("valid"))
    return rows.select(*SESSION, F.col("idx").alias("child"), status.alias("status"), problems.alias("problems"))


def anchors(certs: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Trust verdict per session from the top certificate and the trust store.

    A store root anchors the chain when it names the top's issuer and is the same certificate, or is taken
    to have signed it (`root_verified` on the store row, true by default). The store is joined by subject
    after being reduced to one row per subject and fingerprint.
    """
    top = certs.groupBy(*SESSION).agg(
        F.max_by(F.struct("subject", "issuer", "sha256", "link_verified"), "idx").alias("t")
    ).select(*SESSION, F.col("t.subject").alias("subject"), F.col("t.issuer").alias("issuer"), F.col("t.sha256").alias("sha256"), F.col("t.link_verified").alias("top_verified"))
    verified = F.col("root_verified") if "root_verified" in roots.columns else F.lit(True)
    store = roots.select(F.col("subject").alias("issuer"), F.col("sha256").alias("root_sha256"), "source", "store_order", verified.alias("root_verified"))
    hits = top.join(store, "issuer").where((F.col("root_sha256") == F.col("sha256")) | F.col("root_verified"))
    best = hits.groupBy(*SESSION).agg(
        F.min_by(F.struct("source", (F.col("root_sha256") == F.col("sha256")).alias("presented")), "store_order").alias("a")
    )
    broken = links.groupBy(*SESSION).agg(F.bool_or(F.col("status") == "invalid").alias("broken"))
    rows = top.join(best, SESSION, "left").join(broken, SESSION, "left")
    self_issued = F.col("subject") == F.col("issuer")
    self_broken = F.col("a").isNull() & self_issued & F.coalesce(~F.col("top_verified"), F.lit(False))
    trust = (
        F.when(F.coalesce("broken", F.lit(False)) | self_broken, F.lit("INVALID"))
        .when(F.col("a").isNotNull(), F.lit("TRUSTED"))
        .when(self_issued, F.lit("UNTRUSTED_ANCHOR"))
        .otherwise(F.lit("INCOMPLETE"))
    )
    return rows.select(*SESSION, trust.alias("chain_trust"), F.col("a.source").alias("anchor_source"), F.col("a.presented").alias("anchor_presented"))


def root_stats(roots: DataFrame) -> DataFrame:
    return roots.groupBy("source").agg(F.count(F.lit(1)).alias("roots"))


def verdicts(certs: DataFrame, roots: DataFrame) -> DataFrame:
    """All certificate columns of the session table, one row per session that showed a certificate."""
    leaf = validity(certs.where(F.col("idx") == 0)).withColumns(
        {
            "cert_hostname_match": hostname_match(F.col("hostname"), F.col("san_names"), F.col("subject_cn")),
            "cert_weak_key": weak_key(F.col("key_alg"), F.col("key_bits")),
            "cert_broken_signature": broken_hash(F.col("sig_alg")).isNotNull(),
            "cert_key_alg": F.col("key_alg"),
            "cert_key_bits": F.col("key_bits"),
        }
    )
    columns = [c for c in leaf.columns if c.startswith("cert_")]
    trust = anchors(certs, chain_links(certs), roots)
    return (
        leaf.select(*SESSION, *columns, F.lit(True).alias("cert_seen"))
        .join(chain_shape(certs), SESSION)
        .join(trust, SESSION)
        .withColumn("cert_chain_invalid", F.col("chain_trust") == "INVALID")
    )


def attach(sessions: DataFrame, verdict: DataFrame) -> DataFrame:
    """Session rows with their certificate columns; sessions that showed none keep FALSE flags and NULL facts."""
    keep = [c for c in sessions.columns if c in SESSION or c not in verdict.columns]
    out = sessions.select(*keep).join(verdict, SESSION, "left")
    flags = ["cert_seen", "cert_expired", "cert_not_yet_valid", "cert_expiring_soon", "cert_weak_key", "cert_broken_signature", "cert_self_signed", "cert_chain_incomplete", "cert_chain_invalid"]
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags if f in out.columns})


def leaf_table(sessions: DataFrame) -> DataFrame:
    """Observed leaf certificates with the labels of their issues."""
    # Issue labels in report order
    labels = [
        ("cert_expired", "expired"),
        ("cert_not_yet_valid", "not yet valid"),
        ("cert_expiring_soon", "expiring soon"),
        ("cert_weak_key", "weak key"),
        ("cert_broken_signature", "weak signature hash"),
        ("cert_self_signed", "self-signed"),
        ("cert_chain_incomplete", "incomplete chain"),
        ("cert_chain_invalid", "chain signature invalid"),
    ]
    issues = [F.when(F.col(k), F.lit(v)) for k, v in labels]
    issues.append(F.when(F.col("cert_hostname_match").eqNullSafe(F.lit(False)), F.lit("hostname mismatch")))
    return sessions.where(F.col("cert_seen")).select(
        *SESSION, server_key().alias("server"), F.concat_ws(" ", "cert_key_alg", "cert_key_bits").alias("key"), "cert_days_to_expiry", F.array_compact(F.array(*issues)).alias("issues")
    )
