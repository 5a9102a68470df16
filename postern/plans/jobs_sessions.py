"""Queries over the session view: baselines, rules, posture, readiness, funnel, drift, graph, ranking, listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.functions.scores import server_key, text
from postern.operators import baseline, browse, drift, funnel, grading, graph, posture, ranking, readiness, rules, sessions
from postern.plans import report
from postern.plans.catalog import query
from postern.plans.oracle_parts import radius_sql, sql
from postern.plans.views import load, view
from postern.session import stage


def sess(spark, sf):
    return view(spark, sf, "sess")


def facts(spark, sf):
    return crypto.decorate(sess(spark, sf))


def stored(spark, sf):
    """The session table written once, as it is in production, for jobs that read it in several branches."""
    return stage(facts(spark, sf))


def found(spark, sf):
    return rules.findings(stored(spark, sf))


def staged_findings(f):
    """Numbered findings, written once because several branches of the plan read them."""
    return stage(rules.number(rules.findings(f)))


# ---- crypto facts on sessions -------------------------------------------------------------
@query(
    "suite_facts",
    "C-1",
    sql(["f"], "SELECT capture_id, session_id, cipher_suite, key_exchange, authentication, encryption, key_size, mode, mac_hash, forward_secrecy, aead, weaknesses FROM f"),
)
def suite_facts(spark, sf):
    return facts(spark, sf).select("capture_id", "session_id", "cipher_suite", *crypto.SUITE_FACTS[:-1], text("weaknesses").alias("weaknesses"))


@query(
    "group_facts",
    "C-2",
    sql(
        ["sess"],
        """SELECT capture_id, key_group, CASE key_group WHEN 'X25519MLKEM768' THEN 4588 WHEN 'x25519' THEN 29 END AS group_code, key_group = 'X25519MLKEM768' AS pqc, false AS weak, count(*) AS sessions
FROM sess WHERE key_group IS NOT NULL GROUP BY ALL""",
    ),
)
def group_facts(spark, sf):
    counts = sess(spark, sf).where(F.col("key_group").isNotNull()).groupBy("capture_id", "key_group").agg(F.count(F.lit(1)).alias("sessions"))
    return counts.join(F.broadcast(dims.groups(spark)), "key_group").select("capture_id", "key_group", "group_code", "pqc", "weak", "sessions")


@query(
    "certificate_unobservable_reason",
    "C-7",
    sql(
        ["sess"],
        """SELECT capture_id, session_id, CASE WHEN tls_version = 'TLS 1.3' THEN 'encrypted_in_tls13' ELSE 'no_certificate_message' END AS reason
FROM sess WHERE tls_version IS NOT NULL AND NOT cert_observable
UNION ALL SELECT capture_id, session_id, 'no_server_hello' FROM sess WHERE encryption_state = 'STARTTLS_NEGOTIATION_FAILED' AND h2 % 3 = 2""",
    ),
)
def certificate_unobservable_reason(spark, sf):
    rows = sess(spark, sf).where(F.col("tls_version").isNotNull() | (F.col("at_client_hello").isNotNull() & F.col("at_server_hello").isNull()))
    return rows.select("capture_id", "session_id", sessions.cert_reason().alias("reason")).where(F.col("reason").isNotNull())


# ---- session assembly -----------------------------------------------------------------------
@query(
    "session_refs",
    "D-12",
    sql(["sess"], "SELECT capture_id, session_id, protocol || '-' || lpad(CAST(row_number() OVER (PARTITION BY capture_id, protocol ORDER BY first_frame) AS VARCHAR), 4, '0') AS ref FROM sess"),
)
def session_refs(spark, sf):
    return sessions.assign_refs(sess(spark, sf)).select("capture_id", "session_id", "ref")


@query(
    "run_summary",
    "D-13",
    sql(
        ["sess", "fnd"],
        """SELECT capture_id, 'protocol' AS counter, protocol AS value, count(*) AS n FROM sess GROUP BY ALL UNION ALL SELECT capture_id, 'state', encryption_state, count(*) FROM sess GROUP BY ALL
UNION ALL SELECT capture_id, 'severity', severity, count(*) FROM fnd GROUP BY ALL UNION ALL SELECT capture_id, 'category', category, count(*) FROM fnd GROUP BY ALL""",
    ),
)
def run_summary(spark, sf):
    return sessions.summary(sess(spark, sf), found(spark, sf))


@query(
    "upgrade_narrative",
    "D-14",
    sql(
        ["sess"],
        """SELECT capture_id, session_id, CASE encryption_state WHEN 'IMPLICIT_TLS' THEN 'implicit' WHEN 'TRUNCATED' THEN 'unseen' WHEN 'STARTTLS_NOT_ADVERTISED' THEN CASE WHEN h2 % 2 = 0 THEN 'offer_damaged>clear' ELSE 'no_offer>clear' END
 WHEN 'STARTTLS_ADVERTISED_NOT_USED' THEN 'offered>clear' WHEN 'PLAINTEXT_AFTER_FAILURE' THEN 'offered>asked>refused>clear' WHEN 'STARTTLS_REJECTED' THEN 'offered>asked>refused' WHEN 'STARTTLS_NEGOTIATION_FAILED' THEN 'offered>asked>broken_off'
 WHEN 'TLS_ESTABLISHED' THEN 'offered>asked>secured' WHEN 'PLAINTEXT_THROUGHOUT' THEN 'no_offer' END AS summary FROM sess""",
    ),
)
def upgrade_narrative(spark, sf):
    return sess(spark, sf).select("capture_id", "session_id", sessions.upgrade_summary().alias("summary"))


# ---- baselines ---------------------------------------------------------------------------------
@query(
    "server_profile",
    "B-1",
    sql(["prof"], "SELECT capture_id, server_ip, server_port, dim, value, cnt, ff AS first_seen, round(share, 6) AS share FROM prof"),
)
def server_profile(spark, sf):
    prof = baseline.profile(baseline.population(sess(spark, sf)), baseline.SERVER, dims.BASELINE_DIMS, "first_frame")
    return prof.withColumn("share", F.round("share", 6))


@query(
    "supplier_profile",
    "B-1",
    """SELECT l_suppkey, dim, value, count(*) AS cnt, min(l_partkey) AS first_seen, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_suppkey, dim), 6) AS share
FROM (SELECT l_suppkey, l_partkey, 'l_returnflag' AS dim, l_returnflag AS value FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, 'l_linestatus', l_linestatus FROM lineitem) u GROUP BY l_suppkey, dim, value""",
)
def supplier_profile(spark, sf):
    prof = baseline.profile(load(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"], "l_partkey")
    return prof.withColumn("share", F.round("share", 6))


@query(
    "expected_behaviour",
    "B-2 B-3",
    sql(["expd", "srvn"], "SELECT capture_id, server_ip, server_port, dim, value, round(share, 6) AS share, n >= 4 AS has_baseline FROM expd JOIN srvn USING (capture_id, server_ip, server_port)"),
)
def expected_behaviour(spark, sf):
    base = baseline.population(sess(spark, sf))
    dom = baseline.dominant_values(baseline.profile(base, baseline.SERVER, dims.BASELINE_DIMS, "first_frame"), baseline.SERVER)
    sizes = base.groupBy(*baseline.SERVER).agg((F.count(F.lit(1)) >= dims.MIN_BASELINE_SESSIONS).alias("has_baseline"))
    return dom.join(sizes, baseline.SERVER).select(*baseline.SERVER, "dim", "value", F.round("share", 6).alias("share"), "has_baseline")


@query(
    "baseline_deviations",
    "B-4",
    sql(["devs"], "SELECT capture_id, session_id, dim AS dimension, expected, round(share, 3) AS expected_share, observed FROM devs"),
)
def baseline_deviations(spark, sf):
    rows = baseline.with_deviations(baseline.population(sess(spark, sf)))
    return rows.select("capture_id", "session_id", F.explode("deviations").alias("d")).select(
        "capture_id", "session_id", "d.dimension", "d.expected", F.round("d.expected_share", 3).alias("expected_share"), "d.observed"
    )


@query(
    "deviation_scores",
    "B-5",
    sql(
        ["f", "devs"],
        """SELECT f.capture_id, f.session_id, coalesce(d.n, 0) AS deviations, CASE WHEN d.s IS NULL THEN 0::DOUBLE ELSE round_even(least(d.s / 5, 1), 3) END AS deviation_score FROM f
LEFT JOIN (SELECT capture_id, session_id, count(*) AS n, sum(share) AS s FROM devs GROUP BY 1, 2) d USING (capture_id, session_id) WHERE NOT f.is_indeterminate""",
    ),
)
def deviation_scores(spark, sf):
    rows = baseline.with_deviations(baseline.population(sess(spark, sf)))
    return rows.select("capture_id", "session_id", F.size("deviations").alias("deviations"), "deviation_score")


@query(
    "server_statistics",
    "B-6",
    sql(
        ["f"],
        """SELECT capture_id, server_ip, server_port, count(*) AS sessions, count(*) FILTER (protocol = 'SMTP') AS smtp_sessions, count(*) FILTER (protocol = 'IMAP') AS imap_sessions,
 count(*) FILTER (protocol = 'POP3') AS pop3_sessions, arg_min(server_banner, first_frame) FILTER (server_banner IS NOT NULL) AS banner, round_even(median(handshake_ms), 2) AS median_handshake_ms
FROM f WHERE NOT is_indeterminate GROUP BY 1, 2, 3""",
    ),
)
def server_statistics(spark, sf):
    return baseline.server_stats(sess(spark, sf))


@query(
    "server_software",
    "B-7",
    sql(
        ["sess"],
        """, sw AS (SELECT capture_id, server_ip, server_port, first_frame, protocol, CASE WHEN server_banner ILIKE '%Microsoft ESMTP%' THEN 'exchange' WHEN server_banner ILIKE '%Postfix%' THEN 'postfix'
 WHEN server_banner ILIKE '%Exim%' THEN 'exim' WHEN server_banner ILIKE '%Dovecot%' THEN 'dovecot' WHEN protocol = 'SMTP' THEN 'generic_smtp' ELSE 'generic_mailbox' END AS software,
 CASE WHEN server_banner ILIKE '%Postfix%' THEN nullif(regexp_extract(server_banner, 'Postfix (\\d+\\.\\d+\\.\\d+)', 1), '') WHEN server_banner ILIKE '%Exim%' THEN '4.96' END AS version,
 coalesce(sni, CASE WHEN string_split(server_banner, ' ')[1] LIKE '%.%' THEN string_split(server_banner, ' ')[1] END, server_ip) AS hostname FROM sess),
 top AS (SELECT capture_id, server_ip, server_port, dim, value FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, server_ip, server_port, dim ORDER BY n DESC, ff) AS rn FROM (
   SELECT capture_id, server_ip, server_port, dim, value, count(*) AS n, min(first_frame) AS ff FROM (SELECT capture_id, server_ip, server_port, first_frame, 'software' AS dim, software AS value FROM sw
    UNION ALL SELECT capture_id, server_ip, server_port, first_frame, 'hostname', hostname FROM sw UNION ALL SELECT capture_id, server_ip, server_port, first_frame, 'protocol', protocol FROM sw) a GROUP BY ALL) b) c WHERE rn = 1)
SELECT t.capture_id, t.server_ip, t.server_port, any_value(CASE dim WHEN 'software' THEN value END) AS software, any_value(CASE dim WHEN 'hostname' THEN value END) AS hostname, any_value(CASE dim WHEN 'protocol' THEN value END) AS protocol,
 (SELECT arg_min_null(version, first_frame) FROM sw WHERE sw.capture_id = t.capture_id AND sw.server_ip = t.server_ip AND sw.server_port = t.server_port AND sw.software = any_value(CASE t.dim WHEN 'software' THEN t.value END)) AS version
FROM top t GROUP BY 1, 2, 3""".replace("SELECT t.capture_id", "SELECT t.capture_id", 1),
    ).replace(" , sw AS", ", sw AS"),
)
def server_software(spark, sf):
    return baseline.software_by_server(sess(spark, sf))


# ---- rules -----------------------------------------------------------------------------------------
@query(
    "rule_findings",
    "U-1 U-2 U-3 U-4 U-5 U-6 IO-7",
    sql(["fnd"], "SELECT capture_id, session_id, server, category, verdict, severity, severity_rank, confidence, lo AS finding_frame, hi AS finding_last_frame, affected AS affected_sessions FROM fnd"),
)
def rule_findings(spark, sf):
    return found(spark, sf).select(
        "capture_id", "session_id", "server", "category", "verdict", "severity", "severity_rank", "confidence", "finding_frame", "finding_last_frame", "affected_sessions"
    )


@query(
    "certificate_findings",
    "U-5",
    sql(["fnd"], "SELECT capture_id, session_id, category, severity, lo AS finding_frame FROM fnd WHERE category LIKE 'certificate%' AND category <> 'certificate_not_observable'"),
)
def certificate_findings(spark, sf):
    out = rules.resolve(rules.session_drafts(facts(spark, sf), rules.cert_rules()))
    return out.select("capture_id", "session_id", "category", "severity", "finding_frame")


@query("finding_numbers", "U-7", sql(["fno"], "SELECT capture_id, session_id, category, 'F-' || lpad(CAST(finding_no AS VARCHAR), 4, '0') AS finding_ref FROM fno"))
def finding_numbers(spark, sf):
    return rules.number(found(spark, sf)).select("capture_id", "session_id", "category", "finding_ref")


@query(
    "starttls_stripping",
    "U-8",
    sql(["strip"], "SELECT capture_id, session_id, server, scope AS baseline_scope, affected AS affected_sessions, CASE scope WHEN 'server_port' THEN 0.9::DOUBLE WHEN 'host' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM strip"),
)
def starttls_stripping(spark, sf):
    out = rules.stripping_drafts(sess(spark, sf))
    return out.select("capture_id", "session_id", "server", "baseline_scope", "affected_sessions", F.col("confidence_override").alias("confidence"))


@query(
    "host_profiles",
    "U-9",
    sql(["hosts"], "SELECT capture_id, server_ip, h_adv AS host_advertised, h_man AS host_mangled, h_sil AS host_silent, h_ratio AS host_ratio, coalesce(ports, '') AS ports FROM hosts"),
)
def host_profiles(spark, sf):
    return rules.host_profiles(rules.capability_profiles(sess(spark, sf))).withColumn("ports", text("ports"))


@query(
    "capability_profiles",
    "U-10",
    sql(["caps"], "SELECT *, round(advertised::DOUBLE / total, 6) AS advertise_ratio FROM caps"),
)
def capability_profiles(spark, sf):
    return rules.capability_profiles(sess(spark, sf)).withColumn("advertise_ratio", F.round("advertise_ratio", 6))


@query("pqc_gap", "U-11", sql(["pqcgap"], "SELECT capture_id, session_id, affected AS affected_sessions, ff AS finding_frame FROM pqcgap"))
def pqc_gap(spark, sf):
    return rules.pqc_gap_drafts(sess(spark, sf)).select("capture_id", "session_id", "affected_sessions", F.get("frames", F.lit(0)).alias("finding_frame"))


# ---- posture -----------------------------------------------------------------------------------------
_DIMS = "SELECT capture_id, dimension, score, assessed, total, round_even(100.0::DOUBLE * assessed / nullif(total, 0), 1) AS coverage_pct FROM dimsc WHERE dimension IN "


@query("transport_score", "P-1", sql(["dimsc"], _DIMS + "('transport')"))
def transport_score(spark, sf):
    return posture.dimension_scores(facts(spark, sf)).where(F.col("dimension") == "transport")


@query("handshake_scores", "P-2 P-3 P-4", sql(["dimsc"], _DIMS + "('tls_version','crypto','pfs')"))
def handshake_scores(spark, sf):
    return posture.dimension_scores(facts(spark, sf)).where(F.col("dimension").isin("tls_version", "crypto", "pfs"))


@query("certificate_score", "P-5", sql(["dimsc"], _DIMS + "('certificate')"))
def certificate_score(spark, sf):
    return posture.dimension_scores(facts(spark, sf)).where(F.col("dimension") == "certificate")


@query("behaviour_score", "P-6", sql(["dimsc"], _DIMS + "('behaviour')"))
def behaviour_score(spark, sf):
    return posture.dimension_scores(facts(spark, sf)).where(F.col("dimension") == "behaviour")


@query("capped_dimensions", "P-7", sql(["capped"], "SELECT capture_id, dimension, uncapped, score, ceiling FROM capped"))
def capped_dimensions(spark, sf):
    f = stored(spark, sf)
    return posture.apply_ceilings(posture.dimension_scores(f), rules.findings(f)).select("capture_id", "dimension", "uncapped", "score", "ceiling")


@query("posture_overall", "P-8", sql(["post"], "SELECT capture_id, overall, round(numerator, 6) AS numerator, assessed_weight, dimensions_assessed, excluded FROM post"))
def posture_overall(spark, sf):
    f = stored(spark, sf)
    return posture.posture(f, rules.findings(f)).withColumn("numerator", F.round("numerator", 6)).withColumn("excluded", text("excluded"))


@query(
    "crypto_inventory",
    "P-9",
    sql(
        ["f"],
        """SELECT capture_id, kind, name, count(*) AS sessions, CASE WHEN kind = 'suite' THEN 'ae' WHEN name = 'X25519MLKEM768' THEN 'kem' WHEN kind IN ('group','kex') THEN 'key-agree' WHEN kind = 'auth' THEN 'signature' END AS primitive
FROM (SELECT capture_id, 'suite' AS kind, cipher_suite AS name FROM f UNION ALL SELECT capture_id, 'group', key_group FROM f UNION ALL SELECT capture_id, 'kex', key_exchange FROM f
 UNION ALL SELECT capture_id, 'auth', authentication FROM f UNION ALL SELECT capture_id, 'version', tls_version FROM f) u WHERE name IS NOT NULL GROUP BY ALL""",
    ),
)
def crypto_inventory(spark, sf):
    return readiness.inventory(facts(spark, sf)).select("capture_id", "kind", "name", "sessions", "primitive")


@query(
    "crypto_bom",
    "IO-11",
    sql(
        ["f"],
        """SELECT capture_id, count(tls_version) AS tls_sessions, count(DISTINCT cipher_suite) + count(DISTINCT key_group) + count(DISTINCT key_exchange) + count(DISTINCT authentication) AS component_count,
 count(DISTINCT cipher_suite) + count(DISTINCT key_group) + count(DISTINCT key_exchange) + count(DISTINCT authentication) AS listed FROM f WHERE tls_version IS NOT NULL GROUP BY 1""",
    ),
)
def crypto_bom(spark, sf):
    docs = readiness.cbom(facts(spark, sf), "00000000-0000-0000-0000-000000000000", "2026-03-02T09:15:00Z")
    listed = F.json_array_length(F.get_json_object("document", "$.components")).cast("bigint").alias("listed")
    return docs.select("capture_id", "tls_sessions", F.col("component_count").cast("bigint").alias("component_count"), listed)


@query("exposure_tiers", "P-10", sql(["tiers"], "SELECT capture_id, session_id, tier FROM tiers"))
def exposure_tiers(spark, sf):
    return baseline.population(facts(spark, sf)).select("capture_id", "session_id", readiness.tier().alias("tier"))


@query(
    "pqc_readiness",
    "P-11",
    sql(
        ["ready"],
        """SELECT capture_id, c1 AS c_pqc_key_exchange, c2 AS c_tls13, c3 AS c_client_capability, c4 AS c_forward_secrecy, c5 AS c_encrypted, score,
CASE WHEN score >= 75 THEN 'ready' WHEN score >= 50 THEN 'transitioning' WHEN score >= 25 THEN 'early' WHEN score >= 0 THEN 'not_started' END AS level, hndl_sessions, round_even(100.0::DOUBLE * hndl_sessions / n_email, 1) AS hndl_pct FROM ready""",
    ),
)
def pqc_readiness(spark, sf):
    comps = [f"c_{n}" for n in dims.READINESS_WEIGHTS]
    return readiness.readiness(facts(spark, sf)).select("capture_id", *comps, "score", "level", "hndl_sessions", "hndl_pct")


@query(
    "exposure_distribution",
    "P-12",
    sql(
        ["tiers"],
        """SELECT c.capture_id, t.tier, count(x.tier) AS sessions, round_even(100.0::DOUBLE * count(x.tier) / any_value(c.n), 1) AS pct FROM (SELECT capture_id, count(*) AS n FROM tiers GROUP BY 1) c
CROSS JOIN (VALUES ('cleartext'),('static_rsa'),('classical'),('pqc_hybrid')) t(tier) LEFT JOIN tiers x ON x.capture_id = c.capture_id AND x.tier = t.tier GROUP BY 1, 2""",
    ),
)
def exposure_distribution(spark, sf):
    return readiness.exposure(facts(spark, sf))


@query(
    "server_readiness",
    "P-13",
    sql(
        ["tiers"],
        """SELECT t.capture_id, t.server_ip, t.server_port, count(*) AS sessions, arg_min(tier, CASE tier WHEN 'cleartext' THEN 0 WHEN 'static_rsa' THEN 1 WHEN 'classical' THEN 2 WHEN 'pqc_hybrid' THEN 3 END) AS worst_tier,
 count(*) FILTER (pqc_selected) AS pqc_selected, count(*) FILTER (pqc_offered) AS clients_offering_pqc, count(*) FILTER (tls_version = 'TLS 1.3') AS tls13, any_value(g.key_group) AS dominant_group,
 count(*) FILTER (pqc_offered) > 0 AND count(*) FILTER (pqc_selected) = 0 AS migration_gap FROM tiers t
LEFT JOIN (SELECT capture_id, server_ip, server_port, key_group FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, server_ip, server_port ORDER BY n DESC, ff) AS rn FROM (SELECT capture_id, server_ip, server_port, key_group, count(*) AS n, min(first_frame) AS ff FROM tiers WHERE key_group IS NOT NULL GROUP BY ALL) a) b WHERE rn = 1) g USING (capture_id, server_ip, server_port) GROUP BY 1, 2, 3""",
    ),
)
def server_readiness(spark, sf):
    return readiness.server_readiness(facts(spark, sf))


@query(
    "group_usage",
    "P-14",
    sql(
        ["sess", "hello"],
        """, off AS (SELECT capture_id, g AS code, count(*) AS offered FROM (SELECT capture_id, session_id, unnest(list_distinct(string_split(grps, ','))) AS g FROM hello) u WHERE g <> '2570' GROUP BY 1, 2),
 offn AS (SELECT capture_id, CASE code WHEN '4588' THEN 'X25519MLKEM768' WHEN '29' THEN 'x25519' WHEN '23' THEN 'secp256r1' WHEN '24' THEN 'secp384r1' WHEN '256' THEN 'ffdhe2048' END AS key_group, offered FROM off),
 sel AS (SELECT capture_id, key_group, count(*) AS selected FROM sess WHERE key_group IS NOT NULL GROUP BY 1, 2), tot AS (SELECT capture_id, count(tls_version) AS n FROM sess GROUP BY 1)
SELECT capture_id, key_group, key_group LIKE '%MLKEM%' AS pqc, coalesce(offered, 0) AS offered, round_even(100.0::DOUBLE * coalesce(offered, 0) / n, 1) AS offered_pct, coalesce(selected, 0) AS selected, round_even(100.0::DOUBLE * coalesce(selected, 0) / n, 1) AS selected_pct
FROM offn FULL JOIN sel USING (capture_id, key_group) JOIN tot USING (capture_id)""",
    ).replace(" , off AS", ", off AS"),
)
def group_usage(spark, sf):
    codes = F.transform(F.split("grps", ","), lambda x: x.cast("int"))
    offers = view(spark, sf, "hello").select("capture_id", F.transform(crypto.drop_grease(codes), crypto.group_name).alias("groups_offered"))
    return readiness.group_usage(sess(spark, sf), offers)


@query(
    "migration_actions",
    "P-15",
    sql(
        ["tiers"],
        """, c AS (SELECT capture_id, count(*) FILTER (tier = 'cleartext') AS a1, count(*) FILTER (tier = 'static_rsa') AS a2, count(tls_version) - count(*) FILTER (tls_version = 'TLS 1.3') AS a3,
  count(tls_version) - count(*) FILTER (pqc_selected) AS a5 FROM tiers GROUP BY 1), g AS (SELECT capture_id, count(*) FILTER (o > 0 AND s = 0) AS a4 FROM (SELECT capture_id, server, count(*) FILTER (pqc_offered) AS o, count(*) FILTER (pqc_selected) AS s FROM tiers GROUP BY 1, 2) x GROUP BY 1)
SELECT capture_id, 1 AS priority, 'Encrypt the cleartext sessions first' AS title, a1 AS affected FROM c WHERE a1 > 0 UNION ALL SELECT capture_id, 2, 'Remove static RSA key exchange', a2 FROM c WHERE a2 > 0
UNION ALL SELECT capture_id, 3, 'Move remaining servers to TLS 1.3', a3 FROM c WHERE a3 > 0 UNION ALL SELECT capture_id, 4, 'Enable X25519MLKEM768 on servers where clients are ready', a4 FROM g WHERE a4 > 0
UNION ALL SELECT capture_id, 5, 'Enable hybrid PQC key exchange', a5 FROM c JOIN g USING (capture_id) WHERE a5 > 0 AND a4 = 0""",
    ).replace(" , c AS", ", c AS"),
)
def migration_actions(spark, sf):
    return readiness.actions(facts(spark, sf))


@query(
    "overview",
    "P-16",
    sql(
        ["f", "fnd"],
        """SELECT f.capture_id, count(*) AS sessions, count(*) FILTER (is_prot) AS protected, count(*) FILTER (is_clear) AS cleartext, count(*) FILTER (is_indeterminate) AS indeterminate, count(tls_version) AS tls_sessions,
 count(*) FILTER (tls_version IS NOT NULL AND forward_secrecy) AS forward_secrecy, count(*) FILTER (pqc_offered) AS pqc_offered, count(*) FILTER (pqc_selected) AS pqc_selected, count(*) FILTER (cert_observable) AS cert_observable,
 count(*) FILTER (session_complete) AS complete, any_value(n.findings) AS findings, any_value(n.c) AS critical_findings, any_value(n.h) AS high_findings, any_value(n.m) AS medium_findings, any_value(n.l) AS low_findings, any_value(n.i) AS info_findings,
 any_value(n.u) AS unknown_verdicts, round_even(100.0::DOUBLE * count(*) FILTER (cert_observable) / nullif(count(tls_version), 0), 1) AS certificate_coverage_pct, round_even(100.0::DOUBLE * count(*) FILTER (session_complete) / count(*), 1) AS session_coverage_pct
FROM f LEFT JOIN (SELECT capture_id, count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l,
 count(*) FILTER (severity = 'INFO') AS i, count(*) FILTER (verdict = 'UNKNOWN') AS u FROM fnd GROUP BY 1) n USING (capture_id) GROUP BY 1""",
    ),
)
def overview(spark, sf):
    f = stored(spark, sf)
    return posture.overview(f, rules.findings(f))


@query(
    "suite_table",
    "P-17",
    sql(["f"], "SELECT capture_id, cipher_suite, count(*) AS sessions, string_agg(DISTINCT tls_version, ',' ORDER BY tls_version) AS versions FROM f WHERE cipher_suite IS NOT NULL GROUP BY 1, 2"),
)
def suite_table(spark, sf):
    return posture.tls_stats(facts(spark, sf))[0].withColumn("versions", text("versions"))


@query(
    "tls_group_breakdown",
    "P-17",
    sql(
        ["f"],
        "SELECT capture_id, coalesce(key_group, CASE WHEN forward_secrecy = false THEN 'RSA key transport' ELSE 'not visible' END) AS group_label, count(*) AS sessions FROM f WHERE tls_version IS NOT NULL GROUP BY 1, 2",
    ),
)
def tls_group_breakdown(spark, sf):
    return posture.tls_stats(facts(spark, sf))[1]


@query(
    "estate_counts",
    "P-17",
    sql(["f"], "SELECT capture_id, count(*) AS email_sessions, count(tls_version) AS tls_sessions, count(DISTINCT server) AS servers, count(DISTINCT client_ip) AS clients FROM f GROUP BY 1"),
)
def estate_counts(spark, sf):
    return posture.tls_stats(facts(spark, sf))[2]


# ---- funnel ------------------------------------------------------------------------------------------
_REACHED = "point <> 'unobservable'"


@query(
    "funnel_outcomes",
    "G-1",
    sql(
        ["stg"],
        """SELECT capture_id, session_id, point AS failure_point, point NOT IN ('unobservable','capability_stripped') AND upgrade_advertised AS reached_advertised, depth >= 2 AS reached_requested, depth >= 3 AS reached_accepted, depth >= 4 AS reached_handshake,
 depth >= 5 AS reached_established, fell_back, CASE point WHEN 'unobservable' THEN first_frame WHEN 'capability_stripped' THEN at_mangled WHEN 'not_advertised' THEN at_capability WHEN 'client_skipped' THEN at_advertised
 WHEN 'server_rejected' THEN at_rejected WHEN 'handshake_not_started' THEN at_accepted WHEN 'handshake_failed' THEN at_client_hello WHEN 'no_application_data' THEN at_server_hello ELSE at_app_data END AS evidence_frame FROM stg""",
    ),
)
def funnel_outcomes(spark, sf):
    stages = [f"reached_{s}" for s in dims.FUNNEL_STAGES[1:]]
    return funnel.classify(sess(spark, sf)).select("capture_id", "session_id", "failure_point", *stages, "fell_back", "evidence_frame")


@query(
    "funnel_stages",
    "G-2",
    sql(
        ["stg"],
        """, n AS (SELECT capture_id, stage_no, stage, count(*) FILTER (depth >= stage_no) AS cnt FROM (SELECT * FROM stg WHERE point <> 'unobservable') s CROSS JOIN
 (VALUES (0,'connected'),(1,'advertised'),(2,'requested'),(3,'accepted'),(4,'handshake'),(5,'established')) v(stage_no, stage) GROUP BY ALL)
SELECT capture_id, stage_no, stage, cnt AS count, round_even(100.0::DOUBLE * cnt / first_value(cnt) OVER w, 1) AS pct_of_start, greatest(0, coalesce(lag(cnt) OVER w - cnt, 0)) AS drop_from_previous FROM n WINDOW w AS (PARTITION BY capture_id ORDER BY stage_no)""",
    ).replace(" , n AS", ", n AS"),
)
def funnel_stages(spark, sf):
    return funnel.stages(funnel.classify(sess(spark, sf)))


@query(
    "failure_points",
    "G-3",
    sql(
        ["outc"],
        """, x AS (SELECT *, row_number() OVER (PARTITION BY capture_id, point ORDER BY first_frame) AS rn FROM outc)
SELECT capture_id, point AS failure_point, count(*) AS count, count(DISTINCT server) AS servers, count(*) FILTER (fell_back) AS cleartext_fallbacks, round_even(100.0::DOUBLE * count(*) / any_value(t.n), 1) AS pct,
 CASE point WHEN 'capability_stripped' THEN 'network' WHEN 'not_advertised' THEN 'server' WHEN 'client_skipped' THEN 'client' WHEN 'server_rejected' THEN 'server' WHEN 'handshake_not_started' THEN 'client' WHEN 'handshake_failed' THEN 'both' WHEN 'no_application_data' THEN 'both' END AS owner,
 string_agg(CASE WHEN rn <= 8 THEN CAST(session_id AS VARCHAR) END, ',' ORDER BY first_frame) AS examples
FROM x JOIN (SELECT capture_id, count(*) AS n FROM outc GROUP BY 1) t USING (capture_id) GROUP BY 1, 2""",
    ).replace(" , x AS", ", x AS"),
)
def failure_points(spark, sf):
    out = funnel.failure_points(funnel.classify(sess(spark, sf)))
    return out.select("capture_id", "failure_point", "count", "servers", "cleartext_fallbacks", "pct", "owner", text("examples").alias("examples"))


@query("failure_servers", "G-3", sql(["outc"], "SELECT DISTINCT capture_id, point AS failure_point, server FROM outc"))
def failure_servers(spark, sf):
    return funnel.failure_servers(funnel.classify(sess(spark, sf)))


_ADOPT = """count(*) AS sessions, count(*) FILTER (point <> 'unobservable') AS observable, round_even(100.0::DOUBLE * count(*) FILTER (point = 'success') / nullif(count(*) FILTER (point <> 'unobservable'), 0), 1) AS adoption_pct,
 round_even(100.0::DOUBLE * count(*) FILTER (point <> 'unobservable' AND upgrade_advertised) / nullif(count(*) FILTER (point <> 'unobservable'), 0), 1) AS advertise_pct,
 arg_min(point, r) AS dominant_failure, count(*) FILTER (fell_back) AS cleartext_fallbacks FROM (SELECT *, CASE point WHEN 'capability_stripped' THEN 1 WHEN 'not_advertised' THEN 2 WHEN 'client_skipped' THEN 3
 WHEN 'server_rejected' THEN 4 WHEN 'handshake_not_started' THEN 5 WHEN 'handshake_failed' THEN 6 WHEN 'no_application_data' THEN 7 END AS r FROM outc) o"""


@query("protocol_adoption", "G-4", sql(["outc"], f"SELECT capture_id, protocol, {_ADOPT} GROUP BY 1, 2"))
def protocol_adoption(spark, sf):
    return funnel.adoption(funnel.classify(sess(spark, sf)), ["capture_id", "protocol"])


@query(
    "server_adoption",
    "G-4 G-5",
    sql(
        ["outc", "f"],
        f"""SELECT capture_id, server_ip, server_port, coalesce(sessions, 0) AS sessions, coalesce(observable, 0) AS observable, adoption_pct, advertise_pct, dominant_failure, coalesce(cleartext_fallbacks, 0) AS cleartext_fallbacks, coalesce(i, 0) AS implicit_tls_sessions
FROM (SELECT capture_id, server_ip, server_port, {_ADOPT} GROUP BY 1, 2, 3) a FULL JOIN (SELECT capture_id, server_ip, server_port, count(*) AS i FROM f WHERE encryption_state = 'IMPLICIT_TLS' GROUP BY 1, 2, 3) b USING (capture_id, server_ip, server_port)""",
    ),
)
def server_adoption(spark, sf):
    return funnel.server_adoption(sess(spark, sf))


@query(
    "upgrade_timeline",
    "G-6",
    sql(
        ["outc"],
        """, sp AS (SELECT capture_id, min(start_time) AS t0, max(start_time) AS t1, CASE WHEN max(start_time) > min(start_time) THEN least(12, greatest(1, count(*) // 2)) ELSE 1 END AS b FROM outc GROUP BY 1),
 w AS (SELECT *, CASE WHEN t1 > t0 THEN (t1 - t0) / b ELSE 1.0 END AS wd FROM sp), fr AS (SELECT capture_id, unnest(range(0, b)) AS bucket, wd FROM w),
 h AS (SELECT capture_id, least(CAST(floor((start_time - t0) / wd) AS BIGINT), b - 1) AS bucket, count(*) AS a, count(*) FILTER (point = 'success') AS u, count(*) FILTER (point = 'unobservable') AS x FROM outc JOIN w USING (capture_id) GROUP BY 1, 2)
SELECT capture_id, CAST(bucket AS INT) AS bucket, round(bucket * wd, 6) AS offset_seconds, coalesce(a, 0) AS attempts, coalesce(u, 0) AS upgraded, coalesce(x, 0) AS unobservable, coalesce(a - u - x, 0) AS failed,
 round_even(100.0::DOUBLE * u / nullif(a - x, 0), 1) AS adoption_pct FROM fr LEFT JOIN h USING (capture_id, bucket)""",
    ).replace(" , sp AS", ", sp AS"),
)
def upgrade_timeline(spark, sf):
    return funnel.timeline(funnel.classify(sess(spark, sf))).withColumn("offset_seconds", F.round("offset_seconds", 6))


# ---- drift ----------------------------------------------------------------------------------------------
def captures(spark, sf):
    return sess(spark, sf).groupBy("capture_id").agg(F.max(F.col("capture_id") * F.lit(31557600.0)).alias("observed_at"))


@query("drift_snapshot", "T-1", sql(["mets"], "SELECT * FROM mets"))
def drift_snapshot(spark, sf):
    f = stored(spark, sf)
    return drift.metrics(f, rules.findings(f))


@query("server_snapshot", "T-2", sql(["ssnap"], "SELECT capture_id, server_ip, server_port, attr, value FROM ssnap"))
def server_snapshot(spark, sf):
    snap = drift.server_snapshot(facts(spark, sf))
    rows = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in drift.SERVER_ATTRIBUTES])
    return snap.select(*baseline.SERVER, F.explode(rows).alias("r")).select(*baseline.SERVER, "r.attr", "r.value").where("value IS NOT NULL")


@query("category_snapshot", "T-3", sql(["csnap"], "SELECT capture_id, category, n AS count, severity FROM csnap"))
def category_snapshot(spark, sf):
    return drift.category_snapshot(found(spark, sf))


@query("metric_drift", "T-4", sql(["mcmp"], "SELECT * FROM mcmp"))
def metric_drift(spark, sf):
    f = stored(spark, sf)
    return drift.compare_metrics(stage(drift.metrics(f, rules.findings(f))), drift.capture_pairs(captures(spark, sf)))


@query("server_drift", "T-5", sql(["scmp"], "SELECT * FROM scmp"))
def server_drift(spark, sf):
    out = drift.compare_servers(drift.server_snapshot(facts(spark, sf)), drift.capture_pairs(captures(spark, sf)))
    return out.select("from_capture", "to_capture", "server_ip", "server_port", "status", F.size("changes").cast("bigint").alias("changes"))


@query("server_changes", "T-5", sql(["schg"], "SELECT from_capture, to_capture, server_ip, server_port, attr AS attribute, old, new, direction FROM schg"))
def server_changes(spark, sf):
    out = drift.compare_servers(drift.server_snapshot(facts(spark, sf)), drift.capture_pairs(captures(spark, sf)))
    return out.where("before IS NOT NULL AND after IS NOT NULL").select("from_capture", "to_capture", "server_ip", "server_port", F.explode("changes").alias("c")).select(
        "from_capture", "to_capture", "server_ip", "server_port", "c.attribute", "c.old", "c.new", "c.direction"
    )


@query("finding_drift", "T-6", sql(["ccmp"], "SELECT * FROM ccmp"))
def finding_drift(spark, sf):
    return drift.compare_findings(drift.category_snapshot(found(spark, sf)), drift.capture_pairs(captures(spark, sf)))


@query(
    "drift_timeline",
    "T-7 T-8",
    sql(
        ["mcmp", "schg", "scmp", "ccmp"],
        """, k AS (SELECT p.from_capture, p.to_capture, (SELECT count(*) FROM mcmp m WHERE m.from_capture = p.from_capture AND direction = 'regressed') + (SELECT count(*) FROM schg s WHERE s.from_capture = p.from_capture AND direction = 'regressed') + (SELECT count(*) FROM ccmp c WHERE c.from_capture = p.from_capture AND status IN ('new','worse')) AS regressions,
 (SELECT count(*) FROM mcmp m WHERE m.from_capture = p.from_capture AND direction = 'improved') + (SELECT count(*) FROM schg s WHERE s.from_capture = p.from_capture AND direction = 'improved') + (SELECT count(*) FROM ccmp c WHERE c.from_capture = p.from_capture AND status IN ('resolved','better')) AS improvements,
 (SELECT count(*) FROM schg s WHERE s.from_capture = p.from_capture AND direction = 'changed') AS neutral_changes, (SELECT count(*) FROM scmp s WHERE s.from_capture = p.from_capture AND status NOT IN ('added','removed')) AS servers_compared,
 (SELECT count(*) FROM scmp s WHERE s.from_capture = p.from_capture AND status = 'added') AS servers_added, (SELECT count(*) FROM scmp s WHERE s.from_capture = p.from_capture AND status = 'removed') AS servers_removed FROM pairs p)
SELECT *, CASE WHEN regressions = 0 AND improvements = 0 AND neutral_changes = 0 THEN 'stable' WHEN improvements = 0 AND regressions > 0 THEN 'regressed' WHEN regressions = 0 AND improvements > 0 THEN 'improved' WHEN regressions > 0 THEN 'mixed' ELSE 'changed' END AS verdict FROM k""",
    ).replace(" , k AS", ", k AS"),
)
def drift_timeline(spark, sf):
    f = stored(spark, sf)
    return drift.timeline(f, staged_findings(f), captures(spark, sf))


# ---- graph ----------------------------------------------------------------------------------------------------
@query(
    "client_nodes",
    "H-1",
    sql(
        ["f"],
        """, c AS (SELECT capture_id, client_ip, count(*) AS n, min(first_frame) AS ff, count(*) FILTER (is_clear) AS cl, count(*) FILTER (cleartext_auth) AS cr FROM f GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, ff, client_ip) AS rn FROM c)
SELECT capture_id, 'client:' || CASE WHEN rn <= 150 THEN client_ip ELSE 'other' END AS node_id, CAST(sum(n) AS BIGINT) AS sessions, CAST(sum(cl) AS BIGINT) AS cleartext, CAST(sum(cr) AS BIGINT) AS credentials_exposed, count(*) AS clients FROM r GROUP BY 1, 2""",
    ).replace(" , c AS", ", c AS"),
)
def client_nodes(spark, sf):
    return graph.client_nodes(sess(spark, sf))


@query(
    "top_suppliers_or_other",
    "H-1",
    """WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS n, min(l_partkey) AS ff FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, ff, l_suppkey) AS rn FROM c)
SELECT l_returnflag, CASE WHEN rn <= 20 THEN CAST(l_suppkey AS VARCHAR) ELSE 'other' END AS node, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
)
def top_suppliers_or_other(spark, sf):
    rows = graph.top_or_other(load(spark, sf, "lineitem"), ["l_returnflag"], "l_suppkey", 20, "l_partkey")
    return rows.groupBy("l_returnflag", "node").agg(F.sum("n").alias("n"))


@query(
    "server_nodes",
    "H-2",
    sql(
        ["f"],
        "SELECT capture_id, server, count(*) AS sessions, count(*) FILTER (is_clear) AS cleartext, count(DISTINCT client_ip) AS clients, count(*) FILTER (protocol = 'SMTP') AS smtp, count(*) FILTER (protocol = 'IMAP') AS imap, count(*) FILTER (protocol = 'POP3') AS pop3 FROM f GROUP BY 1, 2",
    ),
)
def server_nodes(spark, sf):
    return graph.server_nodes(sess(spark, sf))


@query("crypto_nodes", "H-3", sql(["crows"], "SELECT capture_id, node_id, count(*) AS sessions, arg_min(risk, first_frame) AS risk FROM crows GROUP BY 1, 2"))
def crypto_nodes(spark, sf):
    return graph.crypto_nodes(facts(spark, sf))


@query(
    "graph_edges",
    "H-4",
    sql(
        ["f", "crows", "scope"],
        """, c AS (SELECT capture_id, client_ip, count(*) AS n, min(first_frame) AS ff FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, ff, client_ip) AS rn FROM c)
SELECT f.capture_id, 'client:' || CASE WHEN rn <= 150 THEN f.client_ip ELSE 'other' END AS source, 'server:' || server AS target, 'connects' AS type, count(*) AS weight, count(*) FILTER (is_clear) AS cleartext FROM f JOIN r USING (capture_id, client_ip) GROUP BY 1, 2, 3
UNION ALL SELECT capture_id, 'server:' || server, node_id, 'negotiates', count(*), NULL FROM crows GROUP BY 1, 2, 3 UNION ALL SELECT capture_id, 'weakness:' || category, 'server:' || server, 'affects', 1, NULL FROM scope""",
    ).replace(" , c AS", ", c AS"),
)
def graph_edges(spark, sf):
    f = stored(spark, sf)
    return graph.edges(f, graph.finding_scope(staged_findings(f), f)).select("capture_id", "source", "target", "type", "weight", "cleartext")


@query("finding_scope", "H-5", sql(["scope"], "SELECT * FROM scope"))
def finding_scope(spark, sf):
    f = stored(spark, sf)
    return graph.finding_scope(staged_findings(f), f)


_SRV_RISK = """SELECT capture_id, server, min(severity_rank) AS risk_rank, string_agg(DISTINCT category, ',' ORDER BY category) AS weaknesses FROM scope JOIN rule USING (category) GROUP BY 1, 2"""


@query("server_risk", "H-6", sql(["scope", "rule"], f"SELECT capture_id, server, ['critical','high','medium','low','info'][risk_rank + 1] AS risk, weaknesses FROM ({_SRV_RISK}) x"))
def server_risk(spark, sf):
    f = stored(spark, sf)
    n = staged_findings(f)
    return graph.server_risk(graph.finding_scope(n, f), graph.weaknesses(n)).select("capture_id", "server", "risk", text("weaknesses").alias("weaknesses"))


@query("blast_radius", "H-7", sql(["frad"], "SELECT * FROM frad"))
def blast_radius(spark, sf):
    f = stored(spark, sf)
    return graph.finding_radius(staged_findings(f), f)


@query(
    "crypto_blast_radius",
    "H-7",
    sql(
        ["crows", "f"],
        ", risky AS (SELECT capture_id, node_id AS key, CASE arg_min(risk, first_frame) WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' WHEN 'low' THEN 'LOW' WHEN 'quantum' THEN 'INFO' END AS severity FROM crows GROUP BY 1, 2 HAVING arg_min(risk, first_frame) <> 'ok') "
        + radius_sql(
            "SELECT capture_id, node_id AS key, session_id, cleartext_auth FROM crows JOIN risky ON risky.capture_id = crows.capture_id AND risky.key = crows.node_id".replace("SELECT capture_id", "SELECT crows.capture_id"),
            "SELECT crows.capture_id, node_id AS key, server FROM crows JOIN risky ON risky.capture_id = crows.capture_id AND risky.key = crows.node_id",
            "SELECT * FROM risky",
        ),
    ).replace(" , risky AS", ", risky AS"),
)
def crypto_blast_radius(spark, sf):
    return graph.crypto_radius(facts(spark, sf))


@query(
    "critical_servers",
    "H-8",
    sql(
        ["f", "scope", "rule"],
        f"""SELECT a.capture_id, a.server, a.clients, a.sessions, a.cleartext, coalesce(['critical','high','medium','low','info'][r.risk_rank + 1], 'ok') AS risk, coalesce(r.weaknesses, '') AS weaknesses
FROM (SELECT capture_id, server, count(*) AS sessions, count(*) FILTER (is_clear) AS cleartext, count(DISTINCT client_ip) AS clients FROM f GROUP BY 1, 2) a LEFT JOIN ({_SRV_RISK}) r USING (capture_id, server)""",
    ),
)
def critical_servers(spark, sf):
    f = stored(spark, sf)
    n = staged_findings(f)
    out = graph.rank_servers(f, graph.finding_scope(n, f), graph.weaknesses(n)).orderBy("capture_id", "risk_rank", F.desc("clients"), F.desc("sessions"))
    return out.select("capture_id", "server", "clients", "sessions", "cleartext", "risk", text("weaknesses").alias("weaknesses"))


# ---- ranking ---------------------------------------------------------------------------------------------------
def prioritised(spark, sf):
    f = stored(spark, sf)
    n = staged_findings(f)
    return ranking.prioritise(n, f, graph.finding_radius(n, f))


@query("finding_priority", "K-1", sql(["prio"], "SELECT capture_id, finding_no, category, session_id, severity, verdict, priority, tier FROM prio"))
def finding_priority(spark, sf):
    return prioritised(spark, sf).select("capture_id", "finding_no", "category", "session_id", "severity", "verdict", "priority", "tier")


@query(
    "priority_rank",
    "K-2",
    sql(["prio"], "SELECT capture_id, finding_no, priority, tier, row_number() OVER (PARTITION BY capture_id ORDER BY priority DESC, finding_no) AS rank FROM prio"),
)
def priority_rank(spark, sf):
    return ranking.rank(stage(prioritised(spark, sf))).select("capture_id", "finding_no", "priority", "tier", "rank")


_EXPLAIN = """SELECT n.capture_id, 'F-' || lpad(CAST(finding_no AS VARCHAR), 4, '0') AS finding_ref, {step} AS step, {key} AS key, {value} AS value FROM fno n {rest}"""


@query(
    "finding_facts",
    "K-3",
    sql(
        ["fno", "f", "dimcat"],
        " UNION ALL ".join(
            [
                _EXPLAIN.format(step="'rule'", key="'severity'", value="severity", rest=""),
                _EXPLAIN.format(step="'rule'", key="'min_sessions_for_baseline'", value="'3'", rest="WHERE category = 'starttls_stripping'"),
                _EXPLAIN.format(step="'rule'", key="'min_advertise_ratio'", value="'0.5'", rest="WHERE category = 'starttls_stripping'"),
                _EXPLAIN.format(step="'verdict'", key="'verdict'", value="verdict", rest=""),
                _EXPLAIN.format(step="'confidence'", key="'confidence'", value="CAST(confidence AS VARCHAR)", rest=""),
                _EXPLAIN.format(step="'confidence'", key="'baseline_scope'", value="scope", rest="WHERE scope IS NOT NULL"),
                _EXPLAIN.format(step="'limit'", key="'missing_bytes'", value="'true'", rest="JOIN f USING (capture_id, session_id) WHERE has_gaps"),
                _EXPLAIN.format(step="'limit'", key="'no_termination'", value="'true'", rest="JOIN f USING (capture_id, session_id) WHERE NOT session_complete"),
                _EXPLAIN.format(step="'limit'", key="'certificate_hidden'", value="'true'", rest="JOIN f USING (capture_id, session_id) WHERE tls_version IS NOT NULL AND NOT cert_observable"),
                _EXPLAIN.format(
                    step="'posture_impact'", key="d.dimension", value="CASE severity WHEN 'CRITICAL' THEN '40' WHEN 'HIGH' THEN '60' WHEN 'MEDIUM' THEN '75' WHEN 'LOW' THEN '90' END", rest="JOIN dimcat d USING (category)"
                ),
            ]
        ),
    ),
)
def finding_facts(spark, sf):
    f = stored(spark, sf)
    return ranking.explain(rules.number(rules.findings(f)), f)


_SCEN = """, ind AS (SELECT * FROM (VALUES ('strip_and_harvest',1,0.9::DOUBLE,true,'starttls_stripping'),('strip_and_harvest',2,0.8,false,'cleartext_credential_exposure'),('strip_and_harvest',3,0.4,false,'cleartext_mail_transaction'),
 ('passive_harvest',1,0.9,true,'cleartext_credential_exposure'),('passive_harvest',2,0.4,false,'starttls_advertised_not_used'),('passive_harvest',3,0.4,false,'starttls_not_advertised'),('passive_harvest',4,0.6,false,'starttls_downgrade_fallback'),
 ('content_interception',1,0.85,true,'cleartext_mail_transaction'),('content_interception',2,0.4,false,'starttls_advertised_not_used'),('content_interception',2,0.4,false,'starttls_not_advertised'),
 ('impersonation',1,0.6,false,'certificate_expired'),('impersonation',1,0.6,false,'certificate_not_yet_valid'),('impersonation',2,0.6,false,'certificate_self_signed'),('impersonation',3,0.7,false,'certificate_hostname_mismatch'),('impersonation',4,0.8,false,'certificate_chain_invalid'),
 ('impersonation',5,0.5,false,'certificate_weak_key'),('impersonation',5,0.5,false,'certificate_weak_signature'),('protocol_downgrade',1,0.8,false,'deprecated_tls_version'),('protocol_downgrade',2,0.6,false,'weak_cipher_suite'),
 ('retrospective_decryption',1,0.85,false,'no_forward_secrecy'),('retrospective_decryption',2,0.5,false,'pqc_server_not_ready'),('retrospective_decryption',3,0.35,false,'classical')) t(scenario, indicator, weight, required, category)),
 bc AS (SELECT capture_id, category, max(confidence) AS conf FROM fnd WHERE verdict = 'FAIL' GROUP BY 1, 2 UNION ALL SELECT capture_id, 'classical', 1.0 FROM f GROUP BY 1 HAVING count(tls_version) > 0 AND count(*) FILTER (pqc_selected) = 0),
 hit AS (SELECT capture_id, scenario, indicator, weight, bool_or(required) AS required, max(conf) AS conf FROM bc JOIN ind USING (category) GROUP BY 1, 2, 3, 4),
 ev AS (SELECT capture_id, scenario, count(DISTINCT session_id) AS n FROM fnd JOIN ind USING (category) WHERE verdict = 'FAIL' GROUP BY 1, 2), em AS (SELECT capture_id, count(*) AS n FROM f GROUP BY 1),
 sc AS (SELECT capture_id, scenario, count(*) AS indicators, 1 - product(1 - weight * conf) AS lk FROM hit GROUP BY 1, 2 HAVING max(weight) >= 0.4 AND (scenario NOT IN ('strip_and_harvest','passive_harvest','content_interception') OR bool_or(required)))
"""


@query(
    "interception_scenarios",
    "K-5 K-6",
    sql(
        ["fnd", "f"],
        _SCEN
        + """SELECT *, CASE WHEN score >= 60 THEN 'High' WHEN score >= 35 THEN 'Elevated' ELSE 'Low' END AS level FROM (SELECT capture_id, scenario, indicators, round_even(lk, 3) AS likelihood, coalesce(ev.n, 0) AS sessions, round_even(100.0::DOUBLE * coalesce(ev.n, 0) / em.n, 1) AS exposure_pct,
 round_even(100.0::DOUBLE * lk * (0.65::DOUBLE * CASE scenario WHEN 'strip_and_harvest' THEN 1.0 WHEN 'passive_harvest' THEN 0.95 WHEN 'content_interception' THEN 0.8 WHEN 'impersonation' THEN 0.85 WHEN 'protocol_downgrade' THEN 0.6 ELSE 0.7 END + 0.35::DOUBLE * least(1, 2 * coalesce(ev.n, 0)::DOUBLE / em.n)), 1) AS score
 FROM sc LEFT JOIN ev USING (capture_id, scenario) JOIN em USING (capture_id)) x""",
    ).replace(" , ind AS", ", ind AS"),
)
def interception_scenarios(spark, sf):
    f = stored(spark, sf)
    out = ranking.scenarios(staged_findings(f), f)
    return out.select("capture_id", "scenario", F.col("indicators").cast("bigint").alias("indicators"), "likelihood", "sessions", "exposure_pct", "score", "level")


@query(
    "scenario_examples",
    "K-6",
    sql(["fnd", "f"], _SCEN + "SELECT capture_id, scenario, session_id, rn FROM (SELECT capture_id, scenario, session_id, row_number() OVER (PARTITION BY capture_id, scenario ORDER BY session_id) AS rn FROM (SELECT DISTINCT capture_id, scenario, session_id FROM fnd JOIN ind USING (category) WHERE verdict = 'FAIL') d) r WHERE rn <= 25").replace(" , ind AS", ", ind AS"),
)
def scenario_examples(spark, sf):
    return ranking.scenario_sessions(found(spark, sf)).select("capture_id", "scenario", "session_id", "rn")


@query(
    "quantum_forecast",
    "K-7",
    sql(
        ["f"],
        """, t AS (SELECT capture_id, count(*) AS n, count(*) FILTER (tier = 'cleartext') AS cl, count(*) FILTER (tier = 'static_rsa') AS st, count(*) FILTER (tier = 'classical') AS ca,
 greatest(CASE WHEN count(*) FILTER (NOT is_prot) > 0 THEN 0.5 ELSE 0 END, CASE WHEN count(*) FILTER (tls_version <> 'TLS 1.3') > 0 THEN 1.0 ELSE 0 END, CASE WHEN count(*) FILTER (tls_version IS NOT NULL AND NOT pqc_selected) > 0 THEN 2.0 ELSE 0 END)::DOUBLE AS mx,
 CASE WHEN count(*) FILTER (NOT is_prot) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (tls_version <> 'TLS 1.3') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (tls_version IS NOT NULL AND NOT pqc_selected) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (tls_version IS NOT NULL AND NOT pqc_offered) > 0 THEN 1 ELSE 0 END AS k
 FROM (SELECT *, CASE WHEN is_clear THEN 'cleartext' WHEN tls_version IS NULL THEN NULL WHEN pqc_selected THEN 'pqc_hybrid' WHEN forward_secrecy = false THEN 'static_rsa' ELSE 'classical' END AS tier FROM f) x GROUP BY 1),
 y AS (SELECT *, mx + 0.5::DOUBLE * greatest(0, k - 1) AS my FROM t), r AS (SELECT *, CASE WHEN capture_id + 30.5::DOUBLE + 10 > yr THEN cl + st + ca ELSE cl + st END AS hit FROM y CROSS JOIN (VALUES ('early', 2030), ('median', 2035), ('late', 2040)) h(horizon, yr))
SELECT capture_id, horizon, round_even(my, 1) AS migration_years, round_even(yr - 2026.25::DOUBLE, 1) AS years_left, CASE WHEN 10 + my > yr - 2026.25::DOUBLE THEN 'Act now' ELSE 'Within margin' END AS verdict, round_even(yr - 2026.25::DOUBLE - (10 + my), 1) AS margin_years,
 capture_id + 40.5::DOUBLE > yr AS captured_at_risk, hit AS exposed_sessions, round_even(100.0::DOUBLE * hit / n, 1) AS exposed_pct, round_even(greatest(0, capture_id + 40.5::DOUBLE - yr), 1) AS years_of_exposure FROM r""",
    ).replace(" , t AS", ", t AS"),
)
def quantum_forecast(spark, sf):
    return ranking.forecast(facts(spark, sf), F.col("capture_id") + F.lit(30.5), as_of_year=2026.25)


# ---- listing ----------------------------------------------------------------------------------------------------------
@query("session_list", "Q-1", sql(["sess"], "SELECT capture_id, session_id, encryption_state, first_frame FROM sess WHERE protocol = 'IMAP' AND encryption_state = 'STARTTLS_REJECTED'"))
def session_list(spark, sf):
    return browse.list_sessions(sess(spark, sf), "IMAP", "STARTTLS_REJECTED").select("capture_id", "session_id", "encryption_state", "first_frame")


@query("finding_list", "Q-2", sql(["fnd"], "SELECT capture_id, session_id, category, lo AS finding_frame FROM fnd WHERE severity = 'CRITICAL'"))
def finding_list(spark, sf):
    return browse.list_findings(found(spark, sf), severity="CRITICAL").select("capture_id", "session_id", "category", "finding_frame")


@query("session_lookup", "Q-3", sql(["sess"], "SELECT capture_id, session_id, server_ip, encryption_state FROM sess WHERE session_id = 42"))
def session_lookup(spark, sf):
    return browse.get(sess(spark, sf), "session_id", 42).select("capture_id", "session_id", "server_ip", "encryption_state")


@query("order_page", "Q-4", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def order_page(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return browse.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 40).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "total")


@query("risk_list", "Q-5", sql(["sess"], "SELECT capture_id, session_id, risk_class, risk_score FROM sess WHERE risk_class IS NOT NULL"))
def risk_list(spark, sf):
    return browse.risk_list(sess(spark, sf)).select("capture_id", "session_id", "risk_class", "risk_score")


@query(
    "deviating_sessions",
    "Q-6",
    sql(["f", "devs"], "SELECT f.capture_id, f.session_id, coalesce(d.n, 0) AS deviations FROM f LEFT JOIN (SELECT capture_id, session_id, count(*) AS n FROM devs GROUP BY 1, 2) d USING (capture_id, session_id) WHERE NOT f.is_indeterminate AND (d.n > 0 OR f.is_anomalous)"),
)
def deviating_sessions(spark, sf):
    rows = browse.deviating(baseline.with_deviations(baseline.population(sess(spark, sf))))
    return rows.select("capture_id", "session_id", F.size("deviations").cast("bigint").alias("deviations"))


@query("page_search", "Q-7", "SELECT page_id, url FROM pages WHERE regexp_extract(url, '^(https?)', 1) IN ('https') AND contains(lower(url), 'example.net')")
def page_search(spark, sf):
    rows = load(spark, sf, "pages").withColumn("scheme", F.regexp_extract("url", "^(https?)", 1))
    return browse.facet_filter(rows, {"scheme": ["https"]}, "Example.NET", ["url"]).select("page_id", "url")


@query(
    "facet_values",
    "Q-7",
    sql(["sess"], "SELECT 'protocol' AS facet, protocol AS value, count(*) AS rows FROM sess GROUP BY 2 UNION ALL SELECT 'tls_version', tls_version, count(*) FROM sess WHERE tls_version IS NOT NULL GROUP BY 2 UNION ALL SELECT 'encryption_state', encryption_state, count(*) FROM sess GROUP BY 2"),
)
def facet_values(spark, sf):
    return browse.facet_values(sess(spark, sf), ["protocol", "tls_version", "encryption_state"])


@query(
    "risky_legacy_sessions",
    "Q-8",
    sql(["f"], "SELECT capture_id, session_id, tls_version, risk_score FROM f WHERE tls_version IN ('SSL 3.0','TLS 1.0','TLS 1.1') AND (forward_secrecy = false OR aead = false) AND protocol IN ('SMTP','IMAP') ORDER BY risk_score DESC, capture_id, session_id LIMIT 25"),
)
def risky_legacy_sessions(spark, sf):
    rows = browse.filter_sessions(facts(spark, sf), {"protocols": ["SMTP", "IMAP"], "tls_versions": ["__deprecated"], "topics": ["cipher"]})
    return browse.top_risk(rows).select("capture_id", "session_id", "tls_version", "risk_score")


@query("finding_topics", "Q-8", sql(["fnd"], "SELECT capture_id, session_id, category FROM fnd WHERE verdict = 'FAIL' AND severity IN ('HIGH','CRITICAL') AND (category LIKE 'starttls%' OR category LIKE 'certificate%')"))
def finding_topics(spark, sf):
    return browse.filter_findings(found(spark, sf), ["HIGH", "CRITICAL"], ["starttls", "certificate"]).select("capture_id", "session_id", "category")


@query(
    "server_inventory",
    "Q-9",
    sql(
        ["f", "fno"],
        """SELECT a.capture_id, a.server, a.sessions, coalesce(a.versions, '') AS versions, coalesce(b.n, 0) AS findings, ['CRITICAL','HIGH','MEDIUM','LOW','INFO'][b.w + 1] AS worst FROM (SELECT capture_id, server, count(*) AS sessions, string_agg(DISTINCT tls_version, ',' ORDER BY tls_version) AS versions FROM f GROUP BY 1, 2) a
LEFT JOIN (SELECT capture_id, server, count(DISTINCT finding_no) AS n, min(severity_rank) AS w FROM (SELECT fno.capture_id, f.server, finding_no, severity_rank FROM fno JOIN f USING (capture_id, session_id) WHERE verdict = 'FAIL'
 UNION ALL SELECT fno.capture_id, f.server, finding_no, severity_rank FROM fno JOIN f USING (capture_id) WHERE fno.category = 'pqc_server_not_ready' AND f.pqc_offered) x GROUP BY 1, 2) b USING (capture_id, server)""",
    ),
)
def server_inventory(spark, sf):
    f = stored(spark, sf)
    n = staged_findings(f)
    out = browse.server_inventory(f, n, graph.finding_scope(n, f), baseline.software_by_server(f))
    return out.select("capture_id", "server", "sessions", text("versions").alias("versions"), "findings", "worst")


@query(
    "outcome_flow",
    "Q-11",
    sql(
        ["sess"],
        """SELECT capture_id, protocol, state, version, count(*) AS sessions FROM (SELECT capture_id, protocol, encryption_state AS state, coalesce(tls_version, 'No TLS') AS version FROM sess) x
GROUP BY GROUPING SETS ((capture_id, protocol, state), (capture_id, state, version), (capture_id, protocol), (capture_id, state), (capture_id, version))""",
    ),
)
def outcome_flow(spark, sf):
    return browse.outcome_flow(sess(spark, sf))


@query(
    "session_lanes",
    "Q-12",
    sql(
        ["sess"],
        """SELECT capture_id, session_id, server_ip || ':' || CAST(server_port AS VARCHAR) AS lane, round((start_time - t0) / greatest(t1 - t0, 0.001), 6) AS offset_share, round((end_time - start_time) / greatest(t1 - t0, 0.001), 6) AS width_share
FROM (SELECT *, min(start_time) OVER (PARTITION BY capture_id) AS t0, max(end_time) OVER (PARTITION BY capture_id) AS t1 FROM sess) x""",
    ),
)
def session_lanes(spark, sf):
    return browse.session_lanes(sess(spark, sf)).withColumn("offset_share", F.round("offset_share", 6)).withColumn("width_share", F.round("width_share", 6))


# ---- grading -----------------------------------------------------------------------------------------------------------
@query(
    "grade_controls",
    "V-3",
    sql(
        ["fnd", "f"],
        """SELECT l.capture_id, l.server, l.label, coalesce(n.noisy, 0) AS noisy, coalesce(n.unk, 0) AS unknown, CASE WHEN label = 'secure' AND n.noisy > 0 THEN 'false_positive' WHEN label = 'incomplete_evidence' AND coalesce(n.unk, 0) = 0 THEN 'no_unknown_verdict' END AS problem
FROM (SELECT capture_id, server, CASE WHEN bool_and(is_prot AND tls_version = 'TLS 1.3') THEN 'secure' WHEN bool_or(is_indeterminate) THEN 'incomplete_evidence' ELSE 'mixed' END AS label FROM f GROUP BY 1, 2) l
LEFT JOIN (SELECT capture_id, server, count(*) FILTER (severity <> 'INFO') AS noisy, count(*) FILTER (verdict = 'UNKNOWN') AS unk FROM fnd GROUP BY 1, 2) n USING (capture_id, server)""",
    ),
)
def grade_controls(spark, sf):
    f = stored(spark, sf).withColumn("server", server_key())
    clean = F.col("encryption_state").isin(*dims.PROTECTED) & F.coalesce(F.col("tls_version") == "TLS 1.3", F.lit(False))
    label = F.when(F.bool_and(clean), F.lit("secure")).when(F.bool_or("is_indeterminate"), F.lit("incomplete_evidence")).otherwise(F.lit("mixed"))
    labels = f.groupBy("capture_id", "server").agg(label.alias("label"))
    return grading.grade_controls(labels, rules.findings(f.drop("server")), ["capture_id", "server"])


@query(
    "grade_findings",
    "V-2",
    sql(
        ["fnd", "f"],
        """, e AS (SELECT capture_id, 'starttls_downgrade_fallback' AS category, count(*) AS n FROM f WHERE encryption_state = 'PLAINTEXT_AFTER_FAILURE' GROUP BY 1 UNION ALL SELECT capture_id, 'deprecated_tls_version', count(*) FROM f WHERE tls_version IN ('TLS 1.0','TLS 1.1') GROUP BY 1)
SELECT e.capture_id, e.category, e.n AS expected, coalesce(a.n, 0) AS actual, coalesce(a.n, 0) < e.n AS missed, 0 AS wrong_frames FROM e LEFT JOIN (SELECT capture_id, category, count(*) AS n FROM fnd GROUP BY 1, 2) a USING (capture_id, category)""",
    ).replace(" , e AS", ", e AS"),
)
def grade_findings(spark, sf):
    f = stored(spark, sf)
    want = F.array_compact(
        F.array(
            F.when(F.col("encryption_state") == "PLAINTEXT_AFTER_FAILURE", F.struct(F.lit("starttls_downgrade_fallback").alias("category"), F.array("at_rejected").alias("frames"))),
            F.when(F.col("tls_version").isin("TLS 1.0", "TLS 1.1"), F.struct(F.lit("deprecated_tls_version").alias("category"), F.array("at_server_hello").alias("frames"))),
        )
    )
    expected = f.select("capture_id", "session_id", F.explode(want).alias("w")).select("capture_id", "session_id", "w.category", "w.frames")
    return grading.grade_findings(expected, rules.findings(f), ["capture_id"])


# ---- documents -----------------------------------------------------------------------------------------------------
def _ranked(spark, sf):
    f = stored(spark, sf)
    n = staged_findings(f)
    blast = stage(graph.finding_radius(n, f))
    return f, n, blast, stage(report.rank_all(f, n, blast))


@query(
    "finding_trace",
    "K-4",
    sql(
        ["prio", "f", "frad"],
        """SELECT p.capture_id, 'F-' || lpad(CAST(p.finding_no AS VARCHAR), 4, '0') AS finding_ref, p.category, p.session_id, f.server AS session_server, f.encryption_state, p.priority, p.tier, r.blast_score, r.dependent_clients,
 CASE WHEN p.category LIKE 'certificate_chain%' THEN 'fix_certificate_chain' WHEN p.category = 'certificate_not_observable' OR p.category = 'incomplete_evidence' THEN NULL WHEN p.category LIKE 'certificate%' THEN 'renew_certificate' WHEN p.category = 'starttls_stripping' THEN 'deploy_mta_sts_dane' WHEN p.category = 'deprecated_tls_version' THEN 'disable_legacy_tls'
 WHEN p.category IN ('weak_cipher_suite','no_forward_secrecy') THEN 'modern_ciphers' WHEN p.category = 'pqc_server_not_ready' THEN 'enable_hybrid_pqc' WHEN p.category = 'protocol_port_mismatch' THEN 'standard_ports' ELSE 'enforce_tls' END AS fix_id
FROM prio p LEFT JOIN f USING (capture_id, session_id) LEFT JOIN frad r ON r.capture_id = p.capture_id AND r.key = p.category""",
    ),
)
def finding_trace(spark, sf):
    f, n, blast, ranked = _ranked(spark, sf)
    out = report.trace(n, f, ranked, blast)
    return out.select("capture_id", "finding_ref", "category", "session_id", "session_server", "encryption_state", "priority", "tier", "blast_score", "dependent_clients", "fix_id")


@query("brief_facts", "K-8")
def brief_facts(spark, sf):
    f, n, blast, ranked = _ranked(spark, sf)
    return report.brief_facts(f, ranked, posture.posture(f, n), readiness.readiness(f), ranking.scenarios(n, f))


@query(
    "report_documents",
    "IO-10",
    sql(
        ["f", "post", "fnd"],
        """SELECT capture_id, CAST(count(*) AS VARCHAR) AS sessions, CAST(any_value(post.overall) AS VARCHAR) AS posture, CAST(any_value(k.n) AS VARCHAR) AS findings, 12 AS priorities, 6 AS radii, 12 AS risky FROM f JOIN post USING (capture_id) JOIN (SELECT capture_id, count(*) AS n FROM fnd GROUP BY 1) k USING (capture_id) GROUP BY 1""",
    ),
)
def report_documents(spark, sf):
    f, n, blast, ranked = _ranked(spark, sf)
    doc = F.col("document")
    size = lambda p: F.json_array_length(F.get_json_object(doc, p))
    return report.report(f, ranked, blast).select(
        "capture_id",
        F.get_json_object(doc, "$.summary.sessions").alias("sessions"),
        F.get_json_object(doc, "$.posture.overall").alias("posture"),
        F.get_json_object(doc, "$.summary.findings").alias("findings"),
        size("$.priorities").alias("priorities"),
        size("$.blast_radius").alias("radii"),
        size("$.risky_sessions").alias("risky"),
    )
