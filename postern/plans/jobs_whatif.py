"""Queries over fixes, projections and plans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.functions.scores import text
from postern.operators import graph, posture, ranking, readiness, rules, whatif
from postern.plans import report
from postern.plans.catalog import query
from postern.plans.jobs_sessions import _ranked
from postern.plans.jobs_traffic import _with_domains
from postern.plans.oracle_parts import PARTS, part, sql
from postern.plans.views import load, view
from postern.session import stage

ALL_FIXES = list(dims.FIX_ORDER)


def facts(spark, sf):
    """Decorated sessions, written once: projections read them in several branches."""
    return stage(crypto.decorate(view(spark, sf, "sess")))


def projected(spark, sf, fixes=ALL_FIXES):
    return whatif.project(whatif.with_fixes(facts(spark, sf), fixes))


# ---- oracle: the projection in SQL, step by step -------------------------------------------------------
_HEALTH = """row_number() OVER (PARTITION BY capture_id, server_ip, server_port ORDER BY CASE tls_version WHEN 'TLS 1.3' THEN 5 WHEN 'TLS 1.2' THEN 4 WHEN 'TLS 1.1' THEN 3 WHEN 'TLS 1.0' THEN 2 ELSE 1 END DESC, coalesce(forward_secrecy, false) DESC, coalesce(aead, false) DESC,
 CASE WHEN weaknesses = '' THEN 0 ELSE len(string_split(weaknesses, ',')) END, (NOT (cert_expired OR cert_weak_key OR cert_broken_signature OR cert_self_signed)) DESC, first_frame)"""
_INH = ["tls_version", "cipher_suite", "key_group", "ja4s", "cert_observable", "cert_seen", "cert_expired", "cert_not_yet_valid", "cert_expiring_soon", "cert_days_to_expiry", "cert_hostname_match", "cert_weak_key", "cert_broken_signature", "cert_chain_invalid", "cert_self_signed", "cert_chain_incomplete", "cert_key_alg", "cert_key_bits", "key_exchange", "forward_secrecy", "aead", "weaknesses"]
_DEF = {"tls_version": "'TLS 1.3'", "cipher_suite": "'TLS_AES_256_GCM_SHA384'", "key_group": "'x25519'", "cert_observable": "false", "key_exchange": "NULL", "forward_secrecy": "true", "aead": "true", "weaknesses": "''"}


def _enc(src: str, best: str, cond: str, fix: str) -> str:
    cols = ", ".join(f"CASE WHEN hit THEN CASE WHEN b.session_id IS NOT NULL THEN b.{c} ELSE {_DEF.get(c, 's.' + c)} END ELSE s.{c} END AS {c}" for c in _INH)
    return f"""SELECT s.* EXCLUDE (hit) REPLACE ({cols}, CASE WHEN hit THEN CASE WHEN s.server_port IN (465,993,995) THEN 'IMPLICIT_TLS' ELSE 'TLS_ESTABLISHED' END ELSE s.encryption_state END AS encryption_state,
 CASE WHEN hit THEN s.server_port NOT IN (465,993,995) ELSE s.upgrade_advertised END AS upgrade_advertised, CASE WHEN hit THEN s.server_port NOT IN (465,993,995) ELSE s.upgrade_requested END AS upgrade_requested, CASE WHEN hit THEN false ELSE s.upgrade_advertised_mangled END AS upgrade_advertised_mangled,
 CASE WHEN hit THEN true ELSE s.tls_established END AS tls_established, CASE WHEN hit THEN false ELSE s.cleartext_auth END AS cleartext_auth, CASE WHEN hit THEN false ELSE s.cleartext_mail END AS cleartext_mail,
 CASE WHEN hit AND b.session_id IS NOT NULL THEN b.pqc_selected AND s.pqc_offered ELSE s.pqc_selected END AS pqc_selected, CASE WHEN hit THEN s.fixes || ',{fix}' ELSE s.fixes END AS fixes) FROM (SELECT *, {cond} AS hit FROM {src}) s LEFT JOIN {best} b ON b.capture_id = s.capture_id AND b.server_ip = s.server_ip AND b.server_port = s.server_port"""


part("w0", ["f"], "SELECT *, '' AS fixes FROM f")
part("wb0", ["w0"], f"SELECT * FROM (SELECT *, {_HEALTH} AS rn FROM w0 WHERE tls_established AND tls_version IS NOT NULL) x WHERE rn = 1")
part("w1", ["w0", "wb0"], _enc("w0", "wb0", "NOT is_indeterminate AND NOT upgrade_advertised_mangled AND (is_clear OR encryption_state = 'STARTTLS_NEGOTIATION_FAILED')", "enforce_tls"))
part("wb1", ["w1"], f"SELECT * FROM (SELECT *, {_HEALTH} AS rn FROM w1 WHERE tls_established AND tls_version IS NOT NULL) x WHERE rn = 1")
part("w2", ["w1", "wb1"], _enc("w1", "wb1", "NOT is_indeterminate AND upgrade_advertised_mangled", "deploy_mta_sts_dane"))
part("w3", ["w2"], "SELECT * REPLACE (CASE WHEN tls_version IN ('SSL 3.0','TLS 1.0','TLS 1.1') THEN 'TLS 1.2' ELSE tls_version END AS tls_version, CASE WHEN tls_version IN ('SSL 3.0','TLS 1.0','TLS 1.1') THEN fixes || ',disable_legacy_tls' ELSE fixes END AS fixes) FROM w2")
part(
    "w4",
    ["w3"],
    """SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN CASE WHEN cert_key_alg = 'EC' THEN 'TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384' ELSE 'TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384' END ELSE cipher_suite END AS cipher_suite, CASE WHEN hit THEN '' ELSE weaknesses END AS weaknesses,
 CASE WHEN hit THEN true ELSE forward_secrecy END AS forward_secrecy, CASE WHEN hit THEN true ELSE aead END AS aead, CASE WHEN hit THEN 'ECDHE' ELSE key_exchange END AS key_exchange, CASE WHEN hit THEN fixes || ',modern_ciphers' ELSE fixes END AS fixes)
FROM (SELECT *, coalesce(tls_version <> 'TLS 1.3' AND (weaknesses <> '' OR forward_secrecy = false OR aead = false), false) AS hit FROM w3) x""",
)
_FLAGS = ["cert_expired", "cert_not_yet_valid", "cert_expiring_soon", "cert_weak_key", "cert_broken_signature", "cert_self_signed", "cert_chain_incomplete", "cert_chain_invalid"]
part(
    "w5",
    ["w4"],
    "SELECT * EXCLUDE (hit) REPLACE ("
    + ", ".join(f"CASE WHEN hit THEN false ELSE {c} END AS {c}" for c in _FLAGS)
    + ", CASE WHEN hit AND cert_hostname_match IS NOT NULL THEN true ELSE cert_hostname_match END AS cert_hostname_match, CASE WHEN hit THEN 365 ELSE cert_days_to_expiry END AS cert_days_to_expiry, CASE WHEN hit THEN fixes || ',renew_certificate' ELSE fixes END AS fixes) FROM (SELECT *, cert_seen AND ("
    + " OR ".join(_FLAGS)
    + " OR coalesce(cert_hostname_match = false, false)) AS hit FROM w4) x",
)
part("w6", ["w5"], "SELECT * REPLACE (CASE WHEN tls_version = 'TLS 1.3' AND pqc_offered THEN true ELSE pqc_selected END AS pqc_selected, CASE WHEN tls_version = 'TLS 1.3' AND pqc_offered AND NOT pqc_selected THEN 'X25519MLKEM768' ELSE key_group END AS key_group, CASE WHEN tls_version = 'TLS 1.3' AND pqc_offered AND NOT pqc_selected THEN fixes || ',enable_hybrid_pqc' ELSE fixes END AS fixes) FROM w5")
part(
    "pf",
    ["w6"],
    """SELECT * REPLACE (CASE WHEN session_id % 97 IN (5, 6) THEN 'payload_signature' ELSE detection_method END AS detection_method, CASE WHEN session_id % 97 IN (5, 6) THEN fixes || ',standard_ports' ELSE fixes END AS fixes,
 encryption_state IN ('PLAINTEXT_THROUGHOUT','PLAINTEXT_AFTER_FAILURE','STARTTLS_ADVERTISED_NOT_USED','STARTTLS_NOT_ADVERTISED','STARTTLS_REJECTED') AS is_clear, encryption_state IN ('TLS_ESTABLISHED','IMPLICIT_TLS') AS is_prot) FROM w6""",
)
_VARIANTS = ["sdrafts", "caps", "hosts", "strip", "pqcgap", "fnd"]
for _name in _VARIANTS:
    _deps, _text = PARTS[_name]
    for _dep in ["f", *_VARIANTS]:
        _text = re.sub(rf"\b(FROM|JOIN) {_dep}\b", rf"\1 {'pf' if _dep == 'f' else 'p_' + _dep}" + (" f" if _dep == "f" and _name == "strip" else ""), _text)
    _text = _text.replace("session_id % 97 IN (5, 6)", "detection_method LIKE '%mismatch'").replace("pf f ", "pf f ")
    part("p_" + _name, [("pf" if d == "f" else "p_" + d if d in _VARIANTS else d) for d in _deps], _text)


@query(
    "fix_bridge",
    "W-1",
    sql(
        ["fnd"],
        """, b AS (SELECT * FROM (VALUES ('enforce_tls','cleartext_credential_exposure'),('enforce_tls','starttls_advertised_not_used'),('enforce_tls','starttls_not_advertised'),('enforce_tls','cleartext_mail_transaction'),('enforce_tls','starttls_downgrade_fallback'),('deploy_mta_sts_dane','starttls_stripping'),
 ('disable_legacy_tls','deprecated_tls_version'),('modern_ciphers','weak_cipher_suite'),('modern_ciphers','no_forward_secrecy'),('renew_certificate','certificate_expired'),('renew_certificate','certificate_not_yet_valid'),('renew_certificate','certificate_expiring_soon'),('renew_certificate','certificate_hostname_mismatch'),
 ('renew_certificate','certificate_weak_key'),('renew_certificate','certificate_weak_signature'),('renew_certificate','certificate_self_signed'),('fix_certificate_chain','certificate_chain_incomplete'),('fix_certificate_chain','certificate_chain_invalid'),('enable_hybrid_pqc','pqc_server_not_ready'),('standard_ports','protocol_port_mismatch')) t(fix_id, category))
SELECT capture_id, category, fix_id, count(*) AS findings FROM fnd JOIN b USING (category) GROUP BY 1, 2, 3""",
    ).replace(" , b AS", ", b AS"),
)
def fix_bridge(spark, sf):
    bridge = dims.fixes(spark).where("choice = 1").select("category", "fix_id")
    return rules.findings(facts(spark, sf)).join(F.broadcast(bridge), "category").groupBy("capture_id", "category", "fix_id").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "fix_candidates",
    "W-2",
    sql(
        ["fnd", "scope"],
        """, b AS (SELECT category, CASE WHEN category LIKE 'certificate_chain%' THEN 'fix_certificate_chain' WHEN category LIKE 'certificate%' THEN 'renew_certificate' WHEN category = 'starttls_stripping' THEN 'deploy_mta_sts_dane' WHEN category = 'deprecated_tls_version' THEN 'disable_legacy_tls'
 WHEN category IN ('weak_cipher_suite','no_forward_secrecy') THEN 'modern_ciphers' WHEN category = 'pqc_server_not_ready' THEN 'enable_hybrid_pqc' WHEN category = 'protocol_port_mismatch' THEN 'standard_ports' ELSE 'enforce_tls' END AS fix_id FROM (SELECT DISTINCT category FROM fnd WHERE verdict = 'FAIL') c)
SELECT a.capture_id, a.fix_id, a.findings, s.servers FROM (SELECT capture_id, fix_id, count(*) AS findings FROM fnd JOIN b USING (category) WHERE verdict = 'FAIL' GROUP BY 1, 2) a JOIN (SELECT capture_id, fix_id, count(DISTINCT server) AS servers FROM scope JOIN b USING (category) GROUP BY 1, 2) s USING (capture_id, fix_id)""",
    ).replace(" , b AS", ", b AS"),
)
def fix_candidates(spark, sf):
    f = facts(spark, sf)
    fixes, scope = whatif.candidates(stage(rules.findings(f)), f)
    return fixes.select("capture_id", "fix_id", "findings").join(scope.groupBy("capture_id", "fix_id").agg(F.count(F.lit(1)).alias("servers")), ["capture_id", "fix_id"])


@query("best_server_sessions", "W-3", sql(["wb0"], "SELECT capture_id, server_ip, server_port, session_id FROM wb0"))
def best_server_sessions(spark, sf):
    return whatif.best_profiles(facts(spark, sf)).select("capture_id", "server_ip", "server_port", "best.session_id")


@query(
    "projected_sessions",
    "W-4",
    sql(["pf"], "SELECT capture_id, session_id, encryption_state, tls_version, cipher_suite, key_group, forward_secrecy, pqc_selected, cert_observable, cert_expired, cert_hostname_match, cert_days_to_expiry, detection_method, ltrim(fixes, ',') AS fixes FROM pf"),
)
def projected_sessions(spark, sf):
    out = projected(spark, sf)
    return out.select(
        "capture_id", "session_id", "encryption_state", "tls_version", "cipher_suite", "key_group", "forward_secrecy", "pqc_selected", "cert_observable", "cert_expired", "cert_hostname_match", "cert_days_to_expiry", "detection_method", text("changed_by").alias("fixes")
    )


@query("projected_findings", "W-5", sql(["p_fnd"], "SELECT capture_id, session_id, category, severity, verdict FROM p_fnd"))
def projected_findings(spark, sf):
    return whatif.reevaluate(stage(projected(spark, sf))).select("capture_id", "session_id", "category", "severity", "verdict")


@query(
    "finding_resolution",
    "W-6",
    sql(
        ["fnd", "p_fnd"],
        """, d AS (SELECT capture_id, category, CAST(session_id AS VARCHAR) AS subject, sum(b) AS b, sum(a) AS a FROM (SELECT capture_id, category, session_id, 1 AS b, 0 AS a FROM fnd WHERE verdict = 'FAIL' UNION ALL SELECT capture_id, category, session_id, 0, 1 FROM p_fnd WHERE verdict = 'FAIL') x GROUP BY 1, 2, 3)
SELECT capture_id, category, subject, CAST(least(a, b) AS BIGINT) AS remaining, CAST(greatest(0, b - a) AS BIGINT) AS resolved, CAST(greatest(0, a - b) AS BIGINT) AS introduced FROM d""",
    ).replace(" , d AS", ", d AS"),
)
def finding_resolution(spark, sf):
    f = facts(spark, sf)
    return whatif.finding_diff(rules.findings(f), whatif.reevaluate(stage(projected(spark, sf))))


_STATE = "count(*) AS sessions, count(*) FILTER (is_prot) AS protected, count(*) FILTER (is_clear OR encryption_state = 'STARTTLS_NEGOTIATION_FAILED') AS cleartext, count(*) FILTER (cleartext_auth) AS credentials_exposed, count(*) FILTER (forward_secrecy) AS forward_secrecy, count(*) FILTER (pqc_selected) AS pqc_selected, count(*) FILTER (tls_version = 'TLS 1.3') AS tls13"


@query("projection_states", "W-7", sql(["f", "pf"], f"SELECT capture_id, 'before' AS phase, {_STATE} FROM f GROUP BY 1 UNION ALL SELECT capture_id, 'after', {_STATE} FROM pf GROUP BY 1"))
def projection_states(spark, sf):
    return whatif.state_summary(facts(spark, sf), projected(spark, sf))


@query("projection_report", "W-7")
def projection_report(spark, sf):
    before, after = facts(spark, sf), stage(projected(spark, sf))
    return whatif.projection_report(before, after, stage(rules.findings(before)), stage(whatif.reevaluate(after)))


@query(
    "normalised_fixes",
    "W-8",
    """SELECT fix_id, CAST(i AS INT) AS apply_order, CASE WHEN bool_or(s IS NULL) THEN NULL ELSE string_agg(DISTINCT s, ',' ORDER BY s) END AS servers FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'enforce_tls' WHEN 1 THEN 'modern_ciphers' ELSE 'standard_ports' END AS fix_id, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 8 END AS i,
 CASE WHEN s_suppkey % 3 = 1 AND s_nationkey > 20 THEN NULL ELSE '10.0.0.' || s_nationkey || ':25' END AS s FROM supplier) x GROUP BY 1, 2""",
)
def normalised_fixes(spark, sf):
    k = F.col("s_suppkey") % 3
    fix = F.when(k == 0, "enforce_tls").when(k == 1, "modern_ciphers").otherwise("standard_ports")
    server = F.when(~((k == 1) & (F.col("s_nationkey") > 20)), F.array(F.concat(F.lit("10.0.0."), F.col("s_nationkey").cast("string"), F.lit(":25"))))
    return whatif.normalise(load(spark, sf, "supplier").select(fix.alias("fix_id"), server.alias("servers"))).withColumn("servers", text("servers"))


def with_domains(spark, sf):
    """Sessions, all findings with those of DNS, and the servers of each domain, each written once."""
    f, found, servers = _with_domains(spark, sf)
    return f, found, stage(servers)


_BRIDGE = """CASE WHEN category LIKE 'certificate_chain%' THEN 'fix_certificate_chain' WHEN category LIKE 'certificate%' THEN 'renew_certificate' WHEN category IN ('starttls_stripping','mta_sts_policy_violation','mta_sts_not_published','dane_not_deployed','tlsrpt_not_configured') THEN 'deploy_mta_sts_dane'
 WHEN category = 'deprecated_tls_version' THEN 'disable_legacy_tls' WHEN category IN ('weak_cipher_suite','no_forward_secrecy') THEN 'modern_ciphers' WHEN category = 'pqc_server_not_ready' THEN 'enable_hybrid_pqc' WHEN category = 'protocol_port_mismatch' THEN 'standard_ports' WHEN category LIKE 'dmarc%' THEN 'publish_dmarc' ELSE 'enforce_tls' END"""


@query(
    "fix_candidates_with_dns",
    "W-2 N-5",
    sql(
        ["fnd", "scope", "dnsf", "dres", "f"],
        f""", u AS (SELECT capture_id, {_BRIDGE} AS fix_id FROM (SELECT capture_id, category, verdict FROM fnd UNION ALL SELECT capture_id, category, verdict FROM dnsf) a WHERE verdict = 'FAIL'),
 s AS (SELECT capture_id, {_BRIDGE} AS fix_id, server FROM (SELECT capture_id, category, server FROM scope UNION ALL SELECT x.capture_id, x.category, f.server FROM dnsf x JOIN dres d USING (capture_id, domain) JOIN f ON f.capture_id = d.capture_id AND f.server_ip = d.ip WHERE x.verdict = 'FAIL') b)
SELECT a.capture_id, a.fix_id, a.findings, coalesce(b.servers, 0) AS servers FROM (SELECT capture_id, fix_id, count(*) AS findings FROM u GROUP BY 1, 2) a LEFT JOIN (SELECT capture_id, fix_id, count(DISTINCT server) AS servers FROM s GROUP BY 1, 2) b USING (capture_id, fix_id)""",
    ).replace(" , u AS", ", u AS"),
)
def fix_candidates_with_dns(spark, sf):
    f, found, servers = with_domains(spark, sf)
    fixes, scope = whatif.candidates(found, f, servers)
    n = scope.groupBy("capture_id", "fix_id").agg(F.count(F.lit(1)).alias("servers"))
    return fixes.select("capture_id", "fix_id", "findings").join(n, ["capture_id", "fix_id"], "left").na.fill(0, ["servers"])


_OPEN = "('PLAINTEXT_THROUGHOUT','PLAINTEXT_AFTER_FAILURE','STARTTLS_ADVERTISED_NOT_USED','STARTTLS_NOT_ADVERTISED','STARTTLS_REJECTED','STARTTLS_NEGOTIATION_FAILED')"
_TRIALS = {"as observed": [], "encrypted": ["enforce_tls", "publish_dmarc"], "policy": ["deploy_mta_sts_dane"]}


@query(
    "carried_dns_findings",
    "W-5 N-5",
    sql(
        ["f", "w1", "dnsf", "dres"],
        f""", o AS (SELECT DISTINCT 'as observed' AS trial, d.capture_id, d.domain FROM dres d JOIN f s ON s.capture_id = d.capture_id AND s.server_ip = d.ip WHERE s.encryption_state IN {_OPEN}
 UNION ALL SELECT DISTINCT 'encrypted', d.capture_id, d.domain FROM dres d JOIN w1 s ON s.capture_id = d.capture_id AND s.server_ip = d.ip WHERE s.encryption_state IN {_OPEN})
SELECT trial, x.capture_id, x.domain, x.category, x.verdict FROM dnsf x CROSS JOIN (SELECT unnest(['as observed','encrypted','policy']) AS trial) t LEFT JOIN o USING (trial, capture_id, domain)
WHERE CASE trial WHEN 'policy' THEN category LIKE 'dmarc%' OR category = 'dns_correlation_incomplete' ELSE (trial = 'as observed' OR category NOT LIKE 'dmarc%') AND (category <> 'mta_sts_policy_violation' OR o.domain IS NOT NULL) END""",
    ).replace(" , o AS", ", o AS"),
)
def carried_dns_findings(spark, sf):
    f, found, servers = with_domains(spark, sf)
    none = F.array().cast("array<string>")
    sets = F.array(*[F.struct(F.lit(t).alias("trial"), (F.array(*[F.lit(x) for x in fixes]) if fixes else none).alias("fixes")) for t, fixes in _TRIALS.items()])
    trials = f.select("capture_id").distinct().select("capture_id", F.inline(sets))
    rows = whatif.with_profiles(f).join(trials, "capture_id").withColumns({f"fx_{x}": F.array_contains("fixes", x) for x in ALL_FIXES}).drop("fixes")
    after = stage(whatif.project(rows, ["trial"]).select("trial", "capture_id", "server_ip", "server_port", "encryption_state"))
    kept = whatif.carried_dns(found, after, trials, servers, ["trial"])
    return kept.select("trial", "capture_id", "domain", "category", "verdict")


@query("remediation_plan", "W-9")
def remediation_plan(spark, sf):
    return whatif.plan(*with_domains(spark, sf))


@query("brief_with_actions", "K-8")
def brief_with_actions(spark, sf):
    f, n, _, ranked = _ranked(spark, sf)
    return report.brief_facts(f, ranked, posture.posture(f, n), readiness.readiness(f), ranking.scenarios(n, f), stage(whatif.plan(f, n)))


@query("minimal_fix_sets", "W-10")
def minimal_fix_sets(spark, sf):
    f = facts(spark, sf)
    return whatif.minimal_fixes(f, stage(rules.findings(f))).withColumn("fixes", text("fixes"))


@query("evidence_gaps", "W-11", sql(["fnd"], "SELECT capture_id, category, count(*) AS findings FROM fnd WHERE category IN ('incomplete_evidence','certificate_not_observable') GROUP BY 1, 2"))
def evidence_gaps(spark, sf):
    return whatif.evidence_gaps(rules.findings(facts(spark, sf))).select("capture_id", "category", "findings")


_NODES = """SELECT capture_id, 'server:' || server AS node_id, CASE min(severity_rank) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'ok' END AS risk FROM (SELECT DISTINCT {f}.capture_id, {f}.server_ip || ':' || CAST({f}.server_port AS VARCHAR) AS server, n.severity_rank FROM {f} LEFT JOIN (SELECT capture_id, session_id, severity_rank FROM {n} WHERE verdict = 'FAIL' AND category <> 'pqc_server_not_ready'
 UNION ALL SELECT s.capture_id, s.session_id, 3 FROM {f} s JOIN {n} q ON q.capture_id = s.capture_id AND q.category = 'pqc_server_not_ready' WHERE s.tls_version IS NOT NULL AND s.pqc_offered) n ON n.capture_id = {f}.capture_id AND n.session_id = {f}.session_id) x GROUP BY 1, 2"""


@query(
    "graph_changes",
    "Q-14",
    sql(
        ["f", "pf", "fnd", "p_fnd"],
        f""", b AS ({_NODES.format(f='f', n='fnd')}), a AS ({_NODES.format(f='pf', n='p_fnd')}), r AS (SELECT * FROM (VALUES ('critical',0),('high',1),('medium',2),('low',3),('ok',6)) t(risk, o))
SELECT capture_id, node_id, b.risk AS risk_before, a.risk AS risk_after, CASE WHEN ra.o > rb.o THEN 'improved' WHEN ra.o < rb.o THEN 'worse' ELSE 'same' END AS change FROM b JOIN a USING (capture_id, node_id) JOIN r rb ON rb.risk = b.risk JOIN r ra ON ra.risk = a.risk""",
    ).replace(" , b AS", ", b AS"),
)
def graph_changes(spark, sf):
    def nodes(s, n):
        ranked = graph.rank_servers(s, graph.finding_scope(n, s), graph.weaknesses(n))
        return ranked.select("capture_id", F.concat(F.lit("server:"), F.col("server")).alias("node_id"), "risk")

    before, after = facts(spark, sf), stage(projected(spark, sf))
    return graph.graph_diff(nodes(before, stage(rules.findings(before))), nodes(after, stage(whatif.reevaluate(after))))


_CHANGED_EDGES = """SELECT f.capture_id, 'client:' || CASE WHEN rn <= 150 THEN f.client_ip ELSE 'other' END AS source, 'server:' || server AS target, 'connects' AS type FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, ff, client_ip) AS rn FROM (SELECT capture_id, client_ip, count(*) AS n, min(first_frame) AS ff FROM f GROUP BY 1, 2) c) r USING (capture_id, client_ip) GROUP BY 1, 2, 3
UNION ALL SELECT capture_id, 'server:' || server, node_id, 'negotiates' FROM {c} GROUP BY 1, 2, 3 UNION ALL SELECT capture_id, 'weakness:' || category, 'server:' || server, 'affects' FROM {s}"""
for _name in ("crows", "scope"):
    _deps, _text = PARTS[_name]
    for _dep in ["f", *_VARIANTS]:
        _text = re.sub(rf"\b(FROM|JOIN) {_dep}\b(?! )", rf"\1 {'pf' if _dep == 'f' else 'p_' + _dep}", _text)
        _text = re.sub(rf"\b(FROM|JOIN) {_dep}\b(?= (?:[a-z]\b|WHERE|JOIN|USING|GROUP|ON|UNION))", rf"\1 {'pf f' if _dep == 'f' else 'p_' + _dep}", _text)
    part("p_" + _name, [("pf" if d == "f" else "p_" + d if d in _VARIANTS else d) for d in _deps], _text)


@query(
    "graph_edge_changes",
    "Q-14",
    sql(
        ["f", "pf", "crows", "p_crows", "scope", "p_scope"],
        f""", b AS ({_CHANGED_EDGES.format(c='crows', s='scope')}), a AS ({_CHANGED_EDGES.format(c='p_crows', s='p_scope')})
SELECT capture_id, source, target, type, CASE WHEN max(now) = 0 THEN 'removed' WHEN max(was) = 0 THEN 'new' ELSE 'same' END AS change FROM (SELECT *, 1 AS was, 0 AS now FROM b UNION ALL SELECT *, 0, 1 FROM a) x GROUP BY 1, 2, 3, 4""",
    ).replace(" , b AS", ", b AS"),
)
def graph_edge_changes(spark, sf):
    def edges(s, n):
        return graph.edges(s, graph.finding_scope(n, s))

    before, after = facts(spark, sf), stage(projected(spark, sf))
    return graph.edge_diff(edges(before, stage(rules.findings(before))), edges(after, stage(whatif.reevaluate(after))))
