"""Decoded-table views derived from the given tables, as SQL text both engines run.

The given tables are a star schema, so the session, line, DNS and certificate tables the
operators expect are derived from them by integer arithmetic. Every view is a projection of
its source tables (one row in, a fixed handful of rows out), so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postern.session import tune

# One session per order; the capture is the order year.
SESS = """
SELECT *,
  CASE WHEN encryption_state IN ('IMPLICIT_TLS','TRUNCATED') THEN NULL ELSE first_frame + 3 END AS at_greeting,
  CASE WHEN encryption_state IN ('IMPLICIT_TLS','TRUNCATED') THEN NULL ELSE first_frame + 5 END AS at_capability,
  CASE WHEN upgrade_advertised THEN first_frame + 6 END AS at_advertised,
  CASE WHEN upgrade_advertised_mangled THEN first_frame + 6 END AS at_mangled,
  CASE WHEN upgrade_requested THEN first_frame + 8 END AS at_requested,
  CASE WHEN encryption_state IN ('STARTTLS_NEGOTIATION_FAILED','TLS_ESTABLISHED') THEN first_frame + 9 END AS at_accepted,
  CASE WHEN encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED') THEN first_frame + 9 END AS at_rejected,
  CASE WHEN tls_established OR (encryption_state = 'STARTTLS_NEGOTIATION_FAILED' AND h2 % 3 > 0) THEN first_frame + 10 END AS at_client_hello,
  CASE WHEN tls_established OR (encryption_state = 'STARTTLS_NEGOTIATION_FAILED' AND h2 % 3 = 1) THEN first_frame + 11 END AS at_server_hello,
  CASE WHEN encryption_state = 'STARTTLS_NEGOTIATION_FAILED' AND h2 % 3 = 2 THEN first_frame + 12 END AS at_alert,
  CASE WHEN tls_established THEN first_frame + 13 END AS at_app_data,
  CASE WHEN cleartext_auth THEN first_frame + 15 END AS at_auth,
  CASE WHEN cleartext_mail THEN first_frame + 16 END AS at_mail,
  CAST(4 + h2 % 9 AS INT) AS event_count,
  CAST(h2 % 101 AS DOUBLE) AS risk_score, h1 = 50 AS is_anomalous,
  CASE WHEN h2 % 101 < 20 THEN 'minimal' WHEN h2 % 101 < 40 THEN 'low' WHEN h2 % 101 < 60 THEN 'medium' WHEN h2 % 101 < 80 THEN 'high' ELSE 'critical' END AS risk_class,
  cert_seen AND h2 % 19 = 0 AS cert_expired,
  cert_seen AND h2 % 19 = 1 AS cert_not_yet_valid,
  cert_seen AND h2 % 19 = 2 AS cert_expiring_soon,
  CAST(CASE WHEN NOT cert_seen OR h2 % 19 IN (0, 1) THEN NULL WHEN h2 % 19 = 2 THEN 1 + h2 % 30 ELSE 100 + h2 END AS INT) AS cert_days_to_expiry,
  CASE WHEN cert_seen AND sni IS NOT NULL THEN h2 % 13 <> 0 END AS cert_hostname_match,
  cert_seen AND h2 % 17 = 0 AS cert_weak_key,
  cert_seen AND h2 % 23 = 0 AS cert_broken_signature,
  cert_seen AND h2 % 29 = 0 AS cert_chain_invalid,
  cert_seen AND h2 % 11 = 1 AS cert_self_signed,
  cert_seen AND h2 % 11 = 2 AS cert_chain_incomplete,
  CASE WHEN cert_seen THEN CASE WHEN nk % 3 = 0 THEN 'EC' ELSE 'RSA' END END AS cert_key_alg,
  CAST(CASE WHEN NOT cert_seen THEN NULL WHEN nk % 3 = 0 THEN CASE WHEN h2 % 17 = 0 THEN 192 ELSE 256 END
       WHEN h2 % 17 = 0 THEN 1024 ELSE 2048 END AS INT) AS cert_key_bits
FROM (
SELECT k, nk, cust, h1, h2, hc, CAST(yr AS BIGINT) AS capture_id, k AS session_id, protocol,
  '10.20.' || CAST(cust % 200 AS STRING) || '.' || CAST(cust AS STRING) AS client_ip,
  CAST(40000 + k % 20000 AS INT) AS client_port,
  '10.10.' || CAST(nk % 5 AS STRING) || '.' || CAST(nk AS STRING) AS server_ip, CAST(port AS INT) AS server_port,
  CASE WHEN encryption_state IN ('IMPLICIT_TLS','TRUNCATED') THEN NULL
       WHEN nk % 6 = 0 THEN 'mx' || CAST(nk AS STRING) || '.example.net ESMTP Postfix 3.7.' || CAST(hc AS STRING)
       WHEN nk % 6 = 1 THEN 'ESMTP Exim 4.96 ready'
       WHEN nk % 6 = 2 THEN 'Dovecot ready.'
       WHEN nk % 6 = 3 THEN 'mail' || CAST(nk AS STRING) || '.example.org Microsoft ESMTP MAIL Service'
       ELSE 'ready' END AS server_banner,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'mx' || CAST(nk AS STRING) || '.example.net' END AS sni,
  CASE WHEN k % 97 = 5 THEN 'payload_signature_port_mismatch' WHEN k % 97 = 6 THEN 'payload_signature_nonstandard_port'
       WHEN encryption_state = 'IMPLICIT_TLS' THEN 'implicit_tls_port' ELSE 'payload_signature' END AS detection_method,
  encryption_state, encryption_state = 'TRUNCATED' AS is_indeterminate,
  encryption_state = 'TRUNCATED' AND h2 % 2 = 0 AS has_gaps,
  NOT (encryption_state = 'TRUNCATED' AND h2 % 3 <> 0) AS session_complete,
  encryption_state IN ('STARTTLS_ADVERTISED_NOT_USED','PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED','STARTTLS_NEGOTIATION_FAILED','TLS_ESTABLISHED') AS upgrade_advertised,
  encryption_state = 'STARTTLS_NOT_ADVERTISED' AND h2 % 2 = 0 AS upgrade_advertised_mangled,
  encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED','STARTTLS_NEGOTIATION_FAILED','TLS_ESTABLISHED') AS upgrade_requested,
  encryption_state = 'TLS_ESTABLISHED' AS upgrade_succeeded,
  encryption_state IN ('IMPLICIT_TLS','TLS_ESTABLISHED') AS tls_established,
  encryption_state IN ('STARTTLS_NOT_ADVERTISED','PLAINTEXT_AFTER_FAILURE') AND h2 % 3 = 0 AS cleartext_auth,
  encryption_state IN ('STARTTLS_NOT_ADVERTISED','PLAINTEXT_AFTER_FAILURE','STARTTLS_ADVERTISED_NOT_USED') AS cleartext_mail,
  tls_version,
  CASE WHEN tls_version IS NULL THEN NULL WHEN tls_version = 'TLS 1.3' THEN 'TLS_AES_256_GCM_SHA384'
       WHEN h2 % 49 = 0 THEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' WHEN h2 % 63 = 0 THEN 'TLS_RSA_WITH_RC4_128_SHA'
       WHEN h2 % 7 = 0 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' WHEN h2 % 11 = 0 THEN 'TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256'
       ELSE 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' END AS cipher_suite,
  CASE WHEN tls_version IS NULL THEN NULL WHEN tls_version = 'TLS 1.3' AND hc < 2 AND nk % 5 = 1 AND yr % 2 = 0 THEN 'X25519MLKEM768'
       WHEN tls_version <> 'TLS 1.3' AND h2 % 7 = 0 THEN NULL ELSE 'x25519' END AS key_group,
  tls_version IS NOT NULL AND hc < 2 AS pqc_offered,
  tls_version IS NOT NULL AND tls_version = 'TLS 1.3' AND hc < 2 AND nk % 5 = 1 AND yr % 2 = 0 AS pqc_selected,
  CASE WHEN tls_version IS NULL THEN NULL WHEN tls_version = 'TLS 1.3' THEN 't130200_1302_' || CAST(nk % 4 AS STRING)
       ELSE 't120300_c02f_' || CAST(nk % 3 AS STRING) END AS ja4s,
  tls_version IS NOT NULL AND tls_version <> 'TLS 1.3' AND k % 4 <> 0 AS cert_observable,
  tls_version IS NOT NULL AND tls_version <> 'TLS 1.3' AND k % 4 <> 0 AS cert_seen,
  CASE WHEN tls_version IS NULL THEN NULL ELSE CAST(h2 AS DOUBLE) / 8 END AS handshake_ms,
  k * 40 + 1 AS first_frame, k * 40 + 20 + h1 % 20 AS last_frame,
  CAST(k AS DOUBLE) * CAST(37.5 AS DOUBLE) AS start_time,
  CAST(k AS DOUBLE) * CAST(37.5 AS DOUBLE) + CAST(h2 AS DOUBLE) / 4 AS end_time
FROM (
SELECT *, CASE WHEN encryption_state NOT IN ('IMPLICIT_TLS', 'TLS_ESTABLISHED') THEN NULL
       WHEN nk % 5 = 0 THEN CASE WHEN h2 < 850 THEN 'TLS 1.2' WHEN h2 < 950 THEN 'TLS 1.3' WHEN h2 < 985 THEN 'TLS 1.0' ELSE 'SSL 3.0' END
       ELSE CASE WHEN h2 < 900 THEN 'TLS 1.3' WHEN h2 < 980 THEN 'TLS 1.2' ELSE 'TLS 1.1' END END AS tls_version
FROM (
SELECT *, CASE WHEN port IN (25, 465, 587) THEN 'SMTP' WHEN port IN (143, 993) THEN 'IMAP' ELSE 'POP3' END AS protocol,
    CASE WHEN h1 < 4 THEN 'TRUNCATED' WHEN port IN (465, 993) THEN 'IMPLICIT_TLS'
         WHEN h1 < 8 THEN 'STARTTLS_NOT_ADVERTISED' WHEN h1 < 11 THEN 'STARTTLS_ADVERTISED_NOT_USED'
         WHEN h1 < 13 THEN 'PLAINTEXT_AFTER_FAILURE' WHEN h1 < 14 THEN 'STARTTLS_REJECTED'
         WHEN h1 < 16 THEN 'STARTTLS_NEGOTIATION_FAILED' WHEN h1 < 17 THEN 'PLAINTEXT_THROUGHOUT'
         ELSE 'TLS_ESTABLISHED' END AS encryption_state
FROM (
SELECT o_orderkey AS k, o_custkey AS cust, c_nationkey AS nk,
         (o_orderkey * 7919 + 13) % 100 AS h1, (o_orderkey * 104729 + 7) % 1000 AS h2,
         (o_custkey * 31 + 5) % 10 AS hc, year(o_orderdate) AS yr,
         CASE o_orderkey % 8 WHEN 0 THEN 587 WHEN 1 THEN 587 WHEN 2 THEN 587 WHEN 3 THEN 25
              WHEN 4 THEN 143 WHEN 5 THEN 110 WHEN 6 THEN 993 ELSE 465 END AS port
FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey) b) s) t) u
"""

# One packet per event: a stream per (capture, user).
PACKETS = """
SELECT user_id % 5 AS capture_id, user_id AS stream, event_id AS frame,
  CASE WHEN event_id % 3 = 0 THEN '10.1.0.' || CAST(user_id % 250 AS STRING) ELSE '10.9.0.' || CAST(user_id % 250 AS STRING) END AS src_ip,
  CAST(CASE WHEN event_id % 3 = 0 THEN srv ELSE 40000 + user_id END AS INT) AS src_port,
  CASE WHEN event_id % 3 = 0 THEN '10.9.0.' || CAST(user_id % 250 AS STRING) ELSE '10.1.0.' || CAST(user_id % 250 AS STRING) END AS dst_ip,
  CAST(CASE WHEN event_id % 3 = 0 THEN 40000 + user_id ELSE srv END AS INT) AS dst_port,
  CAST(floor(coalesce(value, 0)) AS INT) AS tcp_len,
  event_type = 'signup' AND event_id % 3 <> 0 AND user_id % 4 <> 0 AS syn,
  event_type = 'error' AND user_id % 5 <> 0 AS fin,
  event_type = 'purchase' AND user_id % 7 = 0 AS rst,
  ts
FROM (SELECT *, CASE user_id % 8 WHEN 0 THEN 587 WHEN 1 THEN 25 WHEN 2 THEN 143 WHEN 3 THEN 110 WHEN 4 THEN 993
        WHEN 5 THEN 465 WHEN 6 THEN 8025 ELSE 50000 END AS srv FROM {events}) e
"""

# One payload segment per line item: a flow per order, one direction per return flag.
SEGMENTS = """
SELECT l_orderkey AS flow, l_returnflag AS dir, l_linenumber * 20 AS seq, CAST(l_quantity AS INT) AS len,
  l_partkey * 128 + l_suppkey AS frame
FROM {lineitem}
"""

# Plaintext dialogue of every non-implicit session: a fixed handful of lines each.


def _line(direction: str, frame: int, text: str, cond: str) -> tuple[str, int, str, str]:
    return direction, frame, text, f"encryption_state <> 'IMPLICIT_TLS' AND {cond}"


_OPEN = "encryption_state <> 'TRUNCATED'"
_USER = "CASE h2 % 3 WHEN 0 THEN 'YWxpY2VAY29ycC5sb2NhbA==' WHEN 1 THEN 'Ym9iQGNvcnAubG9jYWw=' ELSE 'cm9vdA==' END"
_PLAIN = "CASE h2 % 3 WHEN 0 THEN 'AGFsaWNlQGNvcnAubG9jYWwAczNjcmV0' WHEN 1 THEN 'AGJvYkBjb3JwLmxvY2FsAHB3' ELSE 'AHJvb3QAdG9vcg==' END"
_LINE_SPECS = [
    # SMTP
    _line("s2c", 3, "'220 ' || coalesce(server_banner, 'ready')", f"protocol = 'SMTP' AND {_OPEN}"),
    _line("c2s", 4, "'EHLO client' || CAST(cust AS STRING)", f"protocol = 'SMTP' AND {_OPEN}"),
    _line("s2c", 6, "CASE WHEN upgrade_advertised THEN '250-STARTTLS' WHEN upgrade_advertised_mangled THEN '250-XXXXXXXA' ELSE '250-SIZE 1024' END", f"protocol = 'SMTP' AND {_OPEN}"),
    _line("s2c", 7, "'250 AUTH PLAIN LOGIN'", f"protocol = 'SMTP' AND {_OPEN}"),
    _line("c2s", 8, "'STARTTLS'", "protocol = 'SMTP' AND upgrade_requested"),
    _line("s2c", 9, "CASE WHEN encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED') THEN '454 TLS not available' ELSE '220 Ready to start TLS' END", "protocol = 'SMTP' AND upgrade_requested"),
    _line("c2s", 15, f"CASE WHEN h2 % 2 = 0 THEN 'AUTH PLAIN ' || {_PLAIN} ELSE 'AUTH LOGIN' END", "protocol = 'SMTP' AND cleartext_auth"),
    _line("s2c", 16, "'334 VXNlcm5hbWU6'", "protocol = 'SMTP' AND cleartext_auth AND h2 % 2 = 1"),
    _line("c2s", 17, _USER, "protocol = 'SMTP' AND cleartext_auth AND h2 % 2 = 1"),
    _line("s2c", 18, "'334 UGFzc3dvcmQ6'", "protocol = 'SMTP' AND cleartext_auth AND h2 % 2 = 1"),
    _line("c2s", 19, "'czNjcmV0'", "protocol = 'SMTP' AND cleartext_auth AND h2 % 2 = 1"),
    _line("s2c", 20, "CASE WHEN h2 % 5 = 0 THEN '535 denied' ELSE '235 welcome' END", "protocol = 'SMTP' AND cleartext_auth"),
    _line("c2s", 21, "'MAIL FROM:<a@corp.local>'", "protocol = 'SMTP' AND cleartext_mail"),
    _line("s2c", 22, "'502 not implemented'", "protocol = 'SMTP' AND cleartext_mail"),
    _line("c2s", 23, "'QUIT'", f"protocol = 'SMTP' AND {_OPEN}"),
    # IMAP
    _line("s2c", 3, "'* OK ' || coalesce(server_banner, 'ready')", f"protocol = 'IMAP' AND {_OPEN}"),
    _line("c2s", 4, "'a001 CAPABILITY'", f"protocol = 'IMAP' AND {_OPEN}"),
    _line("s2c", 6, "CASE WHEN upgrade_advertised THEN '* CAPABILITY IMAP4rev1 STARTTLS LOGINDISABLED' ELSE '* CAPABILITY IMAP4rev1 AUTH=PLAIN' END", f"protocol = 'IMAP' AND {_OPEN}"),
    _line("c2s", 8, "'a002 STARTTLS'", "protocol = 'IMAP' AND upgrade_requested"),
    _line("s2c", 9, "CASE WHEN encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED') THEN 'a002 NO later' ELSE 'a002 OK begin TLS' END", "protocol = 'IMAP' AND upgrade_requested"),
    _line("c2s", 15, "CASE WHEN h2 % 2 = 0 THEN 'a003 LOGIN \"alice@corp.local\" \"s3cret\"' ELSE 'a003 AUTHENTICATE PLAIN' END", "protocol = 'IMAP' AND cleartext_auth"),
    _line("c2s", 16, _USER, "protocol = 'IMAP' AND cleartext_auth AND h2 % 2 = 1"),
    _line("c2s", 17, "'a004 SELECT INBOX'", "protocol = 'IMAP' AND cleartext_mail"),
    _line("c2s", 23, "'a009 LOGOUT'", f"protocol = 'IMAP' AND {_OPEN}"),
    # POP3
    _line("s2c", 3, "'+OK ' || coalesce(server_banner, 'ready')", f"protocol = 'POP3' AND {_OPEN}"),
    _line("c2s", 4, "'CAPA'", f"protocol = 'POP3' AND {_OPEN}"),
    _line("s2c", 5, "'+OK Capability list follows'", f"protocol = 'POP3' AND {_OPEN}"),
    _line("s2c", 6, "CASE WHEN upgrade_advertised THEN 'STLS' ELSE 'UIDL' END", f"protocol = 'POP3' AND {_OPEN}"),
    _line("s2c", 7, "'.'", f"protocol = 'POP3' AND {_OPEN}"),
    _line("c2s", 8, "'STLS'", "protocol = 'POP3' AND upgrade_requested"),
    _line("s2c", 9, "CASE WHEN encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED') THEN '-ERR no' ELSE '+OK begin TLS' END", "protocol = 'POP3' AND upgrade_requested"),
    _line("c2s", 15, "'USER bob@corp.local'", "protocol = 'POP3' AND cleartext_auth"),
    _line("c2s", 16, "'PASS hunter2'", "protocol = 'POP3' AND cleartext_auth"),
    _line("c2s", 17, "'STAT'", "protocol = 'POP3' AND cleartext_mail"),
    _line("c2s", 23, "'QUIT'", f"protocol = 'POP3' AND {_OPEN}"),
]

LINES = "\nUNION ALL ".join(
    f"SELECT capture_id, session_id AS flow, protocol, '{d}' AS dir, first_frame + {f} AS frame, "
    f"CAST({f * 60} AS BIGINT) AS line_offset, {text} AS text FROM sess WHERE {cond}"
    for d, f, text, cond in _LINE_SPECS
)


def _listed(specs: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(f"CASE WHEN {cond} THEN {row} END" for cond, row in specs) + ")"


# The same rows from one scan: Spark explodes the lines of a session instead of uniting 35 scans. The list is a column of
# its own and its gaps are dropped afterwards: expressions in a generator or a lambda are interpreted, and `explode` would filter by the list first.
def _lines_of(protocol: str) -> str:
    return _listed([
        (cond, f"named_struct('dir', '{d}', 'frame', first_frame + {f}, 'line_offset', CAST({f * 60} AS BIGINT), 'text', {text})")
        for d, f, text, cond in _LINE_SPECS if f"protocol = '{protocol}'" in cond
    ])


_LINES_ONE_SCAN = (
    "SELECT capture_id, flow, protocol, l.* FROM (SELECT capture_id, flow, protocol, explode_outer(ls) AS l FROM (SELECT capture_id, session_id AS flow, protocol, "
    + f"CASE protocol WHEN 'SMTP' THEN {_lines_of('SMTP')} WHEN 'IMAP' THEN {_lines_of('IMAP')} ELSE {_lines_of('POP3')} END AS ls FROM sess)) WHERE l IS NOT NULL"
)

# TLS record events of every session that shows any.
_TLS_SPECS = [
    ("c2s", "at_client_hello", 600, "tls_client_hello"),
    ("s2c", "at_server_hello", 660, "tls_server_hello"),
    ("s2c", "at_alert", 700, "tls_alert"),
    ("c2s", "at_app_data", 720, "tls_application_data"),
    ("s2c", "at_app_data + 1", 780, "tls_application_data"),
    ("c2s", "at_app_data + 2", 840, "tls_application_data"),
]
TLS_EVENTS = "\nUNION ALL ".join(
    f"SELECT capture_id, session_id AS flow, '{d}' AS dir, {at} AS frame, CAST({off} AS BIGINT) AS line_offset, '{kind}' AS kind "
    f"FROM sess WHERE {at} IS NOT NULL"
    for d, at, off, kind in _TLS_SPECS
)
_TLS_ONE_SCAN = (
    "SELECT capture_id, flow, l.* FROM (SELECT capture_id, flow, explode_outer(ls) AS l FROM (SELECT capture_id, session_id AS flow, "
    + _listed([(f"{at} IS NOT NULL", f"named_struct('dir', '{d}', 'frame', {at}, 'line_offset', CAST({off} AS BIGINT), 'kind', '{kind}')") for d, at, off, kind in _TLS_SPECS])
    + " AS ls FROM sess)) WHERE l IS NOT NULL"
)

# Decoded handshake of every TLS session; lists are comma separated integers.
HELLO = """
SELECT capture_id, session_id, client_ip, sni, 771 AS legacy_version,
  CASE WHEN tls_version = 'TLS 1.3' THEN '772,771' WHEN hc < 3 THEN '771,770,769' ELSE '771' END AS versions,
  CASE WHEN k % 4 = 0 THEN '2570,' WHEN k % 4 = 1 THEN '6682,' ELSE '' END || CASE WHEN hc < 5 THEN '4865,4866,4867,49199,49200' ELSE '4866,4865,49200,49199,47' END AS suites,
  CASE WHEN k % 4 = 0 THEN '2570,' ELSE '' END || CASE WHEN hc < 5 THEN '0,23,65281,10,11,35,16,5,13,18,51,45,43' ELSE '0,10,11,13,43,51' END AS exts,
  CASE WHEN k % 4 = 0 THEN '2570,' ELSE '' END || CASE WHEN pqc_offered THEN '4588,29,23,24' WHEN hc < 5 THEN '29,23,24' ELSE '29,23,256' END AS grps,
  '0' AS point_formats,
  CASE WHEN hc = 9 THEN '' ELSE '1027,2052,1025,1283' END AS sig_algs,
  CASE WHEN hc % 3 = 0 THEN 'smtp' WHEN hc % 3 = 1 THEN 'h' ELSE NULL END AS alpn,
  CASE tls_version WHEN 'TLS 1.3' THEN 772 WHEN 'TLS 1.2' THEN 771 WHEN 'TLS 1.1' THEN 770 WHEN 'TLS 1.0' THEN 769 ELSE 768 END AS s_version,
  CASE cipher_suite WHEN 'TLS_AES_256_GCM_SHA384' THEN 4866 WHEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' THEN 10 WHEN 'TLS_RSA_WITH_RC4_128_SHA' THEN 5
       WHEN 'TLS_RSA_WITH_AES_128_CBC_SHA' THEN 47 WHEN 'TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256' THEN 49191 ELSE 49199 END AS s_suite,
  CASE key_group WHEN 'X25519MLKEM768' THEN 4588 WHEN 'x25519' THEN 29 END AS s_group,
  CASE WHEN tls_version = 'TLS 1.3' THEN '43,51' ELSE '65281,11,35' END AS s_exts,
  CASE WHEN hc % 3 = 0 THEN 'smtp' ELSE NULL END AS s_alpn,
  start_time AS c_ts, start_time + CAST(h2 AS DOUBLE) / 8000 AS s_ts
FROM sess WHERE tls_version IS NOT NULL
"""

# DNS traffic: one message per order, its kind chosen by the order key.
DNS = """
SELECT capture_id, k * 40 AS frame, rk % 2 = 1 AS is_response,
  CASE kind WHEN 0 THEN '_mta-sts.' || dom WHEN 1 THEN '_smtp._tls.' || dom WHEN 2 THEN '_dmarc.' || dom
            WHEN 3 THEN '_25._tcp.' || host WHEN 4 THEN dom WHEN 5 THEN dom WHEN 6 THEN dom WHEN 7 THEN host ELSE host END AS qname,
  CAST(CASE kind WHEN 3 THEN 52 WHEN 4 THEN 15 WHEN 5 THEN 15 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 16 END AS INT) AS qtype,
  CAST(CASE WHEN h2 % 10 = 0 THEN 3 ELSE 0 END AS INT) AS rcode,
  CASE WHEN rk % 2 = 0 OR h2 % 10 = 0 THEN NULL
       WHEN kind = 0 THEN CASE WHEN h2 % 3 = 0 THEN 'v=STSv1; id=' || CAST(h2 AS STRING) || ';' WHEN h2 % 3 = 1 THEN 'V = stsv1' ELSE 'junk' END
       WHEN kind = 1 THEN CASE WHEN h2 % 2 = 0 THEN 'v=TLSRPTv1; rua=mailto:a@b.c' ELSE 'nothing' END
       WHEN kind = 2 THEN CASE WHEN h2 % 4 = 0 THEN 'v=DMARC1; p=none' WHEN h2 % 4 = 1 THEN 'v=DMARC1; p=Reject' ELSE 'x' END
       WHEN kind = 6 THEN CASE WHEN h2 % 2 = 0 THEN 'v=spf1 mx ~all' ELSE 'google-site=1' END END AS txt,
  CASE WHEN rk % 2 = 1 AND kind IN (4, 5) THEN 'MX' || CAST(nk AS STRING) || '.example.net.,backup.' || dom || '.' END AS mx,
  CASE WHEN rk % 2 = 1 AND kind IN (7, 8) THEN '10.10.' || CAST(nk % 5 AS STRING) || '.' || CAST(nk AS STRING) END AS addresses,
  CAST(CASE WHEN rk % 2 = 1 AND h2 % 10 > 4 THEN 1 ELSE 0 END AS INT) AS answer_count
FROM (SELECT *, k % 9 AS kind, CAST(floor(k / 9) AS BIGINT) AS rk,
        'd' || CAST(cust % 20 AS STRING) || '.example' AS dom, 'mx' || CAST(nk AS STRING) || '.example.net' AS host FROM sess) d
"""

# Certificates of the sessions that show one: leaf, then up to two issuers.
CERTS = """
SELECT capture_id, session_id, CAST(0 AS INT) AS idx, 'CN=' || host AS subject, host AS subject_cn,
  CASE WHEN h2 % 11 = 1 THEN 'CN=' || host ELSE 'CN=Issuing CA ' || CAST(nk % 4 AS STRING) END AS issuer,
  t0 + (h2 % 40 - 35) * 864000 AS not_before, t0 + (h2 % 40 - 5) * 864000 AS not_after,
  CASE WHEN nk % 3 = 0 THEN 'EC' ELSE 'RSA' END AS key_alg, CAST(CASE WHEN nk % 3 = 0 THEN 256 WHEN h2 % 17 = 0 THEN 1024 ELSE 2048 END AS INT) AS key_bits,
  CASE WHEN h2 % 23 = 0 THEN 'sha1WithRSAEncryption' WHEN h2 % 23 = 1 THEN 'md5WithRSAEncryption' ELSE 'sha256WithRSAEncryption' END AS sig_alg,
  CASE WHEN h2 % 7 = 0 THEN '' WHEN h2 % 7 = 1 THEN '*.example.net' WHEN h2 % 7 = 2 THEN 'other.example.org,*.net' ELSE host END AS san,
  false AS is_ca, 'leaf' || CAST(k AS STRING) AS sha256, CAST(NULL AS BOOLEAN) AS link_verified, t0 AS capture_ts, sni AS hostname
FROM chains
UNION ALL
SELECT capture_id, session_id, CAST(1 AS INT), 'CN=Issuing CA ' || CAST((nk + CASE WHEN h2 % 29 = 0 THEN 1 ELSE 0 END) % 4 AS STRING), 'Issuing CA',
  CASE WHEN h2 % 2 = 0 THEN 'CN=Root ' || CAST(nk % 2 AS STRING) ELSE 'CN=Unknown Root' END,
  t0 - 86400000, CASE WHEN h2 % 31 = 0 THEN t0 - 86400 ELSE t0 + 86400000 END, 'RSA', CAST(4096 AS INT), 'sha256WithRSAEncryption', '',
  h2 % 37 <> 0, 'ica' || CAST(nk % 4 AS STRING), h2 % 41 <> 0, t0, CAST(NULL AS STRING)
FROM chains WHERE h2 % 11 NOT IN (1, 2)
UNION ALL
SELECT capture_id, session_id, CAST(2 AS INT), CASE WHEN h2 % 2 = 0 THEN 'CN=Root ' || CAST(nk % 2 AS STRING) ELSE 'CN=Unknown Root' END, 'Root',
  CASE WHEN h2 % 2 = 0 THEN 'CN=Root ' || CAST(nk % 2 AS STRING) ELSE 'CN=Unknown Root' END,
  t0 - 864000000, t0 + 864000000, 'RSA', CAST(4096 AS INT), 'sha256WithRSAEncryption', '',
  true, 'root' || CAST(nk % 2 AS STRING) || CAST(h2 % 2 AS STRING), true, t0, CAST(NULL AS STRING)
FROM chains WHERE h2 % 11 NOT IN (1, 2) AND h2 % 4 < 2
"""
CHAINS = "SELECT k, nk, h2, capture_id, session_id, sni, 'mx' || CAST(nk AS STRING) || '.example.net' AS host, 1700000000 + (k % 1000) * 3600 AS t0 FROM sess WHERE cert_seen"

# Trust store: one root per nation, half of them of the enterprise.
ROOTS = """
SELECT 'CN=Root ' || CAST(n_nationkey % 8 * 2 AS STRING) AS subject, 'root' || CAST(n_nationkey AS STRING) || '0' AS sha256,
  CASE WHEN n_nationkey % 3 = 0 THEN 'enterprise' ELSE 'public' END AS source, n_nationkey AS store_order FROM {nation}
"""

_DEPS = {"lines": ["sess"], "tls_events": ["sess"], "hello": ["sess"], "dns": ["sess"], "chains": ["sess"], "certs": ["chains"]}
_TEXT = {
    "sess": SESS,
    "packets": PACKETS,
    "segments": SEGMENTS,
    "lines": LINES,
    "tls_events": TLS_EVENTS,
    "hello": HELLO,
    "dns": DNS,
    "chains": CHAINS,
    "certs": CERTS,
    "roots": ROOTS,
}
_ONE_SCAN = {"lines": _LINES_ONE_SCAN, "tls_events": _TLS_ONE_SCAN}
_TABLES = ("orders", "customer", "events", "lineitem", "nation")


def duck(*names: str) -> str:
    """`WITH` clause body defining the named views (and what they rest on) for the oracle."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPS.get(name, []):
            add(dep)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    text = ", ".join(f"{n} AS ({_TEXT[n]})" for n in done)
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def text(name: str) -> str:
    """SQL of one view, for an oracle that defines what it rests on itself."""
    return _TEXT[name]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a lazy DataFrame over the tables in `sf_dir`."""
    text = _ONE_SCAN.get(name, _TEXT[name])
    frames = {t: load(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    for dep in _DEPS.get(name, []):
        text = text.replace(f"FROM {dep}", "FROM {" + dep + "}")
        frames[dep] = view(spark, sf_dir, dep)
    return spark.sql(text, **frames)
