"""Queries over packets, segments, dialogues, handshakes, certificates and DNS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.functions import text as words
from postern.functions.scores import text
from postern.operators import browse, certs, dialogue, dnsaudit, flows, fsm, grading, graph, reassembly, rules, sessions, tls
from postern.plans.catalog import query
from postern.plans.oracle_parts import part, sql
from postern.plans.views import load, view
from postern.sources import readers
from postern.sources.readers import dedup_first
from postern.session import stage


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    day = F.date_diff(F.col(ts), F.to_date(F.lit("1970-01-01"))).cast("bigint")
    secs = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return secs * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def packets(spark, sf):
    return view(spark, sf, "packets").withColumn("ts", epoch_us("ts"))


# ---- flows -------------------------------------------------------------------------------------------
part(
    "flw",
    ["packets"],
    """SELECT capture_id, stream, count(*) AS packets, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(epoch_us(ts), frame) AS start_time, max(epoch_us(ts)) AS end_time,
 bool_or(syn) AS saw_syn, bool_or(fin) AS saw_fin, bool_or(rst) AS saw_rst,
 CASE WHEN bool_or(syn) THEN arg_min(src_ip, frame) FILTER (syn) ELSE CASE WHEN c THEN any_value(o.src_ip) ELSE any_value(o.dst_ip) END END AS client_ip,
 CASE WHEN bool_or(syn) THEN arg_min(src_port, frame) FILTER (syn) ELSE CASE WHEN c THEN any_value(o.src_port) ELSE any_value(o.dst_port) END END AS client_port,
 CASE WHEN bool_or(syn) THEN arg_min(dst_ip, frame) FILTER (syn) ELSE CASE WHEN c THEN any_value(o.dst_ip) ELSE any_value(o.src_ip) END END AS server_ip,
 CASE WHEN bool_or(syn) THEN arg_min(dst_port, frame) FILTER (syn) ELSE CASE WHEN c THEN any_value(o.dst_port) ELSE any_value(o.src_port) END END AS server_port
FROM packets p JOIN (SELECT capture_id, stream, src_ip, src_port, dst_ip, dst_port, CASE WHEN dst_port IN (25,587,2525,110,143,465,993,995) AND src_port NOT IN (25,587,2525,110,143,465,993,995) THEN true
  WHEN src_port IN (25,587,2525,110,143,465,993,995) AND dst_port NOT IN (25,587,2525,110,143,465,993,995) THEN false ELSE src_port >= dst_port END AS c
  FROM packets QUALIFY row_number() OVER (PARTITION BY capture_id, stream ORDER BY frame) = 1) o USING (capture_id, stream) GROUP BY capture_id, stream, c""".replace("arg_min(src_ip", "arg_min(p.src_ip").replace("arg_min(src_port", "arg_min(p.src_port").replace("arg_min(dst_ip", "arg_min(p.dst_ip").replace("arg_min(dst_port", "arg_min(p.dst_port"),
)


@query("flow_index", "F-1 F-2 D-10", sql(["flw"], "SELECT *, NOT saw_syn AS mid_session, (saw_fin OR saw_rst) AND saw_syn AS complete FROM flw"))
def flow_index(spark, sf):
    out = flows.index_flows(packets(spark, sf)).drop("bytes_c2s", "bytes_s2c")
    return out.withColumn("complete", sessions.complete(F.col("saw_syn"), F.col("saw_fin"), F.col("saw_rst")))


@query(
    "flow_bytes",
    "F-3",
    sql(
        ["packets", "flw"],
        """SELECT capture_id, stream, CAST(coalesce(sum(tcp_len) FILTER (src_ip = client_ip AND src_port = client_port), 0) AS BIGINT) AS bytes_c2s, CAST(coalesce(sum(tcp_len) FILTER (NOT (src_ip = client_ip AND src_port = client_port)), 0) AS BIGINT) AS bytes_s2c
FROM packets JOIN flw USING (capture_id, stream) GROUP BY 1, 2""",
    ),
)
def flow_bytes(spark, sf):
    return flows.index_flows(packets(spark, sf)).select("capture_id", "stream", "bytes_c2s", "bytes_s2c")


@query(
    "candidate_flows",
    "F-4",
    sql(
        ["flw"],
        """SELECT capture_id, stream, server_port, CASE WHEN server_port IN (25,587,2525,465) THEN 'SMTP' WHEN server_port IN (143,993) THEN 'IMAP' WHEN server_port IN (110,995) THEN 'POP3' END AS port_protocol,
 server_port IN (25,587,2525,110,143,465,993,995) AS is_candidate FROM flw""",
    ),
)
def candidate_flows(spark, sf):
    return flows.candidates(flows.index_flows(packets(spark, sf))).select("capture_id", "stream", "server_port", "port_protocol", "is_candidate")


@query(
    "greeting_probe",
    "F-5",
    sql(
        ["lines"],
        """SELECT capture_id, flow AS stream, CASE WHEN t LIKE '220 %' OR t LIKE '220-%' THEN 'SMTP' WHEN t LIKE '* OK%' OR t LIKE '* PREAUTH%' THEN 'IMAP' WHEN t LIKE '+OK%' THEN 'POP3' END AS port_protocol
FROM (SELECT capture_id, flow, arg_min(text, frame) AS t FROM lines GROUP BY 1, 2) x WHERE port_protocol IS NOT NULL""",
    ),
)
def greeting_probe(spark, sf):
    segs = view(spark, sf, "lines").select("capture_id", F.col("flow").alias("stream"), "frame", F.col("text").alias("payload"))
    fl = segs.groupBy("capture_id", "stream").agg(F.lit(1).alias("bytes_s2c"))
    fl = fl.withColumn("is_candidate", F.lit(False)).withColumn("port_protocol", F.lit(None).cast("string"))
    return flows.probe(fl, segs).select("capture_id", "stream", "port_protocol")


@query(
    "conversation_openings",
    "F-5",
    "SELECT conv_id, arg_min(text, turn) AS opening, CASE WHEN starts_with(arg_min(text, turn), '+OK') THEN 'POP3' END AS protocol FROM conversations GROUP BY 1",
)
def conversation_openings(spark, sf):
    return flows.openings(load(spark, sf, "conversations"), ["conv_id"], "text", "turn").withColumn("protocol", flows.signature(F.col("opening")))


@query(
    "capture_statistics",
    "IO-3",
    sql(
        ["packets"],
        """SELECT capture_id, count(*) AS packet_count, CAST(sum(tcp_len) AS BIGINT) AS data_bytes, min(us) AS first_packet_at, max(us) AS last_packet_at, bool_and(us >= prev OR prev IS NULL) AS strict_time_order
FROM (SELECT capture_id, tcp_len, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY capture_id ORDER BY frame) AS prev FROM packets) x GROUP BY 1""",
    ),
)
def capture_statistics(spark, sf):
    return flows.capture_stats(packets(spark, sf))


@query(
    "capture_metadata",
    "IO-3",
    sql(
        ["packets"],
        """SELECT capture_id, CASE capture_id % 3 WHEN 0 THEN 96 WHEN 1 THEN 262144 END AS snaplen, count(*) AS packet_count, CAST(sum(tcp_len) AS BIGINT) AS data_bytes, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us, capture_id % 3 = 0 AS snaplen_truncated FROM packets GROUP BY 1""",
    ),
)
def capture_metadata(spark, sf):
    p = stage(packets(spark, sf))
    k = F.col("capture_id") % 3
    manifest = p.select("capture_id").distinct().withColumn("snaplen", F.when(k == 0, 96).when(k == 1, 262144))
    return flows.capture_meta(p, manifest).select("capture_id", "snaplen", "packet_count", "data_bytes", F.col("duration").alias("duration_us"), "snaplen_truncated")


_TARGETS = "SELECT capture_id, frame AS target, stream, greatest(frame - 400, 0) AS first_frame, frame + 400 AS last_frame FROM packets WHERE rst"


@query(
    "evidence_slices",
    "IO-9",
    sql(
        ["packets"],
        f""", t AS ({_TARGETS}), b AS (SELECT p.capture_id, target, p.frame // 65536 AS blk, count(*) AS n, sum(tcp_len) AS bytes, sha256(string_agg(CAST(p.frame AS VARCHAR), ',' ORDER BY p.frame)) AS h FROM t JOIN packets p ON p.capture_id = t.capture_id AND p.stream = t.stream AND p.frame BETWEEN t.first_frame AND t.last_frame GROUP BY 1, 2, 3)
SELECT capture_id, target, CAST(sum(n) AS BIGINT) AS frame_count, CAST(sum(bytes) AS BIGINT) AS size_bytes, sha256(string_agg(h, '' ORDER BY blk)) AS digest FROM b GROUP BY 1, 2""",
    ).replace(" , t AS", ", t AS"),
)
def evidence_slices(spark, sf):
    p = packets(spark, sf)
    t = p.where("rst").select("capture_id", F.col("frame").alias("target"), "stream", F.greatest(F.col("frame") - 400, F.lit(0)).alias("first_frame"), (F.col("frame") + 400).alias("last_frame"))
    return flows.slice_manifest(flows.evidence_slice(p, t))


@query(
    "protocol_identity",
    "D-6",
    sql(
        ["sess"],
        """SELECT capture_id, session_id, CASE WHEN encryption_state = 'TRUNCATED' THEN CASE session_id % 11 WHEN 3 THEN NULL WHEN 4 THEN 'SMTP' ELSE protocol END
  WHEN encryption_state = 'IMPLICIT_TLS' AND session_id % 11 IN (3, 4) THEN NULL ELSE protocol END AS protocol,
 CASE WHEN encryption_state = 'IMPLICIT_TLS' THEN CASE WHEN session_id % 11 IN (3, 4) THEN 'tls_on_unknown_port' ELSE 'implicit_tls_port' END
  WHEN encryption_state = 'TRUNCATED' THEN CASE WHEN session_id % 11 = 3 THEN 'undetected' ELSE 'port_only' END
  WHEN session_id % 11 = 3 THEN 'payload_signature_nonstandard_port' WHEN session_id % 11 = 4 AND protocol <> 'SMTP' THEN 'payload_signature_port_mismatch' ELSE 'payload_signature' END AS detection_method
FROM sess""",
    ),
)
def protocol_identity(spark, sf):
    s = view(spark, sf, "sess")
    k = F.col("session_id") % 11
    moved = s.withColumn("server_port", F.when(k == 3, F.lit(8025)).when(k == 4, F.lit(2525)).otherwise(F.col("server_port")))
    first = view(spark, sf, "lines").where("dir = 's2c'").groupBy("capture_id", F.col("flow").alias("session_id")).agg(F.min_by("text", "frame").alias("opening"))
    rows = moved.drop("protocol", "detection_method").join(first, ["capture_id", "session_id"], "left").withColumn("tls_first", F.col("encryption_state") == "IMPLICIT_TLS")
    return flows.protocol_of(rows).select("capture_id", "session_id", "protocol", "detection_method")


# ---- decoded text --------------------------------------------------------------------------------------
def _line(*fields) -> Column:
    """A line as the dissector prints it: fields as text between tabs, flags as 1 and 0."""
    return F.concat_ws("\t", *[f.cast("string") for f in fields])


@query("parsed_packets", "IO-4", sql(["packets"], "SELECT capture_id, stream, frame, CAST(epoch_us(ts) AS DOUBLE) AS ts, src_ip, src_port, dst_ip, dst_port, tcp_len, syn, fin, rst FROM packets"))
def parsed_packets(spark, sf):
    p, c, none = packets(spark, sf), F.col, F.lit("")
    v6 = c("frame") % 2 == 0  # the address may stand in either column
    pair = lambda a: (F.when(v6, none).otherwise(c(a)), F.when(v6, c(a)).otherwise(none))
    line = _line(c("frame"), c("ts"), c("stream"), *pair("src_ip"), c("src_port"), *pair("dst_ip"), c("dst_port"), c("tcp_len"), *[c(x).cast("int") for x in ("syn", "fin", "rst")])
    return readers.parse_packets(p.select("capture_id", line.alias("value")), c("capture_id"))


@query(
    "parsed_segments",
    "IO-5",
    "SELECT doc_id AS stream, doc_id AS frame, CAST(length(text) AS BIGINT) AS seq, CAST(octet_length(encode(text)) AS BIGINT) AS octets, sha256(text) AS sha256 FROM documents WHERE length(text) > 0",
)
def parsed_segments(spark, sf):
    c = F.col
    payload = F.regexp_replace(F.lower(F.hex(F.encode("text", "UTF-8"))), "(..)(?=.)", "$1:")
    line = _line(c("doc_id"), F.lit(0), c("doc_id"), F.lit("10.0.0.1"), F.lit(""), F.lit(25), F.lit("10.0.0.2"), F.lit(""), F.lit(4000), F.length("text"), F.lit(0), payload)
    found = readers.parse_segments(load(spark, sf, "documents").select(line.alias("value")))
    return found.select("stream", "frame", "seq", F.length("payload").cast("bigint").alias("octets"), F.sha2("payload", 256).alias("sha256"))


_VALUES = "array_to_string(list_filter(string_split(coalesce({c}, ''), ','), lambda x: x <> ''), '|')"
_NAMES = "array_to_string(list_transform(list_filter(string_split(coalesce(mx, ''), ','), lambda x: x <> ''), lambda x: rtrim(lower(x), '.')), '|')"


@query(
    "parsed_dns",
    "IO-6",
    sql(
        ["dns"],
        "SELECT capture_id, frame, is_response, qname, qtype, rcode, " + f"{_VALUES.format(c='txt')} AS txt, {_NAMES} AS mx, {_VALUES.format(c='addresses')} AS addresses" + ", answer_count FROM dns",
    ),
)
def parsed_dns(spark, sf):
    c = F.col
    many = lambda name: F.coalesce(c(name), F.lit(""))
    line = _line(c("frame"), F.lit(0), c("is_response").cast("int"), F.concat(F.upper("qname"), F.lit(".")), c("qtype"), c("rcode"), many("txt"), F.upper(many("mx")), many("addresses"), c("answer_count"))
    found = readers.parse_dns(view(spark, sf, "dns").select("capture_id", line.alias("value")), c("capture_id"))
    return found.select("capture_id", "frame", "is_response", "qname", "qtype", "rcode", *[F.array_join(x, "|").alias(x) for x in ("txt", "mx", "addresses")], "answer_count")


# ---- reassembly -----------------------------------------------------------------------------------------
KEY = ["flow", "dir"]
part("sg", ["segments"], "SELECT flow, dir, seq, len, min(frame) AS frame FROM segments GROUP BY 1, 2, 3, 4")
part(
    "rng",
    ["sg"],
    """SELECT *, greatest(seq, coalesce(cov, seq)) AS new_from, seq + len - greatest(seq, coalesce(cov, seq)) AS new_len, greatest(0, seq - coalesce(cov, seq)) AS hole FROM (
 SELECT *, max(seq + len) OVER (PARTITION BY flow, dir ORDER BY seq, frame, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov, min(seq) OVER (PARTITION BY flow, dir) AS base FROM sg) x WHERE seq + len > coalesce(cov, seq)""",
)


@query("byte_ranges", "R-1", sql(["rng"], "SELECT flow, dir, seq, len, frame, new_from, new_len, hole, new_from - base AS start, new_from - base + new_len AS stop FROM rng"))
def byte_ranges(spark, sf):
    return reassembly.byte_ranges(view(spark, sf, "segments"), KEY, block=64)


@query(
    "coverage_islands",
    "R-1",
    """WITH s AS (SELECT l_orderkey AS flow, l_returnflag AS dir, l_linenumber * 20 AS a, l_linenumber * 20 + CAST(l_quantity AS INT) AS b FROM lineitem),
 p AS (SELECT flow, dir, unnest(range(a, b)) AS byte FROM s) SELECT flow, dir, count(DISTINCT byte) AS covered_bytes FROM p GROUP BY 1, 2""",
)
def coverage_islands(spark, sf):
    return reassembly.byte_ranges(view(spark, sf, "segments"), KEY).groupBy(*KEY).agg(F.sum("new_len").cast("bigint").alias("covered_bytes"))


@query("stream_gaps", "R-2", sql(["rng"], "SELECT flow, dir, new_from - base - hole AS gap_start, new_from - base AS gap_stop FROM rng WHERE hole > 0"))
def stream_gaps(spark, sf):
    return reassembly.gaps(reassembly.byte_ranges(view(spark, sf, "segments"), KEY), KEY)


@query("gap_flags", "R-2", sql(["rng"], "SELECT flow, dir, bool_or(hole > 0) AS has_gaps, max(new_from - base + new_len) AS length FROM rng GROUP BY 1, 2"))
def gap_flags(spark, sf):
    return reassembly.has_gaps(reassembly.byte_ranges(view(spark, sf, "segments"), KEY), KEY)


@query(
    "offset_frames",
    "R-3",
    sql(
        ["segments", "rng"],
        """, q AS (SELECT DISTINCT flow, dir, CAST(frame % 150 AS BIGINT) AS "offset" FROM segments), l AS (SELECT flow, dir, arg_max(frame, new_from) AS last_frame FROM rng GROUP BY 1, 2)
SELECT q.flow, q.dir, q."offset", coalesce(r.frame, l.last_frame) AS frame FROM q JOIN l USING (flow, dir) LEFT JOIN rng r ON r.flow = q.flow AND r.dir = q.dir AND q."offset" >= r.new_from - r.base AND q."offset" < r.new_from - r.base + r.new_len""",
    ).replace(" , q AS", ", q AS"),
)
def offset_frames(spark, sf):
    seg = view(spark, sf, "segments")
    offsets = seg.select(*KEY, (F.col("frame") % 150).cast("bigint").alias("offset")).distinct()
    return reassembly.frame_for(offsets, reassembly.byte_ranges(seg, KEY), KEY, block=64)


@query(
    "document_lines",
    "R-4",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 o AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, max(n) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, CAST(n - 1 AS BIGINT) AS line_no, CAST(off AS BIGINT) AS line_offset, CAST(off // 512 AS BIGINT) AS frame, rtrim(t, chr(13)) AS text FROM o WHERE NOT (n = last AND t = '')""",
)
def document_lines(spark, sf):
    raw = load(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(512))
    segs = raw.select("doc_id", "b", F.explode(starts).alias("start")).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.floor(F.col("start") / 512).alias("frame"), F.expr("substring(b, cast(start + 1 as int), 512)").alias("payload")
    )
    return reassembly.lines(segs, ["doc_id"], block=4096).select("doc_id", "line_no", "line_offset", "frame", "text")


@query(
    "dialogue_order",
    "R-5",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS pos FROM conversations",
)
def dialogue_order(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("frame"), F.when(F.col("role") == "user", "c2s").otherwise("s2c").alias("dir"), F.col("turn").alias("line_offset"))
    return reassembly.dialogue(c, ["conv_id"]).select("conv_id", "turn", "pos")


@query(
    "plaintext_lines",
    "R-6",
    "SELECT conv_id, turn, role FROM conversations WHERE NOT (conv_id % 3 = 0 AND role = 'assistant' AND turn >= 2)",
)
def plaintext_lines(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", F.col("role").alias("dir"), "turn", F.col("turn").alias("line_offset"))
    cut = c.where("conv_id % 3 = 0 AND dir = 'assistant'").select("conv_id", "dir", F.lit(2).cast("bigint").alias("boundary")).distinct()
    return reassembly.plaintext_only(c, cut, ["conv_id"]).select("conv_id", "turn", F.col("dir").alias("role"))


# ---- dialogue -----------------------------------------------------------------------------------------------
def _ev(kind: str, frame: int, cond: str, proto: str) -> str:
    return f"SELECT capture_id, session_id AS flow, first_frame + {frame} AS frame, '{kind}' AS kind FROM sess WHERE protocol = '{proto}' AND encryption_state NOT IN ('IMPLICIT_TLS','TRUNCATED') AND {cond}"


_REJ = "encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED')"
_ACC = "encryption_state IN ('STARTTLS_NEGOTIATION_FAILED','TLS_ESTABLISHED')"
part(
    "evt",
    ["sess"],
    "\nUNION ALL ".join(
        [_ev("greeting", 3, "true", p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("capability_request", 4, "true", p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("upgrade_advertised", 6, "upgrade_advertised", p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("upgrade_requested", 8, "upgrade_requested", p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("upgrade_rejected", 9, _REJ, p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("upgrade_accepted", 9, _ACC, p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("auth_requested", 15, "cleartext_auth", p) for p in ("SMTP", "IMAP", "POP3")]
        + [_ev("session_end", 23, "true", p) for p in ("SMTP", "IMAP", "POP3")]
        + [
            _ev("upgrade_advertised_mangled", 6, "upgrade_advertised_mangled", "SMTP"),
            _ev("capability_response", 7, "true", "SMTP"),
            _ev("auth_credential", 15, "cleartext_auth AND h2 % 2 = 0", "SMTP"),
            _ev("auth_credential", 17, "cleartext_auth AND h2 % 2 = 1", "SMTP"),
            _ev("auth_credential", 19, "cleartext_auth AND h2 % 2 = 1", "SMTP"),
            _ev("auth_failed", 20, "cleartext_auth AND h2 % 5 = 0", "SMTP"),
            _ev("auth_succeeded", 20, "cleartext_auth AND h2 % 5 <> 0", "SMTP"),
            _ev("mail_transaction", 21, "cleartext_mail", "SMTP"),
            _ev("capability_response", 6, "true", "IMAP"),
            _ev("auth_credential", 15, "cleartext_auth AND h2 % 2 = 0", "IMAP"),
            _ev("auth_credential", 16, "cleartext_auth AND h2 % 2 = 1", "IMAP"),
            _ev("mailbox_access", 17, "cleartext_mail", "IMAP"),
            _ev("auth_credential", 16, "cleartext_auth", "POP3"),
            _ev("mailbox_access", 17, "cleartext_mail", "POP3"),
        ]
    ),
)


@query("protocol_events", "D-1 D-2", sql(["evt"], "SELECT capture_id, flow, frame, kind FROM evt"))
def protocol_events(spark, sf):
    return dialogue.events(view(spark, sf, "lines")).select("capture_id", "flow", "frame", "kind")


@query(
    "first_greetings",
    "D-3",
    sql(["sess"], "SELECT capture_id, session_id AS flow, coalesce(server_banner, 'ready') AS server_banner FROM sess WHERE encryption_state NOT IN ('IMPLICIT_TLS','TRUNCATED')"),
)
def first_greetings(spark, sf):
    return dialogue.first_greeting(dialogue.events(view(spark, sf, "lines")))


@query(
    "mangled_tokens",
    "D-4",
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t0 FROM documents), t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat(substr(t0, 1, 1), 7) || 'A' ELSE t0 END AS token FROM w),
 c AS (SELECT doc_id, token, regexp_split_to_array(trim(token), '\s+')[1] AS word FROM t)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (length(trim(token)) > 0 AND (regexp_matches(token, '[^\x20-\x7E\t]') OR (length(word) >= 6 AND list_max(list_transform(list_distinct(string_split(word, '')), lambda x: length(word) - length(replace(word, x, '')))) >= length(word) - 1))) AS mangled FROM c GROUP BY doc_id""",
)
def mangled_tokens(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    token = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.substring("word", 1, 1), 7), F.lit("A"))).otherwise(F.col("word"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count(F.when(words.is_mangled(token), 1)).alias("mangled"))


@query(
    "mangled_words",
    "D-4",
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
 t AS (SELECT doc_id, 'text' AS kind, token FROM w UNION ALL SELECT doc_id, 'filled', repeat(substr(token, 1, 1), 7) || 'A' FROM w WHERE token <> ''),
 c AS (SELECT *, regexp_split_to_array(trim(token), '\s+')[1] AS word FROM t)
SELECT doc_id, kind, count(*) AS tokens, count(*) FILTER (length(trim(token)) > 0 AND (regexp_matches(token, '[^\x20-\x7E\t]') OR (length(word) >= 6 AND list_max(list_transform(list_distinct(string_split(word, '')), lambda x: length(word) - length(replace(word, x, '')))) >= length(word) - 1))) AS mangled FROM c GROUP BY 1, 2""",
)
def mangled_words(spark, sf):
    """The real words of every document, and beside them each one filled with its first character."""
    rows = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    filled = F.when(F.col("word") != "", F.struct(F.lit("filled").alias("kind"), F.concat(F.repeat(F.substring("word", 1, 1), 7), F.lit("A")).alias("token")))
    both = rows.select("doc_id", F.inline(F.array_compact(F.array(F.struct(F.lit("text").alias("kind"), F.col("word").alias("token")), filled))))
    return both.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("tokens"), F.count(F.when(words.is_mangled(F.col("token")), 1)).alias("mangled"))


def _points(spark, sf):
    x, y = (F.col("n_chars") % 64) / F.lit(16.0), (F.col("doc_id") % 48) / F.lit(32.0)
    return load(spark, sf, "documents").select(F.col("source").alias("cluster"), x.alias("x"), y.alias("y"), F.col("doc_id").alias("ref"))


_POINT = "SELECT source AS cluster, round_even((n_chars % 64) / 16.0, 1) AS x, round_even((doc_id % 48) / 32.0, 1) AS y, doc_id AS ref FROM documents"


@query("folded_points", "Q-15", f"SELECT cluster, x, y, count(*) AS count, min(ref) AS first_ref FROM ({_POINT}) p GROUP BY 1, 2, 3")
def folded_points(spark, sf):
    return browse.fold_points(_points(spark, sf), 1)


@query("folded_point_members", "Q-15", _POINT)
def folded_point_members(spark, sf):
    return browse.fold_members(_points(spark, sf), 1)


_CRED = """SELECT capture_id, session_id AS flow, first_frame + {f} AS frame, '{m}' AS mechanism, {u} AS username_redacted, length({s}) AS credential_length, substr(sha256({s}), 1, 6) AS credential_sha256_prefix FROM sess WHERE protocol = '{p}' AND cleartext_auth AND {c}"""
_PW = "CASE h2 % 3 WHEN 0 THEN 's3cret' WHEN 1 THEN 'pw' ELSE 'toor' END"
_US = "CASE h2 % 3 WHEN 0 THEN 'alice@corp.local' WHEN 1 THEN 'bob@corp.local' ELSE 'root' END"
_MU = "CASE h2 % 3 WHEN 0 THEN 'a****@corp.local' WHEN 1 THEN 'b****@corp.local' ELSE 'r****' END"
part(
    "creds",
    ["sess"],
    "\nUNION ALL ".join(
        [
            _CRED.format(f=15, m="AUTH PLAIN", u=_MU, s=_PW, p="SMTP", c="h2 % 2 = 0"),
            _CRED.format(f=17, m="AUTH LOGIN", u=_MU, s=_US, p="SMTP", c="h2 % 2 = 1"),
            _CRED.format(f=19, m="AUTH LOGIN", u="NULL", s="'s3cret'", p="SMTP", c="h2 % 2 = 1"),
            _CRED.format(f=15, m="IMAP LOGIN", u="'a****@corp.local'", s="'s3cret'", p="IMAP", c="h2 % 2 = 0"),
            _CRED.format(f=16, m="IMAP AUTHENTICATE", u=_MU, s=_US, p="IMAP", c="h2 % 2 = 1"),
            _CRED.format(f=16, m="POP3 USER/PASS", u="'b****@corp.local'", s="'hunter2'", p="POP3", c="true"),
        ]
    ),
)


@query("credential_evidence", "D-5", sql(["creds"], "SELECT * FROM creds"))
def credential_evidence(spark, sf):
    return dialogue.events(view(spark, sf, "lines")).where("kind = 'auth_credential'").select("capture_id", "flow", "frame", "credential.*")


@query("credential_listing", "Q-10", sql(["creds", "sess"], "SELECT c.capture_id, c.flow AS session_id, s.server_ip || ':' || CAST(s.server_port AS VARCHAR) AS server, c.mechanism, c.username_redacted, c.frame FROM creds c JOIN sess s ON s.capture_id = c.capture_id AND s.session_id = c.flow"))
def credential_listing(spark, sf):
    e = dialogue.events(view(spark, sf, "lines")).withColumnRenamed("flow", "session_id")
    return browse.credential_rows(e, view(spark, sf, "sess")).select("capture_id", "session_id", "server", "credential.mechanism", "credential.username_redacted", "frame")


# ---- state machine ---------------------------------------------------------------------------------------------
def all_events(spark, sf):
    d = dialogue.events(view(spark, sf, "lines")).select("capture_id", "flow", "dir", "frame", "line_offset", "event_no", "kind")
    t = view(spark, sf, "tls_events").withColumn("event_no", F.lit(0)).select("capture_id", "flow", "dir", "frame", "line_offset", "event_no", "kind")
    return d.unionByName(t)


def fsm_flows(spark, sf):
    return view(spark, sf, "sess").select("capture_id", F.col("session_id").alias("flow"), (F.col("encryption_state") == "IMPLICIT_TLS").alias("implicit_tls"), "session_complete", "has_gaps")


@query(
    "encryption_outcomes",
    "D-7 D-9",
    sql(
        ["sess"],
        """SELECT capture_id, session_id AS flow, encryption_state, is_indeterminate, upgrade_advertised, upgrade_advertised_mangled AND protocol = 'SMTP' AS upgrade_advertised_mangled, upgrade_requested, upgrade_succeeded, tls_established, cleartext_auth, cleartext_mail FROM sess""",
    ),
)
def encryption_outcomes(spark, sf):
    out = fsm.outcomes(stage(all_events(spark, sf)), fsm_flows(spark, sf))
    return out.select(
        "capture_id", "flow", "encryption_state", "is_indeterminate", "upgrade_advertised", "upgrade_advertised_mangled", "upgrade_requested", "upgrade_succeeded", "tls_established", "cleartext_auth", "cleartext_mail"
    )


part(
    "trn",
    ["sess"],
    f"""SELECT capture_id, session_id AS flow, first_frame + 3 AS frame, 'TCP_CONNECTED' AS from_state, 'PLAINTEXT_EMAIL' AS to_state, 'server greeting' AS trigger FROM sess WHERE encryption_state NOT IN ('IMPLICIT_TLS','TRUNCATED')
UNION ALL SELECT capture_id, session_id, first_frame + 8, 'PLAINTEXT_EMAIL', 'TLS_REQUESTED', 'upgrade requested' FROM sess WHERE upgrade_requested UNION ALL SELECT capture_id, session_id, first_frame + 9, 'TLS_REQUESTED', 'TLS_NEGOTIATION', 'server accepted upgrade' FROM sess WHERE {_ACC}
UNION ALL SELECT capture_id, session_id, first_frame + 9, 'TLS_REQUESTED', 'STARTTLS_REJECTED', 'server rejected upgrade' FROM sess WHERE {_REJ} UNION ALL SELECT capture_id, session_id, first_frame + 13, 'TLS_NEGOTIATION', 'TLS_ESTABLISHED', 'encrypted application data' FROM sess WHERE encryption_state = 'TLS_ESTABLISHED'""",
)


@query("state_transitions", "D-8", sql(["trn"], "SELECT * FROM trn"))
def state_transitions(spark, sf):
    return fsm.transitions(stage(all_events(spark, sf)), fsm_flows(spark, sf)).drop("line_offset")


_EVENT_KIND = {"signup": "greeting", "view": "upgrade_requested", "click": "tls_client_hello", "purchase": "tls_application_data", "error": "upgrade_rejected"}


@query(
    "event_state_walk",
    "D-7 D-8",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 w AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS frame, 'TCP_CONNECTED' AS before, 'TCP_CONNECTED' AS st FROM (SELECT DISTINCT user_id FROM events) u
  UNION ALL SELECT e.user_id, e.n, e.event_id, w.st, CASE e.event_type WHEN 'signup' THEN CASE WHEN w.st = 'TCP_CONNECTED' THEN 'PLAINTEXT_EMAIL' ELSE w.st END WHEN 'view' THEN 'TLS_REQUESTED'
   WHEN 'click' THEN CASE WHEN w.st IN ('TCP_CONNECTED','TLS_REQUESTED','TLS_NEGOTIATION') THEN 'TLS_NEGOTIATION' ELSE w.st END WHEN 'purchase' THEN CASE WHEN w.st = 'TLS_NEGOTIATION' THEN 'TLS_ESTABLISHED' ELSE w.st END
   ELSE 'STARTTLS_REJECTED' END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, frame, before AS from_state, st AS to_state FROM w WHERE n > 0 AND before <> st""",
)
def event_state_walk(spark, sf):
    ev = load(spark, sf, "events").select(
        F.lit(0).alias("capture_id"), F.col("user_id").alias("flow"), F.col("event_id").alias("frame"), F.lit(0).cast("bigint").alias("line_offset"), F.lit(0).alias("event_no"), dims.lookup("event_type", _EVENT_KIND).alias("kind")
    )
    fl = ev.select("capture_id", "flow").distinct().withColumn("implicit_tls", F.lit(False))
    return fsm.transitions(ev, fl).select(F.col("flow").alias("user_id"), "frame", "from_state", "to_state")


@query(
    "assembled_sessions",
    "D-11",
    sql(
        ["sess"],
        """SELECT capture_id, session_id AS stream, protocol, CASE WHEN encryption_state = 'IMPLICIT_TLS' THEN 'implicit_tls_port' ELSE 'payload_signature' END AS detection_method, encryption_state, is_indeterminate, tls_version, cipher_suite, key_group, pqc_offered FROM
 (SELECT * REPLACE (CASE WHEN tls_version IS NULL THEN NULL ELSE pqc_offered END AS pqc_offered) FROM sess) s WHERE encryption_state <> 'TRUNCATED'""",
    ),
)
def assembled_sessions(spark, sf):
    s, lines = view(spark, sf, "sess"), view(spark, sf, "lines")
    key = ["capture_id", "stream"]
    fl = s.select("capture_id", F.col("session_id").alias("stream"), "client_ip", "client_port", "server_ip", "server_port", "first_frame", "last_frame")
    opening = lines.where("dir = 's2c'").groupBy("capture_id", F.col("flow").alias("stream")).agg(F.min_by("text", "frame").alias("opening"))
    tls_first = s.select("capture_id", F.col("session_id").alias("stream"), (F.col("encryption_state") == "IMPLICIT_TLS").alias("tls_first"))
    proto = flows.protocol_of(fl.select(*key, "server_port").join(opening, key, "left").join(tls_first, key)).select(*key, "protocol", "detection_method")
    ev = stage(all_events(spark, sf))
    outcome = fsm.outcomes(ev, fsm_flows(spark, sf)).withColumnRenamed("flow", "stream").select(*key, "encryption_state", "tls_established", "upgrade_advertised")
    facts = handshake_facts(spark, sf).withColumnRenamed("session_id", "stream").select(*key, "tls_version", "cipher_suite", "key_group", "pqc_offered")
    seen = ev.select("capture_id", F.col("flow").alias("stream"))
    out = sessions.assemble(fl, proto, outcome, facts, seen)
    return out.select(*key, "protocol", "detection_method", "encryption_state", "is_indeterminate", "tls_version", "cipher_suite", "key_group", "pqc_offered")


@query(
    "grade_states",
    "V-1",
    sql(["sess"], "SELECT capture_id, encryption_state, count(*) AS expected, count(*) AS actual, 0 AS missing, 0 AS extra FROM sess GROUP BY 1, 2"),
)
def grade_states(spark, sf):
    got = fsm.outcomes(stage(all_events(spark, sf)), fsm_flows(spark, sf))
    return grading.grade_counts(view(spark, sf, "sess"), got, ["capture_id"], "encryption_state")


_PH = "CASE WHEN kind = 'tls_application_data' THEN 'encrypted' WHEN frame >= est THEN 'encrypted' WHEN frame >= neg THEN 'handshake' WHEN kind LIKE 'tls_%' THEN 'handshake' ELSE 'plaintext' END"
part("aev", ["evt", "tls_events"], "SELECT capture_id, flow, frame, kind, 0 AS line_offset FROM evt UNION ALL SELECT capture_id, flow, frame, kind, line_offset FROM tls_events")
part(
    "phs",
    ["aev", "sess"],
    f"""SELECT a.capture_id, a.flow AS session_id, kind, frame, {_PH} AS phase, (frame - min(frame) OVER (PARTITION BY a.capture_id, a.flow)) * 0.5::DOUBLE AS since_start,
 CASE WHEN kind = 'tls_application_data' THEN row_number() OVER (PARTITION BY a.capture_id, a.flow, kind ORDER BY frame) END AS rn
FROM aev a JOIN (SELECT capture_id, session_id, CASE WHEN encryption_state = 'IMPLICIT_TLS' THEN first_frame ELSE at_accepted END AS neg, CASE WHEN encryption_state = 'TLS_ESTABLISHED' THEN at_app_data END AS est FROM sess) b ON b.capture_id = a.capture_id AND b.session_id = a.flow""",
)


def _phases(spark, sf):
    ev = stage(all_events(spark, sf))
    fl = fsm_flows(spark, sf)
    tr = fsm.transitions(ev, fl)
    neg = tr.groupBy("capture_id", "flow").agg(
        F.min(F.when(F.col("to_state") == "TLS_NEGOTIATION", F.col("frame"))).alias("negotiation_frame"),
        F.min(F.when(F.col("to_state") == "TLS_ESTABLISHED", F.col("frame"))).alias("established_frame"),
    )
    implicit = view(spark, sf, "sess").where("encryption_state = 'IMPLICIT_TLS'").select("capture_id", F.col("session_id").alias("flow"), F.col("first_frame").alias("negotiation_frame"), F.lit(None).cast("bigint").alias("established_frame"))
    bounds = neg.unionByName(implicit).withColumnRenamed("flow", "session_id")
    rows = ev.withColumnRenamed("flow", "session_id").withColumn("ts", F.col("frame") * F.lit(0.5))
    return browse.phase_events(rows, bounds)


@query("event_phases", "Q-13", sql(["phs"], "SELECT capture_id, session_id, kind, frame, phase, since_start FROM phs WHERE rn IS NULL OR rn <= 2"))
def event_phases(spark, sf):
    return _phases(spark, sf)[0]


@query("folded_records", "Q-13", sql(["phs"], "SELECT capture_id, session_id, max(rn) - 2 AS folded FROM phs GROUP BY 1, 2 HAVING max(rn) > 2"))
def folded_records(spark, sf):
    return _phases(spark, sf)[1]


@query(
    "finding_evidence_frames",
    "U-6 K-3",
    sql(
        ["fnd", "aev"],
        """, c AS (SELECT * FROM (VALUES ('cleartext_credential_exposure','auth_credential'),('starttls_downgrade_fallback','upgrade_requested'),('starttls_downgrade_fallback','upgrade_rejected'),('starttls_not_advertised','capability_response'),
 ('starttls_not_advertised','upgrade_advertised_mangled'),('starttls_not_advertised','greeting'),('starttls_advertised_not_used','upgrade_advertised'),('cleartext_mail_transaction','mail_transaction'),('cleartext_mail_transaction','mailbox_access'),
 ('deprecated_tls_version','tls_server_hello'),('deprecated_tls_version','tls_client_hello'),('weak_cipher_suite','tls_server_hello'),('weak_cipher_suite','tls_client_hello'),('no_forward_secrecy','tls_server_hello'),('no_forward_secrecy','tls_client_hello'),
 ('certificate_not_observable','tls_server_hello'),('certificate_not_observable','tls_client_hello'),('starttls_stripping','upgrade_advertised_mangled')) t(category, kind))
SELECT DISTINCT f.capture_id, f.session_id, f.category, e.frame FROM fnd f JOIN c USING (category) JOIN aev e ON e.capture_id = f.capture_id AND e.flow = f.session_id AND e.kind = c.kind""",
    ).replace(" , c AS", ", c AS"),
)
def finding_evidence_frames(spark, sf):
    f = rules.findings(crypto.decorate(view(spark, sf, "sess")))
    return rules.evidence_frames(f, all_events(spark, sf).withColumnRenamed("flow", "session_id"))


# ---- handshakes -----------------------------------------------------------------------------------------------------
def hellos(spark, sf):
    h = view(spark, sf, "hello")
    client = h.select(
        "capture_id", "session_id", "legacy_version", tls.ints("versions").alias("versions"), tls.ints("suites").alias("suites"), tls.ints("exts").alias("exts"), tls.ints("grps").alias("groups"),
        tls.ints("point_formats").alias("point_formats"), tls.ints("sig_algs").alias("sig_algs"), "alpn", "sni", F.col("c_ts").alias("ts"),
    )
    server = h.select(
        "capture_id", "session_id", F.col("s_version").alias("version"), F.col("s_suite").alias("suite"), F.col("s_group").alias("grp"), tls.ints("s_exts").alias("exts"), F.col("s_alpn").alias("alpn"), F.col("s_ts").alias("ts"), "legacy_version",
    )
    return client, server


def handshake_facts(spark, sf):
    return tls.tls_facts(*hellos(spark, sf), ["capture_id", "session_id"])


@query(
    "grease_free_lists",
    "C-3",
    sql(["hello"], "SELECT capture_id, session_id, array_to_string(list_filter(string_split(suites, ','), lambda x: x NOT IN ('2570','6682')), ',') AS suites, array_to_string(list_filter(string_split(exts, ','), lambda x: x <> '2570'), ',') AS exts FROM hello"),
)
def grease_free_lists(spark, sf):
    h = view(spark, sf, "hello")
    return h.select("capture_id", "session_id", text(crypto.drop_grease(tls.ints("suites"))).alias("suites"), text(crypto.drop_grease(tls.ints("exts"))).alias("exts"))


@query(
    "grease_values",
    "C-3",
    "SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS copies, ((l_partkey * 257 % 65536) & 3855) = 2570 AND ((l_partkey * 257 % 65536) >> 8) & 255 = (l_partkey * 257 % 65536) & 255 AS grease FROM lineitem GROUP BY 1, 2, 3",
)
def grease_values(spark, sf):
    v = F.pmod(F.col("l_partkey") * 257, F.lit(65536)).cast("int")
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("copies")).withColumn("grease", crypto.is_grease(v))


@query(
    "ja3_fingerprints",
    "C-4",
    sql(
        ["hello"],
        """SELECT capture_id, session_id, md5(legacy_version || ',' || replace(suites, ',', '-') || ',' || replace(exts, ',', '-') || ',' || replace(grps, ',', '-') || ',' || point_formats) AS ja3, md5(legacy_version || ',' || s_suite || ',' || replace(s_exts, ',', '-')) AS ja3s FROM hello""",
    ),
)
def ja3_fingerprints(spark, sf):
    return handshake_facts(spark, sf).select("capture_id", "session_id", "ja3", "ja3s")


_HEX = "list_transform({l}, lambda x: lpad(lower(to_hex(CAST(x AS INT))), 4, '0'))"
_NOG = "list_filter(string_split({c}, ','), lambda x: x NOT IN ('2570','6682',''))"
_J4V = "CASE {v} WHEN 772 THEN '13' WHEN 771 THEN '12' WHEN 770 THEN '11' WHEN 769 THEN '10' WHEN 768 THEN 's3' ELSE '00' END"
_J4H = "CASE WHEN len({l}) = 0 THEN '000000000000' ELSE substr(sha256(array_to_string({l}, ',')), 1, 12) END"


@query(
    "ja4_fingerprints",
    "C-5",
    sql(
        ["hello"],
        f""", p AS (SELECT *, list_sort({_HEX.format(l=_NOG.format(c='suites'))}) AS cs, {_HEX.format(l=_NOG.format(c='exts'))} AS es, {_HEX.format(l=_NOG.format(c='sig_algs'))} AS sa, list_sort({_HEX.format(l=_NOG.format(c='s_exts'))}) AS ss FROM hello),
 q AS (SELECT *, list_concat(list_sort(list_filter(es, lambda x: x NOT IN ('0000','0010'))), sa) AS hx FROM p)
SELECT capture_id, session_id, 't' || {_J4V.format(v="CAST(string_split(versions, ',')[1] AS INT)")} || CASE WHEN sni IS NULL THEN 'i' ELSE 'd' END || lpad(CAST(len(cs) AS VARCHAR), 2, '0') || lpad(CAST(len(es) AS VARCHAR), 2, '0')
 || CASE alpn WHEN 'smtp' THEN 'sp' WHEN 'h' THEN 'hh' ELSE '00' END || '_' || {_J4H.format(l='cs')} || '_' || {_J4H.format(l='hx')} AS ja4,
 't' || {_J4V.format(v='s_version')} || lpad(CAST(len(ss) AS VARCHAR), 2, '0') || CASE s_alpn WHEN 'smtp' THEN 'sp' ELSE '00' END || '_' || lpad(lower(to_hex(CAST(s_suite AS INT))), 4, '0') || '_' || {_J4H.format(l='ss')} AS ja4s FROM q""",
    ).replace(" , p AS", ", p AS"),
)
def ja4_fingerprints(spark, sf):
    return handshake_facts(spark, sf).select("capture_id", "session_id", "ja4", "ja4s")


@query(
    "handshake_facts",
    "C-6",
    sql(
        ["hello", "sess"],
        """SELECT s.capture_id, s.session_id, s.tls_version, s.cipher_suite, s.key_group, s.pqc_offered, s.pqc_selected, CASE WHEN s.sni IS NULL THEN 'absent' ELSE 'present' END AS sni_status, round_even((h.s_ts - h.c_ts) * 1000, 3) AS handshake_ms,
 CASE h.versions WHEN '772,771' THEN 'TLS 1.3,TLS 1.2' WHEN '771' THEN 'TLS 1.2' ELSE 'TLS 1.2,TLS 1.1,TLS 1.0' END AS versions_offered FROM sess s JOIN hello h USING (capture_id, session_id)""",
    ),
)
def handshake_facts_query(spark, sf):
    return handshake_facts(spark, sf).select("capture_id", "session_id", "tls_version", "cipher_suite", "key_group", "pqc_offered", "pqc_selected", "sni_status", "handshake_ms", text("versions_offered").alias("versions_offered"))


@query(
    "ja4_parts",
    "C-8",
    sql(
        ["hello"],
        "SELECT capture_id, session_id, len(list_filter(string_split(suites, ','), lambda x: x NOT IN ('2570','6682'))) AS ciphers, len(list_filter(string_split(exts, ','), lambda x: x <> '2570')) AS extensions, sni IS NOT NULL AS sni, alpn IS NOT NULL AS alpn FROM hello",
    ),
)
def ja4_parts(spark, sf):
    return handshake_facts(spark, sf).select("capture_id", "session_id", crypto.ja4_parts(F.col("ja4")).alias("p")).select("capture_id", "session_id", "p.*")


# ---- certificates -------------------------------------------------------------------------------------------------------
def certificates(spark, sf):
    san = F.when(F.length("san") > 0, F.split("san", ",")).otherwise(F.array().cast("array<string>"))
    return view(spark, sf, "certs").withColumn("san_names", san)


@query(
    "certificate_validity",
    "X-1",
    sql(
        ["certs"],
        """SELECT capture_id, session_id, idx, capture_ts > not_after AS cert_expired, capture_ts <= not_after AND capture_ts < not_before AS cert_not_yet_valid,
 CASE WHEN capture_ts BETWEEN not_before AND not_after THEN CAST(floor((not_after - capture_ts) / 86400) AS INT) END AS cert_days_to_expiry, capture_ts BETWEEN not_before AND not_after AND floor((not_after - capture_ts) / 86400) <= 30 AS cert_expiring_soon FROM certs""",
    ),
)
def certificate_validity(spark, sf):
    return certs.validity(certificates(spark, sf)).select("capture_id", "session_id", "idx", "cert_expired", "cert_not_yet_valid", "cert_days_to_expiry", "cert_expiring_soon")


@query(
    "order_validity",
    "X-1",
    """SELECT o_orderkey, t > na AS cert_expired, t <= na AND t < nb AS cert_not_yet_valid, CASE WHEN t BETWEEN nb AND na THEN CAST(floor((na - t) / 86400) AS INT) END AS cert_days_to_expiry, t BETWEEN nb AND na AND floor((na - t) / 86400) <= 30 AS cert_expiring_soon
FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS nb, epoch_us(o_orderdate) // 1000000 + 31536000 AS na, 850000000 + o_custkey * 100000 AS t FROM orders) x""",
)
def order_validity(spark, sf):
    nb = F.floor(epoch_us("o_orderdate") / 1_000_000)
    rows = load(spark, sf, "orders").select("o_orderkey", nb.alias("not_before"), (nb + 31536000).alias("not_after"), (F.col("o_custkey") * 100000 + 850000000).alias("capture_ts"))
    return certs.validity(rows).select("o_orderkey", "cert_expired", "cert_not_yet_valid", "cert_days_to_expiry", "cert_expiring_soon")


@query(
    "url_host_match",
    "X-2",
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages), p AS (SELECT page_id, host, CASE page_id % 4 WHEN 0 THEN ['*.example.com', '*.' || regexp_replace(host, '^[^.]+\.', '')] WHEN 1 THEN [upper(host) || '.'] WHEN 2 THEN ['*.example.com', 'www.example.org'] ELSE ['*.example.org'] END AS names FROM h)
SELECT page_id, host, len(list_filter(names, lambda n: rtrim(lower(n), '.') = lower(host) OR (n LIKE '*.%' AND ends_with(lower(host), substr(lower(n), 2)) AND len(string_split(host, '.')) = len(string_split(n, '.'))))) > 0 AS matches FROM p""",
)
def url_host_match(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    k = F.col("page_id") % 4
    san = (
        F.when(k == 0, F.array(F.lit("*.example.com"), F.concat(F.lit("*."), F.regexp_replace(host, r"^[^.]+\.", ""))))
        .when(k == 1, F.array(F.concat(F.upper(host), F.lit("."))))
        .when(k == 2, F.array(F.lit("*.example.com"), F.lit("www.example.org")))
        .otherwise(F.array().cast("array<string>"))
    )
    return load(spark, sf, "pages").select("page_id", host.alias("host"), certs.hostname_match(host, san, F.lit("*.example.org")).alias("matches"))


@query(
    "leaf_strength",
    "X-3 X-4",
    sql(
        ["certs"],
        """SELECT capture_id, session_id, idx, CASE key_alg WHEN 'RSA' THEN key_bits < 2048 ELSE key_bits < 224 END AS weak_key, CASE WHEN sig_alg LIKE 'md5%' THEN 'md5' WHEN sig_alg LIKE 'sha1%' THEN 'sha1' END AS broken_hash FROM certs""",
    ),
)
def leaf_strength(spark, sf):
    return certificates(spark, sf).select("capture_id", "session_id", "idx", certs.weak_key(F.col("key_alg"), F.col("key_bits")).alias("weak_key"), certs.broken_hash(F.col("sig_alg")).alias("broken_hash"))


@query(
    "chain_shape",
    "X-5",
    sql(["certs"], "SELECT capture_id, session_id, count(*) AS chain_length, bool_or(idx = 0 AND subject = issuer) AS cert_self_signed, NOT bool_or(idx = 0 AND subject = issuer) AND count(*) = 1 AS cert_chain_incomplete FROM certs GROUP BY 1, 2"),
)
def chain_shape(spark, sf):
    return certs.chain_shape(certificates(spark, sf))


part(
    "lnk",
    ["certs"],
    """SELECT capture_id, session_id, idx AS child, CASE WHEN NOT (issuer = ps AND pv AND pca) THEN 'invalid' WHEN NOT capture_ts BETWEEN pnb AND pna THEN 'warning' ELSE 'valid' END AS status,
 concat_ws(',', CASE WHEN issuer <> ps THEN 'issuer_name' END, CASE WHEN issuer = ps AND NOT pv THEN 'signature' END, CASE WHEN issuer = ps AND pv AND NOT pca THEN 'issuer_not_ca' END, CASE WHEN NOT capture_ts BETWEEN pnb AND pna THEN 'issuer_validity' END) AS problems
FROM (SELECT *, lead(subject) OVER w AS ps, lead(link_verified) OVER w AS pv, lead(is_ca) OVER w AS pca, lead(not_before) OVER w AS pnb, lead(not_after) OVER w AS pna FROM certs WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY idx)) x WHERE ps IS NOT NULL""",
)


@query("chain_links", "X-6", sql(["lnk"], "SELECT * FROM lnk"))
def chain_links(spark, sf):
    return certs.chain_links(certificates(spark, sf)).withColumn("problems", text("problems"))


part(
    "anc",
    ["certs", "roots", "lnk"],
    """SELECT t.capture_id, t.session_id, CASE WHEN coalesce(b.bad, false) THEN 'INVALID' WHEN r.source IS NOT NULL THEN 'TRUSTED' WHEN t.subject = t.issuer THEN 'UNTRUSTED_ANCHOR' ELSE 'INCOMPLETE' END AS chain_trust, r.source AS anchor_source, r.sha256 = t.sha256 AS anchor_presented
FROM (SELECT * FROM certs QUALIFY row_number() OVER (PARTITION BY capture_id, session_id ORDER BY idx DESC) = 1) t LEFT JOIN (SELECT * FROM roots QUALIFY row_number() OVER (PARTITION BY subject ORDER BY store_order) = 1) r ON r.subject = t.issuer
LEFT JOIN (SELECT capture_id, session_id, bool_or(status = 'invalid') AS bad FROM lnk GROUP BY 1, 2) b ON b.capture_id = t.capture_id AND b.session_id = t.session_id""",
)


@query("trust_anchors", "X-7", sql(["anc"], "SELECT * FROM anc"))
def trust_anchors(spark, sf):
    c = certificates(spark, sf)
    return certs.anchors(c, certs.chain_links(c), view(spark, sf, "roots"))


@query("trust_store_counts", "X-8", sql(["roots"], "SELECT source, count(*) AS roots FROM roots GROUP BY 1"))
def trust_store_counts(spark, sf):
    return certs.root_stats(view(spark, sf, "roots"))


@query(
    "session_certificates",
    "X-1 X-2 X-3 X-4 X-5 X-7",
    sql(
        ["certs", "anc"],
        """SELECT c.capture_id, c.session_id, capture_ts > not_after AS cert_expired, key_alg = 'RSA' AND key_bits < 2048 AS cert_weak_key, sig_alg LIKE 'md5%' OR sig_alg LIKE 'sha1%' AS cert_broken_signature, a.chain_trust = 'INVALID' AS cert_chain_invalid,
 CASE WHEN hostname IS NULL THEN NULL WHEN san = '' THEN subject_cn = hostname WHEN san = '*.example.net' THEN true WHEN san LIKE 'other%' THEN false ELSE san = hostname END AS cert_hostname_match FROM certs c JOIN anc a USING (capture_id, session_id) WHERE idx = 0""",
    ),
)
def session_certificates(spark, sf):
    v = certs.verdicts(certificates(spark, sf), view(spark, sf, "roots"))
    return v.select("capture_id", "session_id", "cert_expired", "cert_weak_key", "cert_broken_signature", "cert_chain_invalid", "cert_hostname_match")


@query(
    "certificate_table",
    "X-9",
    sql(
        ["sess"],
        """SELECT capture_id, session_id, server_ip || ':' || CAST(server_port AS VARCHAR) AS server, cert_key_alg || ' ' || CAST(cert_key_bits AS VARCHAR) AS key, cert_days_to_expiry, concat_ws(',', CASE WHEN cert_expired THEN 'expired' END, CASE WHEN cert_not_yet_valid THEN 'not yet valid' END,
 CASE WHEN cert_expiring_soon THEN 'expiring soon' END, CASE WHEN cert_weak_key THEN 'weak key' END, CASE WHEN cert_broken_signature THEN 'weak signature hash' END, CASE WHEN cert_self_signed THEN 'self-signed' END, CASE WHEN cert_chain_incomplete THEN 'incomplete chain' END,
 CASE WHEN cert_chain_invalid THEN 'chain signature invalid' END, CASE WHEN cert_hostname_match = false THEN 'hostname mismatch' END) AS issues FROM sess WHERE cert_seen""",
    ),
)
def certificate_table(spark, sf):
    return certs.leaf_table(view(spark, sf, "sess")).withColumn("issues", text("issues"))


# ---- DNS -----------------------------------------------------------------------------------------------------------------
def dns(spark, sf):
    d = view(spark, sf, "dns")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return d.withColumn("txt", one("txt")).withColumn("addresses", one("addresses")).withColumn("mx", F.when(F.col("mx").isNotNull(), F.split("mx", ",")).otherwise(F.array().cast("array<string>")))


part(
    "dnr",
    ["dns"],
    r"""SELECT *, CASE WHEN qname LIKE '\_mta-sts.%' ESCAPE '\' THEN 'mta_sts' WHEN qname LIKE '\_smtp.\_tls.%' ESCAPE '\' THEN 'tlsrpt' WHEN qname LIKE '\_dmarc.%' ESCAPE '\' THEN 'dmarc' WHEN qtype = 52 THEN 'tlsa' WHEN qtype = 15 THEN 'mx' WHEN qtype = 16 AND is_response AND txt LIKE 'v=spf1%' THEN 'spf' WHEN qtype = 1 AND is_response THEN 'a' END AS role,
 regexp_replace(qname, '^(_mta-sts\.|_smtp\._tls\.|_dmarc\.)', '') AS domain FROM dns""",
)
part(
    "dpol",
    ["dnr"],
    """SELECT capture_id, domain, min(frame) AS domain_first, bool_or(role = 'mta_sts' AND NOT is_response) AS mta_sts_queried, arg_max(rcode = 0 AND coalesce(regexp_matches(lower(txt), 'v *= *stsv1'), false), frame) FILTER (role = 'mta_sts' AND is_response) AS mta_sts_published,
 arg_max_null(nullif(regexp_extract(txt, 'id=([^;]+)', 1), ''), frame) FILTER (role = 'mta_sts' AND is_response AND rcode = 0 AND regexp_matches(lower(txt), 'v *= *stsv1')) AS mta_sts_id,
 bool_or(role = 'tlsrpt' AND NOT is_response) AS tlsrpt_queried, arg_max(rcode = 0 AND coalesce(txt LIKE 'v=TLSRPTv1%', false), frame) FILTER (role = 'tlsrpt' AND is_response) AS tlsrpt_published,
 bool_or(role = 'dmarc' AND NOT is_response) AS dmarc_queried, arg_max(rcode = 0 AND coalesce(txt LIKE 'v=DMARC1%', false), frame) FILTER (role = 'dmarc' AND is_response) AS dmarc_published,
 arg_max_null(nullif(lower(regexp_extract(txt, 'p=(none|Reject)', 1)), ''), frame) FILTER (role = 'dmarc' AND is_response) AS dmarc_policy, CASE WHEN bool_or(role = 'spf') THEN true END AS spf_published, max(CASE WHEN role = 'spf' THEN '~' END) AS spf_qualifier
FROM dnr WHERE role IN ('mta_sts','tlsrpt','dmarc','mx','spf') GROUP BY 1, 2""",
)
part(
    "dmx",
    ["dnr"],
    "SELECT capture_id, domain, host, min(frame) AS first_frame FROM (SELECT capture_id, domain, frame, rtrim(lower(unnest(string_split(mx, ','))), '.') AS host FROM dnr WHERE role = 'mx' AND is_response AND mx IS NOT NULL) x GROUP BY 1, 2, 3",
)
part(
    "ddane",
    ["dnr", "dmx"],
    """SELECT m.capture_id, m.domain, bool_or(NOT t.is_response) AS dane_queried, arg_max(t.rcode = 0 AND t.answer_count > 0, t.frame) FILTER (t.is_response) AS dane_published FROM dmx m JOIN dnr t ON t.capture_id = m.capture_id AND t.role = 'tlsa' AND t.qname = '_25._tcp.' || m.host AND m.first_frame < t.frame GROUP BY 1, 2""",
)
part("dres", ["dnr", "dmx"], "SELECT m.capture_id, m.domain, a.addresses AS ip, max(a.frame) AS last_frame FROM dmx m JOIN dnr a ON a.capture_id = m.capture_id AND a.role = 'a' AND a.qname = m.host AND m.first_frame < a.frame GROUP BY 1, 2, 3")


@query("domain_policies", "N-1", sql(["dpol"], "SELECT * FROM dpol"))
def domain_policies(spark, sf):
    return dnsaudit.domain_policy(dns(spark, sf))


@query("mx_hosts", "N-2", sql(["dmx"], "SELECT * FROM dmx"))
def mx_hosts(spark, sf):
    return dnsaudit.mx_hosts(dns(spark, sf)).drop("position")


@query("dane_status", "N-3", sql(["ddane", "dmx"], "SELECT d.capture_id, d.domain, coalesce(dane_queried, false) AS dane_queried, dane_published FROM (SELECT DISTINCT m.capture_id, m.domain FROM dmx m JOIN dnr t ON t.capture_id = m.capture_id AND t.role = 'tlsa' AND t.qname = '_25._tcp.' || m.host) d LEFT JOIN ddane USING (capture_id, domain)"))
def dane_status(spark, sf):
    d = dns(spark, sf)
    return dnsaudit.dane(d, dnsaudit.mx_hosts(d))


@query("address_domains", "N-4", sql(["dres", "dpol"], "SELECT capture_id, ip, arg_max(domain, last_frame * 100000000 + domain_first) AS domain FROM dres JOIN dpol USING (capture_id, domain) GROUP BY 1, 2"))
def address_domains(spark, sf):
    d = dns(spark, sf)
    return dnsaudit.ip_domain(d, dnsaudit.mx_hosts(d), dnsaudit.domain_policy(d))


part(
    "dnsf",
    ["dpol", "dmx", "ddane", "dres", "f"],
    """WITH r AS (SELECT d.capture_id, d.domain, arg_min(f.session_id, f.first_frame) AS any_s, arg_min(f.session_id, f.first_frame) FILTER (is_clear AND NOT is_indeterminate) AS clear_s, count(*) FILTER (is_clear AND NOT is_indeterminate) AS n FROM dres d JOIN f ON f.capture_id = d.capture_id AND f.server_ip = d.ip GROUP BY 1, 2),
 p AS (SELECT dpol.*, r.any_s, r.clear_s, coalesce(r.n, 0) AS n, ddane.dane_published, EXISTS (SELECT 1 FROM dmx WHERE dmx.capture_id = dpol.capture_id AND dmx.domain = dpol.domain) AS has_mx, EXISTS (SELECT 1 FROM dres WHERE dres.capture_id = dpol.capture_id AND dres.domain = dpol.domain) AS has_ip FROM dpol LEFT JOIN r USING (capture_id, domain) LEFT JOIN ddane USING (capture_id, domain))
SELECT capture_id, domain, 'mta_sts_policy_violation' AS category, 'CRITICAL' AS severity, 'FAIL' AS verdict, clear_s AS session_id, n AS affected_sessions FROM p WHERE mta_sts_published AND n > 0
UNION ALL SELECT capture_id, domain, 'mta_sts_not_published', 'MEDIUM', 'FAIL', any_s, 1 FROM p WHERE mta_sts_queried AND mta_sts_published = false UNION ALL SELECT capture_id, domain, 'dane_not_deployed', 'LOW', 'FAIL', NULL, 1 FROM p WHERE has_mx AND dane_published = false
UNION ALL SELECT capture_id, domain, 'tlsrpt_not_configured', 'LOW', 'FAIL', NULL, 1 FROM p WHERE tlsrpt_queried AND tlsrpt_published = false UNION ALL SELECT capture_id, domain, 'dmarc_not_published', 'MEDIUM', 'FAIL', NULL, 1 FROM p WHERE dmarc_queried AND dmarc_published = false
UNION ALL SELECT capture_id, domain, 'dmarc_policy_none', 'LOW', 'FAIL', NULL, 1 FROM p WHERE dmarc_published AND dmarc_policy = 'none' UNION ALL SELECT capture_id, domain, 'dns_correlation_incomplete', 'INFO', 'UNKNOWN', NULL, 1 FROM p WHERE has_mx AND NOT has_ip""",
)


@query("dns_findings", "N-5", sql(["dnsf"], "SELECT * FROM dnsf"))
def dns_findings(spark, sf):
    out = rules.resolve(dnsaudit.dns_drafts(dns(spark, sf), view(spark, sf, "sess")))
    return out.select("capture_id", "domain", "category", "severity", "verdict", "session_id", "affected_sessions")


def _with_domains(spark, sf):
    """Sessions, all findings with those of DNS, and the servers of each domain."""
    f = stage(crypto.decorate(view(spark, sf, "sess")))
    d = dns(spark, sf)
    servers = dnsaudit.domain_servers(dnsaudit.audit(d)[1], f)
    return f, stage(rules.findings(f, dnsaudit.dns_drafts(d, f))), servers


@query("mail_domain_edges", "H-4", sql(["dres", "f"], "SELECT DISTINCT d.capture_id, 'domain:' || d.domain AS source, 'server:' || f.server AS target, 1 AS weight FROM dres d JOIN f ON f.capture_id = d.capture_id AND f.server_ip = d.ip AND f.protocol IS NOT NULL"))
def mail_domain_edges(spark, sf):
    f, found, servers = _with_domains(spark, sf)
    return graph.edges(f, graph.finding_scope(found, f, servers), domain_servers=servers).where("type = 'mx'").select("capture_id", "source", "target", "weight")


@query("dns_finding_scope", "H-5", sql(["dnsf", "dres", "f"], "SELECT DISTINCT x.capture_id, x.category, f.server FROM dnsf x JOIN dres d USING (capture_id, domain) JOIN f ON f.capture_id = d.capture_id AND f.server_ip = d.ip WHERE x.verdict = 'FAIL'"))
def dns_finding_scope(spark, sf):
    f, found, servers = _with_domains(spark, sf)
    return graph.finding_scope(found, f, servers).where(F.col("category").isin(*dims.DNS_CATEGORIES))


# ---- text ----------------------------------------------------------------------------------------------------------------
_ASK = "'Finding ' || page_id || ' f-' || (page_id + 1) || ' on 10.0.0.' || (page_id % 250) || ':25 SMTP-' || lpad(CAST(page_id AS VARCHAR), 4, '0') || CASE WHEN page_id % 2 = 0 THEN ' imap TLS 1.2 ' ELSE ' tlsv1 high ' END || 'port 587 ' || url"


@query(
    "question_entities",
    "M-14",
    f"""WITH q AS (SELECT page_id, url, lower({_ASK}) AS t FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(['F-' || lpad(CAST(page_id AS VARCHAR), 4, '0'), 'F-' || lpad(CAST(page_id + 1 AS VARCHAR), 4, '0')])), ',') AS findings, 'SMTP-' || lpad(CAST(page_id AS VARCHAR), 4, '0') AS sessions, '10.0.0.' || (page_id % 250) AS ips, '25,587' AS ports,
 CASE WHEN page_id % 2 = 0 THEN 'IMAP' ELSE '' END AS protocols, CASE WHEN page_id % 2 = 0 THEN 'TLS 1.2' ELSE 'TLS 1.0' END AS tls_versions, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'HIGH' END AS severities,
 concat_ws(',', CASE WHEN regexp_matches(t, 'cert|x\\.?509|expir|self.?signed|hostname|chain|sha-?1') THEN 'certificate' END, CASE WHEN regexp_matches(t, 'cipher|cbc|rc4|3des|aead|forward secrecy|\\bfs\\b|pfs') THEN 'cipher' END, CASE WHEN regexp_matches(t, 'starttls|stls|strip|downgrade|upgrade') THEN 'starttls' END,
  CASE WHEN regexp_matches(t, 'credential|password|passwd|pwd|login|auth|username|account') THEN 'credential' END, CASE WHEN regexp_matches(t, 'cleartext|plain.?text|unencrypted|not encrypted|in clear|no tls') THEN 'cleartext' END, CASE WHEN regexp_matches(t, 'mta.?sts|dane|dmarc|tls.?rpt|dns') THEN 'dns' END,
  CASE WHEN regexp_matches(t, 'pqc|quantum|ml-?kem|kyber|hybrid') THEN 'pqc' END, CASE WHEN regexp_matches(t, 'risky|high risk|critical risk|dangerous') THEN 'risk' END) AS topics FROM q""",
)
def question_entities(spark, sf):
    p = load(spark, sf, "pages")
    k = F.col("page_id").cast("string")
    ask = F.concat(
        F.lit("Finding "), k, F.lit(" f-"), (F.col("page_id") + 1).cast("string"), F.lit(" on 10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit(":25 SMTP-"), F.lpad(k, 4, "0"),
        F.when(F.col("page_id") % 2 == 0, F.lit(" imap TLS 1.2 ")).otherwise(F.lit(" tlsv1 high ")), F.lit("port 587 "), F.col("url"),
    )
    e = words.entities(ask)
    return p.select("page_id", *[text(e[n]).alias(n) for n in ("findings", "sessions", "ips", "ports", "protocols", "tls_versions", "severities", "topics")])


@query(
    "document_topics",
    "M-14",
    """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, 'cert|x\\.?509|expir|self.?signed|hostname|chain|sha-?1') THEN 'certificate' END, CASE WHEN regexp_matches(t, 'cipher|cbc|rc4|3des|aead|forward secrecy|\\bfs\\b|pfs') THEN 'cipher' END, CASE WHEN regexp_matches(t, 'starttls|stls|strip|downgrade|upgrade') THEN 'starttls' END,
  CASE WHEN regexp_matches(t, 'credential|password|passwd|pwd|login|auth|username|account') THEN 'credential' END, CASE WHEN regexp_matches(t, 'cleartext|plain.?text|unencrypted|not encrypted|in clear|no tls') THEN 'cleartext' END, CASE WHEN regexp_matches(t, 'mta.?sts|dane|dmarc|tls.?rpt|dns') THEN 'dns' END,
  CASE WHEN regexp_matches(t, 'pqc|quantum|ml-?kem|kyber|hybrid') THEN 'pqc' END, CASE WHEN regexp_matches(t, 'risky|high risk|critical risk|dangerous') THEN 'risk' END) AS topics FROM (SELECT doc_id, lower(text) AS t FROM documents) q""",
)
def document_topics(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text(words.entities(F.col("text"))["topics"]).alias("topics"))


@query("first_upload", "IO-2", "SELECT doc_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def first_upload(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return dedup_first(rows, "sha256", "doc_id").select("doc_id", "sha256")


