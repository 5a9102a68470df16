"""The blocked way gives the plain window's results, whatever the block size."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from postern.operators import dialogue, flows, fsm, ordered, reassembly


def rows(df):
    return sorted(map(str, df.collect()))


def test_running_blocked_equals_plain(spark):
    rng = random.Random(1)
    data = [(k, i * 3, rng.randrange(100) if rng.random() < 0.8 else None) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(data, "k int, pos int, v int")
    aggs = {"hi": ("max", F.col("v")), "total": ("sum", F.col("v")), "lo": ("min", F.col("v"))}
    for inclusive in (False, True):
        plain = ordered.running(df, ["k"], ["pos"], None, aggs, inclusive)
        blocked = ordered.running(df, ["k"], ["pos"], F.floor(F.col("pos") / 16), aggs, inclusive)
        assert rows(plain.select("k", "pos", *aggs)) == rows(blocked.select("k", "pos", *aggs))


def test_numbered_equals_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 501).alias("pos"))
    got = ordered.numbered(df, ["k"], [F.col("pos")], [F.floor(F.col("pos") / 40)])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("bigint"))
    assert rows(got.select("k", "pos", "rn")) == rows(want.select("k", "pos", "rn"))


def test_exact_median_even_and_odd(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 200.0), ("a", 3.0), ("a", 100.0), ("b", 5.0), ("b", -7.5), ("b", 900.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["median"] for r in ordered.exact_median(df, ["k"], F.col("v"), per_octave=1).collect()}
    assert got == {"a": 51.5, "b": 5.0}


def test_hot_stream_reassembly_is_whole(spark):
    rng = random.Random(7)
    segs = [(0, "c", rng.randrange(0, 400), rng.randrange(1, 30), i) for i in range(300)] + [(1, "c", s, 10, s) for s in range(0, 60, 10)]
    df = spark.createDataFrame(segs, "flow int, dir string, seq int, len int, frame int")
    plain = reassembly.byte_ranges(df, ["flow", "dir"])
    hot = reassembly.byte_ranges(df, ["flow", "dir"], block=32)
    cols = ["flow", "seq", "len", "frame", "new_from", "new_len", "hole", "start", "stop"]
    assert rows(plain.select(*cols)) == rows(hot.select(*cols))
    # brute force over single bytes: covered bytes and the frame that carried each first
    covered = set()
    for f, _, s, n, _ in segs:
        covered |= {(f, b) for b in range(s, s + n)}
    assert plain.agg(F.sum("new_len")).first()[0] == len(covered)
    offsets = spark.createDataFrame([(0, "c", o) for o in range(0, 450, 7)], "flow int, dir string, offset bigint")
    a = reassembly.frame_for(offsets, plain, ["flow", "dir"])
    b = reassembly.frame_for(offsets, plain, ["flow", "dir"], block=64)
    assert rows(a) == rows(b)


def test_lines_across_segments_and_terminators(spark):
    data = b"220 hi\r\nEHLO x\r\n\r\nlone\rcr\nlast \xff tail"
    for size in (1, 3, 7, 100):
        parts = [(0, i, i, bytearray(data[i : i + size])) for i in range(0, len(data), size)]
        df = spark.createDataFrame(parts, "flow int, start bigint, frame int, payload binary")
        want, off = [], 0
        for raw in data.splitlines(keepends=True):
            want.append((off, raw.rstrip(b"\r\n").decode("utf-8", "replace")))
            off += len(raw)
        for block in (1000, 8):
            got = [(r["line_offset"], r["text"]) for r in reassembly.lines(df, ["flow"], block=block).orderBy("line_no").collect()]
            assert got == want, (size, block)


def test_dialogue_context_blocked_equals_plain(spark):
    script = [
        ("SMTP", [("s2c", "220 mx ESMTP"), ("c2s", "EHLO a"), ("s2c", "250-STARTTLS"), ("s2c", "454 stray"), ("c2s", "STARTTLS"), ("s2c", "454 no"), ("s2c", "454 again"),
                  ("c2s", "AUTH LOGIN"), ("s2c", "334 VXNlcm5hbWU6"), ("c2s", "cm9vdA=="), ("s2c", "334 UGFzc3dvcmQ6"), ("c2s", "dG9vcg=="), ("c2s", "DATA"), ("c2s", "QUIT")]),
        ("IMAP", [("s2c", "* OK ready"), ("c2s", "a1 AUTHENTICATE PLAIN"), ("c2s", "a2 AUTHENTICATE PLAIN"), ("c2s", "a3 STARTTLS"), ("s2c", "a9 OK no"), ("s2c", "a3 OK go"), ("s2c", "a3 OK twice")]),
        ("POP3", [("s2c", "+OK hi"), ("c2s", "CAPA"), ("s2c", "+OK list"), ("s2c", "STLS"), ("s2c", "."), ("s2c", "STLS"), ("c2s", "STLS"), ("s2c", "-ERR"), ("s2c", "+OK x"), ("c2s", "USER bob@x.y"), ("c2s", "PASS pw")]),
    ]
    data = [(0, f, p, d, i + 1, 0, t) for f, (p, ls) in enumerate(script) for i, (d, t) in enumerate(ls)]
    df = spark.createDataFrame(data, "capture_id int, flow int, protocol string, dir string, frame int, line_offset int, text string")
    events = dialogue.events(df)
    got = [(r["flow"], r["frame"], r["kind"]) for r in events.orderBy("flow", "frame", "event_no").collect()]
    assert (0, 4, "upgrade_rejected") not in got and (0, 6, "upgrade_rejected") in got and (0, 7, "upgrade_rejected") not in got
    assert [f for fl, f, k in got if k == "auth_credential"] == [10, 12, 3, 11]
    assert (0, 13, "mail_transaction") in got
    assert [(f, k) for fl, f, k in got if fl == 1 and k.startswith("upgrade_")] == [(4, "upgrade_requested"), (6, "upgrade_accepted")]
    assert [(f, k) for fl, f, k in got if fl == 2 and k.startswith("upgrade_")] == [(4, "upgrade_advertised"), (7, "upgrade_requested"), (8, "upgrade_rejected")]
    old = dialogue.FRAMES_PER_BLOCK
    plain = rows(dialogue.with_context(df).drop("last_prompt", "last_user"))
    try:
        dialogue.FRAMES_PER_BLOCK = 3
        hot = rows(dialogue.with_context(df).drop("last_prompt", "last_user"))
    finally:
        dialogue.FRAMES_PER_BLOCK = old
    assert plain == hot


def test_state_machine_against_a_walk(spark):
    rng = random.Random(3)
    kinds = [*fsm.KINDS, "upgrade_advertised", "auth_credential", "mail_transaction"]
    data = [(0, f, i + 1, 0, 0, rng.choice(kinds)) for f in range(20) for i in range(40)]
    ev = spark.createDataFrame(data, "capture_id int, flow int, frame bigint, line_offset bigint, event_no int, kind string")
    fl = spark.createDataFrame([(0, f, f % 4 == 0, f % 3 != 0, f % 5 == 0) for f in range(20)], "capture_id int, flow int, implicit_tls boolean, session_complete boolean, has_gaps boolean")
    steps = rows(fsm.replay(ev, fl, frames_per_block=7))
    assert steps == rows(fsm.replay(ev, fl))
    got = {r["flow"]: r for r in fsm.outcomes(ev, fl).collect()}
    for f in range(20):
        state = fsm.IMPLICIT if f % 4 == 0 else fsm.TCP
        est = auth = False
        for _, _, _, _, _, k in (r for r in data if r[1] == f):
            if k in fsm.KINDS:
                before, state = state, fsm.NEXT_STATE[k][state]
                est |= k == "tls_application_data" and before in (fsm.NEGOTIATING, fsm.IMPLICIT)
            auth |= k == "auth_credential" and not est
        assert got[f]["tls_established"] == est and got[f]["cleartext_auth"] == auth


def test_strict_time_order_flag(spark):
    data = [(0, i, float(i), 1) for i in range(20)] + [(1, i, float(i if i != 9 else 3), 1) for i in range(20)]
    df = spark.createDataFrame(data, "capture_id int, frame bigint, ts double, tcp_len int")
    old = flows.FRAMES_PER_BLOCK
    try:
        for size in (4, 9, 1000):
            flows.FRAMES_PER_BLOCK = size
            got = {r["capture_id"]: r["strict_time_order"] for r in flows.capture_stats(df).collect()}
            assert got == {0: True, 1: False}
    finally:
        flows.FRAMES_PER_BLOCK = old


def test_scale_blocks_ascend_with_the_value(spark):
    values = sorted([0.0, -1e300, 1e300, 5e-324, -5e-324, 1.0, 1.01, -1.01, 0.5, 124.9, 125.0, -3.5, 1e-9, 7e18])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in df.select("i", ordered.scale_block(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) >= len(values) - 2


def test_a_flow_of_a_million_sparse_frames(spark):
    """One event a block of frames: the maps compose in a tree, and every event still knows the state before it."""
    n = 1_000_000
    kind = F.when(F.col("id") % 2 == 0, F.lit("upgrade_requested")).otherwise(F.lit("upgrade_rejected"))
    ev = spark.range(n).select(F.lit(0).alias("capture_id"), F.lit(0).alias("flow"), (F.col("id") * 1000).alias("frame"), F.lit(0).cast("bigint").alias("line_offset"), F.lit(0).alias("event_no"), kind.alias("kind"))
    fl = spark.createDataFrame([(0, 0, False)], "capture_id int, flow int, implicit_tls boolean")
    steps = fsm.replay(ev, fl)
    asked = F.col("k") == fsm.KINDS.index("upgrade_requested")
    before = F.when(F.col("frame") == 0, fsm.TCP).when(asked, fsm.REJECTED).otherwise(fsm.REQUESTED)
    assert steps.agg(F.count(F.lit(1)), F.count_if(F.col("before") == before), F.count_if(F.col("after") == F.when(asked, fsm.REQUESTED).otherwise(fsm.REJECTED))).first()[:] == (n, n, n)


def test_event_time_and_metadata(spark):
    script = [("s2c", "220 mx"), ("c2s", "EHLO me"), ("s2c", "250-STARTTLS"), ("s2c", "250 AUTH PLAIN  LOGIN"), ("c2s", "STARTTLS"), ("s2c", "454 no"), ("c2s", "AUTH LOGIN"), ("s2c", "334 VXNlcm5hbWU6"), ("c2s", "cm9vdA==")]
    df = spark.createDataFrame([(0, 0, "SMTP", d, i, 0, i * 0.5, t) for i, (d, t) in enumerate(script)], "capture_id int, flow int, protocol string, dir string, frame int, line_offset int, ts double, text string")
    ev = dialogue.events(df)
    got = {r.kind: (r.frame, r.ts, {k: v for k, v in r.meta.asDict().items() if v is not None}) for r in ev.collect()}
    assert got["greeting"] == (0, 0.0, {"banner": "mx"}) and got["upgrade_advertised"][2] == {"keyword": "STARTTLS"} and got["capability_request"][2] == {"identity": "me"}
    assert got["capability_response"][2] == {"mechanisms": ["PLAIN", "LOGIN"]} and got["upgrade_requested"] == (4, 2.0, {"command": "STARTTLS"}) and got["upgrade_rejected"] == (5, 2.5, {"reply_code": "454"})
    assert got["auth_requested"][2] == {"mechanism": "LOGIN"} and got["auth_credential"][2] == {"field": "username"}
    fl = spark.createDataFrame([(0, 0, False)], "capture_id int, flow int, implicit_tls boolean")
    said = [tuple(r)[4:] for r in fsm.described(ev, fl).orderBy("frame").collect()]
    assert said == [(0.0, "TCP_CONNECTED", "PLAINTEXT_EMAIL", "server greeting"), (2.0, "PLAINTEXT_EMAIL", "TLS_REQUESTED", "STARTTLS requested"), (2.5, "TLS_REQUESTED", "STARTTLS_REJECTED", "server rejected upgrade (454)")]
