"""Readers of decoded tables and the idempotent writer."""

import json

from pyspark.sql import functions as F

from postern.sources import readers, sinks


def test_manifest_and_rejects(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(bytes.fromhex("d4c3b2a1") + b"x" * 20)
    (tmp_path / "b.pcapng").write_bytes(bytes.fromhex("0a0d0d0a") + b"y")
    (tmp_path / "c.txt").write_bytes(b"hello")
    (tmp_path / "d.pcap").write_bytes(bytes.fromhex("d4c3b2a1") + b"x" * 20)
    m = readers.read_manifest(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["container_format"] for r in m.collect()}
    assert got == {"a.pcap": "pcap", "b.pcapng": "pcapng", "c.txt": None, "d.pcap": "pcap"}
    assert readers.rejects(m).count() == 1
    assert readers.dedup_first(m, "sha256", "path").count() == 3
    seen = m.where(F.col("path").endswith("b.pcapng"))
    assert readers.new_captures(m, seen).count() == 3


def test_packets_segments_dns(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("1\t0.5\t3\t10.0.0.1\t\t4000\t10.0.0.2\t\t25\t10\t1\t0\tFalse\n2\tbad\t3\t\tfe80::1\t25\t\tfe80::2\tx\t\tTrue\t\t1\n3\t1\t\t10.0.0.1\t\t1\t10.0.0.2\t\t2\t3\t0\t0\t0\n4\t1\t5\t\t\t1\t10.0.0.2\t\t2\t3\t0\t0\t0\n")
    rows = {r["frame"]: r for r in readers.read_packets(spark, str(p)).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["syn"] and not rows[1]["rst"] and rows[1]["tcp_len"] == 10
    assert rows[2]["ts"] == 0.0 and rows[2]["src_ip"] == "fe80::1" and rows[2]["dst_port"] == 0 and rows[2]["rst"]
    s = tmp_path / "s.tsv"
    s.write_text("1\t0.5\t3\t1.1.1.1\t\t40\t2.2.2.2\t\t25\t1\t3\t32:32:30\n2\t0.6\t4\t1.1.1.1\t\t40\t2.2.2.2\t\t25\t1\t3\t2a20\n3\t0.6\t3\t1.1.1.1\t\t40\t2.2.2.2\t\t25\t4\t3\tzz\n4\t0.6\t3\t1.1.1.1\t\t40\t2.2.2.2\t\t25\t4\t3\t\n")
    wanted = spark.createDataFrame([(3,)], "stream bigint")
    got = readers.read_segments(spark, str(s), wanted).collect()
    assert [(r["frame"], bytes(r["payload"])) for r in got] == [(1, b"220")]
    d = tmp_path / "d.tsv"
    d.write_text("7\t1.0\tTrue\tMail.Example.\t15\t0\t\tMX1.Example.,mx2.example\t\t2\n8\t1.0\tFalse\t\t1\t0\t\t\t\t0\n")
    r = readers.read_dns(spark, str(d)).collect()
    assert len(r) == 1 and r[0]["qname"] == "mail.example" and r[0]["mx"] == ["mx1.example", "mx2.example"] and r[0]["txt"] == [] and r[0]["is_response"]


def test_policy_document(spark, tmp_path):
    doc = {"_comment": ["x"], "version": "1.0", "rules": {"starttls_stripping": {"severity": "CRITICAL", "confidence": 0.9, "title": "t", "min_sessions_for_baseline": 3}}, "posture_weights": {"_comment": "w", "transport": 0.3}}
    f = tmp_path / "policy.json"
    f.write_text(json.dumps(doc, indent=1))
    rules, weights = readers.load_policy(spark, str(f))
    r = rules.first()
    assert (r["category"], r["severity_rank"], r["min_sessions_for_baseline"], r["standards"]) == ("starttls_stripping", 0, 3, [])
    assert [tuple(x) for x in weights.collect()] == [("transport", 0.3)]


def test_rewrite_replaces_only_its_capture(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_results(spark.createDataFrame([(1, "a"), (2, "b")], "capture_id int, v string"), out)
    sinks.write_results(spark.createDataFrame([(2, "c"), (2, "d")], "capture_id int, v string"), out)
    assert sorted((r["capture_id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_a_failed_version_leaves_the_last_one_readable(spark, tmp_path):
    out = str(tmp_path / "pub")
    assert sinks.published(spark, out) == {}
    first = {"a": spark.range(3), "b": spark.range(5)}
    assert sinks.publish(spark, first, out) == 1
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).alias("x"))
    try:
        sinks.publish(spark, {"a": spark.range(9), "b": broken}, out)
        raise AssertionError("must fail")
    except AssertionError:
        raise
    except Exception as e:
        assert "stop" in str(e)
    now = sinks.published(spark, out)
    assert (now["a"].count(), now["b"].count()) == (3, 5)
    assert sinks.publish(spark, {"a": spark.range(7)}, out) == 2
    assert {k: v.count() for k, v in sinks.published(spark, out).items()} == {"a": 7} and sinks.published(spark, out, 1)["b"].count() == 5


def test_digests_of_a_slice_do_not_depend_on_the_partitions(spark):
    from postern.operators import flows

    rows = [(1, s, f, "a", 1, "b", 25, f % 90) for f in range(4000) for s in [f % 3]]
    p = spark.createDataFrame(rows, "capture_id int, stream int, frame bigint, src_ip string, src_port int, dst_ip string, dst_port int, tcp_len int")
    t = spark.createDataFrame([(1, 5, 2, 0, 400), (1, 9, 1, 1000, 2500)], "capture_id int, target int, stream int, first_frame bigint, last_frame bigint")
    one, two = ([tuple(r) for r in flows.custody(p.repartition(n), t).orderBy("target").collect()] for n in (1, 7))
    assert one == two and [(r[1], r[3]) for r in one] == [(t, sum(s[1] == k and a <= s[2] <= b for s in rows)) for t, k, a, b in ((5, 2, 0, 400), (9, 1, 1000, 2500))]
    changed = flows.custody(p.where("frame <> 3999"), t).orderBy("target").collect()
    assert [r.sha256 for r in changed] == [r[5] for r in one] and changed[0].parent_sha256 != one[0][6]


def test_a_segment_line_is_split_once(spark):
    line = F.concat_ws("\t", F.col("id").cast("string"), F.lit("0"), F.col("id").cast("string"), F.lit("10.0.0.1"), F.lit(""), F.lit("25"), F.lit("10.0.0.2"), F.lit(""), F.lit("4000"), F.lit("7"), F.lit("0"), F.col("p"))
    rows = spark.createDataFrame([(1, "61:62"), (2, "616"), (3, "6g"), (4, ""), (5, None), (6, "0A\n"), (7, "é1")], "id bigint, p string")
    found = readers.parse_segments(rows.select(line.alias("value")))
    assert [(r["stream"], bytes(r["payload"])) for r in found.collect()] == [(1, b"ab")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
