"""Small inline scenarios for branches the shared view does not reach."""

from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto, text
from postern.ml import anomaly, clusters
from postern.operators import certs, dnsaudit, rules


def stripping_rows(spark, rows):
    df = spark.createDataFrame(rows, "session_id bigint, server_port int, upgrade_advertised boolean, upgrade_advertised_mangled boolean")
    return df.select(
        F.lit(1).cast("bigint").alias("capture_id"), "session_id", F.lit("SMTP").alias("protocol"), F.lit("10.0.0.1").alias("server_ip"), "server_port",
        F.lit("STARTTLS_NOT_ADVERTISED").alias("encryption_state"), F.lit(False).alias("is_indeterminate"), "upgrade_advertised", "upgrade_advertised_mangled",
        F.lit(None).cast("bigint").alias("at_mangled"), F.col("session_id").alias("first_frame"),
    )


def test_stripping_confidence_tiers(spark):
    clean = [(i, 587, True, False) for i in range(6)]
    same = rules.stripping_drafts(stripping_rows(spark, clean + [(6, 587, False, True), (7, 587, False, True)])).collect()
    assert {(r["baseline_scope"], r["confidence_override"], r["affected_sessions"]) for r in same} == {("server_port", 0.9, 2)}
    host = rules.stripping_drafts(stripping_rows(spark, clean[:4] + [(9, 25, False, True)])).collect()
    assert [(r["baseline_scope"], r["confidence_override"]) for r in host] == [("host", 0.7)]
    alone = rules.stripping_drafts(stripping_rows(spark, [(9, 25, False, True)])).collect()
    assert [(r["baseline_scope"], r["confidence_override"]) for r in alone] == [("none", 0.5)]


def test_wildcards_and_missing_names(spark):
    df = spark.createDataFrame([("b.c.a.com", ["*.a.com"]), ("b.a.com", ["*.a.com"]), ("A.com.", ["a.COM"]), (None, ["x"]), ("x.y", [])], "h string, names array<string>")
    got = [r[0] for r in df.select(certs.hostname_match(F.col("h"), F.col("names"), F.lit(None).cast("string"))).collect()]
    assert got == [False, True, True, None, False]


def test_expiry_boundaries(spark):
    day = 86400
    df = spark.createDataFrame([(0, 30 * day), (0, 31 * day), (0, -1), (10, 99), (0, 0)], "not_before bigint, not_after bigint").withColumn("capture_ts", F.lit(0))
    got = [(r["cert_expired"], r["cert_not_yet_valid"], r["cert_days_to_expiry"], r["cert_expiring_soon"]) for r in certs.validity(df).collect()]
    assert got == [(False, False, 30, True), (False, False, 31, False), (True, False, None, False), (False, True, None, False), (False, False, 0, True)]


DNS = "capture_id bigint, frame bigint, is_response boolean, qname string, qtype int, rcode int, txt array<string>, mx array<string>, addresses array<string>, answer_count int"


def test_dns_is_order_dependent_and_silent_without_evidence(spark):
    rows = [
        (1, 1, True, "mx.d.com", 1, 0, [], [], ["9.9.9.9"], 1),
        (1, 2, True, "d.com", 15, 0, [], ["MX.d.com."], [], 1),
        (1, 3, True, "mx.d.com", 1, 0, [], [], ["1.1.1.1"], 1),
        (1, 4, False, "_mta-sts.d.com", 16, 0, [], [], [], 0),
        (1, 5, True, "_mta-sts.d.com", 16, 3, [], [], [], 0),
        (1, 6, True, "_mta-sts.d.com", 16, 0, ["v=STSv1; id=7"], [], [], 1),
    ]
    dns = spark.createDataFrame(rows, DNS)
    policy, pairs = dnsaudit.audit(dns)
    assert [(r["domain"], r["ip"]) for r in pairs.collect()] == [("d.com", "1.1.1.1")]
    p = policy.first()
    assert p["mta_sts_published"] is True and p["mta_sts_id"] == "7" and p["tlsrpt_published"] is None and p["dane_published"] is None
    sess = spark.createDataFrame([(1, 1, "1.1.1.1", 25, "PLAINTEXT_THROUGHOUT", False, 10)], "capture_id bigint, session_id bigint, server_ip string, server_port int, encryption_state string, is_indeterminate boolean, first_frame bigint")
    got = dnsaudit.dns_drafts(dns, sess).collect()
    assert [(r["category"], r["session_id"], r["frames"]) for r in got] == [("mta_sts_policy_violation", 1, [2, 4, 5, 6, 10])]
    assert dnsaudit.dns_drafts(spark.createDataFrame([], DNS), sess).count() == 0


def test_suite_decomposition_edges(spark):
    got = {r["cipher_suite"]: r for r in crypto.dim_suite(spark).collect()}
    assert len(got) == len(dims.CIPHER_SUITES)
    ccm8, null, tdes = got["TLS_AES_128_CCM_8_SHA256"], got["TLS_NULL_WITH_NULL_NULL"], got["TLS_DHE_DSS_WITH_3DES_EDE_CBC_SHA"]
    assert (ccm8["mode"], ccm8["key_size"], ccm8["forward_secrecy"], ccm8["key_exchange"]) == ("8", 128, True, None)
    assert (null["key_exchange"], null["authentication"], null["key_size"], null["weaknesses"], null["forward_secrecy"]) == ("NULL", "NULL", None, ["NULL"], False)
    assert (tdes["authentication"], tdes["key_size"], tdes["weaknesses"]) == ("DSS", 168, ["3DES", "DES", "CBC"])
    assert got["TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256"]["mode"] == "POLY1305"


def test_mangled_and_masked(spark):
    df = spark.createDataFrame([("XXXXXXXA",), ("STARTTLS",), ("SIZE 1024",), ("aaaaa",), ("café",), ("",)], "t string")
    assert [r[0] for r in df.select(text.is_mangled(F.col("t"))).collect()] == [True, False, False, False, True, False]
    users = spark.createDataFrame([("alice@corp.local",), ("root",), ("",)], "u string")
    assert [r[0] for r in users.select(text.mask_user(F.col("u"))).collect()] == ["a****@corp.local", "r****", None]


def test_components_match_brute_force(spark):
    import random

    rng = random.Random(5)
    pts = [(i, rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(0, 8)) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, a double, b double, c double")
    z = {r["id"]: (r["a"], r["b"], r["c"]) for r in clusters.standardise(df, ["a", "b", "c"]).collect()}
    eps, parent = 0.3, list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(150):
        for j in range(i):
            if sum((p - q) ** 2 for p, q in zip(z[i], z[j])) <= eps * eps:
                parent[find(i)] = find(j)
    want = {}
    for i in range(150):
        want.setdefault(find(i), set()).add(i)
    got = {}
    for r in clusters.cluster_clients(df, ["id"], ["a", "b", "c"], eps=eps).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_ranks_a_planted_outlier_first(spark):
    df = spark.range(300).select(F.lit(1).cast("bigint").alias("g"), "id", F.when(F.col("id") == 17, 50.0).otherwise(F.rand(3)).alias("x"), F.when(F.col("id") == 17, -40.0).otherwise(F.rand(4)).alias("y"))
    out = anomaly.isolation_forest(df.cache(), "g", ["id"], ["x", "y"], trees=20)
    top = out.orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 17 and top["is_outlier"] and top["anomaly_score"] == 1.0
    assert 10 <= out.where("is_outlier").count() <= 30


def test_projection_and_clusters_stay_within_a_population(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    pts = [(g, i, rng.gauss(0, 1 + g), rng.gauss(0, 2), 7.0, rng.random()) for g in range(2) for i in range(40)]
    df = spark.createDataFrame(pts, "g int, id int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    got = {(r["g"], r["id"]): (r["x"], r["y"]) for r in clusters.project_2d(df, ["g", "id"], cols, within=["g"]).collect()}
    for g in range(2):
        x = np.array([p[2:] for p in pts if p[0] == g])
        z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        _, vectors = np.linalg.eigh(z.T @ z)
        for k, v in ((0, vectors[:, -1]), (1, vectors[:, -2])):
            want = z @ (v * (1 if v[np.abs(v).argmax()] >= 0 else -1))
            assert np.allclose(want, [got[g, i][k] for i in range(40)])
    rows = clusters.cluster_clients(df.unionByName(df.where("g = 0")), ["g", "id"], cols, within=["g"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], set()).add(r["g"])
    assert len(rows) == 120 and all(len(g) == 1 for g in by.values())


def test_many_stacks_in_one_coarse_cell(spark):
    """100,000 distinct stacks that fall into one cell of side eps after scaling, and two that don't."""
    n = 100_000
    pts = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10**9).alias("a"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10**9)) / 10**9).alias("b"), (F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(10**9)) / 10**9).alias("c"))
    far = spark.createDataFrame([(n, 5e4, 5e4, 5e4), (n + 1, -5e4, -5e4, -5e4)], "id bigint, a double, b double, c double")
    out = clusters.cluster_clients(pts.unionByName(far), ["id"], ["a", "b", "c"])
    assert sorted(tuple(r) for r in out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.bool_or("is_noise").alias("noise")).select("n", "size", "noise").collect()) == [(1, 1, True), (1, 1, True), (n, n, False)]


def test_brief_names_the_first_three_steps_of_a_plan(spark):
    from postern.plans import report

    sessions = spark.createDataFrame([(1, "SMTP", "c", "s", 25, "TLS_ESTABLISHED", False, False)], "capture_id bigint, protocol string, client_ip string, server_ip string, server_port int, encryption_state string, cleartext_auth boolean, is_anomalous boolean")
    ranked = spark.createDataFrame([], "capture_id bigint, verdict string, severity string, finding_ref string, tier string, rank bigint")
    scores = spark.createDataFrame([(1, 40)], "capture_id bigint, overall bigint")
    ready = spark.createDataFrame([(1, 10, "low", 5.0)], "capture_id bigint, score bigint, level string, hndl_pct double")
    scenarios = spark.createDataFrame([], "capture_id bigint, scenario string, score bigint")
    steps = spark.createDataFrame([(1, i, f"fix{i}", 40 + i, 41 + i) for i in range(1, 6)], "capture_id bigint, step int, fix_id string, score_before int, score_after int")
    rows = sorted((r.ordinal, r.fact, r.value) for r in report.brief_facts(sessions, ranked, scores, ready, scenarios, steps).where("kind = 'action'").collect())
    assert rows == [(16, "step 1", "fix1"), (17, "step 2", "fix2"), (18, "step 3", "fix3"), (19, "posture_before", "41"), (20, "posture_after", "44")]
