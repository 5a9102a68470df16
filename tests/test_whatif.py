"""Plans and minimal fix sets against plain Python over single projections."""

from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.operators import rules, whatif
from postern.plans.views import view
from postern.session import stage

SF = "/root/testdata/sf0.001"


def one_server(spark):
    """The sessions of the server with the most kinds of failed findings, and those findings."""
    every = stage(crypto.decorate(view(spark, SF, "sess")))
    found = stage(rules.findings(every).where("verdict = 'FAIL'"))
    key = ["capture_id", "server_ip", "server_port"]
    best = found.where("session_id is not null").join(every.select("session_id", *key), ["capture_id", "session_id"]).groupBy(*key).agg(F.count_distinct("category").alias("n"), F.count("*").alias("m"))
    at = best.orderBy(F.desc("n"), "m", *key).first()
    sessions = stage(every.where((F.col("capture_id") == at.capture_id) & (F.col("server_ip") == at.server_ip) & (F.col("server_port") == at.server_port)))
    return sessions, stage(rules.findings(sessions))


def test_minimal_fixes_are_the_first_combination_that_clears(spark):
    sessions, found = one_server(spark)
    fails = [r for r in found.where("verdict = 'FAIL' and session_id is not null").collect()]
    options = defaultdict(list)
    for fid, effort, categories in sorted(dims.FIXES, key=lambda f: (len(f[2]), f[1])):
        for c in categories:
            options[c].append(fid)
    of = defaultdict(dict)
    for r in fails:
        if r.category in options:
            of[r.session_id][r.category] = min((r.severity_rank, r.finding_frame or 0), of[r.session_id].get(r.category, (99, 0)))
    tried = {}
    for s, categories in of.items():
        for c in categories:
            others = [options[x][0] for x in sorted(categories, key=lambda x: (categories[x], x)) if x != c]
            pool = list(dict.fromkeys([*options[c], *others]))
            tried[s, c] = [*[[f] for f in pool], *[[a, b] for a, b in combinations(pool, 2)]][:12]
    left = {}
    for combo in {tuple(sorted(x)) for xs in tried.values() for x in xs}:
        after = whatif.project(whatif.with_fixes(sessions, list(combo)))
        left[combo] = {(r.session_id, r.category) for r in rules.findings(after).where("verdict = 'FAIL'").collect()}
    want = set()
    for at, combos in tried.items():
        clear = [x for x in combos if at not in left[tuple(sorted(x))]]
        want.add((*at, ",".join(clear[0] if clear else combos[0]), bool(clear)))
    got = {(r.session_id, r.category, ",".join(r.fixes), r.cleared) for r in whatif.minimal_fixes(sessions, found).collect()}
    assert got == want and len(want) > 5


def test_a_plan_takes_dns_findings_along(spark):
    """With one domain's findings, the fixes that resolve them become steps, and what no fix resolves is counted to the end."""
    sessions, found = one_server(spark)
    at = sessions.first()
    server = f"{at.server_ip}:{at.server_port}"
    empty = {c: F.lit(None).cast(found.schema[c].dataType) for c in found.columns}
    names = ["dmarc_not_published", "dane_not_deployed"]
    dns = found.limit(1).withColumns(empty).select(*[c for c in found.columns if c not in ("category",)], F.explode(F.array(*map(F.lit, names))).alias("category"))
    dns = dns.withColumns({"capture_id": F.lit(at.capture_id), "domain": F.lit("a.test"), "verdict": F.lit("FAIL"), "severity": F.lit("MEDIUM"), "severity_rank": F.lit(2)})
    both = stage(found.unionByName(dns))
    servers = spark.createDataFrame([(at.capture_id, "a.test", server)], "capture_id bigint, domain string, server string")
    plain, whole = whatif.plan(sessions, found).collect(), whatif.plan(sessions, both, servers).collect()
    assert "publish_dmarc" not in {r.fix_id for r in plain} and "publish_dmarc" in {r.fix_id for r in whole}
    assert "deploy_mta_sts_dane" in {r.fix_id for r in whole}
    last = lambda rows: max(rows, key=lambda r: r.step).findings_after
    assert last(whole) <= last(plain)
    first = min(whole, key=lambda r: r.step)
    assert first.findings_after >= min(plain, key=lambda r: r.step).findings_after


def test_carried_dns_of_a_fix_list(spark):
    cols = "capture_id bigint, domain string, category string, verdict string"
    rows = [(1, "a", "mta_sts_policy_violation", "FAIL"), (1, "b", "mta_sts_policy_violation", "FAIL"), (1, "a", "dmarc_policy_none", "FAIL"), (1, "a", "dns_correlation_incomplete", "UNKNOWN"), (1, None, "weak_cipher_suite", "FAIL")]
    found = spark.createDataFrame(rows, cols)
    servers = spark.createDataFrame([(1, "a", "10.0.0.1:25"), (1, "b", "10.0.0.2:25"), (1, "b", "10.0.0.3:25")], "capture_id bigint, domain string, server string")
    states = [(1, "10.0.0.1", 25, "TLS_ESTABLISHED"), (1, "10.0.0.2", 25, "TLS_ESTABLISHED"), (1, "10.0.0.3", 25, "STARTTLS_NEGOTIATION_FAILED")]
    after = spark.createDataFrame(states, "capture_id bigint, server_ip string, server_port int, encryption_state string")

    def kept(fixes):
        return sorted((r.domain, r.category) for r in whatif.carried_dns(found, after, fixes, servers).collect())

    assert kept([]) == [("a", "dmarc_policy_none"), ("a", "dns_correlation_incomplete"), ("b", "mta_sts_policy_violation")]
    assert kept(["publish_dmarc"]) == [("a", "dns_correlation_incomplete"), ("b", "mta_sts_policy_violation")]
    assert kept(["deploy_mta_sts_dane", "publish_dmarc"]) == [("a", "dns_correlation_incomplete")]


def test_trials_write_only_what_their_rules_read(spark, monkeypatch):
    """Copies of sessions, one for each trial, hold no column that neither rules nor posture read, and no profile of their own."""
    sessions, found = one_server(spark)
    seen = []
    monkeypatch.setattr(whatif, "stage", lambda df: (seen.append(df.columns), stage(df))[1])
    whatif.minimal_fixes(sessions, found)
    copies = [c for c in seen if "encryption_state" in c]
    assert copies == [["trial", "capture_id", *whatif.RULED]]


def test_shared_profiles_project_as_profiles_of_each_trial(spark):
    """Two servers, one without an established session; one trial of each of the fixes that copy profiles, and both."""
    every = stage(crypto.decorate(view(spark, SF, "sess")))
    none = F.array().cast("array<string>")
    sets = [none, F.array(F.lit("enforce_tls")), F.array(F.lit("deploy_mta_sts_dane")), F.array(F.lit("enforce_tls"), F.lit("deploy_mta_sts_dane"))]
    trials = every.select("capture_id").distinct().select("capture_id", F.posexplode(F.array(*sets)).alias("trial", "t"))

    def rows(sessions):
        copied = sessions.join(trials, "capture_id").withColumns({f"fx_{f}": F.array_contains("t", f) for f in dims.FIX_ORDER}).drop("t")
        return whatif.project(copied, ["trial"])

    shared = rows(whatif.with_profiles(every))
    own = rows(every).select(*shared.columns)
    assert "best" not in shared.columns and shared.count() == every.count() * 4
    assert shared.exceptAll(own).isEmpty() and own.exceptAll(shared).isEmpty()
    assert not shared.where(F.array_contains("changed_by", "deploy_mta_sts_dane")).isEmpty()
