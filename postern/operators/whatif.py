"""Projection of fixes onto the observed sessions, and plans built from projections.

A projection is a chain of CASE columns over the session table. Each row carries, per fix, whether
it is in that fix's scope (`fx_<fix>`), so many alternative fix sets (`trial`) run as one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.functions.scores import count_if, server_key
from postern.operators import graph, posture, readiness, rules
from postern.session import stage

CAP = "capture_id"
SERVER = [CAP, "server_ip", "server_port"]
# Suites a fixed server would negotiate
TARGET_TLS13 = "TLS_AES_256_GCM_SHA384"
TARGET_TLS12 = "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384"
TARGET_TLS12_EC = "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384"
# What a newly encrypted session takes over from its server's healthiest session
INHERITED = [
    "tls_version",
    "cipher_suite",
    "key_group",
    "ja4s",
    "cert_observable",
    "cert_seen",
    "cert_expired",
    "cert_not_yet_valid",
    "cert_expiring_soon",
    "cert_days_to_expiry",
    "cert_hostname_match",
    "cert_weak_key",
    "cert_broken_signature",
    "cert_chain_invalid",
    "cert_self_signed",
    "cert_chain_incomplete",
    "cert_key_alg",
    "cert_key_bits",
    *crypto.SUITE_FACTS,
]
# What the rules read of a projected session, and what posture reads besides: all that trials write
RULED = [
    *["session_id", "server_ip", "server_port", "protocol", "detection_method", "encryption_state", "is_indeterminate", "first_frame", "last_frame"],
    *["upgrade_advertised", "upgrade_advertised_mangled", "tls_established", "cleartext_auth", "cleartext_mail", "tls_version", "weaknesses", "forward_secrecy"],
    *["pqc_offered", "pqc_selected", "cert_observable", "cert_seen", "cert_expired", "cert_not_yet_valid", "cert_expiring_soon", "cert_hostname_match"],
    *["cert_weak_key", "cert_broken_signature", "cert_chain_invalid", "cert_self_signed", "cert_chain_incomplete"],
    *["at_greeting", "at_capability", "at_advertised", "at_mangled", "at_requested", "at_rejected", "at_client_hello", "at_server_hello", "at_auth", "at_mail"],
]
SCORED = [*RULED, "cipher_suite", "key_group", "ja4s", "aead"]
RENEWED_FLAGS = ["cert_expired", "cert_not_yet_valid", "cert_expiring_soon", "cert_weak_key", "cert_broken_signature", "cert_self_signed", "cert_chain_incomplete", "cert_chain_invalid"]


def best_profiles(sessions: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Healthiest established session of each server, the first one on ties: one partial max_by, no window."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cert_ok = ~(yes("cert_expired") | yes("cert_weak_key") | yes("cert_broken_signature") | yes("cert_self_signed"))
    health = F.struct(
        dims.lookup("tls_version", dims.VERSION_RANK, 0).alias("v"),
        yes("forward_secrecy").alias("f"),
        yes("aead").alias("a"),
        (-F.coalesce(F.size("weaknesses"), F.lit(0))).alias("w"),
        cert_ok.alias("c"),
        (-F.col("first_frame")).alias("o"),
    )
    usable = sessions.where(F.col("tls_established") & F.col("tls_version").isNotNull())
    profile = F.struct("session_id", "pqc_selected", "handshake_ms", *INHERITED)
    return usable.groupBy(*extra_keys, *SERVER).agg(F.max_by(profile, health).alias("best"))


def _suite_columns(name: str) -> dict[str, Column]:
    """Literal suite facts of a target suite, derived by the same decomposition as observed suites."""
    known = {
        TARGET_TLS13: (None, None, "AES", 256, "GCM", "SHA384"),
        TARGET_TLS12: ("ECDHE", "RSA", "AES", 256, "GCM", "SHA384"),
        TARGET_TLS12_EC: ("ECDHE", "ECDSA", "AES", 256, "GCM", "SHA384"),
    }[name]
    kex, auth, enc, size, mode, mac = known
    return {
        "cipher_suite": F.lit(name),
        "key_exchange": F.lit(kex).cast("string"),
        "authentication": F.lit(auth).cast("string"),
        "encryption": F.lit(enc),
        "key_size": F.lit(size),
        "mode": F.lit(mode),
        "mac_hash": F.lit(mac),
        "forward_secrecy": F.lit(True),
        "aead": F.lit(True),
        "weaknesses": F.array().cast("array<string>"),
    }


def _set(df: DataFrame, cond: Column, values: dict[str, Column], fix: str) -> DataFrame:
    """Apply one fix where `cond` holds and note it in `changed_by`."""
    df = df.withColumn("_hit", F.coalesce(cond, F.lit(False)))
    hit = F.col("_hit")
    cols = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()}
    cols["changed_by"] = F.when(hit, F.array_append("changed_by", F.lit(fix))).otherwise(F.col("changed_by"))
    return df.withColumns(cols).drop("_hit")


def with_profiles(sessions: DataFrame) -> DataFrame:
    """Each session with its server's healthiest profile, `best`; before a session is copied for its trials, whose copies share it."""
    return sessions.join(best_profiles(sessions), SERVER, "left")


def _encrypt(joined: DataFrame, cond: Column, fix: str) -> DataFrame:
    """Turn the matching sessions into the TLS sessions they would have been, by the profile `best` beside them."""
    implicit = F.col("server_port").isin(*dims.IMPLICIT_TLS_PORTS)
    has = F.col("best").isNotNull()
    target = _suite_columns(TARGET_TLS13)
    defaults = {**target, "tls_version": F.lit("TLS 1.3"), "key_group": F.lit("x25519"), "cert_observable": F.lit(False)}
    values: dict[str, Column] = {
        "encryption_state": F.when(implicit, F.lit("IMPLICIT_TLS")).otherwise(F.lit("TLS_ESTABLISHED")),
        "upgrade_advertised": ~implicit,
        "upgrade_advertised_mangled": F.lit(False),
        "upgrade_requested": ~implicit,
        "upgrade_succeeded": ~implicit,
        "tls_established": F.lit(True),
        "cleartext_auth": F.lit(False),
        "cleartext_mail": F.lit(False),
        "is_indeterminate": F.lit(False),
        "pqc_selected": F.when(has, F.col("best.pqc_selected") & F.col("pqc_offered")).otherwise(F.col("pqc_selected")),
        "handshake_ms": F.coalesce("handshake_ms", "best.handshake_ms"),
        "profile_source": F.when(has, F.col("best.session_id")),
    }
    for name in INHERITED:
        values[name] = F.when(has, F.col(f"best.{name}")).otherwise(defaults.get(name, F.col(name)))
    return _set(joined, cond, values, fix).drop("best")


def project(scoped: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Sessions as they would look with the fixes in place, applied in their fixed order.

    `scoped` are decorated sessions with one boolean `fx_<fix>` column per fix (see `with_scope`), in whose scope a
    server's sessions are all or none. Server profiles are taken anew before each of the two fixes that copy them: the
    first are those of `with_profiles` where `scoped` has them, the second those of servers in scope, for sessions that change.
    """
    c = F.col
    if "best" not in scoped.columns:
        scoped = scoped.join(best_profiles(scoped, extra_keys), [*extra_keys, *SERVER], "left")
    df = scoped.withColumn("changed_by", F.array().cast("array<string>")).withColumn("profile_source", F.lit(None).cast("bigint"))
    open_state = c("encryption_state").isin(*dims.CLEARTEXT_IN_PROJECTION)
    df = _encrypt(df, c("fx_enforce_tls") & ~c("is_indeterminate") & ~c("upgrade_advertised_mangled") & open_state, "enforce_tls")
    mangled = F.coalesce(c("fx_deploy_mta_sts_dane") & ~c("is_indeterminate") & c("upgrade_advertised_mangled"), F.lit(False))
    changing = df.where(mangled).join(best_profiles(df.where("fx_deploy_mta_sts_dane"), extra_keys), [*extra_keys, *SERVER], "left")
    df = df.where(~mangled).unionByName(_encrypt(changing, F.lit(True), "deploy_mta_sts_dane"))
    df = _set(df, c("fx_disable_legacy_tls") & c("tls_version").isin(*dims.DEPRECATED_VERSIONS), {"tls_version": F.lit("TLS 1.2")}, "disable_legacy_tls")
    no = F.lit(False)
    poor = (F.size("weaknesses") > 0) | c("forward_secrecy").eqNullSafe(no) | c("aead").eqNullSafe(no)
    ec, rsa = _suite_columns(TARGET_TLS12_EC), _suite_columns(TARGET_TLS12)
    is_ec = F.coalesce(c("cert_key_alg") == "EC", no)
    cipher = {k: F.when(is_ec, ec[k]).otherwise(rsa[k]) for k in rsa}
    df = _set(df, c("fx_modern_ciphers") & c("tls_version").isNotNull() & (c("tls_version") != "TLS 1.3") & poor, cipher, "modern_ciphers")
    flagged = no
    for f in RENEWED_FLAGS:
        flagged = flagged | F.coalesce(c(f), no)
    renew: dict[str, Column] = {f: no for f in RENEWED_FLAGS}
    renew["cert_days_to_expiry"] = F.lit(365)
    renew["cert_key_bits"] = F.when(is_ec, F.lit(256)).otherwise(F.lit(3072))
    renew["cert_key_alg"] = F.when(is_ec, F.lit("EC")).otherwise(F.lit("RSA"))
    renew["cert_hostname_match"] = F.when(c("cert_hostname_match").isNotNull(), F.lit(True))
    df = _set(df, c("fx_renew_certificate") & c("cert_seen") & (flagged | c("cert_hostname_match").eqNullSafe(no)), renew, "renew_certificate")
    df = _set(
        df,
        c("fx_fix_certificate_chain") & c("cert_seen") & (c("cert_chain_incomplete") | c("cert_chain_invalid")),
        {"cert_chain_incomplete": no, "cert_chain_invalid": no},
        "fix_certificate_chain",
    )
    df = _set(
        df,
        c("fx_enable_hybrid_pqc") & (c("tls_version") == "TLS 1.3") & c("pqc_offered") & ~c("pqc_selected"),
        {"pqc_selected": F.lit(True), "key_group": F.lit("X25519MLKEM768")},
        "enable_hybrid_pqc",
    )
    odd = c("detection_method").isin("payload_signature_port_mismatch", "payload_signature_nonstandard_port")
    return _set(df, c("fx_standard_ports") & odd, {"detection_method": F.lit("payload_signature")}, "standard_ports")


def normalise(fixes: DataFrame) -> DataFrame:
    """Merge repeated fixes: scopes unite, an unscoped mention wins. Input (fix_id, servers)."""
    known = fixes.where(F.col("fix_id").isin(*dims.FIX_ORDER))
    order = dims.lookup("fix_id", {f: i for i, f in enumerate(dims.FIX_ORDER)})
    return known.groupBy("fix_id").agg(
        F.bool_or(F.col("servers").isNull() | (F.size("servers") == 0)).alias("everywhere"),
        # a fix list names servers by hand; the table-sized scopes are rows, see `candidates`
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("servers")))).alias("servers"),
    ).select("fix_id", order.alias("apply_order"), F.when(~F.col("everywhere"), F.col("servers")).alias("servers"))


def with_fixes(sessions: DataFrame, fixes: Sequence[str] | dict[str, Sequence[str] | None]) -> DataFrame:
    """Add the `fx_` columns for a fix list given by the user (server lists are user input, so small)."""
    wanted = fixes if isinstance(fixes, dict) else {f: None for f in fixes}
    cols = {}
    for f in dims.FIX_ORDER:
        if f not in wanted:
            cols[f"fx_{f}"] = F.lit(False)
        elif not wanted[f]:
            cols[f"fx_{f}"] = F.lit(True)
        else:
            cols[f"fx_{f}"] = server_key().isin(*wanted[f])
    return sessions.withColumns(cols)


def candidates(found: DataFrame, sessions: DataFrame, domain_servers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Applicable fixes per capture with finding counts, and their scope as (capture, fix, server) rows."""
    bridge = dims.fixes(found.sparkSession).where("choice = 1").select("category", "fix_id", "effort")
    fails = found.where(F.col("verdict") == "FAIL").join(F.broadcast(bridge), "category")
    fixes = fails.groupBy(CAP, "fix_id", "effort").agg(
        F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("category")).alias("categories")
    )
    scope = graph.finding_scope(found, sessions, domain_servers).join(F.broadcast(bridge), "category").select(CAP, "fix_id", "server").distinct()
    return fixes, scope


def reevaluate(projected: DataFrame, carried: DataFrame | None = None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """All rules on the projected rows, plus the DNS findings that no fix resolved."""
    found = rules.findings(projected, extra_keys=list(extra_keys))
    return found if carried is None else found.unionByName(carried, allowMissingColumns=True)


def carried_dns(found: DataFrame, projected: DataFrame, applied: DataFrame | Sequence[str], domain_servers: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """DNS findings a projection keeps: not resolved by an applied fix, and for a policy violation only while some
    server of the domain still carries cleartext.

    `applied` is one fix list, or rows of (extra keys, capture, fixes) with a fix set for each trial.
    """
    ek = list(extra_keys)
    dns = found.where(F.col("category").isin(*dims.DNS_CATEGORIES))
    if isinstance(applied, DataFrame):
        dns = dns.join(applied.select(*ek, CAP, F.col("fixes").alias("_fixes")), CAP)
    else:
        dns = dns.withColumn("_fixes", F.array(*[F.lit(f) for f in applied]).cast("array<string>"))
    resolved = F.lit(False)
    for fix, _, categories in dims.FIXES:
        if own := [c for c in categories if c in dims.DNS_CATEGORIES]:
            resolved = resolved | (F.array_contains("_fixes", fix) & F.col("category").isin(*own))
    open_servers = projected.where(F.col("encryption_state").isin(*dims.CLEARTEXT_IN_PROJECTION)).select(*ek, CAP, server_key().alias("server")).distinct()
    still_open = domain_servers.join(open_servers, [CAP, "server"]).select(*ek, CAP, "domain", F.lit(True).alias("_open")).distinct()
    rows = dns.where(~resolved).drop("_fixes").join(still_open, [*ek, CAP, "domain"], "left")
    return rows.where((F.col("category") != "mta_sts_policy_violation") | F.coalesce("_open", F.lit(False))).drop("_open")


def finding_diff(before: DataFrame, after: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Resolved, remaining and introduced FAIL findings per key, as multisets on (category, session or domain)."""
    ek = list(extra_keys)
    subject = F.coalesce(F.col("session_id").cast("string"), F.col("domain"), F.lit("")).alias("subject")
    keys = [*ek, CAP, "category", "subject"]

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("verdict") == "FAIL").select(*ek, CAP, "category", subject).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = counts(before, "n_before").join(counts(after, "n_after"), keys, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.select(
        *keys,
        F.least("n_before", "n_after").alias("remaining"),
        F.greatest(F.lit(0), F.col("n_before") - F.col("n_after")).alias("resolved"),
        F.greatest(F.lit(0), F.col("n_after") - F.col("n_before")).alias("introduced"),
    )


def state_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome counts of each capture before and after, aggregated in one pass over both."""
    cols = [CAP, "protocol", "encryption_state", "cleartext_auth", "forward_secrecy", "pqc_selected", "tls_version"]
    rows = before.select(*cols, F.lit("before").alias("phase")).unionByName(after.select(*cols, F.lit("after").alias("phase")))
    return rows.where(F.col("protocol").isNotNull()).groupBy(CAP, "phase").agg(
        F.count(F.lit(1)).alias("sessions"),
        count_if(F.col("encryption_state").isin(*dims.PROTECTED)).alias("protected"),
        count_if(F.col("encryption_state").isin(*dims.CLEARTEXT_IN_PROJECTION)).alias("cleartext"),
        count_if(F.col("cleartext_auth")).alias("credentials_exposed"),
        count_if(F.coalesce("forward_secrecy", F.lit(False))).alias("forward_secrecy"),
        count_if(F.col("pqc_selected")).alias("pqc_selected"),
        count_if(F.col("tls_version") == "TLS 1.3").alias("tls13"),
    )


def projection_report(before: DataFrame, after: DataFrame, found_before: DataFrame, found_after: DataFrame) -> DataFrame:
    """Posture, readiness and FAIL counts per capture and phase."""
    parts = []
    for phase, s, f in (("before", before, found_before), ("after", after, found_after)):
        fails = f.where(F.col("verdict") == "FAIL").groupBy(CAP).agg(F.count(F.lit(1)).alias("findings"))
        p = posture.posture(s, f).select(CAP, F.col("overall").alias("posture"))
        r = readiness.readiness(s).select(CAP, F.col("score").alias("readiness"), "hndl_pct")
        parts.append(p.join(r, CAP).join(fails, CAP, "left").na.fill(0, ["findings"]).withColumn("phase", F.lit(phase)))
    return parts[0].unionByName(parts[1])


def evidence_gaps(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    actions = dims.table(spark, ["category", "action"], list(dims.EVIDENCE_ACTIONS.items()))
    return found.groupBy(CAP, "category").agg(F.count(F.lit(1)).alias("findings")).join(F.broadcast(actions), "category")


def _scored(sessions: DataFrame, trials: DataFrame, scope: DataFrame, dns: DataFrame | None = None, domain_servers: DataFrame | None = None) -> DataFrame:
    """Score, FAIL count and severity points of every (capture, trial) fix set, in one job.

    `trials` = (capture, trial, fixes array); every session meets the trials of its own capture, which are
    at most a few dozen. `scope` limits a fix to its servers; a fix without scope rows applies everywhere.
    `dns` are the findings of domains, which a trial carries along or resolves.
    """
    per_server = scope.groupBy(CAP, "server").agg(F.collect_set("fix_id").alias("scoped"))
    limited = scope.groupBy(CAP).agg(F.collect_set("fix_id").alias("limited"))
    rows = (
        with_profiles(sessions)
        .withColumn("server", server_key())
        .join(per_server, [CAP, "server"], "left")
        .join(limited, CAP, "left")
        .join(trials, CAP)
    )
    none = F.array().cast("array<string>")
    here, lim = F.coalesce("scoped", none), F.coalesce("limited", none)
    rows = rows.withColumns(
        {f"fx_{f}": F.array_contains("fixes", f) & (F.array_contains(here, f) | ~F.array_contains(lim, f)) for f in dims.FIX_ORDER}
    ).drop("server", "scoped", "limited", "fixes")
    after = stage(project(rows, ["trial"]).select("trial", CAP, *SCORED))
    # score and totals only need how many findings of each kind there are
    kept = None if dns is None else carried_dns(dns, after, trials, domain_servers, ["trial"])
    found = stage(reevaluate(after, kept, ["trial"]).groupBy("trial", CAP, "category", "severity", "verdict").agg(F.count(F.lit(1)).alias("n")))
    points = dims.lookup("severity", dims.SEVERITY_POINTS, 0)
    fail = F.col("verdict") == "FAIL"
    totals = found.groupBy("trial", CAP).agg(
        F.coalesce(F.sum(F.when(fail, F.col("n"))), F.lit(0)).alias("findings_after"),
        F.coalesce(F.sum(F.when(fail, points * F.col("n"))), F.lit(0)).alias("points_after"),
    )
    score = posture.posture(after, found, ["trial"]).select("trial", CAP, F.col("overall").alias("score_after"))
    return score.join(totals, ["trial", CAP], "left").na.fill(0, ["findings_after", "points_after"])


def plan(sessions: DataFrame, found: DataFrame, domain_servers: DataFrame | None = None) -> DataFrame:
    """Greedy plan of every capture at once: at each step the fix with the best projected gain per effort.

    At most nine steps (one per fix); each step scores all remaining fixes of all captures in one job and
    is written before the next one builds on it. A fix that changes nothing any more is skipped. With the servers of
    each domain given, the DNS findings among `found` take part: their fixes are candidates, and each trial keeps those it
    doesn't resolve.
    """
    fixes, scope = candidates(found, sessions, domain_servers)
    fixes, scope = stage(fixes), stage(scope)
    dns = None if domain_servers is None else (stage(found.where(F.col("category").isin(*dims.DNS_CATEGORIES))), stage(domain_servers))
    none = F.array().cast("array<string>")
    start = sessions.select(CAP).distinct().select(CAP, F.lit("").alias("trial"), none.alias("fixes"))
    base = _scored(sessions, start, scope, *(dns or ())).select(CAP, F.col("score_after").alias("score"), F.col("findings_after").alias("fails"), F.col("points_after").alias("points"))
    state = stage(base.withColumn("chosen", none).withColumn("tried", none))
    steps: DataFrame | None = None
    for step in range(1, len(dims.FIX_ORDER) + 1):
        open_fixes = fixes.join(state, CAP).where(~F.array_contains("tried", F.col("fix_id")))
        trials = stage(open_fixes.select(CAP, F.col("fix_id").alias("trial"), F.array_append("chosen", F.col("fix_id")).alias("fixes"), "effort"))
        if trials.isEmpty():
            break
        scored = _scored(sessions, trials.drop("effort"), scope, *(dns or ())).join(trials.select(CAP, "trial", "effort"), [CAP, "trial"]).join(state, CAP)
        gain = F.coalesce("score_after", F.lit(0)) - F.coalesce("score", F.lit(0))
        removed = F.col("points") - F.col("points_after")
        rank = F.struct(((removed + gain * 2) / F.col("effort")).alias("value"), gain.alias("gain"), (-F.col("effort")).alias("cheap"), F.col("trial"))
        useful = ~((gain <= 0) & (removed <= 0) & (F.col("findings_after") >= F.col("fails")))
        row = F.struct("trial", "effort", F.col("score").alias("score_before"), "score_after", "findings_after", "points_after", removed.alias("removed"), useful.alias("useful"))
        best = stage(scored.groupBy(CAP).agg(F.max_by(row, rank).alias("b")).select(CAP, F.lit(step).alias("step"), "b.*"))
        taken = best.where("useful")
        steps = taken if steps is None else steps.unionByName(taken)
        merged = state.join(best, CAP, "left")
        use = F.coalesce("useful", F.lit(False))
        state = stage(
            merged.select(
                CAP,
                F.when(use, F.col("score_after")).otherwise(F.col("score")).alias("score"),
                F.when(use, F.col("findings_after")).otherwise(F.col("fails")).alias("fails"),
                F.when(use, F.col("points_after")).otherwise(F.col("points")).alias("points"),
                F.when(use, F.array_append("chosen", F.col("trial"))).otherwise(F.col("chosen")).alias("chosen"),
                F.when(F.col("trial").isNotNull(), F.array_append("tried", F.col("trial"))).otherwise(F.col("tried")).alias("tried"),
            )
        )
    return steps.drop("useful").withColumnRenamed("trial", "fix_id")


def fix_pools(sessions: DataFrame, found: DataFrame, keep: int = 12) -> DataFrame:
    """Fix combinations to try for each failed finding of a session: (capture, session, category, server, rank, fixes).

    The pool holds the fixes of the finding's own category, most targeted first, then the first fix of each other
    failed finding of the session in the order of the findings. Its single fixes come before its pairs, and the first
    `keep` are tried: that bound is part of the method. A session has a few dozen categories at most, so no list grows.
    """
    fixes = dims.fixes(found.sparkSession).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("choice", "fix_id"))), lambda x: x["fix_id"]).alias("own"))
    fails = found.where((F.col("verdict") == "FAIL") & F.col("session_id").isNotNull() & F.col("domain").isNull())
    at = F.min(F.struct("severity_rank", F.coalesce("finding_frame", F.lit(0)).alias("frame"))).alias("at")
    known = fails.groupBy(CAP, "session_id", "category").agg(at).join(F.broadcast(fixes), "category")
    first = F.struct("at", "category", F.get("own", F.lit(0)).alias("fix"))
    rows = known.groupBy(CAP, "session_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("of"), "own"))).alias("all"))
    rows = rows.select(CAP, "session_id", "all", F.explode("all").alias("x"))
    others = F.transform(F.filter("all", lambda o: o["of"]["category"] != F.col("x.of.category")), lambda o: o["of"]["fix"])
    rows = rows.select(CAP, "session_id", F.col("x.of.category").alias("category"), F.array_distinct(F.concat("x.own", others)).alias("pool"))
    pairs = F.flatten(F.transform("pool", lambda f, i: F.transform(F.slice(F.col("pool"), i + 2, len(dims.FIX_ORDER)), lambda g: F.array(f, g))))
    tried = F.slice(F.concat(F.transform("pool", lambda f: F.array(f)), pairs), 1, keep)
    at_server = sessions.select(CAP, "session_id", server_key().alias("server"))
    return rows.select(CAP, "session_id", "category", F.posexplode(tried).alias("rank", "fixes")).join(at_server, [CAP, "session_id"])


def minimal_fixes(sessions: DataFrame, found: DataFrame, keep: int = 12) -> DataFrame:
    """Smallest fix combination that clears each failed finding of a session, applied to the session's own server.

    Only the combinations that a finding of a server asks for are projected, each once over that server's sessions.
    `cleared` is false where none of a finding's combinations clears it; its first fix is then given.
    """
    pools = stage(fix_pools(sessions, found, keep).withColumn("trial", F.array_join(F.array_sort("fixes"), "+")))
    trials = pools.groupBy(CAP, "server", "trial").agg(F.any_value("fixes").alias("t"))
    rows = with_profiles(sessions).withColumn("server", server_key()).join(trials, [CAP, "server"])
    rows = rows.withColumns({f"fx_{f}": F.array_contains("t", f) for f in dims.FIX_ORDER}).drop("t", "server")
    after = stage(project(rows, ["trial"]).select("trial", CAP, *RULED))
    left = reevaluate(after, extra_keys=["trial"]).where(F.col("verdict") == "FAIL").select("trial", CAP, "session_id", "category", F.lit(True).alias("left")).distinct()
    tried = pools.join(left, ["trial", CAP, "session_id", "category"], "left")
    best = tried.groupBy(CAP, "session_id", "category").agg(F.min_by("fixes", "rank").alias("first"), F.min_by("fixes", F.when(F.col("left").isNull(), F.col("rank"))).alias("found"))
    return best.select(CAP, "session_id", "category", F.coalesce("found", "first").alias("fixes"), F.col("found").isNotNull().alias("cleared"))
