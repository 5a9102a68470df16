"""Deterministic rules: sessions in, evidence-linked findings out.

All single-session rules are evaluated in one pass: every rule is an element of an array that is
NULL when it does not fire, and the array is exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, server_key
from postern.operators.ordered import numbered
from postern.session import stage

FRAMES_PER_BLOCK = 1_000_000

# Event kinds each rule cites; the full frame lists come from `evidence_frames`.
CITED_KINDS = {
    "cleartext_credential_exposure": ["auth_credential"],
    "starttls_downgrade_fallback": ["upgrade_requested", "upgrade_rejected"],
    "starttls_not_advertised": ["capability_response", "upgrade_advertised_mangled", "greeting"],
    "starttls_advertised_not_used": ["upgrade_advertised"],
    "cleartext_mail_transaction": ["mail_transaction", "mailbox_access"],
    "deprecated_tls_version": ["tls_server_hello", "tls_client_hello"],
    "weak_cipher_suite": ["tls_server_hello", "tls_client_hello"],
    "no_forward_secrecy": ["tls_server_hello", "tls_client_hello"],
    "certificate_not_observable": ["tls_server_hello", "tls_client_hello"],
    "starttls_stripping": ["upgrade_advertised_mangled"],
}

_FRAMES = "array<bigint>"


def _frames(*columns: str) -> Column:
    """Cited frames, or the first frame of the session when none was recorded."""
    found = F.array_compact(F.array(*[F.col(c).cast("bigint") for c in columns]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.col("first_frame").cast("bigint")))


def _draft(cond: Column, category: str, frames: Column, verdict: str = "FAIL") -> Column:
    return F.when(
        cond,
        F.struct(F.lit(category).alias("category"), F.lit(verdict).alias("verdict"), frames.cast(_FRAMES).alias("frames")),
    )


def transport_rules() -> list[Column]:
    """Indeterminate sessions only ever say that their evidence is incomplete."""
    blind = F.col("is_indeterminate")
    clear = ~blind
    state = F.col("encryption_state")
    return [
        _draft(blind, "incomplete_evidence", F.array("first_frame", "last_frame"), "UNKNOWN"),
        _draft(clear & F.col("cleartext_auth") & F.col("at_auth").isNotNull(), "cleartext_credential_exposure", _frames("at_auth")),
        _draft(clear & (state == "PLAINTEXT_AFTER_FAILURE"), "starttls_downgrade_fallback", _frames("at_requested", "at_rejected")),
        _draft(clear & (state == "STARTTLS_NOT_ADVERTISED"), "starttls_not_advertised", _frames("at_capability", "at_mangled", "at_greeting")),
        _draft(clear & (state == "STARTTLS_ADVERTISED_NOT_USED"), "starttls_advertised_not_used", _frames("at_advertised")),
        _draft(clear & F.col("cleartext_mail") & ~F.col("tls_established"), "cleartext_mail_transaction", _frames("at_mail")),
        _draft(
            clear & F.col("detection_method").isin("payload_signature_port_mismatch", "payload_signature_nonstandard_port"),
            "protocol_port_mismatch",
            F.array("first_frame"),
        ),
    ]


def tls_rules() -> list[Column]:
    """Handshake rules; not gated by the evidence rule above."""
    seen = F.col("tls_version").isNotNull()
    hello = _frames("at_server_hello", "at_client_hello")
    weak = F.filter("weaknesses", lambda w: w != F.lit(dims.NO_FORWARD_SECRECY_NOTE))
    return [
        _draft(seen & F.col("tls_version").isin(*dims.DEPRECATED_VERSIONS), "deprecated_tls_version", hello),
        _draft(seen & (F.size(weak) > 0), "weak_cipher_suite", hello),
        _draft(seen & F.col("forward_secrecy").eqNullSafe(F.lit(False)), "no_forward_secrecy", hello),
        _draft(seen & ~F.col("cert_observable") & F.col("tls_established"), "certificate_not_observable", hello, "UNKNOWN"),
    ]


def cert_rules() -> list[Column]:
    """Certificate rules; a self-signed leaf suppresses the incomplete-chain rule."""
    seen = F.coalesce(F.col("cert_seen"), F.lit(False))
    hello = _frames("at_server_hello")
    flags = [
        ("cert_expired", "certificate_expired"),
        ("cert_not_yet_valid", "certificate_not_yet_valid"),
        ("cert_expiring_soon", "certificate_expiring_soon"),
    ]
    out = [_draft(seen & F.col(flag), category, hello) for flag, category in flags]
    out.append(_draft(seen & F.col("cert_hostname_match").eqNullSafe(F.lit(False)), "certificate_hostname_mismatch", hello))
    for flag, category in [
        ("cert_weak_key", "certificate_weak_key"),
        ("cert_broken_signature", "certificate_weak_signature"),
        ("cert_chain_invalid", "certificate_chain_invalid"),
        ("cert_self_signed", "certificate_self_signed"),
    ]:
        out.append(_draft(seen & F.col(flag), category, hello))
    out.append(_draft(seen & ~F.col("cert_self_signed") & F.col("cert_chain_incomplete"), "certificate_chain_incomplete", hello))
    return out


_DRAFT_COLUMNS = ["capture_id", "session_id", "server", "category", "verdict", "frames", "severity_override", "confidence_override", "baseline_scope", "affected_sessions", "domain"]


def _drafts(df: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Bring any draft table to the common draft columns."""
    defaults = {
        "server": F.lit(None).cast("string"),
        "severity_override": F.lit(None).cast("string"),
        "confidence_override": F.lit(None).cast("double"),
        "baseline_scope": F.lit(None).cast("string"),
        "affected_sessions": F.lit(1).cast("bigint"),
        "domain": F.lit(None).cast("string"),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(*(extra_keys or []), *_DRAFT_COLUMNS)


def session_drafts(sessions: DataFrame, rules: list[Column] | None = None, extra_keys: list[str] | None = None) -> DataFrame:
    """0..n drafts per session from one scan. `sessions` carry the suite facts."""
    array = F.array(*(rules if rules is not None else transport_rules() + tls_rules() + cert_rules()))
    exploded = sessions.select(*(extra_keys or []), "capture_id", "session_id", server_key().alias("server"), F.explode(F.array_compact(array)).alias("d"))
    return _drafts(
        exploded.select(*(extra_keys or []), "capture_id", "session_id", "server", "d.category", "d.verdict", "d.frames"), extra_keys
    )


def capability_profiles(sessions: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """How each server:port answered capability queries; implicit and indeterminate sessions say nothing."""
    seen = sessions.where(
        F.col("protocol").isNotNull() & (F.col("encryption_state") != "IMPLICIT_TLS") & ~F.col("is_indeterminate")
    )
    mangled, advertised = F.col("upgrade_advertised_mangled"), F.col("upgrade_advertised")
    return (
        seen.groupBy(*(extra_keys or []), "capture_id", "server_ip", "server_port")
        .agg(
            F.count(F.lit(1)).alias("total"),
            count_if(~mangled & advertised).alias("advertised"),
            count_if(mangled).alias("mangled"),
            count_if(~mangled & ~advertised).alias("silent"),
        )
        .withColumn("advertise_ratio", F.col("advertised").cast("double") / F.col("total"))
    )


def host_profiles(profiles: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Per-port profiles rolled up to the host; ports sort as text."""
    keys = [*(extra_keys or []), "capture_id", "server_ip"]
    return (
        profiles.groupBy(*keys)
        .agg(
            F.sum("advertised").alias("host_advertised"),
            F.sum("mangled").alias("host_mangled"),
            F.sum("silent").alias("host_silent"),
            F.array_sort(F.collect_set(F.when(F.col("advertised") > 0, F.col("server_port").cast("string")))).alias("ports"),
        )
        .withColumn(
            "host_ratio",
            F.bround(F.col("host_advertised").cast("double") / (F.col("host_advertised") + F.col("host_mangled") + F.col("host_silent")), 3),
        )
    )


def stripping_drafts(
    sessions: DataFrame,
    min_sessions: int = dims.STRIPPING_MIN_SESSIONS,
    min_ratio: float = dims.STRIPPING_MIN_RATIO,
    extra_keys: list[str] | None = None,
) -> DataFrame:
    """A mangled capability, its confidence set by how strong the server's own baseline is."""
    ek = list(extra_keys or [])
    profiles = capability_profiles(sessions, ek)
    hosts = host_profiles(profiles, ek)
    scoped = profiles.where(F.col("mangled") > 0).join(hosts, [*ek, "capture_id", "server_ip"], "left")
    scope = (
        F.when((F.col("advertised") >= min_sessions) & (F.col("advertise_ratio") >= min_ratio), F.lit("server_port"))
        .when((F.col("host_advertised") >= min_sessions) & (F.col("host_ratio") >= min_ratio), F.lit("host"))
        .otherwise(F.lit("none"))
    )
    tiers = scoped.select(
        *ek,
        "capture_id",
        "server_ip",
        "server_port",
        scope.alias("baseline_scope"),
        F.col("mangled").alias("affected_sessions"),
    )
    hit = sessions.where(
        F.col("protocol").isNotNull()
        & (F.col("encryption_state") != "IMPLICIT_TLS")
        & ~F.col("is_indeterminate")
        & F.col("upgrade_advertised_mangled")
    )
    out = hit.join(tiers, [*ek, "capture_id", "server_ip", "server_port"]).select(
        *ek,
        "capture_id",
        "session_id",
        server_key().alias("server"),
        F.lit("starttls_stripping").alias("category"),
        F.lit("FAIL").alias("verdict"),
        _frames("at_mangled").alias("frames"),
        dims.lookup("baseline_scope", {"server_port": 0.9, "host": 0.7, "none": 0.5}).alias("confidence_override"),
        "baseline_scope",
        "affected_sessions",
    )
    return _drafts(out, ek)


def pqc_gap_drafts(sessions: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """One capture-level draft where clients offer a hybrid group and no server selects one."""
    ek = list(extra_keys or [])
    offered = F.col("pqc_offered")
    agg = (
        sessions.where(F.col("tls_version").isNotNull())
        .groupBy(*ek, "capture_id")
        .agg(
            count_if(offered).alias("affected_sessions"),
            count_if(F.col("pqc_selected")).alias("selected"),
            F.min_by(F.struct("session_id", "first_frame"), F.when(offered, F.struct("first_frame", "session_id"))).alias("first"),
        )
        .where((F.col("affected_sessions") > 0) & (F.col("selected") == 0))
    )
    return _drafts(
        agg.select(
            *ek,
            "capture_id",
            F.col("first.session_id").alias("session_id"),
            F.lit("pqc_server_not_ready").alias("category"),
            F.lit("FAIL").alias("verdict"),
            F.array(F.col("first.first_frame").cast("bigint")).alias("frames"),
            "affected_sessions",
        ),
        ek,
    )


def resolve(drafts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Join the policy: an override beats the rule, the rule beats the default."""
    rules = dims.rules(drafts.sparkSession) if rules is None else rules
    frames = F.array_sort(F.array_distinct("frames"))
    own = F.col("severity_override")
    severity = F.coalesce(own, F.col("severity"), F.lit("INFO"))
    rank = F.when(own.isNotNull(), dims.lookup(own, dims.SEVERITY_RANK, 9)).otherwise(F.col("severity_rank"))
    return (
        drafts.join(F.broadcast(rules), "category", "left")
        .withColumn("severity_rank", F.coalesce(rank, F.lit(9)))
        .withColumn("severity", severity)
        .withColumn("confidence", F.coalesce("confidence_override", "confidence", F.lit(0.5)))
        .withColumn("title", F.coalesce(F.col("title"), F.initcap(F.replace(F.col("category"), F.lit("_"), F.lit(" ")))))
        .withColumn("frames", frames)
        .withColumn("finding_frame", F.array_min("frames"))
        .withColumn("finding_last_frame", F.array_max("frames"))
        .drop("confidence_override", "severity_override")
    )


def thresholds(policy: DataFrame) -> dict[str, float]:
    """Thresholds that the policy sets for the stripping rule; what it leaves out keeps its default. One row is read."""
    row = policy.where(F.col("category") == "starttls_stripping").select("min_sessions_for_baseline", "min_advertise_ratio").first()
    found = {"min_sessions": row and row[0], "min_ratio": row and row[1]}
    return {k: v for k, v in found.items() if v is not None}


def findings(sessions: DataFrame, dns_drafts: DataFrame | None = None, extra_keys: list[str] | None = None, policy: DataFrame | None = None) -> DataFrame:
    """All findings of the session tables, not yet numbered.

    Severities, confidences and thresholds come from `policy` (the rules of `readers.load_policy`), or else from the default.
    """
    ek = list(extra_keys or [])
    limits = {} if policy is None else thresholds(policy)
    drafts = (
        session_drafts(sessions, extra_keys=ek)
        .unionByName(stripping_drafts(sessions, extra_keys=ek, **limits))
        .unionByName(pqc_gap_drafts(sessions, extra_keys=ek))
    )
    if dns_drafts is not None:
        drafts = drafts.unionByName(dns_drafts)
    return resolve(drafts, None if policy is None else policy.select("category", "severity", "severity_rank", "confidence", "title", "standards"))


def number(found: DataFrame) -> DataFrame:
    """`finding_ref` F-0001.. per capture by severity, first frame, then session and category."""
    at = F.coalesce("finding_frame", F.lit(0))
    ranked = numbered(
        found,
        ["capture_id"],
        [F.col("severity_rank"), at, F.col("session_id"), F.col("category"), F.col("domain")],
        [F.col("severity_rank"), F.floor(at / F.lit(FRAMES_PER_BLOCK))],
        "finding_no",
    )
    return ranked.withColumn("finding_ref", F.format_string("F-%04d", "finding_no"))


def observations(found: DataFrame, events: DataFrame, changes: DataFrame) -> DataFrame:
    """What the capture shows for each finding: (capture, finding_ref, frame, direction, kind, detail), a row each.

    These are the events at the frames the finding cites, by a join on the frame itself; a finding without any cites its
    session as a whole and gets the session's state changes. `events` = (capture, session_id, frame, dir, kind, detail),
    `changes` = (capture, session_id, frame, from_state, to_state, trigger).
    """
    key = ["capture_id", "session_id"]
    named = found.select(*key, "category", "finding_ref")
    every = named.join(evidence_frames(found, events), [*key, "category"]).select(*key, "finding_ref", "frame")
    own = found.select(*key, "finding_ref", F.explode("frames").alias("frame"))
    cited = every.unionByName(own).distinct()
    seen = stage(cited.join(events.select(*key, "frame", "dir", "kind", "detail"), [*key, "frame"]).select(*key, "finding_ref", "frame", F.col("dir").alias("direction"), "kind", "detail"))
    whole = named.join(seen.select("capture_id", "finding_ref").distinct(), ["capture_id", "finding_ref"], "left_anti")
    text = F.concat("from_state", F.lit(" → "), "to_state", F.lit(" ("), "trigger", F.lit(")"))
    steps = whole.join(changes, key).select(*key, "finding_ref", "frame", F.lit(None).cast("string").alias("direction"), F.lit("state_transition").alias("kind"), text.alias("detail"))
    return seen.unionByName(steps)


def evidence_frames(found: DataFrame, events: DataFrame) -> DataFrame:
    """Every frame a finding cites, as rows: (capture, session, category, frame)."""
    spark = found.sparkSession
    cited = dims.table(spark, ["category", "kind"], [(c, k) for c, kinds in CITED_KINDS.items() for k in kinds])
    wanted = found.select("capture_id", "session_id", "category").distinct().join(F.broadcast(cited), "category")
    return wanted.join(events, ["capture_id", "session_id", "kind"]).select("capture_id", "session_id", "category", "frame").distinct()
