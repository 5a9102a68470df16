"""List, filter, facet, page and fold views over sessions, findings and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, server_key
from postern.operators.baseline import SERVER

CAP = "capture_id"


def list_sessions(sessions: DataFrame, protocol: str | None = None, state: str | None = None) -> DataFrame:
    """Optional equality filters (they reach the scan), ordered by first frame."""
    out = sessions
    if protocol:
        out = out.where(F.col("protocol") == protocol)
    if state:
        out = out.where(F.col("encryption_state") == state)
    return out.orderBy(CAP, "first_frame")


def list_findings(found: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    out = found
    if severity:
        out = out.where(F.col("severity") == severity)
    if category:
        out = out.where(F.col("category") == category)
    return out.orderBy(CAP, "severity_rank", F.coalesce("finding_frame", F.lit(0)))


def get(df: DataFrame, key: str, value, capture=None) -> DataFrame:
    out = df.where(F.col(key) == F.lit(value))
    return out if capture is None else out.where(F.col(CAP) == F.lit(capture))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the total row count beside each row (a scalar subquery, not a join)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def risk_list(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("risk_class").isNotNull()).orderBy(F.desc_nulls_last("risk_score"))


def unclassified(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(CAP).agg(count_if(F.col("protocol").isNotNull() & F.col("risk_class").isNull()).alias("unclassified"))


def deviating(scored: DataFrame) -> DataFrame:
    """Sessions off their baseline or anomalous, strongest first."""
    hit = (F.size("deviations") > 0) | F.coalesce("is_anomalous", F.lit(False))
    return scored.where(hit).orderBy(F.desc(F.coalesce("deviation_score", F.lit(0.0))), F.desc(F.coalesce("risk_score", F.lit(0.0))))


def facet_filter(df: DataFrame, facets: dict[str, Sequence] | None = None, search: str | None = None, search_columns: Sequence[str] = ()) -> DataFrame:
    """Multi-select membership per facet and a case-insensitive substring over the search columns."""
    out = df
    for column, values in (facets or {}).items():
        out = out.where(F.col(column).cast("string").isin(*[str(v) for v in values]))
    if search:
        text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in search_columns]))
        out = out.where(F.contains(text, F.lit(search.lower())))
    return out


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty values and counts of every facet, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .where("p.value IS NOT NULL AND p.value <> ''")
        .groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def filter_sessions(sessions: DataFrame, entities: dict[str, Sequence]) -> DataFrame:
    """Conjunction of the filters an extracted question carries; versions may say deprecated."""
    out = sessions
    c = F.col
    if entities.get("protocols"):
        out = out.where(c("protocol").isin(*entities["protocols"]))
    versions = [v for v in entities.get("tls_versions", ()) if not v.startswith("__")]
    if "__deprecated" in entities.get("tls_versions", ()):
        versions += dims.DEPRECATED_VERSIONS
    if versions:
        out = out.where(c("tls_version").isin(*versions))
    if entities.get("ips"):
        out = out.where(c("server_ip").isin(*entities["ips"]) | c("client_ip").isin(*entities["ips"]))
    if entities.get("ports"):
        out = out.where(c("server_port").isin(*entities["ports"]))
    topics = set(entities.get("topics", ()))
    if topics & {"cleartext", "credential"}:
        out = out.where(c("encryption_state").isin(*dims.CLEARTEXT))
    if "cipher" in topics:
        no = F.lit(False)
        out = out.where(c("forward_secrecy").eqNullSafe(no) | c("aead").eqNullSafe(no))
    if "risk" in topics:
        out = out.where(c("risk_class").isin("high", "critical"))
    if "pqc" in topics:
        out = out.where(c("pqc_offered") | c("pqc_selected"))
    return out


def top_risk(sessions: DataFrame, k: int = 25) -> DataFrame:
    """The k riskiest rows (TakeOrderedAndProject: k rows per task, never a full sort)."""
    return sessions.orderBy(F.desc(F.coalesce("risk_score", F.lit(0.0))), CAP, "session_id").limit(k)


# Which categories a finding topic covers
def topic_condition(topic: str) -> Column:
    c = F.col("category")
    return {
        "certificate": c.startswith("certificate_"),
        "cipher": c.isin("weak_cipher_suite", "no_forward_secrecy"),
        "starttls": c.startswith("starttls_"),
        "credential": c == "cleartext_credential_exposure",
        "cleartext": c.isin("cleartext_mail_transaction", "cleartext_credential_exposure", "starttls_not_advertised", "starttls_advertised_not_used"),
        "dns": c.rlike("^(mta_sts|dane|dmarc|tlsrpt|dns_)"),
        "pqc": c.startswith("pqc_"),
    }[topic]


def filter_findings(found: DataFrame, severities: Sequence[str] = (), topics: Sequence[str] = ()) -> DataFrame:
    out = found.where(F.col("verdict") == "FAIL")
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if topics:
        cond = topic_condition(topics[0])
        for t in topics[1:]:
            cond = cond | topic_condition(t)
        out = out.where(cond)
    return out


def server_inventory(sessions: DataFrame, numbered_findings: DataFrame, scope: DataFrame, software: DataFrame) -> DataFrame:
    """Endpoint list: software, sessions, versions, FAIL findings attached once each, worst severity.

    A finding attaches through its session's server or, for a capture-level finding, through its scope.
    """
    base = sessions.groupBy(*SERVER).agg(
        F.count(F.lit(1)).alias("sessions"), F.array_sort(F.collect_set("tls_version")).alias("versions"), F.first(server_key()).alias("server")
    )
    fails = numbered_findings.where(F.col("verdict") == "FAIL").select(CAP, "finding_no", "category", "severity_rank", "session_id")
    by_session = fails.join(sessions.select(CAP, "session_id", server_key().alias("server")), [CAP, "session_id"]).select(CAP, "server", "finding_no", "severity_rank")
    estate = fails.where(F.col("category") == "pqc_server_not_ready").join(scope, [CAP, "category"]).select(CAP, "server", "finding_no", "severity_rank")
    attached = (
        by_session.unionByName(estate)
        .groupBy(CAP, "server")
        .agg(F.count_distinct("finding_no").alias("findings"), F.min("severity_rank").alias("worst_rank"))
    )
    return (
        base.join(software.select(*SERVER, "software"), SERVER, "left")
        .join(attached, [CAP, "server"], "left")
        .withColumn("findings", F.coalesce("findings", F.lit(0)))
        .withColumn("worst", dims.lookup("worst_rank", {r: s for s, r in dims.SEVERITY_RANK.items()}))
    )


def credential_rows(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per cleartext credential event of a session that exposed any."""
    exposed = sessions.where(F.col("cleartext_auth")).select(CAP, "session_id", server_key().alias("server"))
    return events.where(F.col("kind") == "auth_credential").join(exposed, [CAP, "session_id"])


def outcome_flow(sessions: DataFrame) -> DataFrame:
    """Protocol to state to version: link weights and per-stage totals from one grouping-sets scan."""
    rows = sessions.where(F.col("protocol").isNotNull()).select(
        CAP, "protocol", F.col("encryption_state").alias("state"), F.coalesce("tls_version", F.lit("No TLS")).alias("version")
    )
    c = F.col
    sets = [[c(CAP), c("protocol"), c("state")], [c(CAP), c("state"), c("version")], [c(CAP), c("protocol")], [c(CAP), c("state")], [c(CAP), c("version")]]
    return rows.groupingSets(sets, c(CAP), c("protocol"), c("state"), c("version")).agg(F.count(F.lit(1)).alias("sessions"))


def session_lanes(sessions: DataFrame) -> DataFrame:
    """Relative start and width of each session on its server's lane, span at least a millisecond."""
    email = sessions.where(F.col("protocol").isNotNull() & F.col("start_time").isNotNull())
    bounds = email.groupBy(CAP).agg(F.min("start_time").alias("t0"), F.max(F.coalesce("end_time", "start_time")).alias("t1"))
    span = F.greatest(F.col("t1") - F.col("t0"), F.lit(0.001))
    return email.join(bounds, CAP).select(
        CAP,
        "session_id",
        server_key().alias("lane"),
        ((F.col("start_time") - F.col("t0")) / span).alias("offset_share"),
        ((F.coalesce("end_time", "start_time") - F.col("start_time")) / span).alias("width_share"),
    )


def phase_events(events: DataFrame, bounds: DataFrame, keep: int = 2) -> tuple[DataFrame, DataFrame]:
    """Phase of each event and time since the first one; encrypted records past `keep` become a count.

    `events` = (capture, session_id, kind, frame, ts), `bounds` = (capture, session_id, negotiation_frame,
    established_frame). Returns (kept rows, folded counts per session). The per-session top-k is limited
    before the shuffle, and the folded count is an aggregation.
    """
    key = [CAP, "session_id"]
    app = F.col("kind") == "tls_application_data"
    phase = (
        F.when(app, F.lit("encrypted"))
        .when(F.col("frame") >= F.col("established_frame"), F.lit("encrypted"))
        .when(F.col("frame") >= F.col("negotiation_frame"), F.lit("handshake"))
        .when(F.col("kind").startswith("tls_"), F.lit("handshake"))
        .otherwise(F.lit("plaintext"))
    )
    first = events.groupBy(*key).agg(F.min_by("ts", "frame").alias("t0"), count_if(app).alias("records"))
    w = Window.partitionBy(*key).orderBy("frame", "line_offset")
    records = events.where(app).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")
    kept = events.where(~app).unionByName(records)
    rows = kept.join(bounds, key, "left").join(first, key).select(*key, "kind", "frame", phase.alias("phase"), (F.col("ts") - F.col("t0")).alias("since_start"))
    folded = first.where(F.col("records") > keep).select(*key, (F.col("records") - keep).alias("folded"))
    return rows, folded


def _folded(points: DataFrame, digits: int) -> DataFrame:
    return points.withColumns({"x": F.bround("x", digits), "y": F.bround("y", digits)})


def fold_points(points: DataFrame, digits: int = 3) -> DataFrame:
    """Identical projected points as one, with their number; `fold_members` lists whom each stands for."""
    return _folded(points, digits).groupBy("cluster", "x", "y").agg(F.count(F.lit(1)).alias("count"), F.min("ref").alias("first_ref"))


def fold_members(points: DataFrame, digits: int = 3) -> DataFrame:
    """(cluster, x, y, ref) of every member, named by its folded point: rows, since one point may hold most members."""
    return _folded(points, digits).select("cluster", "x", "y", "ref")
