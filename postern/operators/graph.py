"""Dependency graph: client, server, crypto and weakness nodes, weighted edges and blast radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if, pct, server_key

CAP = "capture_id"


def top_or_other(df: DataFrame, keys: Sequence[str], item: str, k: int, order: str, other: str = "other") -> DataFrame:
    """Map of items to themselves for the k most frequent per key, to `other` for the rest.

    Ranking works on one row per item; Spark limits it to k rows per task before the shuffle.
    """
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first_seen"), F.asc(item))
    kept = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(*keys, item, F.lit(True).alias("kept"))
    return counts.join(kept, [*keys, item], "left").select(
        *keys, item, F.when(F.col("kept"), F.col(item).cast("string")).otherwise(F.lit(other)).alias("node"), "n"
    )


def client_nodes(sessions: DataFrame, k: int = dims.CLIENT_NODE_LIMIT) -> DataFrame:
    email = sessions.where(F.col("protocol").isNotNull())
    node = top_or_other(email, [CAP], "client_ip", k, "first_frame").drop("n")
    per_client = email.groupBy(CAP, "client_ip").agg(
        F.count(F.lit(1)).alias("sessions"),
        count_if(F.col("encryption_state").isin(*dims.CLEARTEXT)).alias("cleartext"),
        count_if(F.col("cleartext_auth")).alias("credentials_exposed"),
    )
    return (
        per_client.join(node, [CAP, "client_ip"])
        .groupBy(CAP, F.concat(F.lit("client:"), F.col("node")).alias("node_id"))
        .agg(F.sum("sessions").alias("sessions"), F.sum("cleartext").alias("cleartext"), F.sum("credentials_exposed").alias("credentials_exposed"), F.count(F.lit(1)).alias("clients"))
    )


def server_nodes(sessions: DataFrame) -> DataFrame:
    return (
        sessions.where(F.col("protocol").isNotNull())
        .groupBy(CAP, server_key().alias("server"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            count_if(F.col("encryption_state").isin(*dims.CLEARTEXT)).alias("cleartext"),
            F.count_distinct("client_ip").alias("clients"),
            *[count_if(F.col("protocol") == p).alias(p.lower()) for p in ("SMTP", "IMAP", "POP3")],
        )
    )


def crypto_rows(sessions: DataFrame) -> DataFrame:
    """One row per (session, primitive it depended on) with the primitive's risk class."""
    c = F.col
    clear = c("encryption_state").isin(*dims.CLEARTEXT)
    seen = ~clear & c("tls_version").isNotNull()

    def node(cond: Column, ident: Column, risk: Column) -> Column:
        return F.when(cond, F.struct(ident.alias("node_id"), risk.alias("risk")))

    no_group = c("key_group").isNull() & c("forward_secrecy").eqNullSafe(F.lit(False)) & c("key_exchange").isNotNull()
    nodes = F.array(
        node(clear, F.lit("crypto:none"), F.lit("critical")),
        node(seen, F.concat(F.lit("crypto:version:"), c("tls_version")), F.when(c("tls_version").isin(*dims.DEPRECATED_VERSIONS), F.lit("high")).otherwise(F.lit("ok"))),
        node(
            seen & c("cipher_suite").isNotNull(),
            F.concat(F.lit("crypto:suite:"), c("cipher_suite")),
            F.when(F.size("weaknesses") > 0, F.lit("medium")).when(~c("aead"), F.lit("low")).otherwise(F.lit("ok")),
        ),
        node(seen & c("key_group").isNotNull(), F.concat(F.lit("crypto:group:"), c("key_group")), F.when(c("pqc_selected"), F.lit("ok")).otherwise(F.lit("quantum"))),
        node(seen & no_group, F.concat(F.lit("crypto:kex:"), c("key_exchange")), F.lit("high")),
    )
    email = sessions.where(c("protocol").isNotNull())
    return email.select(CAP, "session_id", "first_frame", "client_ip", "cleartext_auth", server_key().alias("server"), F.explode(F.array_compact(nodes)).alias("n")).select(
        CAP, "session_id", "first_frame", "client_ip", "cleartext_auth", "server", "n.node_id", "n.risk"
    )


def crypto_nodes(sessions: DataFrame) -> DataFrame:
    """Sessions per primitive; its risk is that of the first session that brought it in."""
    return crypto_rows(sessions).groupBy(CAP, "node_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.min_by("risk", F.struct("first_frame", "session_id")).alias("risk")
    )


def finding_scope(found: DataFrame, sessions: DataFrame, domain_servers: DataFrame | None = None) -> DataFrame:
    """(capture, category, server) a FAIL finding is evidence about.

    A session finding reaches its session's server; the capture-level post-quantum finding reaches every
    server a hybrid offer went to; a DNS finding reaches the servers its domain resolves to.
    """
    fails = found.where(F.col("verdict") == "FAIL")
    direct = fails.where(F.col("session_id").isNotNull()).select(CAP, "category", "session_id").join(
        sessions.select(CAP, "session_id", server_key().alias("server")), [CAP, "session_id"]
    )
    parts = direct.select(CAP, "category", "server")
    estate = fails.where(F.col("category") == "pqc_server_not_ready").select(CAP, "category").distinct()
    offered = sessions.where(F.col("tls_version").isNotNull() & F.col("pqc_offered")).select(CAP, server_key().alias("server")).distinct()
    parts = parts.unionByName(estate.join(offered, CAP).select(CAP, "category", "server"))
    if domain_servers is not None:
        by_domain = fails.where(F.col("domain").isNotNull()).select(CAP, "category", "domain").distinct()
        parts = parts.unionByName(by_domain.join(domain_servers, [CAP, "domain"]).select(CAP, "category", "server"))
    return parts.distinct()


def edges(sessions: DataFrame, scope: DataFrame, k: int = dims.CLIENT_NODE_LIMIT, domain_servers: DataFrame | None = None) -> DataFrame:
    """Weighted typed edges: connects, negotiates, affects and, with DNS evidence, mx."""
    email = sessions.where(F.col("protocol").isNotNull())
    node = top_or_other(email, [CAP], "client_ip", k, "first_frame").select(CAP, "client_ip", "node")
    clear = F.col("encryption_state").isin(*dims.CLEARTEXT)
    connects = (
        email.groupBy(CAP, "client_ip", server_key().alias("server"))
        .agg(F.count(F.lit(1)).alias("weight"), count_if(clear).alias("cleartext"))
        .join(node, [CAP, "client_ip"])
        .groupBy(CAP, F.concat(F.lit("client:"), F.col("node")).alias("source"), F.concat(F.lit("server:"), F.col("server")).alias("target"))
        .agg(F.sum("weight").alias("weight"), F.sum("cleartext").alias("cleartext"))
        .withColumn("type", F.lit("connects"))
    )
    negotiates = (
        crypto_rows(sessions)
        .groupBy(CAP, F.concat(F.lit("server:"), F.col("server")).alias("source"), F.col("node_id").alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("cleartext", F.lit(None).cast("bigint"))
        .withColumn("type", F.lit("negotiates"))
    )
    known = email.select(CAP, server_key().alias("server")).distinct()
    affects = scope.join(known, [CAP, "server"]).select(
        CAP,
        F.concat(F.lit("weakness:"), F.col("category")).alias("source"),
        F.concat(F.lit("server:"), F.col("server")).alias("target"),
        F.lit(1).cast("bigint").alias("weight"),
        F.lit(None).cast("bigint").alias("cleartext"),
        F.lit("affects").alias("type"),
    )
    out = connects.unionByName(negotiates).unionByName(affects)
    if domain_servers is not None:
        mx = domain_servers.join(known, [CAP, "server"]).select(
            CAP,
            F.concat(F.lit("domain:"), F.col("domain")).alias("source"),
            F.concat(F.lit("server:"), F.col("server")).alias("target"),
            F.lit(1).cast("bigint").alias("weight"),
            F.lit(None).cast("bigint").alias("cleartext"),
            F.lit("mx").alias("type"),
        )
        out = out.unionByName(mx)
    return out


def weaknesses(found: DataFrame) -> DataFrame:
    return (
        found.where(F.col("verdict") == "FAIL")
        .groupBy(CAP, "category")
        .agg(F.count(F.lit(1)).alias("findings"), F.min_by("severity", "severity_rank").alias("severity"))
        .withColumn("risk", F.lower("severity"))
    )


def server_risk(scope: DataFrame, weak: DataFrame) -> DataFrame:
    """Worst weakness reaching each server (one hop)."""
    rank = dims.lookup("risk", dims.RISK_ORDER)
    return scope.join(weak.select(CAP, "category", "risk"), [CAP, "category"]).groupBy(CAP, "server").agg(
        F.min_by("risk", rank).alias("risk"), F.min(rank).alias("risk_rank"), F.array_sort(F.collect_set("category")).alias("weaknesses")
    )


def radius(direct: DataFrame, scope: DataFrame, severity: DataFrame, sessions: DataFrame) -> DataFrame:
    """Direct and dependent reach per (capture, key).

    `direct` = (capture, key, session_id, cleartext_auth), `scope` = (capture, key, server),
    `severity` = (capture, key, severity). Clients are counted from distinct (server, client) pairs, so the
    rows joined per key are servers and clients, never all sessions.
    """
    email = sessions.where(F.col("protocol").isNotNull()).withColumn("server", server_key())
    totals = email.groupBy(CAP).agg(F.count(F.lit(1)).alias("t_sessions"), F.count_distinct("client_ip").alias("t_clients"), F.count_distinct("server").alias("t_servers"))
    per_server = email.groupBy(CAP, "server").agg(F.count(F.lit(1)).alias("sessions"))
    pairs = email.select(CAP, "server", "client_ip").distinct()
    d = direct.distinct().groupBy(CAP, "key").agg(F.count(F.lit(1)).alias("direct_sessions"), count_if(F.col("cleartext_auth")).alias("credentials_exposed"))
    s = scope.join(per_server, [CAP, "server"], "left").groupBy(CAP, "key").agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("dependent_sessions"), F.count(F.lit(1)).alias("servers"))
    cl = scope.join(pairs, [CAP, "server"]).groupBy(CAP, "key").agg(F.count_distinct("client_ip").alias("dependent_clients"))
    out = severity.join(d, [CAP, "key"], "left").join(s, [CAP, "key"], "left").join(cl, [CAP, "key"], "left")
    out = out.na.fill(0, ["direct_sessions", "credentials_exposed", "dependent_sessions", "servers", "dependent_clients"]).join(totals, CAP)
    ds = F.col("direct_sessions").cast("double") / F.greatest("t_sessions", F.lit(1))
    cs = F.col("dependent_clients").cast("double") / F.greatest("t_clients", F.lit(1))
    weight = F.coalesce(dims.lookup("severity", dims.SEVERITY_BLAST), F.lit(0.1))
    return out.select(
        CAP,
        "key",
        "severity",
        "direct_sessions",
        pct(F.col("direct_sessions"), F.col("t_sessions")).alias("direct_pct"),
        "dependent_sessions",
        pct(F.col("dependent_sessions"), F.col("t_sessions")).alias("dependent_pct"),
        "servers",
        pct(F.col("servers"), F.col("t_servers")).alias("servers_pct"),
        "dependent_clients",
        pct(F.col("dependent_clients"), F.col("t_clients")).alias("clients_pct"),
        "credentials_exposed",
        F.bround(weight * (F.lit(0.6) * ds + F.lit(0.4) * cs) * 100, 1).alias("blast_score"),
    )


def finding_radius(found: DataFrame, sessions: DataFrame, domain_servers: DataFrame | None = None) -> DataFrame:
    fails = found.where((F.col("verdict") == "FAIL") & F.col("session_id").isNotNull())
    direct = fails.select(CAP, F.col("category").alias("key"), "session_id").join(sessions.select(CAP, "session_id", "cleartext_auth"), [CAP, "session_id"])
    scope = finding_scope(found, sessions, domain_servers).withColumnRenamed("category", "key")
    sev = weaknesses(found).select(CAP, F.col("category").alias("key"), "severity")
    return radius(direct, scope, sev, sessions)


def crypto_radius(sessions: DataFrame) -> DataFrame:
    rows = crypto_rows(sessions)
    nodes = crypto_nodes(sessions).where(F.col("risk") != "ok")
    # Severity of a crypto node's risk class
    sev = dims.lookup("risk", {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "quantum": "INFO"})
    risky = nodes.select(CAP, F.col("node_id").alias("key"), sev.alias("severity"))
    keyed = rows.withColumnRenamed("node_id", "key").join(risky.select(CAP, "key"), [CAP, "key"])
    return radius(keyed.select(CAP, "key", "session_id", "cleartext_auth"), keyed.select(CAP, "key", "server").distinct(), risky, sessions)


def rank_servers(sessions: DataFrame, scope: DataFrame, weak: DataFrame) -> DataFrame:
    """Servers with their risk and weaknesses; order by (risk_rank, -clients, -sessions) to list them."""
    return (
        server_nodes(sessions)
        .join(server_risk(scope, weak), [CAP, "server"], "left")
        .withColumn("risk", F.coalesce("risk", F.lit("ok")))
        .withColumn("risk_rank", F.coalesce("risk_rank", F.lit(dims.RISK_ORDER["ok"])))
        .withColumn("weaknesses", F.coalesce("weaknesses", F.array().cast("array<string>")))
    )


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Node changes between two graphs on (capture, node_id): new, resolved, improved, worse or same."""
    b = before.select(CAP, "node_id", F.col("risk").alias("risk_before"))
    a = after.select(CAP, "node_id", F.col("risk").alias("risk_after"))
    r = {s: F.coalesce(dims.lookup(f"risk_{s}", dims.RISK_ORDER), F.lit(9)) for s in ("before", "after")}
    change = (
        F.when(F.col("risk_after").isNull(), F.lit("resolved"))
        .when(F.col("risk_before").isNull(), F.lit("new"))
        .when(r["after"] > r["before"], F.lit("improved"))
        .when(r["after"] < r["before"], F.lit("worse"))
        .otherwise(F.lit("same"))
    )
    return b.join(a, [CAP, "node_id"], "full_outer").withColumn("change", change)


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges with `change` removed, new or same on (capture, source, target, type)."""
    keys = [CAP, "source", "target", "type"]
    b = before.select(*keys, F.lit(True).alias("was"))
    a = after.select(*keys, F.lit(True).alias("now"))
    change = F.when(F.col("now").isNull(), F.lit("removed")).when(F.col("was").isNull(), F.lit("new")).otherwise(F.lit("same"))
    return b.join(a, keys, "full_outer").select(*keys, change.alias("change"))
