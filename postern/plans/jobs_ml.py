"""Queries over features, outliers, risk models, client clusters and text classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern import dims
from postern.functions import crypto
from postern.ml import anomaly, boost, clusters, features, intent, risk
from postern.operators import browse
from postern.plans.catalog import query
from postern.plans.jobs_traffic import handshake_facts
from postern.plans.oracle_parts import part, sql
from postern.plans.views import load, view
from postern.session import stage

KEYS = ["capture_id", "session_id"]
#: Length of the given vectors
DIMENSIONS = 64


def facts(spark, sf):
    return features.usable(crypto.decorate(view(spark, sf, "sess")))


def vectors(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("bigint").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(DIMENSIONS)])


VEC = [f"v{i}" for i in range(DIMENSIONS)]
_B = "CAST({c} AS INT)::DOUBLE"
_COMMON = {
    "is_smtp": "protocol = 'SMTP'",
    "is_imap": "protocol = 'IMAP'",
    "is_pop3": "protocol = 'POP3'",
    "tls_established": "tls_established",
    "implicit_tls": "encryption_state = 'IMPLICIT_TLS'",
    "forward_secrecy": "coalesce(forward_secrecy, false)",
    "aead": "coalesce(aead, false)",
    "pqc_offered": "pqc_offered",
    "upgrade_advertised": "upgrade_advertised",
    "upgrade_requested": "upgrade_requested",
    "upgrade_mangled": "upgrade_advertised_mangled",
    "cleartext_auth": "cleartext_auth",
    "cleartext_mail": "cleartext_mail",
}
_RANK = "(CASE tls_version WHEN 'TLS 1.3' THEN 5 WHEN 'TLS 1.2' THEN 4 WHEN 'TLS 1.1' THEN 3 WHEN 'TLS 1.0' THEN 2 WHEN 'SSL 3.0' THEN 1 ELSE 0 END)::DOUBLE"


def _select(flags: dict[str, str], values: dict[str, str]) -> str:
    return ", ".join([f"CAST({e} AS INT)::DOUBLE AS {n}" for n, e in flags.items()] + [f"{e} AS {n}" for n, e in values.items()])


part(
    "af",
    ["f"],
    "SELECT capture_id, session_id, "
    + _select(
        {**_COMMON, "cipher_is_known": "cipher_suite IS NOT NULL", "cert_observable": "cert_observable", "session_complete": "session_complete"},
        {"tls_version_rank": _RANK, "server_port": "server_port::DOUBLE", "handshake_ms": "coalesce(handshake_ms, 0)", "frame_span": "greatest(last_frame - first_frame, 0)::DOUBLE", "event_count": "event_count::DOUBLE"},
    )
    + " FROM f WHERE NOT is_indeterminate",
)


@query("anomaly_features", "M-1", sql(["af"], "SELECT * FROM af"))
def anomaly_features(spark, sf):
    return features.anomaly_features(facts(spark, sf))


@query(
    "risk_features",
    "M-1",
    sql(
        ["f"],
        "SELECT capture_id, session_id, "
        + _select(
            {
                **_COMMON,
                "implicit_tls_port": "server_port IN (465, 993, 995)",
                "pqc_selected": "pqc_selected",
                "upgrade_rejected": "encryption_state IN ('PLAINTEXT_AFTER_FAILURE','STARTTLS_REJECTED')",
                "cert_observable": "cert_seen",
                "cert_expired": "cert_expired",
                "cert_not_yet_valid": "cert_not_yet_valid",
                "cert_weak_key": "cert_weak_key",
                "cert_broken_signature": "cert_broken_signature",
                "cert_hostname_mismatch": "coalesce(cert_hostname_match = false, false)",
                "cert_self_signed": "cert_self_signed",
                "cert_chain_incomplete": "cert_chain_incomplete",
                "cert_chain_invalid": "cert_chain_invalid",
            },
            {
                "tls_version_rank": _RANK,
                "cipher_key_bits": "coalesce(key_size, 0)::DOUBLE",
                "cipher_weakness_count": "(CASE WHEN coalesce(weaknesses, '') IN ('', 'STATIC_RSA') THEN 0 ELSE len(list_filter(string_split(weaknesses, ','), lambda x: x <> 'STATIC_RSA')) END)::DOUBLE",
                "cert_days_to_expiry": "(CASE WHEN NOT cert_seen THEN 400 WHEN cert_days_to_expiry IS NULL THEN 0 ELSE greatest(0, least(cert_days_to_expiry, 400)) END)::DOUBLE",
                "cert_key_bits": "(CASE WHEN cert_seen THEN coalesce(cert_key_bits, 0) ELSE 0 END)::DOUBLE",
            },
        )
        + " FROM f WHERE NOT is_indeterminate",
    ),
)
def risk_features(spark, sf):
    return features.risk_features(facts(spark, sf))


@query(
    "feature_variance",
    "M-2",
    sql(["af"], " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, var_pop({c}) > 1e-9 AS kept FROM af" for c in features.ANOMALY_FEATURES)),
)
def feature_variance(spark, sf):
    return features.variances(features.anomaly_features(facts(spark, sf)), features.ANOMALY_FEATURES).withColumn("variance", F.round("variance", 6))


def _mad_sql(source: str, group: str, key: str) -> str:
    return f""", md AS (SELECT {group}, feature, median(value) AS med FROM {source} GROUP BY 1, 2), ab AS (SELECT s.*, med, abs(value - med) AS d FROM {source} s JOIN md USING ({group}, feature)), mm AS (SELECT {group}, feature, CASE WHEN median(d) < 1e-9 THEN 1.0 ELSE median(d) END AS unit FROM ab GROUP BY 1, 2),
 sc AS (SELECT ab.*, d / unit AS dv FROM ab JOIN mm USING ({group}, feature)) SELECT {group}, {key}, feature, round(value, 6) AS value, round(med, 6) AS population_median, round(dv, 6) AS deviation_mad, rn FROM (SELECT *, row_number() OVER (PARTITION BY {group}, {key} ORDER BY dv DESC, feature) AS rn FROM sc WHERE dv > 1.0) r WHERE rn <= 4"""


def _rounded(df, *cols):
    for c in ("value", "population_median", "deviation_mad"):
        df = df.withColumn(c, F.round(c, 6))
    return df.select(*cols, "feature", "value", "population_median", "deviation_mad", "rn")


@query(
    "session_attribution",
    "M-4",
    sql(["af"], f", lg AS (SELECT capture_id, session_id, feature, value FROM af UNPIVOT (value FOR feature IN ({', '.join(features.ANOMALY_FEATURES)})))" + _mad_sql("lg", "capture_id", "session_id")).replace(" , lg", ", lg"),
)
def session_attribution(spark, sf):
    return _rounded(anomaly.mad_attribution(features.anomaly_features(facts(spark, sf)), ["capture_id"], ["session_id"], features.ANOMALY_FEATURES), "capture_id", "session_id")


@query(
    "vector_attribution",
    "M-4",
    f"WITH lg AS (SELECT label, vec_id, 'v' || i AS feature, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, {DIMENSIONS})) AS i) x)" + _mad_sql("lg", "label", "vec_id"),
)
def vector_attribution(spark, sf):
    return _rounded(anomaly.mad_attribution(vectors(spark, sf), ["label"], ["vec_id"], VEC), "label", "vec_id")


@query("session_outliers", "M-3")
def session_outliers(spark, sf):
    feats = stage(features.anomaly_features(facts(spark, sf)))
    kept = features.drop_constant(feats, features.ANOMALY_FEATURES)
    return anomaly.isolation_forest(feats, "capture_id", KEYS, kept)


@query("vector_outliers", "M-3")
def vector_outliers(spark, sf):
    return anomaly.isolation_forest(stage(vectors(spark, sf)), "label", ["vec_id"], VEC)


@query(
    "analyst_labels",
    "M-12",
    sql(
        ["f"],
        """SELECT capture_id, session_id, CASE WHEN NOT tls_established THEN CASE WHEN upgrade_advertised_mangled OR encryption_state = 'PLAINTEXT_AFTER_FAILURE' OR cleartext_auth THEN 4 ELSE 3 END ELSE greatest(CASE WHEN tls_version IN ('TLS 1.0','TLS 1.1') THEN 3 WHEN tls_version = 'TLS 1.2' THEN 1 ELSE 0 END,
 CASE WHEN cipher_suite LIKE 'TLS_RSA%' THEN 3 WHEN cipher_suite LIKE '%CBC%' THEN 2 ELSE 0 END, CASE WHEN cert_expired THEN 4 ELSE 0 END, CASE WHEN cert_not_yet_valid OR coalesce(cert_hostname_match = false, false) OR cert_weak_key OR cert_broken_signature THEN 3 ELSE 0 END, CASE WHEN cert_expiring_soon OR cert_self_signed THEN 2 ELSE 0 END) END AS risk_index FROM f WHERE NOT is_indeterminate""",
    ),
)
def analyst_labels(spark, sf):
    return facts(spark, sf).select(*KEYS, features.analyst_label().alias("risk_index"))


@query(
    "capture_risk_index",
    "M-9",
    sql(
        ["sess"],
        """, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY risk_score DESC) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM sess)
SELECT capture_id, round_even(0.6::DOUBLE * avg(risk_score) FILTER (rn <= greatest(1, n // 10)) + 0.4::DOUBLE * avg(risk_score), 1) AS index, round_even(avg(risk_score), 1) AS mean_score, round_even(avg(risk_score) FILTER (rn <= greatest(1, n // 10)), 1) AS tail_score, count(*) AS sessions,
 count(*) FILTER (risk_class = 'minimal') AS minimal, count(*) FILTER (risk_class = 'low') AS low, count(*) FILTER (risk_class = 'medium') AS medium, count(*) FILTER (risk_class = 'high') AS high, count(*) FILTER (risk_class = 'critical') AS critical FROM r GROUP BY 1""",
    ).replace(" , r AS", ", r AS"),
)
def capture_risk_index(spark, sf):
    return risk.capture_index(view(spark, sf, "sess"))


def labelled(spark, sf):
    f = facts(spark, sf)
    return stage(features.risk_features(f).join(f.select(*KEYS, features.analyst_label().alias("label")), KEYS))


def placed(spark, sf):
    """Labelled sessions, dealt out within their label."""
    return stage(boost.dealt(labelled(spark, sf), KEYS))


_CLASSES = len(dims.RISK_CLASSES)
_FOLDS = tuple(range(risk.FOLDS))


def _boosted(spark, sf, only=()):
    data = placed(spark, sf)
    return data, *boost.fitted(data, features.RISK_FEATURES, _CLASSES, only=only)


@query(
    "stratified_folds",
    "M-5",
    sql(
        ["f"],
        """, l AS (SELECT capture_id, session_id, CASE WHEN NOT tls_established THEN CASE WHEN upgrade_advertised_mangled OR encryption_state = 'PLAINTEXT_AFTER_FAILURE' OR cleartext_auth THEN 4 ELSE 3 END ELSE greatest(CASE WHEN tls_version IN ('TLS 1.0','TLS 1.1') THEN 3 WHEN tls_version = 'TLS 1.2' THEN 1 ELSE 0 END,
 CASE WHEN cipher_suite LIKE 'TLS_RSA%' THEN 3 WHEN cipher_suite LIKE '%CBC%' THEN 2 ELSE 0 END, CASE WHEN cert_expired THEN 4 ELSE 0 END, CASE WHEN cert_not_yet_valid OR coalesce(cert_hostname_match = false, false) OR cert_weak_key OR cert_broken_signature THEN 3 ELSE 0 END, CASE WHEN cert_expiring_soon OR cert_self_signed THEN 2 ELSE 0 END) END AS label FROM f WHERE NOT is_indeterminate)
SELECT capture_id, session_id, CAST(label AS INT) AS label, CAST((row_number() OVER (PARTITION BY label ORDER BY session_id * 7919 % 1000003, capture_id, session_id) - 1) % 5 AS INT) AS fold FROM l""",
    ).replace(" , l AS", ", l AS"),
)
def stratified_folds(spark, sf):
    f = facts(spark, sf)
    rows = f.where(~F.col("is_indeterminate")).select(*KEYS, features.analyst_label().cast("int").alias("label"))
    at = F.col("session_id") * 7919 % 1000003
    dealt = boost.dealt(rows, KEYS, order=at, block=F.floor(at / 4096))
    return dealt.select(*KEYS, "label", (F.col("place") % risk.FOLDS).cast("int").alias("fold"))


@query("risk_cross_validation", "M-5")
def risk_cross_validation(spark, sf):
    """Macro F1 of each stratified fold, by boosted trees grown from the other folds."""
    data, _, models = _boosted(spark, sf, [*_FOLDS, boost.HOLDOUT])
    report = risk.evaluate(data, models)[1].where("model >= 0")
    return report.groupBy(F.col("model").alias("fold")).agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("rows"))


@query("risk_confusion", "M-5")
def risk_confusion(spark, sf):
    data, _, models = _boosted(spark, sf, [boost.HOLDOUT])
    return risk.confusion(models.transform(data.where("place % 4 = 0"), boost.HOLDOUT))


@query("risk_class_report", "M-5")
def risk_class_report(spark, sf):
    """Precision, recall and F1 of each class on the rows that the hold-out model has not seen."""
    return risk.class_report(risk_confusion(spark, sf))


@query("risk_model_card", "M-5 M-6")
def risk_model_card(spark, sf):
    data, nodes, models = _boosted(spark, sf)
    matrix, report = risk.evaluate(data, models)
    return risk.card(data, nodes, matrix, report, features.RISK_FEATURES, dims.RISK_CLASSES)


@query("quality_confusion", "M-5")
def quality_confusion(spark, sf):
    """Document quality from simple length and repetition facts: the same training path on given labels."""
    d = load(spark, sf, "documents")
    words = F.split(F.lower("text"), r"\s+")
    x = d.select(
        "doc_id",
        F.length("text").cast("double").alias("chars"),
        F.size(words).cast("double").alias("words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        (F.size(F.split("text", "\n")) / F.size(words)).alias("line_share"),
    )
    data = x.join(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").where(F.col("label").isNotNull())
    data = stage(boost.dealt(data, ["doc_id"]))
    _, models = boost.fitted(data, ["chars", "words", "distinct_share", "line_share"], 2, only=[boost.HOLDOUT])
    return risk.confusion(models.transform(data.where("place % 4 = 0"), boost.HOLDOUT))


@query("feature_importance", "M-6")
def feature_importance(spark, sf):
    """Share in the gain of the splits, and loss of macro F1 on unseen rows when the feature is shuffled."""
    data, nodes, models = _boosted(spark, sf, [boost.HOLDOUT])
    held = stage(data.where("place % 4 = 0").withColumn("model", F.lit(boost.HOLDOUT)))
    lost = risk.permutation_importance(_On(models, boost.HOLDOUT), held, KEYS, features.RISK_FEATURES)
    return lost.join(boost.gain_importance(nodes, features.RISK_FEATURES, boost.HOLDOUT), "feature")


class _On:
    """One of several boosted models."""

    def __init__(self, models, which):
        self.models, self.which = models, which

    def transform(self, df):
        return self.models.transform(df, self.which)

    def swapped(self, df, donors):
        return self.models.swapped(df, donors, self.which)


@query("risk_scores", "M-7")
def risk_scores(spark, sf):
    data, _, models = _boosted(spark, sf, [boost.FINAL])
    return risk.score(models, data, KEYS).select(*KEYS, "risk_class", "risk_confidence", "risk_score")


@query("risk_drivers", "M-8")
def risk_drivers(spark, sf):
    data, _, models = _boosted(spark, sf, [boost.FINAL])
    return risk.shapley(models, data, KEYS)


def client_vectors(spark, sf):
    return features.client_features(handshake_facts(spark, sf))


@query("client_clusters", "M-10")
def client_clusters(spark, sf):
    v = client_vectors(spark, sf)
    return clusters.cluster_clients(v, KEYS, features.CLIENT_FEATURES, grid=["groups", "extensions", "ciphers"], within=["capture_id"])


@query("vector_clusters", "M-10")
def vector_clusters(spark, sf):
    return clusters.cluster_clients(vectors(spark, sf), ["vec_id"], VEC, eps=0.9, grid=VEC[:3])


@query("client_projection", "M-11 Q-15")
def client_projection(spark, sf):
    v = stage(client_vectors(spark, sf))
    xy = clusters.project_2d(v, KEYS, features.CLIENT_FEATURES, within=["capture_id"])
    named = clusters.cluster_clients(v, KEYS, features.CLIENT_FEATURES, grid=["groups", "extensions", "ciphers"], within=["capture_id"]).select(*KEYS, "cluster")
    return browse.fold_points(xy.join(named, KEYS).withColumn("ref", F.col("session_id")))


@query("language_intent", "M-13")
def language_intent(spark, sf):
    return intent.train_and_grade(load(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", "lang")
