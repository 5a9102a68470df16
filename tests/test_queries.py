"""Registered queries against their oracle on the smallest tables.

All of them run with POSTERN_ALL=1; by default a representative subset keeps the suite short.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare
from postern.plans import catalog

SF = "/root/testdata/sf0.001"
SUBSET = [
    "suite_facts", "session_refs", "baseline_deviations", "server_statistics", "server_software", "rule_findings", "finding_numbers", "starttls_stripping", "posture_overall", "pqc_readiness",
    "funnel_outcomes", "failure_points", "upgrade_timeline", "server_changes", "blast_radius", "finding_priority", "interception_scenarios", "quantum_forecast", "outcome_flow",
    "flow_index", "evidence_slices", "byte_ranges", "offset_frames", "document_lines", "protocol_events", "encryption_outcomes", "event_state_walk", "ja4_fingerprints", "trust_anchors", "dns_findings",
    "question_entities", "projected_sessions", "finding_resolution", "risk_features", "vector_attribution", "capture_risk_index",
    "reassembled_lines", "wire_sessions", "assessed_findings", "event_log", "session_timelines", "policy_findings", "finding_observations", "slice_custody", "report_sections", "stratified_folds",
    "address_domains", "capture_metadata", "mangled_words", "folded_points", "folded_point_members", "fix_candidates_with_dns", "carried_dns_findings", "graph_edge_changes",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


catalog.load_all()


@pytest.mark.parametrize("name", list(catalog.ORACLES) if os.environ.get("POSTERN_ALL") else SUBSET)
def test_query_matches_oracle(spark, duck, name):
    status, n, info = compare(spark, duck, SF, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert status == "ok", (status, n, info)


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["capture_id", "session_id", "dimension", "expected", "expected_share", "observed"]
    assert df.count() > 0


def test_every_query_reads_the_tables(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 140
