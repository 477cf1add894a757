"""Registered queries against their SQL twins. All of them with LEAKSCOPE_ALL=1, else a sample of each group."""
import os

import pytest

from check import compare, connect
from leakscope.plans.catalogue import QUERIES, SQL

SAMPLE = """doc_findings page_findings chunked_documents skip_reasons corpus_overlap extended_findings strict_findings verhoeff_valid
redacted_text classify_documents fake_filter context_score context_with_entities sentence_of_span entities_near ess_by_file ess_breakdown
scan_summary document_exposure risk_distribution type_distribution combined_scan numbered_findings identity_links playbook_lines
executive_summary route_files files_per_repo paste_links forum_documents channel_messages scan_repo scan_social scan_profiles
history_top100 history_delete alert_windows alert_sessions alert_targets stream_findings""".split()
NAMES = sorted(QUERIES) if os.environ.get("LEAKSCOPE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    status, _n, _a, _b, note = compare(spark, duck, sf, name, QUERIES[name], SQL.get(name))
    assert status == "ok", note


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
