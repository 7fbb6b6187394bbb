"""Registered queries against DuckDB on the smallest tables.

``NICHELENS_ALL=1`` runs every query; by default one of each family.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "latest_snapshot", "niche_ranking", "compare_platforms", "niche_dossier", "normalize_row", "import_outcome",
    "read_export_csv", "read_feed_xml", "build_signature", "cluster_assignment", "topic_score", "publish_gate",
    "limit_check", "slot_action", "stream_spend", "stream_items",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("NICHELENS_ALL") else SAMPLE)
def test_query_equals_sql(spark, oracle, name):
    ok, message = compare(spark, oracle, SF, name)
    assert ok, message


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
