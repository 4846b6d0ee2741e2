"""Registered queries against their SQL; ``ALL_QUERIES=1`` runs every one."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from pagelight.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "language_audit check_1_1_1_non_text_content check_1_3_1_info_relationships check_2_4_6_headings_and_labels full_audit "
    "vote_confidence coverage_summary structure_proposals merge_fragments table_body_split list_accumulation reading_order_sort "
    "html_fragments surrounding_text heading_outline duplicate_tables_in_page chunk_overlap_dedupe html_gaps html_score "
    "builder_score_and_block gate_multi_column_bbox publishable_verdict heading_renumber apply_rules evaluate_change_proposal "
    "upsert_by_key page_profile sliding_window_admission session_window_counts ocr_layout_scan figure_image_assignment"
).split()
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    rows, _, problem = compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The comparisons of trained models and of spans are in the tests of their own package.
    assert set(registry.PLANS) == set(registry.COMPARISONS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
