import pytest
from oracle import SF_DIR, compare

import __spark_entry__

NAMES = ["p3_found", "p4_found", "p4_removed", "catalog_view", "query_string", "facet_predicate", "merged_facets", "sort_recent", "fts_phrase", "fts_from_postings", "upsert_preserving", "ai_tags_user_wins", "newer_than_watermark", "refresh_by_status", "language_batches", "p3_contributors", "p3_weeks", "p3_languages", "p3_owners", "p3_first_contributors", "lookup_by_id", "lookup_one", "upsert_row_by_row", "mirror_topics_row_by_row", "stream_sync", "sync_full_counters", "sync_full_catalog", "readme_cache", "star_pages", "enrich_replies", "enrich_run_counts", "enrich_run_tags", "enrich_run_groups"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    compare(spark, name, "/root/testdata/sf0.01" if name.startswith("enrich_run") else SF_DIR)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["snapshot_no", "repo_id", "change"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_query(spark):
    assert __spark_entry__.queries()["stream_sync"](spark, SF_DIR).count() > 0
