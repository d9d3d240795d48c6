"""Queries beside their SQL on the smallest tables: a few of each family; tools/compare.py runs all."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import compare
from tessera.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "price_intelligence_by_brand", "price_mad_anomalies", "filter_products", "filter_eligibility_reasons", "join_cheapest_line", "join_quarantine", "agg_median_mad", "agg_facets", "window_ranks_and_scales",
    "sample_stratified", "retrieve_bm25", "retrieve_rank_fusion", "metric_binary", "metric_retrieval", "split_groups", "rank_heuristic", "entity_pair_features", "compat_report", "build_best_value",
    "quality_batch", "stream_idempotent_events", "performance_training_rows", "records_reconciled_stock", "source_json_lines_round_trip", "stream_deduplicated",
    "compat_published_lists", "build_diverse_profiles", "entity_matches", "rank_features", "retrieve_hash_embedding", "split_components", "performance_estimates", "records_canonical_products", "source_feed_listings",
    "quality_batch_report", "metric_frozen_candidates", "filter_allowed_products", "text_part_vocabulary", "join_arc_consistency",
    "build_replacement", "review_queue_items", "review_queue_manifest", "review_decisions", "review_training_pairs", "lease_replay", "lease_stream", "source_chained_import", "sink_version_switch",
    "performance_frame_digest", "source_vector_index", "text_named_entities", "compat_board_power",
)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and compare.rows(got) == compare.rows(want)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
