"""Queries against their SQL twins on the smallest tables; ``tests/oracle.py`` checks all of them on larger ones."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

DIR = "/root/testdata/sf0.001"
NAMES = """rank_decks rs1_side_samples ag1_deck_stats ag3_high_win_decks ag4_run_counters jn4_deck_report rs4_card_versions gr1_archetypes
wn4_core_cards ag7_deck_board wn1_deck_ranks ag11_weapon_mix ag12_soul_mix ag13_trend wn3_running_rate ag9_matchup_cells jn8_matchup_matrix
gr2_entities up1_match_fields up11_current_run rs5_wide_matches gr3_frontier ag23_search_funnel rs7_card_hashes jn13_version_lookup
st4_daily_counts_stream fn20_clean_text fn28_label_years set4_shared_cost""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    wrong, rows = compare(spark, connection(DIR), entry.queries()[name], entry.oracle_sql()[name], DIR)
    assert wrong is None and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
