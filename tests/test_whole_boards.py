"""Matrices over decks as they are, and the overlay with shared hashes, against their SQL twins."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

DIR = "/root/testdata/sf0.001"
NAMES = """ag9_matchup_cells_decks srt3_matrix_axis_decks jn8_matchup_matrix_decks
rs8_matrix_rows_decks job6_matrix_totals_decks set1_overlay_all""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    wrong, rows = compare(spark, connection(DIR), entry.queries()[name], entry.oracle_sql()[name], DIR)
    assert wrong is None and rows > 0


def test_what_was_left_out(spark):
    assert entry.queries()["set1_overlay_all"](spark, DIR).where("card_hash like 'f%'").count() > 0
