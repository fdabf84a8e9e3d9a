"""Queries that must return whole results."""

import __spark_entry__ as entry
from chronoloom.plans.dealt import STATE_COLUMNS

SF = "/root/testdata/sf0.001"


def test_every_attribute_has_intervals_and_a_column(spark):
    spans = entry.queries()["p5_attributes"](spark, SF)
    assert {r.attribute for r in spans.select("attribute").distinct().collect()} == set(STATE_COLUMNS)
    assert entry.queries()["p5_versions"](spark, SF).columns == ["schedule_key", "valid_from", "valid_to", *STATE_COLUMNS]
