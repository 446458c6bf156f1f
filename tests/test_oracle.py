"""Registered queries against their SQL. All of them with FIELDROUNDS_ALL=1, else one or two per area."""
import os

import pytest

from compare import compare, duck
from conftest import SMALL
from fieldrounds.plans import ORACLES, QUERIES

SOME = ("cln1_parse_items", "cln7_same_day_merge", "cln10_followup_retyping", "cln11_closure_episodes", "wf5_expanding_means", "wf6_trailing_year",
        "wf12_month_start_features", "wf13_snapshot_features", "j2_asof_backward", "j7_point_in_polygon", "j8_nearest_places", "rk1_top_fraction_weights",
        "rk5_slot_reassign", "ml9_auc", "bs1_facility_interval", "vw2_display_records", "vw5_flags", "wl1_monthly_worklist", "bd5_curve_groups",
        "bd13_monitor_bands", "st2_daily_counts")


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("FIELDROUNDS_ALL") else SOME)
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck(SMALL).execute(ORACLES[name]).df()
    assert compare(got, want) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
