"""Ranking measures against plain numpy."""
import numpy as np

from fieldrounds.operators import ranking


def test_rank_correlation_leaves_out_windows_of_one_day(spark):
    """A window whose rows share a day raised a division by zero."""
    rows = [("m1", float(i % 5), i) for i in range(12)] + [("m2", float(i), 3) for i in range(12)] + [("m3", 1.0, 1)]
    got = ranking.within_window_spearman(spark.createDataFrame(rows, "w string, x double, dn int"), ["w"], "x", "dn").collect()
    assert [r["w"] for r in got] == ["m1"]
    assert abs(got[0]["rho"] - np.corrcoef([-i for i in range(12)], _mid([i % 5 for i in range(12)]))[0, 1]) < 1e-12


def _mid(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
