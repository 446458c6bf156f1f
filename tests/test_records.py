"""Summaries of the record, whole."""
from compare import compare, duck
from conftest import SMALL
from fieldrounds.operators import ranking
from fieldrounds.plans import ORACLES, QUERIES


def test_every_common_type_has_its_gap(spark):
    got = QUERIES["ag2_gap_by_common_types"](spark, SMALL).toPandas()
    assert len(got) == 5 and compare(got, duck(SMALL).execute(ORACLES["ag2_gap_by_common_types"]).df()) == ""


def test_missing_closers_at_every_share_and_ordering(monkeypatch, spark):
    asked = []

    def spy(d, like, share, reps):
        asked.append((share, reps))
        return spark.createDataFrame([(0.5, 0.5)], "like_group double, worst double")
    monkeypatch.setattr(ranking, "with_resampled", spy)
    got = QUERIES["ag17_missing_closers_by_share"](spark, SMALL).collect()
    assert [(r.ordering, r.share) for r in got] == [(o, s) for o in ("risk", "rule", "pers") for s in (0.05, 0.1, 0.2)]
    assert asked == [(s, 20) for s in (0.05, 0.1, 0.2)] * 3
