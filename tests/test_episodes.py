"""Closure reading: hand-worked records, and the rules as checks on what random records become."""
import random
from dataclasses import dataclass
from datetime import date, timedelta

from fieldrounds.operators import clean, episodes

START = date(2020, 1, 1)


@dataclass
class Visit:
    day: int
    kind: str = "routine"
    score: int | None = None
    grade: str | None = None
    order: bool = False
    reopen: bool = False
    major: int = 0
    permit: bool = False


COLS = ("business_id long, day date, visit_type string, record_id long, status string, score int, grade string, n_major int, n_minor int, n_grp int, "
        "permit_note boolean, is_order boolean, is_reopen boolean")


def read(spark, places):
    rows = []
    for b, visits in enumerate(places):
        for i, v in enumerate(visits):
            rows.append((b, START + timedelta(days=v.day), v.kind, b * 1000 + i, "x", v.score, v.grade, v.major, 0, 0, v.permit, v.order, v.reopen))
    df = clean.visit_order(spark.createDataFrame(rows, COLS))
    got = {}
    for r in episodes.read_closures(df).collect():
        got[(r.business_id, r.seq - 1)] = r
    return got


def in_order(visits):
    return sorted(visits, key=lambda v: (v.day, 0 if v.order else 1 if v.reopen else 2))


def said(spark, visits):
    """What a record becomes, a short string per visit: type, and where they apply start, reason, reopening day, open, inferred, unplaced."""
    got = read(spark, [in_order(visits)])
    out = []
    for k in range(len(visits)):
        r = got[(0, k)]
        parts = [r.visit_type]
        if r.closed:
            parts += ["starts", r.closure, f"to {(r.reopened_on - START).days}" if r.reopened_on else "to ?"] + ["open"] * r.ends_open
        elif r.closure_order:
            parts += ["order", r.closure_order]
        parts += ["inferred"] * r.closure_inferred + ["unplaced"] * r.unplaced
        out.append(" ".join(parts))
    return out


def test_hand_worked_records(spark):
    V = Visit
    assert said(spark, [V(0, score=85, grade="B"), V(8, score=95, grade="A"), V(25, score=80, grade="B"), V(60, score=99, grade="A")]) == [
        "routine", "followup", "followup", "routine"]
    assert said(spark, [V(0, order=True, major=1), V(3, "reinspection", reopen=True), V(10, score=92, grade="A")]) == [
        "routine starts health to 3", "reinspection", "followup"]
    assert said(spark, [V(0, major=2), V(5, "reinspection", reopen=True), V(20, score=88, grade="B")]) == [
        "routine starts health to 5 inferred", "reinspection", "followup"]
    assert said(spark, [V(0, order=True), V(10, order=True, major=1), V(50, order=True), V(70, score=90, grade="A"), V(75, "reinspection", reopen=True)]) == [
        "routine starts health to ?", "followup order health", "routine starts other to 75", "followup", "reinspection"]
    assert said(spark, [V(0, "reinspection", reopen=True), V(10, score=95, grade="A")]) == ["reinspection unplaced", "routine"]
    assert said(spark, [V(0, score=95, grade="A"), V(30, "reinspection", reopen=True), V(40, score=95, grade="A")]) == [
        "routine", "reinspection unplaced", "followup"]
    assert said(spark, [V(0, order=True, permit=True), V(20, "complaint")]) == ["routine starts permit to ? open", "complaint"]


def random_places(seed, n):
    rng = random.Random(seed)
    places = []
    for _ in range(n):
        day, visits, seen = 0, [], set()
        for _ in range(rng.randint(1, 14)):
            day += rng.choice((0, 1, 3, 7, 12, 14, 15, 29, 30, 31, 60))
            kind = rng.choice(("routine", "routine", "reinspection", "complaint"))
            if (day, kind) not in seen:
                seen.add((day, kind))
                order, reopen = rng.random() < 0.15, rng.random() < 0.2
                score = rng.choice((None, 85, 92, 99)) if kind == "routine" and not order and not reopen else None
                visits.append(Visit(day, kind, score, None if score is None else "A" if score >= 90 else "B", order, reopen,
                                    rng.choice((0, 0, 1)), rng.random() < 0.3))
        places.append(in_order(visits))
    return places


def test_rules_hold_on_random_records(spark):
    places = random_places(5, 300)
    got = read(spark, places)
    met = dict.fromkeys(("inferred", "unplaced", "retyped", "starts", "continued", "reopened", "open"), 0)
    for b, visits in enumerate(places):
        rows = [got[(b, k)] for k in range(len(visits))]
        orders = [k for k, r in enumerate(rows) if r.closure_order is not None]
        for k, (v, r) in enumerate(zip(visits, rows)):
            where = (b, k)
            # An order is a recorded or an inferred one, never both, and has the reason its visit gives.
            assert (k in orders) == (v.order or r.closure_inferred) and not (v.order and r.closure_inferred), where
            if k in orders:
                assert r.closure_order == ("health" if v.major else "permit" if v.permit else "other"), where
            if r.closure_inferred:
                # The visit could be a closure, a reopening follows within 14 days, and nothing nearer could have been meant.
                met["inferred"] += 1
                assert v.score is None and v.major and not v.reopen, where
                later = next(j for j in range(k + 1, len(visits)) if visits[j].reopen)
                assert visits[later].day - v.day <= 14, where
                for j in range(k + 1, later):
                    w = visits[j]
                    assert not w.order and not (w.kind == "routine" and w.grade) and not (w.score is None and w.major), where
            if r.unplaced:
                met["unplaced"] += 1
                assert v.reopen and not v.order and not any(v.day - visits[o].day <= 30 for o in orders if o < k), where
            # A retyped routine has a trigger of the last 30 days behind it; any other routine has none.
            triggers = [j for j in range(k) if j in orders or (rows[j].unplaced and j > 0) or (
                rows[j].visit_type == "routine" and ((visits[j].score or 100) < 90 or visits[j].grade in ("B", "C")))]
            recent = any(v.day - visits[j].day <= 30 for j in triggers)
            assert r.visit_type == ("followup" if v.kind == "routine" and recent else v.kind), where
            met["retyped"] += r.visit_type != v.kind
            # An order starts an episode unless the one before is open and at most 30 days old.
            before = [o for o in orders if o < k]
            if k in orders:
                o = before[-1] if before else None
                ended = o is None or visits[o].reopen or any(
                    visits[j].reopen or (rows[j].visit_type in ("routine", "followup") and visits[j].grade and visits[j].day > visits[o].day) for j in range(o + 1, k))
                assert r.closed == (ended or v.day - visits[o].day > 30), where
                met["starts" if r.closed else "continued"] += 1
            else:
                assert not r.closed, where
        starts = [k for k, r in enumerate(rows) if r.closed]
        for k, end in zip(starts, starts[1:] + [len(rows)]):
            mine = [o for o in orders if k <= o < end]
            assert (rows[k].closure == "health") == any(visits[o].major for o in mine) and (rows[k].closure in ("health", rows[k].closure_order)), (b, k)
            if rows[k].reopened_on is not None:
                met["reopened"] += 1
                day = (rows[k].reopened_on - START).days
                back = [j for j in range(k, end) if visits[j].reopen and visits[j].day == day]
                assert back and day >= visits[k].day, (b, k)
                # The first reopening at or after the last order is the one that counts.
                assert not any(visits[j].reopen for j in range(mine[-1], end) if visits[j].day < day), (b, k)
            if rows[k].ends_open:
                met["open"] += 1
                assert k == starts[-1] and rows[k].reopened_on is None, (b, k)
                assert not any(visits[j].reopen or (rows[j].visit_type in ("routine", "followup") and visits[j].grade and visits[j].day > visits[mine[-1]].day)
                               for j in range(mine[-1] + 1, end)), (b, k)
    assert all(met.values()), met
