"""One row per (place, list date): features of the years before it and the label of the year after."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import daynum, half_up
from ..rules import RECORD_TYPES, RULES, Rules
from .clean import theme_columns
from .history import days_before, persistence_key, prompted_by_complaint


def dates_column(dates: list[str]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in dates])


def stand_ins(places: DataFrame, dates: list[str]) -> DataFrame:
    """Each place on each list date."""
    return places.select("business_id", F.explode(dates_column(dates)).alias("day"))


def label_frame(days: int):
    return W.partitionBy("business_id").orderBy("dn").rangeBetween(0, days - 1)


def snapshots(visits: DataFrame, places: DataFrame, dates: list[str], rules: Rules = RULES,
              horizons: dict[str, int] | None = None) -> DataFrame:
    """Features strictly before each date and labels from it on, for every place seen in the year before.

    ``visits`` carries ``closure``, ``closure_order``, ``rated``, ``prompted`` (added when missing)
    and the theme counts named by ``rules.themes`` when the themes are wanted. ``horizons`` names
    more label columns with a shorter window. One shuffle by place: past and future are range frames
    of the same sorted timeline.
    """
    c = F.col
    v = visits if "prompted" in visits.columns else prompted_by_complaint(visits, rules)
    themes = [t for t in theme_columns(rules) if t in v.columns]
    cols = ["business_id", "day", "dn", "seq", "visit_type", "record_id", "score", "rated", "n_major", "n_grp", "closure",
            "closure_order", "prompted", *themes]
    real = v.select(*cols, F.lit(False).alias("asof"))
    asked = stand_ins(places, dates).select(
        "business_id", "day", daynum(c("day")).cast("int").alias("dn"), F.lit(True).alias("asof"))
    line = real.unionByName(asked, allowMissingColumns=True)
    year, two = days_before(rules.window_days), days_before(rules.score_window_days)
    ever = W.partitionBy("business_id").orderBy("dn").rangeBetween(W.unboundedPreceding, -1)
    routine = c("visit_type") == "routine"
    counted = c("visit_type").isin(*RECORD_TYPES) & ~c("prompted")

    def total(value: Column, w=year) -> Column:
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    def ifc(cond: Column, w=year) -> Column:
        return F.count(F.when(cond, 1)).over(w)

    def latest(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(c("dn"), c("seq"), value.alias("v")))).over(two)["v"]
    score, rated = F.when(routine, c("score")), F.when(routine, c("rated"))
    mean_rated = F.avg(rated).over(two)
    labels = {"label": rules.label_days, **(horizons or {})}
    first = F.when(routine, F.struct(c("dn"), c("seq"), (c("n_major") > 0).cast("int").alias("y"), c("record_id")))
    out = line.select(
        "business_id", c("day").alias("as_of"), "asof",
        F.max(F.when(~c("asof"), c("day"))).over(ever).alias("last_day"),
        ifc(~c("asof")).alias("visits_year"), F.avg(score).over(two).alias("avg_score"), latest(score).alias("last_score"),
        F.coalesce((100 - half_up(mean_rated)).cast("double"), F.lit(0.0)).alias("avg_deficit"),
        F.coalesce((100 - latest(rated)).cast("double"), F.lit(0.0)).alias("last_deficit"),
        mean_rated.isNull().cast("int").alias("no_score"), ifc(routine).alias("routines"),
        ifc(routine & (c("n_major") > 0)).alias("routines_major"), total(F.when(counted, c("n_major"))).alias("majors"),
        ifc(counted & (c("closure") == "health")).alias("health_closures"),
        ifc(counted & (c("visit_type") == "reinspection")).alias("reinspections"),
        total(F.when(routine, c("n_grp"))).alias("grp"), F.count(rated).over(two).alias("rated_2y"),
        ifc(routine & (c("closure_order") == "health"), two).alias("closures_read"),
        *[total(F.when(counted, c(t))).alias(t) for t in themes],
        *[F.min(first).over(label_frame(d)).alias(f"_{n}") for n, d in labels.items()]).where(
        c("asof") & (c("visits_year") > 0))
    got = []
    for n in labels:
        got.append(c(f"_{n}.y").alias("y" if n == "label" else f"y_{n}"))
    return out.select(*[x for x in out.columns if not x.startswith("_") and x != "asof"], *got,
                      c("_label.record_id").alias("event"))


def frame(snaps: DataFrame, places: DataFrame, scope: Column, labelled: bool, forward: bool = False,
          rules: Rules = RULES) -> DataFrame:
    """Snapshots in scope and active on their date; only the labelled ones when asked (WF15)."""
    seen = F.datediff("as_of", "last_day") <= rules.active_days
    dims = places.select("business_id", "kind", "district", "permit_status", "address", "name", "facility_id").where(scope)
    if forward:
        dims = dims.where(F.lower(F.coalesce("permit_status", F.lit(""))) != "expired")
    out = snaps.where(seen).join(dims, "business_id")
    return out.where("y is not null") if labelled else out


def eligible() -> Column:
    """Two rated routines in two years: points never rest on one visit (WF14)."""
    return F.col("rated_2y") >= 2


def event_weights(f: DataFrame) -> DataFrame:
    """Each labelled visit weighs one in total over the snapshots that carry it (WF16)."""
    n = f.groupBy("business_id", "event").agg(F.count("*").alias("_n"))
    return f.join(n, ["business_id", "event"]).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def weights_by_end(f: DataFrame, ends: list[str]) -> DataFrame:
    """``weights``: each row's event weight when only snapshots up to each of several days are read, 0 for later ones (WF16)."""
    upto = [F.col("as_of") <= F.lit(e).cast("date") for e in ends]
    n = f.groupBy("business_id", "event").agg(F.array(*[F.count_if(u) for u in upto]).alias("_n"))
    got = f.join(n, ["business_id", "event"])
    return got.withColumn("weights", F.array(*[F.when(u, 1.0 / F.element_at("_n", i + 1)).otherwise(0.0) for i, u in enumerate(upto)])).drop("_n")


def baselines(f: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The orderings a list is compared with: persistence and the last score."""
    return f.select("*", persistence_key(F.col("routines_major"), F.col("majors"), F.col("last_score"), rules).alias("persistence"),
                    (-F.coalesce(F.col("last_score").cast("double"), F.lit(rules.fill_score))).alias("last_score_rank"))


def scores_used(visits: DataFrame, at: str, rules: Rules = RULES) -> DataFrame:
    """Per place, the readings the average is made of, oldest first (WF17), at most one a day."""
    day = F.lit(at).cast("date")
    rows = visits.where((F.col("visit_type") == "routine") & F.col("rated").isNotNull() & (F.col("day") < day)
                        & (F.datediff(day, "day") <= rules.score_window_days))
    used = F.struct("day", "seq", F.col("rated").alias("score"), F.coalesce(F.col("closure_order") == "health", F.lit(False)).alias("closure"),
                    F.col("score").alias("source_score"))
    return rows.groupBy("business_id").agg(F.array_sort(F.collect_list(used)).alias("scores_used"))


def closure_mask(used: DataFrame) -> DataFrame:
    """Whether the readings include a closure (WF18)."""
    return used.select("business_id", F.exists("scores_used", lambda u: u["closure"]).alias("closure_read"))


def origin_dates(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """First snapshot day, confirmation origin and the two validation origins (FN5), one row."""
    c = F.col
    b = visits.agg(F.min("day").alias("first"), F.max("day").alias("through"))
    b = b.withColumn("confirm", F.trunc(F.date_sub("through", rules.label_days), "month"))
    return b.select("first", "through", F.date_add("first", rules.window_days).alias("snap_first"), "confirm",
                    F.add_months("confirm", -6).alias("validate_1"), F.add_months("confirm", -3).alias("validate_2"))


def month_starts(first: str, last: str) -> list[str]:
    """The first days of the months from ``first`` to ``last``."""
    from datetime import date
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    y, m, out = a.year, a.month, []
    while date(y, m, 1) <= b:
        if date(y, m, 1) >= a:
            out.append(date(y, m, 1).isoformat())
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out
