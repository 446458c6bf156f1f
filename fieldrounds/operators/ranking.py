"""Ranking measures with exact tie handling, from distinct scores and distributed running sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import norm_key
from .joins import with_scalars
from .ordering import first_rows, positions, running_sums


def score_table(df: DataFrame, parts: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """Distinct scores with their rows and positives, and both summed from the highest score down."""
    w = F.lit(1).cast("long") if weight is None else weight
    t = df.groupBy(*parts, score).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))
    return running_sums(t, parts, [F.col(score).desc()], {"end": F.col("n"), "cum_pos": F.col("pos")})


def _totals(t: DataFrame, parts: list[str]) -> DataFrame:
    if parts:
        return t.join(t.groupBy(*parts).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")), parts)
    return with_scalars(t, t.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")))


def share_in(frac: Column) -> Column:
    """Share of a tie group inside the top ``frac``: 1 above the cut, pro rata across it."""
    k, start = frac * F.col("all_n"), F.col("end") - F.col("n")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - start) / F.col("n")))


def top_weights(df: DataFrame, frac: float = 0.2, score: str = "score", parts: list[str] = (), name: str = "weight", y: str = "y") -> DataFrame:
    """Each row's weight in the top ``frac`` (RK1)."""
    t = _totals(score_table(df, list(parts), score, y), list(parts))
    return df.join(t.select(*parts, score, share_in(F.lit(frac)).alias(name)), [*parts, score])


def capture(df: DataFrame, fracs: list[float], parts: list[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    """Share of positives, precision and lift in the top fractions, all in one pass (RK2, ML16)."""
    t = _totals(score_table(df, list(parts), score, y), list(parts))
    t = t.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in fracs])))
    w = share_in(F.col("frac"))
    out = t.groupBy(*parts, "frac").agg(
        (F.sum(w * F.col("pos")) / F.max("all_pos")).alias("recall"),
        (F.sum(w * F.col("pos")) / F.sum(w * F.col("n"))).alias("precision"),
        (F.max("all_pos") / F.max("all_n")).alias("_base"))
    return out.withColumn("lift", F.col("precision") / F.col("_base")).drop("_base")


def gains(df: DataFrame, parts: list[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    """Cumulative gains at the end of each tie group, in percent (RK3)."""
    t = _totals(score_table(df, list(parts), score, y), list(parts))
    return t.select(*parts, score, (F.col("end") / F.col("all_n") * 100).alias("listed_pct"),
                    (F.col("cum_pos") / F.col("all_pos") * 100).alias("caught_pct"))


def ranked(df: DataFrame, tiebreak: str, key: str, score: str = "score", parts: list[str] = ()) -> DataFrame:
    """Position by score, then the lower average, then id."""
    return positions(df, list(parts), [F.col(score).desc(), F.col(tiebreak).asc(), F.col(key).asc()])


def catch_table(order: DataFrame, ks: list[int], parts: list[str] = (), y: str = "y") -> DataFrame:
    """Positives among the first K positions, for several K (RK4)."""
    y0 = F.coalesce(F.col(y), F.lit(0))
    got = order.groupBy(*parts).agg(
        F.sum(y0).alias("total"), F.max("position").alias("_n"),
        *[F.coalesce(F.sum(F.when(F.col("position") <= k, y0)), F.lit(0)).alias(f"_c{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_c{k}").alias("caught")) for k in ks])).alias("_r")
    return got.select(*parts, "total", "_n", rows).select(*parts, "_r.k", "_r.caught", "total", "_n").where("k <= _n").drop("_n")


def auc(df: DataFrame, parts: list[str] = (), score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties at half; null with one class (ML9)."""
    t = score_table(df, list(parts), score, y, weight)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    num = F.sum(neg * (above + F.col("pos") / F.lit(2.0)))
    aggs = [num.alias("_num"), F.sum("pos").alias("positives"), F.sum(neg).alias("negatives")]
    out = t.groupBy(*parts).agg(*aggs) if parts else t.agg(*aggs)
    both = F.col("positives") * F.col("negatives")
    return out.select(*parts, "positives", "negatives", (F.col("_num") / F.when(both > 0, both)).alias("auc"))


def average_precision(df: DataFrame, parts: list[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    """Step-wise area under precision and recall (ML10)."""
    t = _totals(score_table(df, list(parts), score, y), list(parts))
    step = F.sum(F.col("pos") * F.col("cum_pos") / F.col("end")) / F.max("all_pos")
    return t.groupBy(*parts).agg(step.alias("average_precision")) if parts else t.agg(step.alias("average_precision"))


def log_loss(df: DataFrame, p: str = "p", y: str = "y", parts: list[str] = (), eps: float = 1e-15) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return df.groupBy(*parts).agg(F.avg(F.when(F.col(y) == 1, -F.log(q)).otherwise(-F.log(1 - q))).alias("log_loss"))


def assigned_slots(df: DataFrame, window: list[str], arms: dict[str, str], day: str = "dn") -> DataFrame:
    """Work each window's actual days highest score first (RK5).

    Ties share the mean of their days. A window has few distinct days, so the sum of its first p days
    is read from a short array of (day, count); only distinct scores are ordered. Returns the rows
    of ``df`` once per arm with ``assigned`` and ``days_earlier``.
    """
    c = F.col
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c(s).cast("double").alias("arm_score"))
                                              for a, s in arms.items()])).alias("_a")).select(*df.columns, "_a.arm", "_a.arm_score")
    part = [*window, "arm"]
    groups = running_sums(long.groupBy(*part, "arm_score").agg(F.count("*").alias("_n")), part, [c("arm_score").desc()], {"_end": c("_n")})
    days = df.groupBy(*window, day).agg(F.count("*").alias("_m"))
    slots = days.groupBy(*window).agg(F.array_sort(F.collect_list(F.struct(c(day).alias("d"), c("_m").alias("m")))).alias("_slots"))
    groups = groups.join(slots, window)

    def day_sum(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("s"))

        def step(acc: Column, x: Column) -> Column:
            used = F.greatest(F.lit(0).cast("long"), F.least(x["m"], p - acc["at"]))
            return F.struct((acc["at"] + x["m"]).alias("at"), (acc["s"] + used * x["d"]).alias("s"))
        return F.aggregate("_slots", zero, step, lambda a: a["s"])
    mean = (day_sum(c("_end")) - day_sum(c("_end") - c("_n"))) / c("_n")
    at = groups.select(*part, "arm_score", mean.alias("assigned"))
    return long.join(at, [*part, "arm_score"]).withColumn("days_earlier", c(day) - c("assigned"))


def mid_ranks(df: DataFrame, parts: list[str], value: str, name: str) -> DataFrame:
    """Average rank of each value within a part, ascending, from value counts."""
    t = running_sums(df.groupBy(*parts, value).agg(F.count("*").alias("_n")), parts, [F.col(value)], {"_e": F.col("_n")})
    return df.join(t.select(*parts, value, (F.col("_e") - (F.col("_n") - 1) / 2.0).alias(name)), [*parts, value])


def within_window_auc(df: DataFrame, window: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Numerator and denominator per window with both classes (BS9)."""
    t = score_table(df, window, score, y)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    g = t.groupBy(*window).agg(F.sum(2 * neg * above + neg * F.col("pos")).alias("num2"), F.sum("pos").alias("_p"), F.sum(neg).alias("_q"))
    return g.where("_p > 0 and _q > 0").select(*window, "num2", (F.col("_p") * F.col("_q")).alias("den"))


def within_window_spearman(df: DataFrame, window: list[str], x: str, day: str, min_n: int = 10) -> DataFrame:
    """Rank correlation of being earlier and ``x``, per window of enough rows that vary (BS10)."""
    rows = df.where(F.col(x).isNotNull())
    r = mid_ranks(mid_ranks(rows, window, x, "_rx"), window, day, "_rd")
    # F.corr raises where a side does not vary; such a window is left out below.
    rho = F.try_divide(F.covar_pop(-F.col("_rd"), F.col("_rx")), F.stddev_pop("_rd") * F.stddev_pop("_rx"))
    return (r.groupBy(*window).agg(rho.alias("rho"), F.count("*").alias("n"),
                                   (F.max(x) > F.min(x)).alias("_vx"), (F.max(day) > F.min(day)).alias("_vd"))
            .where((F.col("n") >= min_n) & F.col("_vx") & F.col("_vd")).drop("_vx", "_vd"))


def first_per_name_and_address(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One entry per (name, address), the first in list order (RK11)."""
    return first_rows(df.withColumns({"_nk": norm_key(F.col("name")), "_ak": norm_key(F.col("address"))}),
                      ["_nk", "_ak"], keys).drop("_nk", "_ak")


def area_groups(df: DataFrame, area: str, value: str, labels: list[str]) -> DataFrame:
    """Whole areas into ordered groups of about equal rows, by the midpoint of their cumulative share (RK14)."""
    z = df.where(F.col(value).isNotNull()).groupBy(area).agg(F.min(value).alias("_v"), F.count("*").alias("_n"))
    t = running_sums(z, [], [F.col("_v"), F.col(area)], {"_cum": F.col("_n")})
    t = with_scalars(t, z.agg(F.sum("_n").alias("_all")))
    mid = (F.col("_cum") - F.col("_n") / 2.0) / F.col("_all")
    at = F.least(F.floor(mid * len(labels)).cast("int"), F.lit(len(labels) - 1))
    return t.select(area, F.element_at(F.array(*[F.lit(x) for x in labels]), at + 1).alias("grp"))


def page(df: DataFrame, filters: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A filtered page of a list with the total (RK9)."""
    rows = df.where(filters)
    return with_scalars(rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total")))


def list_filter(district=None, band=None, kind=None, flag=None, q: str | None = None) -> Column:
    """Any of the districts, bands and kinds; all of the flags and words (RK9)."""
    out = F.lit(True)
    for name, values in (("district", district), ("band", band), ("kind", kind)):
        if values:
            out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
    for f in flag or ():
        out = out & F.array_contains("flags", f)
    text = F.lower(F.concat_ws(" ", "name", "address"))
    for word in (q or "").lower().split():
        out = out & text.contains(word)
    return out


def search(df: DataFrame, tokens: Column, text: Column, n: int = 8) -> DataFrame:
    """Rows that hold every token: word starts first, then earlier hits, then name (RK10)."""
    zero = F.lit(0).cast("int")     # fixed value below: a hit inside a word ranks 500 places behind one at its start

    def one(acc: Column, tok: Column) -> Column:
        at = F.instr(text, tok) - 1
        start = (at == 0) | F.substring(text, at, F.lit(1)).rlike(r"[\s,&]")
        return F.when((acc < 0) | (at < 0), F.lit(-1)).otherwise(acc + at + F.when(start, 0).otherwise(500))
    return (df.withColumn("match", F.aggregate(tokens, zero, one)).where("match >= 0")
            .orderBy("match", "name", "facility_id").limit(n))


def display_order() -> list[Column]:
    """Band, points, name (RK8)."""
    return [F.coalesce(F.col("band").cast("int"), F.lit(99)), F.col("points").desc_nulls_last(), norm_key(F.col("name")), F.col("facility_id")]




def with_resampled(df: DataFrame, like, share: float, reps: int, frac: float = 0.2, seed: int = 1, key: str = "record_id",
                   score: str = "score", y: str = "y") -> DataFrame:
    """Capture when ``share`` more rows, drawn from those ``like`` a condition, join the list (AG17).

    Only distinct scores are repeated per replicate, never rows. Adds the worst case, where the new
    rows have the drawn outcomes and rank last.
    """
    from .ordering import dense_codes
    pool = df.where(like)
    codes = dense_codes(pool, key)
    n, extra = codes.count(), round(share * df.count())
    spark = df.sparkSession
    if n == 0 or extra == 0:
        raise ValueError("nothing to draw from")
    word = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    pick = F.conv(F.substring(word, 1, 8), 16, 10).cast("long") % n
    drawn = spark.range(reps * extra).select(F.floor(F.col("id") / extra).cast("int").alias("rep"), pick.alias("code"))
    drawn = drawn.groupBy("rep", "code").agg(F.count("*").alias("_t")).join(codes, "code").join(pool.select(key, score, y), key)
    more = drawn.groupBy("rep", score).agg(F.sum("_t").alias("n"), F.sum(F.col("_t") * F.col(y)).alias("pos"))
    base = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    base = base.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(reps)])))
    both = base.select("rep", score, "n", "pos").unionByName(more).groupBy("rep", score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    ran = _totals(running_sums(both, ["rep"], [F.col(score).desc()], {"end": F.col("n")}), ["rep"])
    cap = F.sum(share_in(F.lit(frac)) * F.col("pos")) / F.max("all_pos")
    alike = ran.groupBy("rep").agg(cap.alias("_c")).agg(F.avg("_c").alias("like_group"))
    last = running_sums(df.groupBy(score).agg(F.count("*").alias("n"), F.sum(y).alias("pos")), [], [F.col(score).desc()], {"end": F.col("n")})
    grown = with_scalars(last, df.agg((F.count("*") + extra).alias("all_n"), F.sum(y).alias("_p")))
    rate = pool.agg(F.avg(y).alias("_rate"))
    worst = with_scalars(grown, rate).agg((F.sum(share_in(F.lit(frac)) * F.col("pos")) / (F.max("_p") + F.max("_rate") * extra)).alias("worst"))
    return with_scalars(alike, worst)
