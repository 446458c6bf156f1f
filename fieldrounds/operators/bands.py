"""Score bands, their validation, the monotone rate curve, and drift.

Points are whole numbers from 0 to 100 under the average rule, so a histogram of points, the groups
of a curve and the bands of a list are short arrays; everything up to them is a distributed
aggregate.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import r6, wilson
from ..rules import RULES, Rules
from .joins import with_scalars
from .ordering import positions, running_sums
from .resample import dealt, replicate_sums


def band_cuts(df: DataFrame, points: str = "points", shares: tuple[float, ...] = RULES.band_shares) -> DataFrame:
    """One row with ``cuts``: whole-point cut-offs nearest each target share, never splitting a tie (BD1)."""
    c = F.col
    hist = df.groupBy(points).agg(F.count("*").alias("_n"))
    cum = with_scalars(running_sums(hist, [], [c(points).desc()], {"_cum": c("_n")}), hist.agg(F.sum("_n").alias("_all")))
    return cum.agg(falling_cuts([nearest_cut(s, points) for s in shares]).alias("cuts"))


def nearest_cut(share: float, points: str = "points") -> Column:
    """Of rows with points, ``_cum`` (rows down to these) and ``_all``: the points where the share above is nearest, the higher of two."""
    c = F.col
    return F.min_by(c(points), F.struct(F.abs(c("_cum") - F.lit(share) * c("_all")), -c(points))).cast("double")


def falling_cuts(cuts: list[Column]) -> Column:
    """The cut-offs that fall, in order; one that does not is left out."""
    def fall(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNull() | (x < last), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(F.array_compact(F.array(*cuts)), F.array().cast("array<double>"), fall)


def band_of(points: Column, cuts: Column) -> Column:
    """Band key by descending cut-offs, null below the last (BD2)."""
    at = F.size(F.filter(cuts, lambda x: x > points)) + 1
    return F.when(at <= F.size(cuts), at.cast("string"))


def assign_bands(df: DataFrame, cuts: DataFrame, points: str = "points") -> DataFrame:
    """``band`` for the eligible rows of a scored list."""
    d = with_scalars(df, cuts)
    return d.withColumn("band", F.when(F.col("eligible"), band_of(F.col(points), F.col("cuts")))).drop("cuts")


def fixed_cuts(df: DataFrame, cuts: list[float]) -> Column:
    return F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")


def band_table(df: DataFrame, parts: list[str] = ()) -> DataFrame:
    """Places, labelled, positives, rate and its interval by band and for the eligible rest (BD3)."""
    g = (df.where("eligible").groupBy(*parts, F.coalesce("band", F.lit("rest")).alias("band"))
         .agg(F.min("points").alias("min_points"), F.max("points").alias("max_points"), F.count("*").alias("places"),
              F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("positives")))
    low, high = wilson(F.col("positives"), F.col("labelled"))
    return g.select("*", (F.col("positives") / F.when(F.col("labelled") > 0, F.col("labelled"))).alias("rate"), low.alias("low"), high.alias("high"))


def baseline_groups(df: DataFrame, baseline: str, tiebreak: str, key: str) -> DataFrame:
    """The baseline's group of the same size as each band: eligible rows in the baseline's order, cut
    at the cumulative band sizes (BD3). Adds ``baseline_band``."""
    el = positions(df.where("eligible"), [], [F.col(baseline).desc(), F.col(tiebreak), F.col(key)], "_pos")
    sizes = df.where(F.col("band").isNotNull()).groupBy("band").agg(F.count("*").alias("_n"))
    ends = sizes.select("band", F.sum("_n").over(W.orderBy(F.col("band").cast("int"))).alias("_end"))
    cut = ends.agg(F.array_sort(F.collect_list(F.struct("_end", "band"))).alias("_ends"))
    d = with_scalars(el, cut)
    hit = F.try_element_at(F.filter("_ends", lambda e: F.col("_pos") <= e["_end"]), F.lit(1))
    return d.withColumn("baseline_band", hit["band"]).drop("_pos", "_ends")


def paired_hits(df: DataFrame, cluster: str, band: str, reps: int, seed: int = 0) -> DataFrame:
    """Hits in a band minus hits in the baseline's same-size group, by replicate (BS5)."""
    diff = F.sum(F.coalesce("y", F.lit(0)) * ((F.coalesce(F.col("band") == band, F.lit(False))).cast("int")
                                                - (F.coalesce(F.col("baseline_band") == band, F.lit(False))).cast("int")))
    per = df.groupBy(cluster).agg(diff.alias("diff"))
    return replicate_sums(dealt(per, cluster), cluster, ["diff"], reps=reps, seed=seed)


def band_counts(df: DataFrame, cuts: list[float], parts: list[str] = ("as_of",)) -> DataFrame:
    """Positives and labelled by origin and proposed band, among the eligible."""
    d = df.where("eligible and y is not null").withColumn("band", F.coalesce(band_of(F.col("points"), fixed_cuts(df, cuts)), F.lit("rest")))
    return d.groupBy(*parts, "band").agg(F.sum("y").alias("k"), F.count("*").alias("n"))


def validate_cuts(counts: list[tuple], cuts: list[float], z: float = RULES.band_z) -> list[float]:
    """Keep a split only when it is real at every origin and on the pooled counts (BD4).

    ``counts`` holds (origin, band, positives, labelled), one row per origin and band. Dropping cut i
    merges band i + 1 with the next one, which adds their counts, so the check restarts on the same
    few rows.
    """
    origins = sorted({o for o, *_ in counts})
    table = {(o, b): (k, n) for o, b, k, n in counts}
    rows = [[table.get((o, b), (0, 0)) for b in [str(i + 1) for i in range(len(cuts))] + ["rest"]] for o in origins]
    cuts = list(cuts)

    def real(i: int) -> bool:
        pairs = [(r[i], r[i + 1]) for r in rows]
        if not pairs or any(not hi[1] or not lo[1] or hi[0] / hi[1] <= lo[0] / lo[1] for hi, lo in pairs):
            return False
        def pooled(side: int) -> tuple[float, float]:
            k, n = sum(p[side][0] for p in pairs), sum(p[side][1] for p in pairs)
            return k / n, n / len(origins)
        (ph, nh), (pl, nl) = pooled(0), pooled(1)
        se = math.sqrt(ph * (1 - ph) / nh + pl * (1 - pl) / nl)
        return se > 0 and (ph - pl) / se >= z
    i = 0
    while i < len(cuts):
        if real(i):
            i += 1
            continue
        del cuts[i]
        rows = [r[:i] + [(r[i][0] + r[i + 1][0], r[i][1] + r[i + 1][1])] + r[i + 2:] for r in rows]
        i = 0
    return cuts


def validated_cuts(df: DataFrame, cuts: DataFrame, most: int, rules: Rules = RULES) -> DataFrame:
    """One row with ``cuts``: those of a one-row frame (at most ``most``) that hold on a frame with several origins (BD4), by the rule of ``validate_cuts``.

    Counts by origin and band are a short table, one array per band; a fold over as many turns as there are cuts looks for the first split that is not
    real and adds its two bands up, so nothing goes to the driver.
    """
    c, count = F.col, "struct<k:bigint,n:bigint>"
    # Bands are numbers here: 0 above the first cut, the number of cuts below the last.
    lab = with_scalars(df.where("eligible and y is not null").select("as_of", "points", "y"), cuts)
    counts = lab.groupBy("as_of", F.size(F.filter("cuts", lambda x: x > c("points"))).alias("b")).agg(
        F.sum("y").cast("long").alias("k"), F.count("*").alias("n"))
    by_origin = counts.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("k", "n")))).alias("m"))
    nothing = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n")).cast(count)
    table = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda b: F.transform("_of", lambda m: F.coalesce(F.try_element_at(m, b), nothing)))
    state = with_scalars(by_origin.agg(F.collect_list("m").alias("_of")), cuts).select("cuts", table.alias("rows"))

    def total(a: Column, part: str) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x[part])

    def real(hi: Column, lo: Column) -> Column:
        rate = lambda x: x["k"] / F.when(x["n"] > 0, x["n"])
        above = F.forall(F.zip_with(hi, lo, lambda h, o: F.coalesce(rate(h) > rate(o), F.lit(False))), lambda x: x)
        ph, pl = (total(x, "k") / F.when(total(x, "n") > 0, total(x, "n")) for x in (hi, lo))
        se = F.sqrt(ph * (1 - ph) / (total(hi, "n") / F.size(hi)) + pl * (1 - pl) / (total(lo, "n") / F.size(lo)))
        return above & (F.size(hi) > 0) & F.coalesce((se > 0) & ((ph - pl) / se >= rules.band_z), F.lit(False))

    def turn(acc: Column, _: Column) -> Column:
        cuts_, rows = acc["cuts"], acc["rows"]
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(cuts_), F.lit(1))),
                      lambda i: (i <= F.size(cuts_)) & ~real(F.element_at(rows, i), F.element_at(rows, i + 1)))
        bad = F.try_element_at(at, F.lit(1))

        def merged(b: Column) -> Column:
            both = F.zip_with(F.element_at(rows, b), F.element_at(rows, b + 1),
                              lambda x, y: F.struct((x["k"] + y["k"]).alias("k"), (x["n"] + y["n"]).alias("n")))
            return F.struct(F.concat(F.slice(cuts_, F.lit(1), b - 1), F.slice(cuts_, b + 1, F.size(cuts_))).alias("cuts"),
                            F.concat(F.slice(rows, F.lit(1), b - 1), F.array(both), F.slice(rows, b + 2, F.size(rows))).alias("rows"))
        return F.when(bad.isNull(), acc).otherwise(merged(F.coalesce(bad, F.lit(1))))
    start = F.struct(c("cuts"), c("rows"))
    return state.select(F.aggregate(F.array(*[F.lit(i) for i in range(most)]), start, turn)["cuts"].alias("cuts"))


def attached(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of a short table: its only row, or that of the same ``keys``."""
    return df.join(few, keys) if keys else with_scalars(df, few)


def curve_groups(df: DataFrame, min_n: int = RULES.curve_min, keys: list[str] = ()) -> DataFrame:
    """One row (per ``keys``) with ``groups``: point values pooled from the top into groups of at least ``min_n``
    labelled places, low to high, each with its counts (BD5)."""
    hist = df.where("eligible and y is not null").groupBy(*keys, F.col("points").cast("int").alias("p")).agg(
        F.count("*").alias("n"), F.sum("y").alias("k"))
    arr = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "p", "n", "k"))).alias("h"))
    group = "struct<lo:int,hi:int,n:bigint,k:bigint>"
    empty = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(None).cast(group).alias("cur"))

    def made(lo, hi, n, k) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), n.alias("n"), k.alias("k"))

    def step(acc: Column, x: Column) -> Column:
        cur = F.when(acc["cur"].isNull(), made(x["p"], x["p"], x["n"], x["k"])).otherwise(
            made(x["p"], acc["cur"]["hi"], acc["cur"]["n"] + x["n"], acc["cur"]["k"] + x["k"]))
        full = cur["n"] >= min_n
        return F.struct(F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
                        F.when(~full, cur).alias("cur"))

    def finish(acc: Column) -> Column:
        # A short tail joins the group above it; alone, it is the only group.
        last, cur = F.try_element_at(acc["done"], F.lit(-1)), acc["cur"]
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1),
                          F.array(made(cur["lo"], last["hi"], last["n"] + cur["n"], last["k"] + cur["k"])))
        return F.when(cur.isNull(), acc["done"]).when(last.isNull(), F.array(cur)).otherwise(joined)
    return arr.select(*keys, F.reverse(F.aggregate("h", empty, step, finish)).alias("groups"))


def isotonic(w: Column, s: Column) -> Column:
    """Closest non-decreasing means of ``s / w`` with weights ``w``, by pooling adjacent violators in one fold.

    The fold keeps blocks of pooled places; a place that lies below the last block takes it in, and goes on as long as it does. Each place is pooled once.
    """
    block = "array<struct<w:double,s:double,n:int>>"

    def pooled(done: Column, x: Column) -> Column:
        def back(acc: Column, b: Column) -> Column:
            stop = acc["stop"] | (b["s"] * acc["w"] <= acc["s"] * b["w"])
            return F.when(stop, F.struct(acc["w"].alias("w"), acc["s"].alias("s"), acc["n"].alias("n"), acc["took"].alias("took"), F.lit(True).alias("stop"))).otherwise(
                F.struct((acc["w"] + b["w"]).alias("w"), (acc["s"] + b["s"]).alias("s"), (acc["n"] + b["n"]).alias("n"), (acc["took"] + 1).alias("took"), F.lit(False).alias("stop")))
        start = F.struct(x["w"].alias("w"), x["s"].alias("s"), F.lit(1).alias("n"), F.lit(0).alias("took"), F.lit(False).alias("stop"))
        return F.aggregate(F.reverse(done), start, back)

    def step(done: Column, x: Column) -> Column:
        add = lambda m: F.concat(F.slice(done, F.lit(1), F.size(done) - m["took"]), F.array(F.struct(m["w"].alias("w"), m["s"].alias("s"), m["n"].alias("n"))))
        return F.element_at(F.transform(F.array(pooled(done, x)), add), 1)
    each = F.zip_with(w, s, lambda a, b: F.struct(a.alias("w"), b.alias("s")))
    blocks = F.aggregate(each, F.array().cast(block), step)
    return F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["s"] / b["w"], b["n"])))


def risk_curve(df: DataFrame, cluster: str, reps: int = 200, min_n: int = RULES.curve_min, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """The monotone rate of each group of points with an address-cluster interval (BD6), a curve for each of ``keys`` (BD8).

    One row per group: ``lo, hi, labelled, positives, rate, low, high``. A replicate reweights each
    cluster's counts by group; all keys and replicates go through the same short fold at once.
    """
    c, keys = F.col, list(keys)
    groups = curve_groups(df, min_n, keys)
    base = groups.select(*keys, F.posexplode("groups").alias("g", "x")).select(*keys, "g", "x.lo", "x.hi", "x.n", "x.k")
    rows = attached(df.where("eligible and y is not null").select(cluster, *keys, "points", "y"), groups, keys)
    which = F.size(F.filter("groups", lambda g: g["lo"] <= c("points"))) - 1
    per = rows.select(cluster, *keys, "y", which.alias("g")).groupBy(cluster, *keys, "g").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    drawn = replicate_sums(dealt(per, cluster), cluster, ["n", "k"], [*keys, "g"], reps, seed)
    size = groups.select(*keys, F.size("groups").alias("_g"))

    def fitted(t: DataFrame, by: list[str]) -> DataFrame:
        m = t.groupBy(*keys, *by).agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("n", "k")))).alias("m"))
        m = attached(m, size, keys)
        ids = F.sequence(F.lit(0), c("_g") - 1)
        w = F.transform(ids, lambda i: F.greatest(F.coalesce(c("m")[i]["n"], F.lit(0)), F.lit(1)).cast("double"))
        # An undrawn group enters with weight 1 and rate 0, as one clean place.
        s = F.transform(ids, lambda i: F.coalesce(c("m")[i]["k"], F.lit(0)).cast("double"))
        return m.select(*keys, *by, w.alias("w"), s.alias("s")).select(*keys, *by, F.posexplode(isotonic(c("w"), c("s"))).alias("g", "rate"))
    point = fitted(base.withColumn("one", F.lit(1)), ["one"]).select(*keys, "g", "rate")
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    spread = fitted(drawn, ["rep"]).groupBy(*keys, "g").agg(q.alias("q"))
    out = base.join(point, [*keys, "g"]).join(spread, [*keys, "g"], "left")
    return out.select(*keys, "lo", "hi", c("n").alias("labelled"), c("k").alias("positives"), "rate",
                      F.least("rate", F.coalesce(F.element_at("q", 1), c("rate"))).alias("low"),
                      F.greatest("rate", F.coalesce(F.element_at("q", 2), c("rate"))).alias("high"))


def estimates(df: DataFrame, curve: DataFrame, keys: list[str] = (), points: str = "points") -> DataFrame:
    """The curve read at each place's points: the group holding them, the one below between groups,
    the lowest below all, the highest above all (BD7, BD8 with ``keys``)."""
    arr = F.array_sort(F.collect_list(F.struct("lo", "hi", "rate", "low", "high"))).alias("_curve")
    keys = list(keys)
    d = df.join(curve.groupBy(*keys).agg(arr), keys, "left") if keys else with_scalars(df, curve.agg(arr))
    below = F.filter("_curve", lambda g: g["lo"] <= F.col(points))
    g = F.coalesce(F.try_element_at(below, F.lit(-1)), F.try_element_at(F.col("_curve"), F.lit(1)))
    return (d.withColumn("_g", g).select(*df.columns, F.col("_g.rate").alias("est_rate"), F.col("_g.low").alias("est_low"),
                                         F.col("_g.high").alias("est_high"), F.col("_g.lo").alias("est_min_points"), F.col("_g.hi").alias("est_max_points")))


def curve_bins(df: DataFrame, bins: int = 8) -> DataFrame:
    """Raw rates in about equal groups of places, edges at whole-point quantiles (BD6)."""
    from .ordering import exact_quantiles
    lab = df.where("eligible and y is not null")
    q = exact_quantiles(lab.withColumn("points", F.col("points").cast("int")), [], "points", {f"q{i}": i / bins for i in range(bins + 1)})
    cuts = q.select(F.array_sort(F.array_distinct(F.array(*[F.floor(F.col(f"q{i}")).cast("int") for i in range(bins + 1)]))).alias("_e"))
    d = with_scalars(lab.select("points", "y"), cuts)
    at = F.greatest(F.least(F.size(F.filter("_e", lambda e: e <= F.col("points"))), F.size("_e") - 1), F.lit(1))
    g = d.groupBy(at.alias("bin")).agg(F.min("points").cast("int").alias("min_points"), F.max("points").cast("int").alias("max_points"),
                                       F.count("*").alias("labelled"), F.sum("y").alias("positives"))
    low, high = wilson(F.col("positives"), F.col("labelled"))
    return g.select("*", (F.col("positives") / F.col("labelled")).alias("rate"), low.alias("low"), high.alias("high"))


def named_bands(rows: DataFrame, ratios=(0.25, 0.5, 1.0, 2.0, 3.0)) -> DataFrame:
    """Bands whose interval clears the bar C / (1 + C), for several cost ratios (BD9)."""
    r = F.explode(F.array(*[F.lit(float(x)) for x in ratios if x > 0])).alias("cost_ratio")
    t = rows.where("band <> 'rest'").select("band", "low", r)
    return t.select("cost_ratio", "band", (F.col("cost_ratio") / (1 + F.col("cost_ratio"))).alias("bar")
                    , F.coalesce(F.col("low") > F.col("cost_ratio") / (1 + F.col("cost_ratio")), F.lit(False)).alias("named"))


def outside_bands(df: DataFrame, city: DataFrame, most: int, rules: Rules = RULES) -> DataFrame:
    """Bands outside the city only when all of the city's validated cuts (a row of ``cuts``) hold there too (BD10)."""
    there = validated_cuts(df.where("district is null"), city, most, rules)
    ok = with_scalars(city, there.select(F.col("cuts").alias("_there"))).select(((F.size("cuts") > 0) & (F.col("cuts") == F.col("_there"))).alias("_ok"))
    named = with_scalars(df, ok)
    return named.withColumn("band", F.when(F.col("_ok") | F.col("district").isNotNull(), F.col("band"))).drop("_ok")


def interim_rates(df: DataFrame, days: tuple[int, ...] = RULES.interim_days) -> DataFrame:
    """Rates when the label is cut short: band 1 and all eligible, every horizon in one pass (AG18)."""
    c = F.col
    long = df.where("eligible").select("band", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), c(f"y_d{d}").alias("y")) for d in days])).alias("_x"))
    long = long.select("band", "_x.days", "_x.y").where("y is not null")
    groups = F.array_compact(F.array(F.lit("all"), F.when(c("band") == "1", F.lit("1"))))
    return (long.select("days", "y", F.explode(groups).alias("grp")).groupBy("days", "grp")
            .agg(F.count("*").alias("labelled"), F.sum("y").alias("positives"), F.avg("y").alias("rate")))


def by_route(df: DataFrame, visits: DataFrame, at: str, cut: float, rules: Rules = RULES) -> DataFrame:
    """Band 1 split by whether a closure or the scores put a place there (AG19)."""
    day = F.lit(at).cast("date")
    rt = visits.where((F.col("visit_type") == "routine") & F.col("rated").isNotNull() & (F.col("day") < day)
                      & (F.datediff(day, "day") <= rules.score_window_days))
    closed = F.coalesce(F.col("closure_order") == "health", F.lit(False))
    rest = rt.groupBy("business_id").agg(F.avg(F.when(~closed, F.col("rated"))).alias("_rest"), F.bool_or(closed).alias("_any"))
    carried = F.col("_any") & (F.col("_rest").isNull() | (100 - F.floor(F.col("_rest") + 0.5) < cut))
    d = df.where("band = '1' and y is not null").join(rest, "business_id")
    return d.groupBy(F.when(carried, "closure").otherwise("scores").alias("route")).agg(
        F.count("*").alias("labelled"), F.sum("y").alias("positives"), F.avg("y").alias("rate"))


def fairness_problems(audit: DataFrame, min_named: int = 10) -> DataFrame:
    """Districts over a point threshold, one row per problem (BD11)."""
    c = F.col
    found = F.array_compact(F.array(
        F.when((c("named") >= min_named) & (c("false_share_ratio") > 1.25), F.lit("share of wrongly named")),
        F.when((c("named") >= min_named) & (c("fpr_ratio") > 1.5), F.lit("false-positive rate")),
        F.when((c("high") > 2.0) & (c("named") >= 3), F.lit("interval reaches twice even"))))
    return audit.select("district", F.explode(found).alias("problem"))


def district_audit(df: DataFrame, named: Column) -> DataFrame:
    """Named, labelled and wrongly named places by district, against the whole list (BS7 point values)."""
    lab = F.col("y").isNotNull()
    clean = lab & (F.col("y") == 0)
    fp = named & clean
    g = df.groupBy("district").agg(
        F.count("*").alias("candidates"), F.count_if(lab).alias("labelled"), F.count_if(named).alias("named"),
        F.count_if(named & (F.col("y") == 1)).alias("named_positive"), F.count_if(fp).alias("false_named"), F.count_if(clean).alias("_neg"),
        F.count_if(named & lab).alias("_nl"))
    g = with_scalars(g, df.agg(F.count_if(fp).alias("_fp_all"), F.count_if(clean).alias("_neg_all"), F.count_if(lab).alias("_lab_all")))
    fpr_all = F.col("_fp_all") / F.greatest(F.lit(1), F.col("_neg_all"))
    share = F.col("labelled") / F.greatest(F.lit(1), F.col("_lab_all"))
    low, high = wilson(F.col("named_positive"), F.col("_nl"))
    return g.select(
        "district", "candidates", "labelled", "named", "named_positive", "false_named",
        F.when(F.col("named") > 0, r6(F.col("named_positive") / F.greatest(F.lit(1), F.col("_nl")), 3)).alias("precision"),
        low.alias("precision_low"), high.alias("precision_high"),
        r6((F.col("false_named") / F.greatest(F.lit(1), F.col("_neg"))) / F.when(fpr_all > 0, fpr_all), 2).alias("fpr_ratio"),
        r6((F.col("false_named") / F.when(F.col("_fp_all") > 0, F.col("_fp_all"))) / F.when(share > 0, share), 2).alias("false_share_ratio"))


def drift(by_month: DataFrame, confirm: str, through: str, share_then: float | None = None, n_then: int | None = None,
          share_now: float | None = None, n_now: int | None = None, rules: Rules = RULES, min_quarter: int = 200) -> DataFrame:
    """One row: the routine major rate of the last two complete quarters after the label year against
    the label year's, band 1's share then and now, and the status they give (BD12).

    ``by_month`` has ``month (yyyy-MM), n, positives``: at most twelve rows a year.
    """
    c = F.col
    first = F.to_date(F.concat("month", F.lit("-01")))
    label_end = F.date_add(F.lit(confirm).cast("date"), rules.label_days - 1)
    m = by_month.select("*", first.alias("_d"), F.trunc(first, "quarter").alias("_q"))
    q = m.groupBy("_q").agg(F.sum("n").alias("n"), F.sum("positives").alias("k")).where(c("n") >= min_quarter)
    q = q.withColumn("_end", F.last_day(F.add_months("_q", 2)))
    done = q.where((c("_q") > label_end) & (F.date_add("_end", rules.report_lag_days) <= F.lit(through).cast("date")))
    last2 = done.agg(F.slice(F.sort_array(F.collect_list(F.struct("_q", "n", "k")), False), 1, 2).alias("_l"))
    now = last2.select(F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_now"),
                       F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("k_now"))
    latest = q.agg(F.max_by(F.struct("_q", "n", "k"), "_q").alias("latest"))
    inside = m.where((c("month") >= confirm[:7]) & (c("month") <= F.date_format(label_end, "yyyy-MM")))
    inside = with_scalars(inside, latest)
    then = inside.agg(F.sum("n").alias("n_then"), F.sum("positives").alias("k_then"),
                      F.sum(F.when(c("latest").isNull() | (c("_d") < c("latest._q")), c("n"))).alias("n_note"),
                      F.sum(F.when(c("latest").isNull() | (c("_d") < c("latest._q")), c("positives"))).alias("k_note"))
    one = with_scalars(with_scalars(then, now), latest)

    def moved(p1: Column, n1: Column, p0: Column, n0: Column) -> Column:
        se = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
        return F.abs(p1 - p0) > F.greatest(F.lit(rules.drift_min), F.lit(rules.drift_se) * se)

    def rate(k: str, n: str) -> Column:
        return c(k) / F.when(c(n) > 0, c(n))
    one = one.select("*", rate("k_then", "n_then").alias("rate_then"), rate("k_now", "n_now").alias("rate_now"), rate("k_note", "n_note").alias("rate_note"),
                     (c("latest.k") / c("latest.n")).alias("rate_latest"))
    measurable = c("rate_now").isNotNull() & c("rate_then").isNotNull()
    rate_moved = F.coalesce(measurable & moved(c("rate_now"), c("n_now"), c("rate_then"), c("n_then")), F.lit(False))
    share_moved = F.lit(False)
    if None not in (share_then, share_now) and n_then and n_now:
        share_moved = moved(F.lit(share_now), F.lit(n_now), F.lit(share_then), F.lit(n_then))
    status = F.when(rate_moved | share_moved, "refit").when(measurable, "ok").otherwise("not_yet_measurable")
    note = F.coalesce(moved(c("rate_latest"), c("latest.n"), c("rate_note"), c("n_note")), F.lit(False))
    return one.select("n_then", "rate_then", "n_now", "rate_now", c("latest._q").alias("latest_quarter"), c("latest.n").alias("latest_n"), "rate_latest",
                      "n_note", "rate_note", rate_moved.alias("rate_moved"), share_moved.alias("share_moved"), status.alias("status"), note.alias("note"))


def survivorship(df: DataFrame, band1_rate: float | None = None, missing=(0.05, 0.10)) -> tuple[DataFrame, Column | None]:
    """Positive rates by permit status (AG16), and band 1's rate had a share of its places been closers."""
    g = df.where("y is not null").groupBy(F.coalesce("permit_status", F.lit("?")).alias("permit_status")).agg(
        F.count("*").alias("labelled"), F.avg("y").alias("rate"))
    if band1_rate is None:
        return g, None
    r_exp = F.max(F.when(F.col("permit_status") == "Expired", F.col("rate")))
    return g, F.array(*[(1 - m) * F.lit(band1_rate) + m * r_exp for m in missing])
