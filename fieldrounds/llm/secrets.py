r"""Secret scans over a ledger of content-addressed blobs, with Spark expressions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger has a row for each blob and rule version
that was scanned, found secrets or not. A scan takes the distinct blobs of its input, looks up which rules each has not
met in their present version, runs only those, and adds the new rows; findings are joined back to all paths of a blob.
A changed rule gets a new version and scans every blob again; a known text under a new path is not scanned. Without a ledger to
look up, a text that no rule matches is found where it is read and does not move; nor do rows without findings when secrets are masked.

A match's place comes from the text itself: matches are fenced with a control character, the text is split at it, and
running lengths of the parts are code point offsets. In the text that control character is first put into another
(one for one), which no rule matches either.

Cases: a null text is empty; it has a blob but no findings. Repeated rows share a blob. Spans are in code points, end
exclusive. An empty table gives an empty result. Only the id and the text are read.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import let, parted, prefix_sums

FENCE, STAND_IN = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and not overlapping; those whose ``group`` is under ``least`` long are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The rules that are asked for. A run of one class of characters is matched whole either way, so hex and
# access state their least length in the pattern and need not mark shorter runs.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """Places of a rule's matches in ``text`` (which has no fence)."""
    fenced = F.regexp_replace(text, rule.pattern, FENCE + "$0" + FENCE)

    def placed(parts: Column) -> Column:
        starts = prefix_sums(F.transform(parts, lambda p: F.length(p).cast("long")))
        every = F.zip_with(parts, starts, lambda p, at: F.struct(p.alias("p"), at.alias("at")))
        inside = F.filter(every, lambda x, i: (i % 2 == 1) & (F.length(F.regexp_extract(x["p"], rule.pattern, rule.group)) >= rule.least))
        return F.transform(inside, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["p"])).alias("end")))
    return F.when(text.rlike(rule.pattern), let(F.split(fenced, FENCE, -1), placed)).otherwise(F.array().cast(SPANS))


def addressed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, blob``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (``blob, kind, version, spans``): each blob of ``docs`` with each rule version it has not met."""
    safe = F.when(F.instr("text", FENCE) > 0, F.replace("text", F.lit(FENCE), F.lit(STAND_IN))).otherwise(F.col("text"))
    rows = addressed(docs).withColumn("text", safe)
    if ledger is None and rules:
        rows = rows.withColumn("text", F.when(reduce(Column.__or__, [F.col("text").rlike(r.pattern) for r in rules]), F.col("text")))
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    due = {r.kind: F.lit(True) for r in rules}
    if ledger is not None:
        met = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_met"))
        blobs = blobs.join(met, F.col("blob") == F.col("_blob"), "left")
        due = {r.kind: ~F.coalesce(F.array_contains("_met", f"{r.kind}:{r.version}"), F.lit(False)) for r in rules}
        blobs = blobs.where(F.greatest(*due.values()) if len(due) > 1 else next(iter(due.values())))
    found = blobs.select("blob", F.array(*[F.when(due[r.kind], F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]).alias("rows"))
    return found.select("blob", F.explode(F.filter("rows", lambda r: r.isNotNull())).alias("r")).select("blob", "r.*")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found``: the spans of the present rule versions as ``array<struct<start, rank, end>>`` in order, one row per
    blob that has any."""
    per = None
    for i, r in enumerate(rules):
        mine = (F.col("kind") == r.kind) & (F.col("version") == r.version)
        per = F.when(mine, F.lit(i)) if per is None else per.when(mine, F.lit(i))
    hit = ledger.where(F.size("spans") > 0).withColumn("rank", per).where("rank is not null")
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end")))
    return hit.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(each))).alias("found"))


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every path: a count per kind and all spans, one row per row of ``docs``."""
    paths = addressed(docs).select("doc_id", "blob")
    hit = findings(ledger, rules).select(F.col("blob").alias("_blob"), "found")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    joined = paths.join(hit, F.col("blob") == F.col("_blob"), "left")
    count = lambda i: F.coalesce(F.size(F.filter("found", lambda s: s["rank"] == i)), F.lit(0)).cast("long")
    return joined.select("doc_id", *[F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(count(i)).alias(f"n_{r.kind}")
                                     for i, r in enumerate(rules)], F.coalesce(text, F.lit("")).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each finding put into ``mask`` (spans that overlap share one) and ``n_chars``, if there, made to fit."""
    hit = stored(findings(ledger, rules).select(F.col("blob").alias("_blob"), "found"), "found")
    blob = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    # Columns are named through their frames: ``docs`` may have any names of its own.
    some, rest = parted(docs, blob, hit, F.col("_blob"))
    joined = some.join(hit, blob == hit["_blob"], "left")
    old, found = docs["text"], hit["found"]
    # Spans are in order of start; one that starts before an earlier one ends is joined to it.
    merged = F.aggregate(found, F.array().cast(SPANS), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))

    def cut_out(m: Column) -> Column:
        kept = F.transform(m, lambda s, i: F.substr(
            old, (F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"]) + 1).cast("int"),
            (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])).cast("int")))
        return F.concat(F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(mask))), ""), F.substr(old, (F.element_at(m, -1)["end"] + 1).cast("int")))
    new = F.when(found.isNull(), old).otherwise(let(merged, cut_out))
    out = [new.alias(c) if c == "text" else F.when(found.isNull(), docs[c]).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c)
           if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(*out).union(rest)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after ``docs``: what it had and what was new, written once so that no blob is scanned twice."""
    new = stored(scan(docs, ledger, rules), "ledger")
    return new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
