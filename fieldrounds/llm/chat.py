r"""Chat formatting with Spark expressions only.

Template: ``<turn ROLE>`` TEXT ``</turn>`` and a line end per turn; neighbouring rows of one role share a turn, their
texts parted by ``<part>``. In texts and roles ``\`` becomes ``\s`` and ``<`` becomes ``\l`` (in roles also ``>`` ``\g``),
so ``<`` occurs in control marks only and every escape can be undone: a ``\`` always starts one.
The loss mask is a list of code point spans, one for each assistant text, marks not included.

Cases: a null text or role is an empty string; rows are ordered by turn, role and text (null turns first), so ties and
repeated rows have one order; a conversation without assistant rows has an empty mask; a null conversation id is a
conversation of its own; an empty table gives an empty result. A conversation is one output row and is therefore
held by one task. Only the named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, prefix_sums

OPEN, PART, CLOSE = "<turn ", "<part>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _runs(turns: Column) -> Column:
    """Neighbouring turns of one role as ``struct(role, texts)``."""
    def merged(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i]["role"] != t[F.greatest(i - 1, F.lit(0))]["role"]))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            t[at]["role"].alias("role"),
            F.transform(F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: x["text"]).alias("texts"))))
    return let(turns, merged)


def _pieces(run: Column) -> Column:
    """The strings of one run in order, with a flag on those under the loss mask."""
    role = F.replace(escape(run["role"]), F.lit(">"), F.lit("\\g"))
    mark = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))
    texts = F.flatten(F.transform(run["texts"], lambda x, i: F.array(
        mark(F.when(i == 0, F.concat(F.lit(OPEN), role, F.lit(">"))).otherwise(PART)),
        F.struct(escape(x).alias("s"), (run["role"] == "assistant").alias("loss")))))
    return F.concat(texts, F.array(mark(F.lit(CLOSE))))


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows of ``conv_id, turn, role, text``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = chats.select("conv_id", F.flatten(F.transform(_runs(F.col("turns")), _pieces)).alias("pieces"))
    starts = prefix_sums(F.transform("pieces", lambda p: F.length(p["s"]).cast("long")))
    spans = F.transform(F.filter(F.zip_with("pieces", starts, lambda p, at: F.struct(
        p["loss"].alias("loss"), at.alias("start"), (at + F.length(p["s"])).alias("end"))), lambda x: x["loss"]),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as ``array<struct<role, text>>``: the inverse of ``format_chats``."""
    def turns(chunk: Column) -> Column:
        head = F.substring_index(chunk, ">", 1)
        role = F.replace(F.substring(head, len(OPEN) + 1, 1 << 30), F.lit("\\g"), F.lit(">"))
        body = F.substr(chunk, F.length(head) + 2)
        return F.transform(F.split(body, PART, -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))
    chunks = F.split(formatted, CLOSE, -1)
    return F.flatten(F.transform(F.filter(chunks, lambda c: c != ""), turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts say when read back."""
    turns, loss = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss_spans"))
    back = chats.select("conv_id", turns.alias("t"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")
