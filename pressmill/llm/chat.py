"""Chat formatting: a dialogue from the view of each of its participants.

For every speaker the dialogue is rendered with that speaker's turns as
``assistant``, the turns of the others as ``user name=...`` and system turns as
``system``.  Masks are the character spans that the speaker wrote (its words and
the closing mark), which are the ones to train on.

A dialogue comes in parts of ``part_rows`` turns in order, the last one shorter, so
one that holds a third of all rows is spread over tasks and no text is gathered in a
group of more turns; the parts of a view, in order, are the whole dialogue, and
``char_offset`` says where a part starts.  Turns are numbered by a range sort whose
partitions are counted and summed up; offsets are sums of lengths, first inside
groups of ``GROUP_PARTS`` parts, then over the groups.

Defined results: a null role is the speaker ``unknown``, a null text is empty, a
null turn comes first, null conversation ids make up one conversation.  A turn
that was delivered more than once (all four columns equal) is rendered once.
Ties of a turn number go by role, then text.  A dialogue of system turns alone
has no participant and gives no row.  What looks like a mark is told from one by a
backslash: in texts ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``), in roles
``|>`` too, and a line end in a role becomes a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PART_ROWS, GROUP_PARTS = 64, 1024
SYSTEM = "system"
ASSISTANT_HEAD, SYSTEM_HEAD, TAIL = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def _user_head(role: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(_plain(role), "\\|(\\\\*)>", "|\\\\$1>"), "[\r\n]", " ")
    return F.concat(F.lit("<|user name="), name, F.lit("|>\n"))


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``rank``, their 0-based place in the conversation.

    A range sort gives rows ascending ids, which start with the partition; a
    conversation's ranks go on from partition to partition by their counts."""
    key = ["conv_id", "turn", "role", "text"]
    rows = stored(turns.distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("piece", F.shiftright("row", 33))
    pieces = rows.groupBy("conv_id", "piece").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv_id").alias("p_conv"), F.col("piece").alias("p_piece"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    on = F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("piece") == F.col("p_piece"))
    return rows.join(pieces, on).select("conv_id", "turn", "role", "text", (F.col("row") + F.col("shift")).alias("rank"))


def _offsets(lengths: DataFrame) -> DataFrame:
    """``lengths(conv_id, perspective, part, chars)`` with the sum of ``chars`` of the parts before."""
    view = ["conv_id", "perspective"]
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    grouped = stored(lengths.withColumn("group", F.floor(F.col("part") / GROUP_PARTS)))
    groups = grouped.groupBy(*view, "group").agg(F.sum("chars").alias("chars"))
    groups = groups.select(F.col("conv_id").alias("g_conv"), F.col("perspective").alias("g_view"), F.col("group").alias("g"), F.coalesce(F.sum("chars").over(earlier(view, "group")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("chars").over(earlier([*view, "group"], "part")), F.lit(0))
    on = F.col("conv_id").eqNullSafe(F.col("g_conv")) & (F.col("perspective") == F.col("g_view")) & (F.col("group") == F.col("g"))
    return grouped.withColumn("inside", inside).join(groups, on).select(*view, "part", (F.col("start") + F.col("inside")).alias("char_offset"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """``conv_id, perspective, part, char_offset, n_turns, text, spans`` with spans
    as ``array<struct<start, end>>`` of 0-based character positions in ``text``."""
    turns = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = _ordered(turns).withColumn("part", F.floor(F.col("rank") / part_rows))
    turns = turns.select(
        "conv_id", "part", "rank", "role", F.when(F.col("role") == SYSTEM, SYSTEM_HEAD).otherwise(_user_head(F.col("role"))).alias("head"), F.concat(_plain(F.col("text")), F.lit(TAIL)).alias("body"),
    )
    # 1. Lengths: a part as all would see it, and what the speaker's own heads change.
    sizes = turns.groupBy("conv_id", "part").agg(F.sum((F.char_length("head") + F.char_length("body")).cast("long")).alias("chars"))
    own = turns.filter(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("o_conv"), F.col("role").alias("perspective"), F.col("part").alias("o_part"))
    own = stored(own.agg(F.sum((len(ASSISTANT_HEAD) - F.char_length("head")).cast("long")).alias("more")))
    speakers = own.select(F.col("o_conv").alias("s_conv"), "perspective").distinct()
    views = sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("s_conv"))).drop("s_conv")
    mine = own.withColumnRenamed("perspective", "o_view")
    views = views.join(mine, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")) & (F.col("perspective") == F.col("o_view")), "left")
    at = _offsets(views.select("conv_id", "perspective", "part", (F.col("chars") + F.coalesce("more", F.lit(0))).alias("chars")))
    at = at.select(F.col("conv_id").alias("v_conv"), "perspective", F.col("part").alias("v_part"), "char_offset")

    # 2. Texts: each part meets its views.
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "head", "body"))).alias("turns"))
    views = parts.join(at, F.col("conv_id").eqNullSafe(F.col("v_conv")) & (F.col("part") == F.col("v_part")))
    mark = lambda t: F.when(t["role"] == F.col("perspective"), ASSISTANT_HEAD).otherwise(t["head"])
    pieces = F.transform("turns", lambda t: F.struct(mark(t).alias("head"), t["body"].alias("body"), (t["role"] == F.col("perspective")).alias("own")))

    def walk(state, p):
        start = state["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.struct(start.alias("start"), (end - 1).alias("end"))  # the line end after the mark isn't learnt
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return views.withColumn("pieces", pieces).select(
        "conv_id", "perspective", "part", "char_offset", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("pieces", empty, walk, lambda s: s["spans"]).alias("spans"),
    )
