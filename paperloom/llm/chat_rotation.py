"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the
others as named users and system turns as they are; only the assistant's words are to be learned.

A dialogue is one row per participant up to ``part_bytes``.  A longer one goes on in further parts, cut between
turns in the dialogue's order: the texts of its parts, joined, are the whole rendering.  Where a part begins
follows from the bytes before it, which ranges of the sorted turns sum up, so no task holds a long dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, null_safe

# The rendered format.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM, UNKNOWN = "system", "unknown"

#: Bytes that a turn counts beside its role and text: markers and its segment.
TURN_BYTES = 64
ORDER = ("turn", "role", "__digest")


def plain(text: Column) -> Column:
    """Text that cannot be taken for a control token."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.translate(plain(F.coalesce(role, F.lit(UNKNOWN))), "\n\r", "  ")


def _head(role: Column, participant: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit(START + SYSTEM + BREAK))
        .when(role == participant, F.lit(START + "assistant" + BREAK))
        .otherwise(F.concat(F.lit(START + "user name="), _name(role), F.lit(BREAK)))
    )


def _body(text: Column) -> Column:
    return F.concat(plain(text), F.lit(END))


def _long_parts(rows: DataFrame, long: DataFrame, part_bytes: int) -> DataFrame:
    """The turns of long dialogues with their part: the bytes before a turn, by ranges of the sorted turns."""
    dealt = materialize(null_safe(rows, long, ["conv_id"], "left_semi").withColumn("__salt", F.monotonically_increasing_id()), "chat-dealt")
    placed = materialize(dealt.orderBy("conv_id", *ORDER, "__salt").withColumn("__at", F.monotonically_increasing_id()), "chat-placed")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    before = W.partitionBy("conv_id").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("conv_id", "__range").agg(F.sum("__cost").alias("__sum"))
    ranges = ranges.select("conv_id", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__from"))
    inside = W.partitionBy("conv_id", "__range").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = null_safe(placed.withColumn("__upto", F.sum("__cost").over(inside)), ranges, ["conv_id", "__range"])
    return placed.withColumn("part", F.floor((F.col("__from") + F.col("__upto") - F.col("__cost")) / F.lit(part_bytes)).cast("long")).select(*rows.columns, "part")


def rotate_perspectives(turns: DataFrame, part_bytes: int = 1 << 24) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, participant, part, n_turns, segments, text.

    One row per participant and part; ``segments``: turn, speaker, mask (whether to learn it), and start
    and end of the words with their end token in ``text`` (code points, end exclusive).  Turns go by
    number, ties by role and by the MD5 of the text; a null turn comes first, a null text is empty, a null
    role speaks as "unknown" and, like "system", gets no perspective of its own.  A null conv_id is one
    conversation.  Conversations without participants yield nothing, as does an empty table; repeated
    rows are repeated turns; other columns are ignored, whatever their names.  A turn belongs to part
    floor(bytes of the turns before it / ``part_bytes``), with ``TURN_BYTES`` for each turn beside its role and text;
    so part numbers rise from 0, a turn is never cut, and one that is longer than a part skips numbers.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    cost = F.octet_length("text") + F.coalesce(F.octet_length("role"), F.lit(0)) + TURN_BYTES
    rows = rows.withColumns({"__digest": F.md5("text"), "__cost": cost.cast("long")})
    long = materialize(rows.groupBy("conv_id").agg(F.sum("__cost").alias("__all")).filter(F.col("__all") > part_bytes).select("conv_id"), "chat-long")
    speakers = turns.filter((F.col("role") != SYSTEM) & F.col("role").isNotNull()).select("conv_id", F.col("role").alias("participant")).distinct()
    if long.isEmpty():
        rows, speakers = rows.withColumn("part", F.lit(0).cast("long")), speakers.withColumn("part", F.lit(0).cast("long"))
    else:
        cut = materialize(_long_parts(rows, long, part_bytes), "chat-parts")
        numbers = materialize(cut.select("conv_id", "part").distinct(), "chat-numbers")
        rows = null_safe(rows, long, ["conv_id"], "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(cut)
        speakers = null_safe(speakers, numbers, ["conv_id"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    # How far a turn reaches if everybody is a user; a participant's own turns are shorter by the same number each.
    so_far = W.partitionBy("conv_id", "part").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    width = F.length(_head(F.col("role"), F.lit(None).cast("string"))) + F.length(_body(F.col("text"))) + 1
    rows = rows.withColumn("__upto", F.sum(width.cast("long")).over(so_far))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("__upto", "turn", "role", "text"))).alias("said"))
    both = null_safe(parts, materialize(speakers, "chat-speakers"), ["conv_id", "part"])
    who = F.col("participant")
    own = F.array_compact(F.transform("said", lambda s, i: F.when(s["role"] == who, i + 1)))
    both = both.withColumns({"__own": own, "__less": F.length(_head(who, F.lit(None).cast("string"))) - F.length(_head(who, who))})

    def stretch(k: Column) -> Column:
        """Segments from the participant's k-th own turn to the one before the next; from the first turn for k = 0."""
        first = F.when(k == 0, 1).otherwise(F.get("__own", k - 1))
        upto = F.coalesce(F.get("__own", k), F.size("said") + 1)
        end = lambda s: s["__upto"] - k * F.col("__less") - 1
        return F.transform(
            F.slice("said", first, upto - first),
            lambda s: F.struct(
                s["turn"].alias("turn"),
                s["role"].alias("speaker"),
                F.coalesce(s["role"] == who, F.lit(False)).alias("mask"),
                (end(s) - F.length(_body(s["text"]))).cast("int").alias("start"),
                end(s).cast("int").alias("end"),
            ),
        )

    segments = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__own")), stretch))
    text = F.array_join(F.transform("said", lambda s: F.concat(_head(s["role"], who), _body(s["text"]), F.lit(BREAK))), "")
    return both.select("conv_id", "participant", "part", F.size("said").alias("n_turns"), segments.alias("segments"), text.alias("text"))
