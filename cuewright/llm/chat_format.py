"""Chat formatting with cumulative-snapshot collapse. DataFrame operations only.

Loggers often store a conversation anew after every turn, so that one log is a prefix of the next.
Each conversation's turns are put in order; a rolling hash stands for every prefix (a sum of two
64-bit hashes of position, role and text, kept in decimals, so it can be summed in parts). A
conversation whose whole hash is a strict prefix's hash of another goes (anti-join); of equal ones
the smallest id stays. The maximal conversations are rendered.

Nothing is gathered per conversation: turns are sorted over ranges and cut into blocks of ``BLOCK``
rows at most, positions and hashes come from prefix sums over blocks, and the rendered text comes in
parts of ``BLOCK`` turns, so a conversation with a large share of all rows, or many rows of one turn
number or of none, is spread over tasks. Texts are not read again until the kept ones are rendered.

Defined results: turns are ordered by turn (nulls first), role, text. Identical rows count once. A
null id is a conversation of its own. A null role renders as ``unknown``, a null text as empty; they
differ from the literal values when conversations are compared. ``<|`` inside a text is rendered as
``< |``. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import written

BLOCK = 64
#: Characters of role and text in the keys that ranges are drawn from (a sample of keys goes to the driver).
KEY_CHARS = 64


def ordered_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, at, block, role, text, hc, hd): distinct turns with two hashes of their content.

    Whole rows are sorted over ranges, so no conversation or turn number sets the size of a task.
    ``at`` follows a conversation's order; in one of its blocks, of ``BLOCK`` rows at most, without gaps.
    """
    turns = rows.select(F.col(id_col).alias("conv"), "turn", "role", "text").distinct()
    role = F.substring("role", 1, KEY_CHARS)  # a role that fills its key may be cut, so its texts stay in one range
    text = F.when(F.length("role") >= KEY_CHARS, F.lit("")).otherwise(F.substring("text", 1, KEY_CHARS))
    ranges = [c.asc_nulls_first() for c in (F.col("conv"), F.col("turn"), role, text)]
    turns = turns.repartitionByRange(*ranges).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")))
    turns = turns.withColumn("at", F.monotonically_increasing_id())
    content = [F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))]
    return turns.select("conv", "at", F.floor(F.col("at") / BLOCK).alias("block"), "role", "text", F.xxhash64(*content).alias("hc"), F.xxhash64(*content, F.lit("second")).alias("hd"))


def block_starts(turns: DataFrame) -> DataFrame:
    """(c2, b2, offset): what to add to ``at`` in each block of a conversation to have the position, from 1."""
    sizes = turns.groupBy("conv", "block").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("c").over(before), F.lit(0))
    return sizes.select(F.col("conv").alias("c2"), F.col("block").alias("b2"), (start + 1 - F.col("first")).alias("offset"))


def in_block() -> Column:
    return F.col("conv").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("b2"))


def maximal_conversations(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv, n): the conversations that are no strict prefix of another, the smallest id of equal ones."""
    position = F.col("at") + F.col("offset")
    placed = turns.select("conv", "block", "at", "hc", "hd").join(starts, in_block()).select(
        "conv", "block", position.alias("n"),
        F.xxhash64(position, "hc", "hd").cast("decimal(38,0)").alias("ha"),
        F.xxhash64("hd", "hc", position).cast("decimal(38,0)").alias("hb"),
    )
    inside = Window.partitionBy("conv", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    slim = placed.select("conv", "block", "n", *(F.sum(h).over(inside).alias(h) for h in ("ha", "hb")))
    blocks = slim.groupBy("conv", "block").agg(F.max(F.struct("n", "ha", "hb")).alias("end"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = blocks.select(F.col("conv").alias("c2"), F.col("block").alias("b2"), *(F.coalesce(F.sum(f"end.{h}").over(before), zero).alias(f"s{h}") for h in ("ha", "hb")))
    rolling = slim.join(sums, in_block()).select("conv", "n", (F.col("ha") + F.col("sha")).alias("ha"), (F.col("hb") + F.col("shb")).alias("hb"))
    lengths = rolling.groupBy("conv").agg(F.max(F.struct("n", "ha", "hb")).alias("whole"))
    # Equal conversations become one before the anti-join, so both of its sides hold a prefix once.
    whole = lengths.select("conv", "whole.*").groupBy("n", "ha", "hb").agg(F.min("conv").alias("conv"))
    size = lengths.select(F.col("conv").alias("c2"), F.col("whole.n").alias("size"))
    strict = rolling.join(size, F.col("conv").eqNullSafe(F.col("c2"))).where("n < size").select("n", "ha", "hb").distinct()
    return whole.join(strict, ["n", "ha", "hb"], "left_anti").select("conv", "n")


def render_chats(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, first_turn, n_turns (of the conversation), rendered: one row per ``BLOCK`` turns of a maximal conversation.

    Where equal conversations include one without id, the smallest id that is not null stays.
    """
    turns = written(ordered_turns(rows, id_col), "turns")
    starts = written(block_starts(turns), "starts")
    kept = maximal_conversations(turns, starts).select("conv", "n")
    own = starts.join(kept, F.col("conv").eqNullSafe(F.col("c2"))).drop("conv")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text, F.lit("<|end|>\n"))
    pieces = turns.join(own, in_block()).select("conv", "n", (F.col("at") + F.col("offset")).alias("position"), piece.alias("piece"))
    part = F.floor((F.col("position") - 1) / BLOCK).alias("part")
    parts = pieces.groupBy("conv", "n", part).agg(F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("s"))  # BLOCK turns at most
    return parts.select(F.col("conv").alias(id_col), (F.col("part") * BLOCK + 1).alias("first_turn"), F.col("n").alias("n_turns"), F.array_join("s.piece", "").alias("rendered"))


ORACLE = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), convs AS (
  SELECT conv_id, count(*) AS n,
    list(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS content,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), ''
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT content[1:k] AS content FROM convs, LATERAL (SELECT unnest(range(1, n)) AS k)
), maximal AS (
  SELECT min(conv_id) AS conv_id FROM convs WHERE content NOT IN (SELECT content FROM prefixes) GROUP BY content
)
SELECT conv_id, CAST(1 AS BIGINT) AS first_turn, n AS n_turns, rendered FROM convs JOIN maximal USING (conv_id)
"""
