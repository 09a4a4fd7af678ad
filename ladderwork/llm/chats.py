"""Chat formatting: cumulative snapshots of a conversation are collapsed to the maximal ones, which are rendered.

Chat logs often store a conversation again after every turn. Each turn's content is hashed with its position; the running
combination of these hashes names every prefix of a conversation. A conversation whose whole name is a shorter prefix of
another is a snapshot of it: anti-joins keep the others. DataFrame functions only.

Positions and running hashes are computed in two levels (turns within a chunk, then chunks), and texts are rendered by
chunk, so a conversation that holds a third of all turns is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of turns that a chunk spans.
CHUNK_TURNS = 512


def _chunked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, chunk (by turn number), position in the conversation (from 1) and the chunk's hash keys."""
    rows = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"), "role", "text")
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside).cast("bigint"))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["conv_id", "chunk"]).withColumn("position", F.col("place") + F.col("offset")).drop("place", "offset")


def _turn_hash(seed: int) -> Column:
    """Of position, role and text; null differs from empty."""
    null = lambda c: F.col(c).isNull().cast("int")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.xxhash64(F.lit(seed), "position", null("role"), blank("role"), null("text"), blank("text"))


def prefix_names(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, length and the two 64-bit hashes of each prefix of each conversation."""
    rows = turns.select("conv_id", "chunk", "position", _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    chunk = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunk.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "ab"])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({c: F.bit_xor(c).over(inside) for c in "ab"}).join(carried, ["conv_id", "chunk"])
    return running.select("conv_id", "chunk", F.col("position").alias("length"), *[F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in "ab"])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of conversations that are no prefix of another, and n_equal: logged copies it stands for, itself
    included. Of equal conversations the smallest conv_id stays."""
    names = prefix_names(_chunked(turns))
    n_turns = names.groupBy("conv_id").agg(F.max("length").alias("n_turns"))
    named = names.join(n_turns, "conv_id")
    whole = named.where("length = n_turns").groupBy("length", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    shorter = named.where("length < n_turns").select("length", "a", "b").distinct()
    return whole.join(shorter, ["length", "a", "b"], "left_anti").select("conv_id", F.col("length").alias("n_turns"), "n_equal")


def rendered_turn(role: Column, text: Column) -> Column:
    """<|role|>, a line end, the text, <|end|> and a line end; a null role is 'unknown', a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def formatted_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations as training text.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role and text; a null
    turn counts as 0; rows of a null conv_id are left out; repeated rows are turns of their own. One row per conversation
    and CHUNK_TURNS turn numbers (an ordinary conversation has one): conv_id, part, n_turns and n_equal of the
    conversation, text. Parts of a conversation in order make its text. An empty table gives no rows.
    """
    kept = maximal_conversations(turns)
    rows = _chunked(turns).join(kept, "conv_id")
    one = F.struct("position", rendered_turn(F.col("role"), F.col("text")).alias("text"))
    parts = rows.groupBy("conv_id", "chunk", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return parts.select("conv_id", F.col("chunk").alias("part"), "n_turns", "n_equal", F.array_join("turns.text", "").alias("text"))


FORMATTED_SQL = """
with logged as (
  select conv_id, count(*) as n_turns, list(struct_pack(r := role, t := text) order by turn, role nulls first, text nulls first) as turns,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by turn, role nulls first, text nulls first) as rendered
  from conversations where conv_id is not null group by conv_id),
firsts as (select min(conv_id) as conv_id, count(*) as n_equal, n_turns, turns, any_value(rendered) as rendered from logged group by n_turns, turns),
prefixes as (select distinct k as n_turns, turns[1:k] as turns from (select turns, n_turns, unnest(range(1, n_turns)) as k from logged))
select conv_id, cast(0 as bigint) as part, n_turns, n_equal, rendered as text
from firsts f where not exists (select 1 from prefixes p where p.n_turns = f.n_turns and p.turns = f.turns)
"""
