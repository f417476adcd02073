"""Dialogues rendered once from the view of every participant, by DataFrame functions only.

For each participant the dialogue is rendered with their turns as the assistant's
and the other participants as named users; the mask lists the code points that
the assistant wrote, that is, what a model is trained on in that rendering. Turns
of a system role belong to nobody and are rendered as such in every view.

A dialogue is rendered in segments of SEGMENT_TURNS turn numbers, so that no
group is larger than that, whatever the dialogue's length; segments of a view,
put together by their number, are the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

SEGMENT_TURNS = 4096
SYSTEM_ROLES = ("system",)


def _header(role: Column, view: Column) -> Column:
    return (
        F.when(role.isin(*SYSTEM_ROLES), F.lit("<|im_start|>system\n"))
        .when(role == view, F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), role, F.lit("\n")))
    )


FOOTER = "<|im_end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conv_id, perspective and segment: n_turns, rendered, mask.

    ``mask`` is "start:end" of each assistant text in ``rendered``, end exclusive,
    with the end mark, joined by commas. Turns are in order of turn, role and text,
    rows that repeat one another stay apart. Turns without a number come first, in the
    segment -1. A null role is the participant "unknown", a null text is empty (texts of
    any length are rendered whole). A row without conv_id belongs to no known dialogue and
    is one by itself, in segment 0; a dialogue with system turns only has no views. An
    empty table gives no rows. Other columns are not read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    alone = rows.where("conv_id is null").select("conv_id", F.lit(0).cast("long").alias("segment"), F.array(F.struct("turn", "role", "text")).alias("turns"), F.col("role").alias("perspective")).where(~F.col("role").isin(*SYSTEM_ROLES))
    rows = rows.where("conv_id is not null")
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-1))
    turns = rows.withColumn("segment", segment.cast("long")).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    views = rows.where(~F.col("role").isin(*SYSTEM_ROLES)).select(F.col("conv_id").alias("view_conv"), F.col("role").alias("perspective")).distinct()
    both = turns.join(views, F.col("conv_id") == F.col("view_conv")).drop("view_conv").unionByName(alone)
    view = F.col("perspective")
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(_header(t.role, view), t.text, F.lit(FOOTER))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc.at + F.length(_header(t.role, view))
        end = begin + F.length(t.text) + len(FOOTER)
        mine = (t.role == view) & ~t.role.isin(*SYSTEM_ROLES)
        return F.struct(end.alias("at"), F.when(mine, F.concat(acc.out, F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(acc.out).alias("out"))

    mask = F.aggregate("turns", start, step, lambda acc: F.array_join(acc.out, ","))
    return both.select("conv_id", "perspective", "segment", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN 0 ELSE coalesce(CAST(floor(turn / 4096.0) AS BIGINT), -1) END AS segment,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone
  FROM conversations
), views AS (
  SELECT DISTINCT conv_id, lone, role AS perspective FROM turns WHERE role <> 'system'
), parts AS (
  SELECT t.conv_id, t.lone, v.perspective, t.segment, t.turn, t.role, t.text,
         CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN t.role = v.perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.lone = v.lone
), placed AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER (
      PARTITION BY conv_id, lone, perspective, segment ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM parts
)
SELECT conv_id, perspective, segment, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CASE WHEN role = perspective
         THEN CAST(CAST(stop - length(text) - 11 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM placed GROUP BY conv_id, lone, perspective, segment
"""
