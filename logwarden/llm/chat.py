"""Chat formatting by perspective rotation (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Turn numbers per chunk of the running length, so that no task adds up a whole long dialogue.
CHUNK = 1024

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation, participant and turn: the dialogue as that participant sees it.

    The participant's own turns are the assistant's and are trained on; the others speak as named users.
    Columns: conv_id, perspective, turn, speaker, trained, rendered, start, stop, target_start,
    target_stop.  The dialogue is the ``rendered`` parts in the order of ``start``, which counts its
    characters; a trained turn's target is its text with the closing mark, other turns have none.

    A null role is the participant "unknown", a null text is empty, turns without conversation belong to one
    of their own.  Null turns come first; equal turns are ordered by role and text, and repeated rows are said twice.
    An empty table gives no rows; other columns are left out.
    """
    said = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    people = said.select(F.col("conv_id").alias("of_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), "speaker", F.lit("\n")))
    seen = seen.withColumn("head", head).withColumn("size", F.length("head") + F.length("text") + len(CLOSE))
    seen = seen.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    dialogue = ["conv_id", "perspective"]
    sums = seen.groupBy(*dialogue, "chunk").agg(F.sum("size").alias("chunk_size"))
    earlier = Window.partitionBy(*dialogue).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in (*dialogue, "chunk")], F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*dialogue, "chunk").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*dialogue, "chunk")]
    placed = seen.withColumn("upto", F.sum("size").over(inside)).join(sums, same[0] & same[1] & same[2])
    stop = F.col("before") + F.col("upto")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", own.alias("trained"), F.concat("head", "text", F.lit(CLOSE)).alias("rendered"),
        (stop - F.col("size")).alias("start"), stop.alias("stop"),
        F.when(own, stop - F.col("size") + F.length("head")).alias("target_start"), F.when(own, stop - 1).alias("target_stop"))


PERSPECTIVES_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM said),
seen AS (SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS trained,
    CASE WHEN speaker = perspective THEN '{OPEN}assistant' || chr(10) ELSE '{OPEN}user name=' || speaker || chr(10) END AS head
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
sized AS (SELECT *, length(head) + length(text) + {len(CLOSE)} AS size FROM seen),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM sized)
SELECT conv_id, perspective, turn, speaker, trained, head || text || '<|im_end|>' || chr(10) AS rendered, stop - size AS start, stop,
  CASE WHEN trained THEN stop - size + length(head) END AS target_start, CASE WHEN trained THEN stop - 1 END AS target_stop FROM placed
"""
